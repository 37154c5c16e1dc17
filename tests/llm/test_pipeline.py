"""The pipeline from end to end, against a brute-force version of its five stages."""

import itertools
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from treeglyph.llm import packing, quality  # noqa: E402
from treeglyph.llm.queries import vocabulary  # noqa: E402

from .test_maps import brute_kept  # noqa: E402
from .test_sets import brute_near  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, __key string, __doc int, spans int, items int, comp int"


def documents():
    r = random.Random(23)
    vocabulary_ = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(2500)]
    prose = lambda n: [r.choice(vocabulary_) for _ in range(n)]
    lines = [" ".join(prose(6)) + " line" for _ in range(4)]
    passages = [" ".join(prose(60)) for _ in range(3)]
    bases = [prose(150) for _ in range(5)]
    rows = []
    for i in range(380):
        kind = r.random()
        words = prose(r.choice([30, 60, 120]))
        if kind < 0.15:
            words = list(r.choice(bases))
            for _ in range(r.choice([0, 1, 2, 3, 6, 30])):
                words[r.randrange(len(words))] = r.choice(vocabulary_)
        elif kind < 0.25:
            words = words[:40] + [r.choice(passages)[r.randint(0, 40) :]] + words[40:]
        elif kind < 0.3:
            words = ["$$$" + w for w in words]
        text = " ".join(words)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            text += "\n" + r.choice(["", " ", "\t"]) + r.choice([lines[0].upper(), *lines]) + "\n" + " ".join(prose(9))
        rows.append((i, text, "en" if i % 9 else None))
    long = prose(6000)
    rows += [(400, None, "en"), (401, "", "en"), (402, " ".join(long), "en"), (403, " ".join(long[:5900]), "en"), (404, "few words", "en"), (7, " ".join(prose(50)), "en"), (7, rows[7][1], "en"), (None, rows[3][1], "en")]
    rows += [(405, " ".join(prose(30)) + " <|endoftext|> naïve É" + " ".join(prose(30)), None), (406, "é" * 99 + " " + " ".join(prose(25)), "en"), (407, " ".join(prose(25)) + " é" + "é" * 98, "en")]
    r.shuffle(rows)
    return rows


def line_stage(rows):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t, _ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20 and i is not None:
                holders.setdefault(k, []).append(i)
    stays = lambda i, x: len(h := holders.get(key(x), [])) < 3 or max(h) == i
    return [(i, t if t is None or i is None else "\n".join(x for x in t.split("\n") if stays(i, x)), lang) for i, t, lang in rows]


def near_stage(rows):
    named = [(i, t) for i, t, _ in rows if i is not None]
    comp, nodes = {}, {n: t for n, (_, t) in enumerate(named)}
    of_sets = brute_near(list(nodes.items()), 5, 80)
    edges = [(named[n][0], named[of_sets[n][1]][0]) for n in nodes]  # rows of one id are one node

    def find(i):
        comp.setdefault(i, i)
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        comp[max(x, y)] = min(x, y)
    return [x for x in rows if x[0] is None or find(x[0]) == x[0]]


def suffix_stage(rows, width=100):
    seen, out = set(), []
    for i, t, lang in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1) if i is not None else ():
            w = b[p : p + width]
            gone[p : p + width] |= w in seen
            seen.add(w)
        if gone.any():
            at, left = 0, []
            for c in t:
                n = len(c.encode())
                left += [c] * (not gone[at : at + n].all())
                at += n
            t = "".join(left)
        out.append((i, t, lang))
    return out


def pieces(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for i, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            p = ids[s : s + 2048]
            yield i, s, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(ids)


def brute_fills(lengths, capacity):
    """What the sequences hold: each piece by itself, longest first, into the emptiest one; where it has no room, new ones of as many as fit."""
    fills = []
    for length, group in itertools.groupby(sorted(lengths, reverse=True)):
        n = len(list(group))
        while n:
            at = min(range(len(fills)), key=fills.__getitem__, default=None)
            if at is None or fills[at] + length > capacity:
                fit = capacity // length
                fills += [length * min(fit, n - k) for k in range(0, n, fit)]
                break
            fills[at] += length
            n -= 1
    return sorted(fills)


@pytest.mark.parametrize("seed", range(6))
def test_packing_against_brute_force(seed):
    r = random.Random(seed)
    lengths = r.choices(r.sample(range(1, 65), r.choice([2, 9, 40])), k=r.choice([1, 30, 700]))
    slots = packing.shortest_pack_first({x: lengths.count(x) for x in set(lengths)}, 64)
    fills = np.zeros(slots.n_sequences, np.int64)
    for x in set(lengths):
        sequence, _ = slots.place(np.full(lengths.count(x), x), np.arange(lengths.count(x)))
        np.add.at(fills, sequence, x)
    assert sorted(fills.tolist()) == brute_fills(lengths, 64)


def write(spark, folder, rows, labels):
    spark.createDataFrame([(i, t, lang, "s", len(t or ""), "k", 1, 2, 3, 4) for i, t, lang in rows], SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_against_brute_force(spark, tmp_path):
    rows = documents()
    good = {i for i, t, _ in rows if i is not None and "$" not in (t or "")}
    folder = write(spark, tmp_path, rows, [(i, int(i in good), 0) for i in {x[0] for x in rows} - {None}])
    keeps = brute_kept(rows, good, quality.Rules())
    kept = [x for x, (_, _, k) in zip(rows, keeps, strict=True) if k]
    assert len(kept) < len(rows) - 10 and any(not k and not b for _, b, k in keeps)  # the cutoffs reject some
    lined = line_stage(kept)
    assert lined != kept
    first = near_stage(lined)
    assert len(first) < len(lined) - 10
    last = suffix_stage(first)
    assert sum(len(t or "") for _, t, _ in last) < sum(len(t or "") for _, t, _ in first) - 1000
    got = corpus_pipeline.run(spark, folder).collect()
    want = list(pieces(last))
    assert sorted(((x["doc_id"], x["start"], x["length"], x["ids_crc32"], x["doc_tokens"]) for x in got), key=str) == sorted(want, key=str)
    fills = {}
    for x in sorted(got, key=lambda x: (x["sequence_id"], x["offset"])):
        assert fills.setdefault(x["sequence_id"], 0) == x["offset"]
        fills[x["sequence_id"]] += x["length"]
    assert sorted(fills.values()) == brute_fills([n for _, _, n, _, _ in want], 2048)


def test_stages_of_an_empty_table(spark, tmp_path):
    folder = write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
