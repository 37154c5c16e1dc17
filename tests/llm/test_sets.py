"""Operators that compare documents, against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from treeglyph.llm import components, linededup, minhash, packing, perfect, suffixes  # noqa: E402
from treeglyph.llm.common import compact, shared_table, sized_like  # noqa: E402
from treeglyph.llm.queries import vocabulary  # noqa: E402

WORDS = vocabulary("word_bpe_49k.json")


MORE = {"spans": "string", "drops": "int", "n_chars": "long", "id": "string", "__key": "string", "__drops": "string", "__DOC": "string", "__spans": "string"}
NAMES = ["doc_id", "text", *MORE]


def docs_of(spark, rows):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "a", 0, i, None, "k", "d", "D", "s") for i, t in rows], f"doc_id long, text string, {', '.join(f'{c} {k}' for c, k in MORE.items())}")


# --- perfect hash


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(-(2**63), 2**63, n, dtype=np.int64)
    keys = np.unique(keys)
    h = perfect.PerfectHash.build(keys)
    assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
    s = perfect.Shard.from_bytes(perfect.Shard.build(keys, keys ^ 5, np.arange(len(keys)) + 3, keys * 2).to_bytes())
    count, last = s.find(keys, keys ^ 5)
    assert (count == np.arange(len(keys)) + 3).all() and (last == keys * 2).all()
    assert (s.find(keys, keys ^ 7)[0] == 0).all()


def test_shard_with_equal_halves():
    place, mark = np.array([5, 5, 7, 5, -1]), np.array([1, 2, 3, 4, 5])
    s = perfect.Shard.from_bytes(perfect.Shard.build(place, mark, mark + 10, mark + 20).to_bytes())
    count, last = s.find(np.r_[place, 5, 8], np.r_[mark, 9, 1])
    assert count.tolist() == [11, 12, 13, 14, 15, 0, 0] and last[:5].tolist() == [21, 22, 23, 24, 25]


# --- lines


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20 and i is not None:
                holders.setdefault(k, []).append((i, n))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(h := holders.get(key(x), [])) < 3 or max(h)[0] == i]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows(n=120, seed=2):
    r = random.Random(seed)
    pool = [f"This Is a repeated line no {k:02d}" for k in range(12)] + ["short", "", "é" * 19, "É" * 20, "é" * 20, " " + "z" * 25, "z" * 25]
    rows = [(i, "\n".join(r.choice([" ", "\t", ""]) + r.choice(pool) + r.choice(["", " ", "\r"]) for _ in range(r.randint(0, 9)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "\n"), (7, rows[7][1]), (None, pool[0]), (n + 3, "\n".join(pool[:3] * 3000))]


@pytest.mark.parametrize("hot", [1, 1024])
def test_line_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(linededup, "HOT", hot)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 3)
    rows = line_rows()
    got = linededup.line_dedup_digests(docs_of(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_lines(rows)
    kept = linededup.line_dedup(docs_of(spark, rows))
    assert kept.columns == NAMES and kept.count() == len(rows)
    for r in kept.collect():
        old = {t for i, t in rows if i == r["doc_id"]}
        assert r["text"] in old or r["n_chars"] == len(r["text"])


def test_line_sql_says_the_same_of_any_rows():
    import duckdb
    import pandas as pd

    rows = [*line_rows(), (1, "Held by one id in many rows"), (1, "held by one id in many rows"), (2, "held by one id in many rows ")]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    got = con.sql(linededup.LINE_SQL).fetchall()
    assert sorted(((i, n, k, sha) for i, n, k, sha in got), key=str) == brute_lines(rows)


def test_line_dedup_of_nothing(spark):
    assert linededup.line_dedup_digests(docs_of(spark, []).limit(0)).count() == 0


# --- packing


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    r = random.Random(4)
    words = ["alpha", "Beta,", "don't", "naïve!", "12", "Über.", "x" * 30, "<|endoftext|>", "İ", "ΟΔΥΣΣΕΥΣ", "é"]
    rows = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 5, 50, 3000])))) for i in range(60)] + [(60, None), (61, ""), (0, "alpha"), (None, "beta")]
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x in rows]
    want = sorted((i, s, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(x)) for (i, _), x in zip(rows, ids, strict=True) for s in range(0, len(x), 2048) for p in [x[s : s + 2048]] if i is not None)
    got = packing.pack(docs_of(spark, rows).repartition(5), WORDS).collect()
    assert sorted((g["doc_id"], g["start"], g["length"], g["ids_crc32"], g["doc_tokens"]) for g in got if g["doc_id"] is not None) == want
    bins = {}
    for g in got:
        bins.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= sum(map(len, ids)) / 2048 * 1.05 + 1
    assert packing.pack(docs_of(spark, []).limit(0), WORDS).count() == 0


def test_ids_of_odd_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(WORDS), packing.WordIds(WORDS, special_ids=True, most=300)
    r = random.Random(1)
    bits = ["a", "B", "É", "ß", "ÿ", "x1", "12", "don't", "!", "...", "#", "<|", "|>", "<|endoftext|>", "İ", "Σ", "ς", "中", "\u212a", "'s", "\x1c", "\x85", "\u3000", "é", "THE", "\t", "\n", " ", "  ", "\r", "\x0b", "÷", "×"]
    for many in (3, 1 << 20):
        for _ in range(60):
            texts = ["".join(r.choices(bits, k=r.randint(0, 25))) for _ in range(40)] + [None, ""]
            ends, ids = w.encode(pa.array(texts, pa.string()).slice(1), many)
            assert [ids[a:z].tolist() for a, z in zip(ends[:-1], ends[1:], strict=True)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts[1:]]
    ends, ids = w.encode(pa.array([], pa.string()))
    assert ends.tolist() == [0] and len(ids) == 0


def test_packing_query_takes_the_ids_of_special_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    from treeglyph.llm.queries import op4_packing

    texts = ["hello <|endoftext|> world", "a<|endoftext|>b, <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", "hello\n<|endoftext|>\t!", "don't <|endoftext|>s naïve<|startoftext|>é"]
    docs_of(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(WORDS)
    ids = [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]
    assert ids[0] == [3306, 49407, 1002, 1]
    got = op4_packing(spark, str(tmp_path)).collect()
    assert sorted((g["doc_id"], g["length"], g["ids_crc32"]) for g in got) == [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)]


@pytest.mark.parametrize("histogram", [{}, {5: 1}, {2048: 3}, {1: 10_000, 7: 500, 300: 900}, {700: 1000, 640: 3}, {k: k % 7 for k in range(1, 2049)}])
def test_histogram_packing(histogram):
    slots = packing.shortest_pack_first(histogram)
    used = {}
    for length, n in histogram.items():
        seq, off = slots.place(np.full(n, length), np.arange(n))
        for s, o in zip(seq.tolist(), off.tolist(), strict=True):
            used.setdefault(s, []).append((o, length))
    assert len(used) == slots.n_sequences
    for b in used.values():
        at = 0
        for o, length in sorted(b):
            assert o == at
            at += length
        assert at <= 2048


# --- near duplicates


def brute_near(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        sets[i] = s
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in itertools.combinations(sorted(i for i in sets if sets[i]), 2):
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            comp[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_rows():
    r = random.Random(6)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=4)) for _ in range(3000)]
    rows, bases = [], [r.choices(vocabulary, k=120) for _ in range(6)]
    for i in range(260):  # one large family with edits of all sizes, some small ones
        w = list(bases[0] if i % 2 else r.choice(bases[1:]))
        for _ in range(r.choice([0, 0, 1, 2, 4, 6, 8, 12])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(300 + i, " ".join(r.choices(vocabulary, k=r.randint(1, 40)))) for i in range(60)]
    return [*rows, (400, None), (401, ""), (402, " \n"), (403, "One"), (404, "one"), (405, "a b"), (406, "A  b"), (407, "a b " * 5000), (408, "a b " * 5000 + "c")]


@pytest.mark.parametrize("words,large,few,block", [(2, 64, 16, 256), (2, 1, 0, 3), (5, 10**9, 0, 5), (5, 10**9, 10**9, 256), (5, 64, 2, 256)])
def test_near_duplicates(spark, monkeypatch, words, large, few, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_rows()
    got = minhash.near_duplicates(docs_of(spark, rows), words=words, large=large, few=few).collect()
    want = brute_near(rows, words, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.fixture
def many_partitions(spark):
    """More partitions of a shuffle than results get."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_as_many_partitions_as_rows_need(spark, many_partitions):
    big = spark.range(10_000).repartition("id")
    assert compact(big).rdd.getNumPartitions() <= 6 and compact(big, deal=True).rdd.getNumPartitions() == 6
    small, large = spark.range(10), spark.range(10**9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sized_like(big, small).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism and sized_like(big, large).rdd.getNumPartitions() == 48
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["id"] for r in compact(big, deal=True).collect()) == list(range(10_000))


@pytest.mark.parametrize("rounds,large", [(0, 64), (1, 64), (1, 1), (3, 64)])
def test_any_number_of_rounds_finds_the_same(spark, monkeypatch, many_partitions, rounds, large):
    monkeypatch.setattr(minhash, "BLOCK_ITEMS", 700)  # a few sets; one of the very long ones by itself is larger
    rows = near_rows()
    r = random.Random(13)
    long = [f"w{r.randrange(10**6)}" for _ in range(20_000)]
    rows += [(500 + i, " ".join(long[: 20_000 - 900 * i])) for i in range(5)]
    got = minhash.near_duplicates(docs_of(spark, rows), words=2, rounds=rounds, large=large).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_near(rows, 2, 80)


def test_keep_first_and_odd_tables(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (3, None), (3, "x y")]
    kept = minhash.keep_first(docs_of(spark, rows))
    assert kept.columns == NAMES
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted([("1", "a b c d e f g"), ("None", "a b c d e f g"), ("3", "None"), ("3", "x y")])
    assert minhash.near_duplicates(docs_of(spark, []).limit(0)).count() == 0


def test_rows_of_a_doc_id_are_one_node(spark):
    a, b, c, d = ("a b c d e f g", "h i j k l m n", "o p q r s t u", "v w x y z aa bb")
    rows = [(2, a), (3, a), (3, b), (9, b), (3, None), (4, c), (4, d), (5, d), (6, c), (7, d), (7, None), (8, None), (8, None), (None, a)]
    got = minhash.near_duplicates(docs_of(spark, rows)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(2, 2), (3, 2), (9, 2), (4, 4), (5, 4), (6, 4), (7, 4), (8, 8), (None, None)} and len(got) == len(rows)
    kept = minhash.keep_first(docs_of(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == sorted([("2", a), ("4", c), ("4", d), ("8", "None"), ("8", "None"), ("None", a)])


def test_sketch_estimates_similarity():
    s = minhash.Sketcher()
    r = np.random.default_rng(0)
    for n in (1, 3, 40, 3000):
        x = r.integers(0, 2**63, n, dtype=np.uint64)
        k = max(1, n * 9 // 10)
        y = np.concatenate([x[:k], r.integers(0, 2**63, n - k, dtype=np.uint64)])
        a, b = s.sketch(x), s.sketch(y)
        assert len(a) == s.t and not (a == minhash._NONE).any() and (s.sketch(x[::-1]) == a).all()
        assert abs((a == b).mean() - k / (2 * n - k)) < 0.15


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    comp = {}

    def find(i):
        comp.setdefault(i, i)
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            comp[max(x, y)] = min(x, y)
    got = {x["id"]: x["comp"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in comp}


# --- repeated strings


def brute_suffix(rows, width=100):
    """Rows of one doc_id are documents in the order of their texts."""
    seen, out = set(), []
    for i, t in sorted((i, t or "") for i, t in rows if i is not None):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            if w in seen:
                gone[p : p + width] = True
            seen.add(w)
        out.append((i, b, gone))
    out += [(i, (t or "").encode(), np.zeros(len((t or "").encode()), bool)) for i, t in rows if i is None]
    row = lambda b, g: (len(b), int(g.sum()), int((g[1:] & ~g[:-1]).sum() + (g[0] if len(g) else 0)), hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest())
    return sorted(((i, *row(b, g)) for i, b, g in out), key=str)


def suffix_rows():
    r = random.Random(9)
    passage = [" ".join("".join(r.choices("abcdeé", k=5)) for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passage)
            a = r.randrange(len(p) - 130)
            parts += [p[a : a + r.choice([40, 80, 99, 100, 101, 130, 300])], "".join(r.choices("xyz ", k=r.randint(0, 150)))]
        rows.append((i, "".join(parts)))
    return [*rows, (100, None), (101, ""), (102, "q" * 99), (103, "q" * 100), (104, "q" * 5000), (105, "ab" * 400), (106, "\0" * 300), (107, "q" * 99 + "\0" * 200), (108, passage[0]), (109, passage[0]), (110, passage[1]), (110, passage[1] + "!"), (None, passage[2]), (3, passage[3]), (3, None), (109, passage[0]), (111, passage[1][20:])]


@pytest.mark.parametrize("wide,block", [(suffixes.WIDE, suffixes.BLOCK), (0, 40), (4, 40)])
def test_suffix_dedup(spark, monkeypatch, wide, block):
    if wide == 4:
        monkeypatch.setattr(suffixes, "CHUNK", 700)
    rows = suffix_rows()
    got = suffixes.suffix_dedup_digests(docs_of(spark, rows), wide, block).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_suffix(rows)


def test_suffix_dedup_texts(spark, many_partitions):
    rows = suffix_rows()
    out = suffixes.suffix_dedup(docs_of(spark, rows))
    assert out.columns == NAMES and out.count() == len(rows)
    d = {r["doc_id"]: r for r in out.collect()}
    assert d[109]["text"] == "" and d[109]["n_chars"] == 0 and d[100]["text"] is None and d[102]["text"] == "q" * 99
    assert suffixes.suffix_dedup_digests(docs_of(spark, []).limit(0)).count() == 0


# --- shared tables and the pipeline


def test_shared_folder(spark):
    t = shared_table(spark.range(5).toDF("id"), "x")
    assert t.count() == 5 and spark.sparkContext.getConf().get("spark.checkpoint.dir") in t.inputFiles()[0]


def test_pipeline_stage_by_stage(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tests.conftest import SF
    from treeglyph.llm import quality

    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    for name, stage in corpus_pipeline.STAGES:
        before = rows(docs)
        out = shared_table(stage(spark, docs, SF), "stage")
        if name != "packing":
            columns = columns or docs.columns
            assert out.columns == columns
        if name == "quality rules":
            kept = {r["doc_id"] for r in quality.quality_verdicts(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
            assert rows(out) == [r for r in before if r[0] in kept]
        elif name == "line dedup":
            want = {i: (k, sha) for i, _, k, sha in brute_lines(before)}
            assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows(out)} == {i: sha for i, (_, sha) in want.items()}
        elif name == "near dedup":
            comp = brute_near(before, 5, 80)
            assert [i for i, _ in rows(out)] == [i for i, _ in before if comp[i][1] == i]
        elif name == "suffix dedup":
            lost = {i: n for i, _, n, _, _ in brute_suffix(before)}
            old = dict(before)
            for i, t in rows(out):
                assert 0 <= len((old[i] or "").encode()) - lost[i] <= len((t or "").encode()) and (lost[i] or t == old[i])
        else:
            assert {r["doc_id"] for r in out.collect()} == {i for i, _ in before}
        docs = out
