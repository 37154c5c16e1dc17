"""Exact-substring dedup by blockwise suffix sorting over a cover sample.

Every byte goes that is covered by a string of WIDTH bytes which also starts earlier: in a smaller doc_id, or earlier in the same document.

Cover sample: of the K-byte strings in a window of WIDTH bytes the one with the least hash is sampled, the first of equal ones. Two equal windows thus
sample the same place, as with a difference cover, but only one position in about (WIDTH - K) / 2 is in the sample. A sampled place, with the run of
windows that sample it, has a hull: the bytes that these windows cover.

1. Sample ranks: places are sorted by K-byte prefix and hull, and places with equal hulls get the rank of the first; this settles all
   windows of the others, that is, all that lies inside a repeated passage.
2. Suffix buckets: of what is left, only places matter whose prefix has different hulls, and which agree with another one on half of what a window has besides
   the prefix. The suffixes at these places are read from the documents and sorted, one block of whole buckets at a time, and so are the reversed bytes before them. A window
   is a piece of either; windows of a bucket are equal if both pieces are in the same run of common prefixes.
3. A bucket with more than WIDE places is not held in memory: its windows are sorted by 128-bit hashes, as a stream.

Memory is bounded by a block, except for what a single document needs. No text is kept or shuffled but in two joins by doc_id.

Null and short texts lose nothing; an empty table gives an empty result; rows without a doc_id are neither compared nor changed; other columns stay as they
are. Rows with the same doc_id are documents in the order of their texts (equal ones in any order, so all but one lose what they share); only where
there are such rows is the table sorted and written anew, with numbers in that order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, drop_since, free_shuffles, map_arrow, shared_table, sized_like, tables_so_far, unused, utf8_values
from .minhash import mix

WIDTH, K = 100, 32
REST = WIDTH - K
HALF = REST // 2
CHUNK, BLOCK, WIDE = 2 << 20, 20_000, 20_000
_LOW = np.uint64(0xFFFFFF)
_SET = np.uint64(1 << 32)  # in the half of a hash that is kept: 0 stands for none
_ODD = mix(np.arange(1, 33, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _words_at_all(buf: bytes, n: int) -> np.ndarray:
    """A mixed 64-bit number of the eight bytes from each of n positions; buf goes on beyond n."""
    x = np.empty(n, np.uint64)
    for o in range(8):
        part = x[o::8]
        part[:] = np.frombuffer(buf, "<u8", len(part), o)
    return mix(x)


def _hash_at(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of ``size`` bytes from each place."""
    h = np.zeros(len(at), np.uint64)
    for o in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        h = mix(h * _ODD[0] + words[at + o])
    return h


def _chunks(docs: list[int], texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (doc, start, piece): pieces of long texts overlap by WIDTH - 1 bytes, so each window is in one piece."""
    out, size = [], 0
    for doc, text in zip(docs, texts, strict=True):
        for start in range(0, max(0, len(text) - WIDTH + 1), CHUNK):
            piece = text[start : start + CHUNK + WIDTH - 1] if len(text) > CHUNK else text
            if size + len(piece) > CHUNK and out:
                yield out
                out, size = [], 0
            out.append((doc, start, piece))
            size += len(piece)
    if out:
        yield out


def sample(chunk: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
    """The sampled places of a chunk: key and hull hashes, hashes of the prefix with half a rest after (r) or before it (l), doc, start of the first window, number of
    windows, offset of the place in the first window."""
    from xxhash import xxh3_64_intdigest

    sizes = np.array([len(p) for _, _, p in chunk], np.int64)
    buf = b"".join(p for _, _, p in chunk) + bytes(96)
    n, first = int(sizes.sum()), np.cumsum(sizes) - sizes
    words = _words_at_all(buf, n + 80)
    h = words[:n] * _ODD[1]
    for j in range(1, K // 8):
        h += words[8 * j : 8 * j + n] * _ODD[1 + j]
    h = mix(h)
    low, span = (h & ~_LOW) | np.arange(n, dtype=np.uint64), 1
    while 2 * span <= REST + 1:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    low = np.minimum(low[: len(low) - (REST + 1 - span)], low[REST + 1 - span :])
    count = sizes - WIDTH + 1
    piece = np.repeat(np.arange(len(sizes)), count)
    window = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + first[piece]
    place = (low[window] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])])
    n_windows = np.diff(np.r_[new, len(window)])
    start, place, piece = window[new], place[new], piece[new]
    end = start + n_windows + WIDTH - 1
    view = memoryview(buf)
    hull = np.fromiter((xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
    r = np.where(place + K + HALF <= end, _hash_at(words, place, K + HALF) | _SET, np.uint64(0))
    left = np.where(place - HALF >= start, _hash_at(words, np.maximum(place - HALF, 0), K + HALF) | _SET, np.uint64(0))
    doc = np.array([d for d, _, _ in chunk], np.int64)[piece]
    shift = np.array([s for _, s, _ in chunk], np.int64)[piece] - first[piece]
    return {"key": h[place].view(np.int64), "hull": hull.view(np.int64), "r": r, "l": left, "doc": doc, "start": start + shift, "n": n_windows, "rel": place - start}


_PLACES = "key long, hull long, rl long, doc long, at long"


def _merged(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans, with those that touch or overlap put together."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + size)[order]
    if not len(doc):
        return doc, start, end
    group = np.r_[0, np.cumsum(doc[1:] != doc[:-1])]
    lift = group * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    new = np.flatnonzero(np.r_[True, (start + lift)[1:] > reach[:-1]])
    last = np.r_[new[1:], len(doc)] - 1
    return doc[new], start[new], reach[last] - lift[last] - start[new]


def places(docs: DataFrame) -> DataFrame:
    """key, hull, rl (upper halves of r and l), doc, at (start, number of windows and offset in one). Where a chunk has equal places, the
    first only, and a span (hull null, rl: its length) for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in _chunks(b.column(0).to_pylist(), [t or b"" for t in utf8_values(b.column(1))]):
                x = sample(chunk)
                order = np.lexsort((x["start"], x["doc"], x["hull"], x["key"]))
                x = {k: v[order] for k, v in x.items()}
                again = np.r_[False, (x["key"][1:] == x["key"][:-1]) & (x["hull"][1:] == x["hull"][:-1])]
                doc, start, size = _merged(x["doc"][again], x["start"][again], x["n"][again] + WIDTH - 1)
                f = {k: v[~again] for k, v in x.items()}
                rl = ((f["r"] >> np.uint64(32) << np.uint64(32)) | (f["l"] >> np.uint64(32))).view(np.int64)
                at = (f["start"] << 16) | (f["n"] << 8) | f["rel"]
                spread = mix(doc.view(np.uint64) * _ODD[0] + start.view(np.uint64)).view(np.int64)
                hull = pa.array(np.r_[f["hull"], size], mask=np.r_[np.zeros(len(at), bool), np.ones(len(size), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[f["key"], spread]), hull, pa.array(np.r_[rl, size]), pa.array(np.r_[f["doc"], doc]), pa.array(np.r_[at, start])], names=[c.split()[0] for c in _PLACES.split(", ")])

    return map_arrow(docs, run, _PLACES)


_SETTLED = "kind int, doc long, start long, size long, key long"


def _doubtful(rows: np.ndarray) -> np.ndarray:
    """Of places (key, rl, doc, at) that are first of their hulls, sorted by key, those that agree with another one of their key on either half."""
    key, hit = rows[:, 0], np.zeros(len(rows), bool)
    x = rows[:, 1].view(np.uint64)
    for half in (x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)):
        order = np.lexsort((half, key))
        k, v = key[order], half[order]
        same = (k[1:] == k[:-1]) & (v[1:] == v[:-1]) & (v[1:] != 0)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
    return rows[hit]


def settle(found: DataFrame, wide: int = WIDE) -> DataFrame:
    """kind 0: a span to remove; kind 1: a place whose suffix is to be sorted (size: windows and offset); kind 2: such a place in a wide bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        held: list[np.ndarray] = []  # first places of the key that may go on
        wide_key: int | None = None

        def pack(kind: int, doc: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), *(pa.array(c, pa.int64()) for c in (doc, start, size, key))], names=[c.split()[0] for c in _SETTLED.split(", ")])

        def suffixes(kind: int, rows: np.ndarray) -> pa.RecordBatch:
            return pack(kind, rows[:, 2], rows[:, 3] >> 16, rows[:, 3] & 0xFFFF, rows[:, 0])

        for b in batches:
            span = b.column(1).is_null().to_numpy(zero_copy_only=False)
            key, rl, doc, at = (b.column(i).to_numpy() for i in (0, 2, 3, 4))
            yield pack(0, doc[span], at[span], rl[span], key[span])
            key, rl, doc, at = (c[~span] for c in (key, rl, doc, at))
            hull = b.column(1).drop_null().to_numpy()
            if not len(key):
                continue
            first = np.r_[last != (key[0], hull[0]), (key[1:] != key[:-1]) | (hull[1:] != hull[:-1])]
            last = (key[-1], hull[-1])
            yield pack(0, doc[~first], at[~first] >> 16, (at[~first] >> 8 & 255) + WIDTH - 1, key[~first])
            rows = np.stack([key[first], rl[first], doc[first], at[first]], axis=1)
            if held:
                rows = np.concatenate([*held, rows])
            if wide_key is not None:
                mine = rows[:, 0] == wide_key
                yield suffixes(2, rows[mine])
                rows = rows[~mine]
            open_ = rows[:, 0] == key[-1]
            yield suffixes(1, _doubtful(rows[~open_]))
            held = [rows[open_]]
            if open_.sum() > wide:
                wide_key = key[-1]
                yield suffixes(2, held[0])
                held = []
        if held:
            yield suffixes(1, _doubtful(held[0]))

    return map_arrow(found.repartition("key").sortWithinPartitions("key", "hull", "doc", "at"), run, _SETTLED)


def _with_places(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, text and the wanted places, as lists."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("kind", "start", "size", "key")).alias("places"))
    return docs.join(lists.hint("merge"), docs["doc_id"] == lists["doc"]).select("doc", "text", "places")


_FOUND = "kind int, a long, b long, doc long, start long, size long, hull binary"


def _found(held: DataFrame) -> DataFrame:
    """What is to be sorted, read from the texts in one pass. kind 1: a place with its hull (a: key); kind 2: a window of a wide bucket (a, b: its hash)."""
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def rows(kind: int, *columns: list | np.ndarray, hulls: list | None = None) -> pa.RecordBatch:
        arrays = [pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(c, pa.int64()) for c in columns)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(hulls, pa.binary()) if hulls is not None else pa.nulls(len(columns[0]), pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            narrow: list[tuple[int, int, int, int]] = []
            hulls: list[bytes] = []
            for doc, text, ps in zip(batch.column(0).to_pylist(), utf8_values(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                starts: list[int] = []
                for p in ps:
                    end = p["start"] + (p["size"] >> 8)
                    if p["kind"] == 1:
                        narrow.append((p["key"], doc, p["start"], p["size"]))
                        hulls.append(text[p["start"] : end + WIDTH - 1])
                    else:
                        starts += range(p["start"], end)
                if starts:
                    h = np.frombuffer(b"".join(xxh3_128_digest(text[s : s + WIDTH]) for s in starts), "<i8").reshape(-1, 2)
                    yield rows(2, h[:, 0], h[:, 1], np.full(len(h), doc), np.array(starts), np.full(len(h), WIDTH))
            if narrow:
                key, docs, start, size = np.array(narrow, np.int64).T
                yield rows(1, key, np.zeros(len(key), np.int64), docs, start, size, hulls=hulls)

    return map_arrow(held, run, _FOUND)


def _runs(matrix: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte rows by group and content, and the length of the prefix that each has in common with the one before it."""
    width = matrix.shape[1]
    padded = np.zeros((len(matrix), -(-width // 8) * 8), np.uint8)
    padded[:, :width] = matrix
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort([*(words[:, i] for i in range(words.shape[1] - 1, -1, -1)), group])
    m, g = matrix[order], group[order]
    differ = m[1:] != m[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.r_[-1, np.where(g[1:] == g[:-1], common, -1)]


def sort_bucket(key: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, hulls: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (doc, start, length) that repeat an earlier window, of a block of whole buckets."""
    n_windows, rel, n = size >> 8, size & 255, len(key)
    order = np.lexsort((start + rel, doc))
    key, doc, start, n_windows, rel = (c[order] for c in (key, doc, start, n_windows, rel))
    lengths = np.array([len(hulls[i]) for i in order], np.int64)
    flat = np.frombuffer(b"".join([hulls[i] for i in order]) + bytes(1), np.uint8)
    at = np.cumsum(lengths) - lengths
    group = np.unique(key, return_inverse=True)[1]
    i = np.arange(WIDTH)
    after = np.where(rel[:, None] + i < lengths[:, None], flat[np.minimum((at + rel)[:, None] + i, len(flat) - 1)], 0).astype(np.uint8)
    i = np.arange(REST)
    before = np.where(i < rel[:, None], flat[np.maximum((at + rel - 1)[:, None] - i, 0)], 0).astype(np.uint8)
    (after_order, after_common), (before_order, before_common) = _runs(after, group), _runs(before, group)
    hit = np.zeros((n, REST + 2), bool)
    a, z = np.empty(n, np.int64), np.empty(n, np.int64)
    for left in range(REST + 1):  # bytes of the window that come before the place
        live = np.flatnonzero((rel - n_windows < left) & (left <= rel))
        if len(live) < 2:
            continue
        a[after_order] = np.cumsum(after_common < WIDTH - left)
        z[before_order] = np.cumsum(before_common < left)
        _, first, which = np.unique(z[live] * (n + 1) + a[live], return_index=True, return_inverse=True)
        again = first[which] != np.arange(len(live))
        hit[live[again], REST - left] = True  # columns in the order of window starts
    edge = np.diff(np.c_[np.zeros(n, np.int8), hit.astype(np.int8)], axis=1)
    row, a = np.nonzero(edge == 1)
    _, z = np.nonzero(edge == -1)
    return doc[row], start[row] + rel[row] - REST + a, z - a + WIDTH - 1


def sort_found(found: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc, start, size of what repeats. Places are sorted by blocks of whole buckets; windows of wide buckets, which come after them, are a stream: all but the first of equal ones
    repeat it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        last: tuple | None = None

        def spans(*columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "start", "size"])

        def done(t: pa.Table) -> pa.RecordBatch:
            cols = [t.column(n).to_numpy() for n in ("a", "doc", "start", "size")]
            return spans(*(sort_bucket(*cols, t.column("hull").to_pylist()) if len(t) else (np.empty(0, np.int64),) * 3))

        for batch in batches:
            places = int((batch.column(0).to_numpy() == 1).sum())
            if places:
                t = pa.Table.from_batches([batch.slice(0, places)])
                held = t if held is None else pa.concat_tables([held, t])
                while len(held) > block:
                    key = held.column("a").to_numpy()
                    ends = np.flatnonzero(key[1:] != key[:-1]) + 1
                    if not len(ends):
                        break
                    cut = int(ends[max(0, np.searchsorted(ends, block, "right") - 1)])
                    yield done(held.slice(0, cut))
                    held = held.slice(cut)
            if places < len(batch):
                if held is not None:
                    yield done(held)
                    held = None
                w1, w2, doc, start = (batch.column(i).to_numpy()[places:] for i in (1, 2, 3, 4))
                again = np.r_[last == (w1[0], w2[0]), (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])]
                last = (w1[-1], w2[-1])
                yield spans(*_merged(doc[again], start[again], np.full(int(again.sum()), WIDTH)))
        if held is not None:
            yield done(held)

    return map_arrow(found.repartition("a").sortWithinPartitions("kind", "a", "b", "doc", "start"), run, "doc long, start long, size long")


def ordered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The table and its column of numbers by which documents are in order: doc_id where that is unique; null where there is none."""
    name, own = unused("__doc", docs), F.col("doc_id").cast("long")
    twice = docs.where("doc_id is not null").groupBy(own).count().where("count > 1")
    if twice.isEmpty():
        return docs.withColumn(name, own), name
    number = F.monotonically_increasing_id()  # the last of the keys splits what is equal among tasks
    rows = docs.orderBy(own, F.col("text").cast("string"), number).withColumn(name, F.when(F.col("doc_id").isNotNull(), number))
    return shared_table(rows, "ordered"), name


def repeats(docs: DataFrame, wide: int = WIDE, block: int = BLOCK, doc: str = "doc_id") -> DataFrame:
    """doc and spans array<long> (start * 2^32 + length) of documents that lose bytes. ``doc``: the column that tells them apart and orders them."""
    spark, since = docs.sparkSession, tables_so_far()
    docs = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    settled = shared_table(compact(settle(places(docs), wide), deal=True), "settled")
    free_shuffles(spark)
    spans = settled.where("kind = 0").select("doc", "start", "size")
    wanted = settled.where("kind > 0")
    if not wanted.isEmpty():
        spans = spans.unionByName(shared_table(compact(sort_found(_found(_with_places(docs, wanted)), block), deal=True), "spans"))
        free_shuffles(spark)
    packed = (F.col("start") * (1 << 32) + F.col("size")).alias("span")
    out = shared_table(compact(spans.select("doc", packed).groupBy("doc").agg(F.collect_list("span").alias("spans"))), "repeats")
    free_shuffles(spark)
    drop_since(spark, since, out)
    return out


def lost(size: int, spans: np.ndarray) -> np.ndarray:
    """Which of a text's bytes are covered."""
    edge = np.zeros(size + 1, np.int64)
    start = spans >> 32
    np.add.at(edge, start, 1)
    np.add.at(edge, start + (spans & 0xFFFFFFFF), -1)
    return np.cumsum(edge[:-1]) > 0


def _with_spans(docs: DataFrame, columns: list[str], wide: int, block: int) -> DataFrame:
    """The spans that a document loses, or null, and its columns."""
    docs, doc = ordered(docs)
    spans = unused("__spans", docs)
    found = repeats(docs, wide, block, doc).toDF(doc, spans)
    return sized_like(docs.select(doc, *columns).join(found.hint("merge"), doc, "left").select(spans, *columns), docs)


def _each(b: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray | None]]:
    spans, flat = b.column(0), b.column(0).flatten().to_numpy()
    at = np.cumsum([0, *(len(s) if s.is_valid else 0 for s in spans)])
    for i, text in enumerate(utf8_values(b.column("text"))):
        yield text or b"", flat[at[i] : at[i + 1]] if at[i + 1] > at[i] else None


def suffix_dedup_digests(docs: DataFrame, wide: int = WIDE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in _each(b):
                if spans is None:
                    rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                    continue
                gone = lost(len(text), spans)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((len(text), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(_with_spans(docs, ["doc_id", "text"], wide, block), run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def suffix_dedup(docs: DataFrame, wide: int = WIDE, block: int = BLOCK) -> DataFrame:
    """The documents with their columns, without what repeats; a character stays unless all its bytes go. n_chars, if there, is counted anew where the text changes."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old, texts, sizes = b.column("text"), [], b.column("n_chars").to_pylist() if "n_chars" in names else None
            for i, (text, spans) in enumerate(_each(b)):
                if spans is None:
                    texts.append(old[i].as_py())
                    continue
                gone, x = lost(len(text), spans), np.frombuffer(text, np.uint8)
                char = np.cumsum((x & 0xC0) != 0x80) - 1
                stays = np.bincount(char, ~gone) > 0
                texts.append(x[stays[char]].tobytes().decode())
                if sizes is not None:
                    sizes[i] = len(texts[-1])
            new = {"text": pa.array(texts, old.type)} | ({"n_chars": pa.array(sizes, b.column("n_chars").type)} if sizes is not None else {})
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(n)) for n in names], names=names)

    return map_arrow(_with_spans(docs, names, wide, block), run, docs.schema)
