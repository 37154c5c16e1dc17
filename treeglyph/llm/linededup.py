"""Line dedup with a sharded minimal perfect hash.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. Keys of at least ``min_chars`` code points found in at
least ``min_docs`` documents lose all their lines but those in the largest doc_id that holds them.

1. Documents give the distinct 128-bit hashes of their keys; these are grouped, with partial sums on the map side, to a count and the last holder.
2. The recurring ones are dealt to shards by hash; each shard becomes one row: a minimal perfect hash and, at its places, arrays of
   fingerprints, counts and last holders. The number of shards grows with the number of recurring hashes, so a shard's size is bounded.
3. Documents probe: a hash is sent to its shard's task, where it meets the arrays rather than lines; what is to be dropped goes back to its document.
   Hashes that hold over 1/HOT of all occurrences, of which there can be HOT at most, don't travel: their arrays go along to all tasks.

Lines themselves are never joined. Half of a hash is the place in the arrays and half is the fingerprint, so a false match needs a collision of 128 bits.

A null text is one empty line; a row is a document, so repeated rows count each; where several rows have the largest doc_id all of them keep the
line. Documents without an id are neither counted nor changed. Other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, compact, drop_since, free_shuffles, map_arrow, shared_table, sized_like, tables_so_far, unused, utf8_values
from .perfect import Shard

MIN_CHARS, MIN_DOCS, SHARD_KEYS, HOT = 20, 3, 200_000, 1024


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key, or None where it is too short to count."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars):
        return None
    return key


def line_hashes(text: bytes, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """A 16-byte hash, or None, for each line."""
    from xxhash import xxh3_128_digest

    return [None if (k := line_key(x, min_chars)) is None else xxh3_128_digest(k) for x in text.split(b"\n")]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return x[:, 0], x[:, 1]


def key_holders(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, h1, h2: each document's distinct keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            per = [list({h for h in line_hashes(t or b"", min_chars) if h}) for t in utf8_values(b.column(1))]
            doc = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(x) for x in per])
            h1, h2 = _halves([h for x in per for h in x])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(h1), pa.array(h2)], names=["doc_id", "h1", "h2"])

    return map_arrow(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, h1 long, h2 long")


def recurring_keys(holders: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    return holders.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)


def build_shards(keys: DataFrame, n_shards: int) -> DataFrame:
    """shard and blob: the perfect hash and arrays of each."""

    def build(t: pa.Table) -> pa.Table:
        c = {n: t.column(n).to_numpy() for n in ("h1", "h2", "n", "last")}
        blob = Shard.build(c["h1"], c["h2"], c["n"], c["last"]).to_bytes()
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int64()), "blob": pa.array([blob], pa.binary())})

    return keys.withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("long")).groupBy("shard").applyInArrow(build, "shard long, blob binary")


def probe_shards(holders: DataFrame, shards: DataFrame, n_shards: int) -> DataFrame:
    """doc_id and key (the 16 bytes) of what documents have to drop. A task takes one shard's arrays after the other, before its probes."""
    nul = lambda kind: F.lit(None).cast(kind)
    arrays = shards.select("shard", F.lit(0).alias("probe"), "blob", nul("long").alias("doc_id"), nul("long").alias("h1"), nul("long").alias("h2"))
    probes = holders.select(F.pmod("h1", F.lit(n_shards)).cast("long").alias("shard"), F.lit(1).alias("probe"), nul("binary").alias("blob"), "doc_id", "h1", "h2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now = None, None
        for b in batches:
            at, blobs = b.column(0).to_numpy(), b.column(2)
            doc, h1, h2 = (b.column(i).fill_null(0).to_numpy() for i in (3, 4, 5))
            edges = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(at)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if not z - a:
                    continue
                if blobs[int(a)].is_valid:
                    shard, now, a = at[a], Shard.from_bytes(blobs[int(a)].as_py()), a + 1
                if shard != at[min(a, len(at) - 1)] or a == z:
                    continue  # no recurring keys in this shard
                p1, p2, d = h1[a:z], h2[a:z], doc[a:z]
                n, last = now.find(p1, p2)
                out = (n > 0) & (last != d)
                if out.any():
                    raw = np.c_[p1[out], p2[out]].astype("<i8").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array(d[out]), pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())], names=["doc_id", "key"])

    return map_arrow(arrays.unionByName(probes).repartition("shard").sortWithinPartitions("shard", "probe"), run, "doc_id long, key binary")


def without_hot(holders: DataFrame, hot: list) -> DataFrame:
    if not hot:
        return holders
    rows = holders.sparkSession.createDataFrame([(r["h1"], r["h2"]) for r in hot], "h1 long, h2 long")
    return holders.join(F.broadcast(rows), ["h1", "h2"], "left_anti")


def drops_of(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, Shard]:
    """doc_id and drops (16-byte hashes) of documents that lose lines, and the arrays of the hot keys."""
    spark, since = docs.sparkSession, tables_so_far()
    holders = key_holders(docs, min_chars)
    keys = shared_table(compact(recurring_keys(holders, min_docs), deal=True), "line-keys")
    n, total = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = keys.where(F.col("n") * HOT > total).collect() if total else []  # HOT rows at most: their shares sum to 1
    c = np.array([[r["h1"], r["h2"], r["n"], r["last"]] for r in hot], np.int64).reshape(-1, 4)
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_KEYS))
    shards = shared_table(compact(build_shards(keys, n_shards)), "line-shards")
    free_shuffles(spark)
    found = probe_shards(without_hot(holders, hot), shards, n_shards)
    drops = shared_table(compact(found.groupBy("doc_id").agg(F.collect_set("key").alias("drops"))), "line-drops")
    free_shuffles(spark)
    drop_since(spark, since, drops)
    return drops, Shard.build(*(c[:, i] for i in range(4)))


def thinned(text: bytes, doc: int | None, drops: set[bytes], hot: Shard, min_chars: int) -> tuple[int, bytes, int]:
    """Number of lines, what is left of the text, number of lines dropped."""
    lines = text.split(b"\n")
    if doc is None:
        return len(lines), text, 0
    hashes = line_hashes(text, min_chars)
    if len(hot.count) and any(hashes):
        own = [h for h in hashes if h]
        n, last = hot.find(*_halves(own))
        lost = (n > 0) & (last != doc)
        if lost.any():
            drops = drops | {h for h, x in zip(own, lost.tolist(), strict=True) if x}
    if not drops:
        return len(lines), text, 0
    kept = [x for x, h in zip(lines, hashes, strict=True) if h not in drops]
    return len(lines), b"\n".join(kept), len(lines) - len(kept)


def _thin(docs: DataFrame, columns: list[str], schema: str, emit: Callable, min_chars: int, min_docs: int) -> DataFrame:
    drops, hot = drops_of(docs, min_chars, min_docs)
    key, gone = unused("__key", docs), unused("__drops", docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias(key), *columns)
    joined = keyed.join(drops.toDF(key, gone).hint("merge"), key, "left").select(key, gone, *columns)
    joined = sized_like(joined, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8_values(b.column("text"))
            rows = [thinned(t or b"", k, set(d or ()), hot, min_chars) for t, k, d in zip(texts, b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield emit(b, rows)

    return map_arrow(joined, run, schema)


def line_dedup_digests(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""

    def emit(b: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _thin(docs, ["doc_id", "text"], f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string", emit, min_chars, min_docs)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with their columns; text, and n_chars where there is such a column, as they are after the dropping."""
    names, at = docs.columns, docs.columns.index("text")
    n_chars = names.index("n_chars") if "n_chars" in names else None

    def emit(b: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        cols = [b.column(n) for n in names]
        dropped = pa.array([r[2] > 0 for r in rows], pa.bool_())
        text = pa.array([r[1].decode() if r[2] else None for r in rows], cols[at].type)
        cols[at] = pc.if_else(dropped, text, cols[at])
        if n_chars is not None:
            size = pc.utf8_length(text).cast(cols[n_chars].type)
            cols[n_chars] = pc.if_else(dropped, size, cols[n_chars])
        return pa.RecordBatch.from_arrays(cols, names=names)

    return _thin(docs, names, docs.schema, emit, min_chars, min_docs)


LINE_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), l as (
  select r, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select r, doc_id, unnest(x) as line, generate_subscripts(x, 1) as i from (select r, doc_id, string_split(text, chr(10)) as x from d))
), f as (
  select k, max(doc_id) as last from l where length(k) >= 20 and doc_id is not null group by k having count(distinct r) >= 3
), m as (
  select l.*, f.k is not null and l.doc_id is not null and f.last <> l.doc_id as dropped from l left join f on l.k = f.k
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where dropped)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from m group by r, doc_id
"""
