"""MinHash near-dedup: fast similarity sketches, banding, exact verification, components.

Sketch: in round i < T every shingle is thrown into one of T bins by that round's hash, and each bin keeps the least value of the first round that
reached it; in rounds T to 2T - 1 all shingles are thrown into the round's own bin. So every coordinate is filled after 2T rounds,
most sets fill all of them in about T log T / size rounds, and the share of equal coordinates concentrates around the Jaccard similarity as that of T
independent hashes does.

Banding: BANDS bands of ROWS coordinates; a pair of similarity s shares no bucket with probability (1 - s^ROWS)^BANDS: below 5e-7 at 0.8.

Documents with equal sets are one class from the start, represented by the smallest doc_id. In each bucket, pairs are verified on full sets, but only
as long as they can change the result: first every member against one member of its bucket, in a few rounds with other centres and only where
members are still in different components, then the members outside their bucket's largest component: against its members where it is large, and against each
other where there are many, in blocks that are held as inverted indexes; else pair by pair. From the second round on pairs that share no rare shingle are ruled out by the number of other shingles. Every pair that shares a bucket
is thus verified, already connected, or proven to have no link; nothing is capped.

A null text, or one without words, has an empty set and is linked with nothing. Rows with the same doc_id are one node, with the links of all of them and
one component. Rows
without a doc_id have no class: component_id is null and they are kept. Other columns are ignored by the digest query and returned by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import compact, drop_since, free_shuffles, map_arrow, shared_table, sized_like, tables_so_far, unused, utf8_values
from .components import components

ROWS, BANDS, ROUNDS, RARE, LARGE, FEW = 6, 48, 2, 16, 64, 16
#: A block holds so many sets or so, or so many shingles of them, whichever comes first.
BLOCK, BLOCK_ITEMS = 256, 1 << 19
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int = 2) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles; fewer words are one shingle; no words, none."""
    from xxhash import xxh3_64_intdigest

    split = text.lower().split()
    if not split:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, split), np.uint64, len(split))
    size = min(words, len(w))
    n, h = len(w) - size + 1, np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = mix(h * _A + w[i : i + n])
    return np.unique(h)


class Sketcher:
    def __init__(self, rows: int = ROWS, bands: int = BANDS):
        self.rows, self.bands, self.t = rows, bands, rows * bands
        self.seeds = mix(np.arange(1, 2 * self.t + 1, dtype=np.uint64) * _A)
        self.band_seeds = mix(np.arange(1, bands + 1, dtype=np.uint64) * _C)

    def sketch(self, items: np.ndarray) -> np.ndarray:
        """T coordinates of a set that isn't empty: number of the round (16 bits) and hash (48 bits)."""
        t, n = self.t, len(items)
        out, at = np.full(t, _NONE), 0
        while at < t:
            upto = min(t, at + max(1, 3 * t // n))
            h = mix(items[None, :] ^ self.seeds[at:upto, None])
            value = (np.arange(at, upto, dtype=np.uint64) << np.uint64(48))[:, None] | (h >> np.uint64(16))
            np.minimum.at(out, (h % np.uint64(t)).astype(np.int64).ravel(), value.ravel())
            at = upto
            empty = np.flatnonzero(out == _NONE)
            if not len(empty):
                return out
        h = mix(items[None, :] ^ self.seeds[t + empty, None])
        out[empty] = ((t + empty).astype(np.uint64) << np.uint64(48)) | (h.min(axis=1) >> np.uint64(16))
        return out

    def buckets(self, sketch: np.ndarray) -> np.ndarray:
        """A 64-bit bucket for each band."""
        x, k = sketch.reshape(self.bands, self.rows), self.band_seeds.copy()
        for j in range(self.rows):
            k = mix(k * _A + x[:, j])
        return k


def _set_hash(items: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(items.tobytes())


def set_rows(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles and the 128-bit hash s1, s2 of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t or b"", words) for t in utf8_values(b.column(1))]
            s = np.frombuffer(b"".join(map(_set_hash, sets)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(s[:, 0]), pa.array(s[:, 1])], names=["doc_id", "n_shingles", "s1", "s2"])

    return map_arrow(docs, run, "doc_id long, n_shingles long, s1 long, s2 long")


def bucket_rows(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """bucket, s1, s2, n: where each set falls; once per batch and set, so that copies are few before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(rows, bands)
        for b in batches:
            seen: dict[bytes, np.ndarray] = {}
            sizes: list[int] = []
            for t in utf8_values(b.column(1)):
                if len(items := shingles(t or b"", words)) and (key := _set_hash(items)) not in seen:
                    seen[key] = sketcher.buckets(sketcher.sketch(items))
                    sizes.append(len(items))
            s = np.repeat(np.frombuffer(b"".join(seen), "<i8").reshape(-1, 2), bands, axis=0)
            bucket = np.concatenate(list(seen.values())).view(np.int64) if seen else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(np.repeat(np.array(sizes, np.int64), bands))], names=["bucket", "s1", "s2", "n"])

    return map_arrow(docs, run, "bucket long, s1 long, s2 long, n long")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t or b"", words).tobytes() for t in utf8_values(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "items"])

    return map_arrow(docs, run, "id long, items binary")


def _n_blocks(n: str = "n") -> Column:
    """Of a group of sets, with ``n`` shingles each: how many blocks they take."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(n) / BLOCK_ITEMS))


def _blocks(members: DataFrame) -> DataFrame:
    """id and block: members of one large bucket are in one block, or in several."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("k"), _n_blocks().alias("blocks"))
    home = members.join(sizes, "bucket").groupBy("id").agg(F.max(F.struct("k", "bucket", "blocks")).alias("h"))
    part = F.pmod(F.xxhash64("id"), F.col("h.blocks"))
    return home.select("id", F.xxhash64("h.bucket", part).alias("block"))


def _linked(pairs: DataFrame, sets: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= percent * union, on full sets. Pairs meet by blocks: a set is sent once to each pair
    of blocks in which it has pairs, not once for each pair."""
    of = lambda side: blocks.select(F.col("id").alias(side), F.col("block").alias(f"{side}_block"))
    placed = pairs.join(of("a"), "a").join(of("b"), "b")
    placed = placed.select("a", "b", F.xxhash64(F.least("a_block", "b_block"), F.greatest("a_block", "b_block")).alias("key"))
    needed = placed.select("key", F.col("a").alias("id")).unionByName(placed.select("key", F.col("b").alias("id"))).distinct()
    nothing = F.lit(None).cast("binary").alias("items")
    rows = needed.join(sets.hint("merge"), "id").select("key", F.lit(0).alias("side"), F.col("id").alias("a"), F.col("id").alias("b"), "items")
    rows = rows.unionByName(placed.select("key", F.lit(1).alias("side"), "a", "b", nothing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            found = []
            for key, side, a, b, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    now, held = key, {}
                if side == 0:
                    held[a] = np.frombuffer(items, np.uint64)
                    continue
                both = np.concatenate([held[a], held[b]])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return map_arrow(rows.repartition("key").sortWithinPartitions("key", "side"), run, "a long, b long")


def _rare(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Shingles that at most RARE of the members have are rare. A pair can't share more than the rare ones that it does share and the lesser number of others, m. Pairs
    that share rare ones are few: those for which that is enough for a link are given, (a, b). For the others m alone rules out heavily edited
    copies without reading their sets, and members whose m is too small for any link go."""
    ids = members.select("id", "n", "comp").distinct()
    each = map_arrow(sets.join(ids.select("id"), "id", "left_semi"), _unpack, "id long, item long")
    rare = each.groupBy("item").agg(F.count("*").alias("k")).where(F.col("k") <= RARE)
    held = shared_table(compact(each.join(rare, "item").select("id", "item", "k"), deal=True), "rare")
    own = held.groupBy("id").agg(F.count("*").alias("own"))
    rest = ids.join(own, "id", "left").withColumn("m", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    both = held.where("k > 1").select("id", "item").join(rest, "id")
    other = both.select("item", *(F.col(c).alias(f"c_{c}") for c in ("id", "n", "comp", "m")))
    pairs = both.join(other, "item").where((F.col("id") < F.col("c_id")) & (F.col("comp") != F.col("c_comp")))
    pairs = pairs.groupBy(F.col("id").alias("a"), F.col("c_id").alias("b"), "n", "c_n", "m", "c_m").agg(F.count("*").alias("k"))
    common = F.least(F.col("m") + F.col("k"), F.col("c_m") + F.col("k"))
    out = members.drop("m").join(rest.select("id", "m"), "id").select("bucket", "id", "n", "comp", "m")
    return out.where(100 * F.col("m") >= percent * F.col("n")), pairs.where(100 * common >= percent * (F.col("n") + F.col("c_n") - common)).select("a", "b")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        items = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
        ids = np.repeat(b.column(0).to_numpy(), [len(x) for x in items])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(items) if items else ids, pa.int64())], names=["id", "item"])


def _against(probes: DataFrame, targets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of probes (id, comp: another component) with members (id, n, comp) of that component, at least one for each probe that has any. Members are
    dealt to blocks, and each probe goes to all blocks of its component; a block is held as one inverted index."""
    size = targets.groupBy("comp").agg(_n_blocks().alias("blocks"))
    of = sets.select("id", "items")
    y = targets.join(size, "comp").select("comp", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.lit(0).alias("side"), "id").join(of, "id")
    x = probes.join(of, "id").join(size, "comp").select("id", "comp", "items", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    both = y.unionByName(x.withColumn("side", F.lit(1))).select("comp", "block", "side", "id", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for b in batches:
            a_out, b_out = [], []
            for comp, block, side, id_, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (comp, block) != now:
                    now, held, index = (comp, block), [], None
                s = np.frombuffer(items, np.uint64)
                if side == 0:
                    held.append((id_, s))
                    continue
                if not held:
                    continue
                if index is None:
                    owner = np.repeat(np.arange(len(held)), [len(x) for _, x in held])
                    flat = np.concatenate([x for _, x in held])
                    order = np.argsort(flat, kind="stable")
                    index = flat[order], owner[order], np.array([len(x) for _, x in held])
                flat, owner, sizes = index
                lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                n = hi - lo
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                common = np.bincount(owner[at], minlength=len(held))
                linked = np.flatnonzero(100 * common >= percent * (sizes + len(s) - common))
                if len(linked):
                    other = held[linked[0]][0]
                    a_out.append(min(id_, other))
                    b_out.append(max(id_, other))
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return map_arrow(both.repartition("comp", "block").sortWithinPartitions("comp", "block", "side"), run, "a long, b long")


def _within(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members (bucket, id, n, comp) of the same bucket that are in different components: for each member one, at least, to each component that it
    has any to. A bucket is dealt to blocks; a member is held in its own block and probes that and those after it."""
    size = members.groupBy("bucket").agg(_n_blocks().alias("blocks"))
    dealt = members.join(size, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).join(sets.select("id", "items").hint("merge"), "id")
    names = ("bucket", "block", "side", "id", "comp", "items")
    held = dealt.withColumn("side", F.lit(0)).select(*names)
    later = dealt.where(F.col("block") + 1 < F.col("blocks")).withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)))
    both = held.unionByName(later.withColumn("side", F.lit(1)).select(*names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, index = None, [], None
        found: list[tuple[int, int]] = []

        def probe(id_: int, comp: int, s: np.ndarray, after: int) -> None:
            flat, owner, sizes, comps = index
            lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            n = hi - lo
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            common = np.bincount(owner[at], minlength=len(sizes))
            linked = np.flatnonzero((100 * common >= percent * (sizes + len(s) - common)) & (comps != comp))
            linked = linked[linked > after]
            for k in linked[np.unique(comps[linked], return_index=True)[1]].tolist():
                found.append((min(id_, own[k][0]), max(id_, own[k][0])))

        def close() -> None:
            """The block is complete: index it, and let its members probe each other."""
            nonlocal index
            if index is not None or not own:
                return
            sizes = np.array([len(x) for _, _, x in own])
            flat = np.concatenate([x for _, _, x in own])
            order = np.argsort(flat, kind="stable")
            index = flat[order], np.repeat(np.arange(len(own)), sizes)[order], sizes, np.array([c for _, c, _ in own])
            for k, (id_, comp, s) in enumerate(own):
                probe(id_, comp, s, k)

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
            found.clear()
            return b

        for batch in batches:
            for bucket, block, side, id_, comp, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, block) != now:
                    close()
                    now, own, index = (bucket, block), [], None
                s = np.frombuffer(items, np.uint64)
                if side == 0:
                    own.append((id_, comp, s))
                elif own:
                    close()
                    probe(id_, comp, s, -1)
            yield out()
        close()
        yield out()

    return map_arrow(both.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "side"), run, "a long, b long")


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (id, comp) with the components that new links put together."""
    if labels is None:
        return shared_table(compact(components(links)), "labels")
    of = lambda side: labels.select(F.col("id").alias(side), F.col("comp").alias(f"c{side}"))
    upper = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    new = components(upper)
    up = new.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
    old = labels.join(up, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp"))
    return shared_table(compact(old.unionByName(new.join(labels.select("id"), "id", "left_anti"))), "labels")


def _open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with their components so far, of buckets that hold more than one."""
    if labels is not None:
        members = members.drop("comp").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id")).select("bucket", "id", "n", "m", "comp")
    open_ = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    return shared_table(compact(members.join(open_, "bucket", "left_semi")), "members")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, rounds: int = ROUNDS, large: int = LARGE, few: int = FEW) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    spark, since = docs.sparkSession, tables_so_far()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.where("doc_id is not null")
    held = shared_table(set_rows(docs, words), "sets")
    first = shared_table(compact(held.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"))), "set-first")
    # members of buckets with two different sets or more
    each = bucket_rows(named, words, rows, bands).repartition("bucket").dropDuplicates(["bucket", "s1", "s2"])
    shared = each.withColumn("k", F.count("*").over(Window.partitionBy("bucket"))).where("k > 1")
    members = shared_table(compact(shared.join(first, ["s1", "s2"]).select("bucket", "id", "n", F.col("n").alias("m"), F.col("id").alias("comp"))), "members")
    free_shuffles(spark)
    own = named.join(members.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").select("doc_id", "text")
    sets = shared_table(compact(_sets(own, words)), "shingles")
    free_shuffles(spark)

    blocks = shared_table(compact(_blocks(members)), "blocks")
    common = F.least("m", "c_m")
    possible = (F.col("comp") != F.col("c_comp")) & (100 * common >= percent * (F.col("n") + F.col("c_n") - common))
    as_other = lambda df: df.select("bucket", *(F.col(x).alias(f"c_{x}") for x in ("id", "comp", "n", "m")))
    pair = (F.least("id", "c_id").alias("a"), F.greatest("id", "c_id").alias("b"))
    labels, tested, sharing, now = None, None, None, members
    for k in range(rounds):
        order = F.struct((F.col("id") if k == 0 else F.xxhash64("id", F.lit(k))).alias("o"), "id", "comp", "n", "m")
        centre = now.groupBy("bucket").agg(F.min(order).alias("c")).select("bucket", *(F.col(f"c.{x}").alias(f"c_{x}") for x in ("id", "comp", "n", "m")))
        # of a member's centres in a component, the one that it shares most buckets with
        per = now.join(centre, "bucket").where(possible).withColumn("g", F.col("c_comp") if k else F.lit(0)).groupBy("id", "g", "c_id").agg(F.count("*").alias("k"))
        per = per.groupBy("id", "g").agg(F.max_by("c_id", F.struct("k", -F.col("c_id"))).alias("c_id"))
        pairs = per.select(*pair).distinct()
        if sharing is not None:
            pairs, sharing = pairs.unionByName(sharing).distinct(), None
        pairs = shared_table(compact(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")), "pairs")
        found = shared_table(compact(_linked(pairs, sets, blocks, percent), deal=True), "links")
        free_shuffles(spark)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if not found.isEmpty():
            labels = _relabelled(labels, found)
        now = _open(now, labels)
        if now.isEmpty():
            break
        if k == 0:
            sets = shared_table(compact(sets.join(now.select("id").distinct().hint("merge"), "id", "left_semi")), "shingles")
            now, sharing = _rare(now, sets, percent)
            now = shared_table(compact(now), "members")
        free_shuffles(spark)
    else:
        # of two members in different components, one at least isn't in its bucket's largest
        sizes = labels.groupBy("comp").agg(F.count("*").alias("size")) if labels is not None else now.select("comp", F.lit(1).alias("size")).limit(0)
        largest = now.select("bucket", "comp").distinct().join(sizes, "comp", "left").groupBy("bucket").agg(F.max(F.struct(F.coalesce("size", F.lit(1)).alias("size"), "comp")).alias("t"))
        now = shared_table(compact(now.join(largest.select("bucket", F.col("t.comp").alias("top"), F.col("t.size").alias("size")), "bucket")), "members")
        small = now.where((F.col("comp") != F.col("top")) | (F.col("size") < large)).select("bucket", "id", "n", "m", "comp")
        full = small.groupBy("bucket").agg(F.count("*").alias("k")).where(F.col("k") > few).select("bucket")
        links = _within(small.join(full, "bucket", "left_semi").select("bucket", "id", "n", "comp"), sets, percent)
        small = small.join(full, "bucket", "left_anti")
        pairs = small.join(as_other(small), "bucket").where(possible & (F.col("id") < F.col("c_id"))).select(*pair).distinct()
        if sharing is not None:
            pairs = pairs.unionByName(sharing).distinct()
        found = _linked(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), sets, blocks, percent)
        probes = now.where((F.col("comp") != F.col("top")) & (F.col("size") >= large)).select("id", F.col("top").alias("comp")).distinct()
        targets = now.select("id", "n", "comp").distinct().join(probes.select("comp").distinct(), "comp", "left_semi")
        found = shared_table(compact(found.unionByName(links).unionByName(_against(probes, targets, sets, percent)), deal=True), "links")
        if not found.isEmpty():
            labels = _relabelled(labels, found)
    # rows of one doc_id are one node: the representatives of its sets are linked through it
    twice = held.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    own = held.join(twice, "doc_id", "left_semi").join(first, ["s1", "s2"]).where("n_shingles > 0 and doc_id <> id")
    own = shared_table(compact(own.select(F.col("id").alias("a"), F.col("doc_id").alias("b")).distinct()), "links")
    if not own.isEmpty():
        labels = _relabelled(labels, own)
    drop_since(spark, since, held, first, *([labels] if labels is not None else []))
    out = held.join(first, ["s1", "s2"], "left").withColumn("id", F.when(F.col("n_shingles") > 0, F.col("id")).otherwise(F.col("doc_id")))
    out = out.join(labels, "id", "left") if labels is not None else out.withColumn("comp", F.lit(None).cast("long"))
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "id"))
    return sized_like(out, held).select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, **parameters: int) -> DataFrame:
    """The documents, with their columns, that are the first of their class."""
    key = unused("__key", docs)
    verdict = near_duplicates(docs, **parameters).where("kept and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()
    lost = F.col("doc_id").isNull()
    kept = docs.where(~lost).withColumn(key, F.col("doc_id").cast("long")).join(verdict.hint("merge"), key, "left_semi").select(*docs.columns)
    return sized_like(kept, docs).unionByName(docs.where(lost))
