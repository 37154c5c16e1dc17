"""Packing by shortest pack first over the length histogram.

Documents become pieces of at most ``capacity`` ids. The histogram of piece lengths, which has at most ``capacity`` entries however many documents there are, comes to
the driver; lengths are placed longest first, always into the shortest pack that has room, by whole groups of equal packs, which
updates the counts of packing patterns. Where no pack has room, new ones are opened, each with as many pieces of the
length as fit, so a length that many copies share doesn't open a pack for each. Patterns are joined back by rank: the n-th
piece of a length takes the n-th slot of that length.

Ranks need no shuffle of pieces into one task: each task numbers its pieces by length, and sums of the tasks' counts before it are added.

The table of pieces is written to the shared folder, so numbering stays as it is when executors are lost.

Nulls are as empty texts, which still have the end id; repeated rows are packed each; null doc_ids are kept; other columns are ignored; an empty
table gives no pieces.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, shared_table, sized_like

CAPACITY, END_ID = 2048, 1


#: A word as letters, marks and the rest. One without a rest is split by the tokenizer into its letters and its marks and nothing else, and lower-casing these letters is
#: the same in all libraries.
_SPLIT = "(?s)^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)(?P<marks>[.,!?;:#*$%&|<>]*)(?P<rest>.*)$"


class Pool:
    """Sequences of ids one after the other, and how long each is."""

    def __init__(self, ids: np.ndarray, size: np.ndarray):
        self.ids, self.size, self.start = ids, size, np.cumsum(size) - size

    @classmethod
    def of(cls, sequences: list[bytes]) -> Pool:
        return cls(np.frombuffer(b"".join(sequences), "<u4"), np.fromiter(map(len, sequences), np.int64, len(sequences)) // 4)

    def gather(self, which: np.ndarray) -> np.ndarray:
        """The ids of these sequences."""
        n = self.size[which]
        before = np.cumsum(n) - n
        return self.ids[np.arange(int(n.sum())) + np.repeat(self.start[which] - before, n)]


class WordIds:
    """Ids of texts by a tokenizer that drops white space, lower-cases, and marks the ends of its pieces.

    The distinct words of a batch are put together from the ids of their letters and marks, each of which is kept (little-endian bytes) for when it comes again; new ones are
    encoded many at a time and told apart by their end marks. Other words are encoded by themselves. A text's ids are then gathered from those of the words.
    Special tokens that a text spells out are text like other, or with ``special_ids`` get their own ids, which is the tokenizer library's default.
    """

    def __init__(self, tokenizer_file: str, most: int = 400_000, end_mark: str = "</w>", special_ids: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_file)
        self._tokenizer.encode_special_tokens = not special_ids
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith(end_mark)]] = True
        self._parts: dict[str, bytes] = {"": b""}
        self._most = most

    def encode(self, texts: pa.Array, many: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids start (and the end), and all ids; nulls have none. Words are gathered so many at a time."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ends = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        which, known = coded.indices.to_numpy(), self._words(coded.dictionary)
        total = np.r_[0, np.cumsum(known.size[which])]
        parts = [known.gather(which[a : a + many]) for a in range(0, len(which), many)]
        return total[ends - ends[0]], parts[0] if len(parts) == 1 else np.concatenate([*parts, np.empty(0, "<u4")])

    def _words(self, words: pa.Array) -> Pool:
        """The ids of distinct words."""
        if len(self._parts) > self._most:
            self._parts = {"": b""}
        split = pc.extract_regex(words, _SPLIT)
        letters, marks, rest = (split.field(i) for i in range(3))
        odd = np.flatnonzero((pc.binary_length(rest).to_numpy() > 0) | (pc.binary_length(letters).to_numpy() == 0))
        heads, tails = pc.utf8_lower(letters).dictionary_encode(), marks.dictionary_encode()
        names = [x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (heads, tails)]
        self._learn([x for x in {*names[0], *names[1]} if x not in self._parts])
        other = [np.array(ids, "<u4").tobytes() for ids in self._encode(words.take(pa.array(odd)).to_pylist())]
        parts = Pool.of([*map(self._parts.__getitem__, names[0]), *map(self._parts.__getitem__, names[1]), b"", *other])
        first, second = heads.indices.to_numpy().astype(np.int64), tails.indices.to_numpy() + len(names[0])
        nothing = len(names[0]) + len(names[1])
        first[odd], second[odd] = nothing + 1 + np.arange(len(odd)), nothing
        return Pool(parts.gather(np.stack([first, second], axis=1).ravel()), parts.size[first] + parts.size[second])

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str], many: int = 500) -> None:
        groups = [parts[i : i + many] for i in range(0, len(parts), many)]
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups]), strict=True):
            x = np.array(ids, "<u4")
            ends = (np.flatnonzero(self._ends[x]) + 1) * 4
            if len(ends) != len(group):  # a vocabulary without such marks
                self._parts.update((p, np.array(i, "<u4").tobytes()) for p, i in zip(group, self._encode(group), strict=True))
                continue
            raw, at = x.tobytes(), 0
            for p, end in zip(group, ends.tolist(), strict=True):
                self._parts[p] = raw[at:end]
                at = end

    def forget(self) -> None:
        self._parts = {"": b""}


@functools.cache
def word_ids(tokenizer_file: str, special_ids: bool = False) -> WordIds:
    """One for each Python worker; what it knows goes with each task, as workers live on."""
    return WordIds(tokenizer_file, special_ids=special_ids)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, pid long, nth long"


def cut_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int | None = END_ID, *, with_ids: bool = False, special_ids: bool = False) -> DataFrame:
    """PIECES (and ids binary, if asked for) of every document. nth: the piece's number among the task's pieces of its length."""
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seen, ids_of = TaskContext.get().partitionId(), [0] * (capacity + 1), word_ids(tokenizer_file, special_ids)
        names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
        try:
            for b in batches:
                for at in range(0, len(b), 2048):
                    part = b.slice(at, 2048)
                    ends, ids = ids_of.encode(part.column(1))
                    rows, raw = [], []
                    for doc, a, z in zip(part.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                        whole = ids[a:z].tobytes() + end
                        total = len(whole) // 4
                        for start in range(0, total, capacity):
                            piece = whole[4 * start : 4 * (start + capacity)]
                            n = len(piece) // 4
                            rows.append((doc, start, n, zlib.crc32(piece), total, pid, seen[n]))
                            raw.append(piece)
                            seen[n] += 1
                    cols = list(zip(*rows, strict=True)) or [()] * 7
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), *([pa.array(raw, pa.binary())] * with_ids)], names=names)
        finally:
            ids_of.forget()

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES + ", ids binary" * with_ids)


@dataclass
class Slots:
    """Where the pieces of a length go, by rank: a row is a run of ``times`` equal lengths in the packs of one pattern."""

    length: np.ndarray
    first: np.ndarray  # rank of the first piece that goes there
    times: np.ndarray
    sequence: np.ndarray  # id of the first pack of the pattern
    offset: np.ndarray
    n_sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of pieces."""
        starts = np.searchsorted(self.length, length, "left")
        ends = np.searchsorted(self.length, length, "right")
        lo, hi = starts, ends - 1  # the last row of the length whose first rank isn't over the piece's
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) // 2
            up = self.first[mid] <= rank
            lo, hi = np.where(open_ & up, mid, lo), np.where(open_ & ~up, mid - 1, hi)
        r = rank - self.first[lo]
        return self.sequence[lo] + r // self.times[lo], self.offset[lo] + r % self.times[lo] * length


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> Slots:
    """Histogram: pieces by length. A group of equal packs is (free, pattern, packs); a pattern is a chain of (length, times, pattern before)."""
    heap: list[tuple[int, int, int, tuple | None]] = []  # -free, a number that makes order definite, packs, pattern
    done: list[tuple[int, tuple]] = []
    number = itertools.count()

    def put(free: int, packs: int, pattern: tuple) -> None:
        if packs and free:
            heapq.heappush(heap, (-free, next(number), packs, pattern))
        elif packs:
            done.append((packs, pattern))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        if length > capacity or length < 1 or n < 0:
            raise ValueError(f"no pack takes {n} pieces of length {length}")
        while n and heap and -heap[0][0] >= length:
            free, _, packs, pattern = heapq.heappop(heap)
            take = min(n, packs)
            put(-free, packs - take, pattern)
            again = pattern is not None and pattern[0] == length
            put(-free - length, take, (length, pattern[1] + 1, pattern[2]) if again else (length, 1, pattern))
            n -= take
        if n:
            fit = capacity // length
            put(capacity - fit * length, n // fit, (length, fit, None))
            if n % fit:
                put(capacity - n % fit * length, 1, (length, n % fit, None))
    done += [(packs, pattern) for _, _, packs, pattern in heap]
    rows, sequence = [], 0
    for packs, pattern in done:
        runs, offset = [], 0
        while pattern is not None:
            runs.append(pattern[:2])
            pattern = pattern[2]
        for length, times in reversed(runs):
            rows.append((length, packs * times, times, sequence, offset))
            offset += length * times
        sequence += packs
    rows.sort()
    x = np.array(rows, np.int64).reshape(-1, 5)
    before = np.cumsum(x[:, 1]) - x[:, 1]
    new = np.r_[True, x[1:, 0] != x[:-1, 0]] if len(x) else np.empty(0, bool)
    first = before - np.repeat(before[new], np.diff(np.r_[np.flatnonzero(new), len(x)])) if len(x) else before
    return Slots(x[:, 0], first, x[:, 2], x[:, 3], x[:, 4], sequence)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int | None = END_ID, *, special_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = shared_table(cut_pieces(docs, tokenizer_file, capacity, end_id, special_ids=special_ids), "pieces")
    cells = pieces.groupBy("length", "pid").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    slots = shortest_pack_first(histogram, capacity)
    earlier = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    ranked = pieces.join(cells.select("length", "pid", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), ["length", "pid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = slots.place(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return map_arrow(sized_like(ranked, pieces).select(*names, (F.col("before") + F.col("nth")).alias("rank")), run, ", ".join(f"{n} long" for n in (*names, "sequence_id", "offset")))
