"""Arrow kernels: what array functions can't do in linear time. Each works on whole record batches with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codes import INF

INTS = T.ArrayType(T.IntegerType())


def _flat(x: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """A column of arrays as one: where each array starts (and the end), and all values; nulls are as empty ones."""
    rows = [np.empty(0) if row is None else np.asarray(row, np.float64) for row in x]
    return np.cumsum([0, *map(len, rows)]), np.concatenate([*rows, np.empty(0)])


def _rows(x: pd.Series, offsets: np.ndarray, values: np.ndarray) -> pd.Series:
    """The values as arrays again; null where x is."""
    return pd.Series([None if row is None else part for row, part in zip(x, np.split(values, offsets[1:-1]), strict=True)], dtype=object) if len(x) else pd.Series([], dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def quantize_9g(x: pd.Series) -> pd.Series:
    """Every value to nine significant digits, rounded as C's %.9g does (Java's half-up differs)."""
    offsets, values = _flat(x)
    return _rows(x, offsets, np.array(list(map("%.9g".__mod__, values.tolist())), np.float64))


def series_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def distances_of(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Parent distances of all series of a batch. What lies between an element and the one that it points to is larger, so one that points to a larger element can take
    over where that points to: all do so at once, until none has to. A falling run of n elements takes log n rounds."""
    at = np.arange(len(values))
    first = offsets[:-1][series_of(offsets)]
    to = np.where(at > first, at - 1, -1)
    todo = np.flatnonzero(to >= 0)
    while len(todo := todo[values[to[todo]] > values[todo]]):
        to[todo] = to[to[todo]]
        todo = todo[to[todo] >= 0]
    return np.where(to >= 0, at - to, INF).astype(np.int64)


def distinct_of(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each place of a batch of series how many values from there on are distinct."""
    series, at = series_of(offsets), np.arange(len(values))
    again = offsets[1:][series].copy()  # the next equal value, or the series' end
    order = np.lexsort((at, values, series))
    same = (series[order[1:]] == series[order[:-1]]) & (values[order[1:]] == values[order[:-1]])
    again[order[:-1][same]] = order[1:][same]
    return np.minimum.accumulate(again[::-1])[::-1] - at


@F.pandas_udf(T.StringType())
def values_sha256(x: pd.Series) -> pd.Series:
    """SHA-256 of the values as little-endian doubles, without -0.0."""
    return x.map(lambda row: None if row is None else hashlib.sha256((np.asarray(row, "<f8") + 0.0).tobytes()).hexdigest())


@F.pandas_udf(INTS)
def parent_distance_linear(x: pd.Series) -> pd.Series:
    """As codes.parent_distance, for all series of a batch at once."""
    offsets, values = _flat(x)
    return _rows(x, offsets, distances_of(offsets, values + 0.0).astype(np.int32))


@F.pandas_udf(T.StructType([T.StructField("root", T.IntegerType()), T.StructField("parents", INTS), T.StructField("depth", INTS)]))
def tree_of(codes: pd.Series) -> pd.DataFrame:
    """The min-Cartesian tree of a code: root, parent of each element (-1 for the root) and depth; all null if the code isn't valid."""
    rows = [decode_tree([int(c) for c in code]) if code is not None and len(code) else None for code in codes]
    return pd.DataFrame([r or (None, None, None) for r in rows], columns=["root", "parents", "depth"])


def decode_tree(code: list[int]) -> tuple[int, list[int], list[int]] | None:
    """An element's subtree lies between the nearest one before it that isn't larger (given by the code) and the nearest one after it that is smaller: the first that
    points beyond it. Of the two the larger is the parent: the later one if it points to the earlier one, else the earlier. An element is as deep as there are
    other subtrees that it lies in. Pointers that cross make no tree."""
    n, d = len(code), np.asarray(code, np.int64)
    at = np.arange(n)
    if not n or (d < 0).any() or (d > at).any():
        return None
    before, after = np.where(d > 0, at - d, -1), np.full(n, n)
    for i in range(n - 1, -1, -1):
        passed = slice(before[i] + 1, i)
        if (before[passed] < before[i]).any():
            return None
        after[passed] = i
    parents = np.where(np.append(before, -2)[after] == before, after, before)
    inside = np.bincount(before + 1, minlength=n + 1) - np.bincount(after, minlength=n + 1)
    return int(np.flatnonzero(parents < 0)[0]), parents.tolist(), (np.cumsum(inside)[:n] - 1).tolist()


@dataclass(frozen=True)
class CountSpec:
    """What to count. ties: "strict" (windows of distinct values only) or "native"; mass: decay as for windows of one value."""

    lengths: tuple[int, ...]
    ties: str = "strict"
    bins: int = 1
    decay: float = 0.0
    mass: bool = False


#: Values that are worked on at a time: what a task holds follows from this and not from what Spark hands over.
SLICE = 1 << 20


class Windows:
    """The windows of a batch of series, that grow by one value at a time. A window's code at length m is its code at m - 1 and one more distance.

    offsets: where each series' values start, and the end. shift, n, own: position of its first value in the whole series, that series' length,
    and how many starts belong here. start: the windows that still grow."""

    def __init__(self, ties: str, offsets: np.ndarray, values: np.ndarray, shift: np.ndarray, n: np.ndarray, own: np.ndarray):
        v = values + 0.0  # no -0.0
        if not np.isfinite(v).all():
            raise ValueError("a series has values that aren't finite")
        self.series, self.shift, self.n = series_of(offsets), shift, n
        self.pos = np.arange(len(v)) - offsets[:-1][self.series]
        self.dist = distances_of(offsets, v)
        left = np.diff(offsets)[self.series] - self.pos
        self.room = distinct_of(offsets, v) if ties == "strict" else left
        self.whole = np.diff(offsets) == n
        self._left = left
        self.start = np.flatnonzero(self.pos < own[self.series])

    def grow(self, m: int, *aligned: np.ndarray) -> tuple[np.ndarray, ...]:
        """Leave out windows that can't have length m; the distances that length adds to the others, and what is ``aligned`` with them."""
        s = self.series[self.start]
        if (((self._left[self.start] < m) & (self.pos[self.start] + self.shift[s] + m <= self.n[s])) & (self.room[self.start] >= np.minimum(m, self._left[self.start]))).any():
            raise ValueError(f"windows of length {m} pass the end of a segment that was made for shorter ones")
        live = self.room[self.start] >= m
        self.start = self.start[live]
        step = self.dist[self.start + m - 1]
        return np.where(step < m, step, 0), *(x[live] for x in aligned)

    def keep(self, mask: np.ndarray) -> None:
        self.start = self.start[mask]

    def texts(self, start: np.ndarray, m: int) -> list[str]:
        """The codes of windows."""
        out: list[str] = []
        for a in range(0, len(start), max(1, SLICE // m)):
            step = self.dist[start[a : a + max(1, SLICE // m), None] + np.arange(m)]
            out += [",".join(map(str, c)) for c in np.where(step <= np.arange(m), step, 0).tolist()]
        return out


def count_batch(spec: CountSpec, offsets: np.ndarray, values: np.ndarray, shift: np.ndarray, n: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Counts of all windows of a batch of series, level by level: a level numbers pairs (number at m - 1, distance) and costs the number of windows, not times m.
    Arguments as those of Windows. Yields (length, series index, bin, count or weight, code number, texts of the codes)."""
    w = Windows(spec.ties, offsets, values, shift, n, own)
    number, first = np.zeros(len(w.start), np.int64), w.start
    for m in range(2, min(max(spec.lengths), int(np.diff(offsets).max(initial=0))) + 1):
        step, number = w.grow(m, number)
        if not len(w.start):
            return
        _, first, number = np.unique(number * m + step, return_index=True, return_inverse=True)
        if m not in spec.lengths:
            continue
        s = w.series[w.start]
        place = w.pos[w.start] + shift[s]
        which = np.minimum(spec.bins - 1, place * spec.bins // (n[s] - m + 1))
        key, index, inverse = np.unique((s * len(first) + number) * spec.bins + which, return_index=True, return_inverse=True)
        weight = np.exp(-spec.decay * (n[s] - place - (1 if spec.mass else m)) / n[s]) if spec.decay else None
        yield m, s[index], which[index], np.bincount(inverse, weight, len(key)), number[index], w.texts(w.start[first], m)


_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _hashed(h: np.ndarray, step: np.ndarray, seed: np.uint64) -> np.ndarray:
    """The hash of a code with one more distance."""
    x = h * seed + step.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _by_length(texts: Iterable[str]) -> dict[int, tuple[list[str], np.ndarray]]:
    by: dict[int, list[str]] = {}
    for t in texts:
        by.setdefault(t.count(",") + 1, []).append(t)
    return {m: (group, np.array([t.split(",") for t in group], np.int64)) for m, group in by.items()}


def code_ids(texts: Iterable[str]) -> list[tuple[str, int, int, int]]:
    """Code, length and its two hashes."""
    out = []
    for m, (group, steps) in _by_length(texts).items():
        a = b = np.zeros(len(group), np.uint64)
        for i in range(1, m):
            a, b = _hashed(a, steps[:, i], _SEEDS[0]), _hashed(b, steps[:, i], _SEEDS[1])
        out += zip(group, [m] * len(group), a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True)
    return out


def prefix_hashes(texts: Iterable[str]) -> dict[int, np.ndarray]:
    """By length, the sorted first hashes of codes and of all that begins them."""
    out: dict[int, list[np.ndarray]] = {}
    for length, (group, steps) in _by_length(texts).items():
        h = np.zeros(len(group), np.uint64)
        for m in range(2, length + 1):
            h = _hashed(h, steps[:, m - 1], _SEEDS[0])
            out.setdefault(m, []).append(h)
    return {m: np.unique(np.concatenate(hs)) for m, hs in out.items()}


@dataclass(frozen=True)
class GrowSpec:
    """Which windows grow. ``among``: by length, sorted first hashes of the codes that windows may have there. ``minsup``: windows go on only where their series has so many of
    their code, as far as the series is here as a whole; 0: no such test. ``texts``: give the codes too."""

    lengths: tuple[int, ...]
    ties: str = "strict"
    among: tuple[tuple[int, np.ndarray], ...] = ()
    minsup: float = 0.0
    texts: bool = False


def grow_batch(spec: GrowSpec, *batch: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str | None]]]:
    """Counts of the windows that go on growing; arguments as those of Windows. Yields (length, series index, whether that series is whole, two hashes of the code, count, first start,
    text of the code where it is the first of its kind here). Other codes than those in ``among`` may slip in by an equal first hash; the pair of hashes tells them apart."""
    w, among = Windows(spec.ties, *batch), dict(spec.among)
    a = b = np.zeros(len(w.start), np.uint64)
    for m in range(2, max(spec.lengths) + 1):
        step, a, b = w.grow(m, a, b)
        if not len(w.start):
            return
        a, b = _hashed(a, step, _SEEDS[0]), _hashed(b, step, _SEEDS[1])
        if m in among:
            known = among[m]
            mask = known[np.minimum(np.searchsorted(known, a), len(known) - 1)] == a if len(known) else np.zeros(len(a), bool)
            w.keep(mask)
            a, b = a[mask], b[mask]
        if m not in spec.lengths or not len(a):
            continue
        s = w.series[w.start]
        order = np.lexsort((b, a, s))
        new = np.flatnonzero(np.r_[True, (s[order[1:]] != s[order[:-1]]) | (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])])
        cnt = np.diff(np.r_[new, len(order)])
        first = order[new]  # a window of each series and code
        good = (cnt >= spec.minsup) | ~w.whole[s[first]]
        index = first[good]
        texts: list[str | None] = [None] * len(index)
        if spec.texts:
            _, one = np.unique(a[index], return_index=True)
            for i, t in zip(one.tolist(), w.texts(w.start[index[one]], m), strict=True):
                texts[i] = t
        yield m, s[index], w.whole[s[index]], a[index], b[index], cnt[good], w.pos[w.start[index]] + w.shift[s[index]], texts
        if spec.minsup and not good.all():
            mask = np.zeros(len(order), bool)
            mask[order] = np.repeat(good, cnt)
            w.keep(mask)
            a, b = a[mask], b[mask]


def _list_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([0 if x is None else x for x in col.value_lengths().to_pylist()], np.int64)
    return np.r_[0, np.cumsum(lens)], col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, tuple[np.ndarray, ...]]]:
    """Series ids, and arguments of Windows, of at most SLICE values, or of one row."""
    for b in batches:
        lens = np.array([x or 0 for x in b.column(1).value_lengths().to_pylist()], np.int64)
        group = np.cumsum(lens) // SLICE
        edges = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(lens)]
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = b.slice(lo, hi - lo)
            yield part.column(0), (*_list_parts(part.column(1)), *(part.column(i).to_numpy() for i in (2, 3, 4)))


def window_counts(series: DataFrame, spec: CountSpec) -> DataFrame:
    """series_id, length, code, bin, cnt double: no shuffle; a row of ``series`` is a series or a segment of one (see sources.series)."""
    kind = series.schema["series_id"].dataType.simpleString()
    names = ["series_id", "length", "code", "bin", "cnt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, batch in _slices(batches):
            for m, s, which, cnt, number, texts in count_batch(spec, *batch):
                code = pa.DictionaryArray.from_arrays(pa.array(number, pa.int32()), pa.array(texts, pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(s)), pa.array(np.full(len(s), m, np.int32)), code, pa.array(which.astype(np.int32)), pa.array(cnt.astype(np.float64))], names=names)

    return series.select("series_id", "x", "shift", "n", "own").mapInArrow(run, f"series_id {kind}, length int, code string, bin int, cnt double")


def grown_counts(series: DataFrame, spec: GrowSpec) -> DataFrame:
    """series_id, length, h1, h2, cnt double, whole (cnt is that of the whole series), st (the first start) and code (null but for one row of a code and slice): no shuffle."""
    kind = series.schema["series_id"].dataType.simpleString()
    names = ["series_id", "length", "h1", "h2", "cnt", "whole", "st", "code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, batch in _slices(batches):
            for m, s, whole, a, b, cnt, st, texts in grow_batch(spec, *batch):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(s)), pa.array(np.full(len(s), m, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(cnt.astype(np.float64)), pa.array(whole), pa.array(st, pa.int64()), pa.array(texts, pa.string())], names=names)

    return series.select("series_id", "x", "shift", "n", "own").mapInArrow(run, f"series_id {kind}, length int, h1 long, h2 long, cnt double, whole boolean, st long, code string")


def gap_batch(length: int, ties: str, *batch: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each series and code of one length: series index, code, number of windows, first and last start, and the sum of squares of the distances between one start and the next."""
    w = Windows(ties, *batch)
    number = np.zeros(len(w.start), np.int64)
    for m in range(2, length + 1):
        step, number = w.grow(m, number)
        _, first, number = np.unique(number * m + step, return_index=True, return_inverse=True)
    s, at = w.series[w.start], w.pos[w.start] + w.shift[w.series[w.start]]
    order = np.lexsort((at, number, s))
    new = np.flatnonzero(np.r_[True, (s[order[1:]] != s[order[:-1]]) | (number[order[1:]] != number[order[:-1]])][: len(order)])
    ends = np.r_[new[1:], len(order)] - 1 if len(new) else new
    gap = np.diff(at[order], prepend=0)
    gap[new] = 0
    texts = w.texts(w.start[first], length) if len(order) else []
    squares = np.add.reduceat(gap * gap, new) if len(new) else gap
    return s[order[new]], [texts[i] for i in number[order[new]].tolist()], ends - new + 1, at[order[new]], at[order[ends]], squares


def gap_parts(series: DataFrame, length: int, ties: str = "strict") -> DataFrame:
    """series_id, code, n, first, last, squares of each series or segment: no shuffle."""
    kind = series.schema["series_id"].dataType.simpleString()
    names = ["series_id", "code", "n", "first", "last", "squares"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, batch in _slices(batches):
            s, texts, *rest = gap_batch(length, ties, *batch)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(s)), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in rest)], names=names)

    return series.select("series_id", "x", "shift", "n", "own").mapInArrow(run, f"series_id {kind}, code string, n long, first long, last long, squares long")


@F.pandas_udf(INTS)
def linear_limits_udf(x: pd.Series) -> pd.Series:
    """How many values from each place on are distinct, for all series of a batch at once."""
    offsets, values = _flat(x)
    return _rows(x, offsets, distinct_of(offsets, values + 0.0).astype(np.int32))


def linear_limits(x: Column) -> Column:
    return linear_limits_udf(x)
