"""Encoding and counting against a brute-force encoder, on exhaustive and random corpora."""

import itertools
import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeglyph.functions import codes, kernels
from treeglyph.operators import counts
from treeglyph.plans import mining
from treeglyph.sources import series as src


def brute_code(window):
    out = []
    for i, v in enumerate(window):
        near = [j for j in range(i) if window[j] <= v]
        out.append(i - near[-1] if near else 0)
    return out


def brute_counts(series, lengths, ties="strict"):
    out = Counter()
    for sid, x in series.items():
        x = [v + 0.0 for v in x]
        for m in lengths:
            for s in range(len(x) - m + 1):
                w = x[s : s + m]
                if ties == "native" or len(set(w)) == m:
                    out[sid, m, ",".join(map(str, brute_code(w)))] += 1
    return out


TIES = {0: [0, 0, 1, 2, 1, 3, 4, 5], 1: [1, 2, 3, 1, 2, 4, 3, 5], 2: [-0.0, 0.0, -1, 2, -1, 3, 2, 4], 3: [3] * 8}
MONOTONE = {0: list(range(1, 11)), 1: list(range(10, 0, -1))}
_r = random.Random(17)
MIX = {i: ([_r.random() for _ in range(_r.randint(10, 24))] if i % 2 else [_r.randint(0, 8) for _ in range(_r.randint(10, 24))]) for i in range(40)}
TERNARY = dict(enumerate(list(x) for n in range(2, 6) for x in itertools.product((-1, 0, 1), repeat=n)))


def as_series(spark, data):
    rows = [(i, [float(v) for v in x]) for i, x in data.items()]
    return src.whole(spark.createDataFrame(rows, "series_id long, x array<double>"))


def as_rows(spark, data):
    return src.numbered(spark.createDataFrame([(i, p, float(v)) for i, x in data.items() for p, v in enumerate(x)], "sid long, p int, v double"), "sid", ["p"], "v")


def got(df):
    return {(r["series_id"], r["length"], r["code"]): r["cnt"] for r in df.collect()}


@pytest.mark.parametrize("data", [TIES, MONOTONE, MIX, TERNARY], ids=["ties", "monotone", "mix", "ternary"])
@pytest.mark.parametrize("ties", ["strict", "native"])
@pytest.mark.parametrize("lengths", [(2, 3, 4, 5, 6, 7, 8), (3, 6, 9)])
def test_counts(spark, data, ties, lengths):
    assert got(counts.series_counts(as_series(spark, data), lengths, ties)) == brute_counts(data, lengths, ties)


def test_scratch_and_pair_engines_agree(spark):
    s = as_series(spark, MIX)
    w = counts.windows_of(s, [3, 4])
    scratch = counts.windows_of(s, [3, 4], scratch=True)
    assert w.select("series_id", "st", "code").exceptAll(scratch.select("series_id", "st", "code")).isEmpty()
    pairs = {(r["length"], r["code"]): r["count"] for r in counts.pair_links(w).groupBy("length", "code").count().collect()}
    summed = {(r["length"], r["code"]): r["pairs"] for r in counts.equal_pairs(counts.series_counts(s, [3, 4])).where("pairs > 0").collect()}
    assert pairs == summed


@pytest.mark.parametrize("segment", [3, 7, 1000])
def test_segments_give_the_same(spark, segment):
    rows = as_rows(spark, MIX)
    assert got(counts.series_counts(src.gather(rows, 6, segment), range(2, 7))) == brute_counts(MIX, range(2, 7))


def test_bins_and_decay_over_segments(spark):
    for segment in (5, 1000):
        s = src.gather(as_rows(spark, MIX), 4, segment)
        binned, decayed = Counter(), Counter()
        for sid, x in MIX.items():
            for m in (3, 4):
                for p in range(len(x) - m + 1):
                    w = [v + 0.0 for v in x[p : p + m]]
                    code = ",".join(map(str, brute_code(w)))
                    if len(set(w)) == m:
                        binned[sid, code, min(2, p * 3 // (len(x) - m + 1))] += 1
                    decayed[sid, code] += math.exp(-1.5 * (len(x) - p - m) / len(x))
        assert {(r["series_id"], r["code"], r["bin"]): r["cnt"] for r in counts.series_counts(s, [3, 4], bins=3).collect()} == binned
        have = {(r["series_id"], r["code"]): r["cnt"] for r in counts.series_counts(s, [3, 4], "native", decay=1.5).collect()}
        assert have.keys() == decayed.keys() and all(abs(have[k] - decayed[k]) < 1e-9 for k in have)


def test_distances_and_limits_in_both_forms(spark):
    data = {**TIES, **MIX}
    s, rows = as_series(spark, data), as_rows(spark, data)
    a = s.select("series_id", codes.parent_distance(F.col("x")).alias("pd"), kernels.parent_distance_linear("x").alias("pd2"), kernels.linear_limits(F.col("x")).alias("lim")).collect()
    window_form = {(r["series_id"], r["pos"]): r["lim"] for r in counts.distinct_limits(rows).collect()}
    for r in a:
        assert r["pd"] == r["pd2"]
        x = [v + 0.0 for v in data[r["series_id"]]]
        for i in range(len(x)):
            n = next((k for k in range(1, len(x) - i + 1) if len(set(x[i : i + k])) < k), len(x) - i + 1) - 1
            assert r["lim"][i] == window_form[r["series_id"], i] == n


def brute_mine(data, budget, minsup, lengths):
    per = brute_counts(data, lengths)
    total, best = Counter(), Counter()
    for (_, m, code), n in per.items():
        total[m, code] += n
        best[m, code] = max(best[m, code], n)
    ok = sorted((k for k in total if best[k] >= minsup), key=lambda k: (-total[k], k[0], [int(c) for c in k[1].split(",")]))
    return [(m, code, float(total[m, code])) for m, code in (ok[:budget] if budget else ok)]


@pytest.mark.parametrize("budget,minsup", [(1, 2), (5, 2), (30, 1), (30, 3), (0, 2), (0, 4)])
def test_mining_in_rounds_and_by_level(spark, budget, minsup):
    longest = max(map(len, MIX.values()))
    want = brute_mine(MIX, budget, minsup, range(2, longest + 1))
    rows = lambda m: [(r["length"], r["code"], r["support"]) for r in m.dictionary.orderBy("rank").collect()]
    assert rows(mining.mine(as_series(spark, MIX), budget, minsup)) == want
    if budget in (5, 0):
        assert rows(mining.mine_levelwise(as_rows(spark, MIX), budget, minsup)) == want


def test_mining_named_lengths_and_features(spark):
    s = as_series(spark, MIX)
    m = mining.mine(s, 5, 2, lengths=[3, 6, 9])
    want = brute_mine(MIX, 5, 2, [3, 6, 9])
    assert [(r["length"], r["code"], r["support"]) for r in m.dictionary.orderBy("rank").collect()] == want
    per = brute_counts(MIX, [3, 6, 9])
    cells = {(r["series_id"], r["rank"]): r["cnt"] for r in m.features(s).collect()}
    assert cells == {(sid, i + 1): float(per[sid, length, code]) for sid in MIX for i, (length, code, _) in enumerate(want)}
    with pytest.raises(ValueError):
        m.features(s, max_cells=3)


def test_caps_and_arguments_fail(spark):
    s = as_series(spark, TIES)
    with pytest.raises(ValueError):
        mining.mine(s, 0, 1, cap=1)
    for bad in ([1, 2], [], [2_000_000]):
        with pytest.raises(ValueError):
            counts.lengths_of(bad)
    with pytest.raises(ValueError):
        counts.series_counts(s, [2], ties="loose")
    with pytest.raises(Exception):  # noqa: B017
        counts.series_counts(as_series(spark, {0: [1.0, float("nan"), 2.0]}), [2]).collect()
    with pytest.raises(Exception):  # noqa: B017
        src.checked(as_series(spark, {0: []})).select("x").collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-3, 3).map(float), min_size=1, max_size=14))
def test_kernel_on_any_series(x):
    import numpy as np

    out = {}
    for m, s, _, cnt, number, texts in kernels.count_batch(kernels.CountSpec(tuple(range(2, 15)), "native"), np.array([0, len(x)]), np.array(x), np.array([0]), np.array([len(x)]), np.array([len(x)])):
        out |= {(int(i), m, texts[n]): c for i, n, c in zip(s, number, cnt, strict=True)}
    assert out == brute_counts({0: x}, range(2, 15), "native")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=10))
def test_tree_of_code(x):
    root, parents, depth = kernels.decode_tree(brute_code(x))

    def build(lo, hi, parent, d):
        if lo > hi:
            return
        low = min(range(lo, hi + 1), key=lambda i: (x[i], i))
        assert parents[low] == parent and depth[low] == d
        build(lo, low - 1, low, d + 1)
        build(low + 1, hi, low, d + 1)

    build(0, len(x) - 1, -1, 0)
    assert parents[root] == -1


def test_invalid_codes_have_no_tree():
    assert kernels.decode_tree([0, 2]) is None and kernels.decode_tree([0, -1]) is None and kernels.decode_tree([0, 0, 2]) is None


@pytest.mark.parametrize("segment", [4, 9, 1000])
@pytest.mark.parametrize("ties", ["strict", "native"])
def test_occurrences_and_gaps(spark, segment, ties):
    s = src.gather(as_rows(spark, MIX), 3, segment)
    starts = {}
    for sid, x in MIX.items():
        for p in range(len(x) - 2):
            w = [v + 0.0 for v in x[p : p + 3]]
            if ties == "native" or len(set(w)) == 3:
                starts.setdefault((sid, ",".join(map(str, brute_code(w)))), []).append(p)
    codes_ = sorted({c for _, c in starts})[:3]
    got_ = {(r["series_id"], r["code"]): (r["cnt"], r["st"]) for r in counts.occurrences(s, codes_, ties).collect()}
    assert got_ == {k: (len(v), v[0]) for k, v in starts.items() if k[1] in codes_}
    gaps = {(r["series_id"], r["code"]): (r["gaps"], r["gap_sum"], r["gap_squares"]) for r in counts.gaps(s, 3, ties).collect()}
    want = {k: [b - a for a, b in zip(v, v[1:])] for k, v in starts.items() if len(v) > 1}
    assert gaps == {k: (len(g), sum(g), sum(x * x for x in g)) for k, g in want.items()}
    assert counts.occurrences(s, [], ties).count() == 0 and counts.gaps(s.limit(0), 3, ties).count() == 0
