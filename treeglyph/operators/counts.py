"""Counting window codes: per series, over the corpus, by position, with decay, for given codes, from scratch, and by pairs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import code_array, code_text, parent_distance, scratch_code, window_code
from ..functions.kernels import CountSpec, GrowSpec, code_ids, gap_parts, grown_counts, prefix_hashes, window_counts

SHORTEST, LONGEST = 2, 1_000_000
#: Patterns that may qualify, or be looked up, at a time; more are an error. What goes along to tasks, 16 bytes a pattern, is bounded by this.
CAP = 2_000_000


def lengths_of(lengths: Iterable[int]) -> tuple[int, ...]:
    """Sorted, unique, checked."""
    out = tuple(sorted(set(map(int, lengths))))
    if not out or out[0] < SHORTEST or out[-1] > LONGEST:
        raise ValueError(f"lengths have to be {SHORTEST} to {LONGEST}")
    return out


def series_counts(series: DataFrame, lengths: Iterable[int], ties: str = "strict", bins: int = 1, decay: float = 0.0, wanted: DataFrame | None = None) -> DataFrame:
    """series_id, length, code, bin, cnt. Windows are counted where the series are; what is shuffled is a row per series and code, summed up before."""
    if ties not in ("strict", "native") or bins < 1 or not 0 <= decay <= 100:
        raise ValueError("ties are strict or native, bins at least 1, decay 0 to 100")
    spec = CountSpec(lengths_of(lengths), ties, bins, float(decay))
    if wanted is not None:
        codes = codes_of(wanted, spec.lengths)
        if bins == 1 and not decay:
            return lookup(series, codes, ties).select("series_id", "length", "code", F.lit(0).alias("bin"), "cnt")
        wanted = series.sparkSession.createDataFrame([(c,) for c in codes], "code string")
    each = window_counts(series, spec)
    if wanted is not None:
        each = each.join(wanted, "code", "left_semi")
    return each.groupBy("series_id", "length", "code", "bin").agg(F.sum("cnt").alias("cnt"))


def codes_of(wanted: DataFrame, lengths: Iterable[int] | None = None, cap: int = CAP) -> list[str]:
    """The distinct codes of a table of patterns, of the given lengths."""
    codes = wanted.select("code").distinct()
    if lengths is not None:
        codes = codes.where(F.size(code_array(F.col("code"))).isin(*lengths))
    rows = codes.limit(cap + 1).collect()
    if len(rows) > cap:
        raise ValueError(f"more than {cap} patterns to look up")
    return [r["code"] for r in rows]


def occurrences(series: DataFrame, codes: list[str], ties: str = "strict") -> DataFrame:
    """series_id, length, code, cnt and st (the first start) of given codes. Windows only grow while they begin one of them."""
    names = series.sparkSession.createDataFrame(code_ids(codes), "code string, length int, h1 long, h2 long")
    lengths = tuple(sorted({c.count(",") + 1 for c in codes})) or (SHORTEST,)
    among = prefix_hashes(codes) if codes else {SHORTEST: np.empty(0, np.uint64)}
    each = grown_counts(series, GrowSpec(lengths, ties, tuple(among.items()))).drop("code")
    return each.join(names, ["length", "h1", "h2"]).groupBy("series_id", "length", "code").agg(F.sum("cnt").alias("cnt"), F.min("st").alias("st"))


def lookup(series: DataFrame, codes: list[str], ties: str = "strict") -> DataFrame:
    """series_id, length, code, cnt of given codes."""
    return occurrences(series, codes, ties).drop("st")


def qualifying(series: DataFrame, lengths: Iterable[int], minsup: float, ties: str = "strict", among: Mapping[int, np.ndarray] | None = None, segments: bool = True) -> DataFrame:
    """length, h1, h2 of the codes that some series has ``minsup`` times. A window of a whole series only grows while that series has so many of its code: one that
    qualifies there has no beginning that doesn't. Where there are ``segments``, those of a series are summed up first."""
    each = grown_counts(series, GrowSpec(tuple(lengths), ties, tuple((among or {}).items()), minsup)).drop("code")
    if segments:
        each = each.groupBy("series_id", "length", "h1", "h2").agg(F.sum("cnt").alias("cnt")).where(F.col("cnt") >= minsup)
    return each.select("length", "h1", "h2").distinct()


def support_among(series: DataFrame, lengths: Iterable[int], minsup: float, among: Mapping[int, np.ndarray], ties: str = "strict", segments: bool = True) -> DataFrame:
    """length, code, support and qualifying of the codes whose first hashes are among those of their length."""
    per = grown_counts(series, GrowSpec(tuple(lengths), ties, tuple(among.items()), texts=True))
    if segments:
        per = per.groupBy("series_id", "length", "h1", "h2").agg(F.sum("cnt").alias("cnt"), F.max("code").alias("code"))
    total = per.groupBy("length", "h1", "h2").agg(F.max("code").alias("code"), F.sum("cnt").alias("support"), F.count_if(F.col("cnt") >= minsup).alias("qualifying"))
    return total.select("length", "code", "support", "qualifying")


def support_of_all(series: DataFrame, lengths: Iterable[int], minsup: float, ties: str = "strict", segments: bool = True) -> DataFrame:
    """length, code, support and qualifying of every code. A series that is in one row has its counts there."""
    each = series_counts(series, lengths, ties) if segments else window_counts(series, CountSpec(lengths_of(lengths), ties))
    return corpus_support(each, minsup)


def corpus_support(counts: DataFrame, minsup: float = 2.0) -> DataFrame:
    """length, code, support (over all series) and qualifying (series with minsup or more)."""
    return counts.groupBy("length", "code").agg(F.sum("cnt").alias("support"), F.count_if(F.col("cnt") >= minsup).alias("qualifying"))


def eligible(support: DataFrame) -> DataFrame:
    return support.where("qualifying > 0")


def stage_stats(support: DataFrame) -> DataFrame:
    """length, observed, eligible, maximum_support."""
    return support.groupBy("length").agg(F.count("*").alias("observed"), F.count_if(F.col("qualifying") > 0).alias("eligible"), F.max("support").alias("maximum_support"))


def mass_by_length(support: DataFrame, minsup: float) -> DataFrame:
    """length, observed, eligible (by corpus support), mass."""
    return support.groupBy("length").agg(F.count("*").alias("observed"), F.count_if(F.col("support") >= minsup).alias("eligible"), F.sum("support").alias("mass"))


def distances(rows: DataFrame) -> DataFrame:
    """series_id, pos, pd of whole series, by array functions."""
    return rows.select("series_id", F.posexplode(parent_distance(F.col("x"))).alias("pos", "pd"))


def distinct_limits(rows: DataFrame) -> DataFrame:
    """series_id, pos, lim of series in long form: how many values from pos on are distinct; by window functions."""
    by = Window.partitionBy("series_id")
    following = F.coalesce(F.lead("pos").over(Window.partitionBy("series_id", "value").orderBy("pos")), F.col("n"))
    near = rows.withColumn("next", following)
    first = F.min("next").over(by.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return near.select("series_id", "pos", (first - F.col("pos")).cast("int").alias("lim"))


def valid_windows(limits: DataFrame, longest: int) -> DataFrame:
    """length and windows: how many windows of distinct values there are, from a histogram of limits."""
    histogram = limits.select(F.least("lim", F.lit(longest)).alias("length")).where("length >= 2").groupBy("length").agg(F.count("*").alias("k"))
    every = limits.sparkSession.range(2, longest + 1).select(F.col("id").cast("int").alias("length"))
    full = every.join(histogram, "length", "left")  # a row for each length
    above = F.sum(F.coalesce("k", F.lit(0))).over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return full.select("length", above.alias("windows"))


def windows_of(series: DataFrame, lengths: Iterable[int], ties: str = "strict", scratch: bool = False) -> DataFrame:
    """A row per window, by array functions: series_id, st, length, code (text), win (values). For examples and cross-checks; whole series."""
    sizes = F.array(*(F.lit(m) for m in lengths_of(lengths)))
    each = series.withColumn("length", F.explode(sizes)).where("n >= length")
    if not scratch:
        each = each.withColumn("pd", parent_distance(F.col("x")))
    each = each.withColumn("st", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("length")))).withColumn("win", F.slice("x", (F.col("st") + 1).cast("int"), F.col("length")))
    if ties == "strict":
        each = each.where(F.size(F.array_distinct("win")) == F.col("length"))
    code = scratch_code(F.col("win")) if scratch else window_code(F.col("pd"), F.col("st").cast("int"), F.col("length"))
    return each.select("series_id", F.col("st").cast("int").alias("st"), "length", code_text(code).alias("code"), "win", "n")


def equal_pairs(counts: DataFrame) -> DataFrame:
    """length, code, windows and pairs of windows that are equal: what comparing all windows with each other finds, without the pairs."""
    total = counts.groupBy("length", "code").agg(F.sum("cnt").cast("long").alias("windows"))
    return total.withColumn("pairs", F.floor(F.col("windows") * (F.col("windows") - 1) / 2).cast("long"))


def pair_links(windows: DataFrame, within: bool = False) -> DataFrame:
    """The pairs themselves, as an equi-join: for small inputs, as their number is quadratic; ``within``: those of a series only, of which there are at most its length squared."""
    a = windows.select(F.struct("series_id", "st").alias("a"), "length", "code")
    a = a.withColumn("series", F.col("a.series_id") if within else F.lit(0))
    return a.join(a.withColumnRenamed("a", "b"), ["series", "length", "code"]).where(F.col("a") > F.col("b")).drop("series")


def best_of_length(support: DataFrame, length: int, budget: int) -> DataFrame:
    """The most frequent patterns of one length."""
    return support.where(F.col("length") == length).orderBy(F.desc("support"), code_array(F.col("code")).asc()).limit(budget)


def best_of_series(windows: DataFrame, budget: int) -> DataFrame:
    """series_id, place, code, cnt, st: each series' most frequent codes among windows of one length, earlier ones first where they are as frequent (st: the first occurrence)."""
    held = windows.groupBy("series_id", "code").agg(F.count("*").alias("cnt"), F.min("st").alias("st"))
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("cnt"), "st"))
    return held.withColumn("place", place).where(F.col("place") <= budget).select("series_id", "place", "code", "cnt", "st")


def intervals(support: DataFrame, minsup: float) -> DataFrame:
    """What mining one series gives in short: a row for each frequent pattern that no longer one with as much support goes on from, with how many of its beginnings have the same
    support (``lo``: the shortest such length; ``hi``: its own)."""
    frequent = support.where(F.col("support") >= minsup).select("series_id", "code", "length", "support")
    longer = frequent.select("series_id", F.regexp_replace("code", ",[0-9]+$", "").alias("code"), "support", F.lit(True).alias("goes_on")).distinct()
    marked = frequent.join(longer, ["series_id", "code", "support"], "left")
    ends = marked.where("goes_on is null").drop("goes_on")
    begins = ends.select("series_id", F.col("code").alias("end"), "support", F.col("length").alias("hi"), F.explode(F.sequence(F.lit(2), F.col("length"))).alias("length"))
    begins = begins.withColumn("code", F.array_join(F.slice(F.split("end", ","), F.lit(1), F.col("length")), ","))
    same = begins.join(frequent.select("series_id", "code", "support"), ["series_id", "code", "support"], "left_semi")
    return same.groupBy("series_id", F.col("end").alias("code"), "support", "hi").agg(F.min("length").alias("lo"))


def bin_vectors(counts: DataFrame, bins: int) -> DataFrame:
    """series_id, length, code and ``values``: the counts of all bins in order."""
    cells = F.map_from_entries(F.collect_list(F.struct("bin", "cnt")))
    got = counts.groupBy("series_id", "length", "code").agg(cells.alias("cells"))
    values = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.element_at("cells", i), F.lit(0.0)))
    return got.select("series_id", "length", "code", values.alias("values"))


def decayed_by_mass(series: DataFrame, lengths: Iterable[int], decay: float) -> DataFrame:
    """series_id, length, code, cnt: decayed support in closed form. A window's weight at length m is its weight at length 1 times exp(decay (m - 1) / n), so each code's
    mass of weights at length 1 is scaled once. For native ties, as leaves of a tree have them."""
    spec = CountSpec(lengths_of(lengths), "native", 1, float(decay), mass=True)
    sizes = series.select("series_id", "n").distinct()
    mass = window_counts(series, spec).groupBy("series_id", "length", "code").agg(F.sum("cnt").alias("mass")).join(sizes, "series_id")
    return mass.select("series_id", "length", "code", (F.col("mass") * F.exp(F.lit(float(decay)) * (F.col("length") - 1) / F.col("n"))).alias("cnt"))


def gaps(series: DataFrame, length: int, ties: str = "strict") -> DataFrame:
    """series_id, code, gaps, gap_sum, gap_squares, cv of the distances between a code's occurrences in a series. Series, or segments of them, give first and last start and a sum;
    the distances from a segment to the next are added where these meet."""
    part = F.struct("first", "last", "n", "squares")
    parts = gap_parts(series, length, ties).groupBy("series_id", "code").agg(F.array_sort(F.collect_list(part)).alias("p"))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"]) - 1
    inside = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["squares"])
    size = F.size("p")
    between = F.zip_with(F.slice("p", F.lit(2), F.greatest(size - 1, F.lit(0))), F.slice("p", F.lit(1), F.greatest(size - 1, F.lit(0))), lambda x, y: x["first"] - y["last"])
    squares = inside + F.aggregate(between, F.lit(0).cast("long"), lambda a, g: a + g * g)
    total = F.element_at("p", -1)["last"] - F.element_at("p", 1)["first"]
    sums = parts.select("series_id", "code", n.alias("gaps"), total.alias("gap_sum"), squares.alias("gap_squares")).where("gaps > 0")
    return sums.withColumn("cv", variation(F.col("gaps"), F.col("gap_sum"), F.col("gap_squares")))


def variation(n: Column, total: Column, squares: Column) -> Column:
    mean = total / n
    return F.sqrt(F.greatest(F.lit(0.0), squares / n - mean * mean)) / mean


