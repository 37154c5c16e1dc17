"""Mining: the patterns that reach ``minsup`` in some series, by support over all series; the best ``budget`` of them, or all (budget 0).

Support can't grow with length, per series or over all. So lengths are mined in growing rounds until no longer pattern can qualify, or enter the
best; and with all lengths allowed, the best K are among lengths 2 to K + 1, as each prefix of a pattern is shorter and has no less support.

From the second round on two passes over the series make a round. The first finds what qualifies: a window grows only while its series has ``minsup`` of its code,
and while its beginnings are patterns of the rounds before that can still lead to the best. The second counts these in all series. Patterns are
told apart by 128 bits of hashes on the way; the codes themselves leave a task once for each pattern. So time, memory and what is shuffled follow the patterns that
qualify and not the windows that there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import linear_limits, parent_distance_linear, prefix_hashes
from ..operators import counts as C
from ..operators import select as S
from ..operators.features import matrix
from ..sources.series import LONGEST_WHOLE, gather, regather
from .tables import cut

CAP, MAX_CELLS = C.CAP, 100_000_000
SLACK = 1 - 1e-12
KEEP = StorageLevel.MEMORY_AND_DISK


@dataclass
class Mined:
    """dictionary: rank, code, length, support, qualifying_series. stages: by length the patterns that were counted (all of the first lengths; later those that can qualify),
    those that qualify, the largest support, and the support that the best so far ended with after its round (null: there were fewer). reason: why no longer lengths were mined."""

    dictionary: DataFrame
    stages: DataFrame
    reason: str
    ties: str = "strict"
    series: DataFrame | None = None

    @property
    def counts(self) -> DataFrame:
        """series_id, length, code, cnt of the dictionary's patterns."""
        if self.series is None:
            raise ValueError("no series to count in")
        return C.lookup(self.series, C.codes_of(self.dictionary), self.ties)

    def features(self, series: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
        """series_id, rank, cnt: a row for every series and pattern."""
        n, k = series.select("series_id").distinct().count(), self.dictionary.count()
        if n * k > max_cells:
            raise ValueError(f"{n} x {k} feature cells are more than {max_cells}")
        return matrix(series.select("series_id").distinct(), self.dictionary, self.counts)


def rounds(lengths: list[int]) -> list[list[int]]:
    """2 to 5, 6 to 10, 11 to 20 and so on, as far as the lengths go."""
    out, top, rest = [], 5, list(lengths)
    while rest:
        own = [m for m in rest if m <= top]
        rest = rest[len(own) :]
        if own:
            out.append(own)
        top *= 2
    return out


def wanted_lengths(series: DataFrame, budget: int, lengths: Iterable[int] | None, longest: int | None = None) -> list[int]:
    """``longest``: that of the series, if it is known."""
    if lengths is not None:
        out = list(C.lengths_of(lengths))
        return out[:budget] if budget else out  # each of the first K lengths has a prefix that outranks what is longer
    longest = longest or series.agg(F.max("n")).first()[0] or 0
    return list(range(2, min(longest, budget + 1) + 1 if budget else longest + 1))


def mine(series: DataFrame, budget: int, minsup: float = 2.0, lengths: Iterable[int] | None = None, cap: int = CAP, ties: str = "strict", keep: bool = True, stop_early: bool = True, max_cells: int | None = None) -> Mined:
    """By rounds of lengths. ``series`` are whole, one row for each id, or segments, which are made anew for rounds whose lengths pass their overlap; with ``keep`` they stay in memory or on
    executors' disks while rounds go on, and are made anew where an executor is lost. More than ``cap`` patterns that qualify are an error, in any mode. With a
    budget the driver holds the best of the rounds so far: that many rows. Without ``stop_early`` all lengths at which anything qualifies are gone through,
    which changes the stages and not the dictionary. ``max_cells``: without a budget, more cells of patterns and series than that are an error while mining."""
    if budget < 0 or not math.isfinite(minsup) or minsup <= 0 or cap < 1:
        raise ValueError("invalid budget, minsup or cap")
    spark, given = series.sparkSession, series
    series = series.persist(KEEP) if keep else series
    held = [series]
    longest, fits = series.agg(F.max("n"), F.expr(LONGEST_WHOLE)).first()
    todo = wanted_lengths(series, budget, lengths, longest)
    n_series = series.select("series_id").distinct().count() if max_cells is not None and not budget else 0
    found: DataFrame | None = None
    stages, top, seen = [], [], 0
    reason = "all lengths"
    among: dict[int, np.ndarray] = {}
    for own in rounds(todo):
        if fits is not None and own[-1] > fits:
            series, fits = regather(series, own[-1]), own[-1]
            given = series
            series = series.persist(KEEP) if keep else series
            held.append(series)
        if own[-1] <= 5:  # few patterns: counted at once
            support = C.support_of_all(series, own, minsup, ties, fits is not None)
        else:
            ids = C.qualifying(series, own, minsup, ties, among, fits is not None).limit(cap - seen + 1).toArrow()
            _check(seen + len(ids), cap)
            length, h1 = ids.column("length").to_numpy(), ids.column("h1").to_numpy().view(np.uint64)
            support = C.support_among(series, own, minsup, among | {m: np.unique(h1[length == m]) for m in own}, ties, fits is not None)
        support = support.persist(KEEP)
        per = {r["length"]: r for r in C.stage_stats(support).collect()}
        seen += sum(r["eligible"] for r in per.values())
        _check(seen, cap)
        if max_cells is not None and not budget and seen * n_series > max_cells:
            raise ValueError(f"{n_series} x {seen} feature cells are more than {max_cells}")
        able = C.eligible(support)
        if budget:
            top = _merged(top, able, budget)
        else:
            here = cut(able)
            found = here if found is None else found.unionByName(here)
        cutoff = top[-1][2] if budget and len(top) >= budget else None
        stages += [(m, per[m]["observed"], per[m]["eligible"], per[m]["maximum_support"], cutoff) for m in own if m in per]
        last, more = per.get(own[-1]), own[-1] != todo[-1]
        if not last or not last["eligible"]:
            reason = "no pattern of the last length qualifies"
        elif more:
            if budget and stop_early:
                # what isn't among the best so far can't begin a longer one that gets there
                codes = [code for code, length, _, _ in top if length == own[-1]]
            else:
                codes = [r["code"] for r in able.where(F.col("length") == own[-1]).select("code").collect()]
            among = prefix_hashes(codes)
            reason = reason if codes else "no longer pattern can enter"
        support.unpersist()
        if reason != "all lengths":
            break
    _drop(held)
    if not todo:
        raise ValueError("no length fits any series")
    return Mined(_dictionary(spark, top) if budget else _all(found), spark.createDataFrame(stages, "length int, observed long, eligible long, maximum_support double, cutoff double"), reason, ties, given)


def _merged(top: list[tuple], able: DataFrame, budget: int) -> list[tuple]:
    """The best of those so far and of a round's patterns: code, length, support, qualifying."""
    new = S.best(able, budget).select("code", "length", "support", "qualifying").collect()
    return sorted([*top, *map(tuple, new)], key=lambda t: (-t[2], t[1], list(map(int, t[0].split(",")))))[:budget]


def _dictionary(spark: SparkSession, top: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(top, 1)], "rank int, code string, length int, support double, qualifying_series long")


def _all(able: DataFrame) -> DataFrame:
    return S.ranked_wide(able).select("rank", "code", "length", "support", F.col("qualifying").alias("qualifying_series"))


def _check(patterns: int, cap: int) -> None:
    if patterns > cap:
        raise ValueError(f"more than {cap} patterns")


def _drop(held: list[DataFrame]) -> None:
    for df in held:
        df.unpersist()


def mine_levelwise(rows: DataFrame, budget: int, minsup: float = 2.0, longest: int | None = None, exact_stages: bool = False, cap: int = CAP) -> Mined:
    """Length by length on long-form series (series_id, pos, value, n), by joins: a window's code is its number at the length before and one more distance, so a
    length costs the number of windows. Only windows whose prefix qualifies are extended (unless ``exact_stages``). Numbers are ranks of codes among those of their
    length, in order of number and distance, and so in that of the codes; they are given out on one machine, to ``cap`` patterns at most."""
    spark = rows.sparkSession
    limit = longest or (budget + 1 if budget else rows.agg(F.max("n")).first()[0] or 0)
    if limit < 2:
        raise ValueError("no length fits any series")
    series = gather(rows, limit)
    each = cut(series.select("series_id", "shift", "own", parent_distance_linear("x").alias("pd"), linear_limits(F.col("x")).alias("lim")))
    starts = each.select("series_id", "shift", F.posexplode(F.slice("lim", F.lit(1), F.col("own").cast("int"))).alias("at", "lim"))
    windows = starts.select("series_id", (F.col("shift") + F.col("at")).alias("st"), "lim", F.lit(1).alias("id"))
    # a distance is that of the segment in which all windows that end there begin
    ends = each.select("series_id", "shift", F.posexplode("pd").alias("at", "pd")).where((F.col("shift") == 0) | (F.col("at") >= limit - 1))
    step = ends.select("series_id", (F.col("shift") + F.col("at")).alias("end"), "pd")
    names = spark.createDataFrame([(1, "0")], "id int, code string")
    chosen = stages = None
    reason, seen, top = "all lengths", 0, []
    for m in range(2, limit + 1):
        live = windows.where(F.col("lim") >= m).withColumn("end", F.col("st") + m - 1).join(step, ["series_id", "end"])
        live = live.select("series_id", "st", "lim", "id", F.when(F.col("pd") < m, F.col("pd")).otherwise(0).alias("next"))
        counts = live.groupBy("id", "next", "series_id").agg(F.count("*").cast("double").alias("cnt"))
        support = counts.groupBy("id", "next").agg(F.sum("cnt").alias("support"), F.count_if(F.col("cnt") >= minsup).alias("qualifying"))
        support = cut(support.join(names, "id").select("id", "next", "support", "qualifying", F.concat_ws(",", "code", F.col("next").cast("string")).alias("code"), F.lit(m).alias("length")))
        able = C.eligible(support)
        stage = C.stage_stats(support)
        stages = stage if stages is None else stages.unionByName(stage)
        most, qualify, observed = support.agg(F.max("support"), F.count_if(F.col("qualifying") > 0), F.count("*")).first()
        seen += qualify
        _check(max(seen, observed if exact_stages else 0), cap)
        if budget:
            top = _merged(top, able, budget)
        else:
            here = able.select("length", "code", "support", "qualifying")
            chosen = here if chosen is None else chosen.unionByName(here)
        if not qualify:
            reason = "no pattern of the last length qualifies"
            break
        if budget and len(top) >= budget and most < top[-1][2] * SLACK:
            reason = "no longer pattern can enter"
            break
        on = (support if exact_stages else able).withColumn("new", F.row_number().over(Window.orderBy("id", "next")))
        windows = cut(live.join(on.select("id", "next", "new"), ["id", "next"]).select("series_id", "st", "lim", F.col("new").alias("id")))
        names = on.select(F.col("new").alias("id"), "code")
    return Mined(_dictionary(spark, top) if budget else _all(chosen), stages, reason, "strict", series)
