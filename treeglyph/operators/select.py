"""Choosing patterns: by support, then shorter ones, then code; globally, per length, by groups of lengths, or all."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import code_array
from ..plans.tables import cut

MODES = ("global", "per_length", "all_observed", "grouped")


def order() -> list[Column]:
    """Support, largest first; length; code as numbers, a prefix before what it begins."""
    return [F.desc("support"), F.asc("length"), code_array(F.col("code")).asc()]


def best(support: DataFrame, budget: int) -> DataFrame:
    return support.orderBy(*order()).limit(budget)


def by_coverage(support: DataFrame, budget: int) -> DataFrame:
    """The best by the number of series that have a pattern often enough, then as in ``order``."""
    return support.orderBy(F.desc("qualifying"), *order()).limit(budget)


def ranked(chosen: DataFrame) -> DataFrame:
    """With rank, from 1. For chosen patterns: the ranks are given out on one machine."""
    return chosen.withColumn("rank", F.row_number().over(Window.orderBy(*order())))


def ranked_wide(chosen: DataFrame) -> DataFrame:
    """The same for any number of patterns: ranges of them are sorted by themselves, and each starts from the number of patterns in the ranges before it."""
    part = F.shiftright(F.col("__at"), 33)
    rows = cut(chosen.orderBy(*order()).withColumn("__at", F.monotonically_increasing_id()))
    sizes, before = [], 0
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():
        sizes.append((r["part"], before))
        before += r["count"]
    starts = chosen.sparkSession.createDataFrame(sizes, "part long, before long")
    number = (F.col("before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int")
    return rows.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", number).drop("__at", "part", "before")


def best_of(support: DataFrame, by: str, budgets: Column | int) -> DataFrame:
    """The best of each value of ``by``; partial limits keep what is shuffled small."""
    return support.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order()))).where(F.col("place") <= budgets).drop("place")


def choose(support: DataFrame, mode: str, budget: int = 0, minsup: float = 0.0, groups: Mapping[int, int] | None = None, group_budgets: Mapping[int, int] | None = None) -> DataFrame:
    """Corpus selection among patterns with ``minsup`` over all series. grouped: ``groups`` gives each length's group, ``group_budgets`` what each may take."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    able = support.where(F.col("support") >= minsup)
    if mode == "all_observed":
        return able
    if budget < 1:
        raise ValueError("a budget of at least 1 is needed")
    if mode == "global":
        return best(able, budget)
    if mode == "per_length":
        return best_of(able, "length", budget)
    if not groups or not group_budgets or set(groups.values()) != set(group_budgets) or sum(group_budgets.values()) > budget:
        raise ValueError("every group needs a budget, and all together no more than the whole one")
    table = [(m, g, group_budgets[g]) for m, g in groups.items()]
    sizes = able.sparkSession.createDataFrame(table, "length int, grp int, most int")
    return best_of(able.join(F.broadcast(sizes), "length"), "grp", F.col("most")).drop("grp", "most")


def capped(df: DataFrame, cap: int, what: str) -> DataFrame:
    """The same, or an error where there are more rows than the cap; never a part of them."""
    if df.limit(cap + 1).count() > cap:
        raise ValueError(f"more than {cap} {what}")
    return df
