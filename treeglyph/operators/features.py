"""Features from counts: the matrix, scaling, diagnostics, class contrasts, representatives and changes between dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import code_array, is_monotone


def matrix(series: DataFrame, dictionary: DataFrame, counts: DataFrame) -> DataFrame:
    """series_id, rank, cnt (double, 0 where a series has none; and label, if series have one). Ranks count from 1."""
    names = dictionary.select("code", "rank")
    have = counts.join(names, "code").select("series_id", "rank", "cnt")
    ids = series.select(*(c for c in series.columns if c in ("series_id", "label")))
    size = names.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("top"), F.count("*").alias("k")).first()
    ranks = F.sequence(F.lit(1), F.lit(int(size["top"]))) if size["top"] else F.array().cast("array<int>")
    cells = ids.withColumn("rank", F.explode(ranks))
    if size["k"] != size["top"]:  # some ranks aren't in the dictionary
        cells = cells.join(names.select("rank"), "rank", "left_semi")
    return cells.join(have, ["series_id", "rank"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0.0)))


def vectors(cells: DataFrame) -> DataFrame:
    """One array per series, in the order of ranks."""
    keys = [c for c in ("series_id", "label") if c in cells.columns]
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cnt"))), lambda t: t["cnt"]).alias("features"))


def scaled(cells: DataFrame) -> DataFrame:
    """cnt less its column's mean, over the population deviation; 0 for constant columns. Moments are summed before the shuffle and joined back."""
    moments = cells.groupBy("rank").agg(F.avg("cnt").alias("mu"), F.stddev_pop("cnt").alias("sigma"))
    z = F.when(F.col("sigma") > 0, (F.col("cnt") - F.col("mu")) / F.col("sigma")).otherwise(F.lit(0.0))
    return cells.join(moments, "rank").withColumn("z", z).drop("mu", "sigma")


def diagnostics(cells: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row: patterns, unique and constant columns, share of series without any pattern, monotone patterns, code units."""
    columns = cells.groupBy("rank").agg(F.sum(F.xxhash64("series_id", "cnt").cast("decimal(38,0)")).alias("h"), F.min("cnt").alias("lo"), F.max("cnt").alias("hi"))
    c = columns.agg(F.countDistinct("h").alias("unique_columns"), F.count_if(F.col("lo") == F.col("hi")).alias("constant_columns"))
    r = cells.groupBy("series_id").agg(F.max("cnt").alias("top")).agg(F.avg((F.col("top") == 0).cast("double")).alias("zero_row_fraction"))
    d = dictionary.agg(F.count("*").alias("patterns"), F.count_if(is_monotone(code_array(F.col("code")))).alias("monotone_patterns"), F.sum("length").cast("long").alias("code_units"))
    return d.crossJoin(c).crossJoin(r)  # one row each


def class_stats(cells: DataFrame) -> DataFrame:
    """By rank and label: n, support, present, presence, mean, std, median, and the mean's ratio to the overall mean."""
    per = cells.groupBy("rank", "label").agg(
        F.count("*").alias("n"),
        F.sum("cnt").alias("support"),
        F.count_if(F.col("cnt") > 0).alias("present"),
        F.avg("cnt").alias("mean"),
        F.stddev_pop("cnt").alias("std"),
        F.median("cnt").alias("median"),
    )
    overall = cells.groupBy("rank").agg(F.avg("cnt").alias("overall"))
    return per.join(overall, "rank").withColumn("presence", F.col("present") / F.col("n")).withColumn("ratio", F.when(F.col("overall") != 0, F.col("mean") / F.col("overall"))).drop("overall")


def contrast(cells: DataFrame) -> DataFrame:
    """By rank: support, present, mean, std, constant, eta_squared (the share of variance that class means explain), strongest class (the first in order of those with the largest mean)."""
    moments = cells.groupBy("rank", "label").agg(F.count("*").alias("n"), F.avg("cnt").alias("m"), F.var_pop("cnt").alias("v"), F.sum("cnt").alias("s"), F.count_if(F.col("cnt") > 0).alias("p"))
    overall = moments.groupBy("rank").agg((F.sum("s") / F.sum("n")).alias("mu"))
    per = moments.join(overall, "rank")  # deviations from the mean, not differences of large sums
    between = F.sum(F.col("n") * (F.col("m") - F.col("mu")) * (F.col("m") - F.col("mu")))
    variation = between + F.sum(F.col("n") * F.col("v"))
    eta = F.when(variation > 0, F.least(F.lit(1.0), between / variation)).otherwise(F.lit(0.0))
    return per.groupBy("rank").agg(
        F.sum("s").alias("support"),
        F.sum("p").alias("present"),
        F.first("mu").alias("mean"),
        F.sqrt(variation / F.sum("n")).alias("std"),
        (variation == 0).alias("constant"),
        eta.alias("eta_squared"),
        F.min(F.struct(-F.col("m"), F.col("label")))["label"].alias("strongest"),
    )


def contrast_rank(contrasts: DataFrame) -> DataFrame:
    """Rank by eta_squared, largest first, then by rank. For dictionaries: the ranks are given out on one machine."""
    return contrasts.withColumn("contrast_rank", F.row_number().over(Window.orderBy(F.desc(F.round("eta_squared", 9)), "rank")))


def representatives(contrasts: DataFrame, top: int, contrast_top: int) -> DataFrame:
    """Patterns that are among the first by frequency or by contrast, with the reasons."""
    reason: Column = F.concat_ws("+", F.when(F.col("rank") <= top, F.lit("frequency")), F.when(F.col("contrast_rank") <= contrast_top, F.lit("posthoc_label_contrast")))
    return contrast_rank(contrasts).withColumn("reason", reason).where("reason <> ''")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Codes that a dictionary gained or lost against another one, or that changed places."""
    a, b = old.select("code", F.col("rank").alias("old_rank")), new.select("code", F.col("rank").alias("new_rank"))
    change = F.when(F.col("old_rank").isNull(), "added").when(F.col("new_rank").isNull(), "removed").when(F.col("old_rank") != F.col("new_rank"), "moved").otherwise("kept")
    return a.join(b, "code", "full").withColumn("change", change)


def catalogue(dictionaries: DataFrame) -> DataFrame:
    """From budget and code: each code's first budget and all its budgets."""
    return dictionaries.groupBy("code").agg(F.min("budget").alias("first_budget"), F.array_join(F.array_sort(F.collect_set("budget")), ",").alias("budgets"))


def examples(series: DataFrame, first: DataFrame, dictionary: DataFrame, per_code: int) -> DataFrame:
    """The first window of each code in the series that have it most often: series by count, then id. ``first``: series_id, code, cnt and st, as counts.occurrences gives them."""
    held = first.join(dictionary.select("code", "rank"), "code")
    place = F.row_number().over(Window.partitionBy("rank").orderBy(F.desc("cnt"), "series_id"))
    chosen = held.withColumn("place", place).where(F.col("place") <= per_code)
    here = (F.col("st") >= F.col("shift")) & (F.col("st") < F.col("shift") + F.col("own"))
    win = F.slice("x", (F.col("st") - F.col("shift") + 1).cast("int"), F.col("length"))
    joined = series.select("series_id", "x", "shift", "own").join(chosen, "series_id").where(here)
    return joined.select("rank", "code", "place", "series_id", F.col("cnt").cast("long").alias("cnt"), F.col("st").cast("int").alias("st"), win.alias("win"))


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one has and the other hasn't; empty where both are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def shared_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two sets of cells (series_id, code, cnt), as two budgets give: each code that both have, its series, how many have other counts in the one than in the other, and its sum."""
    other = b.select("series_id", "code", F.col("cnt").alias("other"))
    both = a.select("code").distinct().join(b.select("code").distinct(), "code")
    cells = a.select("series_id", "code", "cnt").join(other, ["series_id", "code"], "full").join(both, "code")
    return cells.groupBy("code").agg(F.count("*").alias("series"), F.count_if(~F.col("cnt").eqNullSafe(F.col("other"))).alias("differing"), F.sum("cnt").alias("support"))


def budget_steps(dictionaries: DataFrame, budgets: list[int]) -> DataFrame:
    """From budget, rank and code: for each step from a budget to the next, patterns added, removed and shared, whether the smaller dictionary is a subset, and whether it is the
    beginning of the larger one."""
    steps = dictionaries.sparkSession.createDataFrame(list(zip(budgets, budgets[1:])), "from_budget int, to_budget int")
    side = lambda at, rank: dictionaries.join(F.broadcast(steps), dictionaries["budget"] == steps[at]).select("from_budget", "to_budget", "code", F.col("rank").alias(rank))
    both = side("from_budget", "old").join(side("to_budget", "new"), ["from_budget", "to_budget", "code"], "full")
    kept = F.col("old").isNotNull()
    n = lambda c: F.count_if(c)
    per = both.groupBy("from_budget", "to_budget").agg(n(~kept).alias("added"), n(F.col("new").isNull()).alias("removed"), n(kept & F.col("new").isNotNull()).alias("shared"), n(kept & ~F.col("old").eqNullSafe(F.col("new"))).alias("moved"))
    return per.select("from_budget", "to_budget", "added", "removed", "shared", (F.col("removed") == 0).alias("smaller_is_subset"), (F.col("moved") == 0).alias("exact_prefix"))
