"""Evaluation: clusters against labels, dataset checks, means over repeats, speed-ups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import all_finite


def cluster_metrics(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """nmi (geometric), homogeneity and ari, from the contingency table."""
    cells = df.groupBy(F.col(label).alias("i"), F.col(cluster).alias("j")).agg(F.count("*").cast("double").alias("n"))
    row, col = F.sum("n").over(Window.partitionBy("i")), F.sum("n").over(Window.partitionBy("j"))
    every = df.agg(F.count("*").cast("double").alias("total"))
    t = cells.withColumn("a", row).withColumn("b", col).crossJoin(F.broadcast(every))  # one row
    pairs = lambda c: c * (c - 1) / 2
    entropy = lambda c: -F.sum(F.col("n") / F.col("total") * F.ln(F.col(c) / F.col("total")))
    sums = t.agg(
        F.sum(F.col("n") / F.col("total") * F.ln(F.col("total") * F.col("n") / (F.col("a") * F.col("b")))).alias("mi"),
        entropy("a").alias("hc"),
        entropy("b").alias("hk"),
        F.sum(pairs(F.col("n"))).alias("same"),
        F.sum(F.col("n") / F.col("a") * pairs(F.col("a"))).alias("pa"),
        F.sum(F.col("n") / F.col("b") * pairs(F.col("b"))).alias("pb"),
        F.max(pairs(F.col("total"))).alias("all"),
    )
    c = F.col
    chance, middle = c("pa") * c("pb") / c("all"), (c("pa") + c("pb")) / 2
    return sums.select(
        F.when(c("hc") * c("hk") > 0, c("mi") / F.sqrt(c("hc") * c("hk"))).otherwise(F.when((c("hc") == 0) & (c("hk") == 0), 1.0).otherwise(0.0)).alias("nmi"),
        F.when(c("hc") > 0, c("mi") / c("hc")).otherwise(F.lit(1.0)).alias("homogeneity"),
        F.when(middle != chance, (c("same") - chance) / (middle - chance)).otherwise(F.lit(1.0)).alias("ari"),
    )


def dataset_checks(series: DataFrame, by: str | None = None) -> DataFrame:
    """A row for the data set, or for each value of ``by``: n, classes, shortest, longest, status (ready, excluded, or failed where there are no series) and the reasons."""
    finite = all_finite(F.col("x"))
    grouped = series.groupBy(by) if by else series.groupBy()
    s = grouped.agg(F.count("*").alias("n"), F.countDistinct("label").alias("classes"), F.min(F.size("x")).alias("shortest"), F.max(F.size("x")).alias("longest"), F.count_if(~finite).alias("bad"))
    reason = F.concat_ws(
        "; ",
        F.when(F.col("shortest") != F.col("longest"), "unequal length"),
        F.when(F.coalesce("shortest", F.lit(0)) < 2, "series shorter than 2"),
        F.when(F.col("bad") > 0, "missing or non-finite values"),
        F.when(~((F.col("classes") > 1) & (F.col("classes") < F.col("n"))), "classes not 2 to n - 1"),
    )
    status = F.when(F.col("n") == 0, "failed").when(reason == "", "ready").otherwise("excluded")
    return s.select(*([by] if by else []), "n", "classes", "shortest", "longest", status.alias("status"), reason.alias("reason"))


def macro_means(results: DataFrame, keys: list[str], metric: str, repeats: int) -> DataFrame:
    """Mean over datasets of each dataset's mean over repeats; datasets count if all planned repeats are valid, and the mean is null where a value is missing.
    results: keys, dataset, repeat, valid, metric."""
    good = results.where("valid")
    per = good.groupBy(*keys, "dataset").agg(F.count("*").alias("k"), F.countDistinct("repeat").alias("r"), F.count(metric).alias("v"), F.avg(metric).alias("m"))
    full = per.where((F.col("k") == repeats) & (F.col("r") == repeats))
    return full.groupBy(*keys).agg(F.count("*").alias("datasets"), F.when(F.min("v") == repeats, F.avg("m")).alias("mean"))


def speedups(runs: DataFrame, repeats: int, slow: str, fast: str) -> DataFrame:
    """runs: source, n, length, repeat, engine, seconds, output. Both engines of a repeat have to give the same output; the ratio of the means is
    withheld unless all planned repeats match and agree."""
    key = ["source", "n", "length"]
    side = lambda e, c: F.max(F.when(F.col("engine") == e, F.col(c)))
    pairs = runs.groupBy(*key, "repeat").agg(side(fast, "seconds").alias("fast"), side(slow, "seconds").alias("slow"), side(fast, "output").alias("fo"), side(slow, "output").alias("so"))
    ok: Column = F.col("fo").isNotNull() & (F.col("fo") == F.col("so"))
    t = pairs.groupBy(*key).agg(F.count_if(ok).alias("matched"), F.countDistinct(F.when(ok, F.col("fo"))).alias("outputs"), F.avg(F.when(ok, F.col("fast"))).alias("f"), F.avg(F.when(ok, F.col("slow"))).alias("s"))
    status = F.when(F.col("outputs") > 1, "unstable").when(F.col("matched") == repeats, "complete").otherwise("incomplete")
    full = status == "complete"
    return t.select(*key, "matched", status.alias("status"), F.when(full, F.col("f")).alias("fast_mean"), F.when(full, F.col("s")).alias("slow_mean"), F.when(full & (F.col("f") > 0), F.col("s") / F.col("f")).alias("speedup"))


def valid_jobs(jobs: DataFrame, results: DataFrame, keys: list[str], metrics: list[str], needed: str | None = None, got: str | None = None) -> DataFrame:
    """The jobs that are complete, with their results where these may be used: a row that is there, with status ``ok``, finite metrics and, where ``needed`` names a job's column
    and ``got`` a result's, as many features as the job asks for. Every job stays (a left join); ``valid`` says whether its result counts, and metrics that don't are null."""
    mine = [F.col(k).alias(f"result_{k}") for k in keys]
    rest = [c for c in ("status", got, *metrics) if c]
    right = results.select(*mine, *(F.col(c).alias(f"result_{c}") for c in rest))
    joined = jobs.join(right, [F.col(k).eqNullSafe(F.col(f"result_{k}")) for k in keys], "left")
    finite = F.lit(True)
    for m in metrics:
        finite = finite & F.col(f"result_{m}").isNotNull() & ~F.isnan(f"result_{m}") & (F.abs(F.col(f"result_{m}")) < F.lit(float("inf")))
    ok = (F.col("status") == "complete") & (F.col("result_status") == "ok") & finite
    if needed and got:
        ok = ok & (F.col(needed) == F.col(f"result_{got}"))
    ok = F.coalesce(ok, F.lit(False))
    return joined.select(*jobs.columns, ok.alias("valid"), *(F.when(ok, F.col(f"result_{m}")).alias(m) for m in metrics))


def slices(results: DataFrame, dims: list[str], metric: str) -> DataFrame:
    """Every slice of valid results: by all dimensions, by each part of them, and over all (null: not cut by that one), with ``slice`` telling which; rows, datasets, mean and population deviation."""
    good = results.where("valid")
    grouped = good.cube(*dims).agg(
        F.grouping_id().cast("int").alias("slice"), F.count("*").alias("rows"), F.countDistinct("dataset").alias("datasets"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std")
    )
    return grouped.select("slice", *dims, "rows", "datasets", "mean", "std")


def reusable(targets: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """Each target with what a saved job says of it: ``reuse`` (one that matches in all keys, nulls included, with the same input and settings), ``changed`` (its input or settings differ),
    ``ambiguous`` (several match) or ``run`` (none does)."""
    right = saved.groupBy(*(F.col(k).alias(f"saved_{k}") for k in keys)).agg(F.count("*").alias("n"), F.min("fingerprint").alias("saved_fingerprint"), F.min("result").alias("result"))
    joined = targets.join(right, [F.col(k).eqNullSafe(F.col(f"saved_{k}")) for k in keys], "left")
    plan = F.when(F.col("n").isNull(), "run").when(F.col("n") > 1, "ambiguous").when(F.col("saved_fingerprint") == F.col("fingerprint"), "reuse").otherwise("changed")
    return joined.select(*targets.columns, plan.alias("plan"), F.when(plan == "reuse", F.col("result")).alias("result"))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the named columns as text, in that order; nulls are told apart from empty texts."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))
    return F.sha2(F.concat_ws("\x1f", *(part(c) for c in columns)), 256)


def prefix_conditions(sources: DataFrame, longest: int, percents: list[int]) -> DataFrame:
    """From source and n: a row for each prefix size that a study asks for, with the reason where it isn't run: longer than the source, shorter than the longest pattern, or the
    same size as for a smaller percentage. Sizes aren't raised to fit: that would be another design."""
    each = sources.select("source", "n", F.explode(F.array(*(F.lit(p) for p in sorted(set(percents))))).alias("percent"))
    size = F.floor(F.col("n") * F.col("percent") / 100).cast("long")
    sized = each.select("source", "percent", "n", size.alias("size"))
    again = F.row_number().over(Window.partitionBy("source", "size").orderBy("percent")) > 1
    reason = F.when(again, "duplicate prefix size after rounding").when(F.col("size") > F.col("n"), "n exceeds the source length").when(F.col("size") < longest, "n < L")
    return sized.withColumn("reason", reason).drop("n")


def grid(datasets: DataFrame, settings: Mapping[str, list]) -> DataFrame:
    """A row for each dataset and combination of settings, in one pass over the datasets."""
    out = datasets
    for name, values in settings.items():
        out = out.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return out
