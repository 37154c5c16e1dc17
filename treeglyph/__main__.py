"""python -m treeglyph mine|features|cluster|explain SOURCE OUT: SOURCE is a Parquet table of series_id, x array<double> (and label)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import cluster, features, metrics
from .operators.counts import corpus_support, series_counts
from .plans.mining import mine, rounds, wanted_lengths
from .sources import series, sinks


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="treeglyph", description=__doc__)
    p.add_argument("task", choices=("mine", "features", "cluster", "explain"))
    p.add_argument("source")
    p.add_argument("out")
    p.add_argument("--budget", type=int, default=30, help="0: all that qualify")
    p.add_argument("--minsup", type=float, default=2.0)
    p.add_argument("--lengths", type=int, nargs="*", default=None)
    p.add_argument("--ties", choices=("strict", "native"), default="strict")
    p.add_argument("--quantize", action="store_true", help="values to nine digits first")
    p.add_argument("--seed", type=int, default=0)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    table = spark.read.parquet(a.source)
    label = "label" if "label" in table.columns else None
    data = series.checked(series.whole(table, label_col=label))
    data = series.quantized(data) if a.quantize else data
    if a.task == "explain":
        planned = rounds(wanted_lengths(data, a.budget, a.lengths))
        print("rounds of lengths, as far as they are needed:", ", ".join(f"{r[0]} to {r[-1]}" for r in planned) or "none")
        if planned:
            corpus_support(series_counts(data, planned[0], a.ties), a.minsup).explain("formatted")
        return
    found = mine(data, a.budget, a.minsup, a.lengths, ties=a.ties)
    sinks.save_mined(found, a.out, None if a.task == "mine" else data)
    if a.task == "cluster":
        if not label:
            raise SystemExit("clusters are held against labels; there are none")
        cells = features.matrix(data, found.dictionary, found.counts)
        z = features.vectors(features.scaled(cells).drop("cnt").withColumnRenamed("z", "cnt"))
        out = cluster.kmeans(z, table.select("label").distinct().count(), a.seed)
        out.write.mode("overwrite").parquet(f"{a.out}/clusters")
        print(sinks.markdown(metrics.cluster_metrics(out)))


if __name__ == "__main__":
    main()
