"""Clustering of feature vectors with pyspark.ml: principal components, k-means with restarts, and statuses of feature sets."""

from __future__ import annotations

from collections.abc import Iterable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut
from .features import scaled, vectors
from .metrics import cluster_metrics

#: Bytes of vectors in a partition that k-means goes over, and runs of k-means beside each other.
PART, ABREAST = 4 << 20, 4


def components(cells: DataFrame, k: int) -> DataFrame:
    """series_id (and label) and ``features``: the first components of scaled columns; PCA doesn't centre, so scaling comes before."""
    z = vectors(scaled(cells).drop("cnt").withColumnRenamed("z", "cnt"))
    v = z.withColumn("v", array_to_vector("features")).drop("features")
    model = PCA(k=k, inputCol="v", outputCol="p").fit(v)
    return model.transform(v).withColumn("features", vector_to_array("p")).drop("v", "p")


def kmeans(table: DataFrame, k: int, seed: int = 0, restarts: int = 10, rounds: int = 300) -> DataFrame:
    """With ``cluster``: the cheapest of several runs with seeds of their own. Each round of a run is a Spark job, and on small tables jobs, tasks and lineage cost more than what is
    computed: so some runs go on beside each other, over a checkpoint of the table, in as few partitions as its size asks for."""
    held = cut(table)
    size = held.agg(F.sum(F.size("features").cast("long") * 8)).first()[0] or 0
    v = held.select(array_to_vector("features").alias("v")).coalesce(max(1, -(-size // PART))).persist()
    runs = [KMeans(k=k, seed=seed * 1000 + i, maxIter=rounds, tol=1e-4, featuresCol="v", predictionCol="cluster") for i in range(restarts)]
    with ThreadPool(ABREAST) as pool:
        models = pool.map(inheritable_thread_target(table.sparkSession)(lambda run: run.fit(v)), runs, chunksize=1)
    best = min(models, key=lambda m: m.summary.trainingCost)
    v.unpersist()
    return best.transform(held.withColumn("v", array_to_vector("features"))).drop("v")


def protocol(table: DataFrame, k: int, seeds: Iterable[int] = range(5), restarts: int = 10) -> DataFrame:
    """From series_id, label and features: a row for each seed with nmi, homogeneity and ari of the cheapest clustering of several runs."""
    out: DataFrame | None = None
    for seed in seeds:
        one = cluster_metrics(kmeans(table, k, seed, restarts)).withColumn("seed", F.lit(seed))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no seeds")
    return out


def feature_status(dim: int, needed: int) -> str:
    return "no_features" if dim == 0 else "insufficient_features" if dim < needed else "ok"


def feature_status_of(dim: Column, needed: Column) -> Column:
    """The same of columns."""
    return F.when(dim == 0, "no_features").when(dim < needed, "insufficient_features").otherwise("ok")


def raw_vectors(series: DataFrame) -> DataFrame:
    """The values of equally long series as features."""
    return series.select("series_id", *(["label"] if "label" in series.columns else []), F.col("x").alias("features"))
