"""Connected components of a graph in tables: hooking to the smallest neighbour and pointer jumping. No link or label comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, shared_table


def components(edges: DataFrame) -> DataFrame:
    """id and comp (the smallest id reachable) of every node of edges (a, b). A node's links are summed up on the map side, so hubs are no hot keys."""
    edges = shared_table(compact(edges.where("a <> b").distinct()), "edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        low = F.least("a", "b").alias("p")
        parent = edges.select(F.col("a").alias("v"), low).union(edges.select(F.col("b").alias("v"), low)).groupBy("v").agg(F.min("p").alias("p"))
        parent = shared_table(compact(parent), "parents")
        parent = _roots(parent)
        levels.append(parent)
        of = lambda side: parent.select(F.col("v").alias(side), F.col("p").alias(f"p{side}"))  # noqa: E731, B023
        edges = edges.join(of("a"), "a").join(of("b"), "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        edges = shared_table(compact(edges), "edges")
    if not levels:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    out = levels[-1]
    for lower in reversed(levels[:-1]):  # roots of a level are nodes of the next
        up = out.select(F.col("v").alias("p"), F.col("p").alias("q"))
        out = lower.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
    return out.select(F.col("v").alias("id"), F.col("p").alias("comp"))


def _roots(parent: DataFrame) -> DataFrame:
    """Every parent is a node with a parent of its own, not larger; follow them until nothing changes."""
    while True:
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
        jumped = parent.join(up, "p").select("v", F.col("q").alias("p"), (F.col("q") < F.col("p")).alias("moved"))
        jumped = shared_table(compact(jumped), "parents")
        parent = jumped.select("v", "p")
        if jumped.where("moved").isEmpty():
            return parent
