"""Everything under names that ``spark.sql`` can call."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.series import VIEWS, view
from . import kernels


def register(spark: SparkSession, sf_dir: str | None = None) -> None:
    """ct_distances(x), ct_limits(x), ct_quantize(x), ct_tree(code), the table function ct_windows(x, shortest, longest), and views series_* of the driver tables."""
    spark.udf.register("ct_distances", kernels.parent_distance_linear)
    spark.udf.register("ct_limits", kernels.linear_limits_udf)
    spark.udf.register("ct_quantize", kernels.quantize_9g)
    spark.udf.register("ct_tree", kernels.tree_of)
    spark.udtf.register("ct_windows", F.udtf(Windows, returnType="st int, length int, code string"))
    for name in (*VIEWS, "embeddings") if sf_dir else ():
        view(spark, sf_dir, name).createOrReplaceTempView(f"series_{name}")


class Windows:
    """A row for each window of distinct values of a series."""

    def eval(self, x: list[float], shortest: int, longest: int) -> Iterator[tuple[int, int, str]]:
        values = np.asarray(x, np.float64) + 0.0
        ends = np.array([0, len(values)])
        dist, distinct = kernels.distances_of(ends, values), kernels.distinct_of(ends, values).tolist()
        for st, room in enumerate(distinct):
            most = min(room, longest)
            step = dist[st : st + most]
            code = list(map(str, np.where(step <= np.arange(most), step, 0).tolist()))
            for m in range(shortest, most + 1):
                yield st, m, ",".join(code[:m])
