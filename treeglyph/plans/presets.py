"""Named studies: which settings they go through."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.metrics import grid

# The settings of the published studies.
STUDIES: dict[str, dict[str, list]] = {
    "topk": {"budget": [10, 20, 30, 40, 50], "minsup": [2.0], "percent": [100]},
    "threshold": {"budget": [0], "minsup": [5.0, 10.0, 25.0], "percent": [100]},
    "input_length": {"budget": [30], "minsup": [2.0], "percent": [20, 40, 60, 80, 100]},
}
SEEDS = [0, 1, 2, 3, 4]


def conditions(datasets: DataFrame, study: str, seeds: list[int] | None = None) -> DataFrame:
    """A row for each data set, setting and seed of a study."""
    if study not in STUDIES:
        raise ValueError(f"a study is one of {', '.join(STUDIES)}")
    return grid(datasets, {**STUDIES[study], "seed": SEEDS if seeds is None else seeds})
