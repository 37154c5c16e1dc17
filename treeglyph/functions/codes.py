"""Column functions over series and pattern codes. A code is array<int>: for each element the distance to its parent, 0 for none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parent distance of an element without an earlier one that isn't larger.
INF = 999_999_999


def plain_zero(x: Column) -> Column:
    """An array with -0.0 as 0.0: array functions tell them apart, comparisons don't."""
    return F.transform(x, lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v))


def all_finite(x: Column) -> Column:
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def parent_distance(x: Column) -> Column:
    """For each element the distance to the nearest earlier one that isn't larger, else INF. JVM only; quadratic in the length."""

    def at(v: Column, i: Column) -> Column:
        near = F.array_max(F.transform(F.slice(x, F.lit(1), i), lambda u, k: F.when(u <= v, k)))
        return F.coalesce(i - near, F.lit(INF)).cast("int")

    return F.transform(x, at)


def window_code(distances: Column, start: Column, length: Column) -> Column:
    """The code of a window from the series' parent distances: those that lead out of the window become 0."""
    return F.transform(F.slice(distances, start + 1, length), lambda p, j: F.when(p <= j, p).otherwise(F.lit(0)))


def scratch_code(window: Column) -> Column:
    """The code of a window from its values alone."""
    return F.transform(parent_distance(window), lambda p: F.when(p == INF, F.lit(0)).otherwise(p))


def code_text(code: Column) -> Column:
    return F.array_join(code.cast("array<string>"), ",")


def code_array(text: Column) -> Column:
    return F.split(text, ",").cast("array<int>")


def is_monotone(code: Column) -> Column:
    """Falling (all 0) or rising (0, then 1s)."""
    return F.forall(code, lambda c: c == 0) | ((code[0] == 0) & F.forall(F.slice(code, F.lit(2), F.greatest(F.size(code) - 1, F.lit(0))), lambda c: c == 1))


def pattern_id(text: Column) -> Column:
    """``ct_`` and 20 hex digits of the SHA-256 of the code as JSON."""
    return F.concat(F.lit("ct_"), F.substring(F.sha2(F.concat(F.lit("["), F.replace(text, F.lit(","), F.lit(", ")), F.lit("]")), 256), 1, 20))


def ordinal_ranks(window: Column) -> Column:
    return F.transform(window, lambda v: F.size(F.filter(window, lambda u: u <= v)))


def position_bin(start: Column, n: Column, length: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor(start * bins / (n - length + 1))).cast("int")


def decay_weight(start: Column, n: Column, length: Column, decay: float) -> Column:
    return F.exp(-F.lit(float(decay)) * (n - start - length) / n)
