"""Writing results: tables with checks on reading, text counts, CSV and Markdown reports, event logs, and tree drawings."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from functools import reduce
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import code_array
from ..functions.kernels import decode_tree
from ..operators.select import order
from ..plans.mining import Mined


def save_mined(mined: Mined, path: str, series: DataFrame | None = None) -> None:
    """dictionary, stages and (for given series) features as Parquet, and why mining stopped as JSON."""
    mined.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
    mined.stages.write.mode("overwrite").parquet(f"{path}/stages")
    if series is not None:
        mined.features(series).write.mode("overwrite").parquet(f"{path}/features")
    spark = mined.dictionary.sparkSession
    spark.createDataFrame([(mined.reason,)], "reason string").write.mode("overwrite").json(f"{path}/run")


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The saved dictionary, or an error where ranks, lengths or the order aren't what they should be, or a code is there twice."""
    d = spark.read.parquet(f"{path}/dictionary")
    good = (F.size(code_array(F.col("code"))) == F.col("length")) & (F.col("support") >= 0)
    n = d.agg(F.count("*"), F.min("rank"), F.max("rank"), F.countDistinct("rank"), F.countDistinct("code"), F.count_if(~F.coalesce(good, F.lit(False)))).first()
    # each pattern against the one of the rank before it: no sort of the whole on one machine
    after = d.select((F.col("rank") + 1).alias("rank"), *(F.col(c).alias(f"p_{c}") for c in ("support", "length", "code")))
    place = lambda p: F.struct(-F.col(f"{p}support"), F.col(f"{p}length"), code_array(F.col(f"{p}code")))
    wrong = d.join(after, "rank").where(place("") <= place("p_")).limit(1).count()
    if n[0] and (tuple(n) != (n[0], 1, n[0], n[0], n[0], 0) or wrong):
        raise ValueError("the saved dictionary isn't in order")
    return d


def verify_features(dictionary: DataFrame, features: DataFrame) -> None:
    """Every pattern's support is the sum of its column."""
    sums = features.groupBy("rank").agg(F.sum("cnt").alias("total"))
    if dictionary.join(sums, "rank", "full").where(~F.col("support").eqNullSafe(F.col("total"))).limit(1).count():
        raise ValueError("features and dictionary disagree")


def write_counts_text(counts: DataFrame, path: str) -> None:
    """A line per series and code: C, series, [code], count by tabs."""
    line = F.concat_ws("\t", F.lit("C"), F.col("series_id").cast("string"), F.concat(F.lit("["), "code", F.lit("]")), F.col("cnt").cast("string"))
    counts.select(line.alias("value")).write.mode("overwrite").text(path)


def write_vectors_text(vectors: DataFrame, path: str) -> None:
    """A line per series and code with bins: V, series, [code] and the counts of all bins by comma, by tabs."""
    values = F.array_join(F.col("values").cast("array<string>"), ",")
    line = F.concat_ws("\t", F.lit("V"), F.col("series_id").cast("string"), F.concat(F.lit("["), "code", F.lit("]")), values)
    vectors.select(line.alias("value")).write.mode("overwrite").text(path)


def read_vectors_text(spark: SparkSession, path: str) -> DataFrame:
    """What write_vectors_text wrote; reading a line of another form fails."""
    parts = F.split("value", "\t")
    ok = F.col("value").rlike(r"^V\t-?[0-9]+\t\[[0-9]+(,[0-9]+)*\]\t[0-9.Ee+-]+(,[0-9.Ee+-]+)*$")
    text = F.when(ok, parts[2]).otherwise(F.raise_error(F.concat(F.lit("not a vector of counts: "), F.col("value"))))
    code = F.regexp_replace(F.substring(text, 2, 2**30), r"\]$", "")
    return spark.read.text(path).select(parts[1].cast("long").alias("series_id"), code.alias("code"), F.split(parts[3], ",").cast("array<double>").alias("values"))


def read_counts_text(spark: SparkSession, path: str) -> DataFrame:
    """What write_counts_text wrote; reading a line of another form fails."""
    parts = F.split("value", "\t")
    ok = F.col("value").rlike(r"^C\t-?[0-9]+\t\[[0-9]+(,[0-9]+)*\]\t[0-9.Ee+-]+$")
    text = F.when(ok, parts[2]).otherwise(F.raise_error(F.concat(F.lit("not a count: "), F.col("value"))))
    code = F.substring(text, 2, 2**30)
    return spark.read.text(path).select(parts[1].cast("long").alias("series_id"), F.regexp_replace(code, r"\]$", "").alias("code"), parts[3].cast("double").alias("cnt"))


def dump_patterns(support: DataFrame, path: str) -> None:
    """P, support and the code's numbers, by spaces, one pattern a line, best first."""
    line = F.concat_ws(" ", F.lit("P"), F.col("support").cast("long").cast("string"), F.replace("code", F.lit(","), F.lit(" ")))
    support.orderBy(*order()).select(line.alias("value")).write.mode("overwrite").text(path)


def write_csv(frames: Iterable[DataFrame], path: str) -> None:
    """Tables below each other; columns that a table lacks are empty."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).write.mode("overwrite").option("header", True).csv(path)


def append_event(spark: SparkSession, path: str, event: Mapping[str, object]) -> None:
    """One JSON line more in an event log."""
    spark.createDataFrame([(json.dumps(event, sort_keys=True),)], "value string").write.mode("append").text(path)


def cell(value: object) -> str:
    return "—" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value).replace("|", "/").replace("\n", " ")


def markdown(table: DataFrame, limit: int = 200) -> str:
    """A report's table. For aggregates: more than ``limit`` rows are an error, not a shorter table."""
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for a report")
    lines = ["| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def html_report(title: str, tables: Mapping[str, DataFrame], drawings: Mapping[str, str] | None = None, limit: int = 200) -> str:
    """A page with tables and drawings (SVG, by caption). More than ``limit`` rows of a table are an error."""
    parts = [f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for name, table in tables.items():
        rows = table.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"more than {limit} rows for a report")
        line = lambda tag, values: "<tr>" + "".join(f"<{tag}>{escape(v)}</{tag}>" for v in values) + "</tr>"
        parts.append(f"<h2>{escape(name)}</h2><table>{line('th', table.columns)}{''.join(line('td', map(cell, r)) for r in rows)}</table>")
    parts += [f"<figure>{svg}<figcaption>{escape(caption)}</figcaption></figure>" for caption, svg in (drawings or {}).items()]
    return "\n".join(parts) + "\n"


def tree_svg(code: list[int], step: int = 24) -> str:
    """A code's min-Cartesian tree: elements from left to right, the root on top."""
    tree = decode_tree(code)
    if tree is None:
        raise ValueError("not a code")
    _, parents, depth = tree
    at = [(step * (i + 1), step * (d + 1)) for i, d in enumerate(depth)]
    edges = "".join(f'<line x1="{at[p][0]}" y1="{at[p][1]}" x2="{x}" y2="{y}" stroke="black"/>' for (x, y), p in zip(at, parents, strict=True) if p >= 0)
    nodes = "".join(f'<circle cx="{x}" cy="{y}" r="{step // 5}"/>' for x, y in at)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{step * (len(code) + 1)}" height="{step * (max(depth) + 2)}">{edges}{nodes}</svg>'


def waveform_svg(values: list[float], width: int = 160, height: int = 48) -> str:
    lo, hi = min(values), max(values)
    x = lambda i: width * i / max(1, len(values) - 1)
    y = lambda v: height - height * (v - lo) / ((hi - lo) or 1)
    points = " ".join(f"{x(i):.1f},{y(v):.1f}" for i, v in enumerate(values))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><polyline fill="none" stroke="black" points="{points}"/></svg>'
