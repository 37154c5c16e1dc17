"""Series as tables: series_id, x array<double>, shift, n, own (and label, where there is one).

A row is a whole series, or a segment of one: ``shift`` is the position of x[0] in the whole series, ``n`` that series' length, and windows that start in the first
``own`` values belong to the row; the values after those are there for windows to end in. A window's code depends on its values only, so segments give
the same counts, and no task has to hold a long series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import all_finite, plain_zero
from ..functions.kernels import quantize_9g, values_sha256

SEGMENT = 65_536


def whole(df: DataFrame, id_col: str = "series_id", x_col: str = "x", label_col: str | None = None) -> DataFrame:
    """From a table with one array per series."""
    x = F.col(x_col).cast("array<double>")
    n = F.size(F.col(x_col)).cast("long")
    label = [F.col(label_col).alias("label")] if label_col else []
    return df.select(F.col(id_col).alias("series_id"), plain_zero(x).alias("x"), F.lit(0).cast("long").alias("shift"), n.alias("n"), n.alias("own"), *label)


def numbered(df: DataFrame, id_col: str, order: list[str], value_col: str) -> DataFrame:
    """series_id, pos (from 0), value, n: long form."""
    keys = [f"order_{i}" for i in range(len(order))]
    rows = df.select(F.col(id_col).alias("series_id"), *(F.col(c).alias(k) for c, k in zip(order, keys, strict=True)), F.col(value_col).cast("double").alias("value"))
    by = Window.partitionBy("series_id")
    value = F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.col("value"))
    return rows.select("series_id", (F.row_number().over(by.orderBy(*keys)) - 1).cast("long").alias("pos"), value.alias("value"), F.count("*").over(by).alias("n"))


def gather(rows: DataFrame, longest: int, segment: int = SEGMENT) -> DataFrame:
    """From long form. Each value goes to its segment, and to those before in which a window of the longest length may reach it. Rows that ``numbered``
    gives are dealt by series already and aren't shuffled again."""
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("pos") - (longest - 1)) / segment))
    placed = rows.withColumn("seg", F.explode(F.sequence(first, F.floor(F.col("pos") / segment))))
    item = F.struct("pos", "value")
    got = placed.groupBy("series_id", "seg", "n").agg(F.array_sort(F.collect_list(item)).alias("items"))
    shift = (F.col("seg") * segment).cast("long")
    return got.select("series_id", F.transform("items", lambda t: t["value"]).alias("x"), shift.alias("shift"), "n", F.least(F.lit(segment), F.col("n") - shift).cast("long").alias("own"))


#: Over series: the longest length whose windows are whole in every segment; null where no segment ends before its series does.
LONGEST_WHOLE = "min(case when shift + size(x) < n then size(x) - own + 1 end)"


def regather(series: DataFrame, longest: int, segment: int = SEGMENT) -> DataFrame:
    """Segments made anew, for windows of a longer length."""
    each = series.select("series_id", "shift", "n", F.posexplode(F.slice("x", F.lit(1), F.col("own").cast("int"))).alias("at", "value"))
    return gather(each.select("series_id", (F.col("shift") + F.col("at")).alias("pos"), "value", "n"), longest, segment)


def from_rows(df: DataFrame, id_col: str, order: list[str], value_col: str, longest: int = 32, segment: int = SEGMENT) -> DataFrame:
    return gather(numbered(df, id_col, order, value_col), longest, segment)


def checked(series: DataFrame) -> DataFrame:
    """The same, but reading it fails where a series is empty or has values that aren't finite."""
    ok = (F.col("n") > 0) & all_finite(F.col("x"))
    return series.withColumn("x", F.when(ok, F.col("x")).otherwise(F.raise_error(F.lit("a series is empty or not finite"))))


def prefixes(series: DataFrame, percent: int, clamp: bool = True) -> DataFrame:
    """The first percent of each series: at least two values if ``clamp``, else as many as the floor gives. For whole series."""
    keep = F.floor(F.col("n") * percent / 100)
    keep = (F.greatest(F.lit(2), keep) if clamp else keep).cast("int")
    out = series.withColumn("x", F.slice("x", F.lit(1), keep))
    n = F.size("x").cast("long")
    return out.withColumn("n", n).withColumn("own", n)


def quantized(series: DataFrame) -> DataFrame:
    """Values to nine significant digits, as before mining external data."""
    return series.withColumn("x", quantize_9g("x"))


def parse_numbers(text: Column, single: bool = False) -> Column:
    """White-space separated numbers as an array; single: through 32-bit floats."""
    tokens = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda t: t != "")
    return F.transform(tokens, lambda t: (t.cast("float") if single else t).cast("double"))


def read_text(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """A series per file of white-space separated numbers; single: through 32-bit floats. series_id is the file's name."""
    lines = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("series_id"))
    return whole(lines.select("series_id", parse_numbers(F.col("value"), single).alias("x")))


def parse_ts(lines: DataFrame) -> DataFrame:
    """From series_id and line of a ``.ts`` archive of univariate labelled series: series. Lines that begin with @ or # are its header, empty ones nothing; others are values by
    comma, then a colon and the label. A header that says the archive isn't such a one, or a line of another form, is an error."""
    line = F.trim("line")
    data = lines.withColumn("line", line)
    head, parts = F.col("line").rlike("^([@#]|$)"), F.split("line", ":")
    other = F.lower("line").rlike(r"^@(univariate\s+false|equallength\s+false|timestamps\s+true|classlabel\s+false)")
    good = (F.size(parts) == 2) & (F.trim(parts[1]) != "")
    wrong = lambda what: F.raise_error(F.concat(F.lit(what), F.substring("line", 1, 80)))
    # what is asked of a line holds for every line, as Spark may ask before it leaves out the header
    values = F.when(other, wrong("not a univariate, equally long, labelled archive: ")).when(head, F.lit(None)).when(good, parts[0]).otherwise(wrong("not values and a label: "))
    data = data.withColumn("values", values).where("values is not null")
    values = F.col("values")
    x = F.transform(F.split(values, ","), lambda t: F.when(F.trim(t) == "?", F.lit(float("nan"))).otherwise(F.trim(t).cast("double")))
    return whole(data.select("series_id", x.alias("x"), F.trim(parts[1]).alias("label")), label_col="label")


def read_ts(spark: SparkSession, *paths: str) -> DataFrame:
    """``.ts`` archives, TRAIN and TEST for example, as one table. series_id is file and line order."""
    lines = spark.read.text(list(paths)).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("series_id"))
    return parse_ts(lines)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A code per line, as integers by comma."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.regexp_replace("value", r"\s", "").alias("code"))


def train_and_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both as one table, with ``part``; ids that both have are told apart by it."""
    parts = (train.withColumn("part", F.lit("train")), test.withColumn("part", F.lit("test")))
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def fingerprints(series: DataFrame) -> DataFrame:
    """series_id and the SHA-256 of each series' (or segment's) values and label."""
    label = F.coalesce(F.col("label").cast("string"), F.lit("")) if "label" in series.columns else F.lit("")
    return series.select("series_id", "shift", F.sha2(F.concat_ws("\x1f", values_sha256("x"), label), 256).alias("sha256"))


def verified(series: DataFrame, prepared: DataFrame) -> DataFrame:
    """The series, or an error where they aren't those whose fingerprints were saved when they were prepared."""
    key = ["series_id", "shift", "sha256"]
    now, then = fingerprints(series).select(*key), prepared.select(*key)
    if now.exceptAll(then).limit(1).count() or then.exceptAll(now).limit(1).count():
        raise ValueError("the prepared series have changed")
    return series


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def synthetic(spark: SparkSession, family: str, samples: int, n: int, seed: int = 0, period: int = 32) -> DataFrame:
    """``monotone`` (0 to n - 1), ``random`` (a permutation), or ``periodic`` (one shape again and again, all values distinct)."""
    ids = spark.range(samples).withColumnRenamed("id", "series_id")
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    if family == "monotone":
        x: Column = steps.cast("array<double>")
    elif family == "random":
        mixed = lambda i: F.md5(F.concat_ws(":", i.cast("string"), F.col("series_id").cast("string"), F.lit(str(seed))).cast("binary"))
        x = F.transform(F.array_sort(F.transform(steps, lambda i: F.struct(mixed(i).alias("h"), i.alias("i")))), lambda t: t["i"].cast("double"))
    elif family == "periodic":
        p = min(period, n)
        blocks = -(-n // p)
        shape = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.struct(((i * 7 + seed) % 1009).alias("h"), i.alias("i")))), lambda t: t["i"])
        x = F.transform(steps, lambda i: (F.element_at(shape, (i % p + 1).cast("int")) * blocks + F.floor(i / p)).cast("double"))
    else:
        raise ValueError(f"no such family: {family}")
    return whole(ids.withColumn("x", x))


def excerpt(series: DataFrame, count: int, points: int) -> DataFrame:
    """Evenly spaced series, from the first to the last in the order of their ids (places between two are those before), and the first points of each. Ids are ranked by ranges of them: each
    task ranks its own, and the numbers of ids in the ranges before come from the driver."""
    ids = series.select("series_id").repartitionByRange("series_id").sortWithinPartitions("series_id").withColumn("part", F.spark_partition_id())
    held = ids.groupBy("part").count().collect()
    total = sum(r["count"] for r in held)
    if not total:
        return series
    n = min(count, total)
    wanted = sorted({i * (total - 1) // max(1, n - 1) for i in range(n)})
    before, places = 0, []
    for r in sorted(held, key=lambda r: r["part"]):
        places += [(r["part"], k - before + 1) for k in wanted if before <= k < before + r["count"]]
        before += r["count"]
    chosen = series.sparkSession.createDataFrame(places, "part int, r int")
    place = F.row_number().over(Window.partitionBy("part").orderBy("series_id"))
    kept = ids.withColumn("r", place).join(F.broadcast(chosen), ["part", "r"]).select("series_id")
    out = series.join(kept, "series_id", "left_semi").withColumn("x", F.slice("x", F.lit(1), F.lit(points)))
    size = F.size("x").cast("long")
    return out.withColumn("n", size).withColumn("own", size)


def subset(series: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """A seeded sample of so many series, without replacement, by the order of MD5 sums; in the order of ids."""
    mixed = F.md5(F.concat_ws(":", F.col("series_id").cast("string"), F.lit(str(seed))).cast("binary"))
    return series.orderBy(mixed, "series_id").limit(count).orderBy("series_id")


#: The driver tables as series: table, id, order, value.
VIEWS: dict[str, tuple[str, str, list[str], str]] = {
    "events": ("events", "user_id", ["ts", "event_id"], "value"),
    "orders": ("orders", "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice"),
    "suppliers": ("lineitem", "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_extendedprice"),
}


def view_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, id_col, order, value = VIEWS[name]
    return numbered(spark.read.parquet(f"{sf_dir}/{table}.parquet"), id_col, order, value)


def view(spark: SparkSession, sf_dir: str, name: str, longest: int = 32) -> DataFrame:
    if name == "embeddings":
        return whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    return gather(view_rows(spark, sf_dir, name), longest)
