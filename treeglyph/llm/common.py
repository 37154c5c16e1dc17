"""What the operators of this subpackage share: table access, Arrow row loops, shared-folder tables."""

from __future__ import annotations

import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: The bytes that separate words and that line keys are stripped of.
SPACE = b" \t\n\r\x0b\x0c"
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES, _LIMIT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A temporary one stands in for it on a local master only."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    own = spark.conf.get("treeglyph.local.shared.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        own = "file://" + tempfile.mkdtemp(prefix="treeglyph-")
        spark.conf.set("treeglyph.local.shared.dir", own)
    return own


class _Made(threading.local):
    """Paths of the shared tables of a driver's thread, in the order in which they were made: queries in other threads have their own."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_made = _Made()


def compact(df: DataFrame, by: int = 8, deal: bool = False) -> DataFrame:
    """The same rows in an eighth of the shuffle's partitions, though not in fewer than there are cores: for tables that hold a small part of what
    was shuffled, so that they don't become as many small files. ``deal``: by a small shuffle of their own, so that the stage that makes them keeps its tasks."""
    spark = df.sparkSession
    now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(spark.sparkContext.defaultParallelism, now // by)
    return df if n >= now else df.repartition(n) if deal else df.coalesce(n)


def sized_like(df: DataFrame, source: DataFrame, part: int = 16 << 20) -> DataFrame:
    """The same rows, in no more partitions than one for each 16 MB of ``source`` by Catalyst's estimate and two for each core: results of joins don't become as many small
    files as the shuffle has partitions."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // part))
    return df.coalesce(n) if n < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/treeglyph-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["shared_path"] = path
    return out


def tables_so_far() -> int:
    return len(_made.paths)


def drop_since(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the shared tables that this thread made since then, but for those that ``keep`` are."""
    kept = {vars(df).get("shared_path") for df in keep}
    for path in _made.paths[since:]:
        if path not in kept:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _made.paths[since:] = [p for p in _made.paths[since:] if p in kept]


def unused(name: str, df: DataFrame) -> str:
    """A column name like that one which the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches of at most BATCH_BYTES: what a worker holds follows from that and not from the number of rows. The session's limit is
    lowered where it is higher, and stays so, as plans run after they are returned."""
    spark = df.sparkSession
    if not 0 < _bytes_of(spark.conf.get(_LIMIT)) <= BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def _bytes_of(size: str) -> int:
    """A size as Spark writes it (4194304, 4m, 64MB ...) in bytes."""
    m = re.fullmatch(r"(-?\d+)\s*([kmgt]?)i?b?", size.strip().lower())
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]] if m else 0


def utf8_values(col: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    elif pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    return col.to_pylist()
