"""Results by what they were made from: a table is made once for each fingerprint of its settings, and read again from then on."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


def settings_key(settings: Mapping[str, object]) -> str:
    """SHA-256 of the settings in one order; inputs go in by their fingerprints."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, settings: Mapping[str, object], make: Callable[[], DataFrame]) -> DataFrame:
    """The table under ``folder`` that was made with these settings, made now if there is none that was written to its end."""
    path = f"{folder.rstrip('/')}/{settings_key(settings)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
