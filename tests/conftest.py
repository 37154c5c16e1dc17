import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")]).rstrip(os.pathsep)
os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")

import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def against_sql():
    """Compare a DataFrame with DuckDB's answer, as sets of rows with columns by name."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")

    def plain(v):
        if pd.isna(v):
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    def compare(df, sql):
        mine = df.toPandas()
        theirs = con.sql(sql).df()
        names = sorted(mine.columns)
        assert names == sorted(theirs.columns)
        rows = lambda t: sorted(tuple(plain(v.item() if hasattr(v, "item") else v) for v in r) for r in t[names].itertuples(index=False))
        assert rows(mine) == rows(theirs)

    return compare
