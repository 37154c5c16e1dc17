"""A stream in several batches gives the windows that the whole series has."""

import datetime as dt

from tests.test_codes import brute_code
from treeglyph.streaming.counts import closed_windows


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    data = {0: [3.0, 1.0, 2.0, 2.0, 5.0, 4.0, 0.0, 7.0], 1: [1.0, 2.0, 3.0, 0.0, -0.0, 9.0, 4.0, 6.0]}
    rows = [(s, t0 + dt.timedelta(minutes=i), v) for s, x in data.items() for i, v in enumerate(x)]
    for part in range(2):
        own = [r for r in rows if (r[1] - t0).seconds // 60 // 4 == part]
        spark.createDataFrame(own, "series_id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = closed_windows(stream, [2, 3]).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["series_id"], r["ts"], r["length"], r["code"]) for r in spark.table("closed").collect())
    want = []
    for s, x in data.items():
        x = [v + 0.0 for v in x]
        for m in (2, 3):
            for p in range(len(x) - m + 1):
                if len(set(x[p : p + m])) == m:
                    want.append((s, t0 + dt.timedelta(minutes=p + m - 1), m, ",".join(map(str, brute_code(x[p : p + m])))))
    assert got == sorted(want)


def test_idle_series_are_forgotten(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    parts = [[(0, t0, 1.0), (0, t0 + dt.timedelta(minutes=1), 2.0)], [(1, t0 + dt.timedelta(days=10), 5.0)], [(1, t0 + dt.timedelta(days=10, minutes=1), 6.0)], [(0, t0 + dt.timedelta(days=10, minutes=2), 3.0), (1, t0 + dt.timedelta(days=10, minutes=2), 4.0)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "series_id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {}
    for idle in (None, "1 day"):
        stream = spark.readStream.schema("series_id long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        name = "idle" if idle else "patient"
        q = closed_windows(stream, [2], idle=idle).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got[name] = sorted((r["series_id"], r["ts"]) for r in spark.table(name).collect())
    both = [(0, t0 + dt.timedelta(minutes=1)), (1, t0 + dt.timedelta(days=10, minutes=1)), (1, t0 + dt.timedelta(days=10, minutes=2))]
    assert got["idle"] == both and got["patient"] == sorted([*both, (0, t0 + dt.timedelta(days=10, minutes=2))])
