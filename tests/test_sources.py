"""Readers, generators, prefixes, and small operators that the catalogue doesn't reach."""

import pytest
from pyspark.sql import functions as F

from treeglyph.functions import codes
from treeglyph.operators import cluster, features, metrics, select
from treeglyph.sources import series as src


def test_text_and_ts_and_dictionary(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2\n\n 3.25\t-0.0\n")
    assert src.read_text(spark, str(tmp_path / "a.txt")).first()["x"] == [1.0, 2.0, 3.25, 0.0]
    (tmp_path / "b.txt").write_text("0.1 16777217")
    assert src.read_text(spark, str(tmp_path / "b.txt"), single=True).first()["x"] == [pytest.approx(0.1, abs=1e-8), 16777216.0]
    (tmp_path / "c.ts").write_text("@problemName x\n# note\n@data\n1,2,3:a\n4,?,6:b\n")
    rows = src.read_ts(spark, str(tmp_path / "c.ts")).orderBy("label").collect()
    assert [r["label"] for r in rows] == ["a", "b"] and rows[0]["x"] == [1.0, 2.0, 3.0] and rows[1]["x"][1] != rows[1]["x"][1]
    (tmp_path / "d.csv").write_text("0, 1\n\n0,0,1\n")
    assert sorted(r["code"] for r in src.read_dictionary(spark, str(tmp_path / "d.csv")).collect()) == ["0,0,1", "0,1"]
    import hashlib

    assert src.file_checksums(spark, str(tmp_path / "a.txt")).first()["sha256"] == hashlib.sha256((tmp_path / "a.txt").read_bytes()).hexdigest()


def test_generators(spark):
    for family in ("monotone", "random", "periodic"):
        for r in src.synthetic(spark, family, 2, 70).collect():
            assert len(set(r["x"])) == 70
    shape = src.synthetic(spark, "periodic", 1, 64).first()["x"]
    rank = lambda w: sorted(range(32), key=lambda i: w[i])
    assert rank(shape[:32]) == rank(shape[32:])
    with pytest.raises(ValueError):
        src.synthetic(spark, "other", 1, 4)


def test_prefixes_excerpt_and_quantizing(spark):
    s = src.whole(spark.createDataFrame([(i, [float(v) for v in range(i + 1)]) for i in range(9)], "series_id long, x array<double>"))
    assert [len(r["x"]) for r in src.prefixes(s, 50).orderBy("series_id").collect()] == [1, 2, 2, 2, 2, 3, 3, 4, 4]
    assert [len(r["x"]) for r in src.prefixes(s, 50, clamp=False).orderBy("series_id").collect()] == [0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert [r["series_id"] for r in src.excerpt(s, 3, 2).orderBy("series_id").collect()] == [0, 4, 8]
    q = src.quantized(src.whole(spark.createDataFrame([(0, [0.1234567885, 2.5])], "series_id long, x array<double>"))).first()["x"]
    assert q == [float(format(0.1234567885, ".9g")), 2.5]


def test_rank_order_is_numeric(spark):
    rows = [("0,10", 2, 5.0), ("0,2", 2, 5.0), ("0,1,1", 3, 5.0), ("0,0", 2, 7.0)]
    got = select.ranked(spark.createDataFrame(rows, "code string, length int, support double")).orderBy("rank").collect()
    assert [r["code"] for r in got] == ["0,0", "0,2", "0,10", "0,1,1"]
    df = spark.createDataFrame(rows, "code string, length int, support double")
    for bad in ({"mode": "none"}, {"mode": "global"}, {"mode": "grouped", "budget": 3, "groups": {2: 0}, "group_budgets": {0: 4}}):
        with pytest.raises(ValueError):
            select.choose(df, **bad)


def test_cluster_metrics_extremes(spark):
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(12)], "label int, cluster int")
    assert [round(v, 9) for v in metrics.cluster_metrics(same).first()] == [1.0, 1.0, 1.0]
    one = spark.createDataFrame([(i % 3, 0) for i in range(12)], "label int, cluster int")
    assert [round(v, 9) for v in metrics.cluster_metrics(one).first()] == [0.0, 0.0, 0.0]


def test_dataset_reasons(spark):
    s = src.whole(spark.createDataFrame([(0, [1.0], "a"), (1, [1.0, float("nan")], "a")], "series_id long, x array<double>, label string"), label_col="label")
    r = metrics.dataset_checks(s).first()
    assert r["status"] == "excluded" and r["reason"] == "unequal length; series shorter than 2; missing or non-finite values; classes not 2 to n - 1"


def test_statuses_and_pattern_id(spark):
    assert [cluster.feature_status(d, 3) for d in (0, 2, 3)] == ["no_features", "insufficient_features", "ok"]
    import hashlib
    import json

    want = "ct_" + hashlib.sha256(json.dumps([0, 1, 0]).encode()).hexdigest()[:20]
    assert spark.range(1).select(codes.pattern_id(F.lit("0,1,0")).alias("i")).first()["i"] == want


def test_empty_dictionary_gives_no_features(spark):
    s = src.whole(spark.createDataFrame([(0, [1.0, 2.0])], "series_id long, x array<double>"))
    none = spark.createDataFrame([], "rank int, code string, length int")
    assert features.matrix(s, none, spark.createDataFrame([], "series_id long, code string, cnt double")).count() == 0


def test_mining_past_the_overlap_of_segments(spark):
    import pytest

    from treeglyph.operators.counts import series_counts
    from treeglyph.plans.mining import mine
    from treeglyph.sources.series import gather, whole

    rows = spark.createDataFrame([(1, i, float(i), 90) for i in range(90)] + [(2, i, float(-i), 25) for i in range(25)], "series_id long, pos long, value double, n long")
    cut = gather(rows, 8, 32)
    got = {(r["length"], r["code"]): r["support"] for r in mine(cut, 0, 2.0).dictionary.collect()}
    up = {(m, ",".join(["0"] + ["1"] * (m - 1))): 91 - m for m in range(2, 90)}
    down = {(m, ",".join(["0"] * m)): 26 - m for m in range(2, 25)}
    assert got == up | down
    with pytest.raises(Exception, match="pass the end of a segment"):
        series_counts(cut, [9]).collect()
    assert series_counts(cut, [8]).agg({"cnt": "sum"}).first()[0] == 83 + 18
    assert series_counts(whole(spark.createDataFrame([(1, [1.0, 2.0])], "series_id long, x array<double>")), [2, 9]).count() == 1


def test_fingerprints_and_ranges(spark):
    import hashlib

    import numpy as np
    import pytest

    from tests.test_codes import MIX, as_series
    from treeglyph.sources import series as src

    s = as_series(spark, MIX)
    saved = src.fingerprints(s)
    got = {r["series_id"]: r["sha256"] for r in saved.collect()}
    want = {i: hashlib.sha256((hashlib.sha256(np.array(x, "<f8").tobytes()).hexdigest() + "\x1f").encode()).hexdigest() for i, x in MIX.items()}
    assert got == want and src.verified(s, saved).count() == len(MIX)
    for other in (s.where("series_id > 0"), as_series(spark, {**MIX, 3: [1.0, 2.0]})):
        with pytest.raises(ValueError):
            src.verified(other, saved)


def test_archives_that_are_others_fail(spark, tmp_path):
    import pytest

    from treeglyph.sources import series as src

    (tmp_path / "a_TRAIN.ts").write_text("# x\n@univariate true\n@data\n1,2,?:a\n")
    (tmp_path / "a_TEST.ts").write_text("@univariate true\n@data\n\n3,4,5 : b\n")
    both = src.read_ts(spark, str(tmp_path / "a_TRAIN.ts"), str(tmp_path / "a_TEST.ts")).collect()
    assert sorted((r["label"], len(r["x"])) for r in both) == [("a", 3), ("b", 3)]
    for i, text in enumerate(("@univariate false\n1,2:a\n", "@classLabel false\n1,2:a\n", "1,2\n", "1,2:\n", "1:2:a\n")):
        (tmp_path / f"bad{i}.ts").write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            src.read_ts(spark, str(tmp_path / f"bad{i}.ts")).collect()
