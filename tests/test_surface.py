"""Sinks, SQL functions and the command line."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.test_codes import MIX, as_series, brute_counts
from treeglyph.__main__ import main
from treeglyph.functions.register import register
from treeglyph.operators import counts, select
from treeglyph.plans.mining import mine
from treeglyph.sources import series, sinks


def test_saved_results(spark, tmp_path):
    s = as_series(spark, MIX)
    m = mine(s, 6)
    sinks.save_mined(m, str(tmp_path), s)
    d = sinks.load_dictionary(spark, str(tmp_path))
    f = spark.read.parquet(str(tmp_path / "features"))
    sinks.verify_features(d, f)
    assert d.count() == 6 and f.count() == 6 * len(MIX)
    with pytest.raises(ValueError):
        sinks.verify_features(d, f.where("rank > 1"))
    d.withColumn("support", F.col("rank").cast("double")).write.parquet(str(tmp_path / "bad/dictionary"))
    with pytest.raises(ValueError):
        sinks.load_dictionary(spark, str(tmp_path / "bad"))


def test_text_sinks(spark, tmp_path):
    c = counts.series_counts(as_series(spark, MIX), [2, 3])
    sinks.write_counts_text(c, str(tmp_path / "c"))
    back = {(r["series_id"], r["code"]): r["cnt"] for r in sinks.read_counts_text(spark, str(tmp_path / "c")).collect()}
    assert back == {(s, code): float(n) for (s, _, code), n in brute_counts(MIX, [2, 3]).items()}
    (tmp_path / "x.txt").write_text("C\t1\t[0,a]\t2\n")
    with pytest.raises(Exception):  # noqa: B017
        sinks.read_counts_text(spark, str(tmp_path / "x.txt")).collect()
    sinks.dump_patterns(select.best(counts.corpus_support(c), 3), str(tmp_path / "p"))
    assert all(r["value"].startswith("P ") for r in spark.read.text(str(tmp_path / "p")).collect())
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2, 0.5)], "i int, d double")
    sinks.write_csv([a, b], str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["i", "s", "d"]
    for i in range(2):
        sinks.append_event(spark, str(tmp_path / "log"), {"i": i})
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert sinks.markdown(b) == "| i | d |\n| --- | --- |\n| 2 | 0.5000 |\n"
    assert sinks.tree_svg([0, 1, 0]).count("<circle") == 3 and sinks.tree_svg([0, 1, 0]).count("<line") == 2
    assert "polyline" in sinks.waveform_svg([1.0, 1.0])
    with pytest.raises(ValueError):
        sinks.tree_svg([0, 5])
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(5), limit=4)
    page = sinks.html_report("a < b", {"t": b}, {"tree": sinks.tree_svg([0, 1])})
    assert "a &lt; b" in page and "<td>0.5000</td>" in page and "<svg" in page
    with pytest.raises(ValueError):
        sinks.html_report("x", {"t": spark.range(5)}, limit=4)
    v = counts.bin_vectors(counts.series_counts(as_series(spark, MIX), [2, 3], bins=3), 3)
    sinks.write_vectors_text(v, str(tmp_path / "v"))
    back = {(r["series_id"], r["code"]): list(r["values"]) for r in sinks.read_vectors_text(spark, str(tmp_path / "v")).collect()}
    assert back == {(r["series_id"], r["code"]): list(r["values"]) for r in v.collect()} and all(sum(back[s, code]) == n for (s, _, code), n in brute_counts(MIX, [2, 3]).items())


def test_sql_functions(spark):
    register(spark, SF)
    assert spark.sql("select ct_distances(array(2d, 1d, 3d)) d, ct_limits(array(1d, 2d, 1d)) l, ct_tree(array(0, 0, 1)).root r").first() == ([999999999, 999999999, 1], [2, 2, 1], 1)
    as_series(spark, MIX).createOrReplaceTempView("mix")
    got = {(r["series_id"], r["length"], r["code"]): r["n"] for r in spark.sql("select series_id, length, code, count(*) n from mix, lateral ct_windows(x, 2, 4) group by all").collect()}
    assert got == brute_counts(MIX, [2, 3, 4])
    assert spark.table("series_orders").count() > 0 and spark.table("series_embeddings").columns[0] == "series_id"


def test_command_line(spark, tmp_path, capsys):
    as_series(spark, MIX).select("series_id", "x", (F.col("series_id") % 2).cast("string").alias("label")).write.parquet(str(tmp_path / "in"))
    main(["cluster", str(tmp_path / "in"), str(tmp_path / "out"), "--budget", "5"])
    assert "nmi" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "out/clusters")).count() == len(MIX)
    main(["explain", str(tmp_path / "in"), str(tmp_path / "out2"), "--lengths", "3", "4"])
    assert "Physical Plan" in capsys.readouterr().out


def test_subset(spark):
    s = as_series(spark, MIX)
    a, b = ({r["series_id"] for r in series.subset(s, 7, 3).collect()} for _ in range(2))
    assert a == b and len(a) == 7


def test_clustering_queries_take_ten_restarts(spark, monkeypatch):
    from tests.conftest import SF
    from treeglyph import queries
    from treeglyph.operators import cluster

    seeds, real = [], cluster.KMeans
    monkeypatch.setattr(cluster, "KMeans", lambda **k: seeds.append(k["seed"]) or real(**k))
    assert queries.raw_kmeans(spark, SF).count() > 0 and seeds == list(range(10))
    seeds.clear()
    assert queries.kmeans_clusters(spark, SF).count() > 0 and seeds == list(range(10))


def test_kmeans_runs_beside_each_other(spark, monkeypatch):
    """Several runs are under way at once, over few partitions, and the cheapest is what comes out."""
    import random
    import threading

    from treeglyph.operators import cluster

    real, together, parts, models = cluster.KMeans, threading.Barrier(2), [], []

    class Run:
        def __init__(self, **k):
            self.run = real(**k)

        def fit(self, v):
            parts.append(v.rdd.getNumPartitions())
            together.wait(60)
            models.append(self.run.fit(v))
            return models[-1]

    r = random.Random(4)
    points = [(i, [r.gauss(c, 1.0) for c in (i % 7, i % 5)]) for i in range(400)]
    table = spark.createDataFrame(points, "series_id long, features array<double>").repartition(23)
    monkeypatch.setattr(cluster, "KMeans", Run)
    got = cluster.kmeans(table, 6).collect()
    assert len(models) == 10 and parts == [1] * 10
    assert sorted((x["series_id"], x["features"]) for x in got) == points
    groups = [[x["features"] for x in got if x["cluster"] == c] for c in range(6)]
    cost = sum((x - sum(col) / len(col)) ** 2 for g in groups for col in zip(*g) for x in col)
    costs = [m.summary.trainingCost for m in models]
    assert len(set(costs)) > 1 and cost <= min(costs) * (1 + 1e-3)
    assert cluster.kmeans(table.withColumn("features", F.array(F.lit(1.0))), 2, restarts=10).count() == 400


def test_ranks_of_many_patterns(spark):
    from tests.test_codes import brute_mine

    c = counts.eligible(counts.corpus_support(counts.series_counts(as_series(spark, MIX), range(2, 7))))
    got = [(r["rank"], r["length"], r["code"], r["support"]) for r in select.ranked_wide(c.repartition(7)).orderBy("rank").collect()]
    assert got == [(i, *x) for i, x in enumerate(brute_mine(MIX, 0, 2, range(2, 7)), 1)]


def test_clusters_are_at_rest(spark):
    """Each series is in the cluster whose centre, the mean of its members, is the nearest; and no single run is cheaper than what is taken."""
    import numpy as np

    from treeglyph.operators import cluster

    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.3, (20, 4)) for c in (0, 2, 5)])
    table = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "series_id long, features array<double>")
    got = {row["series_id"]: row["cluster"] for row in cluster.kmeans(table, 3).collect()}
    labels = np.array([got[i] for i in range(len(x))])
    centres = np.array([x[labels == k].mean(0) for k in range(3)])
    assert (((x[:, None] - centres) ** 2).sum(2).argmin(1) == labels).all() and len({tuple(labels[a : a + 20]) for a in (0, 20, 40)}) == 3
    z = spark.createDataFrame([(i, rank + 1, float(v)) for i, row in enumerate(x) for rank, v in enumerate(row)], "series_id long, rank int, cnt double")
    p = np.array([row["features"] for row in cluster.components(z, 4).orderBy("series_id").collect()])
    gram = p.T @ p
    assert abs(gram - np.diag(np.diag(gram))).max() < 1e-8 and (np.diff(np.diag(gram)) <= 1e-9).all() and abs(np.trace(gram) - 4 * len(x)) < 1e-8


def test_results_are_made_once(spark, tmp_path):
    from treeglyph.plans.cache import cached, settings_key

    made = []
    make = lambda: made.append(1) or spark.range(3)
    for settings in ({"budget": 30, "minsup": 2.0}, {"minsup": 2.0, "budget": 30}, {"budget": 20, "minsup": 2.0}):
        assert cached(spark, str(tmp_path), settings, make).count() == 3
    assert len(made) == 2 and settings_key({"a": 1}) != settings_key({"a": "1"})
    with pytest.raises(ValueError):
        settings_key({"a": float("nan")})


def test_protocol_and_rounds(spark):
    from tests.test_codes import brute_mine
    from treeglyph.operators import cluster
    from treeglyph.plans import presets

    rows = [(i, [float(i // 10), float(i % 2) / 9], i // 10) for i in range(30)]
    t = spark.createDataFrame(rows, "series_id long, features array<double>, label int")
    assert [(r["seed"], r["nmi"]) for r in cluster.protocol(t, 3, (0, 1), 2).orderBy("seed").collect()] == [(0, 1.0), (1, 1.0)]
    with pytest.raises(ValueError):
        presets.conditions(t, "none")
    s = as_series(spark, MIX)
    whole, short = mine(s, 5, stop_early=False), mine(s, 5)
    assert [r["code"] for r in whole.dictionary.collect()] == [r["code"] for r in short.dictionary.collect()] == [c for _, c, _ in brute_mine(MIX, 5, 2, range(2, 30))]
    assert whole.stages.count() >= short.stages.count()
    assert {r["cutoff"] for r in short.stages.collect()} == {brute_mine(MIX, 5, 2, range(2, 30))[-1][2]}
    with pytest.raises(ValueError):
        mine(s, 0, 2, max_cells=40)


def test_long_lengths_and_hot_series(spark):
    """One series holds most of the values, and is in segments; another repeats long patterns."""
    import random

    from tests.test_codes import as_rows, brute_mine

    r = random.Random(5)
    data = {0: [r.random() for _ in range(600)], 1: [float(i % 12) + i // 12 / 100 for i in range(120)], **{i: [r.random() for _ in range(30)] for i in range(2, 6)}}
    want = brute_mine(data, 0, 2, range(2, 41))
    for segment in (50, 10_000):
        got = mine(series.gather(as_rows(spark, data), 40, segment), 0, 2, lengths=range(2, 41))
        assert [(x["length"], x["code"], x["support"]) for x in got.dictionary.orderBy("rank").collect()] == want
    with pytest.raises(ValueError):
        mine(series.gather(as_rows(spark, data), 40), 3, 2, cap=20)
