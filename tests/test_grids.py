"""Whole parameter grids against single runs of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from burstloom.operators import cluster, evaluation, events, grid
from burstloom.plans import catalog


def _random(spark, seed=3):
    rng = random.Random(seed)
    edges = [(w, a, b, round(rng.uniform(-0.2, 1), 1)) for w in (1, 2) for a in range(1, 17) for b in range(a + 1, 18) if rng.random() < 0.35]
    nodes = [(w, n, f"s{n}") for w in (1, 2, 3) for n in range(1, 17)]  # node 17 is in edges only, window 3 has no edges
    return spark.createDataFrame(nodes, "window_id int, node long, seg_text string"), spark.createDataFrame(edges, "window_id int, a long, b long, w double")


def test_all_pairs_equal_single_runs(spark):
    nodes, edges = _random(spark)
    got = {(r["window_id"], r["k"], r["k_min"]): r["silhouette"] for r in cluster.cluster_grid(nodes, edges, cluster.range_grid(nodes, 2, 12)).collect()}
    assert len(got) == 3 * sum(range(1, 11))
    for k, k_min in ((2, 1), (4, 2), (5, 1), (7, 3), (11, 10)):
        labels = cluster.noise_clusters(cluster.jarvis_patrick(nodes, edges, k, k_min))
        for r in cluster.silhouette(labels, edges).collect():
            assert got[r["window_id"], k, k_min] == pytest.approx(r["silhouette"], abs=1e-9)


def test_sweep_equals_the_single_steps(spark):
    nodes, edges = _random(spark, 5)
    rng = random.Random(6)
    mu = nodes.select("seg_text").distinct().withColumn("mu", F.length("seg_text") * F.lit(0.3))
    segs = spark.createDataFrame([(w, p, f"s{rng.randint(1, 16)}") for w in (1, 2) for p in range(10 * w, 10 * w + 6) for _ in range(2)], "window_id int, post_id long, seg_text string").distinct()
    gold = spark.createDataFrame([(w, 100 + p, p, [rng.randint(1, 3)]) for w in (1, 2) for p in range(10 * w, 10 * w + 6)], "window_id int, gold_id long, post_id long, classes array<int>")
    held = segs.join(gold, ["window_id", "post_id"]).join(nodes, ["window_id", "seg_text"]).select("window_id", "node", "gold_id")
    classes = gold.select("window_id", "gold_id", F.posexplode("classes").alias("pos", "label"))
    scored = nodes.join(mu, "seg_text")
    got = {(r["window_id"], r["k"], r["k_min"]): r for r in grid.sweep_metrics(scored, edges, cluster.range_grid(nodes, 2, 8), held, classes).collect()}
    several = False
    for k, k_min in ((3, 1), (4, 1), (5, 2)):
        c = cluster.cluster_fixed(nodes, edges, k, k_min).join(nodes, ["window_id", "node"])
        kept = events.realistic_events(events.event_news(c, edges, mu), 5.0).select("window_id", "cluster")
        c = c.join(kept, ["window_id", "cluster"]).cache()
        ids = events.post_event_ids(events.related_posts(c, segs), events.event_order(c))
        samples = gold.join(ids, ["window_id", "post_id"], "left").withColumn("events", F.coalesce("events", F.array(F.lit(0)))).cache()
        for w in (1, 2):
            r, own = got[w, k, k_min], c.where(F.col("window_id") == w)
            labels = [x["cluster"] for x in own.collect()]
            assert r["events"] == len(set(labels))
            if len(set(labels)) > 1:
                several = True
                inner = edges.join(own.select("window_id", F.col("node").alias("a")), ["window_id", "a"]).join(own.select("window_id", F.col("node").alias("b")), ["window_id", "b"])
                assert r["silhouette"] == pytest.approx(cluster.silhouette(own.select("window_id", "node", "cluster"), inner.select("window_id", "a", "b", "w")).first()["silhouette"])
            one = samples.where(F.col("window_id") == w)
            single = one.where(F.size("events") == 1)
            if single.count() == one.count():  # several labels are resolved in the order of samples
                assert r["cluster_entropy"] == pytest.approx(evaluation.total_entropy(one, "events", "classes").first()[0])
                assert r["class_entropy"] == pytest.approx(evaluation.total_entropy(one, "classes", "events").first()[0])
    assert several
    assert all(r["f"] is None for (w, _, _), r in got.items() if w == 3)


def test_sweep_query_has_every_pair(spark, data):
    df = catalog.queries()["param_sweep"](spark, data).cache()
    assert {"silhouette", "class_entropy", "cluster_entropy", "f"} <= set(df.columns)
    assert {r["n"] for r in df.groupBy("window_id").agg(F.countDistinct("k", "k_min").alias("n")).collect()} == {5610}


def test_range_query_has_every_pair_and_the_best(spark, data):
    df = catalog.queries()["cluster_grid_range"](spark, data).cache()
    assert {r["n"] for r in df.groupBy("window_id").agg(F.countDistinct("k", "k_min").alias("n")).collect()} == {1170}
    assert df.where("k = 15 and k_min = 6").count() == df.select("window_id").distinct().count()
    best = {r["window_id"]: r["silhouette"] for r in catalog.queries()["cluster_grid_range_best"](spark, data).collect()}
    assert best == {r["window_id"]: r["m"] for r in df.groupBy("window_id").agg(F.max("silhouette").alias("m")).collect()}


def test_auto_query_has_every_window(spark):
    nodes = spark.createDataFrame([(w, n) for w, many in ((1, 4), (2, 14), (3, 30)) for n in range(many)], "window_id int, node long")
    edges = spark.createDataFrame([(3, a, b, 1.0 if a // 10 == b // 10 else 0.1) for a in range(30) for b in range(a + 1, 30)], "window_id int, a long, b long, w double")
    best = cluster.best_or_initial(cluster.cluster_grid(nodes, edges, cluster.auto_grid(nodes)), cluster.auto_initial(nodes))
    got = {r["window_id"]: (r["k"], r["k_min"], r["silhouette"]) for r in best.collect()}
    assert got[1] == (1, 0, -1.0) and got[2] == (3, 1, -1.0)
    assert set(got) == {1, 2, 3}


def test_auto_query_on_tables(spark, data):
    windows = {r[0] for r in catalog.queries()["knn"](spark, data).select("window_id").distinct().collect()}
    assert windows <= {r["window_id"] for r in catalog.queries()["cluster_grid_auto"](spark, data).collect()}
