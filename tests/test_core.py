"""Worked values of single operators."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from burstloom.functions import text as T
from burstloom.operators import burst, cluster, evaluation, events, ngram, segmentation, walk
from burstloom.operators.similarity import tfidf_cosine_half, tfidf_cosine_sk


def _value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_scp_and_pmi(spark):
    grams = spark.createDataFrame([("a", 100.0), ("b", 50.0), ("a b", 20.0)], "seg_text string, cnt double")
    texts = spark.createDataFrame([("a b",), ("a",), ("c d",)], "seg_text string")
    parts = ngram.split_products(texts, grams, "cnt")
    args = (F.col("f"), F.col("n"), F.col("products"))
    got = {r[0]: (r[1], r[2]) for r in parts.select("seg_text", ngram.scp_simple(*args), ngram.pmi_simple(*args)).collect()}
    assert got["a b"][0] == pytest.approx(0.148148, abs=1e-6)
    assert got["a"][0] == pytest.approx(2.01596e-12, rel=1e-4)
    assert got["c d"] == (2.0, 1.0)
    assert got["a b"][1] == pytest.approx(0.9999974900517, abs=1e-10)
    score = {r[0]: r[1] for r in ngram.stickiness(texts, grams, None).collect()}
    assert score["a b"] == pytest.approx(0.074074, abs=1e-6)


def test_exact_forms(spark):
    args = (F.lit(0.02), F.lit(2), F.lit(0.005))
    assert _value(spark, ngram.pmi_exact(*args)) == pytest.approx(0.888889, abs=1e-6)
    assert _value(spark, ngram.scp_exact(*args)) == pytest.approx(0.148148, abs=1e-6)


def _brute(tokens, score):
    best = None
    for cuts in itertools.product([0, 1], repeat=max(len(tokens) - 1, 0)):
        segs, cur = [], [tokens[0]]
        for c, t in zip(cuts, tokens[1:], strict=True):
            if c:
                segs.append(cur)
                cur = [t]
            else:
                cur.append(t)
        segs.append(cur)
        if all(len(s) <= 5 for s in segs):
            total = sum(score.get(" ".join(s), 0.0) for s in segs)
            best = total if best is None else max(best, total)
    return best


def test_segment_posts_against_brute_force(spark):
    rng = random.Random(3)
    posts = [(i, [rng.choice("abc") for _ in range(rng.randrange(0, 8))]) for i in range(12)]
    spans = {" ".join(t[i:j]) for _, t in posts for i in range(len(t)) for j in range(i + 1, min(i + 5, len(t)) + 1)}
    score = {s: rng.random() * len(s.split()) for s in spans}
    df = spark.createDataFrame(posts, "post_id long, tokens array<string>")
    scores = spark.createDataFrame(list(score.items()), "seg_text string, score double")
    got = {r["post_id"]: r["segs"] for r in segmentation.segment_posts(df, scores).collect()}
    for i, tokens in posts:
        assert " ".join(got[i]).split() == tokens
        if tokens:
            assert sum(score[s] for s in got[i]) == pytest.approx(_brute(tokens, score))


def test_segment_tie_keeps_the_whole(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], "post_id long, tokens array<string>")
    scores = spark.createDataFrame([("a", 0.3), ("b", 0.3), ("a b", 0.6)], "seg_text string, score double")
    assert segmentation.segment_posts(df, scores).first()["segs"] == ["a b"]


def test_burst_weight(spark):
    posts = spark.createDataFrame([(1, 1, 10), (2, 1, 11), (3, 2, 12), (4, 2, 13)], "post_id long, window_id int, user_id long")
    segs = spark.createDataFrame([(1, 0, "s", 1), (2, 0, "s", 1)], "post_id long, pos int, seg_text string, window_id int")
    r = burst.burst_weight(burst.burst_test(burst.burst_stats(segs, posts))).first()
    assert (r["ps"], r["est"], r["fst"]) == (0.5, 1.0, 2)
    assert r["weight"] == pytest.approx(0.682306, abs=1e-6)
    everywhere = spark.createDataFrame([(i, 0, "s", 1) for i in range(1, 5)], "post_id long, pos int, seg_text string, window_id int")
    assert burst.burst_test(burst.burst_stats(everywhere, posts)).count() == 0


def test_cosines(spark):
    rows = [(1, 1, "x", "aa", 1), (1, 1, "x", "bb", 1), (1, 1, "y", "aa", 1), (1, 1, "y", "cc", 1)]
    terms = spark.createDataFrame(rows, "window_id int, sub_id int, seg_text string, term string, tf long")
    assert tfidf_cosine_half(terms).first()["cos"] == pytest.approx(0.2)
    assert tfidf_cosine_sk(terms).first()["cos"] == pytest.approx(0.336097, abs=1e-6)


def test_jarvis_patrick(spark):
    edges = spark.createDataFrame([(1, 1, 2, 0.9), (1, 1, 3, 0.8), (1, 2, 3, 0.7), (1, 1, 4, 0.1)], "window_id int, a long, b long, w double")
    nodes = spark.createDataFrame([(1, i) for i in range(1, 5)], "window_id int, node long")
    got = {r["node"]: r["cluster"] for r in cluster.jarvis_patrick(nodes, edges, 2, 1).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r["node"] for r in cluster.noise_clusters(cluster.jarvis_patrick(nodes, edges, 2, 1)).where("cluster = -1").collect()} == {4}
    with pytest.raises(ValueError):
        cluster.jarvis_patrick(nodes, edges, 1, 2)


def test_event_news_and_choice(spark):
    clusters = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b")], "window_id int, cluster long, node long, seg_text string")
    edges = spark.createDataFrame([(1, 1, 2, 0.9)], "window_id int, a long, b long, w double")
    news = spark.createDataFrame([("a", 0.2), ("b", 0.4)], "seg_text string, mu double")
    assert events.event_news(clusters, edges, news).first()["mu_e"] == pytest.approx(0.27)
    scored = spark.createDataFrame([(1, 1, 10.0), (1, 2, 1.0), (1, 3, 0.0)], "window_id int, cluster long, mu_e double")
    assert [r["cluster"] for r in events.realistic_events(scored, 15.0).orderBy("cluster").collect()] == [1, 2]
    assert [r["cluster"] for r in events.realistic_events(scored, 10.0).collect()] == [1]
    tied = spark.createDataFrame([(1, i, v) for i, v in enumerate([3.0, 1.0, 1.0, 2.0])], "window_id int, cluster long, mu_e double")
    assert sorted(r["cluster"] for r in events.realistic_topk(tied, 15.0, 3).collect()) == [0, 2, 3]


def test_related_posts(spark):
    clusters = spark.createDataFrame([(1, 1, 1, "x"), (1, 1, 2, "y")], "window_id int, cluster long, node long, seg_text string")
    segs = spark.createDataFrame([(1, 1, "y"), (1, 2, "x"), (1, 2, "y"), (1, 3, "x")], "window_id int, post_id long, seg_text string")
    got = events.related_posts(clusters, segs).orderBy("first_member", "post_id").collect()
    assert [r["post_id"] for r in got] == [2, 3, 1]


def test_entropy():
    assert evaluation.group_entropy([([1, 2], 1.0), ([2], 1.0), ([1], 1.0)])[0] == pytest.approx(3 * 0.918296, abs=1e-5)
    assert evaluation.group_entropy([]) == (0.0, "")


def test_entropy_of_single_labels(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "cluster int, klass int")
    r = evaluation.cluster_class_entropy(df, "cluster", "klass").first()
    assert tuple(r) == pytest.approx((2 / 3, 2 / 3, 2 / 3))


def test_jaccard(spark):
    held = spark.createDataFrame([("ab", 1), ("ab", 2), ("c", 1), ("c", 3)], "node string, post_id long")
    assert walk.jaccard_edges(held).first()["w"] == pytest.approx(1 / 3)


def test_walk_keeps_its_mass(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "a string, b string, w double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    kb = spark.createDataFrame([("a", 0.5)], "node string, q double")
    pi = walk.power_iteration(walk.transition_prob(edges), walk.teleport(nodes, kb), rounds=8).collect()
    assert sum(r["pi"] for r in pi) == pytest.approx(1.0)
    assert max(pi, key=lambda r: r["pi"])["node"] == "b"


def test_noise_filter(spark):
    cases = {"ABC 12": "", "abc": "abc", "## tag": "", "سلام خخخ": "", "ههه خوب": "", "هههخوب": "هههخوب", "WORDorEXP": "", "a WORDorEXP": "a WORDorEXP", "۱۲ - ~": "", None: None}
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    assert {r[0]: r[1] for r in df.select("s", T.noise_free(F.col("s"))).collect()} == cases


def test_letters_and_patterns(spark, tmp_path):
    df = spark.createDataFrame([("كتابۀ مُؤمن ٣ ڤ",)], "s string")
    assert df.select(T.normalize_text(F.col("s"))).first()[0] == "کتابه مومن ۳ ف"
    (tmp_path / "words.txt").write_text("\\bكتاب\\b|از", encoding="utf-8")
    (tmp_path / "marks.txt").write_text("[!؟]", encoding="utf-8")
    words, marks = (T.read_pattern(str(tmp_path / f"{n}.txt")) for n in ("words", "marks"))
    assert spark.createDataFrame([("از خانه!",)], "s string").select(T.remove_patterns(F.col("s"), words, marks)).first()[0] == " خانه "
    assert words == "\\bکتاب\\b|از"


def test_walk_against_plain_matrices(spark):
    import numpy as np

    rng = random.Random(2)
    names = [f"n{i}" for i in range(9)]
    q = {n: rng.random() for n in names}
    jump = walk.teleport(spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame(list(q.items()), "node string, q double"))
    e = np.exp([q[n] for n in names])
    # a node without edges loses its share, so only a whole graph comes to rest
    for rounds, tolerance, last in ((2, 0.0, 8), (500, 1e-3, 9)):
        edges = [(a, b, rng.random()) for a, b in itertools.combinations(names[:last], 2)]
        moves = walk.transition_prob(spark.createDataFrame(edges, "a string, b string, w double"))
        w = np.zeros((9, 9))
        for a, b, x in edges:
            w[names.index(a), names.index(b)] = w[names.index(b), names.index(a)] = x
        sums = w.sum(1, keepdims=True)
        p = np.divide(w, sums, out=np.zeros_like(w), where=sums > 0)
        whole = 0.4 * p.T + 0.6 * np.outer(e / e.sum(), np.ones(9))
        want = np.full(9, 1 / 9)
        for _ in range(rounds):
            want = whole @ want
        got = {r["node"]: r["pi"] for r in walk.power_iteration(moves, jump, 0.4, rounds, tolerance).collect()}
        assert max(abs(got[n] - x) for n, x in zip(names, want, strict=True)) < (1e-3 if tolerance else 1e-11)


def test_silhouette_matches_all_pairs(spark):
    w = {(1, 2): 0.9, (1, 3): 0.1, (2, 3): 0.2, (3, 4): 0.8}
    label = {1: 1, 2: 1, 3: 3, 4: 3}
    top = max(w.values())
    d = lambda x, y: top - w.get((min(x, y), max(x, y)), 0.0)
    values = []
    for x in label:
        a = [d(x, y) for y in label if y != x and label[y] == label[x]]
        b = [d(x, y) for y in label if label[y] != label[x]]
        a, b = sum(a) / len(a), sum(b) / len(b)
        values.append((b - a) / max(a, b))
    edges = spark.createDataFrame([(1, x, y, v) for (x, y), v in w.items()], "window_id int, a long, b long, w double")
    labels = spark.createDataFrame([(1, n, c) for n, c in label.items()], "window_id int, node long, cluster long")
    assert cluster.silhouette(labels, edges).first()["silhouette"] == pytest.approx(sum(values) / 4)
    assert math.isclose(cluster.silhouette(labels.where("cluster = 1"), edges).first()["silhouette"], -1.0)


def test_grid_equals_single_runs(spark):
    rng = random.Random(8)
    edges = spark.createDataFrame([(w, a, b, rng.random()) for w in (1, 2) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.5], "window_id int, a long, b long, w double")
    nodes = spark.createDataFrame([(w, n) for w in (1, 2) for n in range(12)], "window_id int, node long")
    grid = cluster.range_grid(nodes, 3, 6, 2)
    got = {(r["window_id"], r["k"], r["k_min"]): r["silhouette"] for r in cluster.cluster_grid(nodes, edges, grid).collect()}
    assert {k[1:] for k in got} == {(3, 1), (5, 1), (5, 3)}
    for k, k_min in ((3, 1), (5, 3)):
        labels = cluster.noise_clusters(cluster.jarvis_patrick(nodes, edges, k, k_min))
        for r in cluster.silhouette(labels, edges).collect():
            assert got[r["window_id"], k, k_min] == pytest.approx(r["silhouette"])
