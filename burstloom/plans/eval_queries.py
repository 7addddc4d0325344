"""Queries of evaluation and random walk, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from burstloom.operators import cluster, evaluation, events, grid, walk
from burstloom.operators.ngram import kb_from_posts
from burstloom.operators.packed import packed_labels
from burstloom.session import materialise
from burstloom.sources.readers import table
from burstloom.sources.views import POSTS_SQL, SEGMENTS_SQL, edges, nodes, posts, segments

GAMMA, ROUNDS = 0.85, 500
#: the walk ends before ROUNDS when no share moves by more in a step, far under the last digit returned
STILL = 1e-13


def _held(s, d):
    return segments(s, d).select(F.col("seg_text").alias("node"), "post_id")


def _edges(s, d):
    return materialise(walk.jaccard_edges(_held(s, d)))


def _kb(s, d):
    return kb_from_posts(segments(s, d), posts(s, d)).select(F.col("seg_text").alias("node"), F.col("anchor_q").alias("q"))


def _graph(s, d):
    e = walk.mirror(_edges(s, d))
    return _held(s, d).select("node").distinct().join(e.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.round(F.sum("w"), 5).alias("strength")), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def _pi(s, d):
    return walk.walk_shares(_held(s, d), _kb(s, d), GAMMA, ROUNDS, STILL)


def _step(s, d):
    jump = materialise(walk.teleport(_held(s, d), _kb(s, d)))
    n = jump.count()
    return walk.walk_step(jump.select("node", F.lit(1.0 / max(n, 1)).alias("pi")), walk.transition_prob(_edges(s, d)), jump, GAMMA)


def _labels(s, d):
    """(gold_id, sample, field, pos, value): every label of both gold fields, with digits of all scripts as ASCII ones."""
    g = table(s, d, "gldn_std")
    value = F.translate("value", "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
    return packed_labels(g, "gold_id", ["gold_class", "gold_cluster"]).withColumn("value", value).join(g.select("gold_id", "sample"), "gold_id")


def _packed(s, d):
    """(gold_id, classes, clusters): all labels of the gold rows with both fields filled; a label repeated in a field counts once."""
    of = lambda f: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("pos", "value")))), lambda x: x["value"]))
    rows = _labels(s, d).groupBy("gold_id").agg(of("gold_class").alias("classes"), of("gold_cluster").alias("clusters"))
    return materialise(rows.where("size(classes) > 0 and size(clusters) > 0"))


def _sweep(s, d):
    """Every pair k in [50, 118), k_min in [1, k): silhouette of the events kept under 5 and entropies of their post labels and the gold classes."""
    n, e, segs = nodes(s, d), edges(s, d), segments(s, d)
    classes = _labels(s, d).where("field = 'gold_class'").join(posts(s, d).select(F.col("post_id").alias("sample"), "window_id"), "sample")
    classes = materialise(classes.select("window_id", "sample", "gold_id", "pos", F.xxhash64("value").alias("label")))
    mu = events.segment_news(n, kb_from_posts(segs, posts(s, d)).select("seg_text", F.col("anchor_q").alias("q")))
    rated = classes.select("window_id", "gold_id", F.col("sample").alias("post_id")).distinct()
    held = segs.join(rated, ["window_id", "post_id"]).join(n, ["window_id", "seg_text"]).select("window_id", "node", "gold_id").distinct()
    scored = n.join(mu, "seg_text", "left").select("window_id", "node", F.coalesce("mu", F.lit(0.0)).alias("mu"))
    metrics = grid.sweep_metrics(scored, e, cluster.range_grid(n, 50, 118), held, classes, 5.0)
    return _r(metrics, silhouette=6, class_entropy=6, cluster_entropy=6, f=6)


def _r(df, **digits):
    return df.withColumns({c: F.round(c, k) for c, k in digits.items()})


QUERIES = {
    "entropy": lambda s, d: _r(evaluation.entropy(_packed(s, d), "clusters", "classes", "gold_id"), h=6).select("group", "h", "n"),
    "entropy_verbose": lambda s, d: _r(evaluation.entropy(_packed(s, d), "clusters", "classes", "gold_id"), h=6),
    "entropy_verbose_classes": lambda s, d: _r(evaluation.entropy(_packed(s, d), "classes", "clusters", "gold_id"), h=6),
    "cluster_class_entropy": lambda s, d: _r(evaluation.multi_entropies(_packed(s, d), "clusters", "classes", "gold_id"), cluster_entropy=6, class_entropy=6).drop("f"),
    "entropy_f": lambda s, d: _r(evaluation.multi_entropies(_packed(s, d), "clusters", "classes", "gold_id"), f=6).select("f"),
    "param_sweep": _sweep,
    "jaccard_edges": lambda s, d: _r(_edges(s, d), w=6),
    "entity_graph": _graph,
    "transition_prob": lambda s, d: _r(walk.transition_prob(_edges(s, d)), p=6),
    "teleport": lambda s, d: _r(walk.teleport(_held(s, d), _kb(s, d)), e=10),
    "walk_matrix": lambda s, d: _r(_step(s, d), pi=9),
    "power_iteration": lambda s, d: _r(_pi(s, d), pi=9),
    "mean_abs_dev": lambda s, d: segments(s, d).groupBy("window_id").agg(F.round(F.avg(F.abs(F.col("stickiness"))), 6).alias("mad")),
    "attach_names": lambda s, d: _r(_pi(s, d), pi=9).join(nodes(s, d).select(F.col("seg_text").alias("node"), F.col("node").alias("node_id"), "window_id"), "node").select("window_id", "node_id", "pi"),
    "select_best": lambda s, d: walk.select_best(_r(_pi(s, d), pi=9), 50),
}

def _walk(rounds: int) -> str:
    out = f"""WITH {POSTS_SQL}, {SEGMENTS_SQL}, held AS (SELECT DISTINCT seg_text AS node, post_id FROM segs), sizes AS (SELECT node, count(*) AS n FROM held GROUP BY node),
common AS (SELECT x.node AS a, y.node AS b, count(*) AS c FROM held x JOIN held y ON x.post_id = y.post_id AND x.node < y.node GROUP BY ALL),
je AS MATERIALIZED (SELECT a, b, c / (x.n + y.n - c) AS w FROM common JOIN sizes x ON x.node = a JOIN sizes y ON y.node = b), m AS (SELECT a, b, w FROM je UNION ALL SELECT b, a, w FROM je),
tp AS MATERIALIZED (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS p FROM m WHERE w > 0), grown AS (SELECT node, exp(n::DOUBLE / (SELECT count(*) FROM posts)) AS x FROM sizes), jump AS MATERIALIZED (SELECT node, x / (SELECT sum(x) FROM grown) AS e FROM grown),
pi0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM jump) AS pi FROM jump)"""
    for i in range(rounds):
        out += f", q{i} AS MATERIALIZED (SELECT b AS node, sum(pi * p) AS s FROM pi{i} JOIN tp ON a = node GROUP BY b), pi{i + 1} AS MATERIALIZED (SELECT jump.node, {GAMMA} * coalesce(s, 0.0) + (1 - {GAMMA}) * e * (SELECT sum(pi) FROM pi{i}) AS pi FROM jump LEFT JOIN q{i} USING (node))"
    return out


SQL = {
    "jaccard_edges": _walk(0) + " SELECT a, b, round(w, 6) AS w FROM je",
    "entity_graph": _walk(0) + ", g AS (SELECT a AS node, count(*) AS degree, round(sum(w), 5) AS strength FROM m GROUP BY a) SELECT node, coalesce(degree, 0) AS degree, coalesce(strength, 0.0::DOUBLE) AS strength FROM sizes LEFT JOIN g USING (node)",
    "transition_prob": _walk(0) + " SELECT a, b, round(p, 6) AS p FROM tp",
    "teleport": _walk(0) + " SELECT node, round(e, 10) AS e FROM jump",
    "walk_matrix": _walk(1) + " SELECT node, round(pi, 9) AS pi FROM pi1",
    "mean_abs_dev": f"WITH {SEGMENTS_SQL} SELECT window_id, round(avg(abs(stickiness)), 6) AS mad FROM segs GROUP BY window_id",
}
