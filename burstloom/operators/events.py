"""Newsworthiness of clusters, choice and titles of events, and the posts that belong to them.

Inputs: ``clusters`` (window_id, cluster, node, seg_text), ``edges`` (window_id, a, b, w) and ``kb`` (seg_text, q).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segment_news(texts: DataFrame, kb: DataFrame) -> DataFrame:
    """(seg_text, mu): the largest e^q - 1 over the words of a segment, at least -1 + 0."""
    words = texts.select("seg_text").distinct().select("seg_text", F.explode(F.split("seg_text", " ")).alias("word"))
    q = words.join(kb.select(F.col("seg_text").alias("word"), "q"), "word", "left")
    return q.groupBy("seg_text").agg((F.greatest(F.lit(0.0), F.max(F.exp(F.coalesce("q", F.lit(0.0))))) - 1).alias("mu"))


def event_news(clusters: DataFrame, edges: DataFrame, news: DataFrame) -> DataFrame:
    """(window_id, cluster, n, mu_e): mean segment news times the weight of the cluster's ordered pairs per member."""
    scored = clusters.join(news, "seg_text", "left").groupBy("window_id", "cluster").agg(F.count("*").alias("n"), F.sum(F.coalesce("mu", F.lit(0.0))).alias("mu"))
    ca = clusters.select("window_id", F.col("node").alias("a"), "cluster")
    cb = clusters.select("window_id", F.col("node").alias("b"), F.col("cluster").alias("cluster_b"))
    inner = edges.join(ca, ["window_id", "a"]).join(cb, ["window_id", "b"]).where("cluster = cluster_b").groupBy("window_id", "cluster").agg((2 * F.sum("w")).alias("weight"))
    joined = scored.join(inner, ["window_id", "cluster"], "left")
    return joined.select("window_id", "cluster", "n", ((F.col("mu") / F.col("n")) * (F.coalesce("weight", F.lit(0.0)) / F.col("n"))).alias("mu_e"))


def window_max_news(scored: DataFrame) -> DataFrame:
    return scored.groupBy("window_id").agg(F.max("mu_e").alias("mu_x"))


def realistic_events(scored: DataFrame, limit: float, strict: bool = True) -> DataFrame:
    """Clusters whose ratio of the window's best to their own news is under ``limit`` (or equal, if not strict); news of 0 has ratio ``limit``."""
    best = F.max("mu_e").over(Window.partitionBy("window_id"))
    ratio = F.when(F.col("mu_e") == 0, F.lit(limit)).otherwise(F.col("mu_x") / F.col("mu_e"))
    marked = scored.withColumn("mu_x", best).withColumn("ratio", ratio)
    return marked.where(F.col("ratio") < limit if strict else F.col("ratio") <= limit)


def realistic_topk(scored: DataFrame, limit: float, k: int) -> DataFrame:
    """The ``k`` best of the realistic events of a window; of equal ones the later."""
    order = Window.partitionBy("window_id").orderBy(F.desc("mu_e"), F.desc("cluster"))
    return realistic_events(scored, limit).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def event_title(clusters: DataFrame, scores: DataFrame, k: int = 5) -> DataFrame:
    """(window_id, cluster, title): the ``k`` best members by score and text, descending; only k per cluster are ever collected."""
    order = Window.partitionBy("window_id", "cluster").orderBy(F.desc("score"), F.desc("seg_text"))
    top = clusters.join(scores, "seg_text").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    listed = F.array_sort(F.collect_list(F.struct("r", "seg_text")))
    return top.groupBy("window_id", "cluster").agg(F.array_join(F.transform(listed, lambda x: x["seg_text"]), " | ").alias("title"))


def related_posts(clusters: DataFrame, segs: DataFrame) -> DataFrame:
    """(window_id, cluster, post_id, first_member): posts of the window with a member, each once, at the first member it holds."""
    members = clusters.select("window_id", "cluster", "node", "seg_text")
    return segs.select("window_id", "post_id", "seg_text").join(members, ["window_id", "seg_text"]).groupBy("window_id", "cluster", "post_id").agg(F.min("node").alias("first_member"))


def event_order(clusters: DataFrame) -> DataFrame:
    """(window_id, cluster, event_ord): events of a window numbered from 1 by label."""
    order = F.row_number().over(Window.partitionBy("window_id").orderBy("cluster"))
    return clusters.select("window_id", "cluster").distinct().withColumn("event_ord", order)


def post_event_ids(related: DataFrame, numbered: DataFrame) -> DataFrame:
    """(window_id, post_id, events): the sorted event numbers of every related post."""
    return related.join(numbered, ["window_id", "cluster"]).groupBy("window_id", "post_id").agg(F.array_sort(F.collect_set("event_ord")).alias("events"))


def post_event_labels(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """(window_id, post_id, label): comma-separated event numbers of every post, 0 for none."""
    text = F.array_join(F.transform("events", lambda x: x.cast("string")), ",")
    return posts.select("window_id", "post_id").join(ids, ["window_id", "post_id"], "left").select("window_id", "post_id", F.coalesce(text, F.lit("0")).alias("label"))
