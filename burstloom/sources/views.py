"""Canonical views of the delivered tables: one row per post, segment, edge or n-gram."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstloom.sources.readers import table


def posts(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """One row per post: its earliest delivery. Without ``text`` only (post_id, sent_at, user_id, window_id), so that no text is shuffled."""
    t = table(spark, sf_dir, "alldata")
    kept = ["posts_windowing", "types", "deleted", "date_sent", "from_id", "window_num"][0 if text else 3 :]
    first = t.groupBy("seq").agg(F.min_by(F.struct(*kept), "loaded_at").alias("p"))
    texts = [F.col("p.posts_windowing").alias("text"), "p.types", "p.deleted"] if text else []
    return first.select(F.col("seq").alias("post_id"), *texts, F.col("p.date_sent").alias("sent_at"), F.col("p.from_id").alias("user_id"), F.col("p.window_num").alias("window_id"))


POSTS_SQL = """posts AS (SELECT DISTINCT ON (seq) seq AS post_id, posts_windowing AS text, types, deleted, date_sent AS sent_at,
  from_id AS user_id, window_num AS window_id FROM alldata ORDER BY seq, loaded_at)"""


def segments(spark: SparkSession, sf_dir: str, by_post: bool = False) -> DataFrame:
    """One row per segment of a post; null and empty segments are none. ``by_post``: shuffled by post, so that a join with the posts needs no other shuffle."""
    t = table(spark, sf_dir, "postsegments").where("current_segment <> ''")
    if by_post:
        t = t.select("seq", "pos", "window_num", "current_segment", "stickiness").repartition("seq")
    return t.groupBy(F.col("seq").alias("post_id"), "pos").agg(F.min("window_num").alias("window_id"), F.min("current_segment").alias("seg_text"), F.min("stickiness").alias("stickiness"))


SEGMENTS_SQL = """segs AS (SELECT seq AS post_id, pos, min(window_num) AS window_id, min(current_segment) AS seg_text,
  min(stickiness) AS stickiness FROM postsegments WHERE current_segment <> '' GROUP BY seq, pos)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected weighted edges a < b per window: the largest weight of repeated ones; weights that are no number count for nothing."""
    t = table(spark, sf_dir, "similaritygraph").where("weight is not null and not isnan(weight) and node_a <> node_b")
    return t.groupBy(F.col("window_num").alias("window_id"), F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).agg(F.max("weight").alias("w"))


EDGES_SQL = """edges AS (SELECT window_num AS window_id, least(node_a, node_b) AS a, greatest(node_a, node_b) AS b, max(weight) AS w
  FROM similaritygraph WHERE weight IS NOT NULL AND NOT isnan(weight) AND node_a <> node_b GROUP BY ALL)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "graphnodes").select(F.col("window_num").alias("window_id"), F.col("node_id").alias("node"), "seg_text")


NODES_SQL = "nodes AS (SELECT window_num AS window_id, node_id AS node, seg_text FROM graphnodes)"


def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seg_text, cnt, prob): one row per n-gram, null counts are 0."""
    t = table(spark, sf_dir, "ngrams").where("seg_text is not null")
    return t.groupBy("seg_text").agg(F.max(F.coalesce("cnt", F.lit(0.0))).alias("cnt"), F.max(F.coalesce("prob", F.lit(0.0))).alias("prob"))


NGRAMS_SQL = "grams AS (SELECT seg_text, max(coalesce(cnt, 0.0)) AS cnt, max(coalesce(prob, 0.0)) AS prob FROM ngrams WHERE seg_text IS NOT NULL GROUP BY seg_text)"
