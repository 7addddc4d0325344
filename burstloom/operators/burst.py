"""Burst detection: which segments occur in a window more often than over all windows.

Inputs: ``segs`` (window_id, post_id, pos, seg_text) and ``posts`` (window_id, post_id, user_id). A segment's probability is the share of
all posts that hold it; it is bursty in a window that holds it in more posts than expected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def segment_prob(segs: DataFrame, posts: DataFrame) -> DataFrame:
    """(seg_text, ps): posts with the segment over all posts. The post total is one number."""
    total = posts.agg(F.count("*").cast("double").alias("total"))
    held = segs.select("seg_text", "post_id").distinct().groupBy("seg_text").agg(F.count("*").alias("n"))
    return held.join(F.broadcast(total)).select("seg_text", (F.col("n") / F.col("total")).alias("ps"))


def segment_freq(segs: DataFrame) -> DataFrame:
    """(window_id, seg_text, fst): posts of the window that hold the segment."""
    return segs.groupBy("window_id", "seg_text", "post_id").agg(F.lit(1).alias("one")).groupBy("window_id", "seg_text").agg(F.count("*").alias("fst"))


def segment_users(segs: DataFrame, posts: DataFrame) -> DataFrame:
    """(window_id, seg_text, ust): users of those posts; unknown users count for none."""
    users = segs.select("window_id", "seg_text", "post_id").join(posts.select("post_id", "user_id"), "post_id")
    return users.groupBy("window_id", "seg_text", "user_id").agg(F.lit(1).alias("one")).groupBy("window_id", "seg_text").agg(F.count("user_id").alias("ust"))


def window_sizes(posts: DataFrame) -> DataFrame:
    return posts.groupBy("window_id").agg(F.count("*").alias("nt"))


def burst_stats(segs: DataFrame, posts: DataFrame) -> DataFrame:
    """(window_id, seg_text, fst, ust, ps, nt, est): one pass over distinct (window, segment, post, user), then counts of counts.

    A post belongs to one window, so the share over all windows is a sum of the windows' counts and needs no second pass.
    """
    sizes = window_sizes(posts)
    total = sizes.agg(F.sum("nt").cast("double").alias("total"))
    homes = posts.select("post_id", "window_id", "user_id").join(sizes, "window_id")
    # one shuffle by text serves every count below
    held = segs.select("post_id", "seg_text").join(homes, "post_id").repartition("seg_text")
    once = held.groupBy("window_id", "seg_text", "post_id").agg(F.first("user_id").alias("user_id"), F.first("nt").alias("nt"))
    per_user = once.groupBy("window_id", "seg_text", "user_id").agg(F.count("*").alias("n"), F.first("nt").alias("nt"))
    counts = per_user.groupBy("window_id", "seg_text").agg(F.sum("n").alias("fst"), F.count("user_id").alias("ust"), F.first("nt").alias("nt"))
    all_windows = F.sum("fst").over(Window.partitionBy("seg_text"))
    stats = counts.withColumn("f_all", all_windows).join(F.broadcast(total))
    return stats.withColumn("ps", F.col("f_all") / F.col("total")).withColumn("est", F.col("ps") * F.col("nt")).drop("f_all", "total")


def burst_test(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("fst") > F.col("est"))


def burst_weight(stats: DataFrame) -> DataFrame:
    """Adds ``weight``: the burst probability times the log of the users; 0 for at most one user."""
    dst = F.sqrt(F.col("nt") * F.col("ps") * (F.lit(1.0) - F.col("ps")))
    pb = F.when(F.col("fst") >= F.col("est") + 2 * dst, 1.0).otherwise(sigmoid(10 * (F.col("fst") - F.col("est") - dst) / dst))
    return stats.withColumn("weight", F.when(F.col("ust") == 0, 0.0).otherwise(pb * F.log(F.col("ust").cast("double"))))


def burst_topk(segs: DataFrame, weighted: DataFrame, posts: DataFrame) -> DataFrame:
    """(window_id, post_id, rank, seg_text, weight): the ceil(sqrt(posts of the window)) heaviest bursty segments of every post."""
    home = posts.select("post_id", "window_id")
    held = segs.select("post_id", "pos", "seg_text").join(home, "post_id").join(weighted.select("window_id", "seg_text", "weight", "nt"), ["window_id", "seg_text"])
    order = Window.partitionBy("window_id", "post_id").orderBy(F.desc("weight"), F.desc("seg_text"), "pos")
    return held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.ceil(F.sqrt("nt"))).select("window_id", "post_id", "rank", "seg_text", "weight")


def detect_bursty(segs: DataFrame, posts: DataFrame, last_n: int | None = None, keep=None) -> DataFrame:
    """The composition. With ``last_n`` only the last windows are returned; probabilities stay those of all windows. ``keep`` may store the weights."""
    weighted = burst_weight(burst_test(burst_stats(segs, posts)))
    if keep:
        weighted = keep(weighted)
    if last_n is not None:
        weighted, segs, posts = (last_windows(x, posts, last_n) if "window_id" in x.columns else x for x in (weighted, segs, posts))
    return burst_topk(segs, weighted, posts)


def last_windows(df: DataFrame, posts: DataFrame, n: int) -> DataFrame:
    """Rows of the last ``n`` windows, by number."""
    keep = posts.select("window_id").distinct().orderBy(F.desc("window_id")).limit(n)
    return df.join(F.broadcast(keep), "window_id", "left_semi")
