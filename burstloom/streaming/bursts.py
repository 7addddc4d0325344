"""Incremental counts of posts as they arrive (an extension of the batch windows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arriving_counts(posts: DataFrame, hours: int = 12, late: str = "1 day") -> DataFrame:
    """(start, posts): posts per tumbling time window, each post once; posts later than the watermark are dropped.

    Works on a stream with columns post_id and sent_at (a timestamp) and, for the same rows, on a batch. Posts without a date or id
    are left out. A stream forgets a post once its time is past the watermark.
    """
    timed = posts.where("sent_at is not null and post_id is not null").withColumn("sent_at", F.col("sent_at").cast("timestamp"))
    if timed.isStreaming:
        once = timed.withWatermark("sent_at", late).dropDuplicates(["post_id", "sent_at"])
    else:
        once = timed.dropDuplicates(["post_id", "sent_at"])
    return once.groupBy(F.window("sent_at", f"{hours} hours").alias("w")).agg(F.count("*").alias("posts")).select(F.col("w.start").alias("start"), "posts")
