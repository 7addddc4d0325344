"""Entity tags of segmented posts, and texts put together from segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bio_tags(segs: DataFrame, entities: DataFrame) -> DataFrame:
    """(post_id, pos, word_no, word, tag, rank): B and I for the words of a segment that is an entity, with its first rank; else O and 0."""
    first = entities.groupBy("seg_text").agg(F.min("rank").alias("rank"))
    tagged = segs.select("post_id", "pos", "seg_text").join(first, "seg_text", "left").select("post_id", "pos", F.coalesce("rank", F.lit(0)).alias("rank"), F.posexplode(F.split("seg_text", " ")).alias("word_no", "word"))
    tag = F.when(F.col("rank") == 0, "O").when(F.col("word_no") == 0, "B").otherwise("I")
    return tagged.select("post_id", "pos", "word_no", "word", tag.alias("tag"), "rank")


def join_segments(segs: DataFrame) -> DataFrame:
    """(post_id, text): the segments of a post in order, joined by blanks. A post's segments are few by nature."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "seg_text")))
    return segs.groupBy("post_id").agg(F.array_join(F.transform(ordered, lambda x: x["seg_text"]), " ").alias("text"))


def pseudo_docs(segs: DataFrame, per_doc: int = 50) -> DataFrame:
    """(window_id, part, doc): the joined texts of a window's posts in id order, ``per_doc`` posts to a document."""
    texts = join_segments(segs).join(segs.select("post_id", "window_id").distinct(), "post_id")
    at = F.row_number().over(Window.partitionBy("window_id").orderBy("post_id")) - 1
    parts = texts.withColumn("part", F.floor(at / per_doc))
    ordered = F.array_sort(F.collect_list(F.struct("post_id", "text")))
    return parts.groupBy("window_id", "part").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("doc"))


def dedupe_runs(segs: DataFrame) -> DataFrame:
    """Segments that differ from the one before them in their post."""
    before = F.lag("seg_text").over(Window.partitionBy("post_id").orderBy("pos"))
    return segs.withColumn("before", before).where("before is null or before <> seg_text").select("post_id", "pos", "seg_text")
