"""Sources and sinks of the pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burstloom.session import materialise

POST_JSON = "struct<DocumentId:bigint,Sentences:array<struct<Tokens:array<struct<Token:string,Type:string,IsStopWord:boolean>>>>>"
#: token types that are kept
KEPT_TYPES = ("PersianWord", "Integer", "EnglishWord", "CompoundWord")


def scan_posts(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with a text whose date lies between start and end (both included), by date and then by descending id."""
    return raw.where(F.col("source_text").isNotNull() & F.col("date_sent").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))).orderBy(F.asc("date_sent"), F.desc("seq"))


def parse_post_json(raw: DataFrame) -> DataFrame:
    """(seq, tokens, types): the kept words of every row whose JSON is whole and its own."""
    doc = F.from_json("source_text", POST_JSON)
    token = lambda t: ~F.coalesce(t["IsStopWord"], F.lit(False)) & t["Type"].isin(*KEPT_TYPES)
    kept = F.flatten(F.transform(F.col("doc.Sentences"), lambda s: F.filter(s["Tokens"], token)))
    parsed = raw.select("seq", doc.alias("doc")).where("doc.DocumentId = seq and doc.Sentences is not null")
    return parsed.select("seq", kept.alias("kept")).select("seq", F.transform("kept", lambda t: t["Token"]).alias("tokens"), F.transform("kept", lambda t: t["Type"]).alias("types"))


def null_default(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def run_windows(posts: DataFrame) -> DataFrame:
    """Adds ``run``: a new number wherever the window number changes in the order (date, descending id).

    Runs need the one global order; it is taken per day first and the days are chained by their ends, so no task holds all rows.
    """
    day = Window.partitionBy("day").orderBy("sent_at", F.desc("post_id"))
    marked = posts.withColumn("day", F.to_date("sent_at"))
    inner = marked.withColumn("turn", F.coalesce((F.lag("window_id").over(day) != F.col("window_id")).cast("int"), F.lit(0)))
    inner = inner.withColumn("in_day", F.sum("turn").over(day))
    first, last = F.min_by("window_id", F.struct("sent_at", -F.col("post_id"))), F.max_by("window_id", F.struct("sent_at", -F.col("post_id")))
    ends = inner.groupBy("day").agg(F.sum("turn").alias("turns"), first.alias("first"), last.alias("last"))
    chain = Window.orderBy("day")  # one row per day
    steps = ends.withColumn("step", F.coalesce((F.lag("last").over(chain) != F.col("first")).cast("int"), F.lit(0)) + F.coalesce(F.lag("turns").over(chain), F.lit(0)))
    base = steps.withColumn("base", F.sum("step").over(chain)).select("day", "base")
    return inner.join(F.broadcast(base), "day").select("post_id", "window_id", (F.col("base") + F.col("in_day")).alias("run"))


def text_lines(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, line_no, line): the lines of a text that are not blank."""
    return df.select(id_col, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.trim("line") != "")


def gold_labels(gold: DataFrame, labels: DataFrame) -> DataFrame:
    """(gold_id, sample, classes, clusters): the labels of every row in the order of their fields; null where a field has none.

    labels: (gold_id, field, pos, value) of the two fields.
    """

    def listed(field: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col("field") == field, F.struct("pos", "value"))))
        return F.transform(own, lambda x: x["value"])

    lists = labels.groupBy("gold_id").agg(listed("gold_class").alias("classes"), listed("gold_cluster").alias("clusters"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return gold.select("gold_id", "sample").join(lists, "gold_id", "left").select("gold_id", "sample", some("classes"), some("clusters"))


#: The rows of the gold sheet that belong to a window, by position from 0
GOLD_SLICES = {14: (0, 94), 15: (94, 150), 16: (150, 508), 17: (508, None)}


def gold_windows(gold: DataFrame) -> DataFrame:
    """``gold`` with ``ordinal``, the place in ``gold_id`` order, and the window of its slice; the sheet is a hand-made, small table."""
    at = F.row_number().over(Window.orderBy("gold_id")) - 1
    window = F.coalesce(*[F.when(F.col("ordinal") < hi, w) for w, (_, hi) in GOLD_SLICES.items() if hi is not None], F.lit(max(GOLD_SLICES)))
    return gold.withColumn("ordinal", at).withColumn("window_id", window)


def checkpoint_stage(df: DataFrame) -> DataFrame:
    """Write a stage to the shared folder and read it again."""
    return materialise(df)


def write_sheets(df: DataFrame, path: str) -> None:
    """One CSV folder per window, written by the tasks that hold it."""
    df.repartition("window_id").write.mode("overwrite").partitionBy("window_id").option("header", True).csv(path)


def read_sheets(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def slice_windows(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Windows lo to hi, both included; a filter that reaches the scan."""
    return df.where(F.col("window_num").between(lo, hi))
