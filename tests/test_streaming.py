"""A stream that has ended gives what the batch gives."""

from pyspark.sql import functions as F

from burstloom.streaming.bursts import arriving_counts


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 40, f"2017-01-0{1 + i % 3} 0{i % 9}:00:00") for i in range(120)] + [(None, "2017-01-01 00:00:00"), (5, None)]
    df = spark.createDataFrame(rows, "post_id long, sent_at string").withColumn("sent_at", F.col("sent_at").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = arriving_counts(stream).writeStream.format("memory").queryName("arriving").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("arriving").collect()}
    assert got == {tuple(r) for r in arriving_counts(df).collect()} and got
