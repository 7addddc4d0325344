"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burstloom.operators.packed import packed_labels
from burstloom.sources.readers import table


def p1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label of the two packed fields."""
    return packed_labels(table(spark, sf_dir, "gldn_std"), "gold_id", ["gold_class", "gold_cluster"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of fields that hold two or more."""
    n = F.max("pos").over(Window.partitionBy("gold_id", "field"))
    return p1_labels(spark, sf_dir).withColumn("n", n).where("n > 1").drop("n")


QUERIES = {"p1_found": p1_found, "p1_labels": p1_labels}
