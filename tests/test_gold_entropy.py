"""Entropies over all labels of all gold rows."""

import pytest
from pyspark.sql import functions as F

from burstloom.operators import evaluation
from burstloom.plans import catalog, eval_queries
from burstloom.sources.readers import table


def test_every_filled_gold_row_counts(spark, data):
    g = table(spark, data, "gldn_std")
    filled = g.where("trim(gold_class) <> '' and trim(gold_cluster) <> ''").count()
    rows = eval_queries._packed(spark, data).collect()
    assert len(rows) == filled
    assert not any(c in "۰۱۲۳۴۵۶۷۸۹" for r in rows for x in r["classes"] + r["clusters"] for c in x)
    shares = {}
    for r in rows:
        for x in r["clusters"]:
            shares[x] = shares.get(x, 0) + 1
    got = catalog.queries()["entropy_verbose"](spark, data).collect()
    assert {r["group"]: r["n"] for r in got} == shares


def test_both_roles_in_the_order_of_rows(spark):
    rows = [(1, ["b"], ["x"]), (2, ["b", "a"], ["x"]), (3, ["a"], ["x", "y"]), (4, ["c"], ["y"])]
    df = spark.createDataFrame(rows, "gold_id long, classes array<string>, clusters array<string>")
    # x: b before a by rows, so b takes 1 and 2 and a takes 3 with half a share
    r = evaluation.multi_entropies(df, "clusters", "classes", "gold_id").first()
    x = evaluation.group_entropy([(["b"], 1.0), (["b", "a"], 1.0), (["a"], 0.5)])[0]
    y = evaluation.group_entropy([(["a"], 0.5), (["c"], 1.0)])[0]
    assert r["cluster_entropy"] == pytest.approx((x + y) / 4)
    assert r["class_entropy"] == pytest.approx(0.0)
    assert evaluation.entropy(df, "clusters", "classes", "gold_id").where(F.col("group") == "x").first()["trace"] == "b:2 a:1"
