"""Spans are scored where their post is read: the same results as by joins, and no span is shuffled."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from burstloom.operators import ngram as N
from burstloom.operators import segmentation as S
from burstloom.plans import catalog


def _posts(spark):
    rng = random.Random(5)
    words = ["a", "bb", "سلام", "dddd", "eeeee"]
    rows = [(i, [rng.choice(words) for _ in range(rng.randrange(14))]) for i in range(60)]
    return spark.createDataFrame([*rows, (60, []), (61, None)], "post_id long, tokens array<string>")


def _shuffles(df):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain()
    return said.getvalue().count("Exchange")


@pytest.mark.parametrize("scorer", [N.length_scorer, lambda texts: [len(t) % 3 / 2 for t in texts]])
def test_beam_of_posts(spark, scorer):
    posts = _posts(spark)
    spans = S.segment_spans(posts)
    want = S.top_beam(spans.join(N.stickiness_lm(spans, scorer), "seg_text"), 6)
    cols = ["post_id", "rank", "seg_text", "score"]
    got = S.beam_of_posts(posts, scorer, width=6)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert not _shuffles(got)


def test_segment_by_parts(spark):
    posts = _posts(spark).where("tokens is not null")
    grams = spark.createDataFrame([("a", 900.0), ("bb", 70.0), ("a bb", 40.0), ("bb سلام", 3.0), ("a bb سلام", 2.0), ("zz", 1.0), ("a  bb", 9.0)], "seg_text string, cnt double")
    kb = spark.createDataFrame([("a", 0.5), ("dddd eeeee", 0.25), ("a a", 0.1)], "seg_text string, anchor_q double")
    scores = N.stickiness(S.segment_spans(posts), grams, kb).withColumn("score", F.round("score", 9))
    want = {r[0]: r[1] for r in S.segment_posts(posts, scores).collect()}
    got = S.segment_by_parts(posts, grams, kb)
    assert {r[0]: r[1] for r in got.collect()} == want
    assert not _shuffles(got)
    assert S.segment_by_parts(posts, grams, kb, most=3) is None
    none = S.segment_by_parts(posts, grams.limit(0), kb.limit(0))
    flat = N.stickiness(S.segment_spans(posts), grams.limit(0), None).withColumn("score", F.round("score", 9))
    assert {r[0]: r[1] for r in none.collect()} == {r[0]: r[1] for r in S.segment_posts(posts, flat).collect()}


def test_queries_shuffle_no_spans(spark, data):
    for name in ("top_e_beam", "segment_dp", "segment_posts"):
        assert _shuffles(catalog.queries()[name](spark, data)) <= 1, name
