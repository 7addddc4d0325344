"""Sheets over all windows."""

from burstloom.plans import catalog
from burstloom.sources.readers import table


def test_topics_of_every_window_with_events(spark, data):
    q = catalog.queries()
    top = {(r["window_id"], r["rank"], r["cluster"]) for r in q["realistic_topk"](spark, data).collect()}
    titles = {(r["window_id"], r["cluster"]): r["title"] for r in q["event_title"](spark, data).collect()}
    got = q["sink_topics_xls"](spark, data).collect()
    assert {(r["window_id"], r["rank"], r["topic"]) for r in got} == {(w, k, titles[w, c]) for w, k, c in top}


def test_gold_slices_hold_every_row(spark, data):
    got = catalog.queries()["scan_xls_window"](spark, data).collect()
    assert sorted(r["gold_id"] for r in got) == sorted(r["gold_id"] for r in table(spark, data, "gldn_std").collect())
