"""Queries of burst detection and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from burstloom.operators import burst
from burstloom.sources.views import POSTS_SQL, SEGMENTS_SQL, posts, segments


def _q(f):
    return lambda spark, sf: f(segments(spark, sf), posts(spark, sf))


def _r(*names):
    return lambda df: df.withColumns({n: F.round(n, 6) for n in names})


STATS_SQL = f"""WITH {POSTS_SQL}, {SEGMENTS_SQL},
once AS (SELECT DISTINCT p.window_id, s.seg_text, s.post_id, p.user_id FROM segs s JOIN posts p USING (post_id)),
counts AS (SELECT window_id, seg_text, count(*) AS fst, count(DISTINCT user_id) AS ust FROM once GROUP BY ALL),
sizes AS (SELECT window_id, count(*) AS nt FROM posts GROUP BY window_id),
stats AS (SELECT window_id, seg_text, fst, ust, nt, sum(fst) OVER (PARTITION BY seg_text)::DOUBLE / (SELECT count(*) FROM posts)::DOUBLE AS ps
  FROM counts JOIN sizes USING (window_id)),
bursty AS (SELECT *, ps * nt AS est, sqrt(nt * ps * (1.0 - ps)) AS dst FROM stats WHERE fst > ps * nt),
weighted AS (SELECT *, CASE WHEN ust = 0 THEN 0.0 ELSE (CASE WHEN fst >= est + 2 * dst THEN 1.0::DOUBLE ELSE 1.0 / (1.0 + exp(-(10 * (fst - est - dst) / dst))) END) * ln(ust::DOUBLE) END AS weight FROM bursty),
ranked AS (SELECT w.window_id, s.post_id, row_number() OVER (PARTITION BY p.window_id, s.post_id ORDER BY weight DESC, s.seg_text DESC, s.pos) AS rank, s.seg_text, weight, nt
  FROM segs s JOIN posts p USING (post_id) JOIN weighted w ON w.window_id = p.window_id AND w.seg_text = s.seg_text),
top AS (SELECT window_id, post_id, rank, seg_text, weight FROM ranked WHERE rank <= ceil(sqrt(nt)))"""
LAST2 = "window_id IN (SELECT DISTINCT window_id FROM posts ORDER BY window_id DESC LIMIT 2)"

QUERIES = {
    "segment_prob": _q(lambda s, p: _r("ps")(burst.segment_prob(s, p))),
    "segment_freq": _q(lambda s, p: burst.segment_freq(s)),
    "segment_freq_text": _q(lambda s, p: burst.burst_stats(s, p).select("window_id", "seg_text", "fst")),
    "segment_users": _q(lambda s, p: burst.segment_users(s, p)),
    "sigmoid": _q(lambda s, p: s.select("post_id", "pos", F.round(burst.sigmoid(F.col("stickiness")), 6).alias("sig"))),
    "burst_test": _q(lambda s, p: _r("ps", "est")(burst.burst_test(burst.burst_stats(s, p)))),
    "burst_weight": _q(lambda s, p: _r("weight")(burst.burst_weight(burst.burst_test(burst.burst_stats(s, p)))).select("window_id", "seg_text", "weight")),
    "burst_topk": _q(lambda s, p: _r("weight")(burst.burst_topk(s, burst.burst_weight(burst.burst_test(burst.burst_stats(s, p))), p))),
    "detect_bursty": _q(lambda s, p: _r("weight")(burst.detect_bursty(s, p))),
    "detect_bursty_last_n": _q(lambda s, p: _r("weight")(burst.detect_bursty(s, p, last_n=2))),
}
SQL = {
    "segment_prob": f"WITH {POSTS_SQL}, {SEGMENTS_SQL} SELECT seg_text, round(count(DISTINCT post_id)::DOUBLE / (SELECT count(*) FROM posts)::DOUBLE, 6) AS ps FROM segs GROUP BY seg_text",
    "segment_freq": f"WITH {SEGMENTS_SQL} SELECT window_id, seg_text, count(DISTINCT post_id) AS fst FROM segs GROUP BY ALL",
    "segment_freq_text": STATS_SQL + " SELECT window_id, seg_text, fst FROM stats",
    "segment_users": f"WITH {POSTS_SQL}, {SEGMENTS_SQL} SELECT s.window_id, seg_text, count(DISTINCT user_id) AS ust FROM segs s JOIN posts USING (post_id) GROUP BY ALL",
    "sigmoid": f"WITH {SEGMENTS_SQL} SELECT post_id, pos, round(1.0 / (1.0 + exp(-stickiness)), 6) AS sig FROM segs",
    "burst_test": STATS_SQL + " SELECT window_id, seg_text, fst, ust, nt, round(ps, 6) AS ps, round(est, 6) AS est FROM bursty",
    "burst_weight": STATS_SQL + " SELECT window_id, seg_text, round(weight, 6) AS weight FROM weighted",
    "burst_topk": STATS_SQL + " SELECT window_id, post_id, rank, seg_text, round(weight, 6) AS weight FROM top",
    "detect_bursty": STATS_SQL + " SELECT window_id, post_id, rank, seg_text, round(weight, 6) AS weight FROM top",
    "detect_bursty_last_n": STATS_SQL + f" SELECT window_id, post_id, rank, seg_text, round(weight, 6) AS weight FROM top WHERE {LAST2}",
}
