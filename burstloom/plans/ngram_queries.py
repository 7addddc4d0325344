"""Queries of n-grams, cohesion and segmentation, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from burstloom.operators import ngram as N
from burstloom.operators import segmentation as S
from burstloom.sources.views import NGRAMS_SQL, POSTS_SQL, SEGMENTS_SQL, ngrams, posts, segments


def _texts(s, d):
    return segments(s, d).select("seg_text").distinct()


def _tokens(s, d):
    return posts(s, d).where("text is not null").select("post_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("tokens"))


def _round(c):
    return F.round(c, 6)


def _cohesion(f, column):
    def run(s, d):
        parts = N.split_products(_texts(s, d), ngrams(s, d), column)
        return parts.select("seg_text", _round(f(F.col("f"), F.col("n"), F.col("products"))).alias("c"))

    return run


def _span_scores(s, d):
    """The scores of all distinct spans with the knowledge-base factor, to nine digits, so that equal splits tie."""
    spans = S.segment_spans(_tokens(s, d))
    return N.stickiness(spans, ngrams(s, d), N.kb_from_posts(segments(s, d), posts(s, d))).withColumn("score", F.round("score", 9))


def _split(s, d):
    found = S.segment_by_parts(_tokens(s, d), ngrams(s, d), N.kb_from_posts(segments(s, d), posts(s, d)))
    return found if found is not None else S.segment_posts(_tokens(s, d), _span_scores(s, d))


QUERIES = {
    "build_ngrams": lambda s, d: N.build_ngrams(segments(s, d)),
    "ngram_count": lambda s, d: N.lookup(_texts(s, d), ngrams(s, d), "cnt"),
    "ngram_simple_prob": lambda s, d: N.lookup(_texts(s, d), ngrams(s, d), "prob").withColumn("prob", F.round("prob", 12)),
    "ngram_cond_prob": lambda s, d: N.lookup(_texts(s, d), N.conditional(ngrams(s, d)), "cprob").withColumn("cprob", F.round("cprob", 9)),
    "scp_simple": _cohesion(N.scp_simple, "cnt"),
    "pmi_simple": _cohesion(N.pmi_simple, "cnt"),
    "pmi_exact": _cohesion(N.pmi_exact, "prob"),
    "scp_exact": _cohesion(N.scp_exact, "prob"),
    "kb_anchor_q": lambda s, d: N.kb_from_posts(segments(s, d), posts(s, d)).select("seg_text", _round("anchor_q").alias("anchor_q")),
    "kb_title_q": lambda s, d: N.kb_from_posts(segments(s, d), posts(s, d)).select("seg_text", _round("title_q").alias("title_q")),
    "length_norm": lambda s, d: _texts(s, d).select("seg_text", _round(N.length_norm(F.size(F.split("seg_text", " ")))).alias("l")),
    "stickiness": lambda s, d: N.stickiness(_texts(s, d), ngrams(s, d), N.kb_from_posts(segments(s, d), posts(s, d))).select("seg_text", _round("score").alias("score")),
    "lm_score": lambda s, d: N.lm_score(_texts(s, d)).select("seg_text", _round("score").alias("score")),
    "stickiness_lm": lambda s, d: N.stickiness_lm(_texts(s, d)).select("seg_text", _round("score").alias("score")),
    "score_cache": lambda s, d: segments(s, d).join(N.lm_score(_texts(s, d)), "seg_text").select("post_id", "pos", _round("score").alias("score")),
    "segment_spans": lambda s, d: S.segment_spans(_tokens(s, d)),
    "top_e_beam": lambda s, d: S.beam_of_posts(_tokens(s, d)).select("post_id", "rank", "seg_text", _round("score").alias("score")),
    "segment_dp": lambda s, d: _split(s, d).select("post_id", F.array_join("segs", " | ").alias("segs")),
    "segment_posts": lambda s, d: _split(s, d).select("post_id", F.posexplode("segs").alias("pos", "seg_text")),
}

_T = f"WITH {SEGMENTS_SQL}, {NGRAMS_SQL}, texts AS (SELECT DISTINCT seg_text, string_split(seg_text, ' ') AS ws FROM segs)"
_TOK = f"WITH {POSTS_SQL}, toks AS (SELECT post_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS tokens FROM posts WHERE text IS NOT NULL), spans AS (SELECT post_id, i::INT AS i, n::INT AS n, array_to_string(tokens[i + 1 : i + n], ' ') AS seg_text FROM toks, unnest(range(0, len(tokens))) AS a(i), unnest(range(1, least(5, len(tokens) - i) + 1)) AS b(n))"


def _parts(column: str) -> str:
    return _T + f""", cuts AS (SELECT seg_text, len(ws) AS n, array_to_string(ws[1:i], ' ') AS pre, array_to_string(ws[i + 1:], ' ') AS suf FROM texts, unnest(CASE WHEN len(ws) > 1 THEN range(1, len(ws)) ELSE [NULL] END) AS u(i)),
parts AS (SELECT c.seg_text, n, sum(coalesce(p.{column}, 0.0) * coalesce(q.{column}, 0.0)) AS products FROM cuts c LEFT JOIN grams p ON p.seg_text = c.pre LEFT JOIN grams q ON q.seg_text = c.suf GROUP BY ALL),
v AS (SELECT parts.*, coalesce(g.{column}, 0.0) AS f FROM parts LEFT JOIN grams g USING (seg_text))"""


_M = "99603396.0::DOUBLE"
_SCP = f"CASE WHEN n = 1 THEN 2 * f * f / (f * f + {_M} * {_M}) WHEN f = 0 AND products = 0 THEN 2.0 ELSE 2 * f * f / (f * f + products / (n - 1)) END"
_LEN = "CASE WHEN {0} = 1 THEN 1.0 ELSE ({0} - 1) / {0} END"
_EVEN = "(list_min(list_transform(string_split({0}, ' '), lambda x: length(x))) / list_max(list_transform(string_split({0}, ' '), lambda x: length(x))))"
_KB = f"WITH {POSTS_SQL}, {SEGMENTS_SQL}, pp AS (SELECT seg_text, post_id, min(pos) AS first FROM segs GROUP BY ALL), kb AS (SELECT seg_text, count(*)::DOUBLE / (SELECT count(*) FROM posts) AS anchor_q, (count(*) FILTER (first = 0))::DOUBLE / (SELECT count(*) FROM posts) AS title_q FROM pp GROUP BY seg_text)"
SQL = {
    "build_ngrams": f"WITH {SEGMENTS_SQL}, w AS (SELECT string_split(seg_text, ' ') AS ws FROM segs), g AS (SELECT n::INT AS n, array_to_string(ws[i:i + n - 1], ' ') AS seg_text FROM w, unnest(range(1, len(ws) + 1)) AS a(i), unnest(range(1, least(5, len(ws) - i + 1) + 1)) AS b(n)) SELECT n, seg_text, count(*) AS cnt FROM g GROUP BY ALL",
    "ngram_count": _T + " SELECT t.seg_text, CASE WHEN len(ws) > 5 THEN 0.0::DOUBLE ELSE coalesce(cnt, 0.0::DOUBLE) END AS cnt FROM texts t LEFT JOIN grams USING (seg_text)",
    "ngram_simple_prob": _T + " SELECT t.seg_text, round(CASE WHEN len(ws) > 5 THEN 0.0::DOUBLE ELSE coalesce(prob, 0.0::DOUBLE) END, 12) AS prob FROM texts t LEFT JOIN grams USING (seg_text)",
    "ngram_cond_prob": _T + f""", cp AS (SELECT g.seg_text, coalesce(CASE WHEN len(string_split(g.seg_text, ' ')) = 1 THEN g.cnt / {_M} WHEN h.cnt = 0 THEN NULL ELSE g.cnt / h.cnt END, 0.0) AS cprob FROM grams g LEFT JOIN grams h ON len(string_split(g.seg_text, ' ')) > 1 AND h.seg_text = array_to_string(string_split(g.seg_text, ' ')[:-2], ' '))
SELECT t.seg_text, round(CASE WHEN len(ws) > 5 THEN 0.0::DOUBLE ELSE coalesce(cprob, 0.0::DOUBLE) END, 9) AS cprob FROM texts t LEFT JOIN cp USING (seg_text)""",
    "scp_simple": _parts("cnt") + f" SELECT seg_text, round({_SCP}, 6) AS c FROM v",
    "pmi_simple": _parts("cnt") + f" SELECT seg_text, round(CASE WHEN n = 1 THEN f / ({_M} + f) WHEN f = 0 AND products = 0 THEN 1.0 ELSE f * {_M} / (f * {_M} + products / (n - 1)) END, 6) AS c FROM v",
    "pmi_exact": _parts("prob") + ", e AS (SELECT seg_text, CASE WHEN n = 1 THEN (CASE WHEN f = 0 THEN 0.0 ELSE ln(f) END) WHEN f = 0 THEN '-inf'::DOUBLE WHEN products = 0 THEN 'inf'::DOUBLE ELSE ln(f / (products / n)) END AS x FROM v) SELECT seg_text, round(CASE WHEN x = '-inf'::DOUBLE THEN 0.0 ELSE 1.0 / (1.0 + exp(-x)) END, 6) AS c FROM e",
    "scp_exact": _parts("prob") + ", e AS (SELECT seg_text, CASE WHEN n = 1 THEN (CASE WHEN f = 0 THEN 0.0 ELSE 2 * ln(f) END) WHEN f = 0 OR products = 0 THEN 0.0 ELSE ln(f * f / (products / (n - 1))) END AS x FROM v) SELECT seg_text, round(2.0 / (1.0 + exp(-x)), 6) AS c FROM e",
    "kb_anchor_q": _KB + " SELECT seg_text, round(anchor_q, 6) AS anchor_q FROM kb",
    "kb_title_q": _KB + " SELECT seg_text, round(title_q, 6) AS title_q FROM kb",
    "length_norm": _T + f" SELECT seg_text, round({_LEN.format('len(ws)')}, 6) AS l FROM texts",
    "stickiness": _parts("cnt").replace("WITH ", f"WITH {POSTS_SQL}, ", 1) + f", pp AS (SELECT DISTINCT seg_text, post_id FROM segs), kb AS (SELECT seg_text, count(*)::DOUBLE / (SELECT count(*) FROM posts) AS q FROM pp GROUP BY seg_text) SELECT seg_text, round({_LEN.format('n')} * ({_SCP}) * exp(coalesce(q, 0.0)), 6) AS score FROM v LEFT JOIN kb USING (seg_text)",
    "lm_score": _T + f" SELECT seg_text, round({_EVEN.format('seg_text')}, 6) AS score FROM texts",
    "stickiness_lm": _T + f" SELECT seg_text, round({_LEN.format('len(ws)')} * {_EVEN.format('seg_text')}, 6) AS score FROM texts",
    "score_cache": f"WITH {SEGMENTS_SQL} SELECT post_id, pos, round({_EVEN.format('seg_text')}, 6) AS score FROM segs",
    "segment_spans": _TOK + " SELECT post_id, i, n, seg_text FROM spans",
    "top_e_beam": _TOK + f", sc AS (SELECT *, {_LEN.format('n')} * {_EVEN.format('seg_text')} AS score FROM spans), r AS (SELECT post_id, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, i, n) AS rank, seg_text, round(score, 6) AS score FROM sc) SELECT * FROM r WHERE rank <= 20",
}
_DP = _TOK.replace("WITH ", f"WITH RECURSIVE {SEGMENTS_SQL}, {NGRAMS_SQL}, ", 1) + f""", texts AS (SELECT DISTINCT seg_text, string_split(seg_text, ' ') AS ws FROM spans),
cuts AS (SELECT seg_text, len(ws) AS n, array_to_string(ws[1:i], ' ') AS pre, array_to_string(ws[i + 1:], ' ') AS suf FROM texts, unnest(CASE WHEN len(ws) > 1 THEN range(1, len(ws)) ELSE [NULL] END) AS u(i)),
parts AS (SELECT c.seg_text, n, sum(coalesce(p.cnt, 0.0) * coalesce(q.cnt, 0.0)) AS products FROM cuts c LEFT JOIN grams p ON p.seg_text = c.pre LEFT JOIN grams q ON q.seg_text = c.suf GROUP BY ALL),
v AS (SELECT parts.*, coalesce(g.cnt, 0.0) AS f FROM parts LEFT JOIN grams g USING (seg_text)),
pp AS (SELECT DISTINCT seg_text, post_id FROM segs), kb AS (SELECT seg_text, count(*)::DOUBLE / (SELECT count(*) FROM posts) AS q FROM pp GROUP BY seg_text),
scores AS MATERIALIZED (SELECT seg_text, round({_LEN.format('n')} * ({_SCP}) * exp(coalesce(q, 0.0)), 9) AS score FROM v LEFT JOIN kb USING (seg_text)),
ends AS MATERIALIZED (SELECT post_id, i + n AS e, list(score ORDER BY i) AS sc FROM spans JOIN scores USING (seg_text) GROUP BY post_id, i + n),
dp AS (SELECT post_id, 0 AS e, [0.0::DOUBLE] AS best, 0 AS back FROM toks
UNION ALL SELECT post_id, e, list_append(best, list_max(o)), (e - len(sc) + list_position(o, list_max(o)) - 1)::INT FROM
(SELECT d.post_id, x.e, d.best, x.sc, list_transform(range(1, len(x.sc) + 1), lambda k: d.best[x.e - len(x.sc) + k] + x.sc[k]) AS o FROM dp d JOIN ends x ON x.post_id = d.post_id AND x.e = d.e + 1)),
backs AS MATERIALIZED (SELECT post_id, e, back FROM dp WHERE e > 0),
path AS (SELECT post_id, len(tokens)::BIGINT AS e FROM toks WHERE len(tokens) > 0 UNION ALL SELECT p.post_id, b.back::BIGINT FROM path p JOIN backs b ON b.post_id = p.post_id AND b.e = p.e WHERE b.back > 0),
cutted AS (SELECT p.post_id, (row_number() OVER (PARTITION BY p.post_id ORDER BY p.e) - 1)::INT AS pos, array_to_string(tokens[b.back + 1 : p.e], ' ') AS seg_text FROM path p JOIN backs b ON b.post_id = p.post_id AND b.e = p.e JOIN toks t ON t.post_id = p.post_id)"""
SQL |= {
    "segment_dp": _DP + " SELECT t.post_id, coalesce(string_agg(seg_text, ' | ' ORDER BY pos), '') AS segs FROM toks t LEFT JOIN cutted USING (post_id) GROUP BY t.post_id",
    "segment_posts": _DP + " SELECT post_id, pos, seg_text FROM cutted",
}
