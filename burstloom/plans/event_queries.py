"""Queries of clusters and events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from burstloom.operators import burst, cluster, events
from burstloom.operators.ngram import kb_from_posts, lm_score
from burstloom.session import materialise
from burstloom.sources.views import EDGES_SQL, NODES_SQL, POSTS_SQL, SEGMENTS_SQL, edges, nodes, posts, segments

#: k_min of the chain from clusters to labels; the graphs here have about five edges a node, and at 6 hardly a cluster is left
K, K_MIN = 15, 2
#: k_min of the fixed choice
FIXED_MIN = 6


def _near(s, d):
    return cluster.knn(edges(s, d), K)


def _mutual(s, d):
    return cluster.mutual_knn(materialise(_near(s, d)))


def _shared(s, d):
    near = materialise(_near(s, d))
    return cluster.shared_neighbors(near, cluster.mutual_knn(near), K_MIN)


def _jp(s, d):
    return cluster.jarvis_patrick(nodes(s, d), edges(s, d), K, K_MIN)


def _clusters(s, d):
    c = cluster.cluster_fixed(nodes(s, d), edges(s, d), K, K_MIN)
    return materialise(c.join(nodes(s, d), ["window_id", "node"]))


def _kb(s, d):
    return kb_from_posts(segments(s, d), posts(s, d)).select("seg_text", F.col("anchor_q").alias("q"))


def _news(s, d, last=None):
    c = _clusters(s, d)
    e = edges(s, d)
    if last:
        c, e = burst.last_windows(c, c, last), burst.last_windows(e, c, last)
    return events.event_news(c, e, events.segment_news(c, _kb(s, d)))


def _r6(df, *cs):
    return df.withColumns({c: F.round(c, 6) for c in cs})


def _scores(s, d, c):
    return c.select("seg_text").distinct().join(_kb(s, d), "seg_text", "left").select("seg_text", F.exp(F.coalesce("q", F.lit(0.0))).alias("score"))


def _titles(s, d, last=None):
    c = _clusters(s, d)
    if last:
        c = burst.last_windows(c, c, last)
    return events.event_title(c, _scores(s, d, c))


def _related(s, d):
    return events.related_posts(_clusters(s, d), segments(s, d))


def _ids(s, d):
    c = _clusters(s, d)
    return events.post_event_ids(events.related_posts(c, segments(s, d)), events.event_order(c))


def _silhouette(s, d):
    return _r6(cluster.silhouette(cluster.noise_clusters(_jp(s, d)), edges(s, d)), "silhouette")


def _grid(s, d, grid):
    n = nodes(s, d)
    return _r6(cluster.cluster_grid(n, edges(s, d), grid(n)), "silhouette")


def _range(s, d):
    return _grid(s, d, lambda n: cluster.range_grid(n, 5, 50))


QUERIES = {
    "knn": _near,
    "mutual_knn": _mutual,
    "shared_neighbors": _shared,
    "jarvis_patrick": _jp,
    "noise_clusters": lambda s, d: cluster.noise_clusters(_jp(s, d)),
    "cluster_fixed": lambda s, d: cluster.cluster_fixed(nodes(s, d), edges(s, d), K, FIXED_MIN),
    "silhouette": _silhouette,
    "cluster_grid_auto": lambda s, d: cluster.best_or_initial(_grid(s, d, cluster.auto_grid), cluster.auto_initial(nodes(s, d))),
    "cluster_grid_range": _range,
    "cluster_grid_range_best": lambda s, d: cluster.best_or_initial(_range(s, d), nodes(s, d).select("window_id", F.lit(10).alias("k"), F.lit(5).alias("k_min")).where("window_id is not null").distinct()),
    "segment_news": lambda s, d: _r6(events.segment_news(nodes(s, d), _kb(s, d)), "mu"),
    "segment_news_lm": lambda s, d: _r6(lm_score(nodes(s, d)), "score"),
    "event_news": lambda s, d: _r6(_news(s, d), "mu_e"),
    "event_news_last_n": lambda s, d: _r6(_news(s, d, 2), "mu_e"),
    "window_max_news": lambda s, d: _r6(events.window_max_news(_news(s, d)), "mu_x"),
    "window_max_news_last_n": lambda s, d: _r6(events.window_max_news(_news(s, d, 2)), "mu_x"),
    "realistic_events": lambda s, d: _r6(events.realistic_events(_news(s, d), 15.0), "mu_e", "mu_x").select("window_id", "cluster", "mu_e", "mu_x"),
    "realistic_events_last_2": lambda s, d: _r6(events.realistic_events(_news(s, d, 2), 500.0, strict=False), "mu_e", "mu_x").select("window_id", "cluster", "mu_e", "mu_x"),
    "realistic_topk": lambda s, d: _r6(events.realistic_topk(_news(s, d), 15.0, 5), "mu_e").select("window_id", "cluster", "mu_e", "rank"),
    "event_title": _titles,
    "describe_events": lambda s, d: _titles(s, d),
    "describe_events_last_2": lambda s, d: _titles(s, d, 2),
    "related_posts": _related,
    "post_event_ids": lambda s, d: _ids(s, d).select("window_id", "post_id", F.array_join(F.transform("events", lambda x: x.cast("string")), ",").alias("events")),
    "post_event_labels": lambda s, d: events.post_event_labels(posts(s, d), _ids(s, d)),
}

_KNN = f"""WITH RECURSIVE {POSTS_SQL}, {SEGMENTS_SQL}, {EDGES_SQL}, {NODES_SQL}, dirs AS (SELECT window_id, a, b, w FROM edges WHERE w > 0 UNION ALL SELECT window_id, b, a, w FROM edges WHERE w > 0),
near AS (SELECT window_id, a, b, row_number() OVER (PARTITION BY window_id, a ORDER BY w DESC, b DESC) AS rank FROM dirs QUALIFY rank <= {K}),
mutual AS (SELECT window_id, least(a, b) AS a, greatest(a, b) AS b FROM near GROUP BY window_id, least(a, b), greatest(a, b) HAVING count(*) = 2),
shared AS (SELECT m.window_id, m.a, m.b, count(*)::INT AS shared FROM mutual m JOIN near x ON x.window_id = m.window_id AND x.a = m.a JOIN near y ON y.window_id = m.window_id AND y.a = m.b AND y.b = x.b GROUP BY ALL HAVING count(*) >= {K_MIN}),
links AS (SELECT window_id, a, b FROM shared UNION SELECT window_id, b, a FROM shared),
reach AS (SELECT window_id, node, node AS label FROM nodes UNION SELECT r.window_id, l.b AS node, r.label FROM reach r JOIN links l ON l.window_id = r.window_id AND l.a = r.node AND l.b > r.label),
jp AS (SELECT window_id, node, min(label) AS cluster FROM reach GROUP BY ALL),
noisy AS (SELECT window_id, node, CASE WHEN count(*) OVER (PARTITION BY window_id, cluster) > 1 THEN cluster ELSE -1 END AS cluster FROM jp),
clusters AS (SELECT c.*, seg_text FROM noisy c JOIN nodes USING (window_id, node) WHERE cluster <> -1),
pp AS (SELECT DISTINCT seg_text, post_id FROM segs), kb AS (SELECT seg_text, count(*)::DOUBLE / (SELECT count(*) FROM posts) AS q FROM pp GROUP BY seg_text),
words AS (SELECT DISTINCT seg_text, unnest(string_split(seg_text, ' ')) AS word FROM nodes), news AS (SELECT w.seg_text, greatest(0.0, max(exp(coalesce(q, 0.0)))) - 1 AS mu FROM words w LEFT JOIN kb ON kb.seg_text = w.word GROUP BY w.seg_text),
inner_w AS (SELECT e.window_id, x.cluster, 2 * sum(w) AS weight FROM edges e JOIN clusters x ON x.window_id = e.window_id AND x.node = e.a JOIN clusters y ON y.window_id = e.window_id AND y.node = e.b AND x.cluster = y.cluster GROUP BY ALL),
sized AS (SELECT window_id, cluster, count(*) AS n, sum(coalesce(mu, 0.0)) AS mu FROM clusters LEFT JOIN news USING (seg_text) GROUP BY ALL),
scored AS (SELECT s.window_id, s.cluster, n, (mu / n) * (coalesce(weight, 0.0) / n) AS mu_e FROM sized s LEFT JOIN inner_w i USING (window_id, cluster)),
best AS (SELECT *, max(mu_e) OVER (PARTITION BY window_id) AS mu_x FROM scored),
last2 AS (SELECT DISTINCT window_id FROM clusters ORDER BY window_id DESC LIMIT 2),
titled AS (SELECT window_id, cluster, seg_text, row_number() OVER (PARTITION BY window_id, cluster ORDER BY exp(coalesce(q, 0.0)) DESC, seg_text DESC) AS r FROM clusters LEFT JOIN kb USING (seg_text)),
titles AS (SELECT window_id, cluster, string_agg(seg_text, ' | ' ORDER BY r) AS title FROM titled WHERE r <= 5 GROUP BY ALL),
related AS (SELECT c.window_id, c.cluster, s.post_id, min(c.node) AS first_member FROM segs s JOIN clusters c USING (window_id, seg_text) GROUP BY ALL),
numbered AS (SELECT window_id, cluster, row_number() OVER (PARTITION BY window_id ORDER BY cluster) AS event_ord FROM (SELECT DISTINCT window_id, cluster FROM clusters)),
ids AS (SELECT r.window_id, post_id, string_agg(event_ord::VARCHAR, ',' ORDER BY event_ord) AS events FROM related r JOIN numbered USING (window_id, cluster) GROUP BY ALL)
"""
_RATIO = "CASE WHEN mu_e = 0 THEN {0} ELSE mu_x / mu_e END"
_SIL = """, top AS (SELECT window_id, max(w) AS top FROM edges GROUP BY window_id), sizes AS (SELECT window_id, cluster, count(*) AS size FROM noisy GROUP BY ALL),
eb AS (SELECT window_id, a, b, w FROM edges UNION ALL SELECT window_id, b, a, w FROM edges), pulls AS (SELECT e.window_id, a, n.cluster AS other, sum(w) AS pull FROM eb e JOIN noisy n ON n.window_id = e.window_id AND n.node = e.b GROUP BY ALL),
g AS (SELECT n.window_id, n.node, n.cluster, s.cluster AS other, s.size, s.size - (s.cluster = n.cluster)::INT AS others, coalesce(pull, 0.0) AS pull, coalesce(top, 0.0) AS top FROM noisy n JOIN sizes s ON s.window_id = n.window_id LEFT JOIN pulls p ON p.window_id = n.window_id AND p.a = n.node AND p.other = s.cluster LEFT JOIN top t ON t.window_id = n.window_id),
d AS (SELECT *, CASE WHEN others > 0 THEN (others * top - pull) / others END AS mean FROM g), p AS (SELECT window_id, node, max(mean) FILTER (cluster = other) AS x, min(mean) FILTER (cluster <> other) AS y, max(size) FILTER (cluster = other) AS n FROM d GROUP BY ALL),
v AS (SELECT window_id, avg(CASE WHEN n = 1 THEN 0.0 ELSE coalesce((y - x) / nullif(greatest(x, y), 0), 0.0) END) AS s, count(*) AS nodes FROM p GROUP BY ALL), c AS (SELECT window_id, count(*) AS clusters FROM sizes GROUP BY ALL)
SELECT window_id, round(CASE WHEN clusters = 1 OR clusters = nodes THEN -1.0::DOUBLE ELSE s END, 6) AS silhouette FROM v JOIN c USING (window_id)"""
SQL = {
    "knn": _KNN + "SELECT window_id, a, b, rank FROM near",
    "mutual_knn": _KNN + "SELECT * FROM mutual",
    "shared_neighbors": _KNN + "SELECT * FROM shared",
    "jarvis_patrick": _KNN + "SELECT * FROM jp",
    "noise_clusters": _KNN + "SELECT * FROM noisy",
    "cluster_fixed": _KNN.replace(f">= {K_MIN})", f">= {FIXED_MIN})") + "SELECT * FROM noisy WHERE cluster <> -1",
    "silhouette": _KNN.rstrip() + _SIL,
    "segment_news": _KNN + "SELECT seg_text, round(mu, 6) AS mu FROM news",
    "segment_news_lm": "SELECT DISTINCT seg_text, round(list_min(list_transform(string_split(seg_text, ' '), lambda x: length(x))) / list_max(list_transform(string_split(seg_text, ' '), lambda x: length(x))), 6) AS score FROM graphnodes",
    "event_news": _KNN + "SELECT window_id, cluster, n, round(mu_e, 6) AS mu_e FROM scored",
    "event_news_last_n": _KNN + "SELECT window_id, cluster, n, round(mu_e, 6) AS mu_e FROM scored WHERE window_id IN (FROM last2)",
    "window_max_news": _KNN + "SELECT window_id, round(max(mu_e), 6) AS mu_x FROM scored GROUP BY window_id",
    "window_max_news_last_n": _KNN + "SELECT window_id, round(max(mu_e), 6) AS mu_x FROM scored WHERE window_id IN (FROM last2) GROUP BY window_id",
    "realistic_events": _KNN + f"SELECT window_id, cluster, round(mu_e, 6) AS mu_e, round(mu_x, 6) AS mu_x FROM best WHERE {_RATIO.format('15.0')} < 15.0",
    "realistic_events_last_2": _KNN + f"SELECT window_id, cluster, round(mu_e, 6) AS mu_e, round(mu_x, 6) AS mu_x FROM best WHERE {_RATIO.format('500.0')} <= 500.0 AND window_id IN (FROM last2)",
    "realistic_topk": _KNN + f"SELECT window_id, cluster, round(mu_e, 6) AS mu_e, row_number() OVER (PARTITION BY window_id ORDER BY best.mu_e DESC, cluster DESC) AS rank FROM best WHERE {_RATIO.format('15.0')} < 15.0 QUALIFY rank <= 5",
    "event_title": _KNN + "SELECT * FROM titles",
    "describe_events": _KNN + "SELECT * FROM titles",
    "describe_events_last_2": _KNN + "SELECT * FROM titles WHERE window_id IN (FROM last2)",
    "related_posts": _KNN + "SELECT * FROM related",
    "post_event_ids": _KNN + "SELECT * FROM ids",
    "post_event_labels": _KNN + "SELECT p.window_id, p.post_id, coalesce(events, '0') AS label FROM posts p LEFT JOIN ids USING (window_id, post_id)",
}
