"""Queries of sources, sinks and text scalars, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from burstloom.functions import text as T
from burstloom.operators import events, tagging
from burstloom.operators.packed import packed_labels
from burstloom.plans import eval_queries, event_queries
from burstloom.session import scratch
from burstloom.sources import io
from burstloom.sources.readers import table
from burstloom.sources.views import POSTS_SQL, SEGMENTS_SQL, nodes, posts, segments

_START, _END = "2017-01-02 00:00:00", "2017-01-20 00:00:00"
_NORMAL_SQL = "translate(regexp_replace({0}, '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}\\x{{06D6}}\\x{{06DA}}\\x{{06E5}}\\x{{06ED}}\\x{{0640}}]', '', 'g'), '" + T.FOLD_FROM + "' || chr(8204), '" + T.FOLD_TO + " ')"
STOP_LIST = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TYPE_SQL = """CASE WHEN regexp_matches({0}, '^[0-9۰-۹]+$') THEN 'Integer' WHEN regexp_matches({0}, '^[A-Za-z]+$') THEN 'EnglishWord'
  WHEN regexp_matches({0}, '^[آ-یءأؤئ]+$') THEN 'PersianWord' WHEN regexp_matches({0}, '^[آ-یءأؤئ]+(‌[آ-یءأؤئ]+)+$') THEN 'CompoundWord' ELSE 'Other' END"""
_SPLIT_SQL = "regexp_split_to_array(regexp_replace(text, '[.!؟?,،؛;:|]', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+')"


def _lines(spark, sf):
    """(doc_id, line_no, tokens): every line of the documents, normalised, without stop words and tokenised."""
    lines = io.text_lines(table(spark, sf, "documents"), "doc_id", "text")
    tokens = T.tokenize(T.remove_stopwords(T.normalize_text(F.col("line"))))
    return lines.select("doc_id", "line_no", F.array_join(tokens, " ").alias("tokens"))


def _gold(spark, sf):
    gold = table(spark, sf, "gldn_std")
    lists = io.gold_labels(gold, packed_labels(gold, "gold_id", ["gold_class", "gold_cluster"]))
    return lists.select("gold_id", "sample", F.array_join("classes", " | ").alias("classes"), F.array_join("clusters", " | ").alias("clusters"))


def _sheets(spark, df, name, schema):
    """``df`` written as one sheet per window and read again."""
    path = scratch(spark, name)
    io.write_sheets(df.where("window_id is not null"), path)
    return io.read_sheets(spark, path, schema)


def _labels_sheet(spark, sf):
    labels = event_queries.QUERIES["post_event_labels"](spark, sf).select("window_id", F.col("post_id").alias("sequence"), F.col("label").alias("event_number"))
    return _sheets(spark, labels, "labels", "sequence long, event_number string, window_id int").select("window_id", "sequence", "event_number")


def _grid_sheet(spark, sf):
    order = F.row_number().over(Window.partitionBy("window_id").orderBy("k", "k_min"))
    grid = event_queries.QUERIES["cluster_grid_range"](spark, sf).select("window_id", order.alias("ordinal"), "k", "k_min", F.col("silhouette").alias("metric"))
    return _sheets(spark, grid, "grid", "ordinal int, k int, k_min int, metric double, window_id int").select("window_id", "ordinal", "k", "k_min", "metric")


def _topics_sheet(spark, sf):
    """(window_id, rank, topic): the titles of the best realistic events of every window."""
    top = events.realistic_topk(event_queries._news(spark, sf), 15.0, 5).select("window_id", "rank", "cluster")
    topics = top.join(event_queries._titles(spark, sf).withColumnRenamed("title", "topic"), ["window_id", "cluster"]).select("window_id", "rank", "topic")
    return _sheets(spark, topics, "topics", "rank int, topic string, window_id int").select("window_id", "rank", "topic")


def _report(spark, sf):
    """The lines of the entropy trace: group, weighted entropy, samples and the order in which labels were resolved."""
    traced = eval_queries.QUERIES["entropy_verbose"](spark, sf)
    path = scratch(spark, "report")
    traced.select(F.format_string("%s: %.6f over %d | %s", "group", "h", "n", "trace").alias("value")).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


QUERIES = {
    "scan_posts": lambda s, d: io.scan_posts(table(s, d, "rawposts"), _START, _END).select("seq", "date_sent", "from_id", "window_num"),
    "parse_post_json": lambda s, d: io.parse_post_json(table(s, d, "rawposts")).select("seq", F.array_join("tokens", " ").alias("tokens"), F.array_join("types", " ").alias("types")),
    "null_default": lambda s, d: posts(s, d).select("post_id", io.null_default("deleted").alias("deleted")),
    "run_windows": lambda s, d: io.run_windows(posts(s, d).where("sent_at is not null and window_id is not null")),
    "scan_text_lines": _lines,
    "scan_npy": lambda s, d: posts(s, d).select("post_id", "text", F.size("types").alias("n_types"), "user_id", "window_id"),
    "scan_xls_gold": _gold,
    "scan_xls_window": lambda s, d: io.gold_windows(table(s, d, "gldn_std")).select("window_id", "gold_id", "ordinal", "sample"),
    "sink_checkpoint": lambda s, d: io.checkpoint_stage(segments(s, d)).select("post_id", "pos", "seg_text"),
    "sink_labels_xls": _labels_sheet,
    "sink_grid_xls": _grid_sheet,
    "sink_topics_xls": _topics_sheet,
    "sink_report_txt": _report,
    "slice_windows": lambda s, d: io.slice_windows(table(s, d, "alldata"), 12, 20).select("seq", "window_num", "loaded_at"),
    "normalize_text": lambda s, d: posts(s, d).select("post_id", T.normalize_text(F.col("text")).alias("text")),
    "remove_stopwords": lambda s, d: posts(s, d).select("post_id", T.remove_stopwords(F.col("text")).alias("text")),
    "tokenize": lambda s, d: posts(s, d).select("post_id", F.array_join(T.tokenize(F.col("text")), " ").alias("tokens")),
    "token_type": lambda s, d: segments(s, d).select("post_id", "pos", T.token_type(F.split("seg_text", " ")[0]).alias("kind")),
    "noise_filter": lambda s, d: segments(s, d).select("post_id", "pos", T.noise_free(F.col("seg_text")).alias("seg_text")).where("seg_text <> ''"),
    "bio_tags": lambda s, d: tagging.bio_tags(segments(s, d), nodes(s, d).select("seg_text", F.col("node").cast("int").alias("rank"))),
    "join_segments": lambda s, d: tagging.join_segments(segments(s, d)),
    "list_to_csv": lambda s, d: posts(s, d).select("post_id", T.list_to_csv(F.col("types")).alias("types")),
    "pseudo_doc": lambda s, d: tagging.pseudo_docs(segments(s, d)),
    "dedupe_beam": lambda s, d: tagging.dedupe_runs(segments(s, d)),
}

_JSON = "from_json(source_text, '{\"DocumentId\": \"BIGINT\", \"Sentences\": [{\"Tokens\": [{\"Token\": \"VARCHAR\", \"Type\": \"VARCHAR\", \"IsStopWord\": \"BOOLEAN\"}]}]}')"
SQL = {
    "scan_posts": f"SELECT seq, date_sent, from_id, window_num FROM rawposts WHERE source_text IS NOT NULL AND date_sent BETWEEN TIMESTAMP '{_START}' AND TIMESTAMP '{_END}'",
    "parse_post_json": f"""WITH d AS (SELECT seq, {_JSON} AS doc FROM rawposts WHERE json_valid(source_text)),
k AS (SELECT seq, list_filter(flatten(list_transform(doc.Sentences, lambda s: s.Tokens)), lambda t: NOT coalesce(t.IsStopWord, false) AND t.Type IN ('PersianWord', 'Integer', 'EnglishWord', 'CompoundWord')) AS kept FROM d WHERE doc.DocumentId = seq AND doc.Sentences IS NOT NULL)
SELECT seq, array_to_string(list_transform(kept, lambda t: t.Token), ' ') AS tokens, array_to_string(list_transform(kept, lambda t: t.Type), ' ') AS types FROM k""",
    "null_default": f"WITH {POSTS_SQL} SELECT post_id, coalesce(deleted, '') AS deleted FROM posts",
    "run_windows": f"""WITH {POSTS_SQL}, k AS (SELECT post_id, window_id, sent_at, coalesce((lag(window_id) OVER (ORDER BY sent_at, post_id DESC) <> window_id)::INT, 0) AS turn FROM posts WHERE sent_at IS NOT NULL AND window_id IS NOT NULL)
SELECT post_id, window_id, (sum(turn) OVER (ORDER BY sent_at, post_id DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM k""",
    "scan_text_lines": f"""WITH l AS (SELECT doc_id, (i - 1)::INT AS line_no, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i) WHERE trim(string_split(text, chr(10))[i], ' ') <> ''),
n AS (SELECT doc_id, line_no, {_NORMAL_SQL.format('line')} AS text FROM l), w AS (SELECT doc_id, line_no, array_to_string(list_filter({_SPLIT_SQL}, lambda w: w NOT IN ({STOP_LIST}) AND w <> ''), ' ') AS text FROM n)
SELECT doc_id, line_no, array_to_string(list_filter({_SPLIT_SQL}, lambda w: {_TYPE_SQL.format('w')} IN ('PersianWord', 'CompoundWord', 'Integer')), ' ') AS tokens FROM w""",
    "scan_npy": f"WITH {POSTS_SQL} SELECT post_id, text, len(types) AS n_types, user_id, window_id FROM posts",
    "scan_xls_window": """SELECT CASE WHEN ordinal < 94 THEN 14 WHEN ordinal < 150 THEN 15 WHEN ordinal < 508 THEN 16 ELSE 17 END AS window_id, gold_id, ordinal, sample
FROM (SELECT *, (row_number() OVER (ORDER BY gold_id) - 1)::INT AS ordinal FROM gldn_std)""",
    "sink_checkpoint": f"WITH {SEGMENTS_SQL} SELECT post_id, pos, seg_text FROM segs",
    "sink_labels_xls": "SELECT window_id, post_id AS sequence, label AS event_number FROM (" + event_queries.SQL["post_event_labels"] + ") WHERE window_id IS NOT NULL",
    "sink_topics_xls": "SELECT r.window_id, r.rank::INT AS rank, t.title AS topic FROM (" + event_queries.SQL["realistic_topk"] + ") r JOIN (" + event_queries.SQL["event_title"] + ") t USING (window_id, cluster)",
    "slice_windows": "SELECT seq, window_num, loaded_at FROM alldata WHERE window_num BETWEEN 12 AND 20",
    "normalize_text": f"WITH {POSTS_SQL} SELECT post_id, {_NORMAL_SQL.format('text')} AS text FROM posts",
    "remove_stopwords": f"WITH {POSTS_SQL} SELECT post_id, array_to_string(list_filter({_SPLIT_SQL}, lambda w: w NOT IN ({STOP_LIST}) AND w <> ''), ' ') AS text FROM posts",
    "tokenize": f"WITH {POSTS_SQL} SELECT post_id, array_to_string(list_filter({_SPLIT_SQL}, lambda w: {_TYPE_SQL.format('w')} IN ('PersianWord', 'CompoundWord', 'Integer')), ' ') AS tokens FROM posts",
    "token_type": f"WITH {SEGMENTS_SQL}, h AS (SELECT post_id, pos, string_split(seg_text, ' ')[1] AS w FROM segs) SELECT post_id, pos, {_TYPE_SQL.format('w')} AS kind FROM h",
    "noise_filter": f"""WITH {SEGMENTS_SQL} SELECT post_id, pos, seg_text FROM segs WHERE NOT (seg_text LIKE '%خخ%' OR seg_text LIKE '%ههه %' OR seg_text LIKE '%##%' OR seg_text = 'WORDorEXP'
OR len(list_filter(string_split(seg_text, ''), lambda c: NOT (c BETWEEN ' ' AND '_' OR c BETWEEN '۰' AND '۹' OR c = '~'))) = 0)""",
    "bio_tags": f"""WITH {SEGMENTS_SQL}, e AS (SELECT seg_text, min(node_id)::INT AS rank FROM graphnodes GROUP BY seg_text),
t AS (SELECT post_id, pos, coalesce(rank, 0) AS rank, string_split(seg_text, ' ') AS ws FROM segs LEFT JOIN e USING (seg_text))
SELECT post_id, pos, (i - 1)::INT AS word_no, ws[i] AS word, CASE WHEN rank = 0 THEN 'O' WHEN i = 1 THEN 'B' ELSE 'I' END AS tag, rank FROM t, unnest(range(1, len(ws) + 1)) AS u(i)""",
    "join_segments": f"WITH {SEGMENTS_SQL} SELECT post_id, string_agg(seg_text, ' ' ORDER BY pos) AS text FROM segs GROUP BY post_id",
    "list_to_csv": f"WITH {POSTS_SQL} SELECT post_id, array_to_string(types, ',') AS types FROM posts",
    "pseudo_doc": f"""WITH {SEGMENTS_SQL}, t AS (SELECT post_id, window_id, string_agg(seg_text, ' ' ORDER BY pos) AS text FROM segs GROUP BY post_id, window_id),
p AS (SELECT *, ((row_number() OVER (PARTITION BY window_id ORDER BY post_id) - 1) // 50)::BIGINT AS part FROM t) SELECT window_id, part, string_agg(text, ' ' ORDER BY post_id) AS doc FROM p GROUP BY window_id, part""",
    "dedupe_beam": f"WITH {SEGMENTS_SQL}, b AS (SELECT *, lag(seg_text) OVER (PARTITION BY post_id ORDER BY pos) AS before FROM segs) SELECT post_id, pos, seg_text FROM b WHERE before IS NULL OR before <> seg_text",
}
