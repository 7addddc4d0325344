"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstloom.llm import components, consistent, distinctive, frequency, garbled, leaks, mixing, neardup, reading
from burstloom.session import materialise
from burstloom.sources.readers import table

#: folder of the public tokenizers and the model used for sizes
TOKENIZERS = os.environ.get("BURSTLOOM_TOKENIZERS", "/opt/tokenizers")
SIZE_MODEL = "piece_bpe_32k.model"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of posts that look the same and are stored differently."""
    posts = table(spark, sf_dir, "alldata").select("seq", "posts_windowing", "loaded_at")
    classes = materialise(consistent.lookalike_classes(posts, "seq", "posts_windowing", "loaded_at"))
    return consistent.lookalike_pairs(classes, "seq")


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "alldata").select("seq", "posts_windowing", "loaded_at")


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    posts = _posts(spark, sf_dir)
    bad = materialise(garbled.garbled_rows(posts, "seq", "posts_windowing", "loaded_at", restoring=False).select("seq"))
    return neardup.near_duplicates(posts, "seq", "posts_windowing", "loaded_at", leave_out=bad)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of posts with at least 70 % of their distinct words in common."""
    return neardup.all_pairs(*_near(spark, sf_dir), "seq")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post with its class of equal word sets, its links and its group."""
    return neardup.duplicate_groups(*_near(spark, sf_dir), "seq")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with garbled text."""
    return garbled.garbled_rows(_posts(spark, sf_dir), "seq", "posts_windowing", "loaded_at", restoring=False).select("seq")


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected posts with their restored text, null where characters are lost."""
    return garbled.garbled_rows(_posts(spark, sf_dir), "seq", "posts_windowing", "loaded_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tied node with the smallest node of its group."""
    return components.segment_groups(table(spark, sf_dir, "similaritygraph"))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, posts and mark of every distinct segment."""
    rows = table(spark, sf_dir, "postsegments").select("seq", "pos", "current_segment")
    return frequency.term_frequencies(rows, "seq", "pos", "current_segment").withColumnsRenamed({"term": "current_segment", "records": "posts"})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments marked rare or common."""
    return p5_counts(spark, sf_dir).where("mark is not null").select("current_segment", "mark")


def _window_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "alldata").select("seq", "window_num")
    rows = table(spark, sf_dir, "postsegments").select("seq", "pos", "current_segment")
    return materialise(distinctive.record_terms(posts, rows, "seq", "window_num", "pos", "current_segment"))


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every segment of at least three posts in every window, with the counts it rests on."""
    scored = distinctive.distinctiveness(_window_terms(spark, sf_dir)).withColumn("score", F.round("score", 8))
    return scored.withColumnsRenamed({"record": "window_num", "term": "current_segment"})


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments that stand for one window."""
    return distinctive.standing_terms(_window_terms(spark, sf_dir)).select(F.col("record").alias("window_num"), F.col("term").alias("current_segment"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with twelve consecutive words of a test item."""
    return leaks.leaked_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "evalitems"))


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, table(spark, sf_dir, "mixtargets"), f"{TOKENIZERS}/{SIZE_MODEL}")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that cannot reach their share."""
    return _mix(spark, sf_dir).report().where("missing > 0").select("source")


def p9_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with sizes in blank-separated words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, table(spark, sf_dir, "mixtargets"), None).report().where("missing > 0").select("source")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mix(spark, sf_dir).report()


def p9_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with whole copies of a text as one document of all their sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, table(spark, sf_dir, "mixtargets"), f"{TOKENIZERS}/{SIZE_MODEL}", copies_of="doc_id").report()


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix with their uses."""
    return _mix(spark, sf_dir).select("doc_id")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return reading.reading_levels(docs, reading.train(docs, table(spark, sf_dir, "doclevels")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ungraded documents at the top level."""
    graded = table(spark, sf_dir, "doclevels").select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    return p10_levels(spark, sf_dir).where("level = 5").join(graded, "doc_id", "left_anti").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p3_found, p3_groups, p4_found, p5_counts, p5_found, p6_found, p6_restored, p7_scores, p7_found, p8_found, p9_found, p9_words, p9_report, p9_texts, p9_mix, p10_levels, p10_found)}


_SEGS = "WITH once AS (SELECT seq, pos, min(current_segment) AS seg FROM postsegments WHERE current_segment <> '' AND seq IS NOT NULL GROUP BY seq, pos)"
_P5 = _SEGS + """, c AS (SELECT seg AS current_segment, count(*) AS occurrences, count(DISTINCT seq) AS posts FROM once GROUP BY seg), t AS (SELECT count(DISTINCT seq) AS total FROM once),
m AS (SELECT c.*, CASE WHEN posts < 3 THEN 'rare' WHEN posts / total > 0.05 THEN 'common' END AS mark FROM c, t)"""
_P7 = _SEGS + """, home AS (SELECT seq, min(window_num) AS w FROM alldata WHERE seq IS NOT NULL AND window_num IS NOT NULL GROUP BY seq), c AS (SELECT w, seg, count(*) AS occurrences, count(DISTINCT seq) AS posts FROM once JOIN home USING (seq) GROUP BY w, seg),
z AS (SELECT *, sum(occurrences) OVER (PARTITION BY seg)::DOUBLE / sum(occurrences) OVER () AS pa, sum(occurrences) OVER (PARTITION BY w) AS size, sum(posts) OVER (PARTITION BY seg)::BIGINT AS term_posts FROM c),
y AS (SELECT w AS window_num, seg AS current_segment, occurrences, posts, term_posts, pa, (occurrences + 2000.0::DOUBLE * pa) / (size + 2000.0::DOUBLE) AS pr FROM z)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """WITH RECURSIVE e AS (SELECT DISTINCT node_a AS a, node_b AS b FROM similaritygraph WHERE weight IS NOT NULL AND NOT isnan(weight) AND weight >= 0.6 AND node_a <> node_b),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS node, a AS label FROM d UNION SELECT d.b AS node, r.label FROM r JOIN d ON d.a = r.node AND d.b > r.label)
SELECT node AS node_id, min(label) AS group_id FROM r GROUP BY node""",
        "p5_counts": _P5 + " SELECT current_segment, occurrences, posts, mark FROM m",
        "p5_found": _P5 + " SELECT current_segment, mark FROM m WHERE mark IS NOT NULL",
        "p7_scores": _P7 + " SELECT window_num, current_segment, occurrences, posts, term_posts, round(pr * ln(pr / pa), 8) AS score FROM y WHERE term_posts >= 3",
        "p9_words": """WITH w AS (SELECT source, sum(coalesce(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')), 0)) AS n FROM documents GROUP BY source), t AS (SELECT sum(n) AS t FROM w)
SELECT m.source FROM (SELECT source, sum(target_share) AS s, max(max_repeat) AS r FROM mixtargets GROUP BY source) m LEFT JOIN w USING (source), t WHERE coalesce(w.n, 0) * r < ceil(s * t)""",
        "p7_found": _P7 + " SELECT window_num, current_segment FROM y WHERE posts >= 5 AND posts >= 0.8 * term_posts",
    }
