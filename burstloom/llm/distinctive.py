"""Problem 7: how distinctive a term is for a record.

A record (here a time window) has a term distribution, smoothed with the distribution of the whole collection by a Dirichlet
prior of mass ``mu``. A term's score is its contribution to the relative entropy of the two:
p(t|record) * ln(p(t|record) / p(t)). Terms held by fewer than ``min_records`` posts in all are cut off.

Defined results: null and empty terms, and rows or posts without an id or window, are ignored; a row delivered twice (same
post and position) counts once; posts unknown to the post table are left out; an empty table gives no rows; extra
columns are ignored. Ties keep equal scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record_terms(posts: DataFrame, rows: DataFrame, post_id: str, record: str, position: str, term: str) -> DataFrame:
    """(record, term, occurrences, posts): how often each term occurs in a record and how many of its posts hold it.

    Rows and posts are brought together by post; everything up to the first partial count needs no other exchange, and only
    counts are moved after it.
    """
    home = posts.where(F.col(post_id).isNotNull() & F.col(record).isNotNull()).groupBy(F.col(post_id).alias("_p")).agg(F.min(record).alias("record"))
    kept = rows.where(F.col(term).isNotNull() & (F.col(term) != "") & F.col(post_id).isNotNull()).select(F.col(post_id).alias("_p"), F.col(position).alias("_i"), F.col(term).alias("term"))
    once = kept.join(home, "_p").groupBy("_p", "_i").agg(F.min("term").alias("term"), F.first("record").alias("record"))
    per_post = once.groupBy("_p", "term").agg(F.count("*").alias("n"), F.first("record").alias("record"))
    return per_post.groupBy("record", "term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("posts"))


def _contribution(p_record: Column, p_all: Column) -> Column:
    return p_record * F.log(p_record / p_all)


def distinctiveness(counts: DataFrame, mu: float = 2000.0, min_records: int = 3, of: str = "occurrences", standing: tuple[int, float] | None = None) -> DataFrame:
    """(record, term, occurrences, posts, term_posts, score) for the output of :func:`record_terms`.

    of: the counts that the distributions are taken over, ``occurrences`` or ``posts``. Terms are summed up before they are joined to their
    records, so a term that every record has is one row where it is added up, and only terms over the cutoff are joined.

    standing: with (posts, share) there is also ``least``, the score that the term would have if the record held it in the least number of
    posts that lets it stand for the record.
    """
    terms = counts.groupBy("term").agg(F.sum(of).alias("term_size"), F.sum("posts").alias("term_posts")).where(F.col("term_posts") >= min_records)
    sizes = counts.groupBy("record").agg(F.sum(of).alias("record_size"))
    total = counts.agg(F.sum(of).alias("total"))
    # one row
    full = counts.join(terms, "term").join(sizes, "record").join(F.broadcast(total))
    p_all = F.col("term_size") / F.col("total")
    smoothed = lambda n: (n + mu * p_all) / (F.col("record_size") + mu)
    out = full.withColumn("score", _contribution(smoothed(F.col(of)), p_all))
    if standing is None:
        return out.select("record", "term", "occurrences", "posts", "term_posts", "score")
    least = F.greatest(F.lit(float(standing[0])), standing[1] * F.col("term_posts"))
    return out.select("record", "term", "occurrences", "posts", "term_posts", "score", _contribution(smoothed(least), p_all).alias("least"))


def standing_terms(counts: DataFrame, mu: float = 2000.0, min_posts: int = 5, min_share: float = 0.8) -> DataFrame:
    """(record, term, posts, term_posts, score): the terms that stand for one record.

    Scores are taken over posts, cut off under ``min_posts``. A term's score rises with the posts of the record that hold it once these are
    more than 1/e of what is expected, so every standing term scores at least what the least standing number of posts would give; those that do
    are checked on their counts, as a record with most of all posts lets others score as high.
    """
    scored = distinctiveness(counts, mu, min_posts, "posts", (min_posts, min_share))
    high = scored.where(F.col("score") >= F.col("least") - 1e-12 * (F.lit(1.0) + F.abs("least")))
    return high.where((F.col("posts") >= min_posts) & (F.col("posts") >= min_share * F.col("term_posts"))).select("record", "term", "posts", "term_posts", "score")
