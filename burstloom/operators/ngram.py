"""N-gram counts and the cohesion ("stickiness") of word sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the sum of 1-gram counts of the reference corpus
CORPUS_MASS = 99_603_396.0
MAX_WORDS = 5


def build_ngrams(segs: DataFrame, top: int = MAX_WORDS) -> DataFrame:
    """(n, seg_text, cnt): counts of all word sequences of up to ``top`` words within the given texts."""
    ws = segs.select(F.split("seg_text", " ").alias("ws"))
    spans = ws.select("ws", F.posexplode("ws").alias("i", "_w")).select("ws", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(top), F.size("ws") - F.col("i")))).alias("n"))
    grams = spans.select("n", F.array_join(F.slice("ws", F.col("i") + 1, F.col("n")), " ").alias("seg_text"))
    return grams.groupBy("n", "seg_text").agg(F.count("*").alias("cnt"))


def lookup(texts: DataFrame, grams: DataFrame, column: str) -> DataFrame:
    """``texts`` with the n-gram value of its distinct ``seg_text``; unseen, empty or longer than five words gives 0."""
    n_words = F.size(F.split("seg_text", " "))
    value = F.when((n_words > MAX_WORDS) | (F.col("seg_text") == ""), 0.0).otherwise(F.coalesce(F.col(column), F.lit(0.0)))
    return texts.join(grams.select("seg_text", column), "seg_text", "left").withColumn(column, value)


def conditional(grams: DataFrame) -> DataFrame:
    """(seg_text, cprob): the count of a sequence over that of its words but the last; of one word over the corpus mass."""
    ws = F.split("seg_text", " ")
    head = F.when(F.size(ws) > 1, F.array_join(F.slice(ws, F.lit(1), F.size(ws) - 1), " "))
    g = grams.select("seg_text", "cnt", head.alias("head"))
    heads = grams.select(F.col("seg_text").alias("head"), F.col("cnt").alias("head_cnt"))
    base = F.when(F.col("head").isNull(), F.lit(CORPUS_MASS)).otherwise(F.col("head_cnt"))
    return g.join(heads, "head", "left").select("seg_text", F.coalesce(F.try_divide("cnt", base), F.lit(0.0)).alias("cprob"))


def splits(texts: DataFrame) -> DataFrame:
    """(seg_text, n, pre, suf): every way to part a sequence in two; a single word has none (pre and suf are null)."""
    ws = F.split("seg_text", " ")
    t = texts.select("seg_text").distinct().withColumn("ws", ws).withColumn("n", F.size("ws"))
    cut = t.withColumn("i", F.explode_outer(F.when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n") - 1))))
    return cut.select("seg_text", "n", F.array_join(F.slice("ws", F.lit(1), F.col("i")), " ").alias("pre"), F.array_join(F.slice("ws", F.col("i") + 1, F.col("n") - F.col("i")), " ").alias("suf"))


def split_products(texts: DataFrame, grams: DataFrame, column: str) -> DataFrame:
    """(seg_text, n, f, products): a sequence's value and the sum of the products of its two parts over all splits."""
    g = grams.select("seg_text", F.col(column).cast("double").alias("v"))
    parts = splits(texts)
    with_pre = parts.join(g.select(F.col("seg_text").alias("pre"), F.col("v").alias("vp")), "pre", "left")
    with_both = with_pre.join(g.select(F.col("seg_text").alias("suf"), F.col("v").alias("vs")), "suf", "left")
    sums = with_both.groupBy("seg_text", "n").agg(F.sum(F.coalesce("vp", F.lit(0.0)) * F.coalesce("vs", F.lit(0.0))).alias("products"))
    return sums.join(g.withColumnRenamed("v", "f"), "seg_text", "left").withColumn("f", F.coalesce("f", F.lit(0.0)))


def scp_simple(f: Column, n: Column, products: Column, mass: float = CORPUS_MASS) -> Column:
    m = products / (n - 1)
    one = 2 * f * f / (f * f + F.lit(mass) * F.lit(mass))
    return F.when(n == 1, one).when((f == 0) & (products == 0), 2.0).otherwise(F.try_divide(2 * f * f, f * f + m))


def pmi_simple(f: Column, n: Column, products: Column, mass: float = CORPUS_MASS) -> Column:
    m = products / (n - 1)
    return F.when(n == 1, f / (F.lit(mass) + f)).when((f == 0) & (products == 0), 1.0).otherwise(F.try_divide(f * mass, f * mass + m))


def pmi_exact(p: Column, n: Column, products: Column) -> Column:
    """Sigmoid of the pointwise mutual information; the mean of the products is taken over n."""
    m = products / n
    value = F.when(n == 1, F.when(p == 0, 0.0).otherwise(F.log(p))).when(p == 0, F.lit(float("-inf"))).when(m == 0, F.lit(float("inf"))).otherwise(F.log(p / m))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def scp_exact(p: Column, n: Column, products: Column) -> Column:
    m = products / (n - 1)
    value = F.when(n == 1, F.when(p == 0, 0.0).otherwise(2 * F.log(p))).when((m == 0) | (p == 0), 0.0).otherwise(F.log(p * p / m))
    return F.lit(2.0) / (F.lit(1.0) + F.exp(-value))


def length_norm(n: Column) -> Column:
    return F.when(n == 1, 1.0).otherwise((n - 1) / n)


def kb_from_posts(segs: DataFrame, posts: DataFrame) -> DataFrame:
    """(seg_text, anchor_q, title_q): stand-ins of a knowledge base. The share of posts that hold the segment, and the share that open with it."""
    total = posts.agg(F.count("*").cast("double").alias("total"))
    per_post = segs.groupBy("seg_text", "post_id").agg(F.min("pos").alias("first"))
    held = per_post.groupBy("seg_text").agg(F.count("*").alias("n"), F.count_if(F.col("first") == 0).alias("opens"))
    return held.join(F.broadcast(total)).select("seg_text", (F.col("n") / F.col("total")).alias("anchor_q"), (F.col("opens") / F.col("total")).alias("title_q"))


def stickiness(texts: DataFrame, grams: DataFrame, kb: DataFrame | None, flag: str = "scp") -> DataFrame:
    """(seg_text, score): length norm x cohesion x e^q; an empty text scores 0. Every distinct text is scored once."""
    parts = split_products(texts, grams, "cnt")
    c = (pmi_simple if flag == "pmi" else scp_simple)(F.col("f"), F.col("n"), F.col("products"))
    q = F.lit(0.0)
    if kb is not None:
        parts = parts.join(kb.select("seg_text", "anchor_q"), "seg_text", "left")
        q = F.coalesce("anchor_q", F.lit(0.0))
    return parts.select("seg_text", F.when(F.col("seg_text") == "", 0.0).otherwise(length_norm(F.col("n")) * c * F.exp(q)).alias("score"))


Scorer = Callable[[list[str]], list[float]]


def length_scorer(texts: list[str]) -> list[float]:
    """A deterministic stand-in for a language model: the more even the word lengths, the higher."""
    out = []
    for t in texts:
        ns = [len(w) for w in t.split(" ")] if t else []
        out.append(min(ns) / max(ns) if ns and max(ns) else 0.0)
    return out


def lm_score(texts: DataFrame, scorer: Scorer = length_scorer) -> DataFrame:
    """(seg_text, score) of the distinct texts by a scorer that each task loads once; distinct-then-join replaces a score cache."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(scorer(s.fillna("").tolist()), dtype="float64")

    return texts.select("seg_text").distinct().withColumn("score", F.pandas_udf(run, "double")(F.col("seg_text")))


def stickiness_lm(texts: DataFrame, scorer: Scorer = length_scorer) -> DataFrame:
    return lm_score(texts, scorer).select("seg_text", (length_norm(F.size(F.split("seg_text", " "))) * F.col("score")).alias("score"))
