"""Agreement of clusters with gold classes by entropy.

Samples carry one or more groups on both sides. Per group of the one side, samples that still have several labels on the other are
resolved greedily: the label with the largest remaining frequency (the first inserted of equal ones) is given to all samples that
have it, and their other labels are taken back; a group's entropy is weighed by its samples' shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_entropy(samples: Iterable[tuple[list[int], float]]) -> tuple[float, str]:
    """(weighted entropy of one group, trace) for its samples (labels, score 1/number of groups)."""
    rows = [(list(dict.fromkeys(labels)), score) for labels, score in samples if labels]
    frequency: dict[int, int] = {}
    for labels, _ in rows:
        for x in labels:
            frequency[x] = frequency.get(x, 0) + 1
    open_rows, scores, trace = list(range(len(rows))), {}, []
    while open_rows:
        best = max(frequency, key=lambda x: frequency[x])
        if frequency[best] <= 0:
            break
        taken = [i for i in open_rows if best in rows[i][0]]
        for i in taken:
            scores[best] = scores.get(best, 0.0) + rows[i][1]
            for x in rows[i][0]:
                frequency[x] -= 1
        open_rows = [i for i in open_rows if best not in rows[i][0]]
        trace.append(f"{best}:{len(taken)}")
    total = sum(scores.values())
    h = -sum(s * math.log2(s / total) for s in scores.values() if s > 0) if total else 0.0
    return h, " ".join(trace)


def entropy(samples: DataFrame, groups: str, labels: str, order: str | None = None) -> DataFrame:
    """(group, h, n, trace): the weighted entropy of each group of array column ``groups`` over the labels of array column ``labels``.

    Groups are resolved one by one over the counts of equal (labels, score) combinations, so a hot group comes in as a few counted rows.
    Labels are inserted in the order of the column ``order``, or in that of their texts.
    """
    per = samples.where((F.size(groups) > 0) & (F.size(labels) > 0)).select(F.explode(groups).alias("group"), F.col(labels).alias("labels"), (F.lit(1.0) / F.size(groups)).alias("score"), (F.col(order) if order else F.lit(0)).alias("at"))
    counted = per.groupBy("group", "labels", "score").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    kind = per.schema["group"].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(key=[",".join(map(str, x)) for x in pdf["labels"]]).sort_values(["at", "key", "score"])
        rows = [(list(x), float(s)) for x, s, n in zip(pdf["labels"], pdf["score"], pdf["n"], strict=True) for _ in range(int(n))]
        h, trace = group_entropy(rows)
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "h": [h], "n": [len(rows)], "trace": [trace]})

    return counted.groupBy("group").applyInPandas(solve, f"group {kind}, h double, n long, trace string")


def total_entropy(samples: DataFrame, groups: str, labels: str, order: str | None = None) -> DataFrame:
    """One row (entropy): the group entropies over the number of samples."""
    n = samples.where((F.size(groups) > 0) & (F.size(labels) > 0)).agg(F.count("*").alias("samples"))
    h = entropy(samples, groups, labels, order).agg(F.sum("h").alias("h"))
    return h.join(F.broadcast(n)).select(F.coalesce(F.try_divide("h", "samples"), F.lit(0.0)).alias("entropy"))


def single_entropy(samples: DataFrame, group: str, label: str) -> DataFrame:
    """(group, h, n) where every sample has one group and one label; plain aggregates."""
    counts = samples.where(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(group).alias("group"), F.col(label).alias("label")).agg(F.count("*").alias("c"))
    sums = counts.groupBy("group").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("clog"))
    return sums.select("group", (F.col("n") * F.log2("n") - F.col("clog")).alias("h"), "n")


def cluster_class_entropy(samples: DataFrame, cluster: str, klass: str) -> DataFrame:
    """One row (cluster_entropy, class_entropy, f): each side's entropy over the other, and their harmonic mean."""
    a = single_entropy(samples, cluster, klass).agg((F.sum("h") / F.sum("n")).alias("cluster_entropy"))
    b = single_entropy(samples, klass, cluster).agg((F.sum("h") / F.sum("n")).alias("class_entropy"))
    both = a.join(F.broadcast(b))
    c, k = F.col("cluster_entropy"), F.col("class_entropy")
    return both.withColumn("f", F.coalesce(F.try_divide(2 * c * k, c + k), F.lit(0.0)))


def multi_entropies(samples: DataFrame, clusters: str, classes: str, order: str | None = None) -> DataFrame:
    """One row (cluster_entropy, class_entropy, f) as :func:`cluster_class_entropy`, over array columns of several labels."""
    a = total_entropy(samples, clusters, classes, order).withColumnRenamed("entropy", "cluster_entropy")
    b = total_entropy(samples, classes, clusters, order).withColumnRenamed("entropy", "class_entropy")
    c, k = F.col("cluster_entropy"), F.col("class_entropy")
    return a.join(F.broadcast(b)).withColumn("f", F.coalesce(F.try_divide(2 * c * k, c + k), F.lit(0.0)))
