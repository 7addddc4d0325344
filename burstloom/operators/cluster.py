"""Shared-nearest-neighbour clustering of weighted graphs, all windows at once, and its quality.

Inputs: ``edges`` (window_id, a, b, w), undirected with a < b, and ``nodes`` (window_id, node). Node order is node number order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstloom.operators.grid import grid_silhouettes
from burstloom.session import materialise, release


def mirror(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select("window_id", F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def knn(edges: DataFrame, k: int) -> DataFrame:
    """(window_id, a, b, rank): the ``k`` heaviest neighbours with a positive weight; ties go to the later node."""
    order = Window.partitionBy("window_id", "a").orderBy(F.desc("w"), F.desc("b"))
    return mirror(edges.where("w > 0")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("window_id", "a", "b", "rank")


def mutual_knn(neighbours: DataFrame) -> DataFrame:
    """(window_id, a, b), a < b, that are in each other's list; one aggregate, no join."""
    pair = neighbours.select("window_id", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return pair.groupBy("window_id", "x", "y").agg(F.count("*").alias("n")).where("n = 2").select("window_id", F.col("x").alias("a"), F.col("y").alias("b"))


def shared_neighbors(neighbours: DataFrame, mutual: DataFrame, k_min: int) -> DataFrame:
    """(window_id, a, b, shared): mutual pairs with at least ``k_min`` common neighbours. Lists are at most k long."""
    lists = neighbours.groupBy("window_id", F.col("a").alias("node")).agg(F.collect_set("b").alias("near"))
    la = lists.select("window_id", F.col("node").alias("a"), F.col("near").alias("na"))
    lb = lists.select("window_id", F.col("node").alias("b"), F.col("near").alias("nb"))
    counted = mutual.join(la, ["window_id", "a"]).join(lb, ["window_id", "b"]).withColumn("shared", F.size(F.array_intersect("na", "nb")))
    return counted.where(F.col("shared") >= k_min).select("window_id", "a", "b", "shared")


def min_labels(nodes: DataFrame, links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(window_id, node, label): the smallest node of each component.

    Every round a node takes the smallest label among its neighbours and then the label of its label, so chains shorten
    geometrically; a round is a table in the shared folder.
    """
    both = materialise(links.select("window_id", "a", "b").unionByName(links.select("window_id", F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = materialise(nodes.select("window_id", "node", F.col("node").alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.select("window_id", F.col("node").alias("b"), "label"), ["window_id", "b"]).groupBy("window_id", F.col("a").alias("node")).agg(F.min("label").alias("m"))
        lower = labels.join(near, ["window_id", "node"], "left").select("window_id", "node", "label", F.least("label", F.coalesce("m", "label")).alias("new"))
        jump = lower.select("window_id", F.col("node").alias("new"), F.col("new").alias("next"))
        following = materialise(lower.join(jump, ["window_id", "new"]).select("window_id", "node", F.least("new", "next").alias("label"), (F.least("new", "next") != F.col("label")).alias("moved")))
        moved = following.where("moved").limit(1).count()
        release(labels)
        labels = following
        if not moved:
            return labels.select("window_id", "node", "label")
    raise RuntimeError(f"labels not stable after {max_rounds} rounds")


def jarvis_patrick(nodes: DataFrame, edges: DataFrame, k: int, k_min: int, neighbours: DataFrame | None = None) -> DataFrame:
    """(window_id, node, cluster): clusters of mutual k-nearest neighbours that share at least k_min of them; the label is the lowest node."""
    if k_min > k:
        raise ValueError("k_min must not exceed k")
    near = knn(edges, k) if neighbours is None else neighbours.where(F.col("rank") <= k)
    links = shared_neighbors(near, mutual_knn(near), k_min)
    return min_labels(nodes, links).withColumnRenamed("label", "cluster")


def noise_clusters(clusters: DataFrame) -> DataFrame:
    """Adds -1 as the cluster of nodes that are alone."""
    size = F.count("*").over(Window.partitionBy("window_id", "cluster"))
    return clusters.withColumn("size", size).select("window_id", "node", F.when(F.col("size") > 1, F.col("cluster")).otherwise(F.lit(-1).cast("long")).alias("cluster"))


def cluster_fixed(nodes: DataFrame, edges: DataFrame, k: int = 15, k_min: int = 6) -> DataFrame:
    """Clusters without noise."""
    return noise_clusters(jarvis_patrick(nodes, edges, k, k_min)).where("cluster <> -1")


def silhouette(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(window_id, silhouette): the mean silhouette of labelled nodes by the distance ``max w - w`` (a missing edge weighs 0).

    The sum of distances from a node to a cluster is its size times max w minus the edge weights into it, so only edges and
    cluster sizes are needed and never all pairs. Distances to the node itself are left out; a node alone has 0; windows with one cluster or
    with only single nodes have -1.
    """
    top = edges.groupBy("window_id").agg(F.max("w").alias("top"))
    sizes = labels.groupBy("window_id", "cluster").agg(F.count("*").alias("size"))
    into = mirror(edges).join(labels.select("window_id", F.col("node").alias("b"), F.col("cluster").alias("other")), ["window_id", "b"]).groupBy("window_id", "a", "other").agg(F.sum("w").alias("pull"))
    mine = labels.select("window_id", F.col("node").alias("a"), "cluster")
    # clusters per window are few; a node meets each of them once
    grid = mine.join(sizes.withColumnRenamed("cluster", "other"), "window_id").join(into, ["window_id", "a", "other"], "left").join(top, "window_id", "left")
    own = F.col("cluster") == F.col("other")
    others = F.col("size") - F.when(own, 1).otherwise(0)
    mean = F.try_divide(others * F.coalesce("top", F.lit(0.0)) - F.coalesce("pull", F.lit(0.0)), others.cast("double"))
    per_node = grid.withColumns({"own": own, "mean": mean}).groupBy("window_id", "a").agg(F.max(F.when(F.col("own"), F.col("mean"))).alias("x"), F.min(F.when(~F.col("own"), F.col("mean"))).alias("y"), F.max(F.when(F.col("own"), F.col("size"))).alias("n"))
    value = F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("y") - F.col("x"), F.greatest("x", "y")), F.lit(0.0)))
    scores = per_node.groupBy("window_id").agg(F.avg(value).alias("s"), F.count("*").alias("nodes"))
    clusters = sizes.groupBy("window_id").agg(F.count("*").alias("clusters"))
    flat = (F.col("clusters") == 1) | (F.col("clusters") == F.col("nodes"))
    return scores.join(clusters, "window_id").select("window_id", F.when(flat, -1.0).otherwise(F.col("s")).alias("silhouette"))


def auto_grid(nodes: DataFrame) -> DataFrame:
    """(window_id, k, k_min): per window k under round(n/5) and k_min under min(k + 1, round(n/10)), in steps that grow with n; half rounds to even."""
    n = nodes.groupBy("window_id").agg(F.count("*").alias("n"))
    top, low = F.bround(F.col("n") / 5, 0).cast("int"), F.bround(F.col("n") / 10, 0).cast("int")
    sized = n.select("window_id", top.alias("top"), low.alias("low")).where("top > 1 and low > 1")
    step = lambda c, by: F.greatest(F.lit(1), F.bround(F.col(c) / by, 0).cast("int"))
    ks = sized.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("top") - 1, step("top", 50))))
    return ks.select("window_id", "k", F.explode(F.sequence(F.lit(1), F.least(F.col("k") + 1, F.col("low")) - 1, step("low", 20))).alias("k_min"))


def auto_initial(nodes: DataFrame) -> DataFrame:
    """(window_id, k, k_min) of every window before any candidate is tried: round(n/5) and round(n/10)."""
    n = nodes.where("window_id is not null").groupBy("window_id").agg(F.count("*").alias("n"))
    return n.select("window_id", F.bround(F.col("n") / 5, 0).cast("int").alias("k"), F.bround(F.col("n") / 10, 0).cast("int").alias("k_min"))


def range_grid(nodes: DataFrame, lo: int, hi: int, step: int = 1) -> DataFrame:
    """(window_id, k, k_min) for every window: k in [lo, hi) and k_min in [1, k), every ``step``."""
    ks = nodes.select("window_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1), F.lit(step))))
    return ks.where("k > 1").select("window_id", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1, F.lit(step))).alias("k_min"))


def cluster_grid(nodes: DataFrame, edges: DataFrame, grid: DataFrame) -> DataFrame:
    """(window_id, k, k_min, silhouette) for every row of ``grid``, in one pass; pairs with equal links are scored once.

    Neighbour lists are taken once and cut by rank. Noise counts as one cluster. k_min must be at least 1.
    """
    return grid_silhouettes(nodes, edges, grid)


def best_of_grid(scores: DataFrame) -> DataFrame:
    """The parameters with the highest silhouette per window, the first of equal ones."""
    order = Window.partitionBy("window_id").orderBy(F.desc("silhouette"), "k", "k_min")
    return scores.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def best_or_initial(scores: DataFrame, initial: DataFrame) -> DataFrame:
    """One row for every window of ``initial`` (window_id, k, k_min): its best parameters of a silhouette over -1, else the initial ones with -1."""
    best = best_of_grid(scores.where("silhouette > -1")).select("window_id", F.col("k").alias("best_k"), F.col("k_min").alias("best_min"), "silhouette")
    joined = initial.join(best, "window_id", "left")
    return joined.select("window_id", F.coalesce("best_k", "k").alias("k"), F.coalesce("best_min", "k_min").alias("k_min"), F.coalesce("silhouette", F.lit(-1.0)).alias("silhouette"))
