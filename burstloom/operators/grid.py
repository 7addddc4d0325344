"""Scores of whole parameter grids: one pass over the graph of a window, every different set of links scored once.

A window's graph reaches one task as arrays of its edges. Neighbour lists are ranked once and cut at each k; k beyond the longest list gives the
lists of the longest, and k_min counts only by the numbers of shared neighbours that occur. So most pairs of a grid share their links, and
pairs with equal links share their scores. Memory grows with nodes and edges; no nodes x clusters or nodes x nodes table is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstloom.operators.evaluation import group_entropy

NODE, EDGE, PAIR, HELD, LABEL = range(5)


def neighbour_lists(a: np.ndarray, b: np.ndarray, w: np.ndarray, order: np.ndarray) -> dict[int, list[int]]:
    """Node -> its neighbours of positive weight, heaviest first; of equal ones the later by ``order``."""
    keep = w > 0
    x, y, v = np.concatenate([a[keep], b[keep]]), np.concatenate([b[keep], a[keep]]), np.concatenate([w[keep], w[keep]])
    at = np.lexsort((-order[y], -v, x))
    x, y = x[at], y[at]
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return {int(x[i]): y[i:j].tolist() for i, j in zip(starts, [*starts[1:], len(x)], strict=False)}


def shared_links(lists: dict[int, list[int]], k: int) -> list[tuple[int, int, int]]:
    """(shared, a, b) of all pairs that are in each other's first k, by falling shared."""
    cut = {n: set(near[:k]) for n, near in lists.items()}
    none: set[int] = set()
    return sorted(((len(near & cut[y]), x, y) for x, near in cut.items() for y in near if x < y and x in cut.get(y, none)), reverse=True)


def labelings(n: int, lists: dict[int, list[int]], pairs: dict[int, list[int]]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
    """(pairs (k, k_min) with the same links, component of each of the n nodes as its lowest node); nodes from n on link nothing."""
    longest = max(map(len, lists.values()), default=0)
    same: dict[int, list[int]] = {}
    for k in sorted(pairs):
        same.setdefault(min(k, longest), []).append(k)
    for cut, ks in same.items():
        links = [x for x in shared_links(lists, cut) if x[1] < n and x[2] < n]
        levels = sorted({x[0] for x in links}, reverse=True)
        asked: dict[int, list[tuple[int, int]]] = {}
        for k in ks:
            for k_min in pairs[k]:
                asked.setdefault(min((x for x in levels if x >= k_min), default=-1), []).append((k, k_min))
        if -1 in asked:
            yield asked.pop(-1), np.arange(n)
        parent, at = list(range(n)), 0
        for level in levels:
            while at < len(links) and links[at][0] >= level:
                roots = []
                for x in links[at][1:]:
                    while parent[x] != x:
                        parent[x] = x = parent[parent[x]]
                    roots.append(x)
                parent[max(roots)] = min(roots)
                at += 1
            if level in asked:
                labels = np.array(parent)
                while (labels != (up := labels[labels])).any():
                    labels = up
                yield asked[level], labels


def mean_silhouette(cluster: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, top: float, whole: int) -> float:
    """As cluster.silhouette for nodes 0, 1, ... with a cluster each; -1 for no or one cluster or as many as the ``whole`` graph has nodes."""
    if not len(cluster):
        return -1.0
    _, c, size = np.unique(cluster, return_inverse=True, return_counts=True)
    m, n = len(size), len(c)
    if m in (1, whole):
        return -1.0
    x, y, v = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    key, at = np.unique(x * m + c[y], return_inverse=True)
    pull = np.bincount(at, v, len(key))
    node, other = key // m, key % m
    own = c[node] == other
    inner = np.zeros(n)
    inner[node[own]] = pull[own]
    alone = size[c] == 1
    others = np.where(alone, 1, size[c] - 1)
    near = (others * top - inner) / others
    met = np.bincount(node[~own], minlength=n)
    far = np.where(met < m - 1, top, np.inf)
    np.minimum.at(far, node[~own], (size[other[~own]] * top - pull[~own]) / size[other[~own]])
    most = np.maximum(near, far)
    return float(np.where(alone | (most == 0), 0.0, (far - near) / np.where(most == 0, 1.0, most)).mean())


class Graph:
    """The arrays of one window's rows (kind, a, b, w)."""

    def __init__(self, rows: pd.DataFrame) -> None:
        kind, a, b, w = (rows[c].to_numpy() for c in ("kind", "a", "b", "w"))
        is_node, is_edge = kind == NODE, kind == EDGE
        self.nodes, first = np.unique(a[is_node], return_index=True)
        self.mu, self.n = w[is_node][first], len(self.nodes)
        ends = np.concatenate([a[is_edge], b[is_edge]])
        ids = np.concatenate([self.nodes, np.setdiff1d(ends, self.nodes)])
        where = np.argsort(ids)
        self.a, self.b = (where[np.searchsorted(ids, e[is_edge], sorter=where)] for e in (a, b))
        self.w = w[is_edge].astype(float)
        self.lists = neighbour_lists(self.a, self.b, self.w, ids)
        self.top = self.w.max() if len(self.w) else 0.0
        known = (self.a < self.n) & (self.b < self.n)  # ends without a node have no cluster
        self.a, self.b, self.w = self.a[known], self.b[known], self.w[known]
        self.pairs: dict[int, list[int]] = {}
        for k, k_min in zip(a[kind == PAIR].tolist(), b[kind == PAIR].tolist(), strict=True):
            self.pairs.setdefault(k, []).append(k_min)

    def scored(self, score: Callable[[np.ndarray], tuple]) -> Iterator[tuple]:
        """(k, k_min, *score of the noise clusters) of every pair; equal clusters are scored once."""
        known: dict[bytes, tuple] = {}
        if not self.n:
            return
        for pairs, labels in labelings(self.n, self.lists, self.pairs):
            key = labels.astype(np.int32).tobytes()
            if key not in known:
                known[key] = score(np.where(np.bincount(labels, minlength=self.n)[labels] > 1, labels, -1))
            for k, k_min in pairs:
                yield k, k_min, *known[key]


def _rows(nodes: DataFrame, edges: DataFrame, grid: DataFrame, *more: DataFrame) -> DataFrame:
    mu = F.col("mu").cast("double") if "mu" in nodes.columns else F.lit(0.0)
    out = nodes.select("window_id", F.lit(NODE).alias("kind"), F.col("node").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), mu.alias("w"))
    out = out.unionByName(edges.select("window_id", F.lit(EDGE).alias("kind"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("w").cast("double").alias("w")))
    pairs = grid.where("k_min >= 1 and k_min <= k").select("window_id", F.lit(PAIR).alias("kind"), F.col("k").cast("long").alias("a"), F.col("k_min").cast("long").alias("b"), F.lit(0.0).alias("w"))
    for df in (pairs, *more):
        out = out.unionByName(df)
    return out.where("window_id is not null")


def _solve(rows: DataFrame, nodes: DataFrame, names: list[str], kinds: list[str], scorer: Callable[[Graph, pd.DataFrame], Callable[[np.ndarray], tuple]]) -> DataFrame:
    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        g = Graph(pdf)
        out = pd.DataFrame(list(g.scored(scorer(g, pdf))), columns=["k", "k_min", *names])
        out.insert(0, "window_id", key[0])
        return out

    kind = nodes.schema["window_id"].dataType.simpleString()
    return rows.groupBy("window_id").applyInPandas(solve, f"window_id {kind}, k int, k_min int, " + ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True)))


def grid_silhouettes(nodes: DataFrame, edges: DataFrame, grid: DataFrame) -> DataFrame:
    """(window_id, k, k_min, silhouette) of every pair of ``grid``; noise counts as one cluster."""

    def scorer(g: Graph, _: pd.DataFrame) -> Callable[[np.ndarray], tuple]:
        return lambda clusters: (mean_silhouette(clusters, g.a, g.b, g.w, g.top, g.n),)

    return _solve(_rows(nodes, edges, grid), nodes, ["silhouette"], ["double"], scorer)


def total(groups: dict[int, list], labels: dict[int, list]) -> float:
    """Entropy over the number of samples (id -> groups, id -> labels), in the order of ids."""
    held: dict[int, list[tuple[list, float]]] = {}
    for i in sorted(groups):
        for x in groups[i]:
            held.setdefault(x, []).append((labels[i], 1 / len(groups[i])))
    return sum(group_entropy(x)[0] for x in held.values()) / len(groups)


def kept_events(g: Graph, clusters: np.ndarray, limit: float) -> np.ndarray:
    """The clusters with -1 for noise and for events that are not realistic (news of 0, or the best news not under ``limit`` times theirs)."""
    n = g.n
    real = clusters >= 0
    size = np.bincount(clusters[real], minlength=n)
    mu = np.bincount(clusters[real], g.mu[real], n)
    inner = real[g.a] & (clusters[g.a] == clusters[g.b])
    weight = 2 * np.bincount(clusters[g.a[inner]], g.w[inner], n)
    some = np.maximum(size, 1)
    news = (mu / some) * (weight / some)
    if not real.any():
        return clusters
    kept = np.divide(news[size > 0].max(), news, out=np.full(n, limit), where=news != 0) < limit
    return np.where(real & kept[clusters], clusters, -1)


def sweep_metrics(nodes: DataFrame, edges: DataFrame, grid: DataFrame, held: DataFrame, classes: DataFrame, limit: float = 5.0) -> DataFrame:
    """(window_id, k, k_min, events, silhouette, class_entropy, cluster_entropy, f) of every pair of ``grid``.

    Clusters are scored by news (``mu`` of ``nodes``) and kept under ``limit``; the silhouette is that of the kept events, with distances from the
    largest weight among them. A gold sample gets the events that its post (``held``: window_id, node, gold_id) has a member
    of, or the label 0, and is held against its classes (``classes``: window_id, gold_id, pos, label as a number). Windows without gold rows have no entropies.
    """

    def scorer(g: Graph, pdf: pd.DataFrame) -> Callable[[np.ndarray], tuple]:
        gold: dict[int, list[int]] = {}
        for i, x in pdf[pdf["kind"] == LABEL].sort_values(["a", "w"])[["a", "b"]].itertuples(index=False):
            gold.setdefault(i, []).append(x)
        gold = {i: list(dict.fromkeys(x)) for i, x in gold.items()}
        of = pdf[pdf["kind"] == HELD]
        samples, members = of["b"].to_numpy(), np.searchsorted(g.nodes, of["a"].to_numpy())

        def score(clusters: np.ndarray) -> tuple:
            kept = kept_events(g, clusters, limit)
            inside = np.flatnonzero(kept >= 0)
            place = np.full(g.n, -1)
            place[inside] = np.arange(len(inside))
            both = (place[g.a] >= 0) & (place[g.b] >= 0)
            w = g.w[both]
            s = mean_silhouette(kept[inside], place[g.a[both]], place[g.b[both]], w, max(0.0, w.max(initial=0.0)), g.n)
            events = len(np.unique(kept[inside]))
            if not gold:
                return events, s, None, None, None
            found: dict[int, set[int]] = {}
            hit = kept[members] >= 0
            for i, x in zip(samples[hit].tolist(), kept[members[hit]].tolist(), strict=True):
                found.setdefault(i, set()).add(x + 1)
            posts = {i: sorted(found[i]) if i in found else [0] for i in gold}
            by_class, by_cluster = total(gold, posts), total(posts, gold)
            both_e = by_class + by_cluster
            return events, s, by_class, by_cluster, 2 * by_class * by_cluster / both_e if both_e else 0.0

        return score

    at = F.col("gold_id").cast("long")
    links = held.select("window_id", F.lit(HELD).alias("kind"), F.col("node").cast("long").alias("a"), at.alias("b"), F.lit(0.0).alias("w"))
    labels = classes.select("window_id", F.lit(LABEL).alias("kind"), at.alias("a"), F.col("label").cast("long").alias("b"), F.col("pos").cast("double").alias("w"))
    names = ["events", "silhouette", "class_entropy", "cluster_entropy", "f"]
    return _solve(_rows(nodes, edges, grid, links, labels), nodes, names, ["int", *["double"] * 4], scorer)
