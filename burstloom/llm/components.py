"""Problem 4: consolidating pairwise matches into groups.

Connected components on a two-dimensional grid. Vertices are hashed into B blocks and every edge goes to the cell of its
two blocks, so a vertex with very many edges is spread over a whole row and column of cells. Each cell runs a local
union-find and gives the smallest vertex it knows for each of its vertices. The cells of a row and a column then
exchange those representatives: a vertex takes the smallest, and the others become edges of the next, smaller round.
B follows the number of edges (one cell holds about ``edges_per_cell``) and is at least 2, so it shrinks with them; the parents
are stable as soon as no edge is left.

Defined results: rows with a null end, a null or NaN weight or a weight under the threshold are no ties; self edges, repeated
and mirrored edges change nothing; an empty table gives no groups; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstloom.session import materialise, release

#: copies of a label's change
SALTS = 16


def local_union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) for the edges a[i]-b[i], by pointer jumping over whole arrays."""
    vertices, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(vertices))
    while len(x):
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        keep = lo != hi
        x, y, lo, hi = x[keep], y[keep], lo[keep], hi[keep]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return vertices, vertices[root]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find cell by cell over a partition that is sorted by cell; only one cell is held at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    cell = None

    def flush():
        v, r = local_union_find(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(r)], names=["v", "r"])

    for batch in batches:
        c, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = np.flatnonzero(np.diff(c)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(c)], strict=True):
            if lo == hi:
                continue
            if cell is not None and c[lo] != cell and held:
                yield flush()
            cell = c[lo]
            held.append((a[lo:hi], b[lo:hi]))
    if held:
        yield flush()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", edges_per_cell: int = 200_000, max_rounds: int = 60) -> DataFrame:
    """(node_id, group_id) for every vertex with an edge to another one; the group is its smallest vertex.

    The result is a table in the shared folder; nothing but edge counts reaches the driver.
    """
    work = materialise(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"))
        .distinct()
    )
    labels: DataFrame | None = None
    for _ in range(max_rounds):
        left = work.count()
        if left == 0:
            break
        blocks = max(2, math.ceil(math.sqrt(left / edges_per_cell)))
        x, y = (F.pmod(F.xxhash64(c), F.lit(blocks)) for c in ("a", "b"))
        celled = work.select((F.least(x, y) * blocks + F.greatest(x, y)).alias("cell"), "a", "b")
        local = materialise(celled.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells, "v long, r long"))
        parent = materialise(local.groupBy("v").agg(F.min("r").alias("p")))
        # representatives of one vertex in different cells belong together
        links = local.join(parent, "v").where("r <> p").select(F.least("r", "p").alias("a"), F.greatest("r", "p").alias("b")).distinct()
        following = materialise(links)
        if labels is None:
            composed = parent.select(F.col("v").alias("node_id"), F.col("p").alias("group_id"))
        else:
            # all nodes of a giant component have one label: they are dealt over SALTS copies of its change
            old = labels.withColumn("salt", F.pmod(F.xxhash64("node_id"), F.lit(SALTS)))
            step = parent.where("v <> p").select(F.col("v").alias("group_id"), "p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
            composed = old.join(step, ["group_id", "salt"], "left").select("node_id", F.coalesce("p", "group_id").alias("group_id"))
        new = materialise(composed)
        release(work, local, parent, *([labels] if labels is not None else []))
        work, labels = following, new
    else:
        raise RuntimeError(f"parents not stable after {max_rounds} rounds")
    release(work)
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node_id long, group_id long")
    return labels


def strong_edges(graph: DataFrame, a: str = "node_a", b: str = "node_b", weight: str = "weight", threshold: float = 0.6) -> DataFrame:
    """The ties of a weighted graph: rows whose weight is a number of at least ``threshold``."""
    w = F.col(weight).cast("double")
    return graph.where(w.isNotNull() & ~F.isnan(w) & (w >= threshold)).select(F.col(a).alias("a"), F.col(b).alias("b"))


def segment_groups(graph: DataFrame, threshold: float = 0.6, edges_per_cell: int = 200_000) -> DataFrame:
    """(node_id, group_id) of the nodes of ``similaritygraph`` that are tied to at least one other node."""
    return connected_components(strong_edges(graph, threshold=threshold), edges_per_cell=edges_per_cell)
