"""Random-walk ranking of segments over the graph of their common posts.

Inputs: ``held`` (node, post_id) and ``kb`` (node, q). Edges are Jaccard shares of posts, found by joining on the post; pairs
without a common post have weight 0 and no row.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstloom.session import local_scratch, materialise, release

#: nodes of which :func:`walk_shares` keeps a vector of doubles in a task's memory (64 MB); more go by tables
MOST_NODES = 1 << 23
#: ordered pairs of segments of a post that one task counts
BLOCK_PAIRS = 4_000_000


def jaccard_edges(held: DataFrame) -> DataFrame:
    """(a, b, w), a < b: common posts over all posts of the two."""
    once = held.select("node", "post_id").distinct()
    sizes = once.groupBy("node").agg(F.count("*").alias("n"))
    x, y = once.alias("x"), once.alias("y")
    common = x.join(y, (F.col("x.post_id") == F.col("y.post_id")) & (F.col("x.node") < F.col("y.node"))).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("c"))
    na, nb = sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), sizes.select(F.col("node").alias("b"), F.col("n").alias("nb"))
    return common.join(na, "a").join(nb, "b").select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("w"))


def mirror(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def transition_prob(edges: DataFrame) -> DataFrame:
    """(a, b, p): an edge's share of all weight that leaves a."""
    return mirror(edges).where("w > 0").withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("a"))).select("a", "b", "p")


def teleport(nodes: DataFrame, kb: DataFrame) -> DataFrame:
    """(node, e): e^q over the sum of e^q; a node without q has q = 0."""
    grown = nodes.select("node").distinct().join(kb.select("node", "q"), "node", "left").select("node", F.exp(F.coalesce("q", F.lit(0.0))).alias("x"))
    total = grown.agg(F.sum("x").alias("total"))
    return grown.join(F.broadcast(total)).select("node", (F.col("x") / F.col("total")).alias("e"))


def walk_step(pi: DataFrame, moves: DataFrame, jump: DataFrame, gamma: float) -> DataFrame:
    """(node, pi): one multiplication with gamma * P^T + (1 - gamma) * e * 1^T."""
    pushed = pi.join(moves, pi["node"] == moves["a"]).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("pi") * F.col("p")).alias("s"))
    mass = pi.agg(F.sum("pi").alias("mass"))
    return jump.join(pushed, "node", "left").join(F.broadcast(mass)).select("node", (F.lit(gamma) * F.coalesce("s", F.lit(0.0)) + F.lit(1 - gamma) * F.col("e") * F.col("mass")).alias("pi"))


def power_iteration(moves: DataFrame, jump: DataFrame, gamma: float = 0.85, rounds: int = 500, tolerance: float = 0.0, every: int = 10) -> DataFrame:
    """(node, pi) after ``rounds`` steps from equal shares, or sooner if no value moves by more than ``tolerance`` (looked at after ``every`` steps).

    Nodes are numbered once, so that steps move numbers and no texts. Every step's vector is a table in the shared folder: its size is
    known, so Spark sends it to the moves while it is small and shuffles both where it is not; lost executors cost one step.
    """
    numbered = materialise(jump.withColumn("id", F.monotonically_increasing_id()))
    ids = numbered.select("node", "id")
    of = lambda end: ids.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id"))
    steps = materialise(moves.join(of("a"), "a").join(of("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "p"))
    start = materialise(numbered.select(F.col("id").alias("node"), "e"))
    n = start.count()
    pi = materialise(start.select("node", F.lit(1.0 / max(n, 1)).alias("pi")))
    for i in range(1, rounds + 1):
        before, pi = pi, materialise(walk_step(pi, steps, start, gamma))
        still = False
        if tolerance and i % every == 0:
            both = pi.join(before.withColumnRenamed("pi", "before"), "node")
            still = (both.agg(F.max(F.abs(F.col("pi") - F.col("before")))).first()[0] or 0.0) <= tolerance
        release(before)
        if still:
            break
    return ids.join(pi.withColumnRenamed("node", "id"), "id").select("node", "pi")


def walk_shares(held: DataFrame, kb: DataFrame, gamma: float = 0.85, rounds: int = 500, tolerance: float = 0.0, every: int = 10, block_pairs: int = BLOCK_PAIRS, most_nodes: int = MOST_NODES) -> DataFrame:
    """(node, pi) of :func:`power_iteration` over the graph of common posts.

    Nodes are numbered and dealt into blocks; each block counts its nodes' pairs from the posts that hold them and keeps its edges as sorted
    arrays in the shared folder, so that a step is one job without a shuffle and no pair is ever shuffled. Where the folder is no path of
    the machines, or the nodes are too many for a vector in memory, tables do the same.
    """
    spark = held.sparkSession
    once = materialise(held.select("node", "post_id").where("node is not null and post_id is not null").distinct())
    jump = teleport(once, kb)
    sizes = once.groupBy("node").agg(F.count("*").alias("n"))
    low = (1 << 33) - 1
    drawn = materialise(jump.join(sizes, "node").withColumn("at", F.monotonically_increasing_id()))
    parts = drawn.groupBy(F.shiftright("at", 33).alias("part")).agg((F.max(F.col("at").bitwiseAND(low)) + 1).alias("k")).orderBy("part").collect()
    n = sum(r["k"] for r in parts)
    folder = local_scratch(spark, "walk")
    if not n or n > most_nodes or folder is None:
        return power_iteration(transition_prob(materialise(jaccard_edges(once))), jump, gamma, rounds, tolerance, every)
    before, starts = 0, []
    for r in parts:
        starts.append((r["part"], before))
        before += r["k"]
    first = F.broadcast(spark.createDataFrame(starts, "part long, start long"))
    numbered = materialise(drawn.withColumn("part", F.shiftright("at", 33)).join(first, "part").select("node", (F.col("start") + F.col("at").bitwiseAND(low)).alias("id"), "e", "n"))
    lists = materialise(once.join(numbered.select("node", "id"), "node").groupBy("post_id").agg(F.collect_list(F.col("id").cast("int")).alias("ids")).select("ids"))
    pairs = lists.agg(F.sum(F.size("ids").cast("long") * F.size("ids"))).first()[0]
    width = math.ceil(n / min(n, math.ceil(pairs / block_pairs)))
    blocks = math.ceil(n / width)
    path = folder.path

    def save(name, values):
        import uuid

        import numpy as np

        part = f"{path}/{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, values)
        os.replace(part, f"{path}/{name}.npy")

    def load(name, mode=None):
        import numpy as np

        return np.load(f"{path}/{name}.npy", mmap_mode=mode)

    def whole(name):
        import numpy as np

        return np.concatenate([load(f"{name}-{k}") for k in range(blocks)])

    def bounds(k):
        return k * width, min(n, (k + 1) * width)

    def vectors(batches):
        import numpy as np
        import pyarrow as pa

        rows = [tuple(c.to_numpy() for c in b.columns) for b in batches if b.num_rows]
        if rows:
            ids, e, size = (np.concatenate(x) for x in zip(*rows, strict=True))
            k, order = int(ids[0]) // width, np.argsort(ids)
            save(f"e-{k}", e[order])
            save(f"size-{k}", size[order])
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["done"])

    def edges(batches):
        import numpy as np
        import pyarrow as pa

        def summed(kept):
            keys = np.concatenate([x for x, _ in kept])
            found, place = np.unique(keys, return_inverse=True)
            return found, np.bincount(place, np.concatenate([c for _, c in kept]), len(found)).astype(np.int64)

        kept, waiting, k = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            to, ids = b.column(0).to_numpy(), b.column(1)
            k = int(to[0]) // width if k is None else k
            other = ids.flatten().to_numpy().astype(np.int64)
            end = np.repeat(to.astype(np.int64), np.diff(ids.offsets.to_numpy()))
            mine = other != end
            kept.append(np.unique((end[mine] - k * width) * n + other[mine], return_counts=True))
            waiting += len(kept[-1][0])
            if waiting > 2 * block_pairs:
                kept = [summed(kept)]
                waiting = len(kept[0][0])
        if k is not None:
            keys, counts = summed(kept)
            save(f"at-{k}", np.searchsorted(keys, np.arange(bounds(k)[1] - k * width + 1) * n))
            save(f"other-{k}", (keys % n).astype(np.int32))
            save(f"count-{k}", counts.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([int(k is not None)], pa.int64())], names=["done"])

    def added(values, at):
        """Sums of the runs of ``values`` that start at ``at``, 0 for an empty run."""
        import numpy as np

        out, filled = np.zeros(len(at) - 1), at[1:] > at[:-1]
        if filled.any():
            out[filled] = np.add.reduceat(values, at[:-1][filled])
        return out

    def weigh(k):
        import numpy as np

        lo, hi = bounds(k)
        size, at, other, count = whole("size"), load(f"at-{k}"), load(f"other-{k}"), load(f"count-{k}")
        w = count / (np.repeat(size[lo:hi], np.diff(at)) + size[other] - count)
        save(f"w-{k}", w)
        out = added(w, at)
        save(f"out-{k}", out)
        save(f"pi0-{k}", np.full(hi - lo, 1.0 / n))
        return float((out == 0).sum()) / n

    def step(k, t, mass, ratio):
        """One step of block k: its mass, the mass of its nodes without edges, the largest move, the largest move besides the fall of all mass by ``ratio``, the largest share."""
        import numpy as np

        lo, hi = bounds(k)
        pi, out = whole(f"pi{t - 1}"), whole("out")
        per = np.divide(pi, out, out=np.zeros(n), where=out > 0)
        s = added(per[load(f"other-{k}", "r")] * load(f"w-{k}", "r"), load(f"at-{k}"))
        new = gamma * s + (1 - gamma) * load(f"e-{k}") * mass
        save(f"pi{t}-{k}", new)
        old = pi[lo:hi]
        return float(new.sum()), float(new[out[lo:hi] == 0].sum()), float(np.abs(new - old).max()), float(np.abs(new - ratio * old).max()), float(new.max())

    block = F.floor(F.col("id") / width).cast("int")
    numbered.select("id", "e", "n").repartitionById(blocks, block).mapInArrow(vectors, "done long").agg(F.sum("done")).collect()
    spread = lists.select(F.explode("ids").alias("id"), "ids")
    spread.repartitionById(blocks, block).mapInArrow(edges, "done long").agg(F.sum("done")).collect()
    release(once, drawn, lists)
    sc = spark.sparkContext
    each = sc.parallelize(range(blocks), blocks)
    mass, lost, scale, t = 1.0, math.fsum(each.map(weigh).collect()), 1.0, 0
    while t < rounds:
        t += 1
        # what stays is known before the step: nodes without edges lose their share of gamma
        ratio = 1 - gamma * lost / mass if mass else 1.0
        got = each.map(lambda k, t=t, mass=mass, ratio=ratio: step(k, t, mass, ratio)).collect()
        for k in range(blocks):
            os.remove(f"{path}/pi{t - 1}-{k}.npy")
        mass, lost = math.fsum(r[0] for r in got), math.fsum(r[1] for r in got)
        moved, bent, top = (max(r[i] for r in got) for i in (2, 3, 4))
        if tolerance and t % every == 0:
            if moved <= tolerance:
                break
            if bent <= tolerance * (1 - gamma):
                # only the mass still falls, by one ratio a step: the rest of the steps is a power of it
                ratio = 1 - gamma * lost / mass
                last = next((u for u in range(t + every, rounds + 1, every) if top * ratio ** (u - t - 1) * (1 - ratio) <= tolerance), rounds)
                scale = ratio ** (last - t)
                break

    def shares(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k in b.column(0).to_pylist():
                lo, hi = bounds(k)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.array(load(f"pi{t}-{k}") * scale)], names=["id", "pi"])

    pi = spark.range(0, blocks, 1, blocks).mapInArrow(shares, "id long, pi double")
    out = materialise(numbered.select("node", "id").join(pi, "id").select("node", "pi"))
    release(numbered)
    folder.drop()
    return out


def select_best(scores: DataFrame, k: int) -> DataFrame:
    """The k best nodes, ties by node."""
    return scores.orderBy(F.desc("pi"), "node").limit(k)
