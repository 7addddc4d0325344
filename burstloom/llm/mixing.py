"""Problem 9: mixing sources to target weights.

Documents are added up by membership pattern (the set of sources they belong to). A min-cost flow routes token capacity
from patterns to source quotas: a pattern offers its tokens once per permitted use, and the k-th use costs k, so repeats are
spread evenly and used last. The flow network has one node per pattern and source; documents never enter it. Documents
are then taken from each pattern in a seeded order up to the routed amount.

Defined results: null and empty texts have no tokens; documents without a source count in the total only; a source without
a target takes no part; a target without documents cannot be reached (unless its share is 0); a null share or
repeat counts as 0; repeated target rows of a source are added up in share and take the largest repeat;
an empty table gives a mix of size 0; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: a membership pattern is kept on the driver; more of them than this are refused
MAX_PATTERNS = 100_000
#: words whose token counts a task remembers
WORD_MEMORY = 300_000


def with_token_counts(docs: DataFrame, column: str, tokenizer_path: str, into: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of ``column`` by a SentencePiece model whose pieces never span blanks.

    Such a text has as many tokens as its blank-separated words together, so each task encodes a word once and remembers it.
    """

    def count(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
        known: dict[str, int] = {}
        for s in series:
            split = [t.split() if t else [] for t in s]
            new = list({w for ws in split for w in ws if w not in known})
            if len(known) + len(new) > WORD_MEMORY:
                known.clear()
                new = list({w for ws in split for w in ws})
            known.update(zip(new, map(len, model.encode(new, num_threads=1)), strict=True))
            yield pd.Series([sum(map(known.__getitem__, ws)) for ws in split], dtype="int64")

    return docs.withColumn(into, F.pandas_udf(count, "long")(F.col(column)))


class _Network:
    """Residual arcs of a flow network: arc ``e`` and its reverse ``e ^ 1``."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, room: int, cost: int) -> int:
        for frm, to, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs[frm].append(len(self.to))
            self.to.append(to)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def distances(self, start: int, potential: list[int]) -> list[float]:
        """Dijkstra over arcs with room, by reduced costs (never negative)."""
        best: list[float] = [math.inf] * len(self.arcs)
        best[start], heap = 0, [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > best[x]:
                continue
            for e in self.arcs[x]:
                y = self.to[e]
                if self.room[e] > 0 and (n := d + self.cost[e] + potential[x] - potential[y]) < best[y]:
                    best[y] = n
                    heapq.heappush(heap, (n, y))
        return best

    def block(self, start: int, end: int, potential: list[int]) -> bool:
        """Fill all shortest paths of fewest arcs over arcs of reduced cost 0; whether there was any."""
        tight = lambda x, e: self.room[e] > 0 and self.cost[e] + potential[x] == potential[self.to[e]]
        level, queue = {start: 0}, [start]
        for x in queue:
            for e in self.arcs[x]:
                if tight(x, e) and self.to[e] not in level:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        if end not in level:
            return False
        at = dict.fromkeys(level, 0)
        path: list[int] = []
        x = start
        while True:
            if x == end:
                amount = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= amount
                    self.room[e ^ 1] += amount
                full = next(i for i, e in enumerate(path) if not self.room[e])
                x = self.to[path[full] ^ 1]
                del path[full:]
                continue
            while at[x] < len(self.arcs[x]) and not (tight(x, e := self.arcs[x][at[x]]) and level.get(self.to[e]) == level[x] + 1):
                at[x] += 1
            if at[x] < len(self.arcs[x]):
                path.append(self.arcs[x][at[x]])
                x = self.to[path[-1]]
            elif path:
                x = self.to[path.pop() ^ 1]
                at[x] += 1
            else:
                return True


def min_cost_flow(capacity: dict[tuple, int], demand: dict[str, int], repeats: dict[str, int]) -> dict[tuple, int]:
    """Tokens routed by (pattern, source, use): as much as possible, and of that the cheapest.

    The network runs from a start over the uses of patterns (room: the pattern's tokens, cost: the use number) and the sources that
    may take them to the end (room: the source's demand). Shortest distances under reduced costs give new potentials, and all shortest
    paths are filled at once, so there are only as many rounds as paths have different costs. A path may take tokens
    back from another source and give it dearer ones.
    """
    sources = sorted(demand)
    number = {s: i + 2 for i, s in enumerate(sources)}
    uses = [(p, k) for p in capacity for k in range(1, max([0, *(repeats.get(s, 0) for s in p if s in number)]) + 1)]
    net = _Network(2 + len(sources) + len(uses))
    arcs: dict[tuple, int] = {}
    for i, (p, k) in enumerate(uses):
        node = 2 + len(sources) + i
        net.add(0, node, capacity[p], k)
        for s in p:
            if s in number and repeats.get(s, 0) >= k:
                arcs[p, s, k] = net.add(node, number[s], capacity[p], 0)
    for s in sources:
        net.add(number[s], 1, demand[s], 0)
    potential = [0] * len(net.arcs)
    while (best := net.distances(0, potential))[1] < math.inf:
        far = best[1]
        potential = [v + int(min(d, far)) for v, d in zip(potential, best, strict=True)]
        while net.block(0, 1, potential):
            pass
    return {key: net.room[e ^ 1] for key, e in arcs.items() if net.room[e ^ 1]}


class Mix:
    """The plan of a mix: quotas, routed tokens and what is missing."""

    def __init__(self, sized: DataFrame, targets: list[tuple[str, float, int]], total: int | None = None, members: str = "members", size: str = "n_tokens"):
        self.sized, self.members, self.size = sized, members, size
        share, repeat = defaultdict(float), defaultdict(int)
        for source, s, r in targets:
            if source is not None:
                share[source] += s or 0.0
                repeat[source] = max(repeat[source], int(r or 0))
        self.repeat = dict(repeat)
        wanted = F.array_sort(F.array_intersect(F.coalesce(members, F.array().cast("array<string>")), F.array(*map(F.lit, share)) if share else F.array().cast("array<string>")))
        patterns = sized.groupBy(wanted.alias("pattern")).agg(F.sum(size).alias("tokens")).limit(MAX_PATTERNS + 1).collect()
        if len(patterns) > MAX_PATTERNS:
            raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
        found = {tuple(r["pattern"]): int(r["tokens"] or 0) for r in patterns}
        self.total = sum(found.values()) if total is None else total
        self.capacity = {p: n for p, n in found.items() if p}
        self.quota = {s: math.ceil(v * self.total) for s, v in share.items()}
        self.flow = min_cost_flow(self.capacity, self.quota, self.repeat)
        self.routed = {s: sum(v for (p, q, k), v in self.flow.items() if q == s) for s in self.quota}
        self.share = dict(share)
        self.pattern_column = wanted

    def report(self) -> DataFrame:
        """(source, target_share, actual_share, quota, routed, missing) for every target."""
        got = sum(self.routed.values())
        rows = [(s, self.share[s], self.routed[s] / got if got else 0.0, self.quota[s], self.routed[s], self.quota[s] - self.routed[s]) for s in sorted(self.quota)]
        return self.sized.sparkSession.createDataFrame(rows, "source string, target_share double, actual_share double, quota long, routed long, missing long")

    def select(self, id_col: str, seed: int = 0, buckets: int = 4096) -> DataFrame:
        """(id, source, use, n_tokens): the documents of the mix, one row per use of a document.

        Within a pattern documents are ordered by a seeded hash. The running total is taken over hash buckets first and then
        inside each bucket, so no task holds a pattern; a document is taken while the total before it is under the routed amount.
        """
        spark = self.sized.sparkSession
        order, start = [], defaultdict(int)
        for (p, s, k), amount in sorted(self.flow.items(), key=lambda x: (x[0][0], x[0][2], x[0][1])):
            order.append(("\x1f".join(p), s, k, start[p, k], start[p, k] + amount))
            start[p, k] += amount
        want = spark.createDataFrame(order, "pattern string, source string, use int, lo long, hi long")
        draw = F.xxhash64(F.col(id_col), F.lit(seed))
        docs = self.sized.where(F.col(self.size) > 0).select(id_col, F.col(self.size).alias("n_tokens"), F.array_join(self.pattern_column, "\x1f").alias("pattern"), draw.alias("draw"), F.pmod(draw, F.lit(buckets)).alias("bucket")).where("pattern <> ''")
        sums = docs.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("n"))
        before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("n")).drop("n")
        inside = F.sum("n_tokens").over(Window.partitionBy("pattern", "bucket").orderBy("draw", id_col).rowsBetween(Window.unboundedPreceding, -1))
        at = docs.join(before, ["pattern", "bucket"]).withColumn("at", F.col("before") + F.coalesce(inside, F.lit(0)))
        return at.join(want, "pattern").where("at >= lo and at < hi").select(id_col, "source", "use", "n_tokens")


def merged_copies(sized: DataFrame, id_col: str, text: str, members: str = "members", size: str = "n_tokens") -> DataFrame:
    """(id, members, size) of every different text: its smallest id and all sources that hold a copy of it. Only digests are moved."""
    bare = sized.select(F.xxhash64(text).alias("_a"), F.md5(text).alias("_b"), id_col, F.explode_outer(members).alias("_m"), size)
    per_text = bare.groupBy("_a", "_b").agg(F.min(id_col).alias(id_col), F.collect_set("_m").alias(members), F.max(size).alias(size))
    return per_text.select(id_col, members, size)


def mix(docs: DataFrame, targets: DataFrame, tokenizer_path: str | None, text: str = "text", source: str = "source", copies_of: str | None = None) -> Mix:
    """The mix of ``docs`` (one source per document) for a table of (source, target_share, max_repeat); without a tokenizer sizes are blank-separated words.

    copies_of: with the name of the id column, whole copies of a text are one document that belongs to all their sources.
    """
    members = F.when(F.col(source).isNotNull(), F.array(source)).otherwise(F.array().cast("array<string>"))
    bare = docs.select(*[c for c in docs.columns if c not in ("members", "n_tokens")])
    if tokenizer_path is None:
        sized = bare.withColumn("n_tokens", F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0)).cast("long"))
        sized = sized.withColumn("n_tokens", F.greatest("n_tokens", F.lit(0)))
    else:
        sized = with_token_counts(bare, text, tokenizer_path)
    sized = sized.withColumn("members", members)
    if copies_of:
        sized = merged_copies(sized, copies_of, text)
    rows = [(r["source"], r["target_share"], r["max_repeat"]) for r in targets.select("source", "target_share", "max_repeat").collect()]
    return Mix(sized, rows)
