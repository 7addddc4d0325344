"""Problem 3: near-duplicate records with small edits.

MinHash banding over word sets. Equal word sets are one class from the start, so exact copies never meet each other. Every
class has ``bands`` x ``rows`` minimum hashes; classes that agree on a whole band meet in one shuffle on the band's hash, which
carries the class, its size and a bitmap of its words, as arrays of many classes for each bucket of hashes. Size and bitmap bound the words that two classes can have in common from
above, so a pair is dropped where it meets only if it cannot be similar enough; all others are verified on the full sets of 64-bit word
hashes. The number of bands follows from the rows of a band and the target recall at the threshold itself; recall above the
threshold is higher.

Band hashes that very many classes share are found on one class in :data:`SAMPLED` and split: their classes are dealt into blocks, and every
pair of blocks meets by itself. The sample decides only where pairs meet and never which.

Defined results: null and empty texts are left out; a text without any word is like equal texts only; a post delivered more
than once counts once, by its earliest delivery; rows without an id are ignored; an empty table gives no rows; extra
columns are ignored; a similarity of exactly the threshold counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstloom.llm.components import connected_components
from burstloom.llm.consistent import connect, consistent_array, first_delivery
from burstloom.llm.words import WORD
from burstloom.session import materialise

#: bits of the word bitmap; the other 8 of a mark hold the size
BITMAP_BITS = 56
LARGE = 255
#: classes that a task remembers to have banded
SEEN = 500_000
#: one class in so many is looked at for band hashes that many share
SAMPLED = 64
#: classes of one band hash that meet in one place
BLOCK = 20_000
#: band rows that a task deals to buckets at once, and those of a bucket that meet in one place on average
DEALT, BUCKET = 1 << 20, 1 << 19
#: band hashes that are split at most (the most frequent ones); a bound on what tasks are sent
MAX_HOT = 10_000


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """The least number of bands that finds a pair of exactly ``threshold`` with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class _WordHashes(dict):
    """Blank-separated piece of a consistent text -> hashes of its words; a bounded memory.

    :meth:`sets` looks up every different piece of a batch once and finds the distinct words of all its texts by one sort.
    """

    def __init__(self, size: int = 300_000, longest: int = 60):
        super().__init__()
        self.size, self.longest, self.word = size, longest, regex.compile(WORD.replace("{200C}", "").replace(r"\x", "‌"))

    def __missing__(self, piece: str) -> tuple[int, ...]:
        out = tuple(xxhash.xxh64_intdigest(w) for w in self.word.findall(piece.lower()))
        if len(piece) <= self.longest:
            if len(self) >= self.size:
                self.clear()
            self[piece] = out
        return out

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, sizes): the distinct word hashes of every text, one after the other, and their number; a text without words has the hash of itself."""
        lists = pc.split_pattern(texts, " ")
        pieces = lists.flatten().dictionary_encode()
        found = [self[p] for p in pieces.dictionary.to_pylist()]
        several = np.fromiter(map(len, found), np.int64, len(found))
        own, number = np.unique(np.fromiter((h for x in found for h in x), np.uint64, int(several.sum())), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(several)])
        at = pieces.indices.to_numpy()
        many = several[at]
        row = np.repeat(np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy())), many)
        word = number[np.repeat(first[at] - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(at) else at, many) + np.arange(int(many.sum()))]
        cells = np.unique(row * max(1, len(own)) + word)
        row = cells // max(1, len(own))
        flat, sizes = own[cells - row * len(own)], np.bincount(row, minlength=len(texts))
        bare = np.flatnonzero(sizes == 0)
        if len(bare):
            whole = np.array([xxhash.xxh64_intdigest("\x00" + texts[i].as_py()) for i in bare.tolist()], np.uint64)
            flat = np.insert(flat, np.cumsum(sizes)[bare], whole)
            sizes[bare] = 1
        return flat, sizes


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes spread once more, so that their sum stands for their set."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_sets(df: DataFrame, id_col: str, text_col: str, time_col: str | None) -> DataFrame:
    """(id, time, cls, ws): the distinct word hashes of every row with text, and the class of equal sets.

    A text without words is a set of its own: the hash of the whole text.
    """
    kept = df.where(F.col(id_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col), *([F.col(time_col)] if time_col else []), F.col(text_col).alias("_text"))
    schema = kept.drop("_text").withColumns({"cls": F.lit(None).cast("long"), "ws": F.lit(None).cast("array<long>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, known = connect(), _WordHashes()
        for b in batches:
            texts = consistent_array(con, b.column(b.num_columns - 1))
            if isinstance(texts, pa.ChunkedArray):
                texts = texts.combine_chunks()
            rows = np.flatnonzero(pc.fill_null(pc.not_equal(texts, ""), False).to_numpy(zero_copy_only=False))
            flat, sizes = known.sets(texts.take(pa.array(rows)))
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            cls = np.add.reduceat(_mixed(flat), offsets[:-1]) if len(rows) else np.empty(0, np.uint64)
            ws = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))
            ids = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*ids.columns[:-1], pa.array(cls.view(np.int64)), ws], names=schema.names)

    return kept.mapInArrow(run, schema)


def marks(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Size up to 255 in the low byte, above it one bit for every word (words share bits)."""
    bits = np.uint64(1) << (np.uint64(8) + (_mixed(flat) % np.uint64(BITMAP_BITS)))
    return np.bitwise_or.reduceat(bits, starts) | np.minimum(sizes, LARGE).astype(np.uint64)


def may_be_similar(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets with these marks can have ``threshold`` in common.

    A bit that only one of two bitmaps has stands for at least one word that the other set has not.
    """
    low = np.uint64(LARGE)
    sx, sy = (x & low).astype(np.int64), (y & low).astype(np.int64)
    bx, by = x >> np.uint64(8), y >> np.uint64(8)
    common = np.minimum(sx - np.bitwise_count(bx & ~by), sy - np.bitwise_count(by & ~bx))
    return (common >= threshold * (sx + sy - common)) | (sx == LARGE) | (sy == LARGE)


def _banding(rows: int, bands: int, seed: int, hot: dict[int, int]):
    """A function from batches (cls, ws) to band rows (key, cls, mark, side).

    hot: band hash -> blocks. A class of such a hash goes to the meetings of its block with every other one; side tells the two
    blocks of a meeting apart and is 0 where all classes meet each other.
    """
    rng = np.random.default_rng(seed)
    n = rows * bands
    mult = rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**63, n, dtype=np.uint64)
    hot_keys = np.array(sorted(hot), np.int64)
    hot_blocks = np.array([hot[k] for k in sorted(hot)], np.int64)

    def deal(key: np.ndarray, cls: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, ...]:
        at = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
        split = hot_keys[at] == key
        plain = ~split
        out = [[key[plain], cls[plain], mark[plain], np.zeros(plain.sum(), np.int8)]]
        for i in np.flatnonzero(split):
            blocks = int(hot_blocks[at[i]])
            own, other = int(cls[i]) % blocks, np.arange(blocks)
            meeting = np.minimum(own, other) * blocks + np.maximum(own, other)
            keys = _mixed(key[i].view(np.uint64) ^ _mixed((meeting + 1).astype(np.uint64))).view(np.int64)
            side = np.where(other == own, 0, np.where(own < other, 1, 2)).astype(np.int8)
            out.append([keys, np.full(blocks, cls[i]), np.full(blocks, mark[i]), side])
        return tuple(np.concatenate([o[c] for o in out]) for c in range(4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            # a class that very many posts have is banded once by a task, not once a post
            fresh = [i for i, c in enumerate(b.column(0).to_pylist()) if c not in seen and not seen.add(c)]
            if len(seen) > SEEN:
                seen.clear()
            if not fresh:
                continue
            if len(fresh) < len(b):
                b = b.take(pa.array(fresh, pa.int64()))
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            offsets = lists.offsets.to_numpy()
            starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
            cls, mark = b.column(0).to_numpy(), marks(flat, starts, sizes).view(np.int64)
            for k in range(bands):
                key = np.full(len(b), k, np.uint64)
                for i in range(k * rows, (k + 1) * rows):
                    key = (key ^ np.minimum.reduceat((flat * mult[i] + add[i]) >> np.uint64(8), starts)) * np.uint64(0xFF51AFD7ED558CCD)
                    key ^= key >> np.uint64(33)
                key = key.view(np.int64)
                out = deal(key, cls, mark) if hot else (key, cls, mark, np.zeros(len(b), np.int8))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["key", "cls", "mark", "side"])

    return run


def _dealing(band, buckets: int):
    """A function from batches (cls, ws) to the band rows that ``band`` makes of them, as (bucket, rows): for every bucket of keys an array
    of rows key, cls, mark and, unless all are 0, side."""

    def dealt(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(4)]
        if not columns[3].any():
            columns.pop()
        to = (_mixed(columns[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        ends = np.bincount(to, minlength=buckets).cumsum()
        rows = np.stack([x[order].astype(np.int64) for x in columns], 1)
        there = np.flatnonzero(np.diff(ends, prepend=0))
        data = [rows[a:b].tobytes() for a, b in zip((ends - np.diff(ends, prepend=0))[there].tolist(), ends[there].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(np.full(len(there), len(columns), np.int32)), pa.array(data, pa.binary())], names=["bucket", "width", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for b in band(batches):
            held.append(b)
            waiting += len(b)
            if waiting >= DEALT:
                yield from dealt(held)
                held, waiting = [], 0
        if waiting:
            yield from dealt(held)

    return run


def _meeting(threshold: float):
    """A function from dealt band rows, sorted by bucket, to the pairs a < b that may be similar."""

    def pairs(key: np.ndarray, cls: np.ndarray, mark: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, step = np.arange(len(key)), 0
        while True:
            step += 1
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                return
            x, y = at, at + step
            good = (cls[x] != cls[y]) & ((side[x] != side[y]) | (side[x] == 0)) & may_be_similar(mark[x], mark[y], threshold)
            a, b = cls[x[good]], cls[y[good]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, pa.BinaryScalar]]:
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True)

        for _, group in groupby(rows(), key=lambda r: r[0]):
            held = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, width) for _, width, x in group]
            key, cls, mark = (np.concatenate([h[:, c] for h in held]) for c in range(3))
            side = np.concatenate([h[:, 3] if h.shape[1] == 4 else np.zeros(len(h), np.int64) for h in held])
            order = np.argsort(key)
            yield from pairs(key[order], cls[order], mark[order].view(np.uint64), side[order])

    return run


BAND_ROW = "key long, cls long, mark long, side byte"


def hot_keys(sets: DataFrame, rows: int, bands: int, seed: int, block: int, sampled: int) -> dict[int, int]:
    """Band hash -> number of blocks for those that more than about ``block`` classes share; at most MAX_HOT of them."""
    some = sets.where(F.pmod("cls", F.lit(sampled)) == 0).select("cls", "ws").mapInArrow(_banding(rows, bands, seed, {}), BAND_ROW)
    counted = some.groupBy("key").agg(F.approx_count_distinct("cls").alias("n")).where(F.col("n") > max(2.0, block / sampled))
    found = counted.orderBy(F.desc("n"), "key").limit(MAX_HOT).collect()
    return {r["key"]: min(256, math.ceil(r["n"] * sampled / block) + 1) for r in found}


def similar_classes(sets: DataFrame, threshold: float, rows: int, recall: float, seed: int = 7, block: int = BLOCK, sampled: int = SAMPLED) -> DataFrame:
    """(a, b): pairs a < b of classes (cls, ws) whose word sets have at least ``threshold`` in common."""
    bands = bands_for(threshold, rows, recall)
    hot = hot_keys(sets, rows, bands, seed, block, sampled)
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * tasks, math.ceil(sets.count() * bands / BUCKET))
    dealt = sets.select("cls", "ws").mapInArrow(_dealing(_banding(rows, bands, seed, hot), buckets), "bucket int, width int, rows binary")
    met = dealt.repartitionById(tasks, F.pmod("bucket", F.lit(tasks))).sortWithinPartitions("bucket").mapInArrow(_meeting(threshold), "a long, b long")
    pairs = materialise(met.distinct())
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    held = sets.select("cls", "ws").join(needed, "cls", "left_semi").dropDuplicates(["cls"])
    first = pairs.join(held.select(F.col("cls").alias("a"), F.col("ws").alias("wa")), "a")
    both = first.join(held.select(F.col("cls").alias("b"), F.col("ws").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    return both.where(common >= F.lit(threshold) * (F.size("wa") + F.size("wb") - common)).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, time_col: str | None = None, leave_out: DataFrame | None = None, threshold: float = 0.7, rows: int = 5, recall: float = 0.95, block: int = BLOCK, sampled: int = SAMPLED):
    """(members, links): every post with its class of equal word sets (id, cls), and the similar classes (a, b).

    leave_out: posts (by id) that take no part. Links are between classes that have members.
    """
    sets = materialise(word_sets(df, id_col, text_col, time_col))
    members = first_delivery(sets, id_col, ["cls"], time_col)
    if leave_out is not None:
        members = members.join(leave_out.select(id_col), id_col, "left_anti")
    members = materialise(members)
    links = similar_classes(sets, threshold, rows, recall, block=block, sampled=sampled)
    there = members.select("cls").distinct()
    for end in ("a", "b"):
        links = links.join(there.withColumnRenamed("cls", end), end, "left_semi")
    return members, materialise(links.select("a", "b"))


def all_pairs(members: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """(seq_a, seq_b): every pair of posts of equal or similar classes, smaller id first."""
    a, b = members.select(F.col(id_col).alias("ia"), F.col("cls").alias("a")), members.select(F.col(id_col).alias("ib"), F.col("cls").alias("b"))
    several = members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    equal = several.join(a, "a").join(b, "b").where("ia < ib").select(F.col("ia").alias("seq_a"), F.col("ib").alias("seq_b"))
    near = links.join(a, "a").join(b, "b").select(F.least("ia", "ib").alias("seq_a"), F.greatest("ia", "ib").alias("seq_b"))
    return equal.unionByName(near)


def duplicate_groups(members: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """(id, cls, links, group): one row per post with its class, the number of similar classes and the smallest class of its group."""
    ends = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    groups = connected_components(links).select(F.col("node_id").alias("cls"), F.col("group_id").alias("group"))
    return members.join(ends, "cls", "left").join(groups, "cls", "left").select(id_col, "cls", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", "cls").alias("group"))
