"""Problem 8: evaluation texts leaking into training text.

A prefix-filtered set join. Every item-sized window (``n`` consecutive words of an item) is a set of word shingles, all of which
must occur in a document that contains it. Shingles are ordered by rarity, and the necessary prefix of a window is its one rarest
shingle; windows and documents are joined on it in a shuffle. The position of the shingle puts the window at one place in the document, where
its words are compared exactly.

Documents come to the join as runs only: stretches in which every shingle is one of the items', long enough for a window (the length
bound). A filter of fixed largest size tells a task which shingles the items have; what it lets through by mistake is dropped by the
join. So documents are read once, and neither items nor documents ever meet in one place.

Words are compared in lower case and in one form: without marks, joiners, invisible characters and look-alike differences.

Defined results: null, empty and short texts contain nothing; an item of fewer than ``n`` words cannot leak; equal items all
count; a passage found several times in a document counts once; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstloom.llm.words import WordNumbers, bare_list
from burstloom.session import materialise

#: words of a shingle
SHINGLE = 6
#: bits of the filter: so many a shingle, and at most
BITS_A_SHINGLE, MAX_BITS = 16, 1 << 27
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _words(text: str) -> list[str]:
    return [w for piece in text.split() for w in bare_list(piece)]


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The hash of the ``k`` words from every place on; the last k - 1 places are left out."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = out * _STEP + words[j : j + len(out)]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def item_words(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """(item, ws, hs): the words and shingle hashes of every item of at least ``n`` words."""
    kept = items.where(F.col(item_id).isNotNull() & (F.col(text) != "")).select(F.col(item_id).alias("item"), F.col(text).alias("t"))
    schema = kept.select("item").withColumns({"ws": F.lit(None).cast("array<string>"), "hs": F.lit(None).cast("array<long>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, ws) for i, t in enumerate(b.column(1).to_pylist()) if len(ws := _words(t)) >= n]
            hs = [shingles(np.array([_word_hash(w) for w in ws], np.uint64)).view(np.int64) for _, ws in found]
            ids = b.column(0).take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([ws for _, ws in found], pa.list_(pa.string())), pa.array(hs, pa.list_(pa.int64()))], names=["item", "ws", "hs"])

    return kept.mapInArrow(run, schema)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for every hash."""
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def shingle_filter(held: DataFrame) -> np.ndarray:
    """A bitmap of the items' shingles, added up by its words in the cluster; its size is bounded by MAX_BITS."""
    every = held.select(F.explode("hs").alias("h"))
    many = every.count()
    bits = min(MAX_BITS, 1 << max(16, (many * BITS_A_SHINGLE).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits >> 6, np.uint64)
        for b in batches:
            for at in _places(b.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(own, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own[some].view(np.int64))], names=["i", "m"])

    rows = every.mapInArrow(mark, "i long, m long").groupBy("i").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[rows.column("i").to_numpy()] = rows.column("m").to_numpy().view(np.uint64)
    return out


def document_runs(docs: DataFrame, doc_id: str, text: str, known: np.ndarray, n: int) -> DataFrame:
    """(doc, run, ws, hs): the stretches of a document, of ``n`` words or more, in which the filter knows every shingle."""
    kept = docs.where(F.col(doc_id).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).alias("doc"), F.col(text).alias("t"))
    schema = kept.select("doc").withColumns({"run": F.lit(None).cast("long"), "ws": F.lit(None).cast("array<string>"), "hs": F.lit(None).cast("array<long>")}).schema
    shared = docs.sparkSession.sparkContext.broadcast(known)
    least = n - SHINGLE + 1  # shingles of a window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        bits = len(table) << 6
        numbers = WordNumbers(_word_hash)
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [numbers.of(t) for t in texts]
            sizes = np.array([len(x) for x in found], np.int64)
            flat = np.fromiter((h for x in found for h in x), np.uint64, int(sizes.sum()))
            hs = shingles(flat)
            if not len(hs):
                continue
            owner = np.repeat(np.arange(len(b)), sizes)
            hit = owner[: len(hs)] == owner[SHINGLE - 1 :]  # a shingle lies in one document
            for at in _places(hs, bits):
                hit &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            # a run ends where a shingle is unknown or the document ends (there the last shingles of a document lie in none)
            edges = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
            starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            long = ends - starts >= least
            rows, places, ws, codes = [], [], [], []
            begins = np.cumsum(sizes) - sizes
            of_doc: tuple[int, list[str]] = (-1, [])
            for lo, hi in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
                i = int(owner[lo])
                if of_doc[0] != i:
                    of_doc = i, _words(texts[i])
                at = lo - int(begins[i])
                rows.append(i)
                places.append(at)
                ws.append(of_doc[1][at : at + hi - lo + SHINGLE - 1])
                codes.append(hs[lo:hi].view(np.int64))
            ids = b.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(places, pa.int64()), pa.array(ws, pa.list_(pa.string())), pa.array(codes, pa.list_(pa.int64()))], names=["doc", "run", "ws", "hs"])

    return kept.mapInArrow(run, schema)


def rarest_shingles(held: DataFrame, frequency: DataFrame, n: int) -> DataFrame:
    """(item, start, h, offset): the rarest shingle of every window of an item; windows with a shingle that no document has are left out."""
    places = held.select("item", F.posexplode("hs").alias("pos", "h"), F.size("ws").alias("length"))
    counted = places.join(frequency, "h", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    window = Window.partitionBy("item").orderBy("pos").rowsBetween(0, n - SHINGLE)
    chosen = counted.withColumn("m", F.min(F.struct("freq", "pos", "h")).over(window)).where((F.col("pos") + n <= F.col("length")) & (F.col("m.freq") > 0))
    return chosen.select("item", F.col("pos").alias("start"), F.col("m.h").alias("h"), (F.col("m.pos") - F.col("pos")).alias("offset"))


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", n: int = 12) -> DataFrame:
    """(doc_id, item_id) wherever a document contains ``n`` consecutive words of an item; ``n`` is at least SHINGLE."""
    held = materialise(item_words(items, item_id, text, n))
    runs = materialise(document_runs(docs, doc_id, text, shingle_filter(held), n))
    hits = runs.select("doc", "run", F.posexplode("hs").alias("pos", "h"), F.size("ws").alias("length"))
    windows = rarest_shingles(held, hits.groupBy("h").agg(F.count("*").alias("freq")), n)
    placed = hits.join(windows, "h").withColumn("at", F.col("pos") - F.col("offset")).where((F.col("at") >= 0) & (F.col("at") + n <= F.col("length")))
    found = placed.select("doc", "run", "at", "item", "start").join(runs.select("doc", "run", F.col("ws").alias("in_doc")), ["doc", "run"]).join(held.select("item", F.col("ws").alias("in_item")), "item")
    same = F.slice("in_doc", F.col("at") + 1, F.lit(n)) == F.slice("in_item", F.col("start") + 1, F.lit(n))
    return found.where(same).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).distinct()
