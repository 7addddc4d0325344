"""Problem 5: frequency of every distinct value or term.

A global dictionary gives each distinct term an integer (partition number and place in it). Rows are encoded with it, and
from then on only integers move: every task adds its rows to blockwise count arrays, one for occurrences and one
for records, and the arrays are added up by identifier range. The text is joined back to the finished counts.

Defined results: null and empty terms are no terms; a row delivered twice (same record and position) counts once, with
the term of the lower identifier if the two differ; rows without a record id are ignored; an empty table gives no rows; extra columns are ignored.
A term that is both rare and common (very small collections) is marked rare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstloom.session import materialise

#: identifiers of one count array
BLOCK_BITS = 14
#: blocks that a task holds before it passes on what it has counted
MAX_BLOCKS = 400


def dictionary(rows: DataFrame, term: str) -> DataFrame:
    """(term, id): the distinct terms with integers whose upper bits are a range of up to 2**14 neighbours."""
    terms = rows.where(F.col(term).isNotNull() & (F.col(term) != "")).select(F.col(term).alias("term")).distinct()
    return materialise(terms.withColumn("id", F.monotonically_increasing_id()))


def _filled(occurrences: dict[int, np.ndarray], presence: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The cells of the arrays that are not zero. A term may be present from before while its record goes on."""
    for block, counts in occurrences.items():
        at = np.flatnonzero(counts)
        there = presence[block][at] if block in presence else np.zeros(len(at), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at + (block << BLOCK_BITS)), pa.array(counts[at]), pa.array(there)], names=["id", "occurrences", "records"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blockwise arrays of one partition, given as its cells that are not zero; rows of a record are neighbours.

    The row with id -1 holds the number of records. A partition is sorted by record, so presence is the first of
    equal (record, id) pairs within a record.
    """
    occurrences: dict[int, np.ndarray] = {}
    presence: dict[int, np.ndarray] = {}
    records, last = 0, None
    seen_rest: tuple[int | None, np.ndarray] = (None, np.empty(0, np.int64))
    mask = (1 << BLOCK_BITS) - 1

    def add(store: dict[int, np.ndarray], ids: np.ndarray) -> None:
        for block in np.unique(ids >> BLOCK_BITS):
            cells = ids[(ids >> BLOCK_BITS) == block] & mask
            counts = np.bincount(cells, minlength=mask + 1)
            if block in store:
                store[block] += counts
            else:
                store[block] = counts.astype(np.int64)

    for batch in batches:
        rec, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(rec):
            continue
        add(occurrences, ids)
        fresh = np.concatenate([[True], rec[1:] != rec[:-1]])
        records += int(fresh.sum()) - int(last is not None and rec[0] == last)
        last = rec[-1]
        pairs = np.unique(np.stack([rec, ids]), axis=1)
        new = pairs[1][~((pairs[0] == seen_rest[0]) & np.isin(pairs[1], seen_rest[1]))] if seen_rest[0] is not None else pairs[1]
        add(presence, new)
        if len(occurrences) > MAX_BLOCKS:
            yield from _filled(occurrences, presence)
            occurrences.clear()
            presence.clear()
        tail = pairs[1][pairs[0] == last]
        seen_rest = (last, np.union1d(tail, seen_rest[1]) if seen_rest[0] == last else tail)
    yield from _filled(occurrences, presence)
    if records:
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([records]), pa.array([records])], names=["id", "occurrences", "records"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the arrays of the identifier ranges of one partition as they stream in."""
    store: dict[int, np.ndarray] = {}
    mask = (1 << BLOCK_BITS) - 1
    for batch in batches:
        ids, occ, rec = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for block in np.unique(ids >> BLOCK_BITS):
            at = (ids >> BLOCK_BITS) == block
            held = store.setdefault(int(block), np.zeros((2, mask + 1), np.int64))
            np.add.at(held[0], ids[at] & mask, occ[at])
            np.add.at(held[1], ids[at] & mask, rec[at])
    for block, held in store.items():
        at = np.flatnonzero(held[0])
        yield pa.RecordBatch.from_arrays([pa.array(at + (block << BLOCK_BITS)), pa.array(held[0][at]), pa.array(held[1][at])], names=["id", "occurrences", "records"])


def term_frequencies(rows: DataFrame, record: str, position: str, term: str, min_records: int = 3, max_share: float = 0.05) -> DataFrame:
    """(term, occurrences, records, mark): mark is ``rare`` under ``min_records`` records, ``common`` over ``max_share`` of the
    records that have a term, else null."""
    kept = rows.select(F.col(record).cast("long").alias("rec"), F.col(position).cast("long").alias("pos"), F.col(term).alias("term")).where(
        F.col("rec").isNotNull() & F.col("term").isNotNull() & (F.col("term") != "")
    )
    ids = dictionary(kept, "term")
    encoded = kept.join(ids, "term").select("rec", "pos", "id")
    by_record = encoded.repartition("rec").sortWithinPartitions("rec")
    once = by_record.groupBy("rec", "pos").agg(F.min("id").alias("id")).select("rec", "id").sortWithinPartitions("rec")
    blocks = once.mapInArrow(_count, "id long, occurrences long, records long")
    summed = materialise(blocks.repartition(F.shiftright("id", BLOCK_BITS)).mapInArrow(_sum, "id long, occurrences long, records long"))
    total = summed.where("id = -1").agg(F.sum("records")).first()[0] or 0
    share = F.col("records") / F.lit(float(max(total, 1)))
    mark = F.when(F.col("records") < min_records, "rare").when(share > max_share, "common")
    counted = summed.where("id >= 0").join(ids, "id")
    return counted.select("term", "occurrences", "records", mark.alias("mark"))
