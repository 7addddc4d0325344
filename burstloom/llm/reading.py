"""Problem 10: reading level of each document.

A smoothed unigram language model per grade, trained on the graded sample, and Bayes' rule: a document gets the grade with the
highest posterior likelihood of its words. A word that few graded documents hold is replaced by a class (its ending, or script and
length), so that names count by how usual such words are at a grade and not one by one. Word probabilities are normalised within
their script, as the script that a text is in says nothing of its level. The strength of the smoothing is the candidate under which
held-out graded documents are likeliest.

The models are fitted on at most ``max_graded`` graded documents (those with the smallest seeded hash of their identifier). This
bounds what reaches the driver and every task; a word gets probabilities of its own if ``min_share`` of these documents hold it. All
documents are scored, over their whole texts.

Defined results: a null, empty or wordless text has no level (null); null grades are no labels, and a document graded several times
counts with each grade by its share; graded ids without a document are ignored; without any label all levels are null; extra
columns are ignored; ties go to the lower grade.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstloom.llm.words import WordNumbers, bare_list

#: graded documents that the models are fitted on
MAX_GRADED = 5_000
#: words that the grade profile of a word's class counts for: the candidates
SMOOTHING = (0.3, 1.0, 3.0, 10.0, 30.0, 100.0)
FOLDS = 4


def _script(word: str) -> int:
    c = word[0]
    return 0 if c.isdigit() else 1 if c < "ɐ" else 2 if "؀" <= c < "܀" else 3


def _class_of(word: str) -> str:
    return f"\x00{_script(word)}" + (word[-3:] if len(word) > 6 else str(len(word)))


@dataclass
class Model:
    """numbers: word or class -> row; logs: row x grade, the last row for what was never seen; prior: log-shares of the grades."""

    numbers: dict[str, int]
    logs: np.ndarray
    prior: np.ndarray
    grades: list[int]

    def number(self, word: str) -> int:
        at = self.numbers.get(word)
        return at if at is not None else self.numbers.get(_class_of(word), len(self.logs) - 1)


def graded_sample(docs: DataFrame, levels: DataFrame, id_col: str, text: str, grade: str, max_graded: int, seed: int) -> DataFrame:
    """(grades, shares, words, counts) of the graded documents that the models are fitted on."""
    marks = levels.where(F.col(grade).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_d"), F.col(grade).cast("int").alias("_g")).agg(F.count("*").alias("_n"))
    per_doc = marks.groupBy("_d").agg(F.collect_list(F.struct("_g", "_n")).alias("_marks"))
    chosen = per_doc.orderBy(F.xxhash64("_d", F.lit(seed)), "_d").limit(max_graded)
    # at most max_graded rows
    held = docs.where(F.col(text) != "").select(F.col(id_col).alias("_d"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_d").select("_marks", "_t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grades, shares, words, counts = [], [], [], []
            for marked, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = Counter(bare_list(t))
                if found:
                    total = sum(m["_n"] for m in marked)
                    grades.append([m["_g"] for m in marked])
                    shares.append([m["_n"] / total for m in marked])
                    words.append(list(found))
                    counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(grades, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64())), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], names=["grades", "shares", "words", "counts"])

    return held.mapInArrow(count, "grades array<int>, shares array<double>, words array<string>, counts array<long>")


def train(docs: DataFrame, levels: DataFrame, id_col: str = "doc_id", text: str = "text", grade: str = "grade", max_graded: int = MAX_GRADED, min_docs: int = 4, min_share: float = 0.005, seed: int = 0) -> Model:
    """The models of all grades, fitted on the driver from the counted words of the bounded sample."""
    sample = graded_sample(docs, levels, id_col, text, grade, max_graded, seed).toArrow().combine_chunks()
    if not len(sample):
        return Model({}, np.zeros((1, 0)), np.zeros(0), [])
    column = {c: sample.column(c).combine_chunks() for c in sample.column_names}
    grades = sorted(set(column["grades"].flatten().to_pylist()))
    weight = np.zeros((len(sample), len(grades)))
    rows = np.repeat(np.arange(len(sample)), np.diff(column["grades"].offsets))
    np.add.at(weight, (rows, np.searchsorted(grades, column["grades"].flatten().to_numpy())), column["shares"].flatten().to_numpy())
    doc = np.repeat(np.arange(len(sample)), np.diff(column["words"].offsets))
    coded = column["words"].flatten().dictionary_encode()
    texts, code, n = coded.dictionary.to_pylist(), coded.indices.to_numpy(), column["counts"].flatten().to_numpy().astype(float)
    usual = np.bincount(code, minlength=len(texts)) >= max(min_docs, round(min_share * len(sample)))
    # rows of the table: usual words, then classes, then what was never seen
    numbers: dict[str, int] = {texts[i]: at for at, i in enumerate(np.flatnonzero(usual))}
    words = len(numbers)
    class_at = np.array([numbers.setdefault(_class_of(w), len(numbers)) for w in texts])
    row = np.where(usual, np.cumsum(usual) - 1, class_at)
    size = len(numbers)
    script = np.zeros(size, np.int64)
    script[row], script[class_at] = [_script(w) for w in texts], [_script(w) for w in texts]
    of_word = class_at[usual]  # the class of every usual word
    cell = row[code]

    def fit(weight: np.ndarray, smoothing: float) -> np.ndarray:
        counts = np.stack([np.bincount(cell, n * weight[doc, g], size) for g in range(len(grades))], 1)
        in_class = counts.copy()
        np.add.at(in_class, of_word, counts[:words])
        share = counts.sum(0) / max(counts.sum(), 1e-12)
        profile = (in_class + smoothing * share) / (in_class.sum(1, keepdims=True) + smoothing)
        table = counts + smoothing * np.concatenate([profile[of_word], profile[words:]]) + 1e-9
        for s in np.unique(script):
            table[script == s] /= table[script == s].sum(0)
        return np.log(table)

    def held_out(smoothing: float) -> float:
        total = 0.0
        for fold in range(FOLDS):
            out = (np.arange(len(sample)) % FOLDS == fold)[:, None]
            logs = fit(weight * ~out, smoothing)
            w = weight * out
            total += sum(float((n * w[doc, g]) @ logs[cell, g]) for g in range(len(grades)))
        return total

    smoothing = max(SMOOTHING, key=held_out) if len(sample) >= FOLDS else SMOOTHING[2]
    logs = np.vstack([fit(weight, smoothing), np.zeros(len(grades))])
    return Model(numbers, logs, np.log(weight.sum(0) / weight.sum()), grades)


def reading_levels(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, level, margin): the likeliest grade of every document and its log-odds to the next one, per word."""
    schema = docs.select(id_col).withColumn("level", F.lit(None).cast("int")).withColumn("margin", F.lit(None).cast("double")).schema
    if not model.grades:
        return docs.select(id_col, F.lit(None).cast("int").alias("level"), F.lit(None).cast("double").alias("margin"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = WordNumbers(m.number)
        grades = np.array(m.grades)
        for b in batches:
            found = [known.of(t) for t in b.column(1).to_pylist()]
            sizes = np.array([len(x) for x in found], np.int64)
            some = np.flatnonzero(sizes)
            level, margin = np.zeros(len(b), np.int32), np.zeros(len(b))
            if len(some):
                flat = np.fromiter((n for x in found for n in x), np.int64, int(sizes.sum()))
                starts = np.cumsum(sizes[some]) - sizes[some]
                total = np.stack([np.add.reduceat(m.logs[flat, g], starts) for g in range(len(grades))], 1) + m.prior
                level[some] = grades[total.argmax(1)]
                if len(grades) > 1:
                    top = np.sort(total, 1)
                    margin[some] = (top[:, -1] - top[:, -2]) / sizes[some]
            none = sizes == 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(level, mask=none), pa.array(margin, mask=none)], names=[id_col, "level", "margin"])

    return docs.select(id_col, F.col(text).alias("_t")).mapInArrow(score, schema)
