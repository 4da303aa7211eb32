"""Toxicity as severity grades by cumulative-link ordinal regression over sparse text features.

Features of a text are its words (runs of letters and digits, A-Z lowered) and the first four and six bytes of its longer words, as
64-bit hashes; a value is log(1 + occurrences). The grades are 0 (not toxic), 1 (mild) and 2 (severe). Labels only tell toxic
from not toxic, so a toxic document's grade is set from its number of marker words, the features most tied to the label: above the median of
toxic documents it is severe.

The model is P(grade >= k) = logistic(w.x - cut_k): one weight for each feature, shared by both thresholds, and two ordered cuts.
The expected severity is the sum of both probabilities; a document is toxic if P(grade >= 1) reaches THRESHOLD.

* The model is fitted on a bounded sample of labelled documents, SAMPLE rows of smallest digest, of which crc32(doc_id) mod 4 = 2 is left
  out for tests. CANDIDATES, FEATURES bound the features. Nothing else is bounded: every whole text is scored.
* Features are counted in the map tasks; the sample is broadcast, as its size is bounded, so no text is shuffled.

A null or empty text has no features; its probabilities follow from the cuts alone. Null labels are none; the largest of several counts.
Without toxic documents in the sample nothing is toxic. Repeated rows score alike. The report reads no other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm import words
from sitewright.llm.tables import batched

SAMPLE, CANDIDATES, FEATURES = 20_000, 50_000, 3_000
#: Toxic documents of the sample that must have a feature.
LEAST = 4
THRESHOLD = 0.4
PREFIXES = (4, 6)


def features(piece: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature hash and row of every word and word beginning of a slice."""
    keys, rows = [piece.hash], [piece.doc]
    for size in PREFIXES:
        long = np.flatnonzero(piece.end - piece.start > size)
        keys.append(words.mixed(piece.parts(piece.start[long], piece.start[long] + size) + np.uint64(size)))
        rows.append(piece.doc[long])
    return np.concatenate(keys), np.concatenate(rows)


class _Known:
    """Sorted feature hashes with a bit table that turns most others away before the search."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(44)
        self.gate = np.zeros(1 << 20, dtype=bool)
        self.gate[keys >> self.shift] = True

    def counts(self, piece: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, feature and number of occurrences."""
        if not len(self.keys):
            return (np.zeros(0, np.int64),) * 3
        keys, rows = features(piece)
        may = np.flatnonzero(self.gate[keys >> self.shift])
        at = np.minimum(np.searchsorted(self.keys, keys[may]), len(self.keys) - 1)
        hit = self.keys[at] == keys[may]
        pairs, many = np.unique(rows[may[hit]] * len(self.keys) + at[hit], return_counts=True)
        return pairs // len(self.keys), pairs % len(self.keys), many


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def probabilities(self, piece: words.Words, known: _Known) -> np.ndarray:
        row, feature, many = known.counts(piece)
        score = np.bincount(row, weights=self.weights[feature] * np.log1p(many), minlength=piece.rows) if len(row) else np.zeros(piece.rows)
        return _logistic(score[:, None] - self.cuts[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit_ordinal(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int, steps: int = 400, penalty: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing cuts of largest penalised likelihood, by gradient steps of adapted size."""
    share = [np.clip((grade >= k).mean(), 1e-3, 1 - 1e-3) for k in (1, 2)]
    first = [np.log((1 - s) / s) for s in share]
    point = np.concatenate([np.zeros(width), [first[0], np.log(max(first[1] - first[0], 1e-2))]])
    mean, square = np.zeros_like(point), np.zeros_like(point)
    for step in range(1, steps + 1):
        weights, low, gap = point[:width], point[width], np.exp(point[width + 1])
        score = np.bincount(row, weights=weights[column] * value, minlength=len(grade))
        above = np.column_stack([np.ones(len(grade)), _logistic(score - low), _logistic(score - low - gap), np.zeros(len(grade))])
        own, over = above[np.arange(len(grade)), grade], above[np.arange(len(grade)), grade + 1]
        pull = 1 - own - over
        chance = np.maximum(own - over, 1e-12)
        slope = above * (1 - above)
        to_cut = np.zeros((len(grade), 4))
        to_cut[np.arange(len(grade)), grade] -= slope[np.arange(len(grade)), grade] / chance
        to_cut[np.arange(len(grade)), grade + 1] += slope[np.arange(len(grade)), grade + 1] / chance
        gradient = np.concatenate([np.bincount(column, weights=pull[row] * value, minlength=width) - penalty * weights, [to_cut[:, 1:3].sum(), to_cut[:, 2].sum() * gap]])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        point = point + 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    low = point[width]
    return point[:width], np.array([low, low + np.exp(point[width + 1])])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts and labels of the sample; at most SAMPLE labels are broadcast."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")


def _counted(sample: DataFrame, keys: np.ndarray | None) -> DataFrame:
    """key, toxic and the number of documents that have the feature. Without keys: all features, of toxic documents only."""
    known = None if keys is None else sample.sparkSession.sparkContext.broadcast(_Known(keys))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for piece in words.slices(batch.column(0), words.NOT_ALPHANUMERIC, lower=True):
                own = label[piece.row : piece.row + piece.rows]
                if known is None:
                    keys, rows = features(piece)
                    order = np.lexsort((rows, keys))
                    keys, rows = keys[order], rows[order]
                    fresh = np.ones(len(keys), dtype=bool)
                    fresh[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
                    keys, rows = keys[fresh], rows[fresh]
                else:
                    rows, at, _ = known.value.counts(piece)
                    keys = known.value.keys[at]
                for grade in (0, 1):
                    found, many = np.unique(keys[own[rows] == grade], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), grade, np.int32)), pa.array(many)], ["key", "toxic", "n"])

    return sample.select("text", "toxic").mapInArrow(counts, "key long, toxic int, n long").groupBy("key", "toxic").agg(F.sum("n").alias("n"))


def _selected(sample: DataFrame, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features most tied to the label, sorted, and which of them mark toxic texts."""
    often = _counted(sample.where("toxic = 1"), None).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "key").limit(CANDIDATES)
    keys = np.sort(np.array([row.key for row in often.select("key").collect()], dtype=np.int64).view(np.uint64))
    if not len(keys):
        return keys, np.zeros(0, dtype=bool)
    table = np.zeros((2, len(keys)))
    for row in _counted(sample, keys).collect():
        table[row.toxic, np.searchsorted(keys, np.int64(row.key).view(np.uint64))] = row.n
    rate = (table + 0.5) / (np.array([[sizes.get(0, 0)], [sizes.get(1, 0)]]) + 1)
    odds = np.log(rate[1] / (1 - np.minimum(rate[1], 0.999))) - np.log(rate[0] / (1 - np.minimum(rate[0], 0.999)))
    strength = odds / np.sqrt((1 / (table + 0.5)).sum(axis=0))
    best = np.sort(np.argsort(-strength, kind="stable")[:FEATURES])
    best = best[strength[best] > 3]
    return keys[best], odds[best] > 3


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = _sample(batched(docs), labels)
    sizes = {row.toxic: row.n for row in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    keys, marks = _selected(sample, sizes)
    if not len(keys):
        return Model(keys, np.zeros(0), np.array([np.inf, np.inf]))
    known = sample.sparkSession.sparkContext.broadcast(_Known(keys))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.slices(batch.column(1), words.NOT_ALPHANUMERIC, lower=True):
                row, feature, many = known.value.counts(piece)
                first = np.searchsorted(row, np.arange(piece.rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x.astype(np.int32))) for x in (feature, many)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(piece.row, piece.rows) for i in (0, 2)], *lists], ["doc_id", "toxic", "feature", "many"])

    collected = sorted(sample.select("doc_id", "text", "toxic").mapInArrow(rows, "doc_id long, toxic int, feature array<int>, many array<int>").collect())
    counts = np.array([len(x.feature) for x in collected])
    column = np.array([f for x in collected for f in x.feature], dtype=np.int64)
    many = np.array([n for x in collected for n in x.many], dtype=np.float64)
    row = np.repeat(np.arange(len(collected)), counts)
    toxic = np.array([x.toxic for x in collected])
    marked = np.bincount(row, weights=many * marks[column], minlength=len(collected))
    grade = np.where(toxic == 1, 1 + (marked > np.median(marked[toxic == 1])), 0)
    return Model(keys, *fit_ordinal(row, column, np.log1p(many), grade, len(keys)))


_SCORES = "n_words long, p_mild double, p_severe double, expected_severity double, toxic boolean"


def _scored(docs: DataFrame, model: Model, text: int, schema: str, keep) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((model, _Known(model.keys)))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        for batch in batches:
            for piece in words.slices(batch.column(text), words.NOT_ALPHANUMERIC, lower=True):
                yield keep(batch.slice(piece.row, piece.rows), piece.counts, model.probabilities(piece, known))

    return batched(docs).mapInArrow(scores, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, P(grade >= 1), P(grade >= 2), expected severity and whether the document is toxic, for every document."""
    def keep(batch: pa.RecordBatch, counts: np.ndarray, chance: np.ndarray) -> pa.RecordBatch:
        columns = [batch.column(0), pa.array(counts), pa.array(chance[:, 0]), pa.array(chance[:, 1]), pa.array(chance.sum(axis=1)), pa.array(chance[:, 0] >= THRESHOLD)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "p_mild", "p_severe", "expected_severity", "toxic"])

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return _scored(texts, fit(docs, labels), 1, f"doc_id long, {_SCORES}", keep)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    def keep(batch: pa.RecordBatch, counts: np.ndarray, chance: np.ndarray) -> pa.RecordBatch:
        return batch.filter(pa.array(chance[:, 0] < THRESHOLD))

    return _scored(docs, fit(docs, labels), docs.columns.index("text"), docs.schema, keep)
