"""Vector codes of a product quantiser, fitted over all vectors with adaptive distance bounds.

Vectors are cut into consecutive parts, and every part position has a codebook of `entries` vectors that Lloyd's rounds improve. A stored table carries
for each part: its entry, an upper bound of the distance to it, its b closest other entries with lower bounds in
ascending order, and one outer bound for all entries that are not named. When the entries have moved, each bound is loosened by its entry's move, the outer one by the
largest move. Counting the bounds that do not exceed the upper bound gives the number z of named entries that may have come closer:

* z = 0: the entry stays, unseen. Otherwise the distance to the own entry is computed and z counted again.
* z up to b, the outer bound holding: only the first z named entries are computed and put in order again.
* Beyond: all entries are computed, and the b closest are named anew.

Everything computed is an integer, and ties go to the smaller index, so codes are those of plain rounds. b is set for each part position and adapted: from the counts of z over all rows
the number is taken that costs the fewest distances, never more than before and one less at most. Every round writes a new table of bounds, from which the sums by entry are read; the
replaced table is deleted. Tasks sum by entry first; entries x width numbers a round reach the driver.

* Kept are vectors without null or non-finite components. Those of another length than the most common one (of equally common ones the longest) have no place in the codebooks
  and get no row; vectors without components neither.
* A codebook starts from the smallest ids, those without an id last; rows that repeat an id are ordered by their vectors. With fewer vectors than entries there
  are as many entries as vectors. A length that cannot be divided evenly is cut at floor(i * length / parts).
* Errors are added up by label without gathering a label's rows; null is a label of its own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm import integer_vectors as iv

#: Rows of one label are dealt out over so many parts when the label's sum is joined to them.
SALTS = 32
_STATE = "vec_id long, label string, vector binary, code binary, upper binary, near binary, low binary, outer binary, sums array<long>"
_NAMES = ["vec_id", "label", "vector", "code", "upper", "near", "low", "outer"]
_KINDS = [pa.int64(), pa.string(), *[pa.binary()] * 6]
_FINAL = "vec_id long, label string, code binary, error long"


@dataclass
class Bounds:
    """State of one part position: entry, upper bound, named entries, their lower bounds, and the outer bound."""

    code: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    low: np.ndarray
    outer: np.ndarray

    def ordered(self) -> None:
        """Each lower bound also holds for all entries behind it."""
        for column in range(self.near.shape[1] - 1, -1, -1):
            behind = self.low[:, column + 1] if column + 1 < self.near.shape[1] else self.outer
            self.low[:, column] = np.minimum(self.low[:, column], behind)

    def narrowed(self, named: int) -> None:
        """Names fewer entries; the first bound dropped becomes the outer one."""
        if named < self.near.shape[1]:
            self.outer = self.low[:, named].copy()
            self.near, self.low = self.near[:, :named].copy(), self.low[:, :named].copy()


def _in_order(square: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and names by distance, ties by name."""
    order = np.lexsort((names, square), axis=1)
    return np.take_along_axis(square, order, axis=1), np.take_along_axis(names, order, axis=1)


def evaluated(part: np.ndarray, entries: np.ndarray, named: int) -> Bounds:
    """All distances of a part position; the `named` closest entries after the first are named."""
    square = iv.distances(part, entries)
    square, names = _in_order(square, np.broadcast_to(np.arange(len(entries)), square.shape))
    outer = iv.root_below(square[:, named + 1]) if named + 1 < len(entries) else np.full(len(part), iv.TOP)
    return Bounds(names[:, 0].copy(), iv.root_above(square[:, 0]), names[:, 1 : named + 1].copy(), iv.root_below(square[:, 1 : named + 1]), outer)


def updated(part: np.ndarray, entries: np.ndarray, moves: np.ndarray, state: Bounds) -> np.ndarray:
    """Brings the bounds up to the present entries, in place; returns how many named entries were in doubt for each row (b + 1: all)."""
    named = state.near.shape[1]
    state.upper += moves[state.code]
    state.low -= moves[state.near]
    state.outer -= moves.max(initial=0)
    state.ordered()
    z = np.zeros(len(part), dtype=np.int64)
    at = np.flatnonzero(_doubts(state, slice(None)) > 0)
    if len(at):
        own = iv.squares(part[at], entries[state.code[at]])
        state.upper[at] = iv.root_above(own)
        z[at] = _doubts(state, at)
    for depth in range(1, named + 1):
        rows = np.flatnonzero(z == depth)
        if len(rows):
            names = np.concatenate([state.code[rows, None], state.near[rows, :depth]], axis=1)
            square, names = _in_order(iv.squares(part[rows, None, :], entries[names]), names)
            state.code[rows], state.near[rows, :depth] = names[:, 0], names[:, 1:]
            state.upper[rows], state.low[rows, :depth] = iv.root_above(square[:, 0]), iv.root_below(square[:, 1:])
    rows = np.flatnonzero(z > named)
    if len(rows):
        fresh = evaluated(part[rows], entries, named)
        state.code[rows], state.upper[rows], state.near[rows], state.low[rows], state.outer[rows] = fresh.code, fresh.upper, fresh.near, fresh.low, fresh.outer
    state.ordered()
    return z


def _doubts(state: Bounds, rows) -> np.ndarray:
    """Bounds that do not exceed the upper bound; they ascend, so these are the first ones."""
    upper = state.upper[rows]
    return (state.low[rows] <= upper[:, None]).sum(axis=1) + (state.outer[rows] <= upper)


def adapted(counts: np.ndarray, named: int, entries: int) -> int:
    """The number of named entries that costs the fewest distances, given how many rows were in doubt about 0, 1, 2 ... entries; at most one less than before."""
    total = max(1, counts.sum())
    costs = [b + entries * counts[b + 1 : named + 2].sum() / total for b in range(1, named + 1)]
    return max(named - 1, 1 + int(np.argmin(costs))) if costs else named


@dataclass
class Layout:
    """Where parts lie in a vector, and how many entries are named at each position."""

    cuts: list[int]
    named: list[int]
    entries: int

    @property
    def parts(self) -> int:
        return len(self.cuts) - 1

    @property
    def width(self) -> int:
        return self.cuts[-1]

    def part(self, vectors: np.ndarray, at: int) -> np.ndarray:
        return vectors[:, self.cuts[at] : self.cuts[at + 1]]

    def numbers(self) -> int:
        """What a task reports: sums, numbers by entry, and counts of doubts."""
        return self.entries * self.width + self.parts * (self.entries + self.entries + 1)


def _unpacked(batch: pa.RecordBatch, layout: Layout) -> tuple[pa.RecordBatch, np.ndarray, list[Bounds]]:
    kept = batch.filter(batch.column("vector").is_valid())
    column = lambda name, kind, width: iv.unpacked(kept.column(name), kind, width).astype(np.int64)
    every = sum(layout.named)
    code, upper, outer = column("code", "u2", layout.parts), column("upper", "i8", layout.parts), column("outer", "i4", layout.parts)
    near, low = column("near", "u2", every), column("low", "i4", every)
    ends = np.cumsum([0, *layout.named])
    states = [Bounds(code[:, p].copy(), upper[:, p].copy(), near[:, ends[p] : ends[p + 1]].copy(), low[:, ends[p] : ends[p + 1]].copy(), outer[:, p].copy()) for p in range(layout.parts)]
    return kept, column("vector", "i4", layout.width), states


def _packed(ids: pa.Array, labels: pa.Array, vectors: np.ndarray, states: list[Bounds]) -> pa.RecordBatch:
    def joined(name: str, kind: str) -> pa.Array:
        columns = [x if (x := getattr(state, name)).ndim == 2 else x[:, None] for state in states]
        rows = np.concatenate(columns, axis=1)
        return iv.packed(np.clip(rows, -iv.TOP, iv.TOP) if kind == "i4" else rows, kind)

    columns = [ids, labels, iv.packed(vectors, "i4"), joined("code", "u2"), joined("upper", "i8"), joined("near", "u2"), joined("low", "i4"), joined("outer", "i4")]
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(vectors), pa.list_(pa.int64()))], [*_NAMES, "sums"])


class _Task:
    """Sums of one task over its rows."""

    def __init__(self, layout: Layout) -> None:
        self.layout = layout
        self.sums = [iv.Sums(layout.entries, layout.cuts[p + 1] - layout.cuts[p]) for p in range(layout.parts)]
        self.doubts = np.zeros((layout.parts, layout.entries + 1), dtype=np.int64)

    def add(self, vectors: np.ndarray, states: list[Bounds], doubts: list[np.ndarray]) -> None:
        for p, state in enumerate(states):
            self.sums[p].add(self.layout.part(vectors, p), state.code)
            self.doubts[p] += np.bincount(doubts[p], minlength=self.layout.entries + 1)

    def reported(self) -> pa.RecordBatch:
        numbers = np.concatenate([*[x.total.ravel() for x in self.sums], *[x.count for x in self.sums], self.doubts.ravel()])
        return pa.RecordBatch.from_arrays([*[pa.nulls(1, kind) for kind in _KINDS], pa.array([numbers.tolist()], pa.list_(pa.int64()))], [*_NAMES, "sums"])


def _first_round(layout: Layout, books: list[np.ndarray]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Task(layout)
        for batch in batches:
            vectors = iv.matrix(batch.column(2), layout.width)
            states = [evaluated(layout.part(vectors, p), books[p], layout.named[p]) for p in range(layout.parts)]
            own.add(vectors, states, [np.zeros(len(vectors), dtype=np.int64)] * layout.parts)
            yield _packed(batch.column(0), batch.column(1), vectors, states)
        yield own.reported()

    return task


def _next_round(layout: Layout, named: list[int], books: list[np.ndarray], moves: list[np.ndarray]):
    """Reads bounds of the layout, and writes those of the layout with other numbers of named entries."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Task(layout)
        for batch in batches:
            kept, vectors, states = _unpacked(batch, layout)
            doubts = [updated(layout.part(vectors, p), books[p], moves[p], states[p]) for p in range(layout.parts)]
            own.add(vectors, states, doubts)
            for state, size in zip(states, named, strict=True):
                state.narrowed(size)
            yield _packed(kept.column("vec_id"), kept.column("label"), vectors, states)
        yield own.reported()

    return task


def _last_round(layout: Layout, books: list[np.ndarray], moves: list[np.ndarray]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, vectors, states = _unpacked(batch, layout)
            error = np.zeros(len(vectors), dtype=np.int64)
            for p, state in enumerate(states):
                updated(layout.part(vectors, p), books[p], moves[p], state)
                error += iv.squares(layout.part(vectors, p), books[p][state.code])
            code = iv.packed(np.stack([state.code for state in states], axis=1), "u1")
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), code, pa.array(error)], ["vec_id", "label", "code", "error"])

    return task


def _moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return iv.root_above(((new - old) ** 2).sum(axis=1))


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, column: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (vec_id, label as text, code with one byte a part, error) and the final codebooks, one array of entries for each part position.

    `entries` is at most 256.
    """
    spark = vectors.sparkSession
    whole = vectors.where(iv.is_whole(column))
    length = whole.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    width = length["size"] if length else 0
    kept = whole.where(F.size(column) == width).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), iv.scaled(column, scale).alias("vector"))
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not rows:
        return kept.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), []
    start = np.array([row["vector"] for row in rows], dtype=np.int64)
    cuts = [i * width // parts for i in range(parts + 1)]
    layout = Layout(cuts, [min(entries // 4, len(start) - 1)] * parts, len(start))
    books = [layout.part(start, p) for p in range(parts)]
    state, path = iv.written(kept.mapInArrow(_first_round(layout, books), _STATE))
    # a narrower layout for the next round takes effect one round after the counts that it follows from
    for done in range(rounds):
        found = iv.added_up(state, "sums", layout.numbers())
        fresh, number, doubts = _split(found, layout)
        old, books = books, [iv.replaced(book, fresh[p], number[p]) for p, book in enumerate(books)]
        moves = [_moves(before, after) for before, after in zip(old, books, strict=True)]
        if done == rounds - 1:
            break
        named = layout.named if done == 0 else [adapted(doubts[p], layout.named[p], layout.entries) for p in range(parts)]
        before = path
        state, path = iv.written(state.mapInArrow(_next_round(layout, named, books, moves), _STATE))
        iv.removed(spark, before)
        layout = Layout(cuts, named, layout.entries)
    if not rounds:
        moves = [np.zeros(layout.entries, dtype=np.int64)] * parts
    final, _ = iv.written(state.mapInArrow(_last_round(layout, books, moves), _FINAL))
    iv.removed(spark, path)
    return final, books


def _split(found: np.ndarray, layout: Layout) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sums, numbers by entry, and counts of doubts of each part position."""
    sums, at = [], 0
    for low, high in zip(layout.cuts, layout.cuts[1:], strict=False):
        size = layout.entries * (high - low)
        sums.append(found[at : at + size].reshape(layout.entries, high - low))
        at += size
    rest = found[at:]
    number = layout.parts * layout.entries
    return sums, rest[:number].reshape(layout.parts, layout.entries), rest[number:].reshape(layout.parts, layout.entries + 1)


def restored(codes: DataFrame, books: list[np.ndarray], scale: int = 4096) -> DataFrame:
    """The codes with a column `vector`, the entries that they name divided by the scale."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = iv.unpacked(batch.column("code"), "u1", len(books))
            found = [(np.concatenate([book[i] for book, i in zip(books, row, strict=True)]) / scale).tolist() for row in code]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(found, pa.list_(pa.float64()))], ["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(task, "vec_id long, vector array<double>")


def report(vectors: DataFrame, **options) -> DataFrame:
    """Every kept vector with its code in hexadecimal, its error, its label's error and the digest of all codebooks."""
    codes, books = compress(vectors, **options)
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
    sums = codes.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).alias("c")
    joined = salted.join(sums.alias("s"), F.col("label").eqNullSafe(F.col("own")) & (F.col("c.salt") == F.col("s.salt")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
