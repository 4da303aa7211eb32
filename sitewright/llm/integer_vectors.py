"""Integer vectors in tasks: exact squared distances, whole bounds of their roots, and tables that replace each other.

Bounds are whole numbers: a lower bound is rounded down and an upper bound up, so no rounding of floats can hide an entry that is as
near. Components must stay below LIMIT after scaling, so that sums of squares fit into 64 bits; a larger one is an error.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm.tables import new_folder

LIMIT = 1 << 26
#: Larger than any bound, and the largest lower bound that is stored.
FAR, TOP = np.int64(1) << 40, np.int64(2**31 - 1)


def is_whole(column: str) -> Column:
    """Neither the vector nor a component is null, and all components are finite; a vector without components is not whole."""
    finite = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & finite, F.lit(False))


def scaled(column: str, scale: int) -> Column:
    """floor(scale * x) of every component."""
    def whole(x: Column) -> Column:
        value = x.cast("double") * scale
        too_large = F.raise_error(F.lit(f"a component times {scale} must stay below {LIMIT}")).cast("long")
        return F.when(F.abs(value) < LIMIT, F.floor(value)).otherwise(too_large)

    return F.transform(F.col(column), whole)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a column of equally long integer lists."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def unpacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows of a binary column that holds `width` numbers a row."""
    if not width:
        return np.zeros((len(column), 0), dtype=kind)
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, dtype=np.int32)[column.offset]
    return np.frombuffer(data, dtype=kind, count=len(column) * width, offset=int(first)).reshape(len(column), width)


def packed(rows: np.ndarray, kind: str) -> pa.Array:
    """The numbers of each row as one binary value."""
    data = np.ascontiguousarray(rows, dtype=kind)
    size = data.shape[1] * data.itemsize
    offsets = np.arange(len(data) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def distances(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all entries. Products run in doubles where every sum stays below 2**53."""
    top = max(int(np.abs(vectors).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if vectors.shape[1] * (2 * top) ** 2 < 1 << 53:
        v, e = vectors.astype(np.float64), entries.astype(np.float64)
        return ((v * v).sum(axis=1)[:, None] - 2 * (v @ e.T) + (e * e).sum(axis=1)).astype(np.int64)
    return np.stack([squares(vectors, entry) for entry in entries], axis=1)


def squares(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector to its own entry, or of all to one."""
    apart = vectors - entries
    return (apart * apart).sum(axis=-1)


def root_below(square: np.ndarray) -> np.ndarray:
    """A whole number that is at most the root."""
    root = np.floor(np.sqrt(square.astype(np.float64))).astype(np.int64)
    return root - (square >= 1 << 50)


def root_above(square: np.ndarray) -> np.ndarray:
    """A whole number that is at least the root."""
    root = np.ceil(np.sqrt(square.astype(np.float64))).astype(np.int64)
    return root + (square >= 1 << 50)


class Sums:
    """Sums and numbers of the vectors under each entry, kept by one task."""

    def __init__(self, entries: int, width: int) -> None:
        self.total, self.count = np.zeros((entries, width), dtype=np.int64), np.zeros(entries, dtype=np.int64)

    def add(self, vectors: np.ndarray, code: np.ndarray) -> None:
        order = np.argsort(code, kind="stable")
        present, first = np.unique(code[order], return_index=True)
        if len(present):
            self.total[present] += np.add.reduceat(vectors[order], first, axis=0)
            self.count += np.bincount(code, minlength=len(self.count))


def replaced(entries: np.ndarray, total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean; entries without vectors stay."""
    return np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], entries)


def added_up(frame: DataFrame, column: str, size: int) -> np.ndarray:
    """Sums by place over the arrays that each task reports; null arrays do not count."""
    found = np.zeros(size, dtype=np.int64)
    rows = frame.where(F.col(column).isNotNull()).select(F.posexplode(column).alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    for row in rows.collect():
        found[row["at"]] = row["n"]
    return found


def written(frame: DataFrame) -> tuple[DataFrame, str]:
    """The frame stored in the shared folder and read back, and its path."""
    path = f"{new_folder(frame.sparkSession)}-{uuid.uuid4().hex[:8]}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that a later one has replaced."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
