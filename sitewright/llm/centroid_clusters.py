"""Centroid clustering by Lloyd's rounds with norm-of-sum bounds.

Every vector carries, in a stored table, its cluster, an upper bound of the distance to that cluster's centroid and a lower bound of the distance to every other
centroid, each with the round in which it was last evaluated. All centroids of all rounds are kept (rounds x clusters vectors,
which every task gets). A stored bound is loosened by the length of the way from the centroid's place at that round to its present place: the
norm of the total displacement, not the sum of the lengths of the single moves, which is never shorter. A vector whose lower bounds all stay
above its upper bound keeps its cluster unseen. For the others the distance to the own centroid is computed, and then to those centroids that it does
not rule out; all in integers, ties to the smaller number.

Because a bound names its round, a table of bounds serves several rounds: a round only reads it, and writes it anew when more than REFRESH of the
vectors had to be looked at. Each task sums its vectors by cluster; Spark adds up these sums, and clusters x width numbers reach the
driver. A table that was replaced is deleted; the new one does not depend on it.

* Kept are vectors with exactly `width` components, none null or not finite. Rows that repeat a vec_id count as often as they occur.
* Rows without a vec_id take part; as start centroids they come last. Equal hashes are ordered by their vectors.
* With fewer vectors than clusters every vector starts a centroid. Without any vector the result is empty. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm import integer_vectors as iv

#: Share of looked-at vectors from which on the bounds are stored anew.
REFRESH = 0.2
_STATE = "vec_id long, vector binary, cluster int, upper long, seen int, low binary, at binary, sums array<long>"
_FINAL = "vec_id long, cluster int, distance long, sums array<long>"


class _Rounds:
    """Centroids of all rounds so far, the last ones being in force."""

    def __init__(self, history: np.ndarray) -> None:
        self.history, self.now = history, len(history) - 1
        self.centroids = history[-1]
        apart = history - self.centroids
        self.drift = iv.root_above((apart * apart).sum(axis=2))

    def first(self, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
        square = iv.distances(vectors, self.centroids)
        cluster = square.argmin(axis=1)
        rows = np.arange(len(vectors))
        return cluster, iv.root_above(square[rows, cluster]), np.zeros(len(rows), dtype=np.int64), iv.root_below(square), np.zeros(square.shape, dtype=np.int64)

    def again(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, seen: np.ndarray, low: np.ndarray, at: np.ndarray) -> int:
        """Brings the state of a batch up to the present centroids, in place, and tells how many vectors were looked at."""
        rows, every = np.arange(len(vectors)), np.arange(len(self.centroids))
        loose = low - self.drift[at, every]
        loose[rows, cluster] = iv.FAR
        doubtful = np.flatnonzero((loose <= (upper + self.drift[seen, cluster])[:, None]).any(axis=1))
        if not len(doubtful):
            return 0
        own = iv.squares(vectors[doubtful], self.centroids[cluster[doubtful]])
        upper[doubtful], seen[doubtful] = iv.root_above(own), self.now
        low[doubtful, cluster[doubtful]], at[doubtful, cluster[doubtful]] = iv.root_below(own), self.now
        rivals = loose[doubtful] <= upper[doubtful][:, None]
        square = np.full(rivals.shape, np.iinfo(np.int64).max)
        square[np.arange(len(doubtful)), cluster[doubtful]] = own
        for entry in np.flatnonzero(rivals.any(axis=0)):
            picked = np.flatnonzero(rivals[:, entry])
            found = iv.squares(vectors[doubtful[picked]], self.centroids[entry])
            square[picked, entry] = found
            low[doubtful[picked], entry], at[doubtful[picked], entry] = iv.root_below(found), self.now
        nearest = square.argmin(axis=1)
        cluster[doubtful] = nearest
        upper[doubtful] = iv.root_above(square[np.arange(len(doubtful)), nearest])
        return len(doubtful)


def _state(batch: pa.RecordBatch, clusters: int, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    kept = batch.filter(batch.column("vector").is_valid())
    vectors = iv.unpacked(kept.column("vector"), "i4", width).astype(np.int64)
    plain = [kept.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("cluster", "upper", "seen")]
    return kept.column("vec_id"), [vectors, *plain, iv.unpacked(kept.column("low"), "i4", clusters).astype(np.int64), iv.unpacked(kept.column("at"), "u2", clusters).astype(np.int64)]


def _rows(ids, vectors, cluster, upper, seen, low, at) -> pa.RecordBatch:
    none = pa.nulls(len(vectors), pa.list_(pa.int64()))
    columns = [ids, iv.packed(vectors, "i4"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(seen.astype(np.int32)), iv.packed(np.minimum(low, iv.TOP), "i4"), iv.packed(at, "u2"), none]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "cluster", "upper", "seen", "low", "at", "sums"])


def _reported(names: list[str], kinds: list[pa.DataType], numbers: np.ndarray) -> pa.RecordBatch:
    """The one row in which a task reports its sums."""
    columns = [pa.nulls(1, kind) for kind in kinds]
    return pa.RecordBatch.from_arrays([*columns, pa.array([numbers.tolist()], pa.list_(pa.int64()))], [*names, "sums"])


def _task_sums(sums: iv.Sums, looked_at: int) -> np.ndarray:
    return np.concatenate([sums.total.ravel(), sums.count, [looked_at]])


_STATE_NAMES = ["vec_id", "vector", "cluster", "upper", "seen", "low", "at"]
_STATE_KINDS = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]


def _first_round(history: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, (_, clusters, width) = _Rounds(history), history.shape
        sums = iv.Sums(clusters, width)
        for batch in batches:
            vectors = iv.matrix(batch.column(1), width)
            state = rounds.first(vectors)
            sums.add(vectors, state[0])
            yield _rows(batch.column(0), vectors, *state)
        yield _reported(_STATE_NAMES, _STATE_KINDS, _task_sums(sums, int(sums.count.sum())))

    return task


def _next_round(history: np.ndarray, keep: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, (_, clusters, width) = _Rounds(history), history.shape
        sums, looked_at = iv.Sums(clusters, width), 0
        for batch in batches:
            ids, (vectors, *state) = _state(batch, clusters, width)
            looked_at += rounds.again(vectors, *state)
            sums.add(vectors, state[0])
            if keep:
                yield _rows(ids, vectors, *state)
        yield _reported(_STATE_NAMES if keep else [], _STATE_KINDS if keep else [], _task_sums(sums, looked_at))

    return task


def _last_round(history: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds, (_, clusters, width) = _Rounds(history), history.shape
        inertia = np.zeros(clusters, dtype=np.int64)
        for batch in batches:
            ids, (vectors, *state) = _state(batch, clusters, width)
            rounds.again(vectors, *state)
            square = iv.squares(vectors, rounds.centroids[state[0]])
            np.add.at(inertia, state[0], square)
            none = pa.nulls(len(vectors), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(state[0].astype(np.int32)), pa.array(square), none], ["vec_id", "cluster", "distance", "sums"])
        yield _reported(["vec_id", "cluster", "distance"], [pa.int64(), pa.int32(), pa.int64()], inertia)

    return task


def start_centroids(kept: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """Vectors of the smallest SHA-256 of `seed:vec_id`."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(order.asc_nulls_last(), "vector").limit(clusters).select("vector").collect()
    return np.array([row["vector"] for row in rows], dtype=np.int64)


def cluster_vectors(vectors: DataFrame, clusters: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3, column: str = "embedding") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows (vec_id, cluster, distance), the final centroids, and the sum of squared distances of each cluster."""
    spark = vectors.sparkSession
    kept = vectors.where(iv.is_whole(column) & (F.size(column) == width)).select(F.col("vec_id").cast("long").alias("vec_id"), iv.scaled(column, scale).alias("vector"))
    start = start_centroids(kept, clusters, seed)
    if not len(start):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), start, np.zeros(0, dtype=np.int64)
    count, size = len(start), len(start) * (width + 1) + 1
    history = start[None]
    state, path = iv.written(kept.mapInArrow(_first_round(history), _STATE))
    found = iv.added_up(state, "sums", size)
    refresh = True
    for _ in range(rounds):
        number = found[count * width : -1]
        history = np.concatenate([history, iv.replaced(history[-1], found[: count * width].reshape(count, width), number)[None]])
        if len(history) > rounds:
            break
        if refresh:
            state, old = (written := iv.written(state.mapInArrow(_next_round(history, True), _STATE)))[0], path
            path = written[1]
            iv.removed(spark, old)
            found = iv.added_up(state, "sums", size)
        else:
            found = iv.added_up(state.mapInArrow(_next_round(history, False), "sums array<long>"), "sums", size)
        refresh = found[-1] > REFRESH * number.sum()
    final, _ = iv.written(state.mapInArrow(_last_round(history), _FINAL))
    iv.removed(spark, path)
    return final.where("sums IS NULL").drop("sums"), history[-1], iv.added_up(final, "sums", count)


def digest(numbers: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, numbers.ravel().tolist())).encode()).hexdigest()


def report(vectors: DataFrame, **options) -> DataFrame:
    """Every kept vector with its cluster, its distance, the inertia of its cluster and of all, and the digest of its centroid."""
    rows, centroids, inertia = cluster_vectors(vectors, **options)
    facts = [(i, int(inertia[i]), int(inertia.sum()), digest(centroid)) for i, centroid in enumerate(centroids)]
    named = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(named, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
