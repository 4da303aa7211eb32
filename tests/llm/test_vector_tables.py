"""Vector codes and centroid clusters against plain rounds in Python, with bounds that must not change any result."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.llm import centroid_clusters, integer_vectors, vector_codes


def plain_rounds(vectors, start, rounds):
    """Codes, squared distances and entries after so many replacements; Python integers throughout."""
    entries = [list(row) for row in start]
    for done in range(rounds + 1):
        square = [[sum((x - y) ** 2 for x, y in zip(v, e, strict=True)) for e in entries] for v in vectors]
        code = [min(range(len(entries)), key=lambda i, own=own: (own[i], i)) for own in square]
        if done == rounds:
            return code, [own[i] for own, i in zip(square, code, strict=True)], entries
        for i in range(len(entries)):
            if members := [v for v, c in zip(vectors, code, strict=True) if c == i]:
                entries[i] = [sum(column) // len(members) for column in zip(*members, strict=True)]


def digest(rows):
    return hashlib.sha256(",".join(str(x) for row in rows for x in row).encode()).hexdigest()


def plain_codes(rows, parts, entries, rounds, scale):
    rows = sorted(rows, key=lambda row: (row[0] is None, row[0] or 0, row[1]))
    whole = [[int(np.floor(scale * x)) for x in v] for _, v, _ in rows]
    cuts = [i * len(whole[0]) // parts for i in range(parts + 1)]
    found = [plain_rounds([v[a:b] for v in whole], [v[a:b] for v in whole[:entries]], rounds) for a, b in zip(cuts, cuts[1:], strict=False)]
    codes = ["".join(f"{code[i]:02x}" for code, _, _ in found) for i in range(len(rows))]
    errors = [sum(square[i] for _, square, _ in found) for i in range(len(rows))]
    totals = Counter()
    for (_, _, label), error in zip(rows, errors, strict=True):
        totals[label] += error
    books = digest([row for _, _, book in found for row in book])
    return sorted([(row[0], code, error, totals[row[2]], books) for row, code, error in zip(rows, codes, errors, strict=True)], key=str)


def plain_clusters(rows, clusters, rounds, scale, seed):
    rows = sorted(rows, key=lambda row: (row[0] is None, hashlib.sha256(f"{seed}:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1]))
    whole = [[int(np.floor(scale * x)) for x in v] for _, v in rows]
    code, square, centres = plain_rounds(whole, whole[:clusters], rounds)
    inertia = Counter()
    for c, d in zip(code, square, strict=True):
        inertia[c] += d
    return sorted([(row[0], c, d, inertia[c], sum(square), digest([centres[c]])) for row, c, d in zip(rows, code, square, strict=True)], key=str)


def drawn(count, width, seed, ties=True):
    draw = np.random.default_rng(seed)
    vectors = draw.normal(size=(count, width)) * draw.choice([0.2, 1.0], size=(count, 1))
    if ties:
        # a coarse grid: many equal vectors and equal distances
        vectors = np.round(vectors)
    return vectors.astype(np.float32).tolist()


BAD = [(9001, None, 1), (9002, [], 1), (9003, [1.0] * 7 + [None], 1), (9004, [float("nan")] * 8, 1), (9005, [float("-inf")] * 8, None), (9006, [1.0] * 5, 2)]


def frame(spark, rows, parts=3):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts)
    return table.withColumns({name: F.lit("x") for name in ("code", "vector", "sums", "salt", "own", "cluster", "upper", "n", "error", "size")})


@pytest.mark.parametrize("ties", [True, False])
def test_codes(spark, ties):
    rows = [(i if i % 40 else None, v, [None, 1, 1, 1, 2][i % 5]) for i, v in enumerate(drawn(260, 8, 1, ties))]
    rows += [rows[5], rows[5], rows[0]]
    got = vector_codes.report(frame(spark, rows + BAD), parts=4, entries=6, rounds=5, scale=16).collect()
    assert sorted(map(tuple, got), key=str) == plain_codes(rows, 4, 6, 5, 16)


def test_codes_of_uneven_parts_few_vectors_and_no_rounds(spark):
    rows = [(i, v, None) for i, v in enumerate(drawn(9, 7, 2, False))]
    for options in ({"parts": 3, "entries": 16, "rounds": 4, "scale": 64}, {"parts": 2, "entries": 1, "rounds": 3, "scale": 64}, {"parts": 3, "entries": 4, "rounds": 0, "scale": 64}):
        got = vector_codes.report(frame(spark, rows), **options).collect()
        assert sorted(map(tuple, got), key=str) == plain_codes(rows, *options.values())
    assert vector_codes.report(frame(spark, rows).limit(0)).count() == 0
    assert vector_codes.report(frame(spark, BAD[:4])).count() == 0


def test_codes_are_restored(spark):
    rows = [(i, v, 1) for i, v in enumerate(drawn(300, 8, 3, False))]
    codes, books = vector_codes.compress(frame(spark, rows), parts=8, entries=32, rounds=5)
    near = {row.vec_id: np.array(row.vector) for row in vector_codes.restored(codes, books).collect()}
    errors = {row.vec_id: row.error for row in codes.collect()}
    for i, v, _ in rows:
        away = np.floor(4096 * np.array(v)) - 4096 * near[i]
        assert round(float((away**2).sum())) == errors[i]


def test_narrower_bounds_stay_below_the_distances():
    """Whatever entries move, no lower bound may exceed its distance and codes are those of all distances."""
    draw = np.random.default_rng(5)
    part, entries = draw.integers(-60, 60, size=(400, 4)), draw.integers(-60, 60, size=(12, 4))
    state, skipped = vector_codes.evaluated(part, entries, 4), 0
    for named in (4, 3, 3, 2, 1, 1):
        moved = entries + draw.integers(-2, 3, size=entries.shape)
        doubts = vector_codes.updated(part, moved, vector_codes._moves(entries, moved), state)
        entries, skipped = moved, skipped + int((doubts == 0).sum())
        state.narrowed(named)
        root = np.sqrt(((part[:, None, :] - entries) ** 2).sum(axis=2))
        assert (state.code == ((part[:, None, :] - entries) ** 2).sum(axis=2).argmin(axis=1)).all()
        assert (state.upper >= root[np.arange(400), state.code]).all()
        assert (state.low <= np.take_along_axis(root, state.near, axis=1)).all()
        others = np.ones(root.shape, dtype=bool)
        others[np.arange(400), state.code] = False
        np.put_along_axis(others, state.near, False, axis=1)
        assert (state.outer[:, None] <= np.where(others, root, np.inf)).all()
        assert (np.diff(np.concatenate([state.low, state.outer[:, None]], axis=1), axis=1) >= 0).all()
    assert skipped > 400


def test_number_of_named_entries_follows_the_doubts():
    counts = np.zeros(17, dtype=np.int64)
    counts[:2] = 900, 100
    assert vector_codes.adapted(counts, 4, 16) == 3 and vector_codes.adapted(counts, 2, 16) == 1
    counts[4] = 500
    assert vector_codes.adapted(counts, 4, 16) == 4


@pytest.mark.parametrize("refresh", [0.0, 0.2, 2.0])
@pytest.mark.parametrize("ties", [True, False])
def test_clusters(spark, monkeypatch, refresh, ties):
    monkeypatch.setattr(centroid_clusters, "REFRESH", refresh)
    rows = [(i if i % 40 else None, v) for i, v in enumerate(drawn(240, 8, 4, ties))]
    rows += [rows[5], rows[5], rows[0]]
    table = frame(spark, [(*row, 1) for row in rows] + BAD)
    got = centroid_clusters.report(table, clusters=6, rounds=7, width=8, scale=16, seed=3).collect()
    assert sorted(map(tuple, got), key=str) == plain_clusters(rows, 6, 7, 16, 3)


def test_clusters_of_few_vectors_and_none(spark):
    rows = [(i, v) for i, v in enumerate(drawn(3, 8, 6))]
    for rounds in (0, 1, 4):
        got = centroid_clusters.report(frame(spark, [(*row, 1) for row in rows]), clusters=8, rounds=rounds, width=8, scale=16).collect()
        assert sorted(map(tuple, got), key=str) == plain_clusters(rows, 8, rounds, 16, 3)
    assert centroid_clusters.report(frame(spark, BAD)).count() == 0
    assert centroid_clusters.report(frame(spark, BAD).limit(0)).count() == 0


def test_displacement_is_not_the_sum_of_moves():
    """Centroids that come back loosen nothing."""
    history = np.array([[[0, 0], [100, 0]], [[30, 0], [100, 40]], [[0, 0], [100, 0]]])
    assert centroid_clusters._Rounds(history).drift.tolist() == [[0, 0], [30, 40], [0, 0]]


def test_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="must stay below"):
        centroid_clusters.report(frame(spark, [(1, [1e30] * 8, 1)]), width=8).collect()


def test_exact_distances_on_both_paths():
    draw = np.random.default_rng(9)
    for top in (1000, integer_vectors.LIMIT - 1):
        vectors, entries = draw.integers(-top, top, size=(50, 16)), draw.integers(-top, top, size=(5, 16))
        want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(v, e, strict=True)) for e in entries] for v in vectors]
        found = integer_vectors.distances(vectors, entries)
        assert found.tolist() == want
        roots = np.sqrt(np.array(want, dtype=np.longdouble))
        assert (integer_vectors.root_below(found) <= roots).all() and (integer_vectors.root_above(found) >= roots).all()
