"""Percentiles against numpy, with ties, hot groups, nulls and null keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.operators.percentiles import percentiles

c = F.col
SHARES = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p75": 0.75, "p99": 0.99, "p100": 1.0}


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(1)
    found = [("hot", float(x)) for x in draw.normal(size=4000)] + [("ties", float(x)) for x in draw.integers(0, 3, size=500)] + [(None, float(x)) for x in draw.integers(-5, 5, size=20)]
    return found + [("one", 7.0), ("two", 1.0), ("two", 4.0), ("null", None), ("some", None), ("some", 3.0)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_percentiles(spark, rows, partitions):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        frame = spark.createDataFrame(rows, "k string, x double").repartition(3)
        got = {r.k: [r[name] for name in SHARES] for r in percentiles(frame, ["k"], {name: (c("x"), share) for name, share in SHARES.items()}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    groups = {}
    for key, x in rows:
        if x is not None:
            groups.setdefault(key, []).append(x)
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert np.allclose(got[key], np.quantile(values, list(SHARES.values()))), key


def test_several_measures(spark):
    frame = spark.createDataFrame([("a", n, n * 10 if n % 2 else None) for n in range(101)] + [("b", 1, None)], "k string, x int, y int")
    got = {r.k: tuple(r)[1:] for r in percentiles(frame, ["k"], {"x50": (c("x"), 0.5), "y50": (c("y"), 0.5), "y90": (c("y"), 0.9)}).collect()}
    odd = [n * 10 for n in range(1, 101, 2)]
    assert got["a"] == (50.0, float(np.quantile(odd, 0.5)), pytest.approx(float(np.quantile(odd, 0.9))))
    assert got["b"] == (1.0, None, None)
    assert percentiles(frame.limit(0), ["k"], {"x50": (c("x"), 0.5)}).count() == 0
