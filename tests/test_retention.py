"""Evidence within a policy, and tables that lose runs without touching other partitions."""

import json

from pyspark.sql import functions as F

from sitewright.sources import retention as RT

c = F.col


def prune(spark, value, **limits):
    text = value if isinstance(value, str) else json.dumps(value)
    row = spark.createDataFrame([(text,)], "e string").select(RT.pruned_evidence(c("e"), RT.Policy(**limits)).alias("p")).first().p
    return json.loads(row.value), row.truncated


def test_evidence(spark):
    assert prune(spark, {"a": "x" * 10, "b": [1, 2, {"c": None}], "d": 1.5, "e": True}) == ({"a": "x" * 10, "b": [1, 2, {"c": None}], "d": 1.5, "e": True}, False)
    value, cut = prune(spark, {"a": "x" * 50, "myErrors": {"at": ["y" * 50]}}, text=45, error_text=40)
    assert cut and value == {"a": "x" * 13 + "... [truncated 37 chars]", "myErrors": {"at": ["y" * 8 + "... [truncated 42 chars]"]}}
    assert prune(spark, {"a": list(range(30))}, items=3) == ({"a": [0, 1, 2]}, True)
    assert prune(spark, {str(n): n for n in range(9)}, keys=2) == ({"0": 0, "1": 1}, True)
    for odd in ("", "[1]", "nonsense", "3", "[" * 20_000):
        assert prune(spark, odd) == ({}, False)
    value, cut = prune(spark, {str(n): "ü" * 100 for n in range(50)}, json_bytes=1000)
    assert cut and value["reason"] == "evidence_json_byte_limit" and value["original_bytes"] > 10_000
    assert spark.createDataFrame([(None,)], "e string").select(RT.pruned_evidence(c("e"))["value"].alias("v")).first().v == "{}"


def test_capped_rows(spark):
    rows = spark.createDataFrame([("a", n) for n in range(7)] + [("b", 1)], "k string, n int")
    got = sorted((r.k, r.n, r.total_rows, r.truncated) for r in RT.capped(rows, ["k"], ["n"], 3).collect())
    assert got == [("a", 0, 7, True), ("a", 1, 7, True), ("a", 2, 7, True), ("b", 1, 1, False)]


def test_expired_runs(spark):
    day = 86_400
    runs = spark.createDataFrame(
        [("r1", 1, 0, 0), ("r2", 1, 10 * day, 0), ("r3", 1, 99 * day, 0), ("r4", 2, 0, 0), ("r5", 1, 1, 1), ("r6", 1, None, 0)], "run_id string, schedule_id int, finished_at long, pinned int")
    assert {r.run_id for r in RT.expired_runs(runs, 1, 30, F.lit(100 * day)).collect()} == {"r1", "r2"}
    assert {r.run_id for r in RT.expired_runs(runs, 2, 30, F.lit(100 * day)).collect()} == {"r1"}
    assert RT.expired_runs(runs, 1, 1000, F.lit(100 * day)).count() == 0


def files(folder):
    return {str(path.relative_to(folder)): path.stat().st_mtime_ns for path in folder.rglob("*.parquet")}


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    folder = tmp_path / "rows"
    sites = ["a", "b", "c/d e", "f", None]
    rows = [(f"r{n % 6}", site, n) for n in range(60) for site in sites if not (site == "b" and n % 6 == 1) and (site != "c/d e" or n % 6 == 1)]
    frame = spark.createDataFrame(rows, "run_id string, site string, n int")
    frame.write.partitionBy("site").parquet(str(folder))
    before = files(folder)
    gone = spark.createDataFrame([("r1",), ("r1",), ("unknown",)], "run_id string")
    touched = {r.site: r.removed for r in RT.prune_table(spark, str(folder), "site", gone).collect()}
    assert touched == {"a": 10, "c/d e": 10, "f": 10, None: 10}
    after = files(folder)
    assert {name: at for name, at in after.items() if name.startswith("site=b/")} == {name: at for name, at in before.items() if name.startswith("site=b/")}
    assert not any(name in before for name in after if not name.startswith("site=b/"))
    left = sorted(((r.run_id, r.site, r.n) for r in spark.read.parquet(str(folder)).collect()), key=str)
    assert left == sorted((row for row in rows if row[0] != "r1"), key=str)
    assert RT.prune_table(spark, str(folder), "site", gone).count() == 0 and files(folder) == after
