"""Attempts as a stream give the rows of the batch form, over restarts, and state expires."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from sitewright.operators import frontier as FR
from sitewright.streaming import attempts as AT

SCHEMA = "url_key string, attempt long, final_status int, error_type string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(name)
    spark.conf.set(name, AT.PROVIDER)
    yield spark
    spark.conf.set(name, kept)


def drawn():
    draw = random.Random(4)
    outcomes = [(200, None), (200, None), (503, None), (None, "timeout"), (404, None)]
    rows = []
    for url in range(12):
        mine = [draw.choice(outcomes[: 1 + url % 5]) for _ in range(1 + draw.randrange(14))]
        rows += [(f"u{url}", n, *outcome) for n, outcome in enumerate(mine)]
    rows += [("late", 0, 500, None), *[("late", n, 200, None) for n in range(1, 9)], ("none", 0, None, None), ("once", 0, 503, None), ("twice", 0, 503, None), ("twice", 1, 503, None)]
    draw.shuffle(rows)
    return rows


def written(query, table):
    """The last row of each key that an update stream gave."""
    rows = {}
    for row in table.collect():
        if row.url_key not in rows or row.attempts > rows[row.url_key].attempts:
            rows[row.url_key] = row
    return {key: tuple(row) for key, row in rows.items()}


def test_stream_equals_batch_over_a_restart(rocks, tmp_path):
    rows = drawn()
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "cp"))
    third = len(rows) // 3
    for part in (rows[:third], rows[third : 2 * third], rows[2 * third :]):
        # every part is a run of its own that goes on from the checkpoint
        rocks.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = AT.attempt_history(rocks.readStream.schema(SCHEMA).parquet(source))
        query = stream.writeStream.foreachBatch(lambda batch, epoch: batch.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    want = {row.url_key: tuple(row) for row in FR.attempt_history(rocks.createDataFrame(rows, SCHEMA)).collect()}
    assert written(query, rocks.read.parquet(out)) == want
    assert want["late"][3] == "transient" and want["late"][4] == "200,200,200,200,200"
    assert [want[key][3] for key in ("none", "once", "twice")] == ["insufficient_evidence", "insufficient_evidence", "confirmed"]


def test_state_expires(rocks, tmp_path):
    """Processing-time state keeps a query going, so it is stopped once its row is there."""
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "cp"))
    for run in range(2):
        rocks.createDataFrame([("u", 0, 200, None)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = AT.attempt_history(rocks.readStream.schema(SCHEMA).parquet(source), live_ms=1)
        query = stream.writeStream.foreachBatch(lambda batch, epoch: batch.where("attempts > 0").write.mode("append").json(out)).outputMode("update").option("checkpointLocation", checkpoint).start()
        try:
            deadline = time.time() + 120
            while time.time() < deadline and len(rows := _json(tmp_path / "out")) <= run:
                time.sleep(0.5)
        finally:
            query.stop()
    assert [row["attempts"] for row in rows] == [1, 1]


def _json(folder):
    return [json.loads(line) for path in sorted(folder.glob("*.json")) for line in path.read_text().splitlines()]


def test_verdict_reads_more_attempts_than_it_shows(spark):
    rows = [("u", 0, 500, None), *[("u", n, 200, None) for n in range(1, 20)]]
    row = FR.attempt_history(spark.createDataFrame(rows, SCHEMA)).first()
    assert (row.attempts, row.kept, row.stability, row.outcomes) == (20, 5, "transient", "200,200,200,200,200")
    assert FR.attempt_history(spark.createDataFrame(rows[1:], SCHEMA)).first().stability == "confirmed"
    assert FR.attempt_history(spark.createDataFrame([], SCHEMA).where(F.lit(True))).count() == 0
