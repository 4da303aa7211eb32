"""Attempts at URLs as a stream: counters and the last outcomes of each URL in keyed state, with the verdict of the batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sitewright.functions import http

c = F.col
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "attempts long, answers long, errors long, lowest int, highest int, last_status int, last_attempt long, shown array<struct<attempt:long,outcome:string>>"
_OUTPUT = "url_key string, attempts long, answers long, errors long, lowest int, highest int, last_status int, shown array<string>"


class Attempts(StatefulProcessor):
    """Counters of one URL. Attempts may come in any order and over any number of micro-batches; state that has seen none for the time to live expires."""

    def __init__(self, keep: int, live_ms: int | None) -> None:
        self.keep, self.live_ms = keep, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("attempts", _STATE, ttlDurationMs=self.live_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (0, 0, 0, None, None, None, None, [])
        attempts, answers, errors, lowest, highest, last_status, last_attempt, shown = held
        shown = [(row[0], row[1]) for row in shown]
        for frame in rows:
            for attempt, status, error in zip(frame["attempt"], frame["final_status"], frame["error_type"], strict=True):
                attempt, status = int(attempt), None if pd.isna(status) else int(status)
                attempts += 1
                errors += not pd.isna(error)
                if status is not None:
                    answers += 1
                    lowest, highest = (status, status) if lowest is None else (min(lowest, status), max(highest, status))
                    if last_attempt is None or attempt > last_attempt:
                        last_status, last_attempt = status, attempt
                shown.append((attempt, str(status) if status is not None else None if pd.isna(error) else error))
            shown = sorted(shown)[-self.keep :]
        self.state.update((attempts, answers, errors, lowest, highest, last_status, last_attempt, shown))
        yield pd.DataFrame({
            "url_key": [key[0]], "attempts": [attempts], "answers": [answers], "errors": [errors], "lowest": pd.array([lowest], dtype="Int32"), "highest": pd.array([highest], dtype="Int32"),
            "last_status": pd.array([last_status], dtype="Int32"), "shown": [[outcome for _, outcome in shown]],
        })

    def close(self) -> None:
        pass


def attempt_history(attempts: DataFrame, keep: int = http.STORED_ATTEMPTS, live_ms: int | None = None) -> DataFrame:
    """A row for each URL with new attempts, in update mode: the columns of ``frontier.attempt_history``. The session needs the RocksDB state store (PROVIDER)."""
    rows = attempts.select("url_key", c("attempt").cast("long").alias("attempt"), c("final_status").cast("int").alias("final_status"), "error_type")
    seen = rows.groupBy("url_key").transformWithStateInPandas(Attempts(keep, live_ms), _OUTPUT, "Update", "None" if live_ms is None else "ProcessingTime")
    mixed = F.coalesce(c("lowest") != c("highest"), F.lit(False))
    verdict = http.stability_of_counts(c("answers"), c("errors"), mixed, c("last_status"))
    return seen.select("url_key", "attempts", F.size("shown").alias("kept"), verdict.alias("stability"), F.array_join("shown", ",").alias("outcomes"))
