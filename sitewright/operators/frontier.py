"""URL frontier as a table: next URLs, counters, retries, transitions, admission and maintenance of stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.functions import http
from sitewright.functions import misc as MI

c = F.col
# fixed values: retry rule
RETRY_STATUSES = (408, 429, 500, 502, 503, 504)
RETRY_ERRORS = ("timeout", "dns_error", "connection_reset", "network_error")
BASE_DELAY_MS, MAX_DELAY_MS, MAX_ATTEMPTS = 1000, 30000, 3


def next_urls(queue: DataFrame, count: int, key: str = "run_id") -> DataFrame:
    """First waiting URLs per key by priority, discovery time and id."""
    order = Window.partitionBy(key).orderBy(F.desc("priority"), "discovered_at", "queue_id")
    return queue.where(c("status") == "pending").withColumn("position", F.row_number().over(order)).where(c("position") <= count)


def counters(queue: DataFrame) -> DataFrame:
    """Counts per run and the earliest waiting retry."""
    status = c("status")
    return queue.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("discovered"), *[F.count_if(status == name).alias(name) for name in ("done", "failed", "skipped", "pending", "processing", "retry_wait")],
        F.count_if(status.isin("done", "failed")).alias("processed"), F.min(F.when(status == "retry_wait", c("next_attempt_at"))).alias("next_attempt_at"),
    )


def status_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("urls"))


def retries(queue: DataFrame, now: int) -> DataFrame:
    """Whether a failed URL is tried again and when: exponential delay with an upper bound."""
    retryable = F.coalesce(c("last_status_code").isin(*RETRY_STATUSES), F.lit(False)) | F.coalesce(c("last_error_type").isin(*RETRY_ERRORS), F.lit(False))
    again = retryable & (c("attempts") < MAX_ATTEMPTS)
    delay = F.least(F.lit(MAX_DELAY_MS), F.lit(BASE_DELAY_MS) * F.pow(F.lit(2), F.greatest(F.lit(0), c("attempts") - 1))).cast("bigint")
    failed = queue.where(c("status").isin("failed", "retry_wait"))
    return failed.select("run_id", "queue_id", again.alias("retry"), F.when(again, delay).alias("delay_ms"), F.when(again, F.lit(now) + F.floor(delay / 1000)).cast("bigint").alias("retry_at"))


def skip_remaining(queue: DataFrame) -> DataFrame:
    return queue.withColumn("status", F.when(c("status").isin("pending", "retry_wait"), "skipped").otherwise(c("status")))


def reset_processing(queue: DataFrame) -> DataFrame:
    return queue.withColumn("status", F.when(c("status") == "processing", "pending").otherwise(c("status")))


def attempt_history(attempts: DataFrame, keep: int = http.STORED_ATTEMPTS) -> DataFrame:
    """Stability verdict per URL over all its attempts, from counters; only the last ``keep`` outcomes are gathered, for show."""
    order = Window.partitionBy("url_key").orderBy(F.desc("attempt"))
    ranked = attempts.withColumn("position", F.row_number().over(order))
    shown = F.when(c("position") <= keep, F.struct("attempt", F.coalesce(c("final_status").cast("string"), c("error_type")).alias("outcome")))
    counted = ranked.groupBy("url_key").agg(
        F.count(F.lit(1)).alias("attempts"), F.count("final_status").alias("answers"), F.count("error_type").alias("errors"), (F.min("final_status") != F.max("final_status")).alias("mixed"),
        F.max_by("final_status", F.when(c("final_status").isNotNull(), c("attempt"))).alias("last_status"), F.array_sort(F.collect_list(shown)).alias("shown"),
    )
    verdict = http.stability_of_counts(c("answers"), c("errors"), F.coalesce(c("mixed"), F.lit(False)), c("last_status"))
    return counted.select("url_key", "attempts", F.size("shown").alias("kept"), verdict.alias("stability"), F.array_join(F.transform("shown", lambda a: a["outcome"]), ",").alias("outcomes"))


def run_health(queue: DataFrame, now: int) -> DataFrame:
    """Counts and the age of the last discovery of a run."""
    rows = counters(queue).join(queue.groupBy("run_id").agg(F.max("discovered_at").alias("last_seen")), "run_id")
    return rows.select("run_id", "discovered", "processed", "pending", "processing", (F.lit(now) - c("last_seen")).alias("age_seconds"), (c("processing") > 0).alias("active"))


def admit(discovered: DataFrame, queue: DataFrame, max_depth: int, include: tuple[str, ...], exclude: tuple[str, ...]) -> DataFrame:
    """Admission of discovered URLs: known, too deep, excluded by pattern, repeated, or admitted."""
    known = queue.select("run_id", "normalized_url").distinct().withColumn("known", F.lit(True))
    first = discovered.groupBy("run_id", "normalized_url").agg(F.min_by(F.struct("url", "depth"), F.struct("depth", "url")).alias("m"), F.count(F.lit(1)).alias("occurrences")).select("run_id", "normalized_url", "m.*", "occurrences")
    verdict = MI.url_filter(c("url"), include, exclude)
    joined = first.join(known, ["run_id", "normalized_url"], "left")
    outcome = F.when(c("known"), "duplicate").when(c("depth") > max_depth, "max_depth").when(verdict == "excluded", "excluded_pattern").when(verdict == "not_included", "not_in_include_patterns").otherwise("admitted")
    return joined.select("run_id", "normalized_url", "url", "depth", "occurrences", outcome.alias("outcome"))


# --- maintenance of stored tables --------------------------------------------------------------------------------

def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """Last write per key over stored and incoming rows."""
    rows = stored.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    fields = [name for name in rows.columns if name not in key and name != "_side"]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*fields), F.struct("_side", order)).alias("m")).select(*key, "m.*")


def replace_children(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Child rows of the incoming parents replace all stored rows of these parents."""
    return stored.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def append_absent(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows and those incoming rows whose key is new, each once."""
    return stored.unionByName(incoming.dropDuplicates(key).join(stored.select(*key), key, "left_anti"), allowMissingColumns=True)


def without_runs(stored: DataFrame, runs: DataFrame) -> DataFrame:
    return stored.join(runs.select("run_id").distinct(), "run_id", "left_anti")


def keep_collected(previous: DataFrame, fresh: DataFrame, preserved: DataFrame) -> DataFrame:
    """Earlier results of preserved checks, and fresh results of all other checks."""
    kept = previous.join(preserved.select("check_id").distinct(), "check_id", "left_semi")
    return kept.unionByName(fresh.join(kept.select("run_id", "check_id").distinct(), ["run_id", "check_id"], "left_anti"), allowMissingColumns=True)


def scope_violations(tables: dict[str, tuple[DataFrame, str]], allowed: DataFrame, url_host, first: int = 25) -> DataFrame:
    """Stored URLs whose host a run does not allow, the first few per table."""
    parts = None
    for name, (df, column) in tables.items():
        rows = df.select("run_id", F.lit(name).alias("table_name"), F.col(column).alias("url"), url_host(F.col(column)).alias("host"))
        parts = rows if parts is None else parts.unionByName(rows)
    foreign = parts.join(allowed.select("run_id", "host").distinct(), ["run_id", "host"], "left_anti").select("run_id", "table_name", "url").distinct()
    order = Window.partitionBy("run_id", "table_name").orderBy("url")
    return foreign.withColumn("position", F.row_number().over(order)).where(c("position") <= first)


def page_of(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of a listing, bounded by a top-k sort."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(rows: DataFrame, keys: list[str], after: tuple | None, size: int) -> DataFrame:
    """The rows that follow the key values of the last row shown, in the order of the keys. Every page costs as much as the first: a filter and a top-k sort.

    Keys are unique together; nulls come first, as in Spark's ascending order.
    """
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for name, value in zip(keys, after, strict=True):
            beyond = beyond | (equal & (c(name).isNotNull() if value is None else F.coalesce(c(name) > F.lit(value), F.lit(False))))
            equal = equal & c(name).eqNullSafe(F.lit(value))
        rows = rows.where(beyond)
    return rows.orderBy(*[F.asc_nulls_first(name) for name in keys]).limit(size)


def totals(rows: DataFrame, *groups: str) -> DataFrame:
    """Rows of each listing, for its pages to state."""
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("total"))


def table_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and text bytes per stored table, from one aggregate each."""
    parts = None
    for name, df in tables.items():
        texts = [column for column, kind in df.dtypes if kind == "string"]
        size = sum((F.coalesce(F.sum(F.octet_length(column)), F.lit(0)) for column in texts), F.lit(0).cast("bigint"))
        row = df.agg(F.count(F.lit(1)).alias("rows"), size.cast("bigint").alias("text_bytes")).select(F.lit(name).alias("table_name"), "rows", "text_bytes")
        parts = row if parts is None else parts.unionByName(row)
    return parts


def storage_projection(statistics: DataFrame, urls: Column, sizes: tuple[int, ...] = (10_000, 50_000, 500_000)) -> DataFrame:
    """Projected bytes for larger crawls from the bytes per URL, with a risk level."""
    total = statistics.agg(F.sum("text_bytes").alias("bytes"), F.sum("rows").alias("rows"))
    rows = total.withColumn("per_url", c("bytes") / urls).withColumn("urls", F.explode(F.array(*[F.lit(size) for size in sizes])))
    return rows.select("urls", F.round(c("per_url") * c("urls"), 0).cast("bigint").alias("projected_bytes")).withColumn("risk", MI.size_risk(c("projected_bytes")))
