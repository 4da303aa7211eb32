"""Retention: evidence cut to a policy before it is stored, and stored rows removed by rule with only the touched partitions rewritten.

A partitioned table loses the rows of runs that a rule gives up. Only partitions that hold such rows are read and replaced; all others keep their files. Kept rows are
written into the shared folder first, so a job that is lost half way leaves the table or the copy whole, and a repeated run finds nothing to do.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewright.session import stored

c = F.col


@dataclass(frozen=True)
class Policy:
    """Limits of stored evidence. Fixed values."""

    items: int = 20
    keys: int = 80
    text: int = 4000
    error_text: int = 2000
    json_bytes: int = 120_000


ERROR_WORDS = ("error", "stack", "trace", "exception")
_TAIL = 32


def _shortened(text: str, limit: int) -> str:
    return text if len(text) <= limit else f"{text[: max(0, limit - _TAIL)]}... [truncated {len(text) - limit + _TAIL} chars]"


def _pruned(value, policy: Policy, error: bool):
    """A value within the limits, and whether anything was cut. Text below a key that names an error has its own limit."""
    if isinstance(value, str):
        text = _shortened(value, policy.error_text if error else policy.text)
        return text, text is not value
    if isinstance(value, list):
        found = [_pruned(item, policy, error) for item in value[: policy.items]]
        return [item for item, _ in found], len(value) > policy.items or any(cut for _, cut in found)
    if isinstance(value, dict):
        found = {key: _pruned(item, policy, error or any(word in key.lower() for word in ERROR_WORDS)) for key, item in list(value.items())[: policy.keys]}
        return {key: item for key, (item, _) in found.items()}, len(value) > policy.keys or any(cut for _, cut in found.values())
    return value, False


def pruned_evidence(evidence: Column, policy: Policy = Policy()) -> Column:
    """Struct of the JSON text within the policy and whether it was cut. What is no JSON object becomes an empty one; evidence above the byte limit is replaced by a note of its size."""

    @F.pandas_udf("value string, truncated boolean")
    def prune(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                value = json.loads(text) if text else {}
            except (ValueError, RecursionError):
                value = {}
            value, cut = _pruned(value, policy, False) if isinstance(value, dict) else ({}, False)
            rows.append((json.dumps(value, ensure_ascii=False, separators=(",", ":")), cut))
        return pd.DataFrame(rows, columns=["value", "truncated"])

    found = prune(evidence)
    size = F.octet_length(found["value"])
    note = F.to_json(F.struct(F.lit(True).alias("storage_truncated"), F.lit("evidence_json_byte_limit").alias("reason"), F.lit(policy.json_bytes).alias("max_bytes"), size.alias("original_bytes")))
    large = size > policy.json_bytes
    return F.struct(F.when(large, note).otherwise(found["value"]).alias("value"), (found["truncated"] | large).alias("truncated"))


def capped(rows: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """At most `limit` detail rows for each key, with the total and whether rows were left out."""
    along = Window.partitionBy(*keys).orderBy(*order)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_rows"))
    first = rows.withColumn("__n", F.row_number().over(along)).where(c("__n") <= limit).drop("__n")
    return first.join(counts, keys).withColumn("truncated", c("total_rows") > limit)


def expired_runs(runs: DataFrame, keep_last: int, keep_days: int, now: Column) -> DataFrame:
    """Runs that neither belong to the last ones of their schedule nor are young enough nor pinned: run_id, schedule_id, finished_at and pinned are read."""
    newest = Window.partitionBy("schedule_id").orderBy(F.desc_nulls_last("finished_at"), F.desc("run_id"))
    ranked = runs.withColumn("__n", F.row_number().over(newest))
    old = c("finished_at") < now - F.lit(keep_days * 86_400)
    return ranked.where((c("__n") > keep_last) & F.coalesce(old, F.lit(False)) & ~F.coalesce(c("pinned").cast("boolean"), F.lit(False))).select("run_id")


def prune_table(spark: SparkSession, path: str, partition: str, tombstones: DataFrame, key: str = "run_id") -> DataFrame:
    """Removes the rows of the tombstones from a table partitioned by one column. Returns the partitions that were rewritten or removed, with the rows they lost."""
    table = spark.read.parquet(path)
    gone = tombstones.select(key).distinct()
    touched = stored(table.join(gone, key, "left_semi").groupBy(partition).agg(F.count(F.lit(1)).alias("removed")))
    if touched.isEmpty():
        return touched
    affected = table.join(touched.select(partition), table[partition].eqNullSafe(touched[partition]), "left_semi")
    kept = stored(affected.join(gone, key, "left_anti").select(*table.columns))
    emptied = touched.join(kept.select(c(partition).alias("__p")).distinct(), c(partition).eqNullSafe(c("__p")), "left_anti")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    # a partition without rows is not part of an overwrite; its folder goes by its name
    folders = emptied.select(F.coalesce(c(partition).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("name"))
    for row in folders.toLocalIterator():
        place = spark._jvm.org.apache.hadoop.fs.Path(path, f"{partition}={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(row['name'])}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return touched
