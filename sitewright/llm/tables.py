"""Stored intermediate tables and row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sitewright.session import batched, shared_folder, stored

__all__ = ["LAST", "batched", "load", "new_folder", "order_key", "shuffle_partitions", "stored", "stored_with", "text_key"]

LAST = (1 << 63) - 1


def stored_with(df: DataFrame, **facts: Column) -> tuple[DataFrame, dict]:
    """The stored frame and aggregates over its rows that are taken while it is written."""
    seen = Observation()
    frame = stored(df.observe(seen, *[fact.alias(name) for name, fact in facts.items()]))
    return frame, seen.get


def new_folder(spark: SparkSession) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_folder(spark)}/sitewright/{uuid.uuid4().hex}"


def order_key(column: str = "doc_id") -> Column:
    """A document's place in the order of ids; rows without an id come last."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST))


def text_key(column: str = "text") -> Column:
    """Tells rows apart that repeat an id with another text."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
