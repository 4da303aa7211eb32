"""Streaming forms of batch operators: first-seen pages, status windows, upserts per micro-batch."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

c = F.col


def first_seen(pages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each normalised URL of a run once within the watermark."""
    return pages.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["run_id", "normalized_url"])


def status_windows(pages: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Status counts per run and window."""
    windowed = pages.withWatermark("fetched_at", delay).groupBy("run_id", F.window("fetched_at", width).alias("w"), "status_code")
    return windowed.agg(F.count(F.lit(1)).alias("pages")).select("run_id", c("w.start").alias("window_start"), "status_code", "pages")


def upsert_into(pages: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write every micro-batch into a folder of its own; ``latest`` resolves them.

    A batch costs its own size, never the table's. A repeated batch overwrites itself only: folders are named by checkpoint and
    epoch, so a new checkpoint adds to what is there.
    """
    writer = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]

    def append(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/writer={writer}/epoch={epoch}")

    query = pages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()


def latest(spark: SparkSession, path: str, keys: tuple[str, ...] = ("run_id", "normalized_url"), order: str = "page_id") -> DataFrame:
    """The last write of every key over all batches."""
    rows = spark.read.option("basePath", path).parquet(path)
    fields = [name for name in rows.columns if name not in (*keys, "writer", "epoch")]
    last = F.max_by(F.struct(*fields), F.struct(order, "epoch", "writer"))
    return rows.groupBy(*keys).agg(last.alias("last")).select(*keys, "last.*")
