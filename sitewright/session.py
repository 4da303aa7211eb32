"""Session helpers: sane defaults for tests and the shared folder of a cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sitewright", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC timestamps."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share. A session has to be started with it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("start the session with spark.checkpoint.dir, a folder that the driver and all executors share")
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The frame written as Parquet into the shared folder and read back: a lost executor costs no more than its running tasks."""
    path = f"{shared_folder(df.sparkSession)}/sitewright/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batched(df: DataFrame) -> DataFrame:
    """The same frame, in a session whose Arrow batches hold at most 1,000 rows: texts are long, and tasks hold whole batches in memory. A limit that the session has set itself stays."""
    name, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if df.sparkSession.conf.get(name, default) == default:
        df.sparkSession.conf.set(name, "1000")
    return df
