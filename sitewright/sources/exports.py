"""Named table exports and run bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that a CSV can hold them."""
    columns = [F.to_json(c(name)).alias(name) if kind.startswith(("array", "map", "struct")) else c(name) for name, kind in df.dtypes]
    return df.select(*columns)


def write_table(df: DataFrame, path: str, form: str = "csv", partition: str | None = "run_id") -> None:
    """Distributed write of an export; files are partitioned by run."""
    writer = (flat(df) if form == "csv" else df).write.mode("overwrite")
    if partition and partition in df.columns:
        writer = writer.partitionBy(partition)
    writer.options(header=True).format(form).save(path)


def status_summary(pages: DataFrame) -> DataFrame:
    """Pages per status with their share of the run."""
    counts = pages.groupBy("run_id", F.coalesce(c("status_code"), F.lit(0)).alias("status_code")).agg(F.count(F.lit(1)).alias("pages"))
    total = F.sum("pages").over(Window.partitionBy("run_id"))
    return counts.withColumn("share", F.round(c("pages") * 100 / total, 2))


def type_flags(pages: DataFrame, types: tuple[str, ...] = ("Organization", "WebSite", "BreadcrumbList", "FAQPage", "Article", "Product", "Person", "LocalBusiness")) -> DataFrame:
    return pages.select("run_id", "url", *[F.array_contains(c("schema_types"), name).alias(f"has_{name.lower()}") for name in types])


def report_facts(pages: DataFrame) -> DataFrame:
    """Status, indexable and page-type counts of a report from one scan."""
    pairs = F.array(*[F.struct(F.lit(name).alias("fact"), F.coalesce(c(name).cast("string"), F.lit("unknown")).alias("value")) for name in ("status_code", "indexable", "page_type")])
    return pages.select("run_id", F.inline(pairs)).groupBy("run_id", "fact", "value").agg(F.count(F.lit(1)).alias("pages"))


def bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write all rows of all tables as JSON and return the manifest of row counts."""
    manifest = None
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
        counted = df.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_rows")).withColumn("table_name", F.lit(name)).withColumn("stored_rows", c("total_rows"))
        manifest = counted if manifest is None else manifest.unionByName(counted)
    return manifest


def counts_by(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy("run_id", *keys).agg(F.count(F.lit(1)).alias("findings"))


