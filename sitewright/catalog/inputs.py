"""Page facts of the derived views in the column types the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.catalog.site_views import Site
from sitewright.functions import http

HEADER_COLUMNS = {
    "h_csp": "content-security-policy", "h_hsts": "strict-transport-security", "h_xfo": "x-frame-options",
    "h_xcto": "x-content-type-options", "h_referrer": "referrer-policy", "h_permissions": "permissions-policy",
    "h_cache": "cache-control", "h_etag": "etag", "h_encoding": "content-encoding",
    "h_coop": "cross-origin-opener-policy",
}


def words(column: Column, separator: str = ",") -> Column:
    return F.filter(F.split(F.coalesce(column, F.lit("")), separator), lambda item: item != "")


def header_map(df: DataFrame) -> Column:
    """Header bag from the flat header columns that the frame has; absent headers are left out."""
    pairs = [
        F.when(F.col(column).isNotNull(), F.struct(F.lit(name).alias("k"), F.col(column).alias("v")))
        for column, name in HEADER_COLUMNS.items()
        if column in df.columns
    ]
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


def pages(site: Site) -> DataFrame:
    df = site.table("site_pages")
    return df.withColumns(
        {
            "schema_types": words(F.col("schema_types")),
            "hreflang": words(F.col("hreflang")),
            "og_fields": words(F.col("og_fields")),
            "consent_vendors": words(F.col("consent_vendors")),
            "canonical_values": words(F.col("canonical_values"), " "),
            "attempts": http.parse_attempts(F.col("attempt_statuses")),
            "response_headers": F.when(F.col("headers_stored") == 1, header_map(df)),
        }
    )


def resources(site: Site) -> DataFrame:
    df = site.table("site_resources")
    return df.withColumn("response_headers", header_map(df))


def flat_results(df: DataFrame) -> DataFrame:
    """Check results with text columns only, as the comparison wants them."""
    columns = ["run_id", "check_id", "evaluation_state", "status", "affected_count"]
    if "evidence" in df.columns:
        columns.append("evidence")
    if "sample_urls" in df.columns:
        return df.select(*columns, F.array_join("sample_urls", " | ").alias("sample_urls"))
    return df.select(*columns)
