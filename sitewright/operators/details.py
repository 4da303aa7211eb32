"""Detail rows behind check results: every affected page, image or resource total, uncut, from one scan of each table.

A family names the table that its checks read, the columns that identify a row, and the checks. A drill-down chooses checks; families without a chosen check are not scanned. Pages of a
listing are asked for by the keys of the last row shown (``frontier.page_after``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.operators import canonical, page_checks, resources
from sitewright.operators.predicates import Check, affected_rows

c = F.col


@dataclass(frozen=True)
class Family:
    """Checks over one table: how its rows are made, and what names a row."""

    table: str
    checks: Callable[[], list[Check]]
    item: str
    prepared: Callable[[DataFrame], DataFrame] = lambda rows: rows


FAMILIES = {
    "head": Family("pages", page_checks.head_checks, "url"),
    "crawl": Family("pages", page_checks.crawl_checks, "url", page_checks.prepare),
    "rendering": Family("pages", page_checks.rendering_checks, "url"),
    "structured_data": Family("pages", page_checks.structured_data_page_checks, "url", page_checks.prepare),
    "content": Family("pages", page_checks.content_signal_checks, "url"),
    "canonical": Family("canonical", canonical.canonical_checks, "url"),
    "images": Family("images", resources.image_checks, "image_url", lambda rows: rows.withColumn("url", c("page_url"))),
    "resources": Family("resource_totals", resources.resource_checks, "page_url", lambda rows: rows.withColumn("url", c("page_url"))),
}


def tables_of(pages: DataFrame, images: DataFrame, found: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    """The tables that the families read; only those that a drill-down needs are computed."""
    site = runs.select("run_id", c("final_domain").alias("site_url"))
    hints = pages.select("run_id", "final_url", "has_preload", "has_preconnect").dropDuplicates(["run_id", "final_url"])
    return {
        "pages": pages, "images": images, "canonical": canonical.evaluate(canonical.in_scope(pages).join(site, "run_id", "left"), c("site_url")),
        "resource_totals": resources.page_totals(found).join(hints, ["run_id", "final_url"], "left"),
    }


def rows_of(tables: Mapping[str, DataFrame], chosen: set[str] | None = None, families: Mapping[str, Family] = FAMILIES) -> DataFrame:
    """run_id, check_id, page (url) and item of every row that makes a chosen check fail (all checks, if none is named)."""
    found = None
    for family in families.values():
        checks = [check for check in family.checks() if check.sample and (chosen is None or check.id in chosen)]
        if not checks or family.table not in tables:
            continue
        rows = family.prepared(tables[family.table])
        part = affected_rows(rows, checks, "run_id", c("url").alias("url"), c(family.item).alias("item")).select("run_id", "check_id", "url", "item")
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no table of the chosen checks is given")
    return found
