"""All registered queries, gathered from the catalogue modules."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "page_queries",
    "header_queries",
    "link_queries",
    "template_queries",
    "score_queries",
    "compare_queries",
    "asset_queries",
    "extract_queries",
    "plan_queries",
    "match_queries",
    "summary_queries",
)


def _gather(attribute: str) -> dict:
    merged: dict = {}
    for module in MODULES:
        found = getattr(import_module(f"sitewright.catalog.{module}"), attribute)
        repeated = merged.keys() & found.keys()
        if repeated:
            raise ValueError(f"registered twice: {sorted(repeated)}")
        merged.update(found)
    return merged


def _wide_ranks(query):
    """Ranks leave a query as long numbers, as counts do."""

    def run(spark, folder):
        result = query(spark, folder)
        return result.withColumn("position", result["position"].cast("bigint")) if "position" in result.columns else result

    return run


def queries() -> dict:
    return {name: _wide_ranks(query) for name, query in _gather("QUERIES").items()}


def oracle_sql() -> dict:
    return _gather("ORACLE")
