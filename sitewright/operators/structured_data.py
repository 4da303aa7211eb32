"""JSON-LD blocks and the checks over stored type rows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.functions.schema_types import type_name
from sitewright.operators import scopes as S
from sitewright.session import batched

c = F.col
#: Blocks read at a time; the rows of their entities leave the worker before the next ones are read.
PIECE = 200
DATA = "Structured Data"
ENTITY_SCHEMA = (
    "page_id bigint, block_index int, parse_status string, snippet_hash string, body_length bigint, entity_index int, entity_path string, entity_id string, "
    "raw_type string, properties array<string>, referenced_ids array<string>, entity_linked boolean"
)


def _names(value) -> list[str]:
    items = value if isinstance(value, list) else [value] if value else []
    return list(dict.fromkeys(str(item).strip() for item in items if item and str(item).strip()))


def _typed_nodes(root) -> list[tuple[str, dict]]:
    """Objects with a type, in document order, with their paths."""
    found, waiting = [], [("$", root)]
    while waiting:
        path, node = waiting.pop(0) if len(waiting) == 1 else waiting.pop()
        if isinstance(node, list):
            waiting.extend((f"{path}[{i}]", item) for i, item in reversed(list(enumerate(node))))
        elif isinstance(node, dict):
            if _names(node.get("@type")):
                found.append((path, node))
            waiting.extend((f"{path}.{key}", item) for key, item in reversed(list(node.items())) if key != "@type" and isinstance(item, (dict, list)))
    return found


def _references(node: dict) -> list[str]:
    ids, waiting = set(), [item for item in node.values() if isinstance(item, (dict, list))]
    while waiting:
        item = waiting.pop()
        if isinstance(item, dict) and item.get("@id"):
            ids.add(str(item["@id"]).strip())
        waiting.extend(x for x in (item.values() if isinstance(item, dict) else item) if isinstance(x, (dict, list)))
    return sorted(x for x in ids if x)


def _block_rows(page_id, index: int, body: str) -> Iterator[dict]:
    text = body.strip()
    digest = hashlib.sha256(text.encode("utf-8")).hexdigest() if text else None
    base = {"page_id": page_id, "block_index": index, "snippet_hash": digest, "body_length": len(body.encode("utf-8")), "properties": [], "referenced_ids": [], "entity_linked": False}
    if not text:
        yield base | {"parse_status": "empty"}
        return
    try:
        nodes = _typed_nodes(json.loads(text))
    except (ValueError, RecursionError):
        yield base | {"parse_status": "error"}
        return
    if not nodes:
        yield base | {"parse_status": "ok"}
    ids = {str(node.get("@id") or "").strip() for _, node in nodes} - {""}
    for position, (path, node) in enumerate(nodes):
        references = _references(node)
        for name in _names(node.get("@type")):
            yield base | {
                "parse_status": "ok", "entity_index": position, "entity_path": path, "entity_id": str(node.get("@id") or "").strip() or None, "raw_type": name,
                "properties": sorted(key for key in node if not key.startswith("@")), "referenced_ids": references, "entity_linked": any(x in ids for x in references),
            }


def entities(blocks: DataFrame) -> DataFrame:
    """Rows per entity and type of JSON-LD blocks ``(page_id, block_index, body)``; blocks stay in their partition."""
    columns = [field.split()[0] for field in ENTITY_SCHEMA.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, max(len(batch), 1), PIECE):
                piece = batch.iloc[at : at + PIECE]
                rows = [row for page_id, index, body in zip(piece["page_id"], piece["block_index"], piece["body"]) for row in _block_rows(page_id, int(index), body or "")]
                yield pd.DataFrame(rows, columns=columns)

    raw = batched(blocks.select("page_id", "block_index", "body")).mapInPandas(walk, ENTITY_SCHEMA)
    return raw.withColumn("schema_type", type_name(c("raw_type"))).drop("raw_type")


def rows_with_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Type rows with their page, matched by final, requested or normalised URL.

    The three keys become rows of one equi-join, which replaces a nested-loop join on an OR condition.
    """
    forms = pages.select("run_id", "page_id", "page_type", F.explode(F.array_distinct(F.array_compact(F.array("final_url", "url", "normalized_url")))).alias("page_url")).drop("page_id")
    page = forms.groupBy("run_id", "page_url").agg(F.min("page_type").alias("matched_page_type"))
    return rows.join(page, ["run_id", "page_url"])


def type_coverage(rows: DataFrame) -> DataFrame:
    """Distinct pages per type."""
    pairs = rows.where((c("parse_status") == "ok") & c("schema_type").isNotNull()).select("run_id", "schema_type", "page_url").distinct()
    return pairs.groupBy("run_id", "schema_type").agg(F.count(F.lit(1)).alias("pages"))


def page_type_by_schema(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct URLs per page type and type name."""
    joined = rows_with_pages(rows.where(c("parse_status") == "ok"), pages)
    pairs = joined.select("run_id", F.col("matched_page_type").alias("page_type"), "schema_type", "page_url").distinct()
    return pairs.groupBy("run_id", "page_type", "schema_type").agg(F.count(F.lit(1)).alias("urls"))


def schema_results(rows: DataFrame, pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Parse errors, inventory, missing site types, location, person and sameAs checks."""
    html = pages.groupBy("run_id").agg(
        F.count_if(F.coalesce(S.is_html(), F.lit(False))).alias("html"),
        F.count_if(F.coalesce(S.is_html() & (S.page_type() == "location") & F.lower(F.concat_ws(" ", c("url"), c("title"))).rlike("/standort|/filiale|/location|standort|filiale"), F.lit(False))).alias("places"),
        F.count_if(F.coalesce(S.is_html() & _person_scope(), F.lit(False))).alias("people"),
        F.count_if(F.coalesce(S.is_html() & _person_scope() & ~F.array_contains(c("schema_types"), "Person"), F.lit(False))).alias("people_missing"),
    )
    ok, kind = c("parse_status") == "ok", c("schema_type")
    counts = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("ok"), F.count_if(ok & (kind == "Organization")).alias("organization"), F.count_if(ok & (kind == "WebSite")).alias("website"),
        F.count_if(ok & (kind == "LocalBusiness")).alias("local"), F.count_if(ok & (kind == "Person")).alias("person"), F.count_if(ok & (kind == "Organization") & F.array_contains(c("properties"), "sameAs")).alias("same_as"),
    )
    matched = rows_with_pages(rows, pages)
    technical = matched.where(c("parse_status") == "technical_error").groupBy("run_id").agg(F.count(F.lit(1)).alias("technical"))
    block = F.coalesce(c("snippet_hash"), F.concat(F.lit("block:"), c("block_index").cast("string")))
    bad_blocks = matched.where(c("parse_status") == "error").select("run_id", "page_url", block.alias("block"), "matched_page_type").distinct()
    bad_pages = bad_blocks.groupBy("run_id", "page_url").agg(F.count(F.lit(1)).alias("blocks"), F.max(c("matched_page_type").isin("article", "product").cast("int")).alias("detail"))
    errors = bad_pages.groupBy("run_id").agg(F.sum("blocks").alias("errors"), F.count(F.lit(1)).alias("error_pages"), F.sum("detail").alias("detail_pages"))
    joined = runs.select("run_id").join(html, "run_id", "left").join(counts, "run_id", "left").join(technical, "run_id", "left").join(errors, "run_id", "left").na.fill(0)
    share = c("error_pages") / F.greatest(F.lit(1), c("html"))
    wide = (c("error_pages") >= 3) & ((share >= 0.5) | ((c("detail_pages") == c("error_pages")) & (share >= 0.25)))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def result(check_id: str, state: Column, affected: Column, failing: str = "Warning", priority: Column = F.lit("Low")) -> Column:
        status = F.when(state == "pass", "OK").when(state == "fail", failing).otherwise("NA")
        return F.struct(F.lit(check_id).alias("check_id"), state.alias("evaluation_state"), status.alias("status"), priority.alias("priority"), F.when(state == "fail", affected).otherwise(zero).cast("bigint").alias("affected_count"))

    parse = F.when((c("errors") == 0) & (c("technical") > 0), "technical_error").when(c("rows") == 0, "insufficient_evidence").when((c("errors") == 0) & (c("ok") == 0), "not_applicable").when(c("errors") > 0, "fail").otherwise("pass")
    present = lambda name: F.when(c("html") == 0, "insufficient_evidence").when(c(name) > 0, "pass").otherwise("fail")
    same_as = F.when(c("organization") == 0, "not_applicable").when(c("same_as") > 0, "pass").otherwise("fail")
    local = F.when(c("local") > 0, "pass").when(c("places") > 0, "fail").otherwise("not_applicable")
    person = F.when(c("person") > 0, "pass").when(c("people") > 0, "fail").otherwise("insufficient_evidence")
    return joined.select(
        "run_id",
        F.inline(
            F.array(
                result("tech.json_ld_parse_errors", parse, c("errors"), "Error", F.when((c("errors") > 0) & wide, "High").otherwise("Medium")), result("tech.schema_types_coverage_summary", present("ok"), zero),
                result("tech.organization_missing", present("organization"), one), result("tech.website_missing", present("website"), one), result("tech.organization_sameas_missing", same_as, one),
                result("geo.organization_schema_sameas", same_as, one), result("tech.localbusiness_present_missing", local, c("places")), result("tech.person_present_missing", person, c("people_missing")),
            )
        ),
    )


def _person_scope() -> Column:
    address, title = F.lower(c("url")), F.lower(F.coalesce(c("title"), F.lit("")))
    named = address.contains("/team") | address.contains("/autor") | address.contains("/author") | title.contains("autor") | title.contains("team")
    return (S.has_text_facts() & ((S.page_type() == "article") | (F.coalesce(c("has_author"), F.lit(0)) == 1))) | named
