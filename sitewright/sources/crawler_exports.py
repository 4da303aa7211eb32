"""Crawler CSV exports: type detection, alias mapping, merge of facts across files, import into pages; all files in one job."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewright.functions import misc as MI
from sitewright.functions import url as U
from sitewright.session import stored
from sitewright.sources import delimited as D

c = F.col

# fixed values: export types with their required headers, signal headers and file name hints
EXPORTS = {
    "internal_html": (
        ("address",),
        ("content_type", "indexability", "title_1", "meta_description_1", "h1_1", "canonical_link_element_1"),
        ("internal_html", "internal all", "internal_all", "all_internal"),
    ),
    "response_codes": (
        ("address", "status_code"),
        ("status", "indexability"),
        ("response_codes", "response codes"),
    ),
    "page_titles": (
        ("address",),
        ("title_1", "title_1_length", "title_1_pixel_width"),
        ("page_titles", "page titles"),
    ),
    "meta_descriptions": (
        ("address",),
        ("meta_description_1", "meta_description_1_length", "meta_description_1_pixel_width"),
        ("meta_descriptions", "meta description"),
    ),
    "h1": (
        ("address",),
        ("h1_1", "h1_1_length", "h1_1_occurrences"),
        ("h1",),
    ),
    "h2": (
        ("address",),
        ("h2_1", "h2_1_length", "h2_1_occurrences"),
        ("h2",),
    ),
    "canonicals": (
        ("address",),
        ("canonical_link_element_1", "canonicalised", "canonical_link_element_1_status_code"),
        ("canonicals", "canonical"),
    ),
    "directives": (
        ("address",),
        ("meta_robots_1", "x_robots_tag_1", "indexability_status"),
        ("directives",),
    ),
    "inlinks": (
        ("source", "destination"),
        ("anchor_text", "type", "follow"),
        ("inlinks", "in links"),
    ),
    "outlinks": (
        ("source", "destination"),
        ("anchor_text", "type", "follow"),
        ("outlinks", "out links"),
    ),
    "images": (
        (),
        ("image", "alt_text", "source", "size_bytes", "missing_alt_text"),
        ("images",),
    ),
    "structured_data": (
        ("address",),
        ("type", "validation_status", "schema_type"),
        ("structured_data", "structured data"),
    ),
    "psi_crux": (
        ("address",),
        ("largest_contentful_paint", "interaction_to_next_paint", "cumulative_layout_shift", "performance_score"),
        ("psi", "crux", "pagespeed", "page speed"),
    ),
    "hreflang": (
        ("address",),
        ("hreflang", "language", "language_region", "x_default", "return_links", "alternate_url"),
        ("hreflang",),
    ),
    "opengraph": (
        ("address",),
        ("og_title", "og_description", "og_image", "og_url", "og_type"),
        ("open_graph", "opengraph", "open graph"),
    ),
    "security_headers": (
        ("address",),
        ("cache_control", "x_cache", "cf_cache_status", "via", "server", "http_version", "content_encoding"),
        ("security", "headers", "response headers"),
    ),
    "javascript": (
        ("address",),
        ("rendered", "javascript", "js_count", "css_count", "total_js_size", "total_css_size"),
        ("javascript", "rendered", "js"),
    ),
    "resource_hints": (
        ("address",),
        ("preconnect", "dns_prefetch", "preload", "prefetch"),
        ("resource hints", "preconnect", "preload"),
    ),
}
# fixed values: column aliases of the logical fields, first non-empty one wins
FIELDS = {
    "url": ("address", "url"),
    "final_url": ("final_url", "final_address", "redirect_url"),
    "status_code": ("status_code", "http_status_code"),
    "content_type": ("content_type",),
    "indexability": ("indexability",),
    "title": ("title_1", "title"),
    "meta_description": ("meta_description_1", "meta_description"),
    "h1": ("h1_1", "h1"),
    "h1_count": ("h1_1_occurrences", "h1_occurrences", "h1_count"),
    "canonical": ("canonical_link_element_1", "canonical", "canonical_url"),
    "meta_robots": ("meta_robots_1", "meta_robots"),
    "x_robots_tag": ("x_robots_tag_1", "x_robots_tag"),
    "word_count": ("word_count",),
    "depth": ("crawl_depth", "depth"),
    "inlink_count": ("inlinks", "unique_inlinks"),
    "outlink_count": ("outlinks", "unique_outlinks"),
    "raw_html_size": ("size_bytes", "size"),
    "schema_types": ("schema_types", "schema_type", "type"),
    "performance_score": ("psi_performance_score", "performance_score"),
    "cache_control": ("cache_control", "cache_control_header"),
    "http_version": ("http_version", "protocol"),
    "source": ("source", "from"),
    "destination": ("destination", "to"),
    "anchor_text": ("anchor_text", "anchor"),
    "link_type": ("type", "link_type"),
    "rel": ("rel",),
    "image_url": ("image", "image_url", "address"),
    "page_url": ("source", "page_url"),
    "alt": ("alt_text", "alt"),
}
NUMERIC = ("status_code", "h1_count", "word_count", "depth", "inlink_count", "outlink_count", "raw_html_size")
TEXT = ("final_url", "content_type", "indexability", "title", "meta_description", "h1", "canonical", "meta_robots", "x_robots_tag", "cache_control", "http_version")


#: Exports that a complete import has.
EXPECTED = (
    "internal_html", "response_codes", "page_titles", "meta_descriptions", "h1", "canonicals", "directives", "inlinks", "outlinks", "images",
    "structured_data", "hreflang",
)
LINK_EXPORTS = ("inlinks", "outlinks")


def export_type(names: Column, path: Column) -> Column:
    """Struct with the best export type for header names and a path, with its confidence: required headers count four times, signal headers once, a hint in the name of the file or its folder twice.

    Ties go to the type with more signal headers, then to the one listed first. Without any point the type is unknown.
    """
    words = lambda text: F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    place = words(F.regexp_extract(F.coalesce(path, F.lit("")), "([^/]*/)?[^/]*$", 0))
    scored = []
    for order, (kind, (required, signals, hints)) in enumerate(EXPORTS.items()):
        have = lambda wanted: F.size(F.array_intersect(names, F.array(*map(F.lit, wanted)))) if wanted else F.lit(0)
        hinted = F.exists(F.array(*[F.lit(re.sub("[^a-z0-9]+", " ", hint).strip()) for hint in (kind, *hints)]), lambda hint: place.contains(hint))
        found, signs = have(required), have(signals)
        confidence = F.when(found < len(required), "medium").otherwise("high")
        scored.append(F.struct((4 * found + signs + F.when(hinted, 2).otherwise(0)).alias("score"), signs.alias("signs"), F.lit(-order).alias("order"), F.lit(kind).alias("kind"), confidence.alias("confidence")))
    none = F.struct(F.lit(0).alias("score"), F.lit(len(EXPORTS)).alias("signs"), F.lit(0).alias("order"), F.lit("unknown").alias("kind"), F.lit("low").alias("confidence"))
    return F.array_max(F.array(none, *scored))


def scan(spark: SparkSession, paths: list[str], run_id: str) -> tuple[DataFrame, DataFrame]:
    """Files with their export type, and the rows of all of them, in one job. Later files, by path, overwrite earlier ones."""
    files, rows = D.table(spark, paths)
    named = U.computed_once(files, {"found": export_type(F.array_compact("names"), c("path"))})
    order = F.dense_rank().over(Window.orderBy("path")) - 1
    known = stored(named.select("file", "path", "bytes", "delimiter", "headers", "names", c("found.kind").alias("export_type"), "found.confidence", order.alias("file_order")))
    typed = rows.join(known.select("file", "export_type", "file_order"), "file")
    return known, typed.select(F.lit(run_id).alias("run_id"), "export_type", "file_order", F.struct("block", "seq").alias("row_order"), "names", "cells")


def column_report(files: DataFrame) -> DataFrame:
    """Every header of every file with the logical fields that it fills; none means that the column is ignored."""
    known = [(field, alias) for field, aliases in FIELDS.items() for alias in aliases]
    table = F.array(*[F.struct(F.lit(field).alias("field"), F.lit(alias).alias("alias")) for field, alias in known])
    rows = files.select("path", "export_type", "confidence", F.posexplode(F.arrays_zip("headers", "names")).alias("position", "column"))
    fields = F.transform(F.filter(table, lambda pair: pair["alias"] == c("column.names")), lambda pair: pair["field"])
    return rows.select("path", "export_type", "confidence", "position", c("column.headers").alias("header"), c("column.names").alias("name"), F.coalesce(fields, F.array().cast("array<string>")).alias("fields"))


def field(rows: DataFrame, name: str) -> Column:
    """A logical field of scanned rows, or of a frame with one column for each header."""
    if "cells" in rows.columns:
        return D.cell(*FIELDS[name])
    found = [F.nullif(F.trim(c(alias).cast("string")), F.lit("")) for alias in FIELDS[name] if alias in rows.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def facts(rows: DataFrame) -> DataFrame:
    """Typed page facts of an export, one row per line with a usable address."""
    columns = {name: MI.imported_number(field(rows, name)) for name in NUMERIC} | {name: field(rows, name) for name in TEXT}
    columns |= {"url": U.normalize(field(rows, "url")), "schema_types": MI.imported_list(field(rows, "schema_types")), "performance_score": MI.imported_score(MI.imported_number(field(rows, "performance_score")))}
    out = rows.select("run_id", "export_type", "file_order", "row_order", *[column.alias(name) for name, column in columns.items()])
    return out.where(c("url").isNotNull())


def links(rows: DataFrame) -> DataFrame:
    target = U.normalize(field(rows, "destination"))
    kind = F.when(F.lower(F.coalesce(field(rows, "link_type"), F.lit(""))).contains("external"), "external").otherwise("internal")
    return rows.select("run_id", U.normalize(field(rows, "source")).alias("source_url"), target.alias("normalized_target_url"), kind.alias("link_type"), field(rows, "anchor_text").alias("anchor_text"), field(rows, "rel").alias("rel"))


def images(rows: DataFrame) -> DataFrame:
    page = U.normalize(field(rows, "page_url"))
    return rows.select("run_id", page.alias("page_url"), U.normalize(field(rows, "image_url"), page).alias("image_url"), field(rows, "alt").alias("alt_value"), field(rows, "alt").isNotNull().alias("alt_present"))


def merge(all_facts: DataFrame) -> DataFrame:
    """One fact per URL over all files: the last non-empty scalar wins, arrays unite."""
    order = F.struct("file_order", "row_order")
    scalars = [F.max_by(name, F.when(c(name).isNotNull(), order)).alias(name) for name in (*NUMERIC, *TEXT, "performance_score")]
    merged = all_facts.groupBy("run_id", "url").agg(*scalars, F.array_sort(F.collect_set("export_type")).alias("source_types"))
    # Type names are reduced per (url, name) before they are gathered: a page has few of them, its files may be many.
    names = all_facts.select("run_id", "url", F.explode("schema_types").alias("name")).distinct().groupBy("run_id", "url").agg(F.array_sort(F.collect_list("name")).alias("schema_types"))
    return merged.join(names, ["run_id", "url"], "left")


def page_records(merged: DataFrame) -> DataFrame:
    """Page rows with the defaults an import implies."""
    robots = F.lower(F.concat_ws(" ", "meta_robots", "x_robots_tag"))
    noindex, nofollow = robots.contains("noindex"), robots.contains("nofollow")
    stated = F.lower(c("indexability"))
    indexable = F.when(c("indexability").isNotNull(), stated.contains("indexable") & ~stated.contains("non-indexable")).when(noindex | (c("status_code") >= 400), False).otherwise(True)
    kind = F.coalesce(c("content_type"), F.when(F.coalesce(c("status_code"), F.lit(999)) < 300, "text/html"))
    return merged.select(
        "run_id", "url", F.coalesce(U.normalize(c("final_url")), c("url")).alias("normalized_url"), c("status_code").cast("int").alias("status_code"), kind.alias("content_type"), indexable.cast("int").alias("indexable"), noindex.cast("int").alias("noindex"), nofollow.cast("int").alias("nofollow"), "meta_robots", "x_robots_tag", "title",
        F.length("title").alias("title_length"), "meta_description", "h1", F.coalesce(c("h1_count"), F.when(c("h1").isNotNull(), 1).otherwise(0)).cast("int").alias("h1_count"), "canonical", F.coalesce(c("word_count"), F.lit(0)).cast("int").alias("word_count"),
        F.coalesce(c("depth"), F.lit(0)).cast("int").alias("depth"), F.coalesce("schema_types", F.array().cast("array<string>")).alias("schema_types"), "performance_score", "source_types", c("raw_html_size").cast("bigint").alias("raw_html_size"),
    )


def image_facts(rows: DataFrame) -> DataFrame:
    """Pages that an image export names, as facts without values."""
    return rows.select("run_id", "export_type", "file_order", "row_order", U.normalize(field(rows, "page_url")).alias("url")).where(c("url").isNotNull())


def import_exports(spark: SparkSession, paths: list[str], run_id: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages, links and images of any number of exports, and the files they came from."""
    files, rows = scan(spark, paths, run_id)
    edges, pictures = rows.where(c("export_type").isin(*LINK_EXPORTS)), rows.where(c("export_type") == "images")
    others = facts(rows.where(~c("export_type").isin(*LINK_EXPORTS, "images")))
    found = others.unionByName(image_facts(pictures), allowMissingColumns=True)
    return page_records(merge(found)), links(edges).where("source_url IS NOT NULL AND normalized_target_url IS NOT NULL"), images(pictures).where("image_url IS NOT NULL"), files


def missing_exports(files: DataFrame) -> DataFrame:
    """Expected export types that no file has."""
    have = files.select("export_type").distinct()
    return files.sparkSession.createDataFrame([(kind,) for kind in EXPECTED], "export_type string").join(have, "export_type", "left_anti")
