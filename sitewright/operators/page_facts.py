"""Page rows from any source in the columns that the page checks read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitewright.functions import page_type as PT
from sitewright.functions import url as U

c = F.col
#: Columns of a page row; a source leaves out what it cannot know.
COLUMNS = (
    "run_id string, url string, normalized_url string, final_url string, depth int, status_code int, initial_status_code int, content_type string, indexable int, noindex int, nofollow int, meta_robots string, "
    "x_robots_tag string, title string, h1_text string, meta_description string, h1_count int, h2_count int, html_lang string, viewport string, favicon string, manifest string, header_utf8 int, meta_utf8 int, "
    "canonical_values array<string>, metadata_complete int, page_type string, page_type_confidence string, schema_types array<string>, word_count_raw int, raw_html_size bigint, internal_links int, external_links int, "
    "has_faq int, has_weak_faq int, has_tables int, has_lists int, has_date int, has_author int, source_links int, has_video int, low_structure int, text_facts int, touch_icons int, has_preload int, has_preconnect int, "
    "hreflang array<string>, og_fields array<string>, og_url string, consent_vendors array<string>, has_tag_manager int, main_regions int, nav_regions int, search_forms int, main_search_forms int, search_result_lists int, "
    "search_result_text int, search_action int, empty_headings int, heading_skips int, attempts array<struct<final_status:int,error_type:string>>, response_headers map<string,string>, headers_stored int"
)


def completed(pages: DataFrame) -> DataFrame:
    """The page rows with every column of COLUMNS, null where the source has none; other columns stay."""
    missing = [field for field in StructType.fromDDL(COLUMNS) if field.name not in pages.columns]
    return pages.withColumns({field.name: F.lit(None).cast(field.dataType) for field in missing})


def from_import(pages: DataFrame) -> DataFrame:
    """Page rows of imported records. What an export does not say stays null; its facts count as complete."""
    kind = PT.classify(c("url"), title=c("title"), h1=F.array_compact(F.array("h1")), types=c("schema_types"))
    rows = U.computed_once(pages, {"kind": kind})
    return completed(rows.select(
        "run_id", "url", "normalized_url", c("normalized_url").alias("final_url"), "depth", "status_code", c("status_code").alias("initial_status_code"), "content_type", "indexable", "noindex", "nofollow", "meta_robots", "x_robots_tag",
        "title", c("h1").alias("h1_text"), "meta_description", "h1_count", F.array_compact(F.array("canonical")).alias("canonical_values"), F.lit(1).alias("metadata_complete"), c("kind.page_type").alias("page_type"),
        c("kind.confidence").alias("page_type_confidence"), "schema_types", c("word_count").alias("word_count_raw"), "raw_html_size", "source_types",
    ))


def _flag(column: Column) -> Column:
    return F.coalesce(column.cast("boolean"), F.lit(False)).cast("int")


def from_html(pages: DataFrame, links: DataFrame, types: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """Page rows of extracted documents.

    ``pages`` and ``links`` come from ``extraction``, ``types`` (page_id, schema_type) from the JSON-LD entities. ``fetched`` has what the crawler saw of a page: page_id and any of
    run_id, status_code, initial_status_code, content_type, x_robots_tag, depth, attempts, response_headers; without it a document counts as fetched with success, its host as its run.
    """
    targets = links.groupBy("page_id").agg(F.count_if(c("link_type") == "internal").cast("int").alias("internal_links"), F.count_if(c("link_type") == "external").cast("int").alias("external_links"))
    named = types.where("schema_type IS NOT NULL").select("page_id", "schema_type").distinct().groupBy("page_id").agg(F.array_sort(F.collect_list("schema_type")).alias("schema_types"))
    rows = pages.join(targets, "page_id", "left").join(named, "page_id", "left")
    if fetched is not None:
        rows = rows.join(fetched, "page_id", "left")
    seen = lambda name, default: F.coalesce(c(name), default) if name in rows.columns else default
    robots, status = F.lower(F.coalesce(c("meta_robots"), F.lit(""))), seen("status_code", F.lit(200))
    kind = seen("content_type", F.lit("text/html"))
    headers = F.concat_ws(" ", kind, F.try_element_at("response_headers", F.lit("content-type")) if "response_headers" in rows.columns else F.lit(""))
    utf8 = lambda text: _flag(F.lower(text).rlike("utf-?8"))
    og = F.map_filter("og", lambda _, value: value != "")
    extra = [name for name in ("x_robots_tag", "depth", "attempts", "response_headers", "headers_stored") if name in rows.columns]
    return completed(rows.select(
        "page_id", seen("run_id", U.host(c("url"))).alias("run_id"), "url", U.normalize(c("url")).alias("normalized_url"), c("url").alias("final_url"), status.alias("status_code"), seen("initial_status_code", status).alias("initial_status_code"),
        kind.alias("content_type"), _flag(c("indexable")).alias("indexable"), _flag(~c("indexable")).alias("noindex"), _flag(robots.contains("nofollow")).alias("nofollow"), "meta_robots", "title", F.array_join("h1", " ").alias("h1_text"),
        "meta_description", "h1_count", F.size("h2").alias("h2_count"), "html_lang", "viewport", "favicon", "manifest", utf8(headers).alias("header_utf8"), utf8(F.coalesce("meta_charset", F.lit(""))).alias("meta_utf8"),
        c("canonicals").alias("canonical_values"), F.lit(1).alias("metadata_complete"), "page_type", "page_type_confidence", F.coalesce("schema_types", F.array().cast("array<string>")).alias("schema_types"), c("word_count").alias("word_count_raw"),
        c("html_bytes").alias("raw_html_size"), F.coalesce("internal_links", F.lit(0)).alias("internal_links"), F.coalesce("external_links", F.lit(0)).alias("external_links"), _flag(c("has_faq")).alias("has_faq"), _flag(c("has_weak_faq")).alias("has_weak_faq"),
        _flag(c("tables") > 0).alias("has_tables"), _flag(c("lists") > 0).alias("has_lists"), _flag(c("has_date")).alias("has_date"), _flag(c("has_author")).alias("has_author"), F.size("source_targets").alias("source_links"), _flag(c("videos") > 0).alias("has_video"),
        _flag(c("low_structure")).alias("low_structure"), F.lit(1).alias("text_facts"), "touch_icons", _flag(c("preloads") + c("modulepreload_hints") > 0).alias("has_preload"), _flag(c("preconnects") + c("dns_prefetch_hints") > 0).alias("has_preconnect"),
        F.transform("hreflang", lambda item: item["code"]).alias("hreflang"), F.map_keys(og).alias("og_fields"), F.try_element_at("og", F.lit("og:url")).alias("og_url"), c("consent.vendors").alias("consent_vendors"),
        _flag(F.size("consent.tags") > 0).alias("has_tag_manager"), "main_regions", "nav_regions", "search_forms", "main_search_forms", "search_result_lists", _flag(c("search_result_text")).alias("search_result_text"), _flag(c("search_action")).alias("search_action"),
        "empty_headings", "heading_skips", *extra,
    ))
