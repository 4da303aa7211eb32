"""Queries over matching with manual reviews, exports and imported facts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitewright.catalog import inputs
from sitewright.catalog.site_views import Site, with_views
from sitewright.operators import matching as MA
from sitewright.operators import page_checks as PC
from sitewright.operators import page_facts as PF
from sitewright.operators import summaries as SU
from sitewright.operators import templates as TP
from sitewright.operators.predicates import evaluate_checks
from sitewright.session import shared_folder, stored
from sitewright.sources import crawler_exports as CE
from sitewright.sources import exports as XP

QUERIES = {}
ORACLE = {}
c = F.col


def _simple(build):
    return lambda spark, folder: build(Site(spark, folder))


def _items(s):
    words = F.when(c("doc_id") % 6 == 0, "Title tags").when(c("doc_id") % 6 == 1, "Canonical setup").when(c("doc_id") % 6 == 2, "Security headers").when(c("doc_id") % 6 == 3, "LCP field data").when(c("doc_id") % 6 == 4, "Impressum and contact").otherwise("Zqx")
    runs = s.table("finding_runs").agg(F.count(F.lit(1)).alias("n"))
    return s.table("documents").join(F.broadcast(runs)).select(
        F.concat(F.lit("run-"), (c("doc_id") % c("n")).cast("string")).alias("run_id"), c("doc_id").alias("item_id"), words.alias("title"), F.lit("").alias("description"), F.lit("").alias("recommendation"),
        F.when(c("doc_id") % 4 == 0, "html-head").when(c("doc_id") % 4 == 1, "technical-seo").otherwise("other").alias("category"), F.when(c("doc_id") % 3 == 0, "High").otherwise("Low").alias("priority"), (c("n_chars") % 60).alias("affected_count"))


ITEMS = """(SELECT 'run-' || (doc_id % (SELECT count(*) FROM finding_runs)) AS run_id, doc_id AS item_id, CASE doc_id % 6 WHEN 0 THEN 'Title tags' WHEN 1 THEN 'Canonical setup' WHEN 2 THEN 'Security headers' WHEN 3 THEN 'LCP field data' WHEN 4 THEN 'Impressum and contact' ELSE 'Zqx' END AS title,
 CASE doc_id % 4 WHEN 0 THEN 'html-head' WHEN 1 THEN 'technical-seo' ELSE 'other' END AS category, CASE WHEN doc_id % 3 = 0 THEN 'High' ELSE 'Low' END AS priority, n_chars % 60 AS affected_count FROM documents)"""


def _findings(s):
    key = F.when(c("category").contains("Head"), "html-head").when(c("category").contains("Crawling"), "technical-seo").otherwise("other")
    rows = s.table("site_findings").groupBy("run_id", "check_id").agg(F.min_by(F.struct("finding_id", "category", "priority", "affected_count", "status", "confidence", "finding_type", "review_recommended", "finding"), "finding_id").alias("m")).select("run_id", "check_id", "m.*")
    return rows.withColumns({"check_name": F.regexp_replace(F.regexp_replace("check_id", r"^[a-z]+\.", ""), "_", " "), "category_key": key})


QUERIES["match_items"] = _simple(lambda s: MA.map_items(_items(s)).select("item_id", F.array_join("rules", ",").alias("rules"), F.size("expected_checks").alias("expected"), "needs_external", "needs_human", "mapping_confidence"))
HEAD_RULES = "'title,meta-description,h1,open-graph'"
SEO_RULES = "'noindex,canonical,status-redirect,internal-links,robots-sitemap-pagination'"
ORACLE["match_items"] = f"""SELECT item_id, CASE m WHEN 0 THEN 'title' WHEN 1 THEN 'canonical' WHEN 2 THEN 'security-headers' WHEN 3 THEN 'crux-psi' WHEN 4 THEN 'trust-entity' ELSE CASE k WHEN 0 THEN {HEAD_RULES} WHEN 1 THEN {SEO_RULES} ELSE '' END END AS rules,
 CAST(CASE m WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 6 WHEN 3 THEN 3 WHEN 4 THEN 7 ELSE CASE k WHEN 0 THEN 13 WHEN 1 THEN 18 ELSE 0 END END AS INT) AS expected, m = 3 AS needs_external, m = 4 AS needs_human, CASE WHEN m < 5 THEN 'high' WHEN k < 2 THEN 'medium' ELSE 'low' END AS mapping_confidence FROM (SELECT item_id, item_id % 6 AS m, item_id % 4 AS k FROM {ITEMS} i) x"""


def _scored(s):
    return MA.candidates(MA.map_items(_items(s)), _findings(s))


QUERIES["match_candidates"] = _simple(lambda s: _scored(s).select("run_id", "item_id", "finding_id", "check_id", "direct", "family_match", "match_score"))
QUERIES["match_coverage"] = _simple(lambda s: MA.coverage(MA.map_items(_items(s)), _scored(s)).drop("expected_checks"))
QUERIES["match_summary"] = _simple(lambda s: MA.coverage_summary(MA.coverage(MA.map_items(_items(s)), _scored(s))))


def _extra(s):
    findings, mapped = stored(_findings(s)), MA.map_items(_items(s))
    scored = stored(MA.candidates(mapped, findings))
    return MA.extra_findings(findings, scored, MA.coverage(mapped, scored))


QUERIES["match_extra_findings"] = _simple(_extra)

QUERIES["export_status_summary"] = _simple(lambda s: XP.status_summary(s.table("site_pages")))
ORACLE["export_status_summary"] = "SELECT run_id, coalesce(status_code, 0) AS status_code, count(*) AS pages, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY run_id), 2) AS share FROM site_pages GROUP BY 1, 2"
QUERIES["export_type_flags"] = _simple(lambda s: XP.type_flags(inputs.pages(s), ("Organization", "Product", "Article")).select("run_id", "url", "has_organization", "has_product", "has_article"))
ORACLE["export_type_flags"] = "SELECT run_id, url, list_contains(string_split(schema_types, ','), 'Organization') AS has_organization, list_contains(string_split(schema_types, ','), 'Product') AS has_product, list_contains(string_split(schema_types, ','), 'Article') AS has_article FROM site_pages"
QUERIES["export_report_facts"] = _simple(lambda s: XP.report_facts(s.table("site_pages")))
ORACLE["export_report_facts"] = "SELECT run_id, fact, value, count(*) AS pages FROM (SELECT run_id, unnest(['status_code', 'indexable', 'page_type']) AS fact, unnest([CAST(status_code AS VARCHAR), coalesce(CAST(indexable AS VARCHAR), 'unknown'), page_type]) AS value FROM site_pages) x GROUP BY 1, 2, 3"
QUERIES["export_findings_by_status"] = _simple(lambda s: XP.counts_by(s.table("site_findings"), "status", "priority"))
ORACLE["export_findings_by_status"] = "SELECT run_id, status, priority, count(*) AS findings FROM site_findings GROUP BY 1, 2, 3"


def _exports(s):
    pages = s.table("site_pages")
    first = pages.select("run_id", c("url").alias("address"), c("status_code").cast("string").alias("status_code"), c("title").alias("title_1"), c("meta_description").alias("meta_description_1"), c("schema_types").alias("schema_types"), F.concat(c("word_count_raw").cast("string"), F.lit("")).alias("word_count"), F.lit("internal_html").alias("export_type"), F.lit(0).alias("file_order"), c("page_id").alias("row_order"))
    second = pages.where("page_id % 2 = 0").select("run_id", c("url").alias("address"), F.lit("404").alias("status_code"), F.lit(" ").alias("title_1"), F.when(c("page_id") % 4 == 0, "Non-Indexable").otherwise("Indexable").alias("indexability"), F.lit("Extra|Article").alias("schema_type"), F.lit("response_codes").alias("export_type"), F.lit(1).alias("file_order"), c("page_id").alias("row_order"))
    return CE.page_records(CE.merge(CE.facts(first).unionByName(CE.facts(second), allowMissingColumns=True)))


QUERIES["import_merged_pages"] = _simple(lambda s: _exports(s).select("run_id", "url", "status_code", "indexable", "title", "word_count", F.array_join("schema_types", ",").alias("schema_types"), F.array_join("source_types", ",").alias("source_types")))
ORACLE["import_merged_pages"] = """SELECT run_id, u AS url, CASE WHEN e IS NOT NULL THEN 404 ELSE p.status_code END AS status_code, CASE WHEN e IS NOT NULL THEN CASE WHEN e % 4 = 0 THEN 0 ELSE 1 END WHEN p.status_code >= 400 THEN 0 ELSE 1 END AS indexable, p.title AS title, p.w AS word_count,
 array_to_string(list_sort(list_distinct(CASE WHEN e IS NOT NULL THEN list_concat(st, ['Article', 'Extra']) ELSE st END)), ',') AS schema_types, CASE WHEN e IS NOT NULL THEN 'internal_html,response_codes' ELSE 'internal_html' END AS source_types FROM (
 SELECT run_id, normalized_url AS u, max_by(page_id, page_id) FILTER (page_id % 2 = 0) AS e, max_by(struct_pack(status_code := status_code), page_id) AS s0, max_by(status_code, page_id) AS status_code0, max_by(trim(title), page_id) FILTER (trim(title) <> '') AS title, CAST(max_by(word_count_raw, page_id) AS INT) AS w,
   list_filter(list_distinct(flatten(list(string_split(schema_types, ',')))), lambda x: x <> '') AS st, max_by(status_code, page_id) AS sc FROM site_pages GROUP BY 1, 2) q, LATERAL (SELECT q.sc AS status_code, q.title AS title, q.w AS w) p"""


def crawler_files(s) -> str:
    """Three exports of the documents as quoted files with other delimiters each; whole texts with their line breaks and quotes are cells."""
    folder = f"{shared_folder(s.spark)}/sitewright/exports-{uuid.uuid4().hex}"
    docs = s.table("documents")
    address = F.concat(F.lit("https://import.example/doc/"), c("doc_id").cast("string"))
    status = F.when(c("doc_id") % 9 == 4, "404").otherwise("200")
    write = lambda name, sep, rows: rows.write.csv(f"{folder}/{name}", header=True, sep=sep, quoteAll=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    write("internal_html", ",", docs.select(
        address.alias("Address"), status.alias("Status Code"), c("source").alias("Title 1"), c("text").alias("Meta Description 1"), c("n_chars").cast("string").alias("Word Count"), c("lang").alias("Own; Remark")))
    write("page_titles", ";", docs.where("source IS NOT NULL").select(F.concat(F.lit("HTTPS://IMPORT.Example/doc/"), c("doc_id").cast("string")).alias("Address"), F.concat(c("source"), F.lit('\n"'), F.coalesce("lang", F.lit("?")), F.lit('"; ')).alias("Title 1"), F.lit("7").alias("Title 1 Length")))
    target = F.concat(F.lit("/doc/"), (c("doc_id") + 1).cast("string"))
    write("all_inlinks", "\t", docs.select(address.alias("Source"), F.concat(F.lit("https://import.example"), target).alias("Destination"), c("text").alias("Anchor Text"), F.lit("Hyperlink").alias("Type"), F.lit("true").alias("Follow")))
    return folder


def _imported(s):
    folder = crawler_files(s)
    return CE.import_exports(s.spark, [f"{folder}/{name}" for name in ("internal_html", "page_titles", "all_inlinks")], "import")


def _imported_pages(s):
    pages, links, _, _ = _imported(s)
    anchors = links.groupBy(c("source_url").alias("url")).agg(F.count(F.lit(1)).alias("links"), F.sum(F.length("anchor_text")).alias("anchor_chars"))
    return pages.join(anchors, "url", "left").select(
        "url", "status_code", "indexable", "title", F.sha2("meta_description", 256).alias("description_sha256"), F.length("meta_description").alias("description_length"), "word_count", F.array_join("source_types", ",").alias("source_types"),
        F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("anchor_chars", F.lit(0)).alias("anchor_chars"))


QUERIES["import_files"] = _simple(_imported_pages)
ORACLE["import_files"] = """
SELECT 'https://import.example/doc/' || doc_id AS url, CAST(CASE WHEN doc_id % 9 = 4 THEN 404 ELSE 200 END AS INT) AS status_code, CASE WHEN doc_id % 9 = 4 THEN 0 ELSE 1 END AS indexable,
  CASE WHEN source IS NOT NULL THEN trim(source || chr(10) || '"' || coalesce(lang, '?') || '"; ') END AS title, sha256(t) AS description_sha256, CAST(length(t) AS INT) AS description_length,
  CAST(coalesce(n_chars, 0) AS INT) AS word_count, CASE WHEN source IS NOT NULL THEN 'internal_html,page_titles' ELSE 'internal_html' END AS source_types, CAST(1 AS BIGINT) AS links, CAST(coalesce(length(t), 0) AS BIGINT) AS anchor_chars
FROM (SELECT *, nullif(trim(text), '') AS t FROM documents) d"""


def _import_columns(s):
    files = _imported(s)[3]
    return CE.column_report(files).select("export_type", "confidence", "header", "name", F.array_join("fields", ",").alias("fields")).distinct()


QUERIES["import_columns"] = _simple(_import_columns)
ORACLE["import_columns"] = """
SELECT * FROM (VALUES ('internal_html', 'high', 'Address', 'address', 'url,image_url'), ('internal_html', 'high', 'Status Code', 'status_code', 'status_code'), ('internal_html', 'high', 'Title 1', 'title_1', 'title'),
  ('internal_html', 'high', 'Meta Description 1', 'meta_description_1', 'meta_description'), ('internal_html', 'high', 'Word Count', 'word_count', 'word_count'), ('internal_html', 'high', 'Own; Remark', 'own_remark', ''),
  ('page_titles', 'high', 'Address', 'address', 'url,image_url'), ('page_titles', 'high', 'Title 1', 'title_1', 'title'), ('page_titles', 'high', 'Title 1 Length', 'title_1_length', ''),
  ('inlinks', 'high', 'Source', 'source', 'source,page_url'), ('inlinks', 'high', 'Destination', 'destination', 'destination'), ('inlinks', 'high', 'Anchor Text', 'anchor_text', 'anchor_text'),
  ('inlinks', 'high', 'Type', 'type', 'schema_types,link_type'), ('inlinks', 'high', 'Follow', 'follow', '')) v(export_type, confidence, header, name, fields) WHERE EXISTS (SELECT 1 FROM documents)"""


def _import_rows(s):
    rows = PF.from_import(_imported(s)[0])
    return PC.prepare(rows), rows.select("run_id", F.lit("import").alias("source_type"), F.lit(1).alias("store_headers"), F.lit(0).alias("use_browser")).distinct()


IMPORT_CHECKS = ("tech.title_missing", "tech.meta_description_missing", "tech.title_too_short", "tech.title_too_long", "tech.meta_description_too_long", "tech.h1_missing", "tech.html_lang_missing", "tech.4xx_pages", "tech.content_type_html_correct")


def _import_checks(s):
    rows, runs = _import_rows(s)
    checks = [check for check in (*PC.head_checks(), *PC.crawl_checks()) if check.id in IMPORT_CHECKS]
    return SU.import_aware(inputs.flat_results(evaluate_checks(rows, runs, checks)), runs).drop("evidence")


QUERIES["import_checks"] = _simple(_import_checks)
_IMPORTED = """(SELECT 'https://import.example/doc/' || doc_id AS url, doc_id % 9 <> 4 AS found, CASE WHEN source IS NOT NULL THEN trim(source || chr(10) || '"' || coalesce(lang, '?') || '"; ') END AS title, nullif(trim(text), '') AS description FROM documents)"""
_HITS = {
    "tech.title_missing": ("found AND coalesce(title, '') = ''", "Error"),
    "tech.meta_description_missing": ("found AND description IS NULL", "Warning"),
    "tech.title_too_short": ("found AND length(title) < 20", "Warning"),
    "tech.title_too_long": ("found AND length(title) > 65", "Warning"),
    "tech.meta_description_too_long": ("found AND length(description) > 165", "Warning"),
    "tech.h1_missing": ("found", "Warning"),
    "tech.html_lang_missing": ("found", "Warning"),
    "tech.4xx_pages": ("NOT found", "Warning"),
    "tech.content_type_html_correct": ("NOT found", "Warning"),
}
ORACLE["import_checks"] = " UNION ALL ".join(
    f"""SELECT 'import' AS run_id, '{check}' AS check_id, CASE WHEN count(*) FILTER ({hit}) > 0 THEN 'fail' ELSE 'pass' END AS evaluation_state, CASE WHEN count(*) FILTER ({hit}) > 0 THEN '{status}' ELSE 'OK' END AS status,
  count(*) FILTER ({hit}) AS affected_count, coalesce((SELECT string_agg(url, ' | ' ORDER BY url) FROM (SELECT url FROM {_IMPORTED} i WHERE {hit} ORDER BY url LIMIT 10) t), '') AS sample_urls FROM {_IMPORTED} i"""
    for check, (hit, status) in _HITS.items())
QUERIES["import_clusters"] = _simple(lambda s: TP.clusters(_import_rows(s)[0]).select("run_id", "cluster_key", "url_count", "indexable_count", F.element_at("status_codes", F.lit("200")).alias("ok")))
ORACLE["import_clusters"] = """SELECT 'import' AS run_id, 'other:/{category}/{id}' AS cluster_key, count(*) AS url_count, count(*) FILTER (doc_id % 9 <> 4) AS indexable_count, count(*) FILTER (doc_id % 9 <> 4) AS ok FROM documents"""
ORACLE = {name: with_views(text) for name, text in ORACLE.items()}
