"""Queries over document extraction and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewright.catalog import inputs
from sitewright.catalog.site_views import Site, with_views
from sitewright.functions import http as HT
from sitewright.functions import misc as MI
from sitewright.functions import page_type as PT
from sitewright.functions import text as TX
from sitewright.functions import url as U
from sitewright.operators import comparison as CP
from sitewright.operators import extraction as EX
from sitewright.operators import page_checks as PC
from sitewright.operators import page_facts as PF
from sitewright.operators import structured_data as SD
from sitewright.operators import suffixes as SX
from sitewright.operators.percentiles import percentiles
from sitewright.operators.predicates import evaluate_checks
from sitewright.session import stored
from sitewright.sources import retention as RT

QUERIES = {}
ORACLE = {}
c = F.col


def _simple(build):
    return lambda spark, folder: build(Site(spark, folder))


def _docs(s):
    return s.table("html_pages")


HOST = "lower(regexp_extract(url, '^https?://([^/?#]+)', 1))"
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
NORMAL = "regexp_replace(regexp_replace(regexp_replace({0}, '#.*$', ''), '[?]utm_source=feed$', ''), '/$', '')".format
QUERIES["extract_head"] = _simple(lambda s: EX.pages(_docs(s)).select(
    "page_id", "title", "title_length", "title_elements", "meta_description", "meta_robots", "meta_charset", "html_lang", F.array_join("canonicals", " ").alias("canonicals"), "favicon", F.array_join("h1", "|").alias("h1"), "h1_count", "indexable",
    F.try_element_at("og", F.lit("og:title")).alias("og_title"), F.size("hreflang").alias("hreflang_count"), "nav_regions", "article_regions", "lists", "preloads"))
PLAINTEXT = "replace(replace({0}, '&amp;', '&'), '  ', ' ')".format
ORACLE["extract_head"] = f"""SELECT page_id, {PLAINTEXT('t')} AS title, CAST(length({PLAINTEXT('t')}) AS INT) AS title_length, 1 AS title_elements, CASE WHEN page_id % 3 <> 0 THEN 'A short description' END AS meta_description, CASE WHEN page_id % 5 = 0 THEN 'noindex,follow' END AS meta_robots, 'utf-8' AS meta_charset,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS html_lang, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN {NORMAL('url')} ELSE {ORIGIN} || '/canonical' END AS canonicals, '/favicon.ico' AS favicon, trim({PLAINTEXT('h')}) AS h1, 1 AS h1_count, page_id % 5 <> 0 AS indexable, 'OG ' || page_id AS og_title, 1 AS hreflang_count,
  1 AS nav_regions, CAST((length(html) - length(replace(html, '<article', ''))) / 8 AS INT) AS article_regions, CAST((length(html) - length(replace(html, '<ul', ''))) / 3 + (length(html) - length(replace(html, '<ol', ''))) / 3 AS INT) AS lists, 1 AS preloads
 FROM (SELECT *, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS h FROM html_pages) x"""
QUERIES["extract_text_facts"] = _simple(lambda s: EX.pages(_docs(s)).select("page_id", "word_count", "main_word_count", "raw_text_length", "visible_text_length", "visible_text_hash", "raw_text_hash", "page_type", "page_type_reason", "heading_skips", "has_faq", "has_weak_faq", "low_structure", "price_marks", "sku_marks"))
QUERIES["extract_links"] = _simple(lambda s: EX.links(_docs(s)).groupBy("page_id", "link_type").agg(F.count(F.lit(1)).alias("links"), F.count_if(c("rel") == "nofollow").alias("nofollow"), F.max(F.when(c("link_type") == "external", c("normalized_target_url"))).alias("external_target")))
ORACLE["extract_links"] = """SELECT page_id, link_type, count(*) AS links, count_if(link_type = 'external') AS nofollow, max(CASE WHEN link_type = 'external' THEN 'https://social.test/x?a=1&b=2' END) AS external_target FROM (SELECT page_id, CASE WHEN h LIKE 'https://social%' THEN 'external' ELSE 'internal' END AS link_type FROM
 (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS h FROM html_pages) x) y GROUP BY 1, 2"""
QUERIES["extract_images"] = _simple(lambda s: EX.images(_docs(s)).drop("page_url"))
ORACLE["extract_images"] = f"""SELECT page_id, {ORIGIN} || '/img/hero-' || page_id || '.jpg' AS image_url, '.jpg' AS extension, true AS alt_present, 'Hero' AS alt_value, '800' AS width, '400' AS height, NULL AS loading, false AS decorative, false AS badge, false AS pixel, false AS icon, 'hero' AS image_role FROM html_pages
 UNION ALL SELECT page_id, {ORIGIN} || '/img/pixel.gif', '.gif', false, NULL, '1', '1', NULL, true, false, true, false, 'tracking_pixel' FROM html_pages UNION ALL SELECT page_id, {ORIGIN} || '/img/photo.webp', '.webp', true, '', NULL, NULL, 'lazy', false, false, false, false, CASE WHEN url LIKE '%hero%' THEN 'hero' ELSE 'content' END FROM html_pages"""
QUERIES["extract_resources"] = _simple(lambda s: EX.resources(_docs(s)).select("page_id", "resource_url", "resource_type", "third_party"))
ORACLE["extract_resources"] = f"""SELECT page_id, u AS resource_url, t AS resource_type, t = 'script' AS third_party FROM (SELECT page_id, unnest(['https://cdn.vendor.test/gtag/js?id=1', {ORIGIN} || '/style.css', {ORIGIN} || '/img/hero-' || page_id || '.jpg', {ORIGIN} || '/img/pixel.gif', {ORIGIN} || '/img/photo.webp', {ORIGIN} || '/f.woff2']) AS u, unnest(['script', 'stylesheet', 'image', 'image', 'image', 'font']) AS t FROM html_pages) x"""
QUERIES["extract_json_ld"] = _simple(lambda s: SD.entities(EX.json_ld_blocks(_docs(s))).select("page_id", "block_index", "parse_status", "schema_type", "entity_path", "entity_id", F.array_join("properties", ",").alias("properties"), F.array_join("referenced_ids", ",").alias("referenced_ids"), "entity_linked"))
ORACLE["extract_json_ld"] = """SELECT page_id, 0 AS block_index, s AS parse_status, t AS schema_type, p AS entity_path, i AS entity_id, pr AS properties, rf AS referenced_ids, lk AS entity_linked FROM html_pages JOIN (
 SELECT 0 AS k, 'ok' AS s, 'Article' AS t, '$.@graph[0]' AS p, '#a' AS i, 'author' AS pr, '#p' AS rf, true AS lk UNION ALL SELECT 0, 'ok', 'Person', '$.@graph[1]', '#p', 'name', '', false UNION ALL SELECT 0, 'ok', 'Thing', '$.@graph[1]', '#p', 'name', '', false
 UNION ALL SELECT 1, 'error', NULL, NULL, NULL, '', '', false UNION ALL SELECT 2, 'empty', NULL, NULL, NULL, '', '', false UNION ALL SELECT 3, 'ok', 'Organization', '$', NULL, 'name,sameAs', '', false) v ON v.k = page_id % 6"""
QUERIES["extract_head_by_expression"] = _simple(lambda s: EX.head_by_expression(s.table("pages").select("page_id", "url", "html")).drop("url"))
ORACLE["extract_head_by_expression"] = """SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[[:space:]]+', ' ', 'g')), '') AS title, nullif(trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '[[:space:]]+', ' ', 'g')), '') AS h1, regexp_extract(html, '<html lang="([^"]*)"', 1) AS html_lang, true AS meta_utf8,
 CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INT) AS link_count, CAST(strlen(html) AS INT) AS html_bytes, sha256(html) AS html_hash FROM pages"""
QUERIES["extract_targeted_facts"] = _simple(lambda s: EX.targeted_facts(s.table("pages"), "title").unionByName(EX.targeted_facts(s.table("pages"), "html_lang")).select("page_id", "job_type", "value_length", "value_hash", "value_pattern", "missing"))
PATTERN = "trim(regexp_replace(regexp_replace(regexp_replace(lower(v), '[0-9]+', '{{num}}', 'g'), '[a-f0-9]{{8,}}', '{{hash}}', 'g'), '[^\\p{{L}}\\p{{N}}{{}}]+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")
TF = f"""SELECT page_id, job AS job_type, CAST(length(v) AS INT) AS value_length, left(sha1(v), 16) AS value_hash, {PATTERN} AS value_pattern, v IS NULL AS missing FROM (SELECT page_id, 'title' AS job, nullif(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[[:space:]]+', ' ', 'g')), '') AS v FROM pages UNION ALL SELECT page_id, 'html_lang', regexp_extract(html, '<html lang="([^"]*)"', 1) FROM pages) x"""
ORACLE["extract_targeted_facts"] = TF


def _fact_groups(s):
    facts = EX.targeted_facts(s.table("pages"), "title").unionByName(EX.targeted_facts(s.table("pages"), "html_lang"))
    totals, groups, patterns = EX.fact_summary(facts)
    part = lambda df, kind, key, n: df.select("job_type", F.lit(kind).alias("kind"), key.alias("key"), n.cast("bigint").alias("urls"))
    return part(totals, "checked", F.lit(""), c("checked")).unionByName(part(totals, "short", F.lit(""), c("short"))).unionByName(part(groups, "duplicate", c("value_hash"), c("urls"))).unionByName(part(patterns, "pattern", c("value_pattern"), c("urls")))


QUERIES["extract_fact_summary"] = _simple(_fact_groups)
ORACLE["extract_fact_summary"] = f"""WITH f AS ({TF}) SELECT job_type, 'checked' AS kind, '' AS key, count(*) AS urls FROM f GROUP BY 1 UNION ALL SELECT job_type, 'short', '', count_if(value_length < 20) FROM f GROUP BY 1 UNION ALL SELECT job_type, 'duplicate', value_hash, count(*) FROM f GROUP BY job_type, value_hash HAVING count(*) > 1
 UNION ALL SELECT job_type, 'pattern', value_pattern, n FROM (SELECT job_type, value_pattern, count(*) AS n, row_number() OVER (PARTITION BY job_type ORDER BY count(*) DESC, value_pattern) AS rn FROM f GROUP BY 1, 2) p WHERE rn <= 20"""
QUERIES["extract_consent_signals"] = _simple(lambda s: _docs(s).select("page_id", EX.consent_signals(c("html")).alias("s")).select("page_id", F.array_join("s.vendors", ",").alias("vendors"), F.array_join("s.tags", ",").alias("tags"), c("s.data_layer").alias("data_layer")))
ORACLE["extract_consent_signals"] = "SELECT page_id, concat_ws(',', CASE WHEN regexp_matches(lower(html), 'onetrust') THEN 'onetrust' END, CASE WHEN regexp_matches(lower(html), 'cookiebot|cookieconsent') THEN 'cookiebot' END) AS vendors, concat_ws(',', CASE WHEN regexp_matches(lower(html), 'gtm-[a-z0-9]+') THEN 'google_tag_manager' END, CASE WHEN regexp_matches(lower(html), 'gtag[(]|googletagmanager[.]com/gtag/js') THEN 'gtag' END) AS tags, lower(html) LIKE '%datalayer%' AS data_layer FROM html_pages"
QUERIES["extract_snapshots"] = _simple(lambda s: s.table("pages").select("page_id", EX.snapshot_cap(c("html"), 1000).alias("s")).select("page_id", "s.bytes", "s.truncated", (F.octet_length("s.html") >= F.least(c("s.bytes"), F.lit(997))).alias("kept")))
ORACLE["extract_snapshots"] = "SELECT page_id, CAST(strlen(html) AS INT) AS bytes, strlen(html) > 1000 AS truncated, true AS kept FROM pages"

# --- scalar functions
QUERIES["fn_url_normalize"] = _simple(lambda s: s.table("pages").select("page_id", U.normalize(c("url")).alias("identity"), U.normalize(c("url"), keep_trailing_slash=True).alias("request"), U.canonical_comparable(c("url")).alias("comparable"), U.normalize(F.lit("../a/./b//c/?z=1&utm_medium=x&a=2#f"), c("url")).alias("resolved"), U.normalize(F.lit("mailto:x@y"), c("url")).alias("other_scheme")))
DIR = "regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '[^/]*$', '')"
ORACLE["fn_url_normalize"] = f"""SELECT page_id, {NORMAL('url')} AS identity, regexp_replace(regexp_replace(url, '#.*$', ''), '[?]utm_source=feed$', '') AS request, {NORMAL('url')} AS comparable, {ORIGIN} || regexp_replace({DIR}, '[^/]+/$', '') || 'a/b/c?a=2&z=1' AS resolved, NULL AS other_scheme FROM pages"""
QUERIES["fn_url_parts"] = _simple(lambda s: s.table("raw_pages").select("page_id", U.host(c("url")).alias("host"), U.origin(c("url")).alias("origin"), U.extension(c("url")).alias("extension"), U.resource_type(c("url")).alias("resource_type"), U.is_likely_page(c("url")).alias("likely_page"), U.registrable_domain(U.host(c("url"))).alias("apex"), U.host_relation(U.host(c("url")), F.lit("www.example.com")).alias("relation"), U.shard(c("url"), 8).between(0, 7).alias("shard_ok")))
ORACLE["fn_url_parts"] = f"""SELECT page_id, {HOST} AS host, lower({ORIGIN}) AS origin, CASE WHEN regexp_extract(url, '^[^?#]*', 0) LIKE '%.html' THEN '.html' ELSE '' END AS extension, 'other' AS resource_type, true AS likely_page, regexp_extract({HOST}, '([^.]+[.][^.]+)$', 1) AS apex,
 CASE WHEN {HOST} = 'www.example.com' THEN 'same' WHEN {HOST} = 'example.com' THEN 'www_variant' WHEN {HOST} LIKE '%.example.com' THEN 'subdomain' ELSE 'different_registrable_domain' END AS relation, true AS shard_ok FROM raw_pages"""
QUERIES["fn_url_shards"] = _simple(lambda s: s.table("raw_pages").select("page_id", U.shard(c("url"), 16).alias("shard")))
KEY = f"{HOST} || '/' || lower(regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1))"
ORACLE["fn_url_shards"] = f"SELECT page_id, CAST(list_reduce(list_transform(string_split({KEY}, ''), lambda ch: CAST(ascii(ch) AS HUGEINT)), lambda a, b: ((xor(CAST(a AS BIGINT), CAST(b AS BIGINT)))::HUGEINT * 16777619) % 4294967296, 2166136261::HUGEINT) % 16 AS INT) AS shard FROM raw_pages"
QUERIES["fn_text_documents"] = _simple(lambda s: s.table("documents").select("doc_id", F.size(TX.tokens(c("text"))).alias("tokens"), TX.short_hash(c("text")).alias("short_hash")))
ORACLE["fn_text_documents"] = "SELECT doc_id, CAST(len(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9äöüß]+', ' ', 'g'), ' '), lambda w: length(w) >= 3))) AS INT) AS tokens, left(sha1(trim(text)), 16) AS short_hash FROM documents"
QUERIES["fn_visible_words"] = _simple(lambda s: s.table("documents").select("doc_id", TX.visible_words(c("text")).alias("words")))
ORACLE["fn_visible_words"] = r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}''-]*[\p{L}\p{N}][\p{L}\p{N}''-]*')) AS BIGINT) AS words FROM documents"
QUERIES["fn_scope_factor"] = _simple(lambda s: s.table("site_findings").select("finding_id", MI.scope_factor(c("affected_count"), c("scope_type")).alias("factor"), MI.root_cause_id(c("check_id")).alias("cause")))
ORACLE["fn_scope_factor"] = "SELECT finding_id, floor(least(2.0, least(1.75, 1 + log10(greatest(1, affected_count)) * 0.25) * CASE coalesce(scope_type, 'unknown') WHEN 'template' THEN 1.15 WHEN 'sitewide' THEN 1.25 ELSE 1.0 END) * 10000 + 0.5) / 10000 AS factor, 'rc_' || left(sha256(check_id), 16) AS cause FROM site_findings"
QUERIES["fn_hreflang_codes"] = _simple(lambda s: inputs.pages(s).select("page_id", F.explode("hreflang").alias("code")).select("page_id", "code", MI.hreflang_code(c("code")).alias("h")).select("page_id", "code", "h.language", "h.region", "h.is_default", "h.invalid"))
ORACLE["fn_hreflang_codes"] = "SELECT page_id, code, CASE WHEN code = 'x-default' THEN 'x-default' ELSE code END AS language, NULL AS region, code = 'x-default' AS is_default, false AS invalid FROM (SELECT page_id, unnest(string_split(hreflang, ',')) AS code FROM site_pages WHERE hreflang <> '') x"
QUERIES["fn_imported_values"] = _simple(lambda s: s.table("site_lab").select("page_id", "device", MI.imported_number(F.concat(F.floor(c("lcp_ms")).cast("string"), F.when(c("page_id") % 5 == 0, F.lit(",000,5 ms")).otherwise(F.lit(",5 %")))).alias("imported_number"), MI.imported_score(c("performance_score") * 100).alias("score"), MI.imported_flag(F.when(c("cls") > 0.2, "Indexable").otherwise("nein")).alias("flag")))
ORACLE["fn_imported_values"] = "SELECT page_id, device, CASE WHEN page_id % 5 <> 0 THEN floor(lcp_ms) + 0.5 WHEN lcp_ms IS NOT NULL THEN floor(lcp_ms) + 0.0005 END AS imported_number, CASE WHEN performance_score * 100 > 1 THEN round(performance_score * 100 / 100, 3) ELSE performance_score * 100 END AS score, cls > 0.2 AS flag FROM site_lab"
QUERIES["fn_bytes_and_risk"] = _simple(lambda s: s.table("site_resources").select("resource_id", MI.human_bytes(c("size_bytes")).alias("label"), MI.size_risk(c("size_bytes") * 1000).alias("risk")))
ORACLE["fn_bytes_and_risk"] = "SELECT resource_id, CASE WHEN size_bytes IS NULL THEN NULL WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f KB', floor(size_bytes / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(size_bytes / 1048576.0::DOUBLE * 10 + 0.5) / 10) END AS label, CASE WHEN size_bytes * 1000 > 10737418240 THEN 'high' WHEN size_bytes * 1000 > 1073741824 THEN 'medium' ELSE 'low' END AS risk FROM site_resources"
QUERIES["fn_url_patterns"] = _simple(lambda s: s.table("raw_pages").select("page_id", MI.url_filter(c("url"), include=("/blog/", "/^https.*[.]html/i", "suche"), exclude=("page=2",)).alias("verdict")))
ORACLE["fn_url_patterns"] = "SELECT page_id, CASE WHEN lower(url) LIKE '%page=2%' THEN 'excluded' WHEN lower(url) LIKE '%/blog/%' OR regexp_matches(lower(url), '^https.*[.]html') OR lower(url) LIKE '%suche%' THEN 'included' ELSE 'not_included' END AS verdict FROM raw_pages"
QUERIES["fn_attempt_stability"] = _simple(lambda s: s.table("site_pages").select("page_id", HT.stability(HT.parse_attempts(c("attempt_statuses"))).alias("stability"), F.array_join(HT.robots_directives(c("meta_robots")), ",").alias("directives")))
ORACLE["fn_attempt_stability"] = "SELECT page_id, CASE attempt_statuses WHEN '500,500' THEN 'confirmed' WHEN '503,200' THEN 'transient' WHEN '503' THEN 'insufficient_evidence' WHEN '429' THEN 'insufficient_evidence' WHEN 'timeout,200' THEN 'transient' ELSE 'confirmed' END AS stability, coalesce(replace(meta_robots, ', ', ','), '') AS directives FROM site_pages"
QUERIES["fn_page_type"] = _simple(lambda s: s.table("raw_pages").select("page_id", PT.classify(c("url")).alias("k")).select("page_id", "k.page_type", "k.confidence"))
FIRST = "lower(regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1))"
YEAR = "regexp_matches(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '(^|/)[0-9]{4}(/|$)')"
ORACLE["fn_page_type"] = f"""SELECT page_id, pt AS page_type, CASE WHEN pt = 'product' THEN 'medium' WHEN pt IN ('legal', 'contact', 'category_index', 'article_index') OR f IN ('c', 'kategorie') THEN 'high' WHEN pt IN ('location', 'category') THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT page_id, {FIRST} AS f,
 CASE WHEN {FIRST} = 'impressum' THEN 'legal' WHEN {FIRST} = 'kontakt' THEN 'contact' WHEN {FIRST} IN ('c', 'kategorie') THEN 'category' WHEN {YEAR} AND {FIRST} = 'blog' THEN 'blog_index' WHEN {YEAR} AND {FIRST} = 'tag' THEN 'category_index' WHEN {YEAR} THEN 'article_index' WHEN {FIRST} = 'p' THEN 'product' WHEN {FIRST} IN ('store', 'standorte') THEN 'location' WHEN {FIRST} IN ('shop', 'produkte') THEN 'category' ELSE 'other' END AS pt FROM raw_pages) x"""
QUERIES["fn_schedule_due"] = _simple(lambda s: s.table("site_runs").select("run_id", "schedule_id", MI.next_due(F.timestamp_seconds(F.lit(1706700000) + c("schedule_id") * 86400), F.when(c("schedule_id") % 3 == 0, "daily").when(c("schedule_id") % 3 == 1, "weekly").otherwise("monthly"), F.lit(1)).cast("bigint").alias("next_due")))
ORACLE["fn_schedule_due"] = "SELECT run_id, schedule_id, CAST(epoch(CASE schedule_id % 3 WHEN 0 THEN t + INTERVAL 1 DAY WHEN 1 THEN t + INTERVAL 7 DAY ELSE t + INTERVAL 1 MONTH END) AS BIGINT) AS next_due FROM (SELECT *, TIMESTAMP '1970-01-01' + to_seconds(1706700000 + schedule_id * 86400) AS t FROM site_runs) x"
QUERIES["fn_event_json"] = _simple(lambda s: s.table("events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(-1)).alias("k"), F.try_parse_json("props").isNotNull().alias("valid")))
ORACLE["fn_event_json"] = "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), -1) AS k, json_valid(props) AS valid FROM events"
SHARES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
QUERIES["fn_percentiles"] = _simple(lambda s: percentiles(s.table("events"), ["event_type"], {name: (c("value"), share) for name, share in SHARES.items()}).select("event_type", *[F.round(name, 4).alias(name) for name in SHARES]))
ORACLE["fn_percentiles"] = "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1"

QUERIES["fn_json_summary"] = _simple(lambda s: s.table("events").select("event_id", CP.evidence_summary(F.concat(F.lit('{"list":[1,{"a":2}],"none":{},"props":'), c("props"), F.lit(',"text":"x"}'))).alias("summary")))
ORACLE["fn_json_summary"] = "SELECT event_id, concat('list=#2;none=#0;props=#', CAST(len(json_keys(props)) AS VARCHAR), ';text=x') AS summary FROM events"



def _from_html(s):
    """One parse of all documents; every fact that the checks read comes out of it."""
    facts = stored(EX.tokenize(s.table("article_pages")))
    types = SD.entities(EX.json_ld_blocks(facts)).select("page_id", "schema_type")
    return stored(PF.from_html(EX.pages(facts), EX.links(facts), types))


QUERIES["extract_evidence"] = _simple(lambda s: EX.pages(s.table("article_pages")).select(
    "page_id", "has_date", F.array_join("dates", "|").alias("dates"), "date_evidence", "has_author", F.array_join("bylines", "|").alias("bylines"), "author_evidence", "videos", F.array_join("source_targets", " ").alias("source_targets")))
ORACLE["extract_evidence"] = """
SELECT page_id, page_id % 5 IN (1, 2) AS has_date, CASE page_id % 5 WHEN 1 THEN 'Am 3. M\u00e4rz 2024' WHEN 2 THEN '2024-01-05' WHEN 4 THEN 'yesterday' ELSE '' END AS dates, CASE WHEN page_id % 5 IN (1, 2) THEN 'markup' END AS date_evidence,
  page_id % 7 IN (2, 3) AS has_author, CASE page_id % 7 WHEN 2 THEN 'Ann Author' WHEN 3 THEN 'Jo' ELSE '' END AS bylines, CASE WHEN page_id % 7 IN (2, 3) THEN 'markup' WHEN page_id % 6 = 0 THEN 'json_ld' END AS author_evidence,
  CAST(CASE WHEN page_id % 9 IN (4, 5) THEN 1 ELSE 0 END AS INT) AS videos, CASE page_id % 3 WHEN 1 THEN 'https://journal.test/p' WHEN 2 THEN 'https://a.test/1' ELSE '' END AS source_targets FROM article_pages"""


def _html_checks(s):
    checks = [*PC.head_checks(), *PC.structured_data_page_checks(), *PC.content_signal_checks()]
    rows = PC.prepare(_from_html(s))
    return inputs.flat_results(evaluate_checks(rows, rows.select("run_id").distinct(), checks)).where(c("check_id").isin(*_HTML_ORACLE))


#: The same facts read from the markup with patterns.
_FACTS = """(SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS run_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, page_id % 5 <> 0 AND strpos(url, '/impressum/') = 0 AS open,
  strpos(html, 'name="description"') > 0 AS described, regexp_matches(html, '<video|<iframe src="https://www.youtube') AS video, regexp_matches(url, '/(blog|news|artikel|ratgeber|wissen)/') AS article,
  regexp_matches(html, '"publish-date">Am 3|<time datetime') AS dated, regexp_matches(html, 'alt="Ann Author"|rel="author"') AS signed, regexp_matches(html, 'journal[.]test|footnotes') AS sourced FROM article_pages)"""


def _html_result(check_id, scope, hit, fails=None):
    """A result row for each run, with at most ten sample addresses."""
    state = f"CASE WHEN count(*) FILTER ({scope}) = 0 THEN 'not_applicable' WHEN {fails or f'count(*) FILTER ({hit}) > 0'} THEN 'fail' ELSE 'pass' END"
    return f"""SELECT r.run_id, '{check_id}' AS check_id, evaluation_state, CASE evaluation_state WHEN 'fail' THEN 'Warning' WHEN 'pass' THEN 'OK' ELSE 'NA' END AS status,
  CASE WHEN evaluation_state = 'fail' THEN hits ELSE 0 END AS affected_count, '' AS evidence, CASE WHEN evaluation_state = 'fail' THEN sample_urls ELSE '' END AS sample_urls
  FROM (SELECT run_id, {state} AS evaluation_state, count(*) FILTER ({hit}) AS hits FROM {_FACTS} f GROUP BY run_id) r
  LEFT JOIN (SELECT run_id, string_agg(url, ' | ' ORDER BY url) AS sample_urls FROM (SELECT DISTINCT run_id, url, dense_rank() OVER (PARTITION BY run_id ORDER BY url) AS k FROM {_FACTS} f WHERE {hit}) t WHERE k <= 10 GROUP BY run_id) t ON t.run_id = r.run_id"""


_HTML_ORACLE = {
    "tech.title_too_short": _html_result("tech.title_too_short", "true", "open AND length(trim(regexp_replace(replace(title, '&amp;', '&'), '[ ]+', ' ', 'g'))) BETWEEN 1 AND 19"),
    "tech.meta_description_missing": _html_result("tech.meta_description_missing", "open", "open AND NOT described"),
    "tech.viewport_missing": _html_result("tech.viewport_missing", "true", "true"),
    "tech.videoobject_schema_present_missing": _html_result("tech.videoobject_schema_present_missing", "video", "video"),
    "geo.visible_dates_present": _html_result("geo.visible_dates_present", "article", "article AND NOT dated"),
    "geo.author_hints_present": _html_result("geo.author_hints_present", "article", "article AND NOT signed"),
    "geo.source_or_external_links_present": _html_result("geo.source_or_external_links_present", "article", "article AND NOT sourced", fails="count(*) FILTER (article AND sourced) = 0"),
}
QUERIES["html_checks"] = _simple(_html_checks)
ORACLE["html_checks"] = " UNION ALL ".join(_HTML_ORACLE.values())


def _suffix_rules(s):
    """Rules of all three kinds from the hosts at hand: their last labels, a wildcard below half of the apexes, and exceptions for hosts that begin with www."""
    hosts = s.table("article_pages").select(U.host(c("url")).alias("host")).distinct().withColumn("apex", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    kinds = {
        "plain": hosts.select(F.regexp_extract("host", r"([^.]+)$", 1).alias("value")),
        "wild": hosts.where("apex LIKE 'example.%'").select(F.concat(F.lit("*."), c("apex")).alias("value")),
        "except": hosts.where("host LIKE 'www.%'").select(F.concat(F.lit("!"), F.regexp_replace("host", r"^www\.", "")).alias("value")),
    }
    return SX.rule_table(kinds["plain"].unionByName(kinds["wild"]).unionByName(kinds["except"]).distinct())


QUERIES["url_registrable"] = _simple(lambda s: SX.with_apex(s.table("article_pages").select("page_id", U.host(c("url")).alias("host")), _suffix_rules(s)))
ORACLE["url_registrable"] = f"""
WITH hosts AS (SELECT DISTINCT {HOST} AS host FROM article_pages), open AS (SELECT DISTINCT regexp_replace(host, '^www[.]', '') AS host FROM hosts WHERE host LIKE 'www.%'),
apexes AS (SELECT DISTINCT regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS apex FROM hosts)
SELECT page_id, h AS host, CASE WHEN x THEN regexp_replace(o, '^[^.]+[.]', '') WHEN below THEN regexp_extract(h, '([^.]+[.][^.]+[.][^.]+)$', 1) ELSE regexp_extract(h, '([^.]+)$', 1) END AS suffix,
  CASE WHEN x THEN o WHEN below AND strpos(regexp_replace(h, '[.][^.]+[.][^.]+$', ''), '.') > 0 THEN regexp_extract(h, '([^.]+[.][^.]+[.][^.]+[.][^.]+)$', 1) WHEN below THEN NULL ELSE regexp_extract(h, '([^.]+[.][^.]+)$', 1) END AS apex
FROM (SELECT page_id, h, (SELECT max(host) FROM open WHERE h = host OR suffix(h, '.' || host)) AS o, (SELECT max(host) FROM open WHERE h = host OR suffix(h, '.' || host)) IS NOT NULL AS x,
  EXISTS (SELECT 1 FROM apexes WHERE apex LIKE 'example.%' AND suffix(h, '.' || apex)) AS below FROM (SELECT page_id, {HOST} AS h FROM article_pages) p) q"""


def _evidence(s):
    """Evidence of whole texts, their words and a trace, cut to a policy."""
    found = F.to_json(F.struct("text", F.split("text", " ").alias("words"), F.struct(c("text").alias("stack")).alias("trace")))
    rows = U.computed_once(s.table("documents"), {"kept": RT.pruned_evidence(found, RT.Policy(text=500, error_text=200, json_bytes=1_000_000))})
    part = lambda path: F.get_json_object("kept.value", path)
    return rows.select("doc_id", F.length(part("$.text")).alias("text_length"), F.json_array_length(part("$.words")).alias("words"), F.length(part("$.trace.stack")).alias("trace_length"), c("kept.truncated").alias("truncated"))


QUERIES["evidence_pruned"] = _simple(_evidence)
_CUT = "CAST(CASE WHEN length(text) <= {0} THEN length(text) ELSE {0} - 32 + length('... [truncated ' || (length(text) - {0} + 32) || ' chars]') END AS INT)".format
ORACLE["evidence_pruned"] = f"""
SELECT doc_id, {_CUT(500)} AS text_length, CAST(least(20, len(string_split(text, ' '))) AS INT) AS words, {_CUT(200)} AS trace_length, coalesce(length(text) > 200 OR len(string_split(text, ' ')) > 20, false) AS truncated FROM documents"""
ORACLE = {name: with_views(text) for name, text in ORACLE.items()}
