"""Queries over links, resources, images and timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewright.catalog import inputs
from sitewright.catalog.oracle import COMPLETE, CONTENT, HTML, check, failed, issue, state_case, union
from sitewright.catalog.page_queries import STABLE
from sitewright.catalog.site_views import Site, with_views
from sitewright.operators import details as DT
from sitewright.operators import frontier as FR
from sitewright.operators import links as L
from sitewright.operators import page_checks as PC
from sitewright.operators import resources as R
from sitewright.operators.predicates import evaluate_all

QUERIES = {}
ORACLE = {}
NF, IE, NE, FAIL, TE = "not_applicable", "insufficient_evidence", "not_executed", "fail", "technical_error"

DISCOVERY = """SELECT run_id, CAST(count(*) AS BIGINT) AS planned, CAST(CASE WHEN count(*) % 4 = 3 THEN 0 ELSE 1 END AS INT) AS discovery_complete
  FROM site_queue WHERE source_type IN ('sitemap', 'robots_sitemap') AND status = 'done' GROUP BY run_id"""


def discovery(site: Site):
    site.table("site_queue").createOrReplaceTempView("site_queue")
    return site.spark.sql(DISCOVERY)


def _simple(build):
    return lambda spark, folder: build(Site(spark, folder))


QUERIES["links_to_status"] = _simple(lambda s: L.status_checks(s.table("site_links"), inputs.pages(s), s.table("site_queue"), s.table("site_runs")))
NOT_PAGE = "regexp_matches(lower(normalized_target_url), '[.](pdf|doc|docx|xls|xlsx|ppt|pptx|zip|rar|7z|gz|tar|jpg|jpeg|png|gif|webp|avif|svg|mp4|mov|avi|wmv|mp3|wav|ogg|css|js|json|xml|txt|woff|woff2|ttf|eot)$')"
LINK_ROWS = f"""SELECT l.run_id, l.normalized_target_url, p.status_code, p.initial_status_code, {STABLE} AS stable, q.status AS queue_status
  FROM site_links l LEFT JOIN site_pages p ON p.run_id = l.run_id AND p.normalized_url = l.normalized_target_url
  LEFT JOIN site_queue q ON q.run_id = l.run_id AND q.normalized_url = l.normalized_target_url
  WHERE l.link_type = 'internal' AND NOT {NOT_PAGE}"""
ERR = "(status_code >= 400 AND status_code < 600 AND status_code NOT IN (408, 429) AND (status_code < 500 OR stable = 'confirmed'))"
ERR_OPEN = "(status_code IS NULL OR status_code IN (408, 429) OR (status_code >= 500 AND stable <> 'confirmed'))"


def _link_sql(check_id, hit, open_, status, priority):
    return f"""SELECT r.run_id, '{check_id}' AS check_id, st AS evaluation_state, CASE st WHEN 'pass' THEN 'OK' WHEN 'fail' THEN '{status}' ELSE 'NA' END AS status,
      {priority} AS priority, CAST(CASE WHEN st = 'fail' THEN hits ELSE 0 END AS BIGINT) AS affected_count, CAST(CASE WHEN st = 'fail' THEN targets ELSE 0 END AS BIGINT) AS unique_targets
    FROM (SELECT s.run_id, coalesce(hits, 0) AS hits, coalesce(targets, 0) AS targets,
      CASE WHEN store_all_links = 0 THEN 'not_executed' WHEN coalesce(hits, 0) > 0 THEN 'fail' WHEN coalesce(opens, 0) > 0 AND coalesce(fails, 0) > 0 THEN 'technical_error' WHEN coalesce(opens, 0) > 0 THEN 'insufficient_evidence' ELSE 'pass' END AS st
      FROM site_runs s LEFT JOIN (SELECT run_id, count_if({hit}) AS hits, count(DISTINCT CASE WHEN {hit} THEN normalized_target_url END) AS targets, count_if({open_}) AS opens, count_if({open_} AND queue_status = 'failed') AS fails
        FROM ({LINK_ROWS}) x GROUP BY run_id) a ON a.run_id = s.run_id) r"""


ORACLE["links_to_status"] = union([
    _link_sql("tech.internal_links_to_3xx", "initial_status_code BETWEEN 300 AND 399", "initial_status_code IS NULL", "Warning", "'Medium'"),
    _link_sql("tech.internal_links_to_4xx_5xx", ERR, ERR_OPEN, "Error", "CASE WHEN hits > 0 AND targets < 3 AND hits < 10 THEN 'Medium' ELSE 'High' END"),
])

QUERIES["links_orphan_pages"] = _simple(lambda s: L.orphan_pages(inputs.pages(s), s.table("site_queue"), s.table("site_links")).select("run_id", "page_id", "url"))
ORACLE["links_orphan_pages"] = """SELECT p.run_id, p.page_id, p.url FROM site_pages p JOIN site_queue q ON q.run_id = p.run_id AND q.normalized_url = p.normalized_url
  LEFT JOIN site_links l ON l.run_id = p.run_id AND l.normalized_target_url = p.normalized_url AND l.link_type = 'internal'
  WHERE q.source_type IN ('sitemap', 'robots_sitemap') AND l.run_id IS NULL"""

QUERIES["checks_orphans"] = _simple(lambda s: inputs.flat_results(L.orphan_check(inputs.pages(s), s.table("site_queue"), s.table("site_links"), s.table("site_runs"), discovery(s))))
ORACLE["checks_orphans"] = f"""WITH disc AS ({DISCOVERY}), orph AS ({ORACLE['links_orphan_pages']}),
 y AS (SELECT r.run_id, r.store_all_links, coalesce(d.planned, 0) AS planned, coalesce(d.discovery_complete, 0) AS dc, coalesce(o.n, 0) AS hit, o.urls, coalesce(d.planned, 0) AS processed
  FROM site_runs r LEFT JOIN disc d ON d.run_id = r.run_id LEFT JOIN (SELECT run_id, sum(c) AS n, string_agg(url, ' | ' ORDER BY url) FILTER (rn <= 10) AS urls FROM
   (SELECT run_id, url, count(*) AS c, row_number() OVER (PARTITION BY run_id ORDER BY url) AS rn FROM orph GROUP BY run_id, url) g GROUP BY run_id) o ON o.run_id = r.run_id),
 z AS (SELECT *, CASE WHEN store_all_links = 0 THEN 'not_executed' WHEN planned = 0 THEN 'not_applicable' WHEN NOT (dc = 1 AND processed >= planned) THEN 'insufficient_evidence' WHEN hit > 0 THEN 'fail' ELSE 'pass' END AS st FROM y)
SELECT run_id, 'tech.orphan_like_sitemap_urls' AS check_id, st AS evaluation_state, CASE st WHEN 'pass' THEN 'OK' WHEN 'fail' THEN 'Warning' ELSE 'NA' END AS status,
 CAST(CASE WHEN st = 'fail' THEN hit ELSE 0 END AS BIGINT) AS affected_count, 'hit=' || CAST(CAST(hit AS BIGINT) AS VARCHAR) AS evidence, CASE WHEN st = 'fail' THEN urls ELSE '' END AS sample_urls FROM z"""

QUERIES["checks_sitemap_status"] = _simple(lambda s: inputs.flat_results(L.sitemap_status_check(inputs.pages(s), s.table("site_queue"), s.table("site_runs"), discovery(s))))
ORACLE["checks_sitemap_status"] = f"""WITH disc AS ({DISCOVERY}), rws AS (SELECT q.run_id, q.url, q.status AS qs, p.status_code AS sc, p.initial_status_code AS ic,
   coalesce(p.status_code IN (408, 429) OR (p.status_code >= 500 AND {STABLE} <> 'confirmed'), false) AS inc
   FROM site_queue q LEFT JOIN site_pages p ON p.run_id = q.run_id AND p.normalized_url = q.normalized_url WHERE q.source_type IN ('sitemap', 'robots_sitemap')),
 f AS (SELECT *, (sc IS NULL OR ic IS NULL OR inc) AS missing, (NOT inc AND NOT (coalesce(ic, sc, 0) = 200 AND coalesce(sc, 0) = 200)) AS hit FROM rws),
 y AS (SELECT r.run_id, coalesce(d.planned, 0) AS planned, coalesce(d.discovery_complete, 0) AS dc, coalesce(a.n, 0) AS n, coalesce(a.hit, 0) AS hit, coalesce(a.missing, 0) AS missing, coalesce(a.inc, 0) AS inc, coalesce(a.failed, 0) AS failed, s.urls
  FROM site_runs r LEFT JOIN disc d ON d.run_id = r.run_id LEFT JOIN (SELECT run_id, count(*) AS n, count_if(hit) AS hit, count_if(missing) AS missing, count_if(inc) AS inc, count_if(missing AND qs = 'failed') AS failed FROM f GROUP BY run_id) a ON a.run_id = r.run_id
  LEFT JOIN (SELECT run_id, string_agg(url, ' | ' ORDER BY url) AS urls FROM (SELECT run_id, url, row_number() OVER (PARTITION BY run_id ORDER BY url) AS rn FROM (SELECT DISTINCT run_id, url FROM f WHERE hit) d1) d2 WHERE rn <= 10 GROUP BY run_id) s ON s.run_id = r.run_id),
 z AS (SELECT *, CASE WHEN n = 0 AND planned > 0 THEN 'not_executed' WHEN n = 0 THEN 'not_applicable' WHEN hit = 0 AND (dc = 0 OR n - missing < planned) AND failed > 0 THEN 'technical_error' WHEN hit = 0 AND (dc = 0 OR n - missing < planned) THEN 'insufficient_evidence' WHEN hit > 0 THEN 'fail' ELSE 'pass' END AS st FROM y)
SELECT run_id, 'tech.sitemap_urls_non_200' AS check_id, st AS evaluation_state, CASE st WHEN 'pass' THEN 'OK' WHEN 'fail' THEN 'Warning' ELSE 'NA' END AS status, CAST(CASE WHEN st = 'fail' THEN hit ELSE 0 END AS BIGINT) AS affected_count,
 'missing=' || CAST(missing AS VARCHAR) || ';inconclusive=' || CAST(inc AS VARCHAR) AS evidence, CASE WHEN st = 'fail' THEN urls ELSE '' END AS sample_urls FROM z"""

QUERIES["links_hydrated"] = _simple(lambda s: L.hydrate_links(s.table("site_links"), inputs.pages(s)).groupBy("run_id", "initial_status_code", "final_status_code").agg(F.count(F.lit(1)).alias("links")))
ORACLE["links_hydrated"] = """SELECT run_id, ic AS initial_status_code, sc AS final_status_code, count(*) AS links FROM (
  SELECT l.run_id, CASE WHEN k THEN p.initial_status_code END AS ic, CASE WHEN k THEN p.status_code END AS sc FROM (
   SELECT l.*, p.initial_status_code, p.status_code, (l.link_type = 'internal' AND coalesce(replace(regexp_replace(l.target_url, '#.*$', ''), '?utm_source=feed', '') = replace(regexp_replace(p.url, '#.*$', ''), '?utm_source=feed', ''), false)) AS k
   FROM site_links l LEFT JOIN site_pages p ON p.run_id = l.run_id AND p.normalized_url = l.normalized_target_url) l LEFT JOIN (SELECT NULL AS x) e ON false, LATERAL (SELECT l.initial_status_code, l.status_code) p) z GROUP BY 1, 2, 3"""

QUERIES["links_per_page"] = _simple(lambda s: L.link_aggregates(s.table("site_links")).withColumn("samples", F.array_join("samples", " | ")))
ORACLE["links_per_page"] = """SELECT a.run_id, a.source_url, internal_links, external_links, internal_targets, external_targets, nofollow_links, image_links, b.samples FROM (
  SELECT run_id, source_url, count_if(link_type <> 'external') AS internal_links, count_if(link_type = 'external') AS external_links,
    count(DISTINCT CASE WHEN link_type <> 'external' THEN normalized_target_url END) AS internal_targets, count(DISTINCT CASE WHEN link_type = 'external' THEN normalized_target_url END) AS external_targets,
    count_if(rel LIKE '%nofollow%') AS nofollow_links, count_if(regexp_matches(lower(normalized_target_url), '[.](png|jpe?g|webp|gif|svg)([?#]|$)')) AS image_links
  FROM site_links GROUP BY 1, 2) a JOIN (SELECT run_id, source_url, string_agg(t, ' | ' ORDER BY t) AS samples FROM (
    SELECT run_id, source_url, t, row_number() OVER (PARTITION BY run_id, source_url ORDER BY t) AS rn FROM (SELECT DISTINCT run_id, source_url, normalized_target_url AS t FROM site_links) d) r WHERE rn <= 20 GROUP BY 1, 2) b
  ON b.run_id = a.run_id AND b.source_url = a.source_url"""

QUERIES["links_inbound"] = _simple(lambda s: L.inlinks(s.table("site_links")).withColumn("first_sources", F.array_join("first_sources", " | ")))
ORACLE["links_inbound"] = """SELECT run_id, normalized_target_url, CAST(sum(n) AS BIGINT) AS inlink_count, string_agg(source_url, ' | ' ORDER BY source_url) FILTER (rn <= 5) AS first_sources FROM (
  SELECT run_id, normalized_target_url, source_url, count(*) AS n, row_number() OVER (PARTITION BY run_id, normalized_target_url ORDER BY source_url) AS rn FROM site_links WHERE link_type = 'internal' GROUP BY 1, 2, 3) x GROUP BY 1, 2"""

QUERIES["checks_navigation_links"] = _simple(lambda s: L.navigation_checks(s.table("site_links"), inputs.pages(s), s.table("site_runs")))
ABOUT = "(regexp_matches(lower(regexp_extract(target_url, '^https?://[^/?#]+([^?#]*)', 1)), '(^|/)(about|about-us|ueber|ueber-uns|über-uns|ueber-mich|über-mich|unternehmen|company|team)(/|$)') OR trim(regexp_replace(lower(anchor_text), '[|:;,.!?]+$', '')) IN ('about', 'about us', 'ueber', 'ueber uns', 'über uns', 'ueber mich', 'über mich', 'unternehmen', 'company', 'team', 'das team'))"


def _nav(check_id, test):
    return f"""SELECT run_id, '{check_id}' AS check_id, st AS evaluation_state, CASE st WHEN 'pass' THEN 'OK' WHEN 'fail' THEN 'Warning' ELSE 'NA' END AS status, CAST(CASE WHEN st = 'fail' THEN 1 ELSE 0 END AS BIGINT) AS affected_count, CAST(n AS BIGINT) AS matches
    FROM (SELECT r.run_id, coalesce(l.n, 0) AS n, CASE WHEN store_all_links = 0 THEN 'not_executed' WHEN coalesce(html, 0) = 0 THEN 'insufficient_evidence' WHEN coalesce(l.n, 0) > 0 THEN 'pass' WHEN cut > 0 OR ro > 0 THEN 'insufficient_evidence' ELSE 'fail' END AS st
      FROM site_runs r LEFT JOIN (SELECT run_id, count_if({HTML}) AS html, count_if(links_truncated = 1) AS cut, count_if(render_status = 'success' AND coalesce(rendered_links, 0) > internal_links) AS ro FROM site_pages GROUP BY run_id) p ON p.run_id = r.run_id
      LEFT JOIN (SELECT run_id, count_if(link_type = 'internal' AND {test}) AS n FROM site_links GROUP BY run_id) l ON l.run_id = r.run_id) x"""


def _words(pattern):
    return f"(regexp_matches(lower(target_url), '{pattern}') OR regexp_matches(lower(anchor_text), '{pattern}'))"


ORACLE["checks_navigation_links"] = union([
    _nav("geo.impressum_linked", _words("impressum|legal notice")), _nav("geo.datenschutz_linked", _words("datenschutz|privacy")),
    _nav("geo.contact_linked", _words("contact|kontakt")), _nav("geo.about_linked", ABOUT),
])

QUERIES["links_trust_signals"] = _simple(lambda s: L.trust_links(s.table("site_links")).withColumn("trust_links", F.array_join("trust_links", ",")))
ORACLE["links_trust_signals"] = """SELECT run_id, concat_ws(',', CASE WHEN bool_or(t LIKE '%impressum%' OR t LIKE '%legal notice%') THEN 'impressum' END, CASE WHEN bool_or(t LIKE '%datenschutz%' OR t LIKE '%privacy%') THEN 'privacy' END,
  CASE WHEN bool_or(regexp_matches(t, '(^|[/ -])(about|about-us|ueber|über|unternehmen|company|team)([/ -]|$)')) THEN 'about_company' END, CASE WHEN bool_or(t LIKE '%kontakt%' OR t LIKE '%contact%') THEN 'contact' END) AS trust_links
FROM (SELECT run_id, lower(concat(target_url, ' ', anchor_text)) AS t FROM site_links WHERE link_type = 'internal') x GROUP BY run_id"""

TOTALS = """(SELECT run_id, page_url AS url, final_url, count_if(resource_type = 'script') AS js, count_if(resource_type = 'stylesheet') AS css, sum(CASE WHEN resource_type = 'script' THEN size_bytes END) AS jsb, sum(CASE WHEN resource_type = 'stylesheet' THEN size_bytes END) AS cssb,
  count_if(resource_type = 'script' AND size_bytes IS NOT NULL) AS jsm, count_if(resource_type = 'stylesheet' AND size_bytes IS NOT NULL) AS cssm, count_if(resource_type = 'script' AND size_error IS NOT NULL) AS jse, count_if(resource_type = 'stylesheet' AND size_error IS NOT NULL) AS csse,
  count_if(resource_type = 'script' AND third_party = 1) AS tp, count_if(resource_type IN ('script', 'stylesheet', 'font')) AS kr, count_if(resource_type IN ('script', 'stylesheet', 'font') AND third_party = 1) AS tpk,
  any_value(hp) AS has_preload, any_value(hc) AS has_preconnect
 FROM (SELECT r.*, p.hp, p.hc FROM site_resources r LEFT JOIN (SELECT run_id, final_url, min(has_preload) AS hp, min(has_preconnect) AS hc FROM site_pages GROUP BY 1, 2) p ON p.run_id = r.run_id AND p.final_url = r.final_url) j GROUP BY 1, 2, 3) q"""


def _res(check_id, hit):
    return issue(check_id, hit, gate="store_all_resources", table=TOTALS)


def _bytes(check_id, k, limit):
    measures = {"hit": f"{k}b > {limit}", "present": f"{k} > 0", "unmeasured": f"{k}m < {k}", "measured": f"{k}m > 0", "unexplained": f"{k}e < {k}"}
    return check(check_id, TOTALS, measures, state_case(("store_all_resources = 0", NE), ("present = 0", NF), ("hit > 0", FAIL), ("unmeasured > 0 AND measured = 0 AND unexplained = 0", TE), ("unmeasured > 0", IE)), failed("hit"), f"{k}b > {limit}")


QUERIES["checks_resources"] = _simple(lambda s: inputs.flat_results(R.resource_results(s.table("site_resources"), s.table("site_pages"), s.table("site_runs"))))
ORACLE["checks_resources"] = union([
    _res("tech.too_many_js", "js > 25"), _res("tech.too_many_css", "css > 15"), _bytes("tech.large_js_total", "js", 1048576), _bytes("tech.large_css_total", "css", 307200),
    _res("tech.third_party_scripts_detected", "tp > 0"), _res("tech.preload_missing", "kr > 10 AND has_preload = 0"), _res("tech.preconnect_missing", "tpk >= 3 AND has_preconnect = 0"),
    check("tech.imported_resource_performance_signals", TOTALS, {"known": "js > 0 OR css > 0", "hit": "js > 25 OR css > 15 OR jsb > 1048576 OR cssb > 307200"}, state_case(("known = 0", IE), ("hit > 0", FAIL)), "hit", "js > 25 OR css > 15 OR jsb > 1048576 OR cssb > 307200"),
])

QUERIES["resource_measurement_kinds"] = _simple(lambda s: R.measurement_kinds(s.table("site_resources")))
ORACLE["resource_measurement_kinds"] = "SELECT run_id, resource_type, coalesce(size_kind, 'unknown') AS size_kind, count(*) AS measured, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM site_resources WHERE size_bytes IS NOT NULL GROUP BY 1, 2, 3"

DECO = "(decorative = 1 OR badge = 1 OR pixel = 1 OR icon = 1)"
SMALL = "(coalesce(width, '') <> '' AND coalesce(height, '') <> '' AND coalesce(try_cast(width AS INT), 0) <= 64 AND coalesce(try_cast(height AS INT), 0) <= 64)"
HERO = "(image_role = 'hero' OR lower(image_url) LIKE '%hero%' OR lower(image_url) LIKE '%masthead%' OR lower(image_url) LIKE '%banner%')"
NOSIZE = "(coalesce(width, '') = '' OR coalesce(height, '') = '')"
NOLAZY = f"(coalesce(lower(loading), '') <> 'lazy' AND NOT {DECO})"


def _alt(check_id, base):
    hit = f"{base} AND NOT {DECO}"
    return check(check_id, "site_images", {"open": "alt_present IS NULL", "hit": hit, "aside": f"{base} AND {DECO}"}, state_case(("store_all_images = 0", NE), ("open > 0", IE), ("hit > 0", FAIL)), failed("hit"), hit, evidence=("aside",), url="page_url")


LAZY = f"{NOLAZY} AND NOT {SMALL} AND NOT {HERO}"
QUERIES["checks_images"] = _simple(lambda s: inputs.flat_results(R.image_results(s.table("site_images"), s.table("site_runs"))))
ORACLE["checks_images"] = union([
    _alt("tech.images_without_alt", "alt_present = 0"), _alt("tech.empty_alt_texts", "alt_present = 1 AND trim(alt_value) = ''"),
    check("tech.images_without_width_height", "site_images", {"hit": f"{NOSIZE} AND NOT {DECO} AND extension <> '.svg'", "decorated": f"{NOSIZE} AND {DECO}"}, state_case(("store_all_images = 0", NE), ("rows_total = 0", NF), ("hit > 0", FAIL)), failed("hit"), f"{NOSIZE} AND NOT {DECO} AND extension <> '.svg'", evidence=("decorated",), url="page_url"),
    check("tech.images_without_lazy_loading", "site_images", {"hit": LAZY, "small": f"{NOLAZY} AND {SMALL}", "hero": f"{NOLAZY} AND NOT {SMALL} AND {HERO}", "open": "image_role IS NULL"}, state_case(("store_all_images = 0", NE), ("rows_total = 0", NF), ("open > 0", IE), ("hit > 0", FAIL)), failed("hit"), LAZY, evidence=("small", "hero"), url="page_url"),
])

IMGRES = "(SELECT run_id, page_url AS url, size_bytes, size_error FROM site_resources WHERE resource_type = 'image') q"
QUERIES["checks_large_images"] = _simple(lambda s: inputs.flat_results(R.large_image_results(s.table("site_resources"), s.table("site_runs"))))
ORACLE["checks_large_images"] = check("tech.large_image_resources", IMGRES, {"hit": "size_bytes > 307200", "measured": "size_bytes IS NOT NULL", "errors": "size_error IS NOT NULL"},
    state_case(("store_all_resources = 0", NE), ("rows_total = 0", NF), ("hit > 0", FAIL), ("measured = 0 AND errors = rows_total", TE), ("measured < rows_total", IE)), failed("hit"), "size_bytes > 307200", evidence=("measured", "errors"))

FORMATS = """(SELECT run_id, u AS url, fmt FROM (SELECT run_id, u, CASE WHEN ct LIKE '%image/svg%' OR ext = '.svg' THEN NULL WHEN ct IN ('image/webp', 'image/avif') THEN 'modern' WHEN ct IN ('image/jpeg', 'image/png', 'image/gif') THEN 'legacy'
   WHEN ext IN ('.webp', '.avif') THEN 'modern' WHEN ext IN ('.jpg', '.jpeg', '.png', '.gif') THEN 'legacy' ELSE 'unknown' END AS fmt
 FROM (SELECT coalesce(i.run_id, r.run_id) AS run_id, coalesce(i.u, r.u) AS u, i.ext, coalesce(r.ct, '') AS ct FROM (SELECT run_id, image_url AS u, max(extension) AS ext FROM site_images GROUP BY 1, 2) i
  FULL OUTER JOIN (SELECT run_id, resource_url AS u, max(content_type) AS ct FROM site_resources WHERE resource_type = 'image' GROUP BY 1, 2) r ON r.run_id = i.run_id AND r.u = i.u) m) n WHERE fmt IS NOT NULL) q"""
QUERIES["checks_modern_image_formats"] = _simple(lambda s: inputs.flat_results(R.modern_format_results(s.table("site_images"), s.table("site_resources"), s.table("site_runs"))))
ORACLE["checks_modern_image_formats"] = check("tech.modern_image_format_coverage_low", FORMATS, {"modern": "fmt = 'modern'", "unknown": "fmt = 'unknown'", "legacy": "fmt = 'legacy'"},
    state_case(("store_all_images = 0", NE), ("rows_total = 0", NF), ("unknown > 0", IE), ("modern * 1.0 / rows_total < 0.3", FAIL)), "CASE WHEN st = 'fail' THEN rows_total - modern ELSE 0 END", "fmt = 'legacy'", evidence=("modern", "legacy"))

QUERIES["images_unlisted"] = _simple(lambda s: R.unlisted_images(s.table("site_images"), s.table("site_resources")).groupBy("run_id").agg(F.count(F.lit(1)).alias("resources"), F.count_if(F.col("third_party") == 1).alias("external")))
ORACLE["images_unlisted"] = """SELECT run_id, count(*) AS resources, count_if(third_party = 1) AS external FROM site_resources r WHERE resource_type = 'image' AND NOT EXISTS
  (SELECT 1 FROM site_images i WHERE i.run_id = r.run_id AND i.page_url = r.page_url AND i.image_url = r.resource_url) GROUP BY run_id"""

VALID = "(warmup = 0 AND error IS NULL AND ttfb_ms >= 0 AND ttfb_ms <= 120000)"
QUERIES["timing_medians"] = _simple(lambda s: R.timing_medians(s.table("site_timings")).withColumn("median_ms", F.round("median_ms", 4)).drop("unlabelled"))
ORACLE["timing_medians"] = f"""SELECT *, (valid >= 3 AND locations = 1 AND modes = 1) AS eligible FROM (SELECT run_id, url, count(*) AS stored, count_if({VALID}) AS valid, count_if(error IS NOT NULL) AS errors, CAST(0 AS BIGINT) AS outliers,
  round(median(CASE WHEN {VALID} THEN ttfb_ms END), 4) AS median_ms, count(DISTINCT CASE WHEN {VALID} THEN location END) AS locations, count(DISTINCT CASE WHEN {VALID} THEN mode END) AS modes FROM site_timings GROUP BY 1, 2) x"""
QUERIES["checks_ttfb"] = _simple(lambda s: inputs.flat_results(R.timing_results(s.table("site_timings"), s.table("site_runs"))))
ORACLE["checks_ttfb"] = check("tech.high_ttfb", f"({ORACLE['timing_medians']}) q", {"eligible": "eligible", "clean": "errors + outliers < stored", "hit": "eligible AND median_ms > 800"},
    state_case(("rows_total = 0", NE), ("eligible = 0 AND clean = 0", TE), ("eligible = 0", IE), ("hit > 0", FAIL)), failed("hit"), "eligible AND median_ms > 800", evidence=("eligible",))

ORACLE["links_hydrated"] = """SELECT run_id, CASE WHEN k THEN ic END AS initial_status_code, CASE WHEN k THEN sc END AS final_status_code, count(*) AS links FROM (
   SELECT l.run_id, p.initial_status_code AS ic, p.status_code AS sc, (l.link_type = 'internal' AND coalesce(replace(regexp_replace(l.target_url, '#.*$', ''), '?utm_source=feed', '') = replace(regexp_replace(p.url, '#.*$', ''), '?utm_source=feed', ''), false)) AS k
   FROM site_links l LEFT JOIN site_pages p ON p.run_id = l.run_id AND p.normalized_url = l.normalized_target_url) x GROUP BY 1, 2, 3"""


DETAIL_CHECKS = {"tech.title_missing", "geo.low_structured_sections", "tech.images_without_width_height", "tech.too_many_js", "tech.redirect_pages"}
QUERIES["detail_rows"] = _simple(lambda s: DT.rows_of(DT.tables_of(inputs.pages(s), s.table("site_images"), s.table("site_resources"), s.table("site_runs")), DETAIL_CHECKS))
ORACLE["detail_rows"] = f"""
SELECT run_id, 'tech.title_missing' AS check_id, url, url AS item FROM site_pages WHERE {CONTENT} AND {COMPLETE} AND coalesce(trim(title), '') = ''
UNION ALL SELECT run_id, 'geo.low_structured_sections', url, url FROM site_pages WHERE low_structure = 1
UNION ALL SELECT run_id, 'tech.redirect_pages', url, url FROM site_pages WHERE initial_status_code BETWEEN 300 AND 399
UNION ALL SELECT run_id, 'tech.images_without_width_height', page_url, image_url FROM site_images WHERE {NOSIZE} AND NOT {DECO} AND extension <> '.svg'
UNION ALL SELECT run_id, 'tech.too_many_js', url, url FROM {TOTALS} WHERE js > 25"""


def _second_page(s):
    """The page after the fiftieth row, found by the keys of that row, with the total of its listing."""
    rows, keys = s.table("site_pages").select("run_id", "page_id", "url"), ["url", "page_id"]
    shown = FR.page_after(rows, keys, None, 50).orderBy(*[F.desc(key) for key in keys]).first()
    page = FR.page_after(rows, keys, (shown["url"], shown["page_id"]) if shown else None, 50)
    return page.withColumn("total", F.lit(FR.totals(rows).first()["total"]).cast("bigint"))


QUERIES["table_page_after"] = _simple(_second_page)
ORACLE["table_page_after"] = "SELECT run_id, page_id, url, (SELECT count(*) FROM site_pages) AS total FROM site_pages ORDER BY url, page_id LIMIT 50 OFFSET 50"

UNSEEN = ("tech.app_icons_incomplete", "tech.favicon_missing", "tech.webmanifest_missing")
QUERIES["checks_technical_errors"] = _simple(lambda s: evaluate_all(inputs.pages(s).drop("manifest", "favicon"), s.table("site_runs"), PC.head_checks()).where("evaluation_state = 'technical_error'").select(
    "run_id", "check_id", "evaluation_state", "status", "affected_count", "evidence"))
ORACLE["checks_technical_errors"] = " UNION ALL ".join(
    f"SELECT run_id, '{check}' AS check_id, 'technical_error' AS evaluation_state, 'NA' AS status, CAST(0 AS BIGINT) AS affected_count, 'UNRESOLVED_COLUMN.WITH_SUGGESTION' AS evidence FROM site_runs" for check in UNSEEN)
ORACLE = {name: with_views(text) for name, text in ORACLE.items()}
