"""Queries over small relations of runs, pages and findings."""

from __future__ import annotations

from sitewright.catalog.site_views import Site, with_views
from sitewright.operators import registry as RG
from sitewright.operators import summaries as SU

QUERIES = {}
ORACLE = {}


def _simple(build):
    return lambda spark, folder: build(Site(spark, folder))


QUERIES["summary_schedules"] = _simple(lambda s: SU.schedule_summary(s.table("finding_runs")))
ORACLE["summary_schedules"] = """
SELECT schedule_id, count(*) AS runs, count_if(status = 'completed') AS completed, count_if(status IN ('running', 'queued', 'paused')) AS active,
  count_if(status = 'failed') AS failed, arg_max(run_id, finished_at) FILTER (status = 'completed') AS latest_run
FROM finding_runs GROUP BY 1"""

QUERIES["runs_with_projects"] = _simple(lambda s: SU.runs_with_projects(
    s.table("finding_runs").selectExpr("run_id", "status", "run_no % 30 AS project_id", "CASE WHEN run_no % 4 > 0 THEN schedule_id END AS schedule_id"),
    s.table("nation").selectExpr("n_nationkey AS project_id", "n_name AS project_name"),
    s.table("region").selectExpr("CAST(r_regionkey AS INT) AS schedule_id", "r_name AS schedule_name"),
))
ORACLE["runs_with_projects"] = """
SELECT x.run_id, x.status, x.project_id, x.schedule_id, n_name AS project_name, r_name AS schedule_name
FROM (SELECT run_id, status, run_no % 30 AS project_id, CASE WHEN run_no % 4 > 0 THEN schedule_id END AS schedule_id FROM finding_runs) x
JOIN nation ON n_nationkey = x.project_id LEFT JOIN region ON r_regionkey = x.schedule_id"""

QUERIES["summary_reach"] = _simple(lambda s: SU.reach_by_page_type(s.table("site_pages"), s.table("site_links").where("link_type = 'external'").selectExpr("run_id", "source_url AS url")))
ORACLE["summary_reach"] = """
SELECT p.run_id, coalesce(page_type, 'other') AS page_type, count(*) AS pages, count(h.url) AS affected_pages
FROM site_pages p LEFT JOIN (SELECT DISTINCT run_id, source_url AS url FROM site_links WHERE link_type = 'external') h ON h.run_id = p.run_id AND h.url = p.url
GROUP BY 1, 2"""

QUERIES["summary_content_signals"] = _simple(lambda s: SU.content_signals(s.table("site_pages")))
ORACLE["summary_content_signals"] = "SELECT run_id, " + ", ".join(f"count_if(coalesce({name}, 0) > 0) AS {name}" for name in SU.SIGNALS) + " FROM site_pages GROUP BY 1"

QUERIES["summary_page_outcomes"] = _simple(lambda s: SU.page_outcomes(s.table("site_pages")))
ORACLE["summary_page_outcomes"] = """
SELECT run_id, count(*) AS pages, count_if(status_code BETWEEN 200 AND 299) AS ok, count_if(status_code BETWEEN 300 AND 399) AS redirected,
  count_if(status_code >= 400) AS failing, count_if(indexable = 1) AS indexable
FROM site_pages GROUP BY 1"""

QUERIES["page_representatives"] = _simple(lambda s: SU.representatives(s.table("site_pages")))
ORACLE["page_representatives"] = """
SELECT run_id, kind, page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY page_id) AS place FROM (
  SELECT run_id, coalesce(page_type, 'other') AS kind, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM site_pages GROUP BY 1, 2) a) b WHERE place <= 5
UNION ALL SELECT run_id, 'with_query' AS kind, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM site_pages WHERE contains(url, '?') GROUP BY 1"""

QUERIES["targeted_urls"] = _simple(lambda s: SU.targeted_urls([("page", s.table("site_pages")), ("queue", s.table("site_queue")), ("link", s.table("site_links").selectExpr("run_id", "target_url AS url"))]))
ORACLE["targeted_urls"] = """
SELECT run_id, url, arg_min(source, rank) AS source FROM (
  SELECT run_id, url, 0 AS rank, 'page' AS source FROM site_pages UNION ALL SELECT run_id, url, 1, 'queue' FROM site_queue
  UNION ALL SELECT run_id, target_url, 2, 'link' FROM site_links) x WHERE coalesce(url, '') <> '' GROUP BY 1, 2"""

RANKS = {"product": 0, "article": 1, "category": 2, "homepage": 3}
QUERIES["review_sample_pages"] = _simple(lambda s: SU.review_sample(s.table("site_pages"), RANKS, 8))
ORACLE["review_sample_pages"] = """
SELECT run_id, page_id, url, place, sha256(concat_ws('|', url, coalesce(title, ''), coalesce(meta_description, ''))) AS input_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(indexable, 0) DESC, CASE coalesce(page_type, 'other') WHEN 'product' THEN 0 WHEN 'article' THEN 1 WHEN 'category' THEN 2 WHEN 'homepage' THEN 3 ELSE 4 END, page_id) AS place
  FROM site_pages) x WHERE place <= 8"""

QUERIES["detail_samples"] = _simple(lambda s: SU.sample_details(s.table("site_samples"), s.table("site_lab"), s.table("site_browser"), "mobile"))
ORACLE["detail_samples"] = """
SELECT s.run_id, s.cluster_key, s.page_id, s.url, performance_score, lcp_ms, tbt_ms, error_message, b.status AS browser_status, js_required, console_errors
FROM site_samples s LEFT JOIN (SELECT * FROM site_lab WHERE device = 'mobile') l ON l.run_id = s.run_id AND l.page_id = s.page_id
LEFT JOIN site_browser b ON b.run_id = s.run_id AND b.page_id = s.page_id"""

QUERIES["detail_render_state"] = _simple(lambda s: SU.render_details(s.table("site_pages").where("status_code = 200").select("run_id", "page_id", "url"), s.table("site_url_metrics")))
ORACLE["detail_render_state"] = """
SELECT p.run_id, p.page_id, p.url, m.render_decision, m.settling_status, m.browser_run
FROM site_pages p LEFT JOIN site_url_metrics m ON m.run_id = p.run_id AND m.page_id = p.page_id WHERE p.status_code = 200"""

QUERIES["results_import_aware"] = _simple(lambda s: SU.import_aware(s.table("site_findings").select("run_id", "finding_id", "check_id", "evaluation_state", "status", "affected_count"), s.table("finding_runs")))
ORACLE["results_import_aware"] = """
SELECT f.run_id, finding_id, check_id, CASE WHEN skip THEN 'not_executed' ELSE evaluation_state END AS evaluation_state, CASE WHEN skip THEN 'NA' ELSE status END AS status,
  CASE WHEN skip THEN 0 ELSE affected_count END AS affected_count
FROM (SELECT f.*, coalesce(r.source_type = 'import', false) AND check_id IN ('""" + "', '".join(SU.LIVE_CHECKS) + """') AS skip FROM site_findings f LEFT JOIN finding_runs r ON r.run_id = f.run_id) f"""



def _results(s):
    return s.table("site_findings").select("run_id", "finding_id", "check_id", "category", "priority", "finding_type", "evaluation_state", "status", "review_recommended", "manual_priority")


QUERIES["results_standard"] = _simple(lambda s: RG.overlay(_results(s), RG.standard(s.spark)).select(
    "run_id", "finding_id", "check_id", "original_priority", "priority", "original_finding_type", "finding_type", "score_eligible", "score_exclusion_reason", "deduplication_key", "review_recommended", "automation_coverage", "standard_version"))


def _values(rows):
    quoted = lambda value: "NULL" if value is None else str(value).lower() if isinstance(value, bool) else f"'{value}'"
    return ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in rows)


STANDARD = f"(SELECT * FROM (VALUES {_values([(check, *row) for check, row in RG.STANDARD.items()])}) v(check_id, {', '.join(RG.FIELDS)}))"
ORACLE["results_standard"] = f"""
SELECT run_id, finding_id, f.check_id, CASE WHEN s.check_id IS NOT NULL THEN priority END AS original_priority,
  CASE WHEN s.severity IS NULL OR (severity_mode = 'dynamic_medium_high' AND priority IN ('Medium', 'High')) OR (severity_mode = 'dynamic_low_medium' AND priority IN ('Low', 'Medium')) THEN priority
       WHEN score_effect = 'conditional' AND manual_priority IS NOT NULL THEN manual_priority ELSE s.severity END AS priority,
  CASE WHEN s.check_id IS NOT NULL THEN f.finding_type END AS original_finding_type, coalesce(s.finding_type, f.finding_type) AS finding_type,
  CASE WHEN score_effect = 'score_free' THEN false WHEN score_effect = 'conditional' THEN false ELSE evaluation_state IN ('pass', 'fail') END AS score_eligible,
  CASE WHEN score_effect = 'score_free' THEN 'audit_standard_' || usage END AS score_exclusion_reason, deduplication_key,
  CASE WHEN usage IN ('disabled', 'diagnostic_only', 'fully_automated') THEN false WHEN s.review_status = 'required_before_scoring' THEN status IN ('Warning', 'Error') OR review_recommended = 1 ELSE review_recommended = 1 END AS review_recommended,
  CASE usage WHEN 'fully_automated' THEN 'full' WHEN 'automated_with_limits' THEN 'partial' END AS automation_coverage, CASE WHEN s.check_id IS NOT NULL THEN '{RG.STANDARD_VERSION}' END AS standard_version
FROM site_findings f LEFT JOIN {STANDARD} s ON s.check_id = f.check_id"""


def _registry(s):
    active, standards = RG.known_checks(s.spark, RG.library_checks()), RG.standard(s.spark)
    return RG.entries(RG.observed(_results(s), s.table("finding_runs")), active, standards), active, standards


QUERIES["registry_entries"] = _simple(lambda s: _registry(s)[0].select(
    "check_id", "active", "validation_status", "default_severity", "finding_type", "score_effect", "positive_cases", "negative_cases", "observations", "runs", "domains"))
QUERIES["registry_violations"] = _simple(lambda s: RG.violations(*_registry(s)))
QUERIES["registry_summary"] = _simple(lambda s: RG.status_summary(_registry(s)[0]))
#: Checks of the library by default severity and whether they score, as text for DuckDB; a test holds it against the library.
ACTIVE_CHECKS = {
    ("Medium", True): (
        "tech.title_missing", "tech.html_lang_missing", "tech.viewport_missing", "tech.4xx_pages", "tech.x_robots_tag_unusual",
        "tech.rendered_word_count_delta", "tech.raw_internal_links_fewer_rendered", "tech.critical_content_raw_html_signal",
        "tech.js_dependent_content", "tech.product_coverage_on_product_like_pages", "tech.large_js_total", "tech.large_css_total",
        "tech.imported_resource_performance_signals", "tech.images_without_alt", "tech.canonical_missing",
    ),
    ("Low", False): (
        "tech.meta_description_missing", "tech.title_too_short", "tech.title_too_long", "tech.meta_description_too_short",
        "tech.meta_description_too_long", "tech.h1_missing", "tech.multiple_h1", "tech.nofollow_pages", "tech.raw_h1_missing_rendered_present",
        "tech.third_party_scripts_detected", "tech.canonical_non_self",
    ),
    ("Low", True): (
        "tech.webmanifest_missing", "tech.open_graph_basics_missing", "tech.favicon_missing", "tech.app_icons_incomplete",
        "tech.hreflang_x_default_missing", "tech.consent_technical_signals", "tech.html_semantics_summary", "tech.raw_html_size_large",
        "tech.resource_hints_summary", "tech.content_type_html_correct", "tech.charset_utf8_present", "tech.internal_search_noindex_policy",
        "tech.article_coverage_on_article_like_pages", "tech.breadcrumb_missing_low_coverage", "geo.breadcrumblist_present",
        "tech.faqpage_missing_low_coverage", "geo.faq_html_present_schema_missing", "tech.videoobject_schema_present_missing", "geo.tables_present",
        "geo.bulletpoints_lists_present", "geo.visible_dates_present", "geo.author_hints_present", "geo.source_or_external_links_present",
        "trust.eeat_signal_summary", "trust.ymyl_review_signal", "geo.low_structured_sections", "tech.too_many_js", "tech.too_many_css",
        "tech.preload_missing", "tech.preconnect_missing", "tech.empty_alt_texts", "tech.images_without_width_height",
        "tech.images_without_lazy_loading", "tech.hsts_header", "tech.content_security_policy", "tech.x_frame_options",
        "tech.x_content_type_options", "tech.referrer_policy", "tech.permissions_policy", "tech.compression_header", "tech.cache_control_header",
        "tech.cdn_cache_signals",
    ),
    ("High", True): (
        "tech.5xx_pages",
    ),
    ("Medium", False): (
        "tech.redirect_pages", "tech.noindex_pages", "geo.article_blog_pages_article_schema", "tech.canonical_to_other_domain",
    ),
}
ACTIVE = f"(SELECT * FROM (VALUES {_values([(check, priority, scores) for (priority, scores), ids in ACTIVE_CHECKS.items() for check in ids])}) v(check_id, default_severity, scores))"
REGISTRY = f"""(SELECT check_id, a.check_id IS NOT NULL AS active, CASE WHEN a.check_id IS NULL THEN 'deprecated' WHEN s.review_status = 'required_before_scoring' THEN 'manual_review_required'
    WHEN domains >= 2 AND positive_cases > 0 AND negative_cases > 0 AND runs >= 2 THEN 'cross_domain_validated' WHEN domains >= 2 THEN 'validated_with_limits' WHEN domains = 1 THEN 'single_domain_validated' ELSE 'unvalidated' END AS validation_status,
  coalesce(s.severity, a.default_severity, 'None') AS default_severity, coalesce(s.finding_type, 'core_issue') AS finding_type, coalesce(s.score_effect, CASE WHEN a.scores THEN 'score_capable' ELSE 'score_free' END) AS score_effect,
  coalesce(positive_cases, 0) AS positive_cases, coalesce(negative_cases, 0) AS negative_cases, coalesce(observations, 0) AS observations, coalesce(runs, 0) AS runs, coalesce(domains, 0) AS domains, s.usage AS usage
FROM (SELECT check_id, count(*) FILTER (f.status IN ('Warning', 'Error')) AS positive_cases, count(*) FILTER (f.status = 'OK') AS negative_cases, count(*) AS observations, count(DISTINCT f.run_id) AS runs, count(DISTINCT final_domain) AS domains
  FROM site_findings f LEFT JOIN finding_runs r ON r.run_id = f.run_id GROUP BY 1) o FULL JOIN {ACTIVE} a USING (check_id) LEFT JOIN {STANDARD} s USING (check_id))"""
ORACLE["registry_entries"] = f"SELECT check_id, active, validation_status, default_severity, finding_type, score_effect, positive_cases, negative_cases, observations, runs, domains FROM {REGISTRY} g"
ORACLE["registry_violations"] = f"SELECT check_id, 'standard_check_not_active' AS \"constraint\" FROM {REGISTRY} g WHERE usage <> 'disabled' AND NOT active"
ORACLE["registry_summary"] = f"""SELECT validation_status, count(*) AS checks, count(*) FILTER (active) AS active_checks,
  count(*) FILTER (active AND validation_status IN ('cross_domain_validated', 'validated_with_limits', 'manual_review_required')) AS trusted_checks FROM {REGISTRY} g GROUP BY 1"""
ORACLE = {name: with_views(text) for name, text in ORACLE.items()}
