"""Queries over snapshot comparison, reviews and maturity."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewright.catalog.score_queries import _r
from sitewright.catalog.site_views import Site, with_views
from sitewright.operators import comparison as CP
from sitewright.operators import maturity as MT
from sitewright.operators import templates as TP

QUERIES = {}
ORACLE = {}


def _simple(build):
    return lambda spark, folder: build(Site(spark, folder))


def _pairs(s):
    return CP.schedule_pairs(s.table("finding_runs"))


PAIRS = "(SELECT base_run, run_id AS compare_run, schedule_id FROM (SELECT *, lag(run_id) OVER (PARTITION BY schedule_id ORDER BY finished_at, run_id) AS base_run FROM finding_runs WHERE status = 'completed') p0 WHERE base_run IS NOT NULL)"
QUERIES["compare_schedule_pairs"] = _simple(_pairs)
ORACLE["compare_schedule_pairs"] = f"SELECT * FROM {PAIRS} p"

QUERIES["compare_comparability"] = _simple(lambda s: CP.comparability(_pairs(s), s.table("finding_runs")).withColumn("warnings", F.array_join("warnings", ",")))
ORACLE["compare_comparability"] = f"""SELECT base_run, compare_run, CASE WHEN b.final_domain = c.final_domain THEN 'completed' ELSE 'not_comparable' END AS status, CASE WHEN b.final_domain = c.final_domain THEN concat_ws(',', CASE WHEN b.status <> 'completed' OR c.status <> 'completed' THEN 'incomplete_run' END,
  CASE WHEN b.check_area <> c.check_area THEN 'check_area_differs' END, CASE WHEN b.max_urls <> c.max_urls THEN 'crawl_configuration_differs' END, CASE WHEN b.lab_sampling <> c.lab_sampling OR b.browser_sampling <> c.browser_sampling THEN 'sampling_configuration_differs' END) ELSE 'different_domain' END AS warnings
 FROM {PAIRS} p JOIN finding_runs b ON b.run_id = p.base_run JOIN finding_runs c ON c.run_id = p.compare_run"""

SRANK = "CASE {0} WHEN 'OK' THEN 0 WHEN 'NA' THEN 1 WHEN 'Warning' THEN 2 WHEN 'Error' THEN 3 ELSE -1 END".format
PRANK = "CASE {0} WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 ELSE -1 END".format
REPS = f"""(SELECT * FROM (SELECT *, coalesce(report_grouping_key, check_id) AS finding_key, row_number() OVER (PARTITION BY run_id, coalesce(report_grouping_key, check_id) ORDER BY {SRANK('status')} DESC, {PRANK('priority')} DESC, coalesce(score, 999), finding_id) AS rn FROM site_findings) r0 WHERE rn = 1)"""
QUERIES["compare_representatives"] = _simple(lambda s: CP.representatives(s.table("site_findings")).select("run_id", "finding_key", "finding_id", "status", "priority", "score"))
ORACLE["compare_representatives"] = f"SELECT run_id, finding_key, finding_id, status, priority, score FROM {REPS} r"

ISS = "coalesce({0} IN ('Warning', 'Error'), false)".format
DELTA = f"""(SELECT base_run, compare_run, finding_key, check_id, coalesce(bs, 'missing') AS base_status, coalesce(cs, 'missing') AS compare_status, coalesce(cp, '') AS compare_priority, bsc AS base_score, csc AS compare_score, coalesce(ca, 0) - coalesce(ba, 0) AS affected_delta,
  CASE WHEN NOT {ISS('bs')} AND {ISS('cs')} THEN 'new' WHEN {ISS('bs')} AND NOT {ISS('cs')} THEN 'resolved' WHEN {ISS('bs')} AND ({SRANK('cs')} > {SRANK('bs')} OR {PRANK('cp')} > {PRANK('bp')} OR coalesce(csc < bsc, false)) THEN 'worsened'
   WHEN {ISS('bs')} AND ({SRANK('cs')} < {SRANK('bs')} OR {PRANK('cp')} < {PRANK('bp')} OR coalesce(csc > bsc, false)) THEN 'improved' WHEN {ISS('bs')} THEN 'unchanged_issue' ELSE 'unchanged_ok' END AS delta_type,
  (bs IS NOT NULL AND cs IS NOT NULL AND coalesce(br, 'unreviewed') <> coalesce(cr, 'unreviewed')) AS review_changed FROM (
  SELECT coalesce(b.base_run, c.base_run) AS base_run, coalesce(b.compare_run, c.compare_run) AS compare_run, coalesce(b.finding_key, c.finding_key) AS finding_key, coalesce(c.check_id, b.check_id) AS check_id, b.status AS bs, c.status AS cs, b.priority AS bp, c.priority AS cp, b.score AS bsc, c.score AS csc, b.affected_count AS ba, c.affected_count AS ca, b.review_status AS br, c.review_status AS cr
  FROM (SELECT p.base_run, p.compare_run, r.* FROM {PAIRS} p JOIN {REPS} r ON r.run_id = p.base_run) b FULL OUTER JOIN (SELECT p.base_run, p.compare_run, r.* FROM {PAIRS} p JOIN {REPS} r ON r.run_id = p.compare_run) c ON c.base_run = b.base_run AND c.compare_run = b.compare_run AND c.finding_key = b.finding_key) j)"""
QUERIES["compare_findings"] = _simple(lambda s: CP.findings_delta(s.table("site_findings"), _pairs(s)))
ORACLE["compare_findings"] = f"SELECT * FROM {DELTA} d"

LASTP = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, normalized_url ORDER BY page_id DESC) AS rn FROM {0}) l0 WHERE rn = 1)".format
QUERIES["compare_urls"] = _simple(lambda s: CP.url_delta(s.table("base_pages"), s.table("compare_pages")))
UDELTA = f"""(SELECT coalesce(b.run_id, c.run_id) AS run_id, coalesce(b.normalized_url, c.normalized_url) AS normalized_url, CASE WHEN b.run_id IS NULL THEN 'newUrl' WHEN c.run_id IS NULL THEN 'removedUrl' WHEN b.status_code <> c.status_code THEN 'statusChanged'
  WHEN coalesce(b.indexable, 0) = 0 AND coalesce(c.indexable, 0) = 1 THEN 'becameIndexable' WHEN coalesce(b.indexable, 0) = 1 AND coalesce(c.indexable, 0) = 0 THEN 'becameNoindex' WHEN coalesce(b.title, '') <> coalesce(c.title, '') THEN 'titleChanged' WHEN coalesce(b.canonical, '') <> coalesce(c.canonical, '') THEN 'canonicalChanged'
  WHEN coalesce(b.page_type, '') <> coalesce(c.page_type, '') THEN 'pageTypeChanged' ELSE 'unchangedUrl' END AS delta_type, b.status_code AS base_status_code, c.status_code AS compare_status_code, b.indexable AS base_indexable, c.indexable AS compare_indexable
 FROM {LASTP('base_pages')} b FULL OUTER JOIN {LASTP('compare_pages')} c ON c.run_id = b.run_id AND c.normalized_url = b.normalized_url)"""
ORACLE["compare_urls"] = f"SELECT * FROM {UDELTA} u"

TCL = "(SELECT run_id, page_type AS cluster_key, count(*) AS url_count, round(avg(word_count_raw), 2) AS avg_word_count, min(schema_types) AS schema_summary FROM {0} GROUP BY 1, 2)".format


def _clusters(df):
    return df.groupBy("run_id", F.col("page_type").alias("cluster_key")).agg(F.count(F.lit(1)).alias("url_count"), F.round(F.avg("word_count_raw"), 2).alias("avg_word_count"), F.min("schema_types").alias("schema_summary"))


QUERIES["compare_templates"] = _simple(lambda s: CP.template_delta(_clusters(s.table("base_pages")), _clusters(s.table("compare_pages"))))
ORACLE["compare_templates"] = f"""SELECT coalesce(b.run_id, c.run_id) AS run_id, coalesce(b.cluster_key, c.cluster_key) AS cluster_key, CASE WHEN b.run_id IS NULL THEN 'newTemplate' WHEN c.run_id IS NULL THEN 'removedTemplate' WHEN b.url_count <> c.url_count THEN 'urlCountChanged' WHEN abs(b.avg_word_count - c.avg_word_count) >= 50 THEN 'avgWordCountChanged'
  WHEN coalesce(b.schema_summary, '') <> coalesce(c.schema_summary, '') THEN 'schemaCoverageChanged' ELSE 'unchangedTemplate' END AS delta_type, coalesce(c.url_count, 0) - coalesce(b.url_count, 0) AS url_count_delta, round(c.avg_word_count - b.avg_word_count, 2) AS avg_word_count_delta
 FROM {TCL('base_pages')} b FULL OUTER JOIN {TCL('compare_pages')} c ON c.run_id = b.run_id AND c.cluster_key = b.cluster_key"""


def _device(s, device):
    browser = s.table("site_browser") if device == "mobile" else s.table("site_browser").where("page_id % 4 <> 1")
    return TP.performance_summary(s.table("site_samples"), s.table("site_lab").where(F.col("device") == device), browser)


PGOOD = "error_message IS NULL AND coalesce(performance_score, seo_score) IS NOT NULL"


def _dev(device, cond):
    return f"""(SELECT s.run_id, s.cluster_key, coalesce(ls, 0) AS ls, ps, lcp, tbt, cls, coalesce(jr, 0) AS jr, coalesce(ce, 0) AS ce FROM (SELECT DISTINCT run_id, cluster_key FROM site_samples) s LEFT JOIN (SELECT run_id, cluster_key, count_if({PGOOD}) AS ls, round(avg(CASE WHEN {PGOOD} THEN coalesce(performance_score, 0) END), 3) AS ps, round(avg(CASE WHEN {PGOOD} THEN lcp_ms END), 3) AS lcp, round(avg(CASE WHEN {PGOOD} THEN tbt_ms END), 3) AS tbt, round(avg(CASE WHEN {PGOOD} THEN cls END), 3) AS cls FROM site_lab WHERE device = '{device}' GROUP BY 1, 2) l ON l.run_id = s.run_id AND l.cluster_key = s.cluster_key
     LEFT JOIN (SELECT run_id, cluster_key, count_if(status = 'success' AND navigation_error IS NULL AND js_required = 1) AS jr, count_if(status = 'success' AND navigation_error IS NULL AND console_errors > 0) AS ce FROM site_browser WHERE {cond} GROUP BY 1, 2) b ON b.run_id = s.run_id AND b.cluster_key = s.cluster_key)"""


PDELTA = f"""(SELECT run_id, cluster_key, CASE WHEN bls = 0 OR cls_ = 0 THEN 'lighthouseUnavailableInOneRun' WHEN bce = 0 AND cce > 0 THEN 'consoleErrorsNew' WHEN bce > 0 AND cce = 0 THEN 'consoleErrorsResolved' WHEN cjr > bjr THEN 'renderingRegressed' WHEN score_delta <= -0.05 THEN 'performanceRegressed' WHEN score_delta >= 0.05 THEN 'performanceImproved'
  WHEN lcp_delta >= 500 OR tbt_delta >= 100 OR cls_delta >= 0.05 THEN 'performanceRegressed' WHEN lcp_delta <= -500 OR tbt_delta <= -100 OR cls_delta <= -0.05 THEN 'performanceImproved' ELSE 'notComparable' END AS delta_type, score_delta, lcp_delta, tbt_delta, cls_delta FROM (
  SELECT b.run_id, b.cluster_key, b.ls AS bls, c.ls AS cls_, b.ce AS bce, c.ce AS cce, b.jr AS bjr, c.jr AS cjr, round(c.ps - b.ps, 3) AS score_delta, round(c.lcp - b.lcp, 3) AS lcp_delta, round(c.tbt - b.tbt, 3) AS tbt_delta, round(c.cls - b.cls, 3) AS cls_delta FROM {_dev('mobile', 'true')} b JOIN {_dev('desktop', 'page_id % 4 <> 1')} c ON c.run_id = b.run_id AND c.cluster_key = b.cluster_key) j)"""
QUERIES["compare_performance"] = _simple(lambda s: CP.performance_delta(_device(s, "mobile"), _device(s, "desktop")))
ORACLE["compare_performance"] = f"SELECT * FROM {PDELTA} p"

ACT = "(status IN ('Warning', 'Error') AND coalesce(review_status, 'unreviewed') NOT IN ('false_positive', 'ignored'))"
FC = f"""(SELECT run_id, count_if({ACT} AND status = 'Warning') AS warnings, count_if({ACT} AND status = 'Error') AS errors, count_if(review_recommended = 1) AS review_recommended, count_if({ACT} AND finding_type = 'core_issue') AS core_issues, count_if({ACT} AND check_area = 'geo' AND (finding_type = 'opportunity' OR lower(category) LIKE '%geo%')) AS geo_opportunities,
  count_if({ACT} AND (lower(category) LIKE '%security%' OR finding_type = 'best_practice')) AS security_best_practices, count_if({ACT} AND lower(category) LIKE '%media%') AS media_findings, count_if({ACT} AND (regexp_matches(lower(category), 'template performance|javascript & rendering') OR check_id LIKE 'template.%')) AS template_performance FROM site_findings GROUP BY 1)"""
QUERIES["compare_finding_counts"] = _simple(lambda s: CP.finding_counts(s.table("site_findings")))
ORACLE["compare_finding_counts"] = f"SELECT * FROM {FC} f"


def _stored(s):
    return s.table("site_findings").groupBy("run_id").agg(F.round(F.avg("score"), 2).alias("score")).withColumn("model", F.lit("overall"))


SUMM = f"""(SELECT p.base_run, p.compare_run, sc.score - sb.score AS score_delta, {', '.join(f'c.{n} - b.{n} AS {n}_delta' for n in CP.COUNTS)}, coalesce(d.nw, 0) AS new, coalesce(d.re, 0) AS resolved, coalesce(d.wo, 0) AS worsened, coalesce(d.im, 0) AS improved, coalesce(d.un, 0) AS unchanged_issue FROM {PAIRS} p JOIN {FC} b ON b.run_id = p.base_run JOIN {FC} c ON c.run_id = p.compare_run
  JOIN (SELECT run_id, round(avg(score), 2) AS score FROM site_findings GROUP BY 1) sb ON sb.run_id = p.base_run JOIN (SELECT run_id, round(avg(score), 2) AS score FROM site_findings GROUP BY 1) sc ON sc.run_id = p.compare_run
  LEFT JOIN (SELECT base_run, compare_run, count_if(delta_type = 'new') AS nw, count_if(delta_type = 'resolved') AS re, count_if(delta_type = 'worsened') AS wo, count_if(delta_type = 'improved') AS im, count_if(delta_type = 'unchanged_issue') AS un FROM {DELTA} d0 GROUP BY 1, 2) d ON d.base_run = p.base_run AND d.compare_run = p.compare_run)"""
QUERIES["compare_summary"] = _simple(lambda s: CP.summary(s.table("site_findings"), _pairs(s), _stored(s)).withColumn("score_delta", F.round("score_delta", 2)))
ORACLE["compare_summary"] = f"SELECT * EXCLUDE (score_delta), round(score_delta, 2) AS score_delta FROM {SUMM} s"
QUERIES["compare_regressions"] = _simple(lambda s: CP.regressions(CP.findings_delta(s.table("site_findings"), _pairs(s)), CP.summary(s.table("site_findings"), _pairs(s), _stored(s)).withColumn("score_delta", F.round(F.col("score_delta") * 10, 1))))
ORACLE["compare_regressions"] = f"""WITH k AS (SELECT base_run, compare_run, count_if(delta_type = 'new' AND compare_priority = 'High') AS nh, count_if(delta_type = 'resolved') AS re FROM {DELTA} d0 GROUP BY 1, 2), j AS (SELECT s.base_run, s.compare_run, round(score_delta * 10, 1) AS sd, coalesce(nh, 0) AS nh, coalesce(re, 0) AS re FROM {SUMM} s LEFT JOIN k ON k.base_run = s.base_run AND k.compare_run = s.compare_run)
 SELECT base_run, compare_run, 'new_high_priority_findings' AS regression, nh::DOUBLE AS size, 'warning' AS severity FROM j WHERE nh > 0 UNION ALL SELECT base_run, compare_run, 'overall_score_drop', sd, 'warning' FROM j WHERE sd <= -5 UNION ALL SELECT base_run, compare_run, 'resolved_findings', re, 'positive' FROM j WHERE re > 0"""
QUERIES["compare_snapshot_regressions"] = _simple(lambda s: CP.snapshot_regressions(CP.url_delta(s.table("base_pages"), s.table("compare_pages")), CP.performance_delta(_device(s, "mobile"), _device(s, "desktop"))))
ORACLE["compare_snapshot_regressions"] = f"""WITH u AS (SELECT run_id, count_if(delta_type = 'becameNoindex') AS a, count_if(delta_type IN ('newUrl', 'statusChanged') AND compare_status_code >= 400) AS b FROM {UDELTA} x GROUP BY 1), p AS (SELECT run_id, count_if(delta_type = 'performanceRegressed') AS d FROM {PDELTA} y GROUP BY 1)
 SELECT run_id, 'pages_became_noindex' AS regression, a AS size FROM u WHERE a > 0 UNION ALL SELECT run_id, 'new_failing_urls', b FROM u WHERE b > 0 UNION ALL SELECT run_id, 'template_performance_drop', d FROM p WHERE d > 0"""

# --- reviews and maturity
EFF = "(SELECT *, coalesce(review_status, 'unreviewed') AS rs, coalesce(action_status, 'open') AS act, coalesce(manual_status, status) AS es, coalesce(manual_priority, priority) AS ep, (manual_status IS NOT NULL OR manual_priority IS NOT NULL) AS ov, lower(concat_ws(' ', check_id, category, coalesce(report_grouping_key, ''))) AS tx FROM site_findings)"
DTYPE = "CASE WHEN es IN ('OK', 'NA') THEN 'info' WHEN regexp_matches(tx, 'webmanifest|browser metadata opportunity|pwa') THEN 'opportunity' WHEN lower(category) LIKE '%security%' THEN 'best_practice' ELSE finding_type END"
DISP0 = f"(SELECT *, {DTYPE} AS dt FROM {EFF} e0)"
IGN = "rs IN ('false_positive', 'ignored')"
DISP1 = f"""(SELECT *, NOT {IGN} AND (es IN ('Warning', 'Error') OR (es = 'NA' AND review_recommended = 1 AND dt <> 'info')) AS rv, CASE WHEN {IGN} THEN 'all_findings' WHEN es = 'OK' THEN 'passed_checks' WHEN es = 'NA' THEN 'not_applicable' WHEN regexp_matches(tx, 'template performance|javascript & rendering|^template[.]') THEN 'template_performance'
  WHEN tx LIKE '%media%' THEN 'media_findings' WHEN tx LIKE '%security%' OR dt = 'best_practice' THEN 'security_best_practices' WHEN dt = 'core_issue' AND regexp_matches(tx, 'geo[.](robots_mentions_|robots_blocks_txt_files|llms_txt_)') THEN 'action_items'
  WHEN check_area = 'geo' OR dt = 'opportunity' OR regexp_matches(tx, 'geo|ai crawler policy|ai bot|speakable|llms|webmanifest|pwa') THEN 'geo_opportunities' WHEN dt = 'core_issue' THEN 'action_items' ELSE 'technical_appendix' END AS sec FROM {DISP0} d0)"""
DISP2 = f"""(SELECT *, CASE WHEN rs <> 'unreviewed' THEN rs WHEN NOT rv THEN 'not_required' ELSE 'unreviewed' END AS drs, CASE WHEN dt = 'opportunity' AND es IN ('Warning', 'Error') THEN 'Opportunity' ELSE es END AS ds, NOT {IGN} AND sec IN ('action_items', 'geo_opportunities', 'security_best_practices', 'media_findings', 'template_performance') AS ac, rv AND (review_recommended = 1 OR confidence IN ('low', 'medium')) AS drr FROM {DISP1} d1)"""
DISP = f"(SELECT *, CASE WHEN act <> 'open' THEN act WHEN NOT rv OR drs = 'not_required' THEN 'none' ELSE 'open' END AS das FROM {DISP2} d2)"


def _displayed(s):
    return MT.display_semantics(MT.effective_values(s.table("site_findings")))


QUERIES["review_display"] = _simple(lambda s: _displayed(s).groupBy("run_id", "report_section", "display_status", "display_review_status", "display_action_status", "display_type", "has_override").agg(F.count(F.lit(1)).alias("findings"), F.count_if("actionable").alias("actionable"), F.count_if("display_review_recommended").alias("review")))
ORACLE["review_display"] = f"SELECT run_id, sec AS report_section, ds AS display_status, drs AS display_review_status, das AS display_action_status, dt AS display_type, ov AS has_override, count(*) AS findings, count_if(ac) AS actionable, count_if(drr) AS review FROM {DISP} d GROUP BY 1, 2, 3, 4, 5, 6, 7"
SECT = ("action_items", "geo_opportunities", "security_best_practices", "media_findings", "template_performance", "passed_checks", "not_applicable")
QUERIES["review_summary"] = _simple(lambda s: MT.review_summary(_displayed(s)))
ORACLE["review_summary"] = f"SELECT run_id, count(*) AS findings, count_if(rv) AS reviewable, count_if(drr) AS review_recommended, count_if(ac) AS actionable, count_if(drs = 'not_required') AS not_required, count_if(rv AND confidence = 'low') AS low_confidence, count_if(rv AND confidence = 'medium') AS medium_confidence, {', '.join(f'''count_if(sec = '{n}') AS {n}''' for n in SECT)} FROM {DISP} d GROUP BY 1"
QUERIES["review_action_items"] = _simple(lambda s: MT.core_action_items(_displayed(s)).select("run_id", "finding_id", "check_id", "effective_priority", "affected_count"))
ORACLE["review_action_items"] = f"SELECT run_id, finding_id, check_id, ep AS effective_priority, affected_count FROM {DISP} d WHERE sec = 'action_items' AND es IN ('Warning', 'Error') AND (ep IN ('High', 'Medium') OR (ep = 'Low' AND regexp_matches(check_id, 'geo[.](robots_mentions_|llms_txt_)'))) AND confidence IN ('high', 'medium') AND affected_count > 0"
QUERIES["review_top_findings"] = _simple(lambda s: MT.ordered_findings(_displayed(s), 10).select("run_id", "position", "finding_id", "effective_priority", "effective_status", "affected_count"))
ORACLE["review_top_findings"] = f"SELECT run_id, position, finding_id, effective_priority, effective_status, affected_count FROM (SELECT run_id, finding_id, ep AS effective_priority, es AS effective_status, affected_count, row_number() OVER (PARTITION BY run_id ORDER BY CASE ep WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END, CASE es WHEN 'Error' THEN 0 WHEN 'Warning' THEN 1 WHEN 'NA' THEN 2 ELSE 3 END, affected_count DESC, finding_id) AS position FROM {DISP} d) t WHERE position <= 10"
QUERIES["review_latest"] = _simple(lambda s: MT.latest_reviews(s.table("site_findings").where("review_status is not null").select("run_id", "check_id", F.col("check_id").alias("finding_id"), "review_status", F.struct("stored_at", "finding_id").alias("reviewed_at")).drop("check_id"), s.table("site_findings").select("run_id", F.col("check_id").alias("finding_id"))))
ORACLE["review_latest"] = "SELECT run_id, check_id AS finding_id, max_by(review_status, (stored_at, finding_id)) AS review_status FROM site_findings WHERE review_status IS NOT NULL GROUP BY 1, 2"

CONTRA = "(es = 'OK' AND regexp_matches(lower(finding), 'status recorded: (4|5)[0-9][0-9]|not found|not explicitly mentioned'))"
MISS = "(es <> 'OK' AND regexp_matches(lower(check_id || ' ' || finding), '(^|[^a-z0-9_])(missing|without)([^a-z0-9_]|$)|_missing([^a-z0-9_]|$)|not found|not explicitly mentioned'))"
MCAT = "CASE check_id " + " ".join(f"WHEN '{check}' THEN '{name}'" for name, ids in MT.CATEGORY_CHECKS.items() for check in ids) + " ELSE 'uncategorized' END"
PTS = f"""(SELECT *, CASE WHEN es = 'NA' OR sec = 'not_applicable' THEN NULL WHEN {CONTRA} THEN 1 WHEN check_id IN ('geo.llms_txt_present', 'geo.robots_mentions_gptbot') THEN CASE WHEN es = 'OK' THEN 10 ELSE 1 END WHEN {MISS} THEN 1 WHEN es = 'OK' THEN 10 WHEN dt IN ('opportunity', 'best_practice') THEN 6 WHEN es = 'Warning' THEN 4 WHEN es = 'Error' THEN 1 END AS pt,
  CASE WHEN {CONTRA} THEN 'Warning' ELSE CASE WHEN es IN ('NA', 'OK') THEN es ELSE ds END END AS ms, {MCAT} AS mc FROM {DISP} d)"""
WT = "CASE mc " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MT.CATEGORY_WEIGHT.items()) + " END"
LBL = "CASE WHEN {0} IS NULL THEN 'Nicht bewertet' WHEN {0} < 2 THEN 'Kritisch' WHEN {0} < 4 THEN 'Unausgereift' WHEN {0} < 5.5 THEN 'Basis vorhanden' WHEN {0} < 7 THEN 'Fortgeschritten' WHEN {0} < 8.5 THEN 'Stark' ELSE 'Top' END".format
CATS = f"""(SELECT *, ({WT})::DOUBLE AS weight, {LBL('score')} AS label FROM (SELECT run_id, mc, count(*) AS checks, count(pt) AS evaluated, {_r('avg(pt)', 1)} AS score, count_if(pt IS NOT NULL AND ms = 'OK') AS passed, count_if(pt IS NOT NULL AND ms = 'Warning') AS warnings, count_if(pt IS NOT NULL AND ms = 'Error') AS errors, count_if(pt IS NOT NULL AND ms = 'Opportunity') AS opportunities, count_if(pt IS NULL) AS excluded FROM {PTS} p GROUP BY 1, 2) c0)"""


def _points(s):
    return MT.points(_displayed(s))


QUERIES["maturity_points"] = _simple(lambda s: _points(s).groupBy("run_id", "maturity_category", "point", "maturity_status").agg(F.count(F.lit(1)).alias("findings")))
ORACLE["maturity_points"] = f"SELECT run_id, mc AS maturity_category, pt AS point, ms AS maturity_status, count(*) AS findings FROM {PTS} p GROUP BY 1, 2, 3, 4"
QUERIES["maturity_categories"] = _simple(lambda s: MT.category_scores(_points(s)))
ORACLE["maturity_categories"] = f"SELECT * EXCLUDE (mc), mc AS maturity_category FROM {CATS} c"
QUERIES["maturity_runs"] = _simple(lambda s: MT.run_maturity(_points(s)))
ORACLE["maturity_runs"] = f"""SELECT a.run_id, check_average, checks, excluded, maturity_score, unweighted_score, categories, {LBL('maturity_score')} AS label FROM (SELECT run_id, {_r('avg(pt)', 1)} AS check_average, count(*) AS checks, count_if(pt IS NULL) AS excluded FROM {PTS} p GROUP BY 1) a
 LEFT JOIN (SELECT run_id, {_r('round(sum(score * weight) / sum(weight), 8)', 1)} AS maturity_score, {_r('round(avg(score), 8)', 1)} AS unweighted_score, count(*) AS categories FROM {CATS} c WHERE score IS NOT NULL GROUP BY 1) b ON b.run_id = a.run_id"""
QUERIES["maturity_highlights"] = _simple(lambda s: MT.highlights(_points(s)))
ORACLE["maturity_highlights"] = f"""WITH c AS (SELECT * FROM {CATS} q WHERE score IS NOT NULL) SELECT run_id, kind, position, maturity_category, score FROM (
  SELECT run_id, 'strength' AS kind, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, weight DESC, passed DESC, mc) AS position, mc AS maturity_category, score FROM c WHERE score >= 7
  UNION ALL SELECT run_id, 'weakness', row_number() OVER (PARTITION BY run_id ORDER BY score, weight DESC, errors DESC, warnings DESC, mc), mc, score FROM c WHERE score < 7 OR warnings + errors + opportunities > 0
  UNION ALL SELECT run_id, 'next_step', row_number() OVER (PARTITION BY run_id ORDER BY score, weight DESC, errors DESC, warnings DESC, mc), mc, score FROM c WHERE mc IN ('technical-seo', 'structure-quality', 'structured-data', 'geo-readiness', 'trust-entity', 'media-performance', 'template-rendering') AND score < 8.5) h WHERE position <= 5"""
EST = "CASE WHEN effort IN ('S', 'M', 'L') THEN effort WHEN regexp_matches(lower(check_id || ' ' || category), 'robots_mentions|ai_bots|open_graph|webmanifest|favicon|html_lang|viewport|security|header|llms') THEN 'S' WHEN regexp_matches(lower(check_id || ' ' || category), 'schema|structured|breadcrumb|title|meta|h1') THEN 'M' ELSE 'unknown' END"
QUERIES["maturity_quick_wins"] = _simple(lambda s: MT.quick_wins(_points(s)))
ORACLE["maturity_quick_wins"] = f"""SELECT run_id, position, finding_id, check_id, eu AS effort_used, ep AS effective_priority, affected_count FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE eu WHEN 'S' THEN 0 WHEN 'M' THEN 1 WHEN 'L' THEN 2 ELSE 3 END, CASE ep WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END, affected_count DESC, finding_id) AS position
  FROM (SELECT *, {EST} AS eu FROM {PTS} p WHERE pt IS NOT NULL AND ms NOT IN ('OK', 'NA')) q WHERE eu = 'S' OR (eu = 'M' AND ep <> 'High') OR dt IN ('opportunity', 'best_practice')) r WHERE position <= 5"""

ORACLE = {name: with_views(text) for name, text in ORACLE.items()}
