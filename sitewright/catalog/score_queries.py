"""Queries over scoring and evidence coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewright.catalog.site_views import Site, with_views
from sitewright.operators import coverage as CV
from sitewright.operators import scoring as SC

QUERIES = {}
ORACLE = {}


def _simple(build):
    def run(spark, folder):
        site = Site(spark, folder)
        return build(site.table("site_findings"), site.table("finding_runs"))

    return run


def _r(value, places):
    scale = f"{10.0 ** places:.1f}"
    return f"(floor(({value}) * {scale} + 0.5) / {scale})"


def _r3(value):
    return f"(floor((CAST(round(({value}) * 10000) AS BIGINT) + 5) / 10) / 1000.0::DOUBLE)"


def _case(column, table, default):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


AI = "'geo.robots_mentions_gptbot'"
CLASS = f"""CASE WHEN check_id = 'tech.js_dependent_content' THEN CASE WHEN render_required > 0 THEN 'primary_conditional' ELSE 'secondary_diagnostic' END WHEN check_id IN ({AI}, 'geo.llms_txt_present') THEN 'primary_required'
 WHEN check_id IN ('tech.https_reachable', 'tech.content_security_policy', 'tech.hsts_header') THEN 'primary_required' WHEN check_id IN ('tech.console_errors_present', 'template.console_errors') THEN 'secondary_diagnostic' WHEN check_id = 'template.high_lcp' THEN 'primary_conditional'
 WHEN regexp_matches(check_id, '(distribution|summary)$') THEN 'inventory' WHEN regexp_matches(check_id, 'article_coverage|article_blog_pages') THEN 'primary_conditional' WHEN regexp_matches(check_id, 'open_graph|impressum_linked') OR regexp_matches(check_id, '^(geo|trust|llm)[.]') THEN 'optional_opportunity' ELSE 'primary_required' END"""
UNIT = f"""CASE WHEN check_id = {AI} THEN 'site:ai_policy:' || check_id WHEN check_id = 'geo.llms_txt_present' THEN 'site:ai_files:llms_txt' WHEN check_id IN ('tech.https_reachable', 'tech.content_security_policy', 'tech.hsts_header') THEN 'site:http_host_security:' || check_id
 WHEN check_id LIKE '%article%' THEN 'site:structured_data:article_coverage' WHEN check_id LIKE '%.console_errors%' THEN 'site:browser_diagnostic:console' WHEN check_id = 'template.high_lcp' THEN 'module:lighthouse:performance' ELSE 'check:' || check_id END"""
BROWSER = "check_id IN ('tech.console_errors_present', 'template.console_errors', 'tech.js_dependent_content')"
SENSITIVE = f"({BROWSER} OR check_id = 'template.high_lcp' OR regexp_matches(check_id, 'title|meta_description|canonical|h1|html_lang|hreflang|open_graph'))"
OFF = "((check_id = 'template.high_lcp' AND lab_sampling = 0) OR (check_id = 'template.console_errors' AND browser_sampling = 0))"
SKIP = f"({BROWSER} AND render_required = 0 AND evaluation_state NOT IN ('pass', 'fail'))"
DONE = "evaluation_state IN ('pass', 'fail')"
DIAG = "ec IN ('secondary_diagnostic', 'optional_opportunity')"
ANN = f"""ann AS (SELECT b.*, CASE WHEN {OFF} THEN 'disabled' WHEN {SKIP} THEN CASE WHEN render_optional_open > 0 THEN 'render_optional_not_selected' ELSE 'skipped_by_render_plan' END WHEN evaluation_state = 'not_applicable' OR {DONE} THEN 'completed'
   WHEN {SENSITIVE} AND render_exhausted > 0 THEN 'skipped_by_budget' WHEN evaluation_state = 'technical_error' OR ({SENSITIVE} AND render_unavailable > 0) THEN 'technical_error' ELSE 'not_executed' END AS execution_status,
  CASE WHEN {OFF} OR {SKIP} OR evaluation_state = 'not_applicable' THEN 'not_required' WHEN {DONE} THEN 'complete' WHEN evaluation_state = 'technical_error' OR ({SENSITIVE} AND render_unavailable > 0) THEN 'technical_error' WHEN {DIAG} THEN 'optional_unavailable' ELSE 'required_but_missing' END AS evidence_status,
  CASE WHEN {OFF} OR {SKIP} OR evaluation_state = 'not_applicable' THEN 'excluded' WHEN {DONE} THEN 'covered' WHEN {DIAG} THEN 'diagnostic_unavailable' ELSE 'uncovered' END AS coverage_status,
  {_case('ec', CV.CLASS_WEIGHTS, 0)} AS cw FROM (SELECT f.*, r.* EXCLUDE (run_id, run_no, source_type, status, check_area, finished_at), {CLASS} AS ec, {UNIT} AS cu FROM site_findings f JOIN finding_runs r ON r.run_id = f.run_id) b)"""
TEXT = "lower(category || ' ' || check_id)"
CAT = f"""CASE WHEN regexp_matches({TEXT}, 'accessib') THEN 'accessibility' WHEN regexp_matches({TEXT}, 'security|hsts|content.security|frame|referrer|permissions') THEN 'security' WHEN regexp_matches({TEXT}, 'structured|schema|article|product|breadcrumb|faq') THEN 'structured_data'
 WHEN regexp_matches({TEXT}, 'performance|lighthouse|lcp|ttfb|javascript|render') THEN 'performance' WHEN regexp_matches({TEXT}, 'media|image|video') THEN 'media' WHEN regexp_matches({TEXT}, 'crawling|index|redirect|canonical|robots|sitemap') THEN 'crawling_indexing'
 WHEN regexp_matches({TEXT}, 'html head|meta|title|heading|h1') THEN 'html_meta' WHEN check_area = 'geo' OR regexp_matches({TEXT}, 'geo|ai crawler|ai bot|llms|trust') THEN 'geo' WHEN {TEXT} LIKE '%content%' THEN 'content' WHEN regexp_matches({TEXT}, 'server|infrastructure|http') THEN 'technical_seo' ELSE 'other' END"""
SCOPE = """coalesce(scope_type, CASE WHEN check_id LIKE 'template.%' THEN 'template' WHEN check_id LIKE '%external%' THEN 'external' WHEN regexp_matches(check_id, 'image|resource|css|javascript|large_js') THEN 'resource'
 WHEN regexp_matches(check_id, 'https_reachable|http_to_https|www_non_www|robots|sitemap|header|not_found|compression|hsts|content_security') THEN 'sitewide' WHEN affected_count > 0 THEN 'url' ELSE 'unknown' END)"""
PREP = f"""prep AS (SELECT *, {DONE} AND conf <> 'low' AND coverage_status = 'covered' AS reliable, coalesce(root_cause_key, CASE WHEN check_id LIKE '%article%' THEN 'structured_data.article_coverage' END, 'check.' || check_id) AS rck FROM (
  SELECT *, CASE WHEN severity IS NOT NULL THEN severity ELSE lower(priority) END AS sev, confidence AS conf, {CAT} AS ck, CASE WHEN {SCOPE} IN ('url', 'template', 'sitewide', 'resource', 'external', 'service', 'unknown') THEN {SCOPE} ELSE 'unknown' END AS sc FROM ann) p0),
 md AS (SELECT *, unnest(['overall', check_area]) AS model FROM prep)"""
RC = f"""bc AS (SELECT run_id, model, rck, check_id, max(affected_count) AS ma, sum(affected_count) AS sa, max(occurrence_count) AS mo, sum(occurrence_count) AS so, max({_case('sev', SC.SEVERITY_RANK, 0)}) AS s, min({_case('conf', SC.CONFIDENCE_RANK, 1)}) AS k,
   max(({_case('sc', SC.SCOPE_RANK, 0)}, sc)) AS scope, count(DISTINCT finding_id) AS members, bool_and(finding_type <> 'core_issue') AS nocore,
   min((-{_case('sev', SC.SEVERITY_RANK, 0)}, {_case('finding_type', SC.TYPE_RANK, 9)}, -{_case('conf', SC.CONFIDENCE_RANK, 1)}, check_id, ck)) AS m FROM md WHERE evaluation_state = 'fail' AND reliable GROUP BY 1, 2, 3, 4),
 rc0 AS (SELECT run_id, model, rck, max(CASE WHEN ma > 1 THEN ma ELSE sa END) AS au, max(CASE WHEN mo > 1 THEN mo ELSE so END) AS oc, greatest(1, max(s)) AS s, min(k) AS k, max(scope)[2] AS sc, CAST(sum(members) AS BIGINT) AS member_count, bool_and(nocore) AS nocore, min(m)[4] AS pc, min(m)[5] AS ck, string_agg(check_id, ',' ORDER BY check_id) AS related FROM bc GROUP BY 1, 2, 3),
 rc1 AS (SELECT *, CASE s WHEN 4 THEN 30 WHEN 3 THEN 14 WHEN 2 THEN 5 ELSE 1 END AS bp, CASE k WHEN 3 THEN 1.0::DOUBLE WHEN 2 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS cf,
   {_r("least(2.0::DOUBLE, least(1.75::DOUBLE, 1 + log10(greatest(1.0::DOUBLE, CAST(greatest(1, CASE WHEN au > 0 THEN au ELSE oc END) AS DOUBLE))) * 0.25::DOUBLE) * (" + _case('sc', SC.SCOPE_FACTOR, '1.0') + ")::DOUBLE)", 4)} AS sf FROM rc0),
 rc AS (SELECT *, {_r("bp * sf * cf * (" + _case('ck', SC.CATEGORY_FACTOR, '0.8') + ")::DOUBLE", 4)} AS raw, s = 1 AND nocore AS ol FROM rc1),
 o1 AS (SELECT run_id, model, (sum(CAST(round(raw * 10000) AS BIGINT)) / 10000.0::DOUBLE) AS os FROM rc WHERE ol GROUP BY 1, 2),
 c1 AS (SELECT rc.*, CASE WHEN ol AND os > 5 THEN {_r("raw * (5.0::DOUBLE / os)", 4)} ELSE raw END AS stage FROM rc LEFT JOIN o1 ON o1.run_id = rc.run_id AND o1.model = rc.model),
 c2 AS (SELECT run_id, model, ck, (sum(CAST(round(stage * 10000) AS BIGINT)) / 10000.0::DOUBLE) AS cs FROM c1 GROUP BY 1, 2, 3),
 cap AS (SELECT c1.*, ({_case('c1.ck', SC.CATEGORY_CAP, 15)})::DOUBLE AS lim, CASE WHEN cs > ({_case('c1.ck', SC.CATEGORY_CAP, 15)}) THEN {_r("stage * ((" + _case('c1.ck', SC.CATEGORY_CAP, 15) + ")::DOUBLE / cs)", 4)} ELSE stage END AS applied FROM c1 JOIN c2 ON c2.run_id = c1.run_id AND c2.model = c1.model AND c2.ck = c1.ck)"""


def _pct(a, b):
    return f"CASE WHEN {b} > 0 THEN {_r(f'{a} / {b} * 100', 1)} ELSE 0.0 END"


def _sum(cond):
    return f"sum(CASE WHEN {cond} THEN w ELSE 0.0 END)"


UN = f"""un AS (SELECT *, CASE WHEN rk >= 4 THEN 'primary' WHEN rk = 2 THEN 'diagnostic' WHEN rk = 3 THEN 'inventory' ELSE 'optional' END AS dim FROM (SELECT run_id, model, cu, max(cw)::DOUBLE AS w, max({_case('ec', CV.CLASS_RANK, 0)}) AS rk, bool_and(coverage_status = 'excluded') AS ex, bool_or(coverage_status = 'covered') AS cv, min(ck) AS ck, count(*) AS results FROM md GROUP BY 1, 2, 3) u0)"""
WEIGHTS = ", ".join([f"sum(w) AS configured_weight, {_sum('NOT ex')} AS eligible_weight, {_sum('NOT ex AND cv')} AS evaluated_weight"] + [f"{_sum(f'''NOT ex AND dim = '{d}' ''')} AS {d}_eligible, {_sum(f'''NOT ex AND cv AND dim = '{d}' ''')} AS {d}_evaluated" for d in ("primary", "diagnostic", "inventory", "optional")])
SHARES = ", ".join([_pct("evaluated_weight", "eligible_weight") + " AS weighted_coverage"] + [_pct(f"{d}_evaluated", f"{d}_eligible") + f" AS {d}_coverage" for d in ("primary", "diagnostic", "inventory", "optional")])
STATUS = "CASE WHEN {0} >= 80 THEN 'final' WHEN {0} >= 60 THEN 'provisional' ELSE 'insufficient_coverage' END"
COV = f"""cc AS (SELECT *, CASE WHEN primary_eligible > 0 THEN {STATUS.format('primary_coverage')} ELSE 'not_applicable' END AS category_status FROM (SELECT *, {SHARES} FROM (SELECT run_id, model, ck, {WEIGHTS} FROM un GROUP BY 1, 2, 3) a) b),
 rv AS (SELECT *, CASE WHEN {STATUS.format('primary_coverage')} <> 'final' THEN {STATUS.format('primary_coverage')} WHEN render_coverage < 100 THEN 'provisional' WHEN weak > 0 THEN 'provisional' ELSE 'final' END AS score_status FROM (
  SELECT a.*, {SHARES}, CASE WHEN rn IS NULL THEN 100.0 WHEN rn > 0 THEN {_r('rcv * 1.0 / rn * 100', 1)} ELSE 0.0 END AS render_coverage, coalesce(weak, 0) AS weak FROM (SELECT run_id, model, {WEIGHTS} FROM un GROUP BY 1, 2) a
  LEFT JOIN (SELECT run_id, model, count(*) AS weak FROM cc WHERE ck IN ('technical_seo', 'crawling_indexing', 'html_meta', 'structured_data', 'performance') AND primary_eligible > 0 AND primary_coverage < 60 GROUP BY 1, 2) k ON k.run_id = a.run_id AND k.model = a.model
  LEFT JOIN (SELECT run_id, model, count_if(coverage_status = 'covered') AS rcv, count_if(coverage_status <> 'excluded') AS rn FROM md WHERE check_id = 'tech.js_dependent_content' AND ec = 'primary_conditional' GROUP BY 1, 2) n ON n.run_id = a.run_id AND n.model = a.model) b)"""
BASE = f"WITH {ANN}, {PREP}"
ALL = f"{BASE}, {RC}, {UN}, {COV}"

QUERIES["evidence_availability"] = _simple(lambda f, r: CV.annotate(f, r).select("run_id", "finding_id", "evidence_class", "coverage_unit", "execution_status", "evidence_status", "coverage_status", "coverage_weight").groupBy("run_id", "evidence_class", "coverage_unit", "execution_status", "evidence_status", "coverage_status").agg(F.count(F.lit(1)).alias("results"), F.max("coverage_weight").alias("weight")))
ORACLE["evidence_availability"] = f"WITH {ANN} SELECT run_id, ec AS evidence_class, cu AS coverage_unit, execution_status, evidence_status, coverage_status, count(*) AS results, max(cw)::DOUBLE AS weight FROM ann GROUP BY 1, 2, 3, 4, 5, 6"

QUERIES["score_rows_prepared"] = _simple(lambda f, r: SC.prepare(f, r).groupBy("run_id", "category_key", "severity", "confidence", "scope_type", "reliable").agg(F.count(F.lit(1)).alias("results")))
ORACLE["score_rows_prepared"] = f"{BASE} SELECT run_id, ck AS category_key, sev AS severity, conf AS confidence, sc AS scope_type, reliable, count(*) AS results FROM prep GROUP BY 1, 2, 3, 4, 5, 6"

QUERIES["score_root_causes"] = _simple(lambda f, r: SC.apply_caps(SC.root_causes(SC.per_model(SC.prepare(f, r)))).select("run_id", "model", "root_cause_key", "root_cause_id", "primary_check_id", "category_key", "scope_type", "affected_url_count", "occurrence_count", "member_count", F.array_join("related_check_ids", ",").alias("related_check_ids"), "scope_factor", "raw_penalty", "optional_low", "applied_penalty"))
ORACLE["score_root_causes"] = f"""{BASE}, {RC} SELECT run_id, model, rck AS root_cause_key, 'rc_' || left(sha256(rck), 16) AS root_cause_id, pc AS primary_check_id, ck AS category_key, sc AS scope_type, CAST(au AS BIGINT) AS affected_url_count, CAST(oc AS BIGINT) AS occurrence_count, member_count, related AS related_check_ids, sf AS scope_factor, raw AS raw_penalty, ol AS optional_low, applied AS applied_penalty FROM cap"""

QUERIES["score_cap_records"] = _simple(lambda f, r: SC.cap_records(SC.root_causes(SC.per_model(SC.prepare(f, r)))))
ORACLE["score_cap_records"] = f"""{BASE}, {RC} SELECT run_id, model, 'optional_low_global' AS cap, 5.0::DOUBLE AS cap_limit, {_r3('os')} AS raw_penalty FROM o1 WHERE os > 5 UNION ALL SELECT run_id, model, 'category:' || ck, any_value(lim), {_r3('(sum(CAST(round(raw * 10000) AS BIGINT)) / 10000.0::DOUBLE)')} FROM cap GROUP BY run_id, model, ck HAVING sum(raw) > any_value(lim)"""

QUERIES["score_coverage_units"] = _simple(lambda f, r: SC.coverage_units(SC.per_model(SC.prepare(f, r))).select("run_id", "model", "coverage_unit", "weight", "category_key", "dimension", "unit_status", "results"))
ORACLE["score_coverage_units"] = f"{BASE}, {UN} SELECT run_id, model, cu AS coverage_unit, w AS weight, ck AS category_key, dim AS dimension, CASE WHEN ex THEN 'excluded' WHEN cv THEN 'covered' ELSE 'uncovered' END AS unit_status, results FROM un"

QUERIES["score_coverage"] = _simple(lambda f, r: (lambda m: SC.run_coverage(m, SC.coverage_units(m)))(SC.per_model(SC.prepare(f, r))).select("run_id", "model", "weighted_coverage", "primary_coverage", "diagnostic_coverage", "inventory_coverage", "optional_coverage", "render_coverage", "score_status"))
ORACLE["score_coverage"] = f"{BASE}, {UN}, {COV} SELECT run_id, model, weighted_coverage, primary_coverage, diagnostic_coverage, inventory_coverage, optional_coverage, render_coverage, score_status FROM rv"

QUERIES["score_runs"] = _simple(lambda f, r: SC.scores(f, r).select("run_id", "model", "score_status", "score", "diagnostic_score", "raw_penalty", "applied_penalty", "root_causes", "results", "failing", "excluded_results"))
SCORES = f"""SELECT v.run_id, v.model, score_status, CASE WHEN score_status <> 'insufficient_coverage' THEN least(100.0, greatest(0.0, {_r('100 - ' + _r3('coalesce(ap, 0)'), 0)})) END AS score, least(100.0, greatest(0.0, {_r('100 - ' + _r3('coalesce(ap, 0)'), 0)})) AS diagnostic_score,
  {_r3('coalesce(rw, 0)')} AS raw_penalty, {_r3('coalesce(ap, 0)')} AS applied_penalty, coalesce(n, 0) AS root_causes, results, failing, excluded_results FROM rv v LEFT JOIN (SELECT run_id, model, (sum(CAST(round(raw * 10000) AS BIGINT)) / 10000.0::DOUBLE) AS rw, (sum(CAST(round(applied * 10000) AS BIGINT)) / 10000.0::DOUBLE) AS ap, count(*) AS n FROM cap GROUP BY 1, 2) p ON p.run_id = v.run_id AND p.model = v.model
  LEFT JOIN (SELECT run_id, model, count(*) AS results, count_if(evaluation_state = 'fail') AS failing, count_if(NOT reliable) AS excluded_results FROM md GROUP BY 1, 2) q ON q.run_id = v.run_id AND q.model = v.model"""
ORACLE["score_runs"] = f"{ALL} {SCORES}"

QUERIES["score_categories"] = _simple(SC.category_breakdown)
ORACLE["score_categories"] = f"""{ALL} SELECT cc.run_id, cc.model, cc.ck AS category_key, checks, coalesce(n, 0) AS root_causes, {_r3('coalesce(rw, 0)')} AS raw_penalty, {_r3('coalesce(ap, 0)')} AS applied_penalty, weighted_coverage, primary_coverage, category_status AS score_status,
  least(100.0, greatest(0.0, {_r('100 - ' + _r3('coalesce(ap, 0)'), 0)})) AS diagnostic_score, CASE WHEN category_status NOT IN ('insufficient_coverage', 'not_applicable') THEN least(100.0, greatest(0.0, {_r('100 - ' + _r3('coalesce(ap, 0)'), 0)})) END AS score FROM cc
  LEFT JOIN (SELECT run_id, model, ck, (sum(CAST(round(raw * 10000) AS BIGINT)) / 10000.0::DOUBLE) AS rw, (sum(CAST(round(applied * 10000) AS BIGINT)) / 10000.0::DOUBLE) AS ap, count(*) AS n FROM cap GROUP BY 1, 2, 3) p ON p.run_id = cc.run_id AND p.model = cc.model AND p.ck = cc.ck LEFT JOIN (SELECT run_id, model, ck, count(*) AS checks FROM md GROUP BY 1, 2, 3) q ON q.run_id = cc.run_id AND q.model = cc.model AND q.ck = cc.ck"""

QUERIES["score_exclusions"] = _simple(SC.exclusions)
ORACLE["score_exclusions"] = f"{BASE} SELECT run_id, model, CASE WHEN conf = 'low' AND {DONE} THEN 'low_confidence' ELSE evaluation_state END AS reason, count(*) AS results, {_r('sum(cw)::DOUBLE', 3)} AS weight, count(DISTINCT check_id) AS checks FROM md WHERE NOT reliable GROUP BY 1, 2, 3"

QUERIES["score_memberships"] = _simple(SC.memberships)
ORACLE["score_memberships"] = f"{BASE}, {RC} SELECT p.run_id, p.finding_id, p.check_id, p.rck AS root_cause_key, 'rc_' || left(sha256(p.rck), 16) AS root_cause_id, cap.pc AS primary_check_id, cap.applied AS applied_penalty FROM prep p JOIN cap ON cap.run_id = p.run_id AND cap.rck = p.rck AND cap.model = 'overall' WHERE p.evaluation_state = 'fail' AND p.reliable"

KIND = f"(finding_type = 'opportunity' OR check_area = 'geo' OR regexp_matches(lower(check_id || ' ' || category), 'geo|ai crawler|ai bot|speakable|llms|webmanifest|pwa'))"
SECU = "(finding_type = 'best_practice' OR regexp_matches(lower(check_id || ' ' || category), 'security'))"
QUERIES["score_legacy"] = _simple(lambda f, r: SC.legacy_scores(f))
LEGACY = f"""SELECT run_id, model, CASE WHEN best > 0 THEN {_r('points / best * 100', 0)} END AS score, CASE WHEN conf > 0 THEN {_r('elig / conf * 100', 1)} ELSE 0.0 END AS coverage FROM (SELECT run_id, model, sum(CASE WHEN score IS NOT NULL THEN score * w END) AS points, sum(CASE WHEN score IS NOT NULL THEN 10 * w END) AS best, sum(w) AS conf, sum(CASE WHEN score IS NOT NULL THEN w END) AS elig
 FROM (SELECT *, unnest(['overall', check_area]) AS model, (CASE WHEN {KIND} THEN 0.35 WHEN {SECU} THEN 0.5 WHEN finding_type = 'info' THEN 0.2 ELSE 1.0 END)::DOUBLE AS w FROM site_findings) a GROUP BY 1, 2) b"""
ORACLE["score_legacy"] = LEGACY
QUERIES["score_legacy_gated"] = _simple(lambda f, r: SC.gated_legacy_scores(f))
ORACLE["score_legacy_gated"] = f"""SELECT run_id, model, {_r('sum(m.score * m.w) / sum(10 * m.w) * 100', 0)} AS score, count(*) AS representatives FROM (SELECT run_id, m, unnest(['overall', check_area]) AS model FROM (
  SELECT run_id, check_area, unit, min_by(struct_pack(score := score, w := w), (score, CASE priority WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 1 END, finding_id)) AS m FROM (
   SELECT *, CASE WHEN root_cause_key IS NULL THEN finding_id ELSE check_area || ':' || root_cause_key END AS unit, (CASE WHEN {KIND} THEN 0.25 WHEN {SECU} THEN 0.4 WHEN finding_type = 'info' THEN 0.15 ELSE 1.0 END)::DOUBLE * (CASE priority WHEN 'High' THEN 1.5 WHEN 'Low' THEN 0.25 ELSE 0.75 END)::DOUBLE AS w FROM site_findings WHERE {DONE} AND score IS NOT NULL) a GROUP BY 1, 2, 3) b) c GROUP BY 1, 2"""
QUERIES["score_stored_runs"] = _simple(SC.stored_scores)
ORACLE["score_stored_runs"] = f"""{ALL}, cur AS ({SCORES}), leg AS ({LEGACY}) SELECT r.run_id, CASE WHEN r.scoring_version IS NOT NULL THEN cur.score ELSE leg.score END AS score, CASE WHEN r.scoring_version IS NOT NULL THEN cur.score_status ELSE 'historical_unknown' END AS score_status
 FROM finding_runs r JOIN cur ON cur.run_id = r.run_id AND cur.model = 'overall' JOIN leg ON leg.run_id = r.run_id AND leg.model = 'overall'"""

QUERIES["evidence_render_context"] = lambda spark, folder: CV.render_context(Site(spark, folder).table("site_url_metrics"))
ORACLE["evidence_render_context"] = """SELECT run_id, count(*) AS planned, count_if(render_need = 'render_required') AS required, count_if(browser_run = 1) AS rendered, count_if(render_decision = 'render_budget_exhausted') AS exhausted, count_if(render_decision = 'render_unavailable') AS unavailable,
 count_if(render_need = 'render_recommended' AND browser_run = 0) AS optional_open, count_if(render_need = 'render_required' AND browser_run = 0) AS missing_required FROM site_url_metrics GROUP BY run_id"""

ORACLE = {name: with_views(text) for name, text in ORACLE.items()}
