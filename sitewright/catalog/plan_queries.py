"""Queries over render planning, run metrics, the URL frontier and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewright.catalog import inputs
from sitewright.catalog.site_views import Site, with_views
from sitewright.functions import url as U
from sitewright.operators import frontier as FR
from sitewright.operators import rendering as RN

QUERIES = {}
ORACLE = {}
c = F.col


def _simple(build):
    return lambda spark, folder: build(Site(spark, folder))


FACTS = """(SELECT *, coalesce(word_count_raw, 0) AS vis, raw_main_words AS mn, main_regions > 0 AS mp, CASE WHEN main_regions > 0 THEN raw_main_words ELSE word_count_raw END AS cmp, coalesce(indexable, 1) = 1 AS ix, coalesce(indexable, 1) = 1 AND page_type IN ('homepage', 'article', 'product', 'category', 'service', 'location', 'blog_index') AS ct,
  (script_count >= 1 OR hydration_bytes > 0) AS scr, title <> '' AS ht, canonical_values IS NOT NULL AS hc, html_lang IS NOT NULL AS hl FROM site_pages)"""
F1 = f"""(SELECT *, (ct OR (ix AND page_type = 'other' AND cmp <= 49 AND h1_count = 0 AND scr)) AND cmp <= 49 AND vis <= 99 AND (h1_count = 0 OR internal_links < 3) AS shell, ct AND mp AND mn < 30 AS nomain, ct AND cmp <= 49 AND h1_count = 0 AS gap, vis <= 14 AND cmp <= 14 AND h1_count = 0 AS empty, ct AND cmp <= 49 AND vis <= 99 AND h1_count > 0 AND internal_links >= 2 AS thin FROM {FACTS} f0)"""
PLUS = [("empty", 6), ("thin", 4), ("ix AND NOT ht", 3), ("ix AND NOT hc", 2), ("ix AND NOT hl", 1), ("ix AND h1_count = 0", 1), ("ct AND internal_links < 2", 1)]
MINUS = [("mp AND mn >= 100", 4), ("vis >= 100", 4), ("h1_count > 0", 2), ("ht AND hc AND hl", 2), ("internal_links >= 2", 1), ("schema_types <> ''", 1), ("page_type IN ('legal', 'search', 'filter', 'utility') AND ht AND h1_count > 0 AND cmp >= 15", 8), ("NOT ix", 8)]
SUMP = " + ".join(f"CASE WHEN {k} THEN {w} ELSE 0 END" for k, w in PLUS)
SUMM = " + ".join(f"CASE WHEN {k} THEN {w} ELSE 0 END" for k, w in MINUS)
NEED = f"""(SELECT *, CASE WHEN decision = 'render_required' THEN 300 + greatest(0, 100 - cmp) + hard * 10 WHEN decision = 'render_recommended' THEN 200 + score ELSE 100 - score END AS strength, CASE WHEN decision = 'render_required' OR (decision = 'render_not_required' AND score <= 0) THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN cmp = 0 THEN 'empty' WHEN cmp < 50 THEN 'thin' WHEN cmp < 100 THEN 'moderate' ELSE 'substantial' END AS raw_class FROM (SELECT *, CASE WHEN hard > 0 OR ((empty OR thin) AND scr) THEN 'render_required' WHEN score >= 4 THEN 'render_recommended' ELSE 'render_not_required' END AS decision FROM (
  SELECT *, shell::INT + nomain::INT + gap::INT AS hard, plus + CASE WHEN scr AND plus > 0 THEN 1 ELSE 0 END - ({SUMM}) AS score FROM (SELECT *, {SUMP} AS plus FROM {F1} f1) f2) f3) f4)"""


def _need(s):
    pages = inputs.pages(s).withColumn("cluster_key", F.concat("page_type", F.lit(":"), (c("page_id") % 5).cast("string")))
    return RN.render_need(pages)


QUERIES["render_need"] = _simple(lambda s: _need(s).select("run_id", "page_id", "decision", "confidence", "score", "strength", "raw_class"))
ORACLE["render_need"] = f"SELECT run_id, page_id, decision, confidence, score, strength, raw_class FROM {NEED} n"
HARD1 = "(((ct OR (ix AND page_type = 'other' AND cmp < 50 AND h1_count = 0 AND scr)) AND cmp < 50 AND vis < 100 AND (h1_count = 0 OR internal_links < 3)) OR (ct AND mp AND mn < 30) OR (ct AND cmp < 50 AND h1_count = 0))"
UT1 = "(page_type IN ('legal', 'search', 'filter', 'utility') AND ht AND h1_count > 0 AND cmp >= 15)"
V1 = f"""(SELECT *, CASE WHEN {HARD1} THEN 'render_required' WHEN {UT1} THEN 'render_not_required' WHEN cmp >= 100 AND h1_count > 0 AND ht AND ms = 0 THEN 'render_not_required' ELSE 'render_recommended' END AS decision FROM (SELECT *, (CASE WHEN ht THEN 0 ELSE 1 END) + (CASE WHEN coalesce(meta_description, '') <> '' THEN 0 ELSE 1 END) + (CASE WHEN hc THEN 0 ELSE 1 END) + (CASE WHEN hl THEN 0 ELSE 1 END) AS ms, ct AND internal_links < 2 AS few FROM {FACTS} a) b)"""
QUERIES["render_need_first_version"] = _simple(lambda s: RN.render_need_v1(inputs.pages(s)))
ORACLE["render_need_first_version"] = f"SELECT run_id, page_id, decision, CASE WHEN decision = 'render_required' THEN 300 + greatest(0, 100 - cmp) + ms * 8 + few::INT * 5 WHEN decision = 'render_not_required' THEN 0 WHEN (ix AND ms > 0) OR h1_count = 0 OR few THEN 200 + ms * 8 + CASE WHEN h1_count = 0 THEN 10 ELSE 0 END + few::INT * 5 ELSE 190 END AS strength FROM {V1} v"

KEYN = f"(SELECT *, page_type || ':' || (page_id % 5) AS cluster_key FROM {NEED} n0)"
USABLE = "(status_code BETWEEN 200 AND 299 AND initial_status_code BETWEEN 200 AND 299 AND coalesce(content_type LIKE '%html%', true))"
CONF = f"""(SELECT k.* EXCLUDE (decision, strength), pr.page_id IS NOT NULL AS promoted, CASE WHEN pr.page_id IS NOT NULL THEN 'render_recommended' ELSE k.decision END AS decision, CASE WHEN pr.page_id IS NOT NULL THEN greatest(180, k.strength) ELSE k.strength END AS strength FROM {KEYN} k LEFT JOIN (SELECT run_id, page_id FROM (
  SELECT a.run_id, a.page_id, row_number() OVER (PARTITION BY a.run_id ORDER BY CASE WHEN t.cluster_key IS NULL THEN 0 ELSE 1 END, a.url) AS rn FROM {KEYN} a JOIN (SELECT run_id FROM {KEYN} p WHERE {USABLE} AND decision <> 'render_not_required' GROUP BY 1 HAVING count(*) < 2 AND count_if(decision = 'render_required') > 0) sh ON sh.run_id = a.run_id
  LEFT JOIN (SELECT DISTINCT run_id, cluster_key FROM {KEYN} q WHERE {USABLE} AND decision <> 'render_not_required') t ON t.run_id = a.run_id AND t.cluster_key = a.cluster_key WHERE {USABLE} AND a.decision = 'render_not_required') r WHERE rn = 1) pr ON pr.run_id = k.run_id AND pr.page_id = k.page_id)"""
QUERIES["render_minimum_confirmation"] = _simple(lambda s: RN.confirm_minimum(_need(s)).select("run_id", "page_id", "decision", "strength", "promoted"))
ORACLE["render_minimum_confirmation"] = f"SELECT run_id, page_id, decision, strength, promoted FROM {CONF} x"
PLAN = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN decision = 'render_required' THEN 3 ELSE 2 END DESC, least(ord, 2), strength DESC, url, page_id) AS position FROM (SELECT *, row_number() OVER (PARTITION BY run_id, cluster_key ORDER BY url, page_id) - 1 AS ord FROM {CONF} c0) c1 WHERE decision <> 'render_not_required') c2 WHERE position <= 4)"""
QUERIES["render_plan"] = _simple(lambda s: RN.render_plan(RN.confirm_minimum(_need(s)), 10, 5000, 20000).drop("url"))
ORACLE["render_plan"] = f"SELECT run_id, page_id, decision, CAST(least(ord, 2) AS INT) AS ordinal, strength, position FROM {PLAN} p"
QUERIES["render_plan_summary"] = _simple(lambda s: (lambda k: RN.plan_summary(k, RN.render_plan(k, 10, 5000, 20000)))(RN.confirm_minimum(_need(s))))
ORACLE["render_plan_summary"] = f"SELECT a.run_id, urls, not_required, coalesce(n, 0) AS planned, urls - not_required - coalesce(n, 0) AS excluded, coalesce(n, 0) * 5000 AS render_ms, coalesce(n, 0) * 30000 AS bytes FROM (SELECT run_id, count(*) AS urls, count_if(decision = 'render_not_required') AS not_required FROM {CONF} x GROUP BY 1) a LEFT JOIN (SELECT run_id, count(*) AS n FROM {PLAN} p GROUP BY 1) b ON b.run_id = a.run_id"
QUERIES["render_template_evidence"] = _simple(lambda s: RN.template_evidence(s.table("site_samples").select("run_id", "cluster_key", (c("page_id") % 4 != 1).alias("same_page_type"), (c("page_id") % 6 != 2).alias("same_structure"), (c("browser_status") == "success").alias("render_succeeded"), (c("page_id") % 10 == 3).alias("difference"))))
ORACLE["render_template_evidence"] = "SELECT run_id, cluster_key, CASE WHEN n < 2 THEN 'insufficient_evidence' WHEN b > 0 THEN 'invalidated' ELSE 'confirmed_raw_sufficient_template' END AS status FROM (SELECT run_id, cluster_key, count_if(g) AS n, count_if(g AND page_id % 10 = 3) AS b FROM (SELECT *, page_id % 4 <> 1 AND page_id % 6 <> 2 AND browser_status = 'success' AS g FROM site_samples) x GROUP BY 1, 2) y"

QUERIES["settling_verdicts"] = _simple(lambda s: RN.settling(s.table("site_snapshots")))
ORACLE["settling_verdicts"] = """WITH s AS (SELECT *, coalesce(fingerprint <> lag(fingerprint) OVER (PARTITION BY snapshot_key ORDER BY seq), false) AS ch FROM site_snapshots), l AS (SELECT snapshot_key, count(*) AS n, max(CASE WHEN ch THEN seq END) AS lc, max(elapsed_ms) AS el, max_by(loading_indicators, seq) AS li, max_by(visible_words, seq) AS vw FROM s GROUP BY 1)
SELECT l.snapshot_key, n AS snapshots, k AS stable_count, CASE WHEN k >= 3 AND el >= 4000 AND li = 0 THEN CASE WHEN vw > 0 THEN 'settled' ELSE 'content_remained_empty' END WHEN lc IS NOT NULL THEN 'rendering_unstable' ELSE 'settling_timeout' END AS status FROM l JOIN (SELECT s.snapshot_key, count(*) AS k FROM s JOIN l ON l.snapshot_key = s.snapshot_key WHERE lc IS NULL OR seq >= lc GROUP BY 1) t ON t.snapshot_key = l.snapshot_key"""
QUERIES["settling_change_timing"] = _simple(lambda s: RN.change_timing(s.table("site_snapshots")))
ORACLE["settling_change_timing"] = """WITH b AS (SELECT snapshot_key, min(elapsed_ms) AS st FROM site_snapshots GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT s.*, elapsed_ms - st AS age, lim FROM site_snapshots s JOIN b ON b.snapshot_key = s.snapshot_key CROSS JOIN (SELECT unnest([1000, 2000, 3000, 4000, 5000, 6000]) AS lim) l), f AS (SELECT snapshot_key, lim, max_by(fingerprint, seq) FILTER (age <= lim) AS fb FROM r GROUP BY 1, 2)
SELECT f.lim AS limit_ms, count(*) AS measured, count_if(EXISTS (SELECT 1 FROM r WHERE r.snapshot_key = f.snapshot_key AND r.lim = f.lim AND r.age > r.lim AND r.fingerprint <> f.fb)) AS changed FROM f GROUP BY 1"""
QUERIES["settling_stability_share"] = _simple(lambda s: RN.stability_share(s.table("site_snapshots")))
ORACLE["settling_stability_share"] = "SELECT count(*) AS measured, count_if(n = 1) AS steady FROM (SELECT snapshot_key, count(DISTINCT fingerprint) AS n FROM site_snapshots GROUP BY 1) x"


def _events(s):
    return s.table("events").select(
        F.col("user_id").alias("page_key"), F.when(c("event_type") == "error", "console_error").when(c("event_type") == "view", "pageerror").when(c("event_type") == "click", "csp_violation").otherwise("request_failed").alias("type"),
        F.when(c("event_id") % 2 == 0, "initial").otherwise("settled").alias("phase"), F.concat(F.lit("m"), (c("event_id") % 40).cast("string")).alias("message"), c("event_id").alias("observed_at"), F.when(c("user_id") % 5 == 1, 1).otherwise(0).alias("content_missing"))


EV = "(SELECT user_id AS page_key, CASE event_type WHEN 'error' THEN 'console_error' WHEN 'view' THEN 'pageerror' WHEN 'click' THEN 'csp_violation' ELSE 'request_failed' END AS type, CASE WHEN event_id % 2 = 0 THEN 'initial' ELSE 'settled' END AS phase, 'm' || (event_id % 40) AS message, event_id, user_id % 5 = 1 AS cm FROM events)"
EVM = f"(SELECT page_key, type, phase, message, count(*) AS count, min(event_id) AS first_at, max(event_id) AS last_at, CASE WHEN bool_or(cm) AND type IN ('pageerror', 'request_failed') THEN 'content_unavailable' WHEN type = 'csp_violation' THEN 'security_policy' ELSE 'diagnostic' END AS impact FROM {EV} e GROUP BY 1, 2, 3, 4)"
QUERIES["browser_events"] = _simple(lambda s: RN.browser_events(_events(s)))
ORACLE["browser_events"] = f"SELECT * FROM {EVM} m"
QUERIES["browser_console_pages"] = _simple(lambda s: RN.console_results(_events(s)))
ORACLE["browser_console_pages"] = f"WITH m AS (SELECT * FROM {EVM} x), s AS (SELECT message, count(DISTINCT page_key) AS p FROM m WHERE type = 'console_error' GROUP BY 1) SELECT page_key, count(*) AS events, bool_or(impact = 'content_unavailable') AS content_lost FROM m LEFT JOIN s ON s.message = m.message WHERE impact = 'content_unavailable' OR (type = 'console_error' AND (count >= 2 OR p >= 2)) GROUP BY 1"

QUERIES["metrics_distribution"] = _simple(lambda s: RN.distribution(s.table("site_url_metrics"), "settling_ms"))
ORACLE["metrics_distribution"] = """SELECT run_id, g AS grouping, v AS value, count(*) AS rows, count(x) AS measured, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.75), 4) AS p75, round(quantile_cont(x, 0.9), 4) AS p90, round(quantile_cont(x, 0.95), 4) AS p95, max(x) AS maximum FROM (
 SELECT run_id, settling_ms AS x, unnest(['all', 'page_type', 'raw_content_class', 'render_decision', 'settling_status']) AS g, unnest(['', page_type, raw_content_class, render_decision, settling_status]) AS v FROM site_url_metrics) y GROUP BY 1, 2, 3"""
RM = """(SELECT run_id, count(*) AS urls, count_if(browser_run = 1) AS rendered, count_if(browser_run = 0 AND render_decision = 'render_not_required') AS avoided, count_if(render_decision = 'render_budget_exhausted') AS exhausted, count_if(settling_status = 'settling_timeout') AS timeouts, count_if(settling_status = 'rendering_unstable') AS unstable, sum(fetch_ms) AS fetch_ms,
 CAST(sum(CASE WHEN browser_run = 1 THEN provenance_bytes END) AS BIGINT) AS bytes, round(quantile_cont(fetch_ms, 0.5), 4) AS p50_fetch_ms, round(quantile_cont(CASE WHEN browser_run = 1 THEN navigation_ms + settling_ms END, 0.5), 4) AS p50_render_ms, round(quantile_cont(CASE WHEN browser_run = 1 THEN navigation_ms + settling_ms END, 0.9), 4) AS p90_render_ms, round(avg(CASE WHEN browser_run = 1 THEN provenance_bytes END), 4) AS bytes_per_render FROM site_url_metrics GROUP BY 1)"""
QUERIES["metrics_runs"] = _simple(lambda s: RN.run_metrics(s.table("site_url_metrics")))
ORACLE["metrics_runs"] = f"SELECT * FROM {RM} r"
QUERIES["metrics_forecasts"] = _simple(lambda s: RN.forecasts(s.table("site_url_metrics")).select("run_id", "url_count", c("rendered").cast("bigint").alias("rendered"), F.round("p50_ms", 2).alias("p50_ms"), F.round("p90_ms", 2).alias("p90_ms"), F.round("bytes", 1).alias("bytes"), "slow"))
ORACLE["metrics_forecasts"] = f"""SELECT run_id, url_count, rendered, round(url_count * p50_fetch_ms + rendered * coalesce(p50_render_ms, 0), 2) AS p50_ms, round(url_count * p50_fetch_ms + rendered * coalesce(p90_render_ms, 0), 2) AS p90_ms, round(rendered * coalesce(bytes_per_render, 0), 1) AS bytes, url_count >= 1000 AS slow FROM (SELECT m.* EXCLUDE (rendered), u AS url_count, CAST(ceil(u * (m.rendered * 1.0::DOUBLE / urls)) AS BIGINT) AS rendered FROM {RM} m CROSS JOIN (SELECT unnest([10, 100, 1000, 10000]) AS u) s) x"""
QUERIES["metrics_budget"] = _simple(lambda s: RN.budget_usage(s.table("site_url_metrics"), 4, 12000))
ORACLE["metrics_budget"] = "SELECT *, CASE WHEN rendered >= 4 THEN 'max_rendered_urls' WHEN used_ms >= 12000 THEN 'max_total_render_time_ms' ELSE 'within_budget' END AS verdict FROM (SELECT run_id, count_if(browser_run = 1) AS rendered, sum(CASE WHEN browser_run = 1 THEN coalesce(navigation_ms, 0) + coalesce(settling_ms, 0) ELSE 0 END) AS used_ms, count_if(browser_run = 1 AND settling_status = 'navigation_failed') AS failures FROM site_url_metrics GROUP BY 1) x"
QUERIES["document_states"] = _simple(lambda s: RN.document_state(inputs.pages(s)).select("page_id", "effective_words", "effective_h1", "source", F.coalesce("changed_after_initial", F.lit(False)).alias("changed_after_initial"), F.length("fingerprint").alias("fingerprint_length")))
SET = "(render_status = 'success' AND settling_status IN ('settled', 'content_remained_empty'))"
ORACLE["document_states"] = f"SELECT page_id, CASE WHEN coalesce({SET}, false) THEN settled_main_words ELSE raw_main_words END AS effective_words, CASE WHEN coalesce({SET}, false) THEN greatest(h1_count, rendered_h1_count) ELSE h1_count END AS effective_h1, CASE WHEN coalesce({SET}, false) THEN 'settled' ELSE 'raw' END AS source, coalesce({SET}, false) AND settled_main_words <> initial_main_words AS changed_after_initial, 64 AS fingerprint_length FROM site_pages"
QUERIES["storage_estimates"] = _simple(lambda s: RN.storage_estimate(s.table("site_runs")).select("run_id", "estimated_bytes"))
ORACLE["storage_estimates"] = "SELECT run_id, processed_urls * (1400 + 450 * store_all_links + 1800 * store_all_images + 2600 * store_all_resources + 500 * store_headers) AS estimated_bytes FROM site_runs"

# --- frontier
QUERIES["frontier_next_urls"] = _simple(lambda s: FR.next_urls(s.table("site_queue"), 3).select("run_id", "queue_id", "priority", "position"))
ORACLE["frontier_next_urls"] = "SELECT run_id, queue_id, priority, position FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY priority DESC, discovered_at, queue_id) AS position FROM site_queue WHERE status = 'pending') x WHERE position <= 3"
QUERIES["frontier_counters"] = _simple(lambda s: FR.counters(s.table("site_queue")))
ORACLE["frontier_counters"] = "SELECT run_id, count(*) AS discovered, " + ", ".join(f"count_if(status = '{n}') AS {n}" for n in ("done", "failed", "skipped", "pending", "processing", "retry_wait")) + ", count_if(status IN ('done', 'failed')) AS processed, min(CASE WHEN status = 'retry_wait' THEN next_attempt_at END) AS next_attempt_at FROM site_queue GROUP BY 1"
QUERIES["frontier_status"] = _simple(lambda s: FR.status_counts(FR.reset_processing(FR.skip_remaining(s.table("site_queue")))))
ORACLE["frontier_status"] = "SELECT run_id, CASE WHEN status IN ('pending', 'retry_wait') THEN 'skipped' WHEN status = 'processing' THEN 'pending' ELSE status END AS status, count(*) AS urls FROM site_queue GROUP BY 1, 2"
QUERIES["frontier_retries"] = _simple(lambda s: FR.retries(s.table("site_queue"), 1700200000))
RET = "((last_status_code IN (408, 429, 500, 502, 503, 504) OR last_error_type IN ('timeout', 'dns_error')) AND attempts < 3)"
DEL = "least(30000, 1000 * pow(2, greatest(0, attempts - 1)))"
ORACLE["frontier_retries"] = f"SELECT run_id, queue_id, coalesce({RET}, false) AS retry, CAST(CASE WHEN {RET} THEN {DEL} END AS BIGINT) AS delay_ms, CAST(CASE WHEN {RET} THEN 1700200000 + floor({DEL} / 1000) END AS BIGINT) AS retry_at FROM site_queue WHERE status IN ('failed', 'retry_wait')"
QUERIES["frontier_attempts"] = _simple(lambda s: FR.attempt_history(s.table("site_attempts")))
ORACLE["frontier_attempts"] = """
SELECT url_key, count(*) AS attempts, CAST(least(5, count(*)) AS INT) AS kept, CASE WHEN count(final_status) = 0 THEN 'technical_error' WHEN count(DISTINCT final_status) > 1 OR count(error_type) > 0 THEN 'transient'
  WHEN max(final_status) IN (429, 500, 502, 503, 504) AND count(final_status) < 2 THEN 'insufficient_evidence' ELSE 'confirmed' END AS stability,
  string_agg(coalesce(CAST(final_status AS VARCHAR), error_type), ',' ORDER BY attempt) FILTER (rn <= 5) AS outcomes
FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY attempt DESC) AS rn FROM site_attempts) x GROUP BY 1"""
QUERIES["frontier_health"] = _simple(lambda s: FR.run_health(s.table("site_queue"), 1700200000))
ORACLE["frontier_health"] = "SELECT run_id, count(*) AS discovered, count_if(status IN ('done', 'failed')) AS processed, count_if(status = 'pending') AS pending, count_if(status = 'processing') AS processing, 1700200000 - max(discovered_at) AS age_seconds, count_if(status = 'processing') > 0 AS active FROM site_queue GROUP BY 1"
QUERIES["frontier_admission"] = _simple(lambda s: FR.admit(s.table("site_links").select("run_id", F.col("target_url").alias("url"), F.col("normalized_target_url").alias("normalized_url"), (c("page_id") % 5).cast("int").alias("depth")), s.table("site_queue"), 3, (), ("social", "/media/")))
ORACLE["frontier_admission"] = """SELECT d.run_id, d.normalized_url, d.m.url AS url, d.m.depth AS depth, occurrences, CASE WHEN k.run_id IS NOT NULL THEN 'duplicate' WHEN d.m.depth > 3 THEN 'max_depth' WHEN lower(d.m.url) LIKE '%social%' OR lower(d.m.url) LIKE '%/media/%' THEN 'excluded_pattern' ELSE 'admitted' END AS outcome FROM (
 SELECT run_id, normalized_target_url AS normalized_url, min_by(struct_pack(url := target_url, depth := CAST(page_id % 5 AS INT)), (CAST(page_id % 5 AS INT), target_url)) AS m, count(*) AS occurrences FROM site_links GROUP BY 1, 2) d LEFT JOIN (SELECT DISTINCT run_id, normalized_url FROM site_queue) k ON k.run_id = d.run_id AND k.normalized_url = d.normalized_url"""

# --- maintenance
QUERIES["table_upsert"] = _simple(lambda s: FR.upsert(s.table("base_pages"), s.table("compare_pages"), ["run_id", "normalized_url"], "page_id").select("run_id", "normalized_url", "page_id", "status_code", "title"))
ORACLE["table_upsert"] = "SELECT run_id, normalized_url, page_id, status_code, title FROM (SELECT *, row_number() OVER (PARTITION BY run_id, normalized_url ORDER BY side DESC, page_id DESC) AS rn FROM (SELECT run_id, normalized_url, page_id, status_code, title, 0 AS side FROM base_pages UNION ALL SELECT run_id, normalized_url, page_id, status_code, title, 1 FROM compare_pages) x) y WHERE rn = 1"
QUERIES["table_replace_children"] = _simple(lambda s: FR.replace_children(s.table("site_links").select("run_id", "source_url", "href"), s.table("site_pages").where("depth = 1").select("run_id", F.col("url").alias("source_url"), F.lit("/new").alias("href")), ["run_id", "source_url"]).groupBy("run_id", "href").agg(F.count(F.lit(1)).alias("links")))
ORACLE["table_replace_children"] = "SELECT run_id, href, count(*) AS links FROM (SELECT run_id, source_url, href FROM site_links l WHERE NOT EXISTS (SELECT 1 FROM site_pages p WHERE p.depth = 1 AND p.run_id = l.run_id AND p.url = l.source_url) UNION ALL SELECT run_id, url, '/new' FROM site_pages WHERE depth = 1) x GROUP BY 1, 2"
QUERIES["table_append_absent"] = _simple(lambda s: FR.append_absent(s.table("base_pages").select("run_id", "normalized_url"), s.table("compare_pages").select("run_id", "normalized_url"), ["run_id", "normalized_url"]).groupBy("run_id").agg(F.count(F.lit(1)).alias("urls")))
ORACLE["table_append_absent"] = "SELECT run_id, count(*) AS urls FROM (SELECT run_id, normalized_url FROM base_pages UNION ALL SELECT DISTINCT run_id, normalized_url FROM compare_pages c WHERE NOT EXISTS (SELECT 1 FROM base_pages b WHERE b.run_id = c.run_id AND b.normalized_url = c.normalized_url)) x GROUP BY 1"
QUERIES["table_without_runs"] = _simple(lambda s: FR.without_runs(s.table("site_pages"), s.table("site_runs").where("status = 'failed'")).groupBy("run_id").agg(F.count(F.lit(1)).alias("pages")))
ORACLE["table_without_runs"] = "SELECT run_id, count(*) AS pages FROM site_pages WHERE run_id NOT IN (SELECT run_id FROM site_runs WHERE status = 'failed') GROUP BY 1"
QUERIES["table_keep_collected"] = _simple(lambda s: FR.keep_collected(s.table("site_findings").where("review_status is not null").select("run_id", "check_id", "finding_id"), s.table("site_findings").where("review_status is null").select("run_id", "check_id", "finding_id"), s.table("site_findings").where("check_id like '%console%'").select("check_id")).groupBy("run_id", "check_id").agg(F.count(F.lit(1)).alias("results")))
ORACLE["table_keep_collected"] = "WITH k AS (SELECT run_id, check_id, finding_id FROM site_findings WHERE review_status IS NOT NULL AND check_id LIKE '%console%') SELECT run_id, check_id, count(*) AS results FROM (SELECT * FROM k UNION ALL SELECT run_id, check_id, finding_id FROM site_findings f WHERE review_status IS NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.run_id = f.run_id AND k.check_id = f.check_id)) x GROUP BY 1, 2"
QUERIES["table_scope_violations"] = _simple(lambda s: FR.scope_violations({"pages": (s.table("site_pages"), "url"), "links": (s.table("site_links"), "target_url"), "resources": (s.table("site_resources"), "resource_url")}, s.table("site_runs").select("run_id", F.col("input_domain").alias("host")), U.host))
ORACLE["table_scope_violations"] = "SELECT run_id, table_name, url, position FROM (SELECT *, row_number() OVER (PARTITION BY run_id, table_name ORDER BY url) AS position FROM (SELECT DISTINCT run_id, table_name, url FROM (SELECT run_id, 'pages' AS table_name, url FROM site_pages UNION ALL SELECT run_id, 'links', target_url FROM site_links UNION ALL SELECT run_id, 'resources', resource_url FROM site_resources) a WHERE lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) <> run_id) b) c WHERE position <= 25"
QUERIES["table_page_listing"] = _simple(lambda s: FR.page_of(s.table("site_pages").select("run_id", "page_id", "url"), [F.asc("url"), F.asc("page_id")], 2, 50))
ORACLE["table_page_listing"] = "SELECT run_id, page_id, url FROM site_pages ORDER BY url, page_id LIMIT 50 OFFSET 50"
QUERIES["table_statistics"] = _simple(lambda s: FR.table_statistics({"pages": s.table("site_pages").select("run_id", "url", "title", "page_id"), "links": s.table("site_links").select("source_url", "target_url"), "documents": s.table("documents").select("text", "doc_id")}))
ORACLE["table_statistics"] = "SELECT 'pages' AS table_name, count(*) AS rows, CAST(sum(strlen(run_id)) + sum(strlen(url)) + sum(strlen(title)) AS BIGINT) AS text_bytes FROM site_pages UNION ALL SELECT 'links', count(*), CAST(sum(strlen(source_url)) + sum(strlen(target_url)) AS BIGINT) FROM site_links UNION ALL SELECT 'documents', count(*), CAST(sum(strlen(text)) AS BIGINT) FROM documents"
QUERIES["table_storage_projection"] = _simple(lambda s: FR.storage_projection(FR.table_statistics({"documents": s.table("documents").select("text")}), c("rows")))
ORACLE["table_storage_projection"] = "SELECT u AS urls, CAST(round(b * 1.0::DOUBLE / n * u, 0) AS BIGINT) AS projected_bytes, CASE WHEN round(b * 1.0::DOUBLE / n * u, 0) > 10737418240 THEN 'high' WHEN round(b * 1.0::DOUBLE / n * u, 0) > 1073741824 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT sum(strlen(text)) AS b, count(*) AS n FROM documents) d CROSS JOIN (SELECT unnest([10000, 50000, 500000]) AS u) s"

ORACLE = {name: with_views(text) for name, text in ORACLE.items()}
