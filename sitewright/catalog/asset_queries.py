"""Queries over robots, sitemap and llms.txt files, host probes and structured data rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewright.catalog import inputs
from sitewright.catalog.oracle import HTML
from sitewright.catalog.site_views import Site, with_views
from sitewright.config import AI_BOTS
from sitewright.functions import url as U
from sitewright.operators import assets as AS
from sitewright.operators import hosts as HO
from sitewright.operators import structured_data as SD

QUERIES = {}
ORACLE = {}
c = F.col


def _simple(build):
    return lambda spark, folder: build(Site(spark, folder))


def _paths():
    path = F.concat(U.path(c("page_url")), F.when(U.query(c("page_url")) != "", F.concat(F.lit("?"), U.query(c("page_url")))).otherwise(F.lit("")))
    return F.array(F.lit("/"), F.lit("/llms.txt"), path)


QUERIES["robots_directives"] = _simple(lambda s: AS.robots_directives(s.table("asset_robots")).drop("url", "run_id"))
ORACLE["robots_directives"] = """SELECT asset_id, CAST(line AS INT) AS line, name, value, CAST(CASE WHEN name = '' AND ln NOT LIKE '%:%' THEN g ELSE g END AS INT) AS group_id, CASE WHEN ln NOT LIKE '%:%' THEN 'malformed_directive' WHEN name IN ('allow', 'disallow') AND g = 0 THEN 'rule_without_user_agent' END AS error,
  CASE WHEN name IN ('allow', 'disallow') THEN CAST(strlen(regexp_replace(replace(value, '*', ''), '[$]$', '')) AS INT) END AS specificity FROM (
  SELECT *, coalesce(sum(CASE WHEN name = 'user-agent' AND coalesce(prev, '') <> 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY line), 0) AS g FROM (
   SELECT *, lag(name) OVER (PARTITION BY asset_id, (ln LIKE '%:%') ORDER BY line) AS prev FROM (
    SELECT asset_id, line, trim(regexp_replace(raw, '#.*$', '')) AS ln, CASE WHEN raw LIKE '%:%' THEN lower(trim(split_part(trim(regexp_replace(raw, '#.*$', '')), ':', 1))) ELSE '' END AS name, CASE WHEN raw LIKE '%:%' THEN trim(substr(trim(regexp_replace(raw, '#.*$', '')), strpos(trim(regexp_replace(raw, '#.*$', '')), ':') + 1)) ELSE '' END AS value
    FROM (SELECT page_id0 AS asset_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS line FROM (SELECT asset_id AS page_id0, string_split(content, chr(10)) AS ls FROM asset_robots) a0) a1) a2 WHERE ln <> '') a3) a4"""

STATE = """CASE WHEN status_code IS NULL OR measurement_state = 'technical_error' THEN 'technical_error' WHEN measurement_state = 'unstable' OR status_code >= 500 THEN 'temporarily_unreachable' WHEN status_code = 404 THEN 'absent' WHEN status_code = 403 THEN 'access_restricted' WHEN status_code >= 300 THEN 'unexpected_status'
 WHEN truncated = 1 THEN 'truncated' WHEN content LIKE '<!DOCTYPE%' THEN 'invalid_html_representation' WHEN content = '' THEN 'valid_empty' ELSE 'valid' END"""
QUERIES["robots_states"] = _simple(lambda s: AS.robots_state(s.table("asset_robots")).select("asset_id", "robots_state", "crawl_default"))
ORACLE["robots_states"] = f"SELECT asset_id, st AS robots_state, CASE WHEN st IN ('absent', 'valid_empty') THEN 'allowed' WHEN st = 'valid' THEN 'rules_apply' ELSE 'unknown' END AS crawl_default FROM (SELECT *, {STATE} AS st FROM asset_robots) x"
QUERIES["robots_sitemap_lines"] = _simple(lambda s: AS.sitemap_directives(s.table("asset_robots")).select("asset_id", "key", "line", "valid", F.coalesce("same_host", F.lit(False)).alias("same_host")))
ORACLE["robots_sitemap_lines"] = "SELECT asset_id, concat('https://', run_id, '/sitemap.xml') AS key, 5 AS line, true AS valid, true AS same_host FROM asset_robots WHERE asset_id % 6 = 1 UNION ALL SELECT asset_id, 'invalid:/relative.xml', 6, false, false FROM asset_robots WHERE asset_id % 6 = 1"

# Hand-worked verdicts per file variant, bot and page path.
PATHQ = "regexp_extract(page_url, '^https?://[^/?#]+([^#]*)', 1)"
BOTS = "(SELECT unnest(['" + "', '".join(AI_BOTS) + "']) AS bot)"
POL = f"""(SELECT run_id, asset_id, bot, v <> 2 OR html AS parser_valid, CASE WHEN html OR v = 3 THEN 'default' WHEN v IN (0, 2, 5) THEN 'wildcard' WHEN v = 1 AND bot IN ('GPTBot', 'CCBot') THEN 'explicit' WHEN v = 1 THEN 'wildcard' WHEN bot IN ('ClaudeBot', 'PerplexityBot') THEN 'explicit' ELSE 'default' END AS policy_source, CAST(3 AS INT) AS tested_paths,
  CAST(CASE WHEN html OR v IN (2, 3) THEN 0 WHEN v = 0 THEN 3 WHEN v = 1 AND bot IN ('GPTBot', 'CCBot') THEN 0 WHEN v = 1 THEN CASE WHEN p LIKE '/blog%' OR p LIKE '/wissen%' THEN 1 ELSE 0 END WHEN v = 4 AND bot = 'ClaudeBot' THEN CASE WHEN p LIKE '/%.html' THEN 1 ELSE 0 END WHEN v = 4 AND bot = 'PerplexityBot' THEN 2 WHEN v = 4 THEN 0
   ELSE CASE WHEN p LIKE '/search%' OR (p LIKE '/suche%' AND p NOT LIKE '/suche/en%') THEN 1 ELSE 0 END END AS INT) AS blocked_paths FROM (SELECT a.*, b.bot, asset_id % 6 AS v, content LIKE '<!DOCTYPE%' AS html, {PATHQ} AS p FROM {{0}} a CROSS JOIN {BOTS} b) x)"""
POLS = f"""(SELECT *, CASE WHEN status = 'blocked' AND policy_source = 'explicit' THEN 'blocked_explicitly' WHEN status = 'blocked' THEN 'blocked_by_wildcard' WHEN status = 'explicitly_allowed' THEN 'allowed_explicitly' WHEN policy_source = 'wildcard' THEN 'inherited_wildcard_allowed' ELSE 'not_mentioned_default_allowed' END AS policy_status FROM (
  SELECT *, CASE WHEN NOT parser_valid THEN 'unclear' WHEN blocked_paths > 0 THEN 'blocked' WHEN policy_source = 'explicit' THEN 'explicitly_allowed' ELSE 'implicitly_allowed' END AS status FROM {POL}) y)"""
QUERIES["robots_bot_policies"] = _simple(lambda s: AS.bot_policies(s.table("asset_robots"), _paths()))
ORACLE["robots_bot_policies"] = f"SELECT * FROM {POLS.format('asset_robots')} q"
QUERIES["robots_policy_summary"] = _simple(lambda s: AS.policy_summary(AS.bot_policies(s.table("asset_robots"), _paths())))
ORACLE["robots_policy_summary"] = f"SELECT run_id, asset_id, count_if(status = 'explicitly_allowed') AS explicitly_allowed, count_if(status = 'implicitly_allowed') AS implicitly_allowed, count_if(status = 'blocked') AS blocked, count_if(status = 'unclear') AS unclear FROM {POLS.format('asset_robots')} q GROUP BY 1, 2"

LAST = "(SELECT *, {1} AS st FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY asset_id DESC) AS rn FROM {0}) l0 WHERE rn = 1)".format
OUT = "SELECT run_id, check_id, ev AS evaluation_state, CASE ev WHEN 'pass' THEN 'OK' WHEN 'fail' THEN 'Warning' ELSE 'NA' END AS status, CAST(CASE WHEN ev = 'fail' THEN aff ELSE 0 END AS BIGINT) AS affected_count FROM ({0}) o".format
QUERIES["checks_robots"] = _simple(lambda s: AS.robots_results(s.table("asset_robots"), s.table("site_runs")))
ORACLE["checks_robots"] = OUT(f"""SELECT r.run_id, k AS check_id, 1 AS aff, CASE WHEN st IS NULL THEN 'not_executed' WHEN k = 'tech.sitemap_in_robots' AND st = 'absent' THEN 'not_applicable' WHEN st = 'technical_error' THEN 'technical_error' WHEN k = 'tech.robots_txt_present' THEN CASE WHEN st IN ('temporarily_unreachable', 'unexpected_status') THEN 'insufficient_evidence' WHEN st = 'invalid_html_representation' THEN 'fail' ELSE 'pass' END
  WHEN st NOT IN ('valid', 'valid_empty') THEN 'insufficient_evidence' WHEN asset_id % 6 = 1 THEN 'pass' ELSE 'fail' END AS ev FROM site_runs r LEFT JOIN {LAST('asset_robots', STATE)} a ON a.run_id = r.run_id CROSS JOIN (SELECT 'tech.robots_txt_present' AS k UNION ALL SELECT 'tech.sitemap_in_robots' AS k) ks""")

LASTR = LAST("asset_robots", STATE)
LASTE = f"(SELECT asset_id - CASE WHEN st = 'absent' THEN asset_id % 6 - 3 ELSE 0 END AS asset_id, run_id, page_url, CASE WHEN st = 'absent' THEN '' ELSE content END AS content FROM {LASTR} le)"
GATE = "CASE WHEN a.st IS NULL THEN 'not_executed' WHEN a.status_code IS NULL THEN 'technical_error' WHEN provenance_complete = 0 THEN 'insufficient_evidence' WHEN a.st = 'absent' THEN NULL WHEN a.st = 'technical_error' THEN 'technical_error' WHEN a.st NOT IN ('valid', 'valid_empty') THEN 'insufficient_evidence' WHEN NOT pv THEN 'insufficient_evidence' END"
QUERIES["checks_bot_policies"] = _simple(lambda s: AS.bot_results(s.table("asset_robots"), s.table("site_runs"), _paths()))
ORACLE["checks_bot_policies"] = OUT(f"""SELECT run_id, check_id, greatest(1, b) AS aff, coalesce(g, CASE WHEN stt = 'explicitly_allowed' THEN 'pass' ELSE 'fail' END) AS ev FROM (SELECT r.run_id, 'geo.robots_mentions_' || regexp_replace(lower(bb.bot), '[^a-z0-9]+', '_', 'g') AS check_id, p.blocked_paths AS b, p.status AS stt, {GATE.replace('pv', 'p.parser_valid')} AS g
   FROM site_runs r CROSS JOIN {BOTS} bb LEFT JOIN {LASTR} a ON a.run_id = r.run_id LEFT JOIN {POLS.format(LASTE)} p ON p.run_id = r.run_id AND p.bot = bb.bot) z
  UNION ALL SELECT run_id, 'geo.robots_blocks_txt_files', b, coalesce(g, CASE WHEN b > 0 THEN 'fail' ELSE 'pass' END) FROM (SELECT r.run_id, CASE WHEN a.st = 'absent' THEN 0 WHEN a.asset_id % 6 = 0 THEN 10 ELSE 0 END AS b, {GATE.replace('pv', "(a.asset_id % 6 <> 2 OR a.content LIKE '<!DOCTYPE%')")} AS g FROM site_runs r LEFT JOIN {LASTR} a ON a.run_id = r.run_id) z2""")

# --- sitemaps
QUERIES["sitemap_documents"] = _simple(lambda s: AS.parse_sitemaps(s.table("asset_sitemaps")).select("asset_id", "document_type", "valid", "parse_error", F.array_join("locations", " ").alias("locations"), "location_count", "unique_location_count", "duplicate_location_count", "limit_exceeded"))
SM = """(SELECT *, CASE asset_id % 7 WHEN 0 THEN 'urlset' WHEN 1 THEN 'urlset' WHEN 2 THEN 'sitemapindex' WHEN 3 THEN 'invalid' WHEN 4 THEN 'invalid' WHEN 5 THEN 'empty' ELSE 'unsupported_root' END AS dt, asset_id % 7 < 3 AS ok FROM asset_sitemaps)"""
LOCS = "CASE WHEN ok THEN list_transform(regexp_extract_all(replace(content, '&amp;', '&'), '<loc>([^<]*)</loc>', 1), lambda x: trim(x)) ELSE [] END"
ORACLE["sitemap_documents"] = f"""SELECT asset_id, dt AS document_type, ok AS valid, CASE asset_id % 7 WHEN 3 THEN 'doctype_not_allowed' WHEN 4 THEN 'invalid_xml' WHEN 5 THEN 'empty_document' WHEN 6 THEN 'unsupported_root:feed' END AS parse_error, array_to_string(l, ' ') AS locations, CAST(len(l) AS INT) AS location_count, CAST(len(list_distinct(l)) AS INT) AS unique_location_count, CAST(len(l) - len(list_distinct(l)) AS INT) AS duplicate_location_count, false AS limit_exceeded FROM (SELECT *, {LOCS} AS l FROM {SM} s0) s1"""
QUERIES["sitemap_reconciliation"] = _simple(lambda s: AS.reconciliation_counts(AS.reconcile(AS.parse_sitemaps(s.table("asset_sitemaps")))))
RECON = f"""(SELECT *, CASE WHEN u IS NULL THEN 'invalid' WHEN regexp_replace(regexp_extract(u, '^https?://([^/?#]+)', 1), '^www[.]', '') <> regexp_replace(run_id, '^www[.]', '') THEN 'external' WHEN row_number() OVER (PARTITION BY run_id, u ORDER BY asset_id, pos) = 1 THEN 'unique' ELSE 'duplicate' END AS listing FROM (
  SELECT run_id, asset_id, pos, CASE WHEN x LIKE 'http%' THEN regexp_replace(regexp_replace(regexp_replace(x, '#.*$', ''), '[?]utm_source=feed$', ''), '/$', '') END AS u FROM (SELECT run_id, asset_id, unnest({LOCS}) AS x, generate_subscripts({LOCS}, 1) AS pos FROM {SM} s0 WHERE dt = 'urlset') s1) s2)"""
ORACLE["sitemap_reconciliation"] = f"SELECT run_id, asset_id, count(*) AS listed, count_if(listing = 'unique') AS \"unique\", count_if(listing = 'duplicate') AS duplicate, count_if(listing = 'external') AS external, count_if(listing = 'invalid') AS invalid FROM {RECON} r GROUP BY 1, 2"
QUERIES["sitemap_planned_urls"] = _simple(lambda s: AS.planned_urls(AS.reconcile(AS.parse_sitemaps(s.table("asset_sitemaps"))), 5).select("run_id", "listed_url", "position"))
ORACLE["sitemap_planned_urls"] = f"SELECT run_id, u AS listed_url, position FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY asset_id, pos) AS position FROM {RECON} r WHERE listing = 'unique') q WHERE position <= 5"
QUERIES["sitemap_template_sampling"] = _simple(lambda s: AS.planned_urls(AS.reconcile(AS.parse_sitemaps(s.table("asset_sitemaps"))), 50, per_template=1).select("run_id", "url_pattern", "listed_url", "position"))
QUERIES["sitemap_index_levels"] = _simple(lambda s: AS.expand_indexes(AS.parse_sitemaps(s.table("asset_sitemaps"))))
ORACLE["sitemap_index_levels"] = f"""WITH RECURSIVE lk AS (SELECT DISTINCT run_id, url AS parent, unnest({LOCS}) AS child FROM {SM} s0 WHERE dt = 'sitemapindex'), kn AS (SELECT DISTINCT run_id, url, dt FROM {SM} s1),
 w AS (SELECT run_id, url, [url] AS path, 0 AS lvl FROM kn WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.run_id = kn.run_id AND lk.child = kn.url AND lk.parent <> lk.child) UNION ALL SELECT w.run_id, lk.child, list_append(w.path, lk.child), w.lvl + 1 FROM w JOIN lk ON lk.run_id = w.run_id AND lk.parent = w.url WHERE NOT list_contains(w.path, lk.child))
SELECT kn.run_id, kn.url, kn.dt AS document_type, CAST(min(lvl) AS INT) AS level FROM w JOIN kn ON kn.run_id = w.run_id AND kn.url = w.url GROUP BY 1, 2, 3"""
QUERIES["checks_sitemaps"] = _simple(lambda s: AS.sitemap_results(AS.parse_sitemaps(s.table("asset_sitemaps")), s.table("site_runs")))
DEC = "source_type = 'robots_sitemap'"
ORACLE["checks_sitemaps"] = OUT(f"""SELECT r.run_id, 'tech.sitemap_present' AS check_id, CASE WHEN v > 0 THEN idc + defi WHEN inv + fl > 0 THEN inv + fl ELSE 1 END AS aff, CASE WHEN n IS NULL THEN 'not_executed' WHEN v > 0 AND idc + defi > 0 THEN 'fail' WHEN v > 0 THEN 'pass' WHEN tr > 0 AND inv = 0 THEN 'technical_error' ELSE 'fail' END AS ev FROM site_runs r LEFT JOIN (
  SELECT run_id, count(*) AS n, count_if(status_code = 200 AND ok) AS v, count_if(status_code = 200 AND NOT ok) AS inv, count_if({DEC} AND status_code >= 400) AS fl, count_if({DEC} AND status_code = 404) AS defi, count_if({DEC} AND status_code = 200 AND NOT ok) AS idc, count_if({DEC} AND status_code >= 500) AS tr FROM {SM} s0 GROUP BY 1) a ON a.run_id = r.run_id""")

# --- llms.txt
HASTEXT = "list_contains(list_transform(string_split(text, chr(10)), lambda l: trim(l) <> ''), true)"
LL = f"""(SELECT a.*, CASE asset_id % 8 WHEN 0 THEN 'Project ' || CAST(asset_id AS VARCHAR) WHEN 2 THEN 'Site two' WHEN 3 THEN 'Site three' END AS designation, CASE WHEN asset_id % 8 IN (0, 1) AND {HASTEXT} THEN 1 ELSE 0 END AS usable_sections, CASE asset_id % 8 WHEN 3 THEN 2 ELSE 0 END AS internal_urls FROM asset_llms a JOIN documents d ON d.doc_id = a.asset_id)"""
REAS = """concat_ws(',', CASE WHEN trim(content) = '' THEN 'empty_or_whitespace_body' END, CASE WHEN asset_id % 8 = 5 THEN 'html_or_soft_error_representation' END, CASE WHEN content_type = 'text/html' THEN 'unsupported_content_type' END, CASE WHEN content_type LIKE '%iso%' THEN 'not_valid_utf8' END, CASE WHEN designation IS NULL THEN 'missing_site_or_project_designation' END, CASE WHEN usable_sections = 0 AND internal_urls = 0 THEN 'missing_usable_section_or_internal_target' END)"""
QUERIES["llms_files"] = _simple(lambda s: AS.analyze_llms(s.table("asset_llms")).select("asset_id", "designation", "content_hash", F.array_join("content_reasons", ",").alias("reasons")))
ORACLE["llms_files"] = f"SELECT asset_id, designation, sha256(content) AS content_hash, {REAS} AS reasons FROM {LL} l"


def _llms_runs(s):
    return s.table("asset_llms").select("run_id").distinct()


QUERIES["checks_llms"] = _simple(lambda s: AS.llms_results(s.table("asset_llms"), _llms_runs(s)))
ORACLE["checks_llms"] = OUT(f"""SELECT run_id, k AS check_id, 1 AS aff, CASE WHEN measurement_state = 'technical_error' THEN 'technical_error' WHEN truncated = 1 OR measurement_state = 'unstable' THEN 'insufficient_evidence' WHEN initial_status = 200 AND final_status = 200 AND {REAS} = '' THEN 'pass' ELSE 'fail' END AS ev FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY asset_id DESC) AS rn FROM {LL} l) m CROSS JOIN (SELECT 'geo.llms_txt_present' AS k UNION ALL SELECT 'geo.llms_txt_http_status' AS k) ks WHERE rn = 1""")
QUERIES["checks_markdown_twins"] = _simple(lambda s: AS.markdown_twins(s.table("asset_llms"), _llms_runs(s)))
ORACLE["checks_markdown_twins"] = OUT("SELECT run_id, 'geo.markdown_twin_homepage' AS check_id, 1 AS aff, CASE WHEN count_if(final_status = 200 AND content_type <> 'text/html') > 0 THEN 'pass' ELSE 'fail' END AS ev FROM asset_llms GROUP BY 1")
QUERIES["asset_text_references"] = _simple(lambda s: AS.text_references(s.table("asset_llms"), s.table("site_links"), s.table("site_resources"), "the").groupBy("run_id", "source").agg(F.count(F.lit(1)).alias("references")))
ORACLE["asset_text_references"] = "SELECT run_id, 'asset' AS source, count(*) AS \"references\" FROM asset_llms WHERE lower(content) LIKE '%the%' GROUP BY 1 UNION ALL SELECT run_id, 'html_link', count(*) FROM site_links WHERE lower(target_url) LIKE '%the%' GROUP BY 1 UNION ALL SELECT run_id, 'resource', count(*) FROM site_resources WHERE lower(resource_url) LIKE '%the%' GROUP BY 1"

# --- hosts
QUERIES["checks_hosts"] = _simple(lambda s: HO.host_results(s.table("host_probes"), inputs.pages(s), s.table("site_runs")))
HP = """(SELECT *, kind = 1 AS sec, loop_detected = 1 AS cf, (final_status IS NOT NULL OR initial_status IS NOT NULL OR loop_detected = 1) AS evd, loop_detected = 0 AND (attempt_statuses IN ('timeout', '503')) AS bl, coalesce(initial_status BETWEEN 300 AND 399, false) AS rd, redirect_statuses <> '' AND redirect_statuses <> '302' AS pm, final_url LIKE 'https://%' AS th, redirect_statuses LIKE '%,%' AS hops,
  CASE WHEN start_host = run_id THEN true ELSE regexp_replace(start_host, '^www[.]', '') = regexp_replace(run_id, '^www[.]', '') END AS rel FROM host_probes)"""
HBAD = "(cf OR NOT th OR NOT rd OR (th AND rd AND NOT pm) OR (th AND path_preserved = 0) OR (th AND final_host <> run_id) OR hops)"
VBAD = "(cf OR final_host <> run_id OR (start_host <> run_id AND (NOT rd OR NOT pm OR hops OR path_preserved = 0)))"
HA = f"""(SELECT r.run_id, a.*, coalesce(d.deep, 0) AS deep FROM site_runs r LEFT JOIN (SELECT run_id AS rr, count_if(sec) AS https, count_if(sec AND certificate_failures >= 2) AS certs, count_if(sec AND final_status IS NOT NULL) AS answered, count_if(sec AND final_status IS NOT NULL AND th) AS reach, count_if(sec AND final_status IS NOT NULL AND th AND tls_state <> 'connected') AS tlso,
   count_if(NOT sec AND evd) AS http, count_if(NOT sec AND evd AND NOT bl) AS hst, count_if(NOT sec AND evd AND bl) AS hbl, count_if(NOT sec AND evd AND NOT bl AND initial_status IS NULL AND NOT cf) AS hop, count_if(NOT sec AND evd AND NOT bl AND {HBAD}) AS hbad, count_if(NOT sec AND evd AND NOT bl AND kind = 4) AS hdeep,
   count(DISTINCT CASE WHEN rel THEN start_host END) AS hosts, count_if(rel AND evd) AS meas, count_if(rel AND evd AND bl) AS vbl, count_if(rel AND evd AND initial_status IS NULL AND NOT cf) AS vop, count_if(rel AND evd AND kind = 4) AS vdeep, count_if(rel AND evd AND {VBAD}) AS vbad,
   count_if(sec AND tls_state = 'connected') AS conn, count_if(sec AND tls_state = 'technical_error') AS terr, min_by(negotiated_protocol, CASE WHEN sec AND tls_state = 'connected' THEN (CASE WHEN final_host <> run_id THEN 1 ELSE 0 END) * 1000000000 + probe_id END) AS proto FROM {HP} h GROUP BY 1) a ON a.rr = r.run_id
  LEFT JOIN (SELECT run_id, count(*) AS deep FROM site_pages WHERE {HTML} AND status_code = 200 AND page_type NOT IN ('login', 'search', 'error') AND regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) <> '/' GROUP BY 1) d ON d.run_id = r.run_id)"""


def _host(check_id, cases, failing, aff):
    return f"SELECT run_id, '{check_id}' AS check_id, ev AS evaluation_state, CASE ev WHEN 'pass' THEN 'OK' WHEN 'fail' THEN '{failing}' ELSE 'NA' END AS status, CAST(CASE WHEN ev = 'fail' THEN {aff} ELSE 0 END AS BIGINT) AS affected_count FROM (SELECT *, CASE {cases} END AS ev FROM {HA} h) x"


ORACLE["checks_hosts"] = "\nUNION ALL\n".join([
    _host("tech.https_reachable", "WHEN coalesce(https, 0) = 0 THEN 'insufficient_evidence' WHEN certs > 0 THEN 'fail' WHEN answered = 0 THEN 'technical_error' WHEN reach > 0 AND tlso > 0 THEN 'insufficient_evidence' WHEN reach > 0 THEN 'pass' ELSE 'fail'", "Error", "CASE WHEN certs > 0 THEN certs ELSE 1 END"),
    _host("tech.http_to_https_redirect", "WHEN hst = 0 AND hbl > 0 THEN 'technical_error' WHEN hop > 0 THEN 'insufficient_evidence' WHEN deep > 0 AND coalesce(hdeep, 0) = 0 THEN 'insufficient_evidence' WHEN coalesce(http, 0) = 0 THEN 'insufficient_evidence' WHEN hbad > 0 THEN 'fail' ELSE 'pass'", "Warning", "hbad"),
    _host("tech.www_non_www_consistency", "WHEN coalesce(hosts, 0) < 2 THEN 'not_applicable' WHEN meas < hosts THEN 'technical_error' WHEN vbl > 0 THEN 'technical_error' WHEN vop > 0 THEN 'insufficient_evidence' WHEN deep > 0 AND vdeep = 0 THEN 'insufficient_evidence' WHEN vbad > 0 THEN 'fail' ELSE 'pass'", "Warning", "vbad"),
    _host("tech.http_version_support", "WHEN coalesce(conn, 0) = 0 AND coalesce(terr, 0) > 0 THEN 'technical_error' WHEN coalesce(conn, 0) = 0 THEN 'insufficient_evidence' WHEN proto IN ('h2', 'h3') THEN 'pass' ELSE 'fail'", "Warning", "1"),
])


def _unknown(s):
    rows = s.table("site_queue").where("source_type = 'start'").select("run_id", F.when(c("queue_id") % 3 == 0, 404).when(c("queue_id") % 9 == 1, 200).otherwise(410).alias("final_status"), F.when(c("queue_id") % 3 == 0, "404").when(c("queue_id") % 9 == 1, "200").when(c("queue_id") % 9 == 4, "timeout").otherwise("410").alias("attempt_statuses"))
    return HO.unknown_url_results(rows, s.table("site_runs"))


QUERIES["checks_unknown_urls"] = _simple(_unknown)
ORACLE["checks_unknown_urls"] = OUT("""SELECT r.run_id, 'tech.synthetic_not_found_handling' AS check_id, soft AS aff, CASE WHEN n IS NULL THEN 'not_executed' WHEN soft > 0 THEN 'fail' WHEN te = n THEN 'technical_error' WHEN te > 0 THEN 'insufficient_evidence' ELSE 'pass' END AS ev FROM site_runs r LEFT JOIN (SELECT run_id, count(*) AS n, count_if(queue_id % 9 = 1) AS soft, count_if(queue_id % 9 = 4) AS te FROM site_queue WHERE source_type = 'start' GROUP BY 1) a ON a.run_id = r.run_id""")


# --- structured data rows
def _schema(s):
    return s.table("site_schema_rows").withColumn("properties", F.split("properties", ","))


FORMS = "(SELECT run_id, f AS page_url, min(page_type) AS pt FROM (SELECT run_id, page_type, unnest(list_distinct([final_url, url, normalized_url])) AS f FROM site_pages) u GROUP BY 1, 2)"
QUERIES["schema_rows_with_pages"] = _simple(lambda s: SD.rows_with_pages(_schema(s), inputs.pages(s)).select("run_id", "page_id", "page_url", "schema_type", "matched_page_type"))
ORACLE["schema_rows_with_pages"] = f"SELECT s.run_id, s.page_id, s.page_url, s.schema_type, f.pt AS matched_page_type FROM site_schema_rows s JOIN {FORMS} f ON f.run_id = s.run_id AND f.page_url = s.page_url"
QUERIES["schema_type_coverage"] = _simple(lambda s: SD.type_coverage(_schema(s)))
ORACLE["schema_type_coverage"] = "SELECT run_id, schema_type, count(DISTINCT page_url) AS pages FROM site_schema_rows WHERE parse_status = 'ok' GROUP BY 1, 2"
QUERIES["schema_by_page_type"] = _simple(lambda s: SD.page_type_by_schema(_schema(s), inputs.pages(s)))
ORACLE["schema_by_page_type"] = f"SELECT s.run_id, f.pt AS page_type, s.schema_type, count(DISTINCT s.page_url) AS urls FROM site_schema_rows s JOIN {FORMS} f ON f.run_id = s.run_id AND f.page_url = s.page_url WHERE parse_status = 'ok' GROUP BY 1, 2, 3"
PERSON = "((text_facts = 1 AND (page_type = 'article' OR has_author = 1)) OR lower(url) LIKE '%/team%' OR lower(url) LIKE '%/autor%' OR lower(url) LIKE '%/author%' OR lower(title) LIKE '%autor%' OR lower(title) LIKE '%team%')"
SA = f"""(SELECT r.run_id, coalesce(html, 0) AS html, coalesce(places, 0) AS places, coalesce(people, 0) AS people, coalesce(pm, 0) AS pm, coalesce(n, 0) AS n, coalesce(okn, 0) AS okn, coalesce(org, 0) AS org, coalesce(web, 0) AS web, coalesce(loc, 0) AS loc, coalesce(per, 0) AS per, coalesce(sa, 0) AS sa, coalesce(te, 0) AS te, coalesce(er, 0) AS er, coalesce(ep, 0) AS ep, coalesce(dp, 0) AS dp FROM site_runs r
 LEFT JOIN (SELECT run_id, count_if({HTML}) AS html, count_if({HTML} AND page_type = 'location' AND regexp_matches(lower(url || ' ' || title), 'standort|filiale|/location')) AS places, count_if({HTML} AND {PERSON}) AS people, count_if({HTML} AND {PERSON} AND schema_types NOT LIKE '%Person%') AS pm FROM site_pages GROUP BY 1) p ON p.run_id = r.run_id
 LEFT JOIN (SELECT run_id, count(*) AS n, count_if(parse_status = 'ok') AS okn, count_if(parse_status = 'ok' AND schema_type = 'Organization') AS org, count_if(parse_status = 'ok' AND schema_type = 'WebSite') AS web, count_if(parse_status = 'ok' AND schema_type = 'LocalBusiness') AS loc, count_if(parse_status = 'ok' AND schema_type = 'Person') AS per, count_if(parse_status = 'ok' AND schema_type = 'Organization' AND properties LIKE '%sameAs%') AS sa FROM site_schema_rows GROUP BY 1) s ON s.run_id = r.run_id
 LEFT JOIN (SELECT s.run_id, count(*) AS te FROM site_schema_rows s JOIN {FORMS} f ON f.run_id = s.run_id AND f.page_url = s.page_url WHERE parse_status = 'technical_error' GROUP BY 1) t ON t.run_id = r.run_id
 LEFT JOIN (SELECT run_id, sum(b) AS er, count(*) AS ep, sum(d) AS dp FROM (SELECT s.run_id, s.page_url, count(DISTINCT (snippet_hash, f.pt)) AS b, max(CASE WHEN f.pt IN ('article', 'product') THEN 1 ELSE 0 END) AS d FROM site_schema_rows s JOIN {FORMS} f ON f.run_id = s.run_id AND f.page_url = s.page_url WHERE parse_status = 'error' GROUP BY 1, 2) e0 GROUP BY 1) e ON e.run_id = r.run_id)"""


def _schema_check(check_id, cases, aff, failing="Warning", priority="'Low'"):
    return f"SELECT run_id, '{check_id}' AS check_id, ev AS evaluation_state, CASE ev WHEN 'pass' THEN 'OK' WHEN 'fail' THEN '{failing}' ELSE 'NA' END AS status, {priority} AS priority, CAST(CASE WHEN ev = 'fail' THEN {aff} ELSE 0 END AS BIGINT) AS affected_count FROM (SELECT *, CASE {cases} END AS ev FROM {SA} a) x"


def _present(name):
    return f"WHEN html = 0 THEN 'insufficient_evidence' WHEN {name} > 0 THEN 'pass' ELSE 'fail'"


SAME = "WHEN org = 0 THEN 'not_applicable' WHEN sa > 0 THEN 'pass' ELSE 'fail'"
QUERIES["checks_structured_data_rows"] = _simple(lambda s: SD.schema_results(_schema(s), inputs.pages(s), s.table("site_runs")))
ORACLE["checks_structured_data_rows"] = "\nUNION ALL\n".join([
    _schema_check("tech.json_ld_parse_errors", "WHEN er = 0 AND te > 0 THEN 'technical_error' WHEN n = 0 THEN 'insufficient_evidence' WHEN er = 0 AND okn = 0 THEN 'not_applicable' WHEN er > 0 THEN 'fail' ELSE 'pass'", "er", "Error", "CASE WHEN er > 0 AND ep >= 3 AND (ep * 1.0 / greatest(1, html) >= 0.5 OR (dp = ep AND ep * 1.0 / greatest(1, html) >= 0.25)) THEN 'High' ELSE 'Medium' END"),
    _schema_check("tech.schema_types_coverage_summary", _present("okn"), "0"), _schema_check("tech.organization_missing", _present("org"), "1"), _schema_check("tech.website_missing", _present("web"), "1"), _schema_check("tech.organization_sameas_missing", SAME, "1"), _schema_check("geo.organization_schema_sameas", SAME, "1"),
    _schema_check("tech.localbusiness_present_missing", "WHEN loc > 0 THEN 'pass' WHEN places > 0 THEN 'fail' ELSE 'not_applicable'", "places"), _schema_check("tech.person_present_missing", "WHEN per > 0 THEN 'pass' WHEN people > 0 THEN 'fail' ELSE 'insufficient_evidence'", "pm"),
])

ORACLE = {name: with_views(text) for name, text in ORACLE.items()}
