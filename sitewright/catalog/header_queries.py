"""Queries over header policies. The texts hold the expected state of every distinct header value."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewright.catalog import inputs
from sitewright.catalog.oracle import OK, check, failed, state_case, union
from sitewright.catalog.site_views import Site, with_views
from sitewright.operators import header_checks as HC
from sitewright.operators import scopes as S

QUERIES = {}
ORACLE = {}

CSP = """CASE WHEN h_csp IS NULL THEN 'missing' WHEN h_csp LIKE 'default-src ''self''; frame-anc%' THEN 'protected' WHEN h_csp LIKE 'script-src *%' THEN 'dangerously_weak'
 WHEN h_csp = 'upgrade-insecure-requests' THEN 'incomplete_protection' WHEN h_csp LIKE '%''unsafe-inline''' THEN 'dangerously_weak'
 WHEN h_csp LIKE '%default-src *' THEN 'invalid' WHEN h_csp LIKE '%nonce%' THEN 'protected' ELSE 'invalid' END"""
HSTS = """CASE WHEN final_url NOT LIKE 'https://%' THEN 'not_applicable' WHEN h_hsts IS NULL THEN 'missing' WHEN h_hsts LIKE '%; preload' THEN 'protected' WHEN h_hsts = 'max-age=100' THEN 'too_short'
 WHEN h_hsts = 'max-age=0' THEN 'disabled' ELSE 'invalid' END"""
XFO = """CASE WHEN h_csp LIKE '%frame-ancestors *' THEN 'unprotected' WHEN h_csp LIKE '%frame-ancestors%' THEN 'protected_by_csp' WHEN h_xfo IS NULL THEN 'missing'
 WHEN h_xfo IN ('DENY', 'sameorigin') THEN 'protected_by_xfo' ELSE 'invalid' END"""
XCTO = "CASE WHEN h_xcto IS NULL THEN 'missing' WHEN h_xcto = 'sniff' THEN 'invalid' ELSE 'protected' END"
REFERRER = """CASE WHEN h_referrer IS NULL THEN 'missing' WHEN h_referrer = 'bogus' THEN 'invalid' WHEN h_referrer IN ('unsafe-url', 'no-referrer-when-downgrade') THEN 'unsafe' ELSE 'configured' END"""
PERMISSIONS = """CASE WHEN h_permissions IS NULL THEN 'missing' WHEN h_permissions IN ('camera=*', 'usb=(none)') THEN 'invalid' WHEN h_permissions = 'microphone=(*)' THEN 'dangerously_open' ELSE 'configured' END"""
HTML_CACHE = """CASE WHEN h_cache = 'no-store' THEN 'html_no_store_observed' WHEN h_cache = 'no-cache' AND h_etag IS NOT NULL THEN 'html_revalidation' WHEN h_cache = 'no-cache' THEN 'html_revalidation_observed'
 WHEN h_cache IS NULL AND h_etag IS NULL THEN 'html_policy_unspecified' WHEN h_cache = 'max-age=10, max-age=20' THEN 'invalid' ELSE 'configured' END"""
STATIC_CACHE = "CASE WHEN h_cache IN ('no-store', 'no-cache') THEN 'static_uncacheable' WHEN h_cache IS NULL AND h_etag IS NULL THEN 'static_policy_missing' ELSE 'configured' END"
OPENER = "CASE WHEN h_coop IS NULL THEN 'not_configured' WHEN h_coop = 'same-origin' THEN 'protective' WHEN h_coop = 'unsafe-none' THEN 'permissive' ELSE 'invalid_or_conflicting' END"
PACKED = "coalesce(h_encoding, '') IN ('gzip', 'br', 'zstd')"
PAGE_PACK = f"CASE WHEN raw_html_size < 4096 THEN 'not_applicable' WHEN {PACKED} THEN 'compressed' ELSE 'uncompressed' END"


def header_policy_states(spark, folder):
    pages = HC.policy_states(inputs.pages(Site(spark, folder)).where(S.successful_html() & F.col("response_headers").isNotNull()))
    states = [F.col(f"policy_{name}").alias(name) for name in HC.POLICIES]
    return pages.select(
        "page_id", *states, F.col("policy_cross_origin")["opener"].alias("opener"), F.col("policy_cross_origin")["embedder"].alias("embedder"),
        F.col("policy_cache").alias("cache"), "cache_ttl", F.col("policy_compression").alias("compression"),
    )


QUERIES["header_policy_states"] = header_policy_states
ORACLE["header_policy_states"] = f"""SELECT page_id, {HSTS} AS hsts_header, {CSP} AS content_security_policy, {XFO} AS x_frame_options, {XCTO} AS x_content_type_options,
  {REFERRER} AS referrer_policy, {PERMISSIONS} AS permissions_policy, {OPENER} AS opener, 'not_configured' AS embedder, {HTML_CACHE} AS cache,
  CAST(CASE h_cache WHEN 'max-age=600' THEN 600 WHEN 'max-age=0' THEN 0 WHEN 'max-age=10, max-age=20' THEN 20 WHEN 'public, s-maxage=60' THEN 60 END AS BIGINT) AS cache_ttl, {PAGE_PACK} AS compression
FROM site_pages WHERE {OK} AND headers_stored = 1"""


def checks_security_headers(spark, folder):
    site = Site(spark, folder)
    return inputs.flat_results(HC.security_results(inputs.pages(site), inputs.resources(site), site.table("site_runs")))


def _policy(name, state, passing, severe="false", extra=""):
    table = f"""(SELECT run_id, url, headers_stored, coalesce({OK}, false) AS in_scope, {state} AS st, {severe} AS severe_state FROM site_pages {extra}) q"""
    used = "in_scope AND headers_stored = 1 AND st <> 'not_applicable'"
    hit = f"{used} AND st NOT IN ({passing})"
    measures = {"scope": "in_scope", "open": "in_scope AND headers_stored = 0", "applicable": used, "hit": hit, "severe": f"{hit} AND severe_state"}
    steps = [("store_headers = 0", "not_executed")] + ([("store_all_resources = 0", "not_executed")] if extra else [])
    steps += [("scope = 0", "not_applicable"), ("hit = 0 AND open > 0", "insufficient_evidence"), ("applicable = 0", "not_applicable"), ("hit > 0", "fail")]
    return check(f"tech.{name}", table, measures, state_case(*steps), failed("hit"), hit, evidence=("severe", "open"))


RESOURCE_ROWS = f"""UNION ALL SELECT run_id, resource_url, 1, true, {XCTO}, false FROM site_resources WHERE status_code BETWEEN 200 AND 299 AND resource_type IN ('script', 'stylesheet')"""
QUERIES["checks_security_headers"] = checks_security_headers
ORACLE["checks_security_headers"] = union([
    _policy("hsts_header", HSTS, "'protected'"),
    _policy("content_security_policy", CSP, "'protected'", f"({CSP}) = 'dangerously_weak'"),
    _policy("x_frame_options", XFO, "'protected_by_csp', 'protected_by_xfo'"),
    _policy("x_content_type_options", XCTO, "'protected'", extra=RESOURCE_ROWS),
    _policy("referrer_policy", REFERRER, "'configured'"),
    _policy("permissions_policy", PERMISSIONS, "'configured'", "h_permissions = 'microphone=(*)'"),
])


def checks_delivery_headers(spark, folder):
    site = Site(spark, folder)
    return inputs.flat_results(HC.delivery_results(inputs.pages(site), inputs.resources(site), site.table("site_runs")))


DELIVERY = f"""(SELECT run_id, url, url AS page_url, raw_html_size AS bytes, headers_stored AS known, {PAGE_PACK} AS pack, {HTML_CACHE} AS cache, true AS cs, true AS ks FROM site_pages WHERE {OK}
  UNION ALL SELECT run_id, resource_url, page_url, size_bytes, 1, CASE WHEN size_bytes IS NULL THEN 'insufficient_evidence' WHEN size_bytes < 4096 THEN 'not_applicable' WHEN {PACKED} THEN 'compressed' ELSE 'uncompressed' END, '', regexp_matches(content_type, '^text/|javascript|json|xml|svg'), false
    FROM site_resources WHERE status_code BETWEEN 200 AND 299
  UNION ALL SELECT run_id, resource_url, page_url, size_bytes, 1, '', cache, false, true FROM (SELECT run_id, resource_url, page_url, size_bytes, {STATIC_CACHE} AS cache,
    row_number() OVER (PARTITION BY run_id, resource_url ORDER BY page_url, resource_id) AS rn FROM site_resources WHERE status_code BETWEEN 200 AND 299) f WHERE rn = 1) q"""


def _delivery(check_id, scope, hit, open_, used=None):
    measures = {"scope": scope, "open": open_, "hit": hit} | ({"used": used} if used else {})
    steps = [("store_headers = 0", "not_executed"), ("scope = 0", "not_applicable"), ("hit = 0 AND open > 0", "insufficient_evidence")]
    steps += ([("used = 0", "not_applicable")] if used else []) + [("hit > 0", "fail")]
    return check(check_id, DELIVERY, measures, state_case(*steps), failed("hit"), hit, evidence=("used", "open") if used else ("scope", "open"))


CACHE_HIT = "ks AND known = 1 AND cache IN ('static_uncacheable', 'static_policy_missing', 'invalid')"
QUERIES["checks_delivery_headers"] = checks_delivery_headers
ORACLE["checks_delivery_headers"] = union([
    _delivery("tech.compression_header", "cs", "cs AND known = 1 AND pack = 'uncompressed'", "cs AND (known = 0 OR pack = 'insufficient_evidence')", "cs AND (known = 0 OR pack <> 'not_applicable')"),
    _delivery("tech.cache_control_header", "ks", CACHE_HIT, "ks AND known = 0"),
    _delivery("tech.cdn_cache_signals", "ks", CACHE_HIT, "ks AND known = 0"),
])


def header_cache_impact(spark, folder):
    site = Site(spark, folder)
    return HC.cache_impact(inputs.pages(site), inputs.resources(site))


QUERIES["header_cache_impact"] = header_cache_impact
ORACLE["header_cache_impact"] = f"SELECT run_id, cache AS state, count(*) AS responses, count(DISTINCT page_url) AS pages, CAST(sum(coalesce(bytes, 0)) AS BIGINT) AS bytes FROM {DELIVERY} WHERE ks AND known = 1 GROUP BY 1, 2"

ORACLE = {name: with_views(text) for name, text in ORACLE.items()}
