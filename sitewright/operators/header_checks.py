"""Header policy checks over pages and resources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.config import STATE_FAIL, STATE_INSUFFICIENT, STATE_NOT_APPLICABLE, STATE_NOT_EXECUTED
from sitewright.functions import headers as H
from sitewright.functions import url as U
from sitewright.operators import scopes as S
from sitewright.operators.predicates import Check, _fail_count, evaluate_checks, flag_off, ladder, none

c = F.col
SECURITY, DELIVERY = "Security Best Practice", "Server/Performance Best Practice"

POLICIES: dict[str, Callable[[Column], Column]] = {
    "hsts_header": lambda headers: H.transport_security(headers, F.coalesce(c("final_url"), c("url"))),
    "content_security_policy": H.content_security_policy,
    "x_frame_options": H.frame_protection,
    "x_content_type_options": H.content_type_options,
    "referrer_policy": H.referrer_policy,
    "permissions_policy": H.permissions_policy,
}


def policy_states(pages: DataFrame) -> DataFrame:
    """State of every policy, one row per page."""
    bag = F.col("response_headers")
    columns = {f"policy_{name}": rule(bag) for name, rule in POLICIES.items()}
    columns["policy_cross_origin"] = H.cross_origin_policies(bag)
    columns["policy_cache"] = H.cache_policy(bag, F.lit("html"))
    columns["cache_ttl"] = H.cache_ttl(bag)
    columns["policy_compression"] = H.compression(bag, c("content_type"), c("raw_html_size"))
    return U.computed_once(pages, columns)


def _executable_resources(resources: DataFrame) -> DataFrame:
    return resources.where(S.between(c("status_code"), 200, 300) & c("resource_type").isin("script", "stylesheet"))


def security_checks() -> list[Check]:
    checks = []
    for name in POLICIES:
        policy = c(f"policy_{name}")
        known = c("response_headers").isNotNull() & c("in_scope")
        if name != "x_content_type_options":
            known = known & (c("source") == "page")
        scope = c("in_scope") & (F.lit(True) if name == "x_content_type_options" else (c("source") == "page"))
        applicable = known & (policy != "not_applicable")
        hit = applicable & ~H.passes(policy)
        severe = hit & (policy.isin(*H.MEDIUM) | (F.lit(name == "x_frame_options") & F.lower(c("page_type")).isin("login", "checkout", "account")))
        steps = [(flag_off("store_headers"), STATE_NOT_EXECUTED)]
        if name == "x_content_type_options":
            steps.append((flag_off("store_all_resources"), STATE_NOT_EXECUTED))
        steps += [
            (none("scope"), STATE_NOT_APPLICABLE),
            (lambda m: (m["hit"] == 0) & (m["open"] > 0), STATE_INSUFFICIENT),
            (none("applicable"), STATE_NOT_APPLICABLE),
            (lambda m: m["hit"] > 0, STATE_FAIL),
        ]
        state = ladder(*steps)
        measures = {"scope": scope, "open": scope & c("response_headers").isNull(), "applicable": applicable, "hit": hit, "severe": severe}
        checks.append(Check(f"tech.{name}", SECURITY, measures, state, _fail_count(state, "hit"), sample="hit", priority="Low", evidence=("severe", "open")))
    return checks


def security_results(pages: DataFrame, resources: DataFrame, runs: DataFrame) -> DataFrame:
    """Six policy checks; pages and executable resources share one aggregation."""
    page_rows = pages.select(
        "run_id", "url", "final_url", "page_type", "response_headers", F.lit("page").alias("source"),
        F.coalesce(S.successful_html(), F.lit(False)).alias("in_scope"),
    )
    resource_rows = _executable_resources(resources).select(
        "run_id", F.col("resource_url").alias("url"), F.col("resource_url").alias("final_url"),
        F.lit(None).cast("string").alias("page_type"), "response_headers", F.lit("resource").alias("source"), F.lit(True).alias("in_scope"),
    )
    policies = {f"policy_{name}": rule(c("response_headers")) for name, rule in POLICIES.items()}
    rows = U.computed_once(page_rows.unionByName(resource_rows), policies)
    return evaluate_checks(rows, runs, security_checks(), repeated=True)


def delivery_rows(pages: DataFrame, resources: DataFrame) -> DataFrame:
    """Compression and cache rows: pages, text resources and distinct static resources."""
    page_rows = pages.where(S.successful_html()).select(
        "run_id", "url", F.col("url").alias("page_url"), "content_type", F.col("raw_html_size").alias("body_bytes"),
        "response_headers", F.lit("html").alias("kind"), F.lit(True).alias("compress_scope"), F.lit(True).alias("cache_scope"),
    )
    kind = F.lower(c("content_type"))
    text = kind.rlike("^text/|javascript|json|xml|svg")
    found = resources.where(S.between(c("status_code"), 200, 300))
    resource_rows = found.select(
        "run_id", F.col("resource_url").alias("url"), "page_url", "content_type", F.col("size_bytes").alias("body_bytes"),
        "response_headers", F.lit("static").alias("kind"), F.coalesce(text, F.lit(False)).alias("compress_scope"), F.lit(False).alias("cache_scope"),
    )
    # One row stands for a resource that many pages load: the first by page and size, so the choice is stable.
    first = (
        found.where(c("resource_type").isin("script", "stylesheet", "font", "image"))
        .groupBy("run_id", "resource_url")
        .agg(F.min_by(F.struct("page_url", "content_type", "size_bytes", "response_headers"), F.struct("page_url", "resource_id")).alias("m"))
        .select(
            "run_id", F.col("resource_url").alias("url"), "m.page_url", "m.content_type", F.col("m.size_bytes").alias("body_bytes"),
            "m.response_headers", F.lit("static").alias("kind"), F.lit(False).alias("compress_scope"), F.lit(True).alias("cache_scope"),
        )
    )
    return page_rows.unionByName(resource_rows).unionByName(first)


def delivery_checks() -> list[Check]:
    compression, cache = c("compression"), c("cache")
    known = c("response_headers").isNotNull()
    compress_open = c("compress_scope") & (~known | (compression == "insufficient_evidence"))
    compress_hit = c("compress_scope") & known & (compression == "uncompressed")
    compress_used = c("compress_scope") & (~known | (compression != "not_applicable"))
    compress_state = ladder(
        (flag_off("store_headers"), STATE_NOT_EXECUTED), (none("scope"), STATE_NOT_APPLICABLE),
        (lambda m: (m["hit"] == 0) & (m["open"] > 0), STATE_INSUFFICIENT), (none("used"), STATE_NOT_APPLICABLE), (lambda m: m["hit"] > 0, STATE_FAIL),
    )
    cache_open = c("cache_scope") & ~known
    cache_hit = c("cache_scope") & known & ~H.passes(cache) & (cache != "not_applicable")
    cache_state = ladder(
        (flag_off("store_headers"), STATE_NOT_EXECUTED), (none("scope"), STATE_NOT_APPLICABLE),
        (lambda m: (m["hit"] == 0) & (m["open"] > 0), STATE_INSUFFICIENT), (lambda m: m["hit"] > 0, STATE_FAIL),
    )
    cache_measures = {"scope": c("cache_scope"), "open": cache_open, "hit": cache_hit}
    return [
        Check("tech.compression_header", DELIVERY, {"scope": c("compress_scope"), "open": compress_open, "hit": compress_hit, "used": compress_used}, compress_state, _fail_count(compress_state, "hit"), sample="hit", priority="Low", evidence=("used", "open")),
        Check("tech.cache_control_header", DELIVERY, cache_measures, cache_state, _fail_count(cache_state, "hit"), sample="hit", priority="Low", evidence=("scope", "open")),
        Check("tech.cdn_cache_signals", DELIVERY, cache_measures, cache_state, _fail_count(cache_state, "hit"), sample="hit", priority="Low", evidence=("scope", "open")),
    ]


def delivery_results(pages: DataFrame, resources: DataFrame, runs: DataFrame) -> DataFrame:
    rows = U.computed_once(
        delivery_rows(pages, resources),
        {
            "compression": H.compression(c("response_headers"), c("content_type"), c("body_bytes")),
            "cache": H.cache_policy(c("response_headers"), c("kind")),
        },
    )
    return evaluate_checks(rows, runs, delivery_checks(), repeated=True)


def cache_impact(pages: DataFrame, resources: DataFrame) -> DataFrame:
    """Per run and state: responses, affected pages and decoded bytes behind cache findings."""
    rows = delivery_rows(pages, resources).where("cache_scope and response_headers is not null")
    rows = U.computed_once(rows, {"cache": H.cache_policy(c("response_headers"), c("kind"))})
    return rows.groupBy("run_id", F.col("cache").alias("state")).agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_distinct("page_url").alias("pages"),
        F.sum(F.coalesce(c("body_bytes"), F.lit(0))).alias("bytes"),
    )
