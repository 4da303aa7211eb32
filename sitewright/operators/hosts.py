"""Host probe checks: HTTPS, redirects to HTTPS, www variants, negotiated protocol, unknown-URL handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.functions import http
from sitewright.functions import url as U
from sitewright.operators import scopes as S

c = F.col
HOST = "Server & Infrastructure"


def _facts(probes: DataFrame, runs: DataFrame) -> DataFrame:
    rows = probes.join(runs.select("run_id", F.col("final_domain").alias("site_url")), "run_id", "left")
    stability = http.stability(http.parse_attempts(c("attempt_statuses")))
    statuses = F.transform(F.filter(F.split("redirect_statuses", ","), lambda s: s != ""), lambda s: s.cast("int"))
    rows = U.computed_once(rows, {"stability": stability, "statuses": statuses, "selected_host": U.host(c("site_url"))})
    failing = c("loop_detected") == 1
    known = c("final_status") >= 100
    evidence = F.coalesce(known, F.lit(False)) | F.coalesce(c("initial_status") >= 100, F.lit(False)) | failing
    blocks = ~failing & (c("final_status").isin(408, 429) | c("stability").isin("technical_error", "transient", "insufficient_evidence"))
    return rows.withColumns(
        {
            "secure": c("start_url").startswith("https://"), "has_evidence": evidence, "blocks": F.coalesce(blocks, c("stability").isin("technical_error", "transient", "insufficient_evidence")),
            "redirects": F.coalesce(S.between(c("initial_status"), 300, 400), F.lit(False)), "permanent": http.permanent_chain(c("statuses")), "config_failure": failing,
            "relation": U.host_relation(c("start_host"), c("selected_host")), "to_https": c("final_url").startswith("https://"),
        }
    )


def host_results(probes: DataFrame, pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Four host checks from one aggregation over the probes of a run."""
    rows = _facts(probes, runs)
    secure = c("secure") & (c("probe_role") != "representative_public_path")
    plain = ~c("secure") & c("has_evidence")
    stable = plain & ~c("blocks")
    incomplete = c("initial_status").isNull() & ~c("config_failure")
    lost = (c("path_preserved") == 0)
    bad_redirect = stable & (
        c("config_failure") | ~c("to_https") | ~c("redirects") | (c("to_https") & c("redirects") & ~c("permanent")) | (c("to_https") & lost) | (c("to_https") & (c("final_host") != c("selected_host"))) | (F.size("statuses") > 1)
    )
    related = c("relation").isin("same", "www_variant")
    variant = c("start_host") != c("selected_host")
    bad_variant = related & (
        c("config_failure") | (c("final_host") != c("selected_host")) | (variant & (~c("redirects") | ~c("permanent") | (F.size("statuses") > 1) | lost))
    )
    connected = c("secure") & (c("tls_state") == "connected")
    counts = rows.groupBy("run_id").agg(
        F.count_if(secure).alias("https"), F.count_if(secure & (c("certificate_failures") >= 2)).alias("certificates"), F.count_if(secure & (c("final_status") >= 100)).alias("answered"),
        F.count_if(secure & (c("final_status") >= 100) & c("to_https")).alias("reachable"), F.count_if(secure & (c("final_status") >= 100) & c("to_https") & ~F.coalesce(c("tls_state") == "connected", F.lit(False))).alias("tls_open"),
        F.count_if(plain).alias("http"), F.count_if(stable).alias("http_stable"), F.count_if(plain & c("blocks")).alias("http_blocked"), F.count_if(stable & incomplete).alias("http_open"), F.count_if(bad_redirect).alias("http_bad"),
        F.count_if(stable & (c("probe_role") == "representative_public_path")).alias("http_deep"),
        F.count_distinct(F.when(related, c("start_host"))).alias("hosts"), F.count_if(related & c("has_evidence")).alias("measured"), F.count_if(related & c("has_evidence") & c("blocks")).alias("variant_blocked"),
        F.count_if(related & c("has_evidence") & incomplete).alias("variant_open"), F.count_if(related & c("has_evidence") & (c("probe_role") == "representative_public_path")).alias("variant_deep"), F.count_if(bad_variant & c("has_evidence")).alias("variant_bad"),
        F.count_if(c("secure")).alias("secure_probes"), F.count_if(connected).alias("connected"), F.count_if(c("secure") & (c("tls_state") == "technical_error")).alias("tls_errors"),
        F.min_by(F.lower("negotiated_protocol"), F.when(connected, F.struct((c("final_host") != c("selected_host")).alias("a"), c("probe_id")))).alias("protocol"),
    )
    deep = pages.where(S.is_html() & S.between(c("status_code"), 200, 300) & ~S.page_type().isin("login", "search", "error") & (U.path(c("url")) != "/")).groupBy("run_id").agg(F.count(F.lit(1)).alias("deep_pages"))
    joined = runs.select("run_id").join(counts, "run_id", "left").join(deep, "run_id", "left").na.fill(0)

    https = (
        F.when(c("https") == 0, "insufficient_evidence").when(c("certificates") > 0, "fail").when(c("answered") == 0, "technical_error").when((c("reachable") > 0) & (c("tls_open") > 0), "insufficient_evidence")
        .when(c("reachable") > 0, "pass").otherwise("fail")
    )
    redirect = (
        F.when((c("http_stable") == 0) & (c("http_blocked") > 0), "technical_error").when(c("http_open") > 0, "insufficient_evidence").when((c("deep_pages") > 0) & (c("http_deep") == 0), "insufficient_evidence")
        .when(c("http") == 0, "insufficient_evidence").when(c("http_bad") > 0, "fail").otherwise("pass")
    )
    variants = (
        F.when(c("hosts") < 2, "not_applicable").when(c("measured") < c("hosts"), "technical_error").when(c("variant_blocked") > 0, "technical_error").when(c("variant_open") > 0, "insufficient_evidence")
        .when((c("deep_pages") > 0) & (c("variant_deep") == 0), "insufficient_evidence").when(c("variant_bad") > 0, "fail").otherwise("pass")
    )
    modern = c("protocol").isin("h2", "h3") | F.coalesce(c("protocol").startswith("h3-"), F.lit(False))
    version = F.when((c("connected") == 0) & (c("tls_errors") > 0), "technical_error").when(c("connected") == 0, "insufficient_evidence").when(modern, "pass").otherwise("fail")

    def result(check_id: str, state: Column, failing: str, affected: Column) -> Column:
        status = F.when(state == "pass", "OK").when(state == "fail", failing).otherwise("NA")
        return F.struct(F.lit(check_id).alias("check_id"), state.alias("evaluation_state"), status.alias("status"), F.when(state == "fail", affected).otherwise(F.lit(0)).cast("bigint").alias("affected_count"))

    one = F.lit(1).cast("bigint")
    return joined.select(
        "run_id",
        F.inline(
            F.array(
                result("tech.https_reachable", https, "Error", F.when(c("certificates") > 0, c("certificates")).otherwise(one)), result("tech.http_to_https_redirect", redirect, "Warning", c("http_bad")),
                result("tech.www_non_www_consistency", variants, "Warning", c("variant_bad")), result("tech.http_version_support", version, "Warning", one),
            )
        ),
    )


def unknown_url_results(probes: DataFrame, runs: DataFrame) -> DataFrame:
    """Verdict over stored probes of URLs that cannot exist: 404 or 410 is right, a 2xx answer is a soft error."""
    stable = c("stability") == "confirmed"
    right, soft = c("final_status").isin(404, 410), S.between(c("final_status"), 200, 300)
    rows = U.computed_once(probes, {"stability": http.stability(http.parse_attempts(c("attempt_statuses")))})
    counts = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("probes"), F.count_if(stable & F.coalesce(right, F.lit(False))).alias("right"), F.count_if(stable & F.coalesce(soft, F.lit(False))).alias("soft"),
        F.count_if(stable & ~F.coalesce(right | soft, F.lit(False))).alias("other"), F.count_if(~stable).alias("open"), F.count_if(c("stability") == "technical_error").alias("technical"),
    )
    joined = runs.select("run_id").join(counts, "run_id", "left").na.fill(0)
    state = (
        F.when(c("probes") == 0, "not_executed").when(c("soft") > 0, "fail").when(c("technical") == c("probes"), "technical_error").when(c("open") > 0, "insufficient_evidence").when(c("other") > 0, "fail").otherwise("pass")
    )
    rows = joined.withColumn("evaluation_state", state)
    return rows.select(
        "run_id", F.lit("tech.synthetic_not_found_handling").alias("check_id"), "evaluation_state", F.when(c("evaluation_state") == "pass", "OK").when(c("evaluation_state") == "fail", "Warning").otherwise("NA").alias("status"),
        F.when(c("evaluation_state") == "fail", c("soft") + c("other")).otherwise(F.lit(0)).cast("bigint").alias("affected_count"),
    )
