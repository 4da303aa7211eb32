"""The checks as a table: the audit standard laid over results, the evidence that results give for each check, and constraints over both.

The standard is one small table per version; results name a version or get the current one, and a join on check and version lays it over them. A registry has one row for
each check that results mention or the library knows, with counts taken from all results. Constraints are named conditions over a registry row; all of them are evaluated
in one scan, and every row that breaks one gives a violation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewright.operators import canonical, header_checks, page_checks, resources
from sitewright.operators import coverage as CV
from sitewright.operators import scoring as SC
from sitewright.operators.predicates import Check

c = F.col
STANDARD_VERSION = "audit-standard-v1"

_NONE = (None, "fixed", "score_free", "disabled", "disabled", None, "none", None)
_SUMMARY = ("Info", "fixed", "score_free", "diagnostic_only", "diagnostic_only", None, "score_free_summary", None)
_INVENTORY = ("Info", "fixed", "score_free", "diagnostic_only", "diagnostic_only", None, "score_free_inventory", None)
_BOT = ("Low", "dynamic_low_medium", "score_capable", "fully_automated", "not_required", "ai_crawler_policy.robots_configuration", "shared_root_cause_member", None)


def _url(severity: str, role: str = "url_score_owner", mode: str = "fixed") -> tuple:
    return severity, mode, "score_capable", "fully_automated", "not_required", None, role, None


def _host(severity: str, key: str) -> tuple:
    return severity, "fixed", "score_capable", "fully_automated", "not_required", key, "host_configuration_score_owner", None


def _header(key: str, usage: str = "automated_with_limits", mode: str = "fixed", role: str = "header_configuration_score_owner") -> tuple:
    return "Low", mode, "score_capable", usage, "not_required", key, role, None


# fixed values: finding type, then severity, severity mode, score effect, usage, review status, deduplication key, roll-up role and score owner of a check
STANDARD: dict[str, tuple] = {
    "geo.ai_bots_policy_summary": ("info", *_SUMMARY),
    "geo.article_blog_pages_article_schema": ("opportunity", "Medium", "fixed", "score_free", "fully_automated", "not_required", "structured_data.article_coverage", "score_free_perspective", "tech.article_coverage_on_article_like_pages"),
    "geo.llms_full_txt_present": ("info", *_NONE),
    "geo.llms_txt_http_status": ("core_issue", "Low", "fixed", "score_capable", "fully_automated", "not_required", "ai_files.llms_txt", "score_deduplicated_perspective", "geo.llms_txt_present"),
    "geo.llms_txt_present": ("core_issue", "Low", "fixed", "score_capable", "fully_automated", "not_required", "ai_files.llms_txt", "primary_score_owner", None),
    "geo.robots_blocks_txt_files": ("core_issue", "Medium", "fixed", "score_capable", "fully_automated", "not_required", "ai_crawler_policy.robots_configuration", "shared_root_cause_member", None),
    "geo.robots_mentions_applebot": ("core_issue", *_BOT),
    "geo.robots_mentions_bytespider": ("core_issue", *_BOT),
    "geo.robots_mentions_ccbot": ("core_issue", *_BOT),
    "geo.robots_mentions_chatgpt_user": ("core_issue", *_BOT),
    "geo.robots_mentions_claude_web": ("core_issue", *_BOT),
    "geo.robots_mentions_claudebot": ("core_issue", *_BOT),
    "geo.robots_mentions_google_extended": ("core_issue", *_BOT),
    "geo.robots_mentions_gptbot": ("core_issue", *_BOT),
    "geo.robots_mentions_oai_searchbot": ("core_issue", *_BOT),
    "geo.robots_mentions_perplexitybot": ("core_issue", *_BOT),
    "geo.speakable_present": ("info", *_NONE),
    "tech.article_coverage_on_article_like_pages": ("core_issue", "Medium", "fixed", "score_capable", "fully_automated", "not_required", "structured_data.article_coverage", "primary_score_owner", None),
    "tech.cache_control_header": ("best_practice", *_header("http_cache.configuration", mode="dynamic_low_medium", role="shared_root_cause_member")),
    "tech.canonical_non_self": ("best_practice", "Info", "fixed", "conditional", "automated_with_limits", "required_before_scoring", None, "url_finding", None),
    "tech.cdn_cache_signals": ("best_practice", *_header("http_cache.configuration", mode="dynamic_low_medium", role="shared_root_cause_member")),
    "tech.compression_header": ("best_practice", *_header("http_compression.configuration", role="resource_root_score_owner")),
    "tech.content_security_policy": ("best_practice", *_header("security_headers.csp", mode="dynamic_low_medium")),
    "tech.duplicate_meta_descriptions": ("core_issue", *_url("Low", "url_group_score_owner")),
    "tech.duplicate_titles": ("core_issue", *_url("Medium", "url_group_score_owner")),
    "tech.h1_missing": ("core_issue", *_url("Medium")),
    "tech.high_ttfb": ("core_issue", *_url("Medium")),
    "tech.hreflang_x_default_missing": ("core_issue", *_url("Low", "cluster_score_owner")),
    "tech.hsts_header": ("best_practice", *_header("security_headers.hsts")),
    "tech.html_semantics_summary": ("info", *_SUMMARY),
    "tech.http_to_https_redirect": ("core_issue", *_host("Medium", "host.redirect_configuration")),
    "tech.http_version_support": ("best_practice", *_host("Low", "http_protocol.negotiation")),
    "tech.https_reachable": ("core_issue", *_host("High", "host.https_transport")),
    "tech.imported_resource_performance_signals": ("info", *_SUMMARY),
    "tech.internal_links_to_3xx": ("core_issue", *_url("Low", "normalized_target_score_owner")),
    "tech.json_ld_parse_errors": ("core_issue", *_url("Medium", "normalized_parse_root_score_owner", "dynamic_medium_high")),
    "tech.meta_description_missing": ("core_issue", *_url("Low")),
    "tech.meta_description_too_long": ("core_issue", *_url("Low")),
    "tech.meta_description_too_short": ("core_issue", *_url("Low")),
    "tech.multiple_h1": ("core_issue", *_url("Low")),
    "tech.permissions_policy": ("best_practice", *_header("security_headers.permissions_policy", mode="dynamic_low_medium")),
    "tech.product_coverage_on_product_like_pages": ("core_issue", *_url("Medium")),
    "tech.raw_h1_missing_rendered_present": ("core_issue", *_url("Low")),
    "tech.redirect_pages": ("info", *_INVENTORY),
    "tech.referrer_policy": ("best_practice", *_header("security_headers.referrer_policy", usage="fully_automated")),
    "tech.speakable_missing": ("info", *_NONE),
    "tech.status_code_distribution": ("info", *_INVENTORY),
    "tech.title_too_long": ("core_issue", *_url("Low")),
    "tech.title_too_short": ("core_issue", *_url("Low")),
    "tech.www_non_www_consistency": ("core_issue", *_host("Medium", "host.canonical_host_configuration")),
    "tech.x_content_type_options": ("best_practice", *_header("security_headers.content_type_protection", usage="fully_automated")),
    "tech.x_frame_options": ("best_practice", *_header("security_headers.frame_protection", mode="dynamic_low_medium")),
}
#: Checks whose findings a template pattern rolls up without a score of its own.
PATTERN_ROLLUPS = ("tech.meta_description_too_long", "tech.meta_description_too_short", "tech.multiple_h1", "tech.title_too_long", "tech.title_too_short")
FIELDS = ("finding_type", "severity", "severity_mode", "score_effect", "usage", "review_status", "deduplication_key", "rollup_role", "score_owner")

# fixed values of a registry entry
USAGES = ("fully_automated", "automated_with_limits", "diagnostic_only", "disabled")
SCORE_EFFECTS = ("score_capable", "conditional", "score_free")
EVIDENCE_CLASSES = ("primary_required", "primary_conditional", "secondary_diagnostic", "optional_opportunity", "inventory")
STATUSES = ("unvalidated", "fixture_validated", "single_domain_validated", "cross_domain_validated", "validated_with_limits", "manual_review_required", "invalid", "deprecated")
TRUSTED = ("cross_domain_validated", "validated_with_limits", "manual_review_required")


def standard(spark: SparkSession, entries: Mapping[str, tuple] = STANDARD, version: str = STANDARD_VERSION) -> DataFrame:
    """One version of the audit standard, a row for each check; versions are united by name."""
    names = ("check_id", *FIELDS)
    table = spark.createDataFrame([(check, *values) for check, values in entries.items()], ", ".join(f"{name} string" for name in names))
    return table.withColumns({
        "version": F.lit(version), "disabled": c("usage") == "disabled", "diagnostic_only": c("usage") == "diagnostic_only",
        "pattern_role": F.when(c("check_id").isin(*PATTERN_ROLLUPS), "template_rollup_score_free").otherwise("none"),
    })


def overlay(results: DataFrame, standards: DataFrame, version: str = STANDARD_VERSION) -> DataFrame:
    """Results with priority, finding type, score and review rules of the standard; checks without a row in it stay as they are.

    ``results`` has check_id, priority, finding_type, evaluation_state, status and review_recommended; a column standard_version chooses the version of a row, score_eligible,
    score_exclusion_reason, manual_priority, deduplication_key and automation_coverage are used where there are such columns.
    """
    own = lambda name, kind: c(f"r.{name}") if name in results.columns else F.lit(None).cast(kind)
    wanted = F.coalesce(own("standard_version", "string"), F.lit(version))
    joined = results.alias("r").join(standards.alias("s"), (c("r.check_id") == c("s.check_id")) & (wanted == c("s.version")), "left")
    found, manual = c("s.check_id").isNotNull(), own("manual_priority", "string")
    free = c("s.disabled") | (c("s.score_effect") == "score_free")
    dynamic = ((c("s.severity_mode") == "dynamic_medium_high") & c("r.priority").isin("Medium", "High")) | ((c("s.severity_mode") == "dynamic_low_medium") & c("r.priority").isin("Low", "Medium"))
    priority = F.when(~found | c("s.severity").isNull() | dynamic, F.coalesce("r.priority", F.lit("Info"))).when((c("s.score_effect") == "conditional") & manual.isNotNull(), manual).otherwise(c("s.severity"))
    by_state = F.when(c("r.evaluation_state").isNotNull(), c("r.evaluation_state").isin("pass", "fail")).otherwise(F.coalesce(c("r.status").isin("OK", "Warning", "Error"), F.lit(False)))
    eligible = F.when(~found, F.coalesce(own("score_eligible", "boolean"), by_state)).when(free, False).when(c("s.score_effect") == "conditional", F.coalesce(own("score_eligible", "boolean"), F.lit(False))).otherwise(by_state)
    reviewed = F.coalesce(c("r.review_recommended").cast("boolean"), F.lit(False))
    review = F.when(~found, reviewed).when(c("s.usage").isin("disabled", "diagnostic_only", "fully_automated"), False).when(c("s.review_status") == "required_before_scoring", F.coalesce(c("r.status").isin("Warning", "Error"), F.lit(False)) | reviewed).otherwise(reviewed)
    changes = {
        "original_priority": F.when(found, c("r.priority")), "original_finding_type": F.when(found, c("r.finding_type")), "priority": priority, "finding_type": F.coalesce("s.finding_type", "r.finding_type"), "score_eligible": eligible,
        "score_exclusion_reason": F.when(found & eligible, F.lit(None)).when(found & free, F.concat(F.lit("audit_standard_"), c("s.usage"))).otherwise(own("score_exclusion_reason", "string")),
        "deduplication_key": F.coalesce("s.deduplication_key", own("deduplication_key", "string")), "review_recommended": review,
        "automation_coverage": F.when(c("s.usage") == "fully_automated", "full").when(c("s.usage") == "automated_with_limits", "partial").otherwise(own("automation_coverage", "string")),
        "standard_version": F.when(found, c("s.version")), "standard_usage": c("s.usage"), "standard_severity": c("s.severity"), "standard_score_effect": c("s.score_effect"), "rollup_role": c("s.rollup_role"), "pattern_role": c("s.pattern_role"),
        "score_owner": c("s.score_owner"), "diagnostic_only": F.coalesce("s.diagnostic_only", F.lit(False)), "disabled": F.coalesce("s.disabled", F.lit(False)),
    }
    kept = [c(f"r.{name}") for name in results.columns if name not in changes]
    return joined.select(*kept, *[column.alias(name) for name, column in changes.items()])


def library_checks() -> list[Check]:
    """Every check that the library evaluates over its tables of pages, resources, images and headers."""
    return [*page_checks.all_page_checks(), *resources.resource_checks(), *resources.image_checks(), *canonical.canonical_checks(), *header_checks.security_checks(), *header_checks.delivery_checks()]


def known_checks(spark: SparkSession, checks: Sequence[Check]) -> DataFrame:
    """Id, name, category and default severity of checks of the library."""
    rows = [(check.id, check.id.partition(".")[2].replace("_", " "), check.category, check.priority, check.score_eligible) for check in checks]
    return spark.createDataFrame(rows, "check_id string, name string, category string, default_severity string, scores boolean")


def observed(results: DataFrame, runs: DataFrame) -> DataFrame:
    """What all results say about each check: category, cases with and without a finding, runs and domains."""
    rows = results.select("run_id", "check_id", "category", "status").join(runs.select("run_id", "final_domain"), "run_id", "left")
    # every level halves the distinct counting: no check's runs or domains are gathered
    runs_of = rows.groupBy("check_id", "final_domain", "run_id").agg(
        F.min("category").alias("category"), F.count_if(c("status").isin("Warning", "Error")).alias("positive_cases"), F.count_if(c("status") == "OK").alias("negative_cases"), F.count(F.lit(1)).alias("observations"))
    sums = [F.sum(name).alias(name) for name in ("positive_cases", "negative_cases", "observations")]
    domains = runs_of.groupBy("check_id", "final_domain").agg(F.min("category").alias("category"), *sums, F.count(F.lit(1)).alias("runs"))
    return domains.groupBy("check_id").agg(F.min("category").alias("category"), *sums, F.sum("runs").alias("runs"), F.count("final_domain").alias("domains"))


def entries(seen: DataFrame, active: DataFrame, standards: DataFrame) -> DataFrame:
    """Registry rows of all checks that are active or were seen, with a validation status that follows from the evidence."""
    rows = seen.alias("o").join(active.alias("a"), "check_id", "full").join(standards.where(c("version") == STANDARD_VERSION).alias("s"), "check_id", "left")
    is_active, number = c("a.name").isNotNull(), lambda name: F.coalesce(f"o.{name}", F.lit(0))
    both = (number("positive_cases") > 0) & (number("negative_cases") > 0)
    status = (
        F.when(~is_active, "deprecated").when(c("s.review_status") == "required_before_scoring", "manual_review_required").when((number("domains") >= 2) & both & (number("runs") >= 2), "cross_domain_validated")
        .when(number("domains") >= 2, "validated_with_limits").when(number("domains") == 1, "single_domain_validated").otherwise("unvalidated")
    )
    scored = F.coalesce("s.score_effect", F.when(F.coalesce("a.scores", F.lit(False)), "score_capable").otherwise("score_free"))
    return rows.select(
        "check_id", F.coalesce("a.name", F.regexp_replace(F.regexp_replace("check_id", r"^[a-z]+\.", ""), "_", " ")).alias("name"), F.coalesce("a.category", "o.category").alias("category"), is_active.alias("active"), status.alias("validation_status"),
        F.coalesce("s.severity", "a.default_severity", F.lit("None")).alias("default_severity"), F.coalesce("s.finding_type", F.lit("core_issue")).alias("finding_type"), scored.alias("score_effect"), c("s.usage").alias("standard_usage"),
        F.coalesce("s.disabled", F.lit(False)).alias("disabled"), F.coalesce("s.diagnostic_only", F.lit(False)).alias("diagnostic_only"), CV.evidence_class(c("check_id"), F.lit(0)).alias("evidence_class"), CV.unit_key(c("check_id")).alias("coverage_unit"),
        SC.family(c("check_id")).alias("root_cause_family"), *[number(name).alias(name) for name in ("positive_cases", "negative_cases", "observations", "runs", "domains")],
    )


def constraints() -> dict[str, Column]:
    """Named conditions that every registry row must meet. The columns a_* are those of the active check, s_* those of the standard."""
    status, registered, aligned = c("validation_status"), c("a_name").isNotNull(), c("s_usage").isNotNull()
    implies = lambda if_so, then: ~F.coalesce(if_so, F.lit(False)) | F.coalesce(then, F.lit(False))
    same = lambda name: implies(aligned, c(name).eqNullSafe(c(f"s_{name}")))
    counts = ("positive_cases", "negative_cases", "observations", "runs", "domains")
    return {
        "check_id_missing": F.trim(F.coalesce("check_id", F.lit(""))) != "",
        "check_id_repeated": c("copies") == 1,
        "validation_status_unknown": status.isin(*STATUSES),
        "score_effect_unknown": c("score_effect").isin(*SCORE_EFFECTS),
        "evidence_class_unknown": c("evidence_class").isin(*EVIDENCE_CLASSES),
        "inventory_incomplete": c("name").isNotNull() & c("category").isNotNull() & c("finding_type").isNotNull() & c("default_severity").isNotNull(),
        "coverage_incomplete": c("coverage_unit").isNotNull() & c("root_cause_family").isNotNull(),
        "count_negative": F.least(*[F.coalesce(name, F.lit(-1)) for name in counts]) >= 0,
        "active_check_marked_inactive": implies(registered, c("active")),
        "unknown_active_check": implies(c("active"), registered),
        "removed_check_not_deprecated": implies(~registered, status == "deprecated"),
        "deprecated_check_active": implies(status == "deprecated", ~c("active")),
        "name_stale": implies(registered, c("name") == c("a_name")),
        "category_stale": implies(registered, c("category") == c("a_category")),
        "severity_stale": implies(registered & ~aligned, c("default_severity") == c("a_default_severity")),
        "single_domain_without_evidence": implies(status == "single_domain_validated", (c("domains") >= 1) & (c("runs") >= 1)),
        "cross_domain_without_evidence": implies(status == "cross_domain_validated", (c("domains") >= 2) & (c("runs") >= 2) & (c("positive_cases") >= 1) & (c("negative_cases") >= 1)),
        "limits_without_evidence": implies(status == "validated_with_limits", c("domains") >= 2),
        "invalid_check_scored": implies(status == "invalid", c("score_effect") == "score_free"),
        "finding_type_against_standard": same("finding_type"),
        "score_effect_against_standard": same("score_effect"),
        "usage_against_standard": implies(aligned, c("standard_usage") == c("s_usage")),
        "disabled_against_standard": implies(aligned, c("disabled") == c("s_disabled")),
        "severity_against_standard": implies(aligned & ~c("s_disabled"), c("default_severity") == c("s_severity")),
        "diagnostic_check_scored": implies(c("diagnostic_only"), (c("score_effect") == "score_free") & (c("finding_type") == "info")),
        "disabled_check_in_use": implies(c("disabled"), ~c("active") & (status == "deprecated") & (c("score_effect") == "score_free")),
        "disabled_check_has_severity": implies(c("disabled"), c("default_severity") == "None"),
        "standard_check_not_active": implies(aligned & ~c("s_disabled"), c("active") & registered),
    }


def violations(registry: DataFrame, active: DataFrame, standards: DataFrame) -> DataFrame:
    """check_id and constraint of every rule that a registry row breaks, and of active checks without a row."""
    known = active.select("check_id", *[c(name).alias(f"a_{name}") for name in ("name", "category", "default_severity")])
    laid = standards.where(c("version") == STANDARD_VERSION).select("check_id", *[c(name).alias(f"s_{name}") for name in ("finding_type", "score_effect", "usage", "severity", "disabled")])
    rows = registry.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("check_id"))).join(known, "check_id", "left").join(laid, "check_id", "left")
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in constraints().items()]))
    found = rows.select("check_id", F.explode(broken).alias("constraint"))
    missing = active.select("check_id").join(registry.select("check_id"), "check_id", "left_anti").withColumn("constraint", F.lit("active_check_without_row"))
    repeated = active.groupBy("check_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("check_id", F.lit("active_check_repeated").alias("constraint"))
    return found.unionByName(missing).unionByName(repeated)


def status_summary(registry: DataFrame) -> DataFrame:
    """Checks by validation status, active ones and those that scores may rely on."""
    return registry.groupBy("validation_status").agg(F.count(F.lit(1)).alias("checks"), F.count_if("active").alias("active_checks"), F.count_if(c("active") & c("validation_status").isin(*TRUSTED)).alias("trusted_checks"))


def stale_summary(registry: DataFrame, stated: DataFrame) -> DataFrame:
    """Rows of a stated summary (as ``status_summary`` makes it) that differ from the registry."""
    now = status_summary(registry).alias("n")
    joined = now.join(stated.alias("t"), "validation_status", "full")
    differs = F.lit(False)
    for name in ("checks", "active_checks", "trusted_checks"):
        differs = differs | (F.coalesce(f"n.{name}", F.lit(0)) != F.coalesce(f"t.{name}", F.lit(0)))
    return joined.where(differs).select("validation_status", F.coalesce("n.checks", F.lit(0)).alias("checks"), F.coalesce("t.checks", F.lit(0)).alias("stated_checks"))
