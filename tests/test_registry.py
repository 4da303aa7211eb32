"""The audit standard over results, the registry of checks, and constraints that find what was broken on purpose."""

import pytest
from pyspark.sql import functions as F

from sitewright.catalog.summary_queries import ACTIVE_CHECKS
from sitewright.operators import registry as RG

c = F.col
RESULTS = "check_id string, priority string, finding_type string, evaluation_state string, status string, review_recommended int, manual_priority string, score_eligible boolean, standard_version string"


def laid(spark, *rows, standards=None):
    frame = spark.createDataFrame([(*row, *[None] * (9 - len(row)), n) for n, row in enumerate(rows)], RESULTS + ", n int")
    return RG.overlay(frame, standards if standards is not None else RG.standard(spark)).orderBy("n").collect()


def test_priorities(spark):
    rows = laid(
        spark, ("tech.h1_missing", "High", "info", "fail", "Warning", 1), ("tech.json_ld_parse_errors", "High", "info", "fail", "Error", 0), ("tech.json_ld_parse_errors", "Low", "info", "fail", "Error", 0),
        ("tech.permissions_policy", "Medium", "info", "pass", "OK", 1), ("tech.canonical_non_self", "Low", "info", "fail", "Warning", 0, "High", True), ("tech.canonical_non_self", "Low", "info", "fail", "Warning", 0), ("own.check", "Low", "info", "fail", "Warning", 1),
        ("geo.speakable_present", None, "x", "pass", "OK", 0),
    )
    assert [r.priority for r in rows] == ["Medium", "High", "Medium", "Medium", "High", "Info", "Low", "Info"]
    assert [r.score_eligible for r in rows] == [True, True, True, True, True, False, True, False]
    assert [r.review_recommended for r in rows] == [False, False, False, True, True, True, True, False]
    assert [r.original_priority for r in rows][:2] == ["High", "High"] and rows[6].original_priority is None
    assert rows[7].disabled and rows[7].score_exclusion_reason == "audit_standard_disabled"
    assert [r.automation_coverage for r in rows][:4] == ["full", "full", "full", "partial"]


def test_versions(spark):
    later = RG.standard(spark, {"tech.h1_missing": ("best_practice", "Low", *RG.STANDARD["tech.h1_missing"][2:])}, "audit-standard-v2")
    rows = laid(spark, ("tech.h1_missing", "High", "info", "fail", "Warning", 0, None, None, "audit-standard-v2"), ("tech.h1_missing", "High", "info", "fail", "Warning", 0), standards=RG.standard(spark).unionByName(later))
    assert [(r.priority, r.finding_type, r.standard_version) for r in rows] == [("Low", "best_practice", "audit-standard-v2"), ("Medium", "core_issue", "audit-standard-v1")]


@pytest.fixture(scope="module")
def sound(spark):
    """A registry of the library's checks and the standard's, none of them broken."""
    active = RG.known_checks(spark, RG.library_checks())
    rest = spark.createDataFrame([(check, check, "Other", "Low", True) for check, row in RG.STANDARD.items() if row[4] != "disabled"], active.schema).join(active.select("check_id"), "check_id", "left_anti")
    active = active.unionByName(rest.select(*active.columns)).cache()
    seen = active.select("check_id", "category", F.lit(3).cast("long").alias("positive_cases"), F.lit(2).cast("long").alias("negative_cases"), F.lit(5).cast("long").alias("observations"), F.lit(2).cast("long").alias("runs"), F.lit(2).cast("long").alias("domains"))
    return RG.entries(seen, active, RG.standard(spark)).cache(), active, RG.standard(spark)


def test_sound_registry_has_no_violations(sound):
    registry, active, standards = sound
    assert RG.violations(*sound).count() == 0
    assert registry.count() == active.count()
    assert {r.validation_status for r in registry.collect()} == {"cross_domain_validated", "manual_review_required"}


BROKEN = [
    ("tech.h1_missing", {"score_effect": "'much'"}, {"score_effect_unknown", "score_effect_against_standard"}),
    ("tech.title_missing", {"validation_status": "'fine'"}, {"validation_status_unknown"}),
    ("tech.title_missing", {"domains": "1L"}, {"cross_domain_without_evidence"}),
    ("tech.title_missing", {"positive_cases": "-1L"}, {"count_negative", "cross_domain_without_evidence"}),
    ("tech.title_missing", {"category": "'Old'"}, {"category_stale"}),
    ("tech.title_missing", {"name": "CAST(NULL AS string)"}, {"name_stale", "inventory_incomplete"}),
    ("tech.title_missing", {"default_severity": "'High'"}, {"severity_stale"}),
    ("tech.title_missing", {"active": "false"}, {"active_check_marked_inactive"}),
    ("tech.title_missing", {"validation_status": "'invalid'", "score_effect": "'score_capable'"}, {"invalid_check_scored"}),
    ("tech.h1_missing", {"default_severity": "'High'"}, {"severity_against_standard"}),
    ("tech.h1_missing", {"finding_type": "'info'"}, {"finding_type_against_standard"}),
    ("tech.h1_missing", {"standard_usage": "'disabled'"}, {"usage_against_standard"}),
    ("tech.redirect_pages", {"finding_type": "'core_issue'"}, {"finding_type_against_standard", "diagnostic_check_scored"}),
    ("tech.title_missing", {"evidence_class": "'none'", "coverage_unit": "CAST(NULL AS string)"}, {"evidence_class_unknown", "coverage_incomplete"}),
    ("tech.title_missing", {"check_id": "'gone.check'"}, {"unknown_active_check", "removed_check_not_deprecated", "active_check_without_row"}),
    ("tech.title_missing", {"check_id": "CAST(NULL AS string)"}, {"check_id_missing", "unknown_active_check", "removed_check_not_deprecated", "active_check_without_row"}),
    ("tech.title_missing", {"check_id": "'geo.speakable_present'", "disabled": "true"}, {"unknown_active_check", "removed_check_not_deprecated", "active_check_without_row", "disabled_check_in_use", "disabled_check_has_severity",
        "finding_type_against_standard", "score_effect_against_standard", "usage_against_standard"}),
    ("tech.title_missing", {"validation_status": "'deprecated'"}, {"deprecated_check_active"}),
    ("tech.title_missing", {"validation_status": "'single_domain_validated'", "runs": "0L"}, {"single_domain_without_evidence"}),
    ("tech.title_missing", {"validation_status": "'validated_with_limits'", "domains": "1L"}, {"limits_without_evidence"}),
]


@pytest.mark.parametrize("number", range(len(BROKEN)))
def test_seeded_violations(sound, number):
    registry, active, standards = sound
    check, changes, wanted = BROKEN[number]
    broken = registry.withColumns({name: F.when(c("check_id") == check, F.expr(value)).otherwise(c(name)) for name, value in changes.items()})
    assert wanted == {r.constraint for r in RG.violations(broken, active, standards).collect()}


def test_repeated_rows(sound):
    registry, active, standards = sound
    one = registry.where("check_id = 'tech.title_missing'")
    assert {(r.check_id, r.constraint) for r in RG.violations(registry.unionByName(one), active, standards).collect()} == {("tech.title_missing", "check_id_repeated")}
    twice = active.unionByName(active.where("check_id = 'tech.title_missing'"))
    assert ("tech.title_missing", "active_check_repeated") in {(r.check_id, r.constraint) for r in RG.violations(registry, twice, standards).collect()}


def test_summaries(sound):
    registry, _, _ = sound
    stated = RG.status_summary(registry)
    assert RG.stale_summary(registry, stated).count() == 0
    changed = registry.withColumn("validation_status", F.when(c("check_id") == "tech.title_missing", "invalid").otherwise(c("validation_status")))
    assert {r.validation_status: (r.checks, r.stated_checks) for r in RG.stale_summary(changed, stated).collect()}["invalid"] == (1, 0)


def test_observed_counts(spark):
    runs = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "run_id string, final_domain string")
    results = spark.createDataFrame([("a", "k", "C", "OK"), ("a", "k", "C", "Error"), ("b", "k", "C", "Warning"), ("c", "k", "C", "NA"), ("z", "l", "C", "OK")], "run_id string, check_id string, category string, status string")
    got = {r.check_id: (r.positive_cases, r.negative_cases, r.observations, r.runs, r.domains) for r in RG.observed(results, runs).collect()}
    assert got == {"k": (2, 1, 4, 3, 2), "l": (0, 1, 1, 1, 0)}


def test_checks_named_for_duckdb(spark):
    named = {(check, *key) for key, ids in ACTIVE_CHECKS.items() for check in ids}
    assert named == {(check.id, check.priority, check.score_eligible) for check in RG.library_checks()}
