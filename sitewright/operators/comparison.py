"""Snapshot comparison: run pairs, finding, URL, template and performance deltas, regressions, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.functions import url as U
from sitewright.operators.scoring import lookup

c = F.col
# fixed values: orders and thresholds of the delta rules
STATUS_RANK = {"OK": 0, "NA": 1, "Warning": 2, "Error": 3}
PRIORITY_RANK = {"Low": 0, "Medium": 1, "High": 2}
SCORE_STEP, LCP_STEP, TBT_STEP, CLS_STEP = 0.05, 500, 100, 0.05


def normalized_domain(text: Column) -> Column:
    plain = F.trim(F.coalesce(text, F.lit("")))
    full = F.when(plain.contains("://"), plain).otherwise(F.concat(F.lit("https://"), plain))
    return F.coalesce(U.strip_www(U.host(full)), F.lit(""))


def schedule_pairs(runs: DataFrame) -> DataFrame:
    """Every completed run of a schedule with the completed run before it."""
    order = Window.partitionBy("schedule_id").orderBy("finished_at", "run_id")
    done = runs.where(c("status") == "completed").withColumn("base_run", F.lag("run_id").over(order))
    return done.where(c("base_run").isNotNull()).select("base_run", F.col("run_id").alias("compare_run"), "schedule_id")


def comparability(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Status of each pair and what limits it: domains, run states, check areas, crawl and sampling settings."""
    fields = ["run_id", "final_domain", "status", "check_area", "max_urls", "lab_sampling", "browser_sampling"]
    left = runs.select(*[F.col(f).alias(f"base_{f}") for f in fields])
    right = runs.select(*[F.col(f).alias(f"compare_{f}") for f in fields])
    joined = pairs.join(left, pairs["base_run"] == c("base_run_id")).join(right, pairs["compare_run"] == c("compare_run_id"))
    same = normalized_domain(c("base_final_domain")) == normalized_domain(c("compare_final_domain"))
    differs = lambda name: ~c(f"base_{name}").eqNullSafe(c(f"compare_{name}"))
    warnings = F.array_compact(
        F.array(
            F.when((c("base_status") != "completed") | (c("compare_status") != "completed"), F.lit("incomplete_run")), F.when(differs("check_area"), F.lit("check_area_differs")),
            F.when(differs("max_urls"), F.lit("crawl_configuration_differs")), F.when(differs("lab_sampling") | differs("browser_sampling"), F.lit("sampling_configuration_differs")),
        )
    )
    return joined.select("base_run", "compare_run", F.when(same, "completed").otherwise("not_comparable").alias("status"), F.when(same, warnings).otherwise(F.array(F.lit("different_domain"))).alias("warnings"))


def representatives(findings: DataFrame) -> DataFrame:
    """One finding per run and grouping key: worst status, then priority, then lowest score."""
    key = F.coalesce(F.nullif(c("report_grouping_key"), F.lit("")), c("check_id"))
    if "template_key" in findings.columns:
        key = F.concat_ws("::", key, c("template_key"))
    order = F.struct(-lookup(c("status"), STATUS_RANK, -1), -lookup(c("priority"), PRIORITY_RANK, -1), F.coalesce(c("score"), F.lit(999)), c("finding_id"))
    fields = ["finding_id", "check_id", "category", "status", "priority", "score", "affected_count", "review_status"]
    fields += [name for name in ("sample_urls",) if name in findings.columns]
    return findings.groupBy("run_id", key.alias("finding_key")).agg(F.min_by(F.struct(*fields), order).alias("m")).select("run_id", "finding_key", "m.*")


def is_issue(status: Column) -> Column:
    return F.coalesce(status.isin("Warning", "Error"), F.lit(False))


def _sides(pairs: DataFrame, rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    def side(name: str) -> DataFrame:
        renamed = rows.select(F.col("run_id").alias(f"{name}_run"), *key, *[F.col(x).alias(f"{name}_{x}") for x in rows.columns if x not in ("run_id", *key)])
        return pairs.select("base_run", "compare_run").join(renamed, f"{name}_run").withColumn(f"in_{name}", F.lit(True))

    return side("base"), side("compare")


def findings_delta(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Change of every finding key between the two runs of each pair."""
    base, compare = _sides(pairs, representatives(findings), ["finding_key"])
    joined = base.join(compare, ["base_run", "compare_run", "finding_key"], "full_outer")
    before, after = is_issue(c("base_status")), is_issue(c("compare_status"))
    status = lookup(c("compare_status"), STATUS_RANK, -1) - lookup(c("base_status"), STATUS_RANK, -1)
    priority = lookup(c("compare_priority"), PRIORITY_RANK, -1) - lookup(c("base_priority"), PRIORITY_RANK, -1)
    score = c("compare_score") - c("base_score")
    kind = (
        F.when(~before & after, "new").when(before & ~after, "resolved")
        .when(before & after & ((status > 0) | (priority > 0) | F.coalesce(score < 0, F.lit(False))), "worsened")
        .when(before & after & ((status < 0) | (priority < 0) | F.coalesce(score > 0, F.lit(False))), "improved")
        .when(before & after, "unchanged_issue").otherwise("unchanged_ok")
    )
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    unreviewed = lambda name: F.coalesce(c(name), F.lit("unreviewed"))
    output = joined.select(
        "base_run", "compare_run", "finding_key", F.coalesce("compare_check_id", "base_check_id").alias("check_id"), F.coalesce("base_status", F.lit("missing")).alias("base_status"),
        F.coalesce("compare_status", F.lit("missing")).alias("compare_status"), F.coalesce("compare_priority", F.lit("")).alias("compare_priority"), "base_score", "compare_score",
        (zero("compare_affected_count") - zero("base_affected_count")).alias("affected_delta"), kind.alias("delta_type"),
        F.coalesce(c("in_base") & c("in_compare") & (unreviewed("base_review_status") != unreviewed("compare_review_status")), F.lit(False)).alias("review_changed"),
        *[c(name) for name in ("base_sample_urls", "compare_sample_urls") if name in joined.columns],
    )
    return output


def sample_diff(base: Column, compare: Column) -> Column:
    """Added, removed and still affected sample URLs."""
    empty = F.array().cast("array<string>")
    before, after = F.coalesce(base, empty), F.coalesce(compare, empty)
    return F.struct(F.array_except(after, before).alias("added"), F.array_except(before, after).alias("removed"), F.array_intersect(after, before).alias("still_affected"))


def _latest(pages: DataFrame) -> DataFrame:
    fields = [name for name in pages.columns if name not in ("run_id", "normalized_url")]
    return pages.groupBy("run_id", "normalized_url").agg(F.max_by(F.struct(*fields), "page_id").alias("m")).select("run_id", "normalized_url", "m.*")


def _tag(df: DataFrame, side: str, key: list[str]) -> DataFrame:
    return df.select(*key, F.lit(True).alias(f"in_{side}"), *[F.col(name).alias(f"{side}_{name}") for name in df.columns if name not in key])


def url_delta(base: DataFrame, compare: DataFrame) -> DataFrame:
    """First difference of every page between two snapshots of a run scope, in a fixed order of importance."""
    key = ["run_id", "normalized_url"]
    joined = _tag(_latest(base), "base", key).join(_tag(_latest(compare), "compare", key), key, "full_outer")
    text = lambda name: F.coalesce(c(name), F.lit(""))
    flag = lambda name: F.coalesce(c(name), F.lit(0)) == 1
    kind = (
        F.when(c("in_base").isNull(), "newUrl").when(c("in_compare").isNull(), "removedUrl")
        .when(F.coalesce(c("base_status_code"), F.lit(0)) != F.coalesce(c("compare_status_code"), F.lit(0)), "statusChanged")
        .when(~flag("base_indexable") & flag("compare_indexable"), "becameIndexable").when(flag("base_indexable") & ~flag("compare_indexable"), "becameNoindex")
        .when(text("base_title") != text("compare_title"), "titleChanged").when(text("base_canonical") != text("compare_canonical"), "canonicalChanged")
        .when(text("base_page_type") != text("compare_page_type"), "pageTypeChanged").otherwise("unchangedUrl")
    )
    return joined.select(*key, kind.alias("delta_type"), "base_status_code", "compare_status_code", "base_indexable", "compare_indexable")


def template_delta(base: DataFrame, compare: DataFrame) -> DataFrame:
    """Change per template cluster; summaries come as text in ``schema_summary``."""
    key = ["run_id", "cluster_key"]
    joined = _tag(base, "base", key).join(_tag(compare, "compare", key), key, "full_outer")
    number = lambda name: F.coalesce(c(name), F.lit(0))
    kind = (
        F.when(c("in_base").isNull(), "newTemplate").when(c("in_compare").isNull(), "removedTemplate").when(number("base_url_count") != number("compare_url_count"), "urlCountChanged")
        .when(F.abs(number("base_avg_word_count") - number("compare_avg_word_count")) >= 50, "avgWordCountChanged")
        .when(F.coalesce(c("base_schema_summary"), F.lit("")) != F.coalesce(c("compare_schema_summary"), F.lit("")), "schemaCoverageChanged").otherwise("unchangedTemplate")
    )
    return joined.select(*key, kind.alias("delta_type"), (number("compare_url_count") - number("base_url_count")).alias("url_count_delta"), F.round(c("compare_avg_word_count") - c("base_avg_word_count"), 2).alias("avg_word_count_delta"))


def performance_delta(base: DataFrame, compare: DataFrame) -> DataFrame:
    """Change per sampled template with thresholds for score, timings, layout shift and browser findings."""
    key = ["run_id", "cluster_key"]
    joined = _tag(base, "base", key).join(_tag(compare, "compare", key), key, "full_outer")
    delta = lambda name: F.round(c(f"compare_{name}") - c(f"base_{name}"), 3)
    rows = joined.withColumns({"score_delta": delta("avg_performance_score"), "lcp_delta": delta("avg_lcp_ms"), "tbt_delta": delta("avg_tbt_ms"), "cls_delta": delta("avg_cls")})
    number = lambda name: F.coalesce(c(name), F.lit(0))
    kind = (
        F.when(c("in_base").isNull() | c("in_compare").isNull(), "notComparable")
        .when((number("base_lab_success_count") == 0) | (number("compare_lab_success_count") == 0), "lighthouseUnavailableInOneRun")
        .when((number("base_console_error_sample_count") == 0) & (number("compare_console_error_sample_count") > 0), "consoleErrorsNew")
        .when((number("base_console_error_sample_count") > 0) & (number("compare_console_error_sample_count") == 0), "consoleErrorsResolved")
        .when(number("compare_js_required_count") > number("base_js_required_count"), "renderingRegressed")
        .when(c("score_delta") <= -SCORE_STEP, "performanceRegressed").when(c("score_delta") >= SCORE_STEP, "performanceImproved")
        .when((c("lcp_delta") >= LCP_STEP) | (c("tbt_delta") >= TBT_STEP) | (c("cls_delta") >= CLS_STEP), "performanceRegressed")
        .when((c("lcp_delta") <= -LCP_STEP) | (c("tbt_delta") <= -TBT_STEP) | (c("cls_delta") <= -CLS_STEP), "performanceImproved").otherwise("notComparable")
    )
    return rows.select(*key, kind.alias("delta_type"), "score_delta", "lcp_delta", "tbt_delta", "cls_delta")


def delta_counts(delta: DataFrame, key: list[str]) -> DataFrame:
    return delta.groupBy(*key, "delta_type").agg(F.count(F.lit(1)).alias("n"))


def finding_counts(findings: DataFrame) -> DataFrame:
    """Counts of active findings of a run, as the comparison summary uses them."""
    active = is_issue(c("status")) & ~F.coalesce(c("review_status"), F.lit("unreviewed")).isin("false_positive", "ignored")
    low = F.lower(F.coalesce(c("category"), F.lit("")))
    kind = F.coalesce(c("finding_type"), F.lit("core_issue"))
    return findings.groupBy("run_id").agg(
        F.count_if(active & (c("status") == "Warning")).alias("warnings"), F.count_if(active & (c("status") == "Error")).alias("errors"), F.count_if(c("review_recommended") == 1).alias("review_recommended"),
        F.count_if(active & (kind == "core_issue")).alias("core_issues"), F.count_if(active & (c("check_area") == "geo") & ((kind == "opportunity") | low.contains("geo"))).alias("geo_opportunities"),
        F.count_if(active & (low.contains("security") | (kind == "best_practice"))).alias("security_best_practices"), F.count_if(active & low.contains("media")).alias("media_findings"),
        F.count_if(active & (low.rlike("template performance|javascript & rendering") | c("check_id").startswith("template."))).alias("template_performance"),
    )


COUNTS = ("warnings", "errors", "review_recommended", "core_issues", "geo_opportunities", "security_best_practices", "media_findings", "template_performance")


def summary(findings: DataFrame, pairs: DataFrame, run_scores: DataFrame) -> DataFrame:
    """Per pair: score change, changes of the finding counts, finding deltas by type."""
    counts = finding_counts(findings)
    score = run_scores.where(c("model") == "overall").select("run_id", "score")
    facts = counts.join(score, "run_id", "left")
    base, compare = _sides(pairs, facts, [])
    joined = base.drop("in_base").join(compare.drop("in_compare"), ["base_run", "compare_run"])
    deltas = findings_delta(findings, pairs).groupBy("base_run", "compare_run").agg(*[F.count_if(c("delta_type") == name).alias(name) for name in ("new", "resolved", "worsened", "improved", "unchanged_issue")])
    rows = joined.join(deltas, ["base_run", "compare_run"], "left").na.fill(0, ["new", "resolved", "worsened", "improved", "unchanged_issue"])
    return rows.select(
        "base_run", "compare_run", (c("compare_score") - c("base_score")).alias("score_delta"), *[(c(f"compare_{name}") - c(f"base_{name}")).alias(f"{name}_delta") for name in COUNTS],
        "new", "resolved", "worsened", "improved", "unchanged_issue",
    )


def regressions(finding_changes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Named regressions and improvements per pair from finding changes and the score change."""
    per_pair = finding_changes.groupBy("base_run", "compare_run").agg(
        F.count_if((c("delta_type") == "new") & (c("compare_priority") == "High")).alias("new_high"), F.count_if(c("delta_type") == "resolved").alias("resolved")
    )
    joined = summaries.select("base_run", "compare_run", "score_delta").join(per_pair, ["base_run", "compare_run"], "left").na.fill(0, ["new_high", "resolved"])
    rules = F.array_compact(
        F.array(
            F.when(c("new_high") > 0, F.struct(F.lit("new_high_priority_findings").alias("regression"), c("new_high").cast("double").alias("size"), F.lit("warning").alias("severity"))),
            F.when(c("score_delta") <= -5, F.struct(F.lit("overall_score_drop").alias("regression"), c("score_delta").cast("double").alias("size"), F.lit("warning").alias("severity"))),
            F.when(c("resolved") > 0, F.struct(F.lit("resolved_findings").alias("regression"), c("resolved").cast("double").alias("size"), F.lit("positive").alias("severity"))),
        )
    )
    return joined.select("base_run", "compare_run", F.inline(rules))


def snapshot_regressions(urls: DataFrame, performance: DataFrame) -> DataFrame:
    """Regressions that page and template deltas show: lost indexing, new failing URLs, slower templates."""
    page_side = urls.groupBy("run_id").agg(
        F.count_if(c("delta_type") == "becameNoindex").alias("noindex"), F.count_if(c("delta_type").isin("newUrl", "statusChanged") & (F.coalesce(c("compare_status_code"), F.lit(0)) >= 400)).alias("broken")
    )
    lab_side = performance.groupBy("run_id").agg(F.count_if(c("delta_type") == "performanceRegressed").alias("slower"))
    joined = page_side.join(lab_side, "run_id", "full_outer").na.fill(0)
    rules = F.array_compact(
        F.array(*[F.when(c(name) > 0, F.struct(F.lit(label).alias("regression"), c(name).alias("size"))) for name, label in (("noindex", "pages_became_noindex"), ("broken", "new_failing_urls"), ("slower", "template_performance_drop"))])
    )
    return joined.select("run_id", F.inline(rules))


def evidence_summary(evidence: Column) -> Column:
    """A JSON object with scalars kept and arrays and objects reduced to their sizes, keys in order."""
    def short(key: Column, value: Column) -> Column:
        items = F.json_array_length(value)
        size = F.when(value.rlike(r"^\s*\["), items).when(value.rlike(r"^\s*\{"), F.size(F.json_object_keys(value)))
        return F.concat(key, F.lit("="), F.when(size.isNotNull(), F.concat(F.lit("#"), size.cast("string"))).otherwise(value))

    pairs = F.array_sort(F.map_entries(F.from_json(evidence, "map<string,string>")))
    return F.array_join(F.transform(pairs, lambda pair: short(pair["key"], pair["value"])), ";")
