"""URL templates: clusters with aggregates and samples, pattern checks, performance summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.config import THRESHOLDS
from sitewright.functions import url as U
from sitewright.functions.schema_types import in_family
from sitewright.operators import canonical as CA
from sitewright.operators import head as HD
from sitewright.operators import scopes as S

c = F.col
T = THRESHOLDS


def with_cluster_key(pages: DataFrame) -> DataFrame:
    """Pages with their URL template and cluster key (page type and template)."""
    template = U.url_template(F.coalesce(c("final_url"), c("url")), S.page_type())
    return U.computed_once(pages, {"url_pattern": template}).withColumn("cluster_key", F.concat(S.page_type(), F.lit(":"), c("url_pattern")))


def issue_counts(check_samples: DataFrame) -> DataFrame:
    """How many failing checks name a URL as a sample."""
    return check_samples.where(c("status").isin("Warning", "Error")).groupBy("run_id", "url").agg(F.count(F.lit(1)).alias("issues"))


def _mean(name: str, places: int = 2) -> Column:
    # A missing number counts as zero here, as in the stored summaries.
    return F.round(F.avg(F.coalesce(c(name), F.lit(0))), places)


def clusters(pages: DataFrame, issues: DataFrame | None = None, per_template: int = 5, total: int = 200) -> DataFrame:
    """One row per (run, template cluster) with counts, status and type maps, averages and representative samples."""
    keyed = with_cluster_key(pages)
    if issues is not None:
        keyed = keyed.join(issues, ["run_id", "url"], "left")
    else:
        keyed = keyed.withColumn("issues", F.lit(0))
    key = ["run_id", "cluster_key"]
    indexable = F.coalesce(c("indexable"), F.lit(0)) == 1
    typed = F.size(F.coalesce(c("schema_types"), F.array().cast("array<string>"))) > 0
    totals = keyed.groupBy(*key).agg(
        F.first(S.page_type()).alias("page_type"), F.first("url_pattern").alias("url_pattern"), F.count(F.lit(1)).alias("url_count"),
        F.count_if(indexable).alias("indexable_count"), F.count_if(~indexable).alias("non_indexable_count"),
        _mean("word_count_raw").alias("avg_word_count"), _mean("internal_links").alias("avg_internal_links"), _mean("external_links").alias("avg_external_links"),
        F.min(F.when((c("status_code") == 200) & indexable, c("url"))).alias("s1"),
        F.min_by("url", F.struct(F.coalesce(c("word_count_raw"), F.lit(0)), c("url"))).alias("s2"),
        F.min_by("url", F.struct(-F.coalesce(c("issues"), F.lit(0)), c("url"))).alias("s3"),
        F.min(F.when(typed, c("url"))).alias("s4"), F.min(F.when(~typed, c("url"))).alias("s5"),
    )

    def counted(rows: DataFrame, name: str, alias: str) -> DataFrame:
        pairs = rows.groupBy(*key, name).agg(F.count(F.lit(1)).alias("n"))
        return pairs.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c(name).cast("string"), c("n"))))).alias(alias))

    statuses = counted(keyed.withColumn("status_key", F.coalesce(c("status_code"), F.lit(0)).cast("string")), "status_key", "status_codes")
    types = counted(keyed.select(*key, F.explode("schema_types").alias("schema_type")), "schema_type", "schema_type_counts")

    first_urls = (
        keyed.select(*key, "url")
        .withColumn("position", F.dense_rank().over(Window.partitionBy(*key).orderBy("url")))
        .where(c("position") <= per_template)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set("url")).alias("fill"))
    )
    # Every sampled cluster takes at least one slot, so clusters beyond the total budget cannot take any.
    order = Window.partitionBy("run_id").orderBy(F.desc("url_count"), "cluster_key")
    front = totals.select(*key, "url_count").withColumn("position", F.row_number().over(order)).where(c("position") <= total)
    taken = F.sum(F.least(F.lit(per_template), c("url_count"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    slots = front.withColumn("slots", F.least(F.lit(per_template), F.greatest(F.lit(0), F.lit(total) - F.coalesce(taken, F.lit(0))))).select(*key, "slots")

    joined = totals.join(statuses, key, "left").join(types, key, "left").join(first_urls, key, "left").join(slots, key, "left")
    picks = F.array_distinct(F.concat(F.array_compact(F.array("s1", "s2", "s3", "s4", "s5")), F.coalesce(c("fill"), F.array().cast("array<string>"))))
    count = F.coalesce(c("slots"), F.lit(0)).cast("int")
    samples = F.when(count > 0, F.slice(picks, F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("sample_urls", samples).drop("s1", "s2", "s3", "s4", "s5", "fill", "slots")


def sample_list(cluster_rows: DataFrame, pages: DataFrame, only_indexable: bool = True, total: int = 200) -> DataFrame:
    """Pages to measure: samples of all clusters in size order, matched by any of their URLs, at most ``total`` per run."""
    samples = cluster_rows.select("run_id", "cluster_key", "url_count", F.posexplode("sample_urls").alias("rank", "sample_url"))
    forms = pages.select("run_id", "page_id", "indexable", F.explode(F.array_distinct(F.array_compact(F.array("url", "final_url", "normalized_url")))).alias("sample_url"))
    wanted = forms.where(c("indexable") == 1) if only_indexable else forms
    match = wanted.groupBy("run_id", "sample_url").agg(F.min("page_id").alias("page_id"))
    joined = samples.join(match, ["run_id", "sample_url"])
    first = joined.groupBy("run_id", "page_id").agg(F.min(F.struct(-c("url_count"), c("cluster_key"), c("rank"), c("sample_url"))).alias("m"))
    order = Window.partitionBy("run_id").orderBy("m")
    ranked = first.withColumn("position", F.row_number().over(order)).where(c("position") <= total)
    return ranked.select("run_id", "page_id", "position", c("m.cluster_key").alias("cluster_key"), c("m.sample_url").alias("url"))


def reusable_rendering() -> Column:
    """A page whose settled browser evidence can stand in for a new measurement."""
    return F.coalesce(S.settled(), F.lit(False)) & c("navigation_error").isNull() & c("word_count_rendered").isNotNull()


# --- pattern checks ----------------------------------------------------------------------------------------------

def _scoped(pages: DataFrame) -> DataFrame:
    key = F.coalesce(c("cluster_key"), F.concat(S.page_type(), F.lit(":unclustered")))
    source = F.when(c("cluster_key").isNotNull(), "template_fingerprint").otherwise("page_type_fallback")
    return pages.withColumns({"pattern_key": key, "pattern_type": S.page_type(), "scope_source": source})


def _share_rows(observed: DataFrame, prefix: str, minimum_coverage: float = 0.8) -> DataFrame:
    """Issue types that hold for at least three and half of the evaluated pages of a scope.

    ``observed`` has one row per page and scope with ``evaluated``, ``issue_type`` (NULL when fine) and ``size``.
    Issue counts come from the same grouping as the totals, so the pages are shuffled once.
    """
    scope = ["run_id", "pattern_key", "pattern_type", "scope_source"]
    parts = observed.groupBy(*scope, "issue_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("evaluated").alias("evaluated"), F.count_if(c("evaluated") & c("issue_type").isNotNull()).alias("hits"),
        F.sum(F.when(c("evaluated"), c("size"))).alias("size_sum"),
    )
    window = Window.partitionBy(*scope)
    rows = parts.withColumns({"total_in_pattern": F.sum("n").over(window), "evaluated_count": F.sum("evaluated").over(window)})
    coverage, share = c("evaluated_count") / c("total_in_pattern"), c("hits") / c("evaluated_count")
    kept = rows.where(c("issue_type").isNotNull() & (c("evaluated_count") >= 3) & (c("hits") >= 3) & (share >= 0.5) & (coverage >= minimum_coverage))
    return kept.select(
        *scope, "issue_type", c("hits").alias("affected_count"), "total_in_pattern", "evaluated_count",
        F.round(coverage, 3).alias("evidence_coverage"), F.round(share, 3).alias("affected_share"),
        F.when((c("evaluated_count") >= 5) & (coverage == 1), "high").otherwise("medium").alias("confidence"),
        F.concat(F.lit(f"{prefix}:"), c("pattern_key"), F.lit(":"), c("issue_type")).alias("root_cause_key"),
        F.round(c("size_sum") / c("hits"), 3).alias("avg_length"),
    )


def head_patterns(pages: DataFrame, field: str) -> DataFrame:
    """Templates whose titles or descriptions are systematically missing, short or long."""
    low, high = (T.title_min, T.title_max) if field == "title" else (T.description_min, T.description_max)
    rows = HD.population(_scoped(pages), field).where(~c("consolidated"))
    size = F.length(F.coalesce(c("head_value"), F.lit("")))
    kind = F.when(~c("evaluated"), F.lit(None)).when(size == 0, f"{field}_missing").when(size < low, f"{field}_too_short").when(size > high, f"{field}_too_long")
    return _share_rows(rows.withColumn("issue_type", kind).withColumn("size", size), "html_meta_pattern")


def schema_patterns(pages: DataFrame) -> DataFrame:
    """Templates of a sure page type that lack the expected type family or breadcrumbs."""
    expected = {"article": ("article_schema_missing", "Article"), "product": ("product_schema_missing", "Product"), "location": ("localbusiness_schema_missing", "LocalBusiness")}
    scope = S.successful_html() & (c("indexable") == 1) & (c("page_type_confidence") == "high") & c("page_type").isin("article", "product", "category", "location")
    rows = _scoped(pages.where(scope))
    lacking = [F.when((c("page_type") == kind) & ~in_family(c("schema_types"), fam), F.lit(name)) for kind, (name, fam) in expected.items()]
    lacking.append(F.when(~in_family(c("schema_types"), "BreadcrumbList"), F.lit("breadcrumblist_schema_missing")))
    scope_key = ["run_id", "pattern_key", "pattern_type", "scope_source"]
    # A page may miss two things, so totals and issues are two small aggregates over one scan.
    totals = rows.groupBy(*scope_key).agg(F.count(F.lit(1)).alias("total_in_pattern"))
    hits = rows.select(*scope_key, F.explode(F.array_compact(F.array(*lacking))).alias("issue_type")).groupBy(*scope_key, "issue_type").agg(F.count(F.lit(1)).alias("affected_count"))
    share = c("affected_count") / c("total_in_pattern")
    kept = hits.join(totals, scope_key).where((c("total_in_pattern") >= 3) & (c("affected_count") >= 3) & (share >= 0.5))
    return kept.select(
        *scope_key, "issue_type", "affected_count", "total_in_pattern", F.round(share, 3).alias("affected_share"),
        F.when(c("total_in_pattern") >= 5, "high").otherwise("medium").alias("confidence"),
        F.concat(F.lit("schema_pattern:"), c("pattern_key"), F.lit(":"), c("issue_type")).alias("root_cause_key"),
    )


def canonical_patterns(pages: DataFrame) -> DataFrame:
    """Systematic canonical issues per template and site-wide; the site-wide row yields to a template that explains it."""
    scope = S.successful_html() & (F.coalesce(c("indexable"), F.lit(1)) == 1) & (S.page_type() != "legal")
    evaluated = CA.evaluate(_scoped(pages.where(scope))).withColumn("evaluated", S.complete_state())
    single = evaluated.where(F.size("canonicals") == 1)
    target = CA.targets(single, pages).where(c("target_redirect") | c("target_non_200") | c("target_non_html"))
    target = target.groupBy("run_id", "page_id").agg(F.min("target_issue").alias("target_issue"))
    rows = evaluated.join(target, ["run_id", "page_id"], "left")
    kind = (
        F.when(~c("evaluated"), F.lit(None)).when(c("canonical_missing"), "canonical_missing").when(c("canonical_conflict"), "conflicting_canonical_tags")
        .when(c("target_issue").isNotNull(), c("target_issue")).when(F.size("canonical_foreign") > 0, "cross_registrable_domain").when(~c("canonical_self"), "canonical_non_self")
    )
    rows = rows.withColumn("issue_type", kind).withColumn("size", F.lit(0))
    columns = ["run_id", "pattern_key", "pattern_type", "scope_source", "evaluated", "issue_type", "size"]
    wide = rows.withColumns({"pattern_key": F.lit("site:all"), "pattern_type": F.lit("mixed"), "scope_source": F.lit("sitewide")})
    found = _share_rows(rows.select(*columns).unionByName(wide.select(*columns)), "canonical_pattern").drop("avg_length")
    specific = found.where(c("scope_source") != "sitewide")
    sitewide = found.where(c("scope_source") == "sitewide").join(specific.select("run_id", "issue_type").distinct(), ["run_id", "issue_type"], "left_anti")
    return specific.unionByName(sitewide)


def simple_patterns(pages: DataFrame, condition: Column, minimum: int, extra: Column | None = None) -> DataFrame:
    """Templates in which a condition holds for ``minimum`` pages and at least half of the template."""
    html = F.coalesce(S.is_html(), F.lit(True))
    rows = _scoped(pages)
    hit = html & (extra if extra is not None else F.lit(True)) & F.coalesce(condition, F.lit(False))
    per_type = rows.groupBy("run_id", "pattern_key", "pattern_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("affected_count"), F.round(F.avg(F.when(hit, c("raw_html_size"))), 2).alias("avg_html_size"))
    totals = per_type.withColumn("total_in_pattern", F.sum("n").over(Window.partitionBy("run_id", "pattern_key")))
    return totals.where((c("affected_count") >= minimum) & (c("affected_count") >= F.greatest(F.lit(2.0), c("total_in_pattern") * 0.5))).drop("n")


def noindex_patterns(pages: DataFrame) -> DataFrame:
    condition = (F.coalesce(c("noindex"), F.lit(0)) == 1) | S.robots_text().contains("noindex")
    return simple_patterns(pages, condition, 2, extra=S.page_type() != "legal")


def large_html_patterns(pages: DataFrame) -> DataFrame:
    return simple_patterns(pages, c("raw_html_size") > T.html_bytes, 3)


def pattern_results(patterns: DataFrame, check_id: str, runs: DataFrame, priority: str = "Low") -> DataFrame:
    """Pattern rows rolled up to one score-free result per run."""
    rolled = patterns.groupBy("run_id").agg(F.sum("affected_count").alias("affected"), F.count(F.lit(1)).alias("patterns"))
    joined = runs.select("run_id").join(rolled, "run_id", "left").na.fill(0)
    hit = c("patterns") > 0
    return joined.select(
        "run_id", F.lit(check_id).alias("check_id"), F.when(hit, "fail").otherwise("pass").alias("evaluation_state"), F.when(hit, "Warning").otherwise("OK").alias("status"),
        F.lit(priority).alias("priority"), c("affected").cast("bigint").alias("affected_count"), c("patterns").cast("bigint").alias("patterns"),
        F.when((c("patterns") == 1) & (c("affected") < 10), "medium").otherwise("high").alias("confidence"),
    )


# --- sampled performance -----------------------------------------------------------------------------------------

def performance_summary(samples: DataFrame, lab: DataFrame, browser: DataFrame) -> DataFrame:
    """Per cluster: sample and success counts, mean and lowest lab scores, mean timings, browser findings."""
    key = ["run_id", "cluster_key"]
    scored = F.coalesce("performance_score", "seo_score", "accessibility_score", "best_practices_score").isNotNull()
    good = c("error_message").isNull() & scored
    only = lambda name: F.when(good, F.coalesce(c(name), F.lit(0.0)))
    lab_rows = lab.groupBy(*key).agg(
        F.count_if(good).alias("lab_success_count"),
        F.round(F.avg(only("performance_score")), 3).alias("avg_performance_score"), F.round(F.min(only("performance_score")), 3).alias("min_performance_score"),
        F.round(F.avg(only("seo_score")), 3).alias("avg_seo_score"), F.round(F.min(only("seo_score")), 3).alias("min_seo_score"),
        F.round(F.avg(only("accessibility_score")), 3).alias("avg_accessibility_score"), F.round(F.avg(only("best_practices_score")), 3).alias("avg_best_practices_score"),
        F.round(F.avg(only("lcp_ms")), 3).alias("avg_lcp_ms"), F.round(F.avg(only("tbt_ms")), 3).alias("avg_tbt_ms"), F.round(F.avg(only("cls")), 3).alias("avg_cls"),
    )
    fine = (c("status") == "success") & c("navigation_error").isNull()
    browser_rows = browser.groupBy(*key).agg(
        F.count_if(fine).alias("browser_success_count"), F.count_if(fine & (c("js_required") == 1)).alias("js_required_count"),
        F.count_if(fine & (c("console_errors") > 0)).alias("console_error_sample_count"),
    )
    base = samples.groupBy(*key).agg(F.count(F.lit(1)).alias("sample_count"))
    counts = ["lab_success_count", "browser_success_count", "js_required_count", "console_error_sample_count"]
    return base.join(lab_rows, key, "left").join(browser_rows, key, "left").na.fill(0, counts)


def worst_samples(lab: DataFrame, browser: DataFrame, size: int = 5) -> DataFrame:
    """Worst URLs of a cluster: lowest score first, then slowest, then by console errors and URL."""
    key = ["run_id", "cluster_key", "url"]
    good = c("error_message").isNull() & F.coalesce("performance_score", "seo_score", "accessibility_score", "best_practices_score").isNotNull()
    # The last device row of a URL stands for it, as a later measurement replaces an earlier one.
    lab_rows = lab.where(good).groupBy(*key).agg(F.max_by(F.struct("performance_score", "lcp_ms", "tbt_ms"), "device").alias("m")).select(*key, "m.*")
    fine = (c("status") == "success") & c("navigation_error").isNull()
    browser_rows = browser.where(fine).groupBy(*key).agg(F.max("console_errors").alias("console_errors"))
    rows = lab_rows.join(browser_rows, key, "full_outer")
    order = Window.partitionBy("run_id", "cluster_key").orderBy(
        F.asc_nulls_last("performance_score"), F.desc(F.coalesce("lcp_ms", F.lit(0.0))), F.desc(F.coalesce("tbt_ms", F.lit(0.0))),
        F.desc(F.coalesce("console_errors", F.lit(0))), F.asc("url"),
    )
    return rows.withColumn("position", F.row_number().over(order)).where(c("position") <= size)


def lab_coverage(samples: DataFrame, lab: DataFrame, metric: str) -> DataFrame:
    """Per run: clusters, clusters with fewer than two measured URLs, unusable and unmatched measurements."""
    expected = samples.select("run_id", "cluster_key", "url").distinct()
    usable = lab.where(c("error_message").isNull() & c("url").isNotNull() & c("device").isNotNull())
    measured = usable.where(c(metric).isNotNull()).select("run_id", "cluster_key", "url").distinct().withColumn("measured", F.lit(1))
    on = expected["run_id"].eqNullSafe(measured["run_id"]) & expected["cluster_key"].eqNullSafe(measured["cluster_key"]) & (expected["url"] == measured["url"])
    per_cluster = expected.join(measured, on, "left").groupBy(expected["run_id"], expected["cluster_key"]).agg(F.count("measured").alias("measured"))
    per_run = per_cluster.groupBy("run_id").agg(F.count(F.lit(1)).alias("clusters"), F.count_if(c("measured") < 2).alias("incomplete_clusters"))
    errors = lab.where(c("error_message").isNotNull()).groupBy("run_id").agg(F.count(F.lit(1)).alias("technical_errors"))
    stray = usable.join(expected, ["run_id", "cluster_key", "url"], "left_anti").groupBy("run_id").agg(F.count(F.lit(1)).alias("stray"))
    blank = usable.where(c(metric).isNull()).join(expected, ["run_id", "cluster_key", "url"], "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("missing_metric"))
    joined = per_run.join(errors, "run_id", "left").join(stray, "run_id", "left").join(blank, "run_id", "left").na.fill(0)
    total = joined.withColumn("technical_errors", c("technical_errors") + c("stray")).drop("stray")
    complete = (c("clusters") > 0) & (c("incomplete_clusters") == 0) & (c("technical_errors") == 0) & (c("missing_metric") == 0)
    return total.withColumn("complete", complete)


def sampling_state(samples: DataFrame) -> DataFrame:
    return samples.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(c("browser_status") == "success").alias("browser_success"), F.count_if(c("lab_status") == "success").alias("lab_success"),
        F.count_if(c("browser_status") == "unavailable").alias("browser_unavailable"), F.count_if(c("lab_status") == "unavailable").alias("lab_unavailable"),
    )


def sampling_results(samples: DataFrame, lab: DataFrame, browser: DataFrame, runs: DataFrame) -> DataFrame:
    """The eight checks over sampled templates."""
    summary = performance_summary(samples, lab, browser)
    low_perf = (c("lab_success_count") >= 2) & ((c("avg_performance_score") < T.lab_score_warning) | (c("min_performance_score") < T.lab_score_warning))
    severe_perf = low_perf & ((c("avg_performance_score") < T.lab_score_error) | (c("min_performance_score") < T.lab_score_error))
    slow = (c("lab_success_count") >= 2) & (c("avg_lcp_ms") > T.lcp_warning_ms)
    blocked = c("avg_tbt_ms") > T.tbt_warning_ms
    counts = summary.groupBy("run_id").agg(
        F.count_if(low_perf).alias("perf"), F.count_if(severe_perf).alias("perf_error"),
        F.count_if((c("avg_seo_score") < T.lab_seo_warning) | (c("min_seo_score") < T.lab_seo_warning)).alias("seo"),
        F.count_if(slow).alias("lcp"), F.count_if(slow & (c("avg_lcp_ms") > T.lcp_error_ms)).alias("lcp_error"),
        F.count_if(blocked).alias("tbt"), F.count_if(blocked & (c("avg_tbt_ms") > T.tbt_error_ms)).alias("tbt_error"),
        F.count_if(c("console_error_sample_count") >= T.console_errors_warning).alias("console"), F.count_if(c("js_required_count") > 0).alias("js"),
    )
    perf_cov = lab_coverage(samples, lab, "performance_score").select("run_id", c("complete").alias("perf_complete"), c("technical_errors").alias("perf_technical"))
    lcp_cov = lab_coverage(samples, lab, "lcp_ms").select("run_id", c("complete").alias("lcp_complete"), c("technical_errors").alias("lcp_technical"))
    joined = runs.join(sampling_state(samples), "run_id", "left").join(counts, "run_id", "left").join(perf_cov, "run_id", "left").join(lcp_cov, "run_id", "left")
    joined = joined.na.fill(0).na.fill(False)

    def unavailable(tool: str) -> Column:
        enabled = c(f"{tool}_sampling") == 1
        return (
            F.when(~enabled | (c("sample_count") == 0), "not_executed").when((c(f"{tool}_success") == 0) & (c(f"{tool}_unavailable") > 0), "technical_error")
            .when(c(f"{tool}_success") == 0, "insufficient_evidence")
        )

    def result(check_id: str, tool: str, hits: str, errors: str | None = None, coverage: str | None = None) -> Column:
        state = F.when(unavailable(tool).isNotNull(), unavailable(tool))
        if coverage:
            state = state.when(~c(f"{coverage}_complete") & (c(f"{coverage}_technical") > 0), "technical_error").when(~c(f"{coverage}_complete"), "insufficient_evidence")
        state = state.when(c(hits) > 0, "fail").otherwise("pass")
        severe = F.when(c(errors) > 0, "Error").otherwise("Warning") if errors else F.lit("Warning")
        return F.struct(
            F.lit(check_id).alias("check_id"), state.alias("evaluation_state"), F.when(state == "pass", "OK").when(state == "fail", severe).otherwise("NA").alias("status"),
            F.when(state == "fail", c(hits)).otherwise(F.lit(0)).cast("bigint").alias("affected_count"),
        )

    def tool_result(check_id: str, tool: str) -> Column:
        missing = c(f"{tool}_unavailable")
        state = F.when(c("sample_count") == 0, "not_executed").when(missing > 0, "insufficient_evidence").otherwise("pass")
        return F.struct(F.lit(check_id).alias("check_id"), state.alias("evaluation_state"), F.when(state == "pass", "OK").otherwise("NA").alias("status"), missing.cast("bigint").alias("affected_count"))

    return joined.select(
        "run_id",
        F.inline(
            F.array(
                result("template.low_lighthouse_performance", "lab", "perf", "perf_error", "perf"), result("template.low_lighthouse_seo", "lab", "seo"),
                result("template.high_lcp", "lab", "lcp", "lcp_error", "lcp"), result("template.high_tbt", "lab", "tbt", "tbt_error"),
                result("template.console_errors", "browser", "console"), result("template.js_required_content", "browser", "js"),
                tool_result("template.lighthouse_unavailable", "lab"), tool_result("template.playwright_unavailable", "browser"),
            )
        ),
    )
