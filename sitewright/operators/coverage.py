"""Evidence classes, coverage units and availability of check results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.functions import url as U

c = F.col

# fixed values: weights, check sets and patterns that decide the evidence class of a check
CLASS_WEIGHTS = {
    "primary_required": 1.0, "primary_conditional": 1.0, "secondary_diagnostic": 0.15, "optional_opportunity": 0.05, "inventory": 0.2,
}
CLASS_RANK = {"primary_required": 5, "primary_conditional": 4, "inventory": 3, "secondary_diagnostic": 2, "optional_opportunity": 1}
BROWSER_DIAGNOSTICS = (
    "tech.raw_h1_missing_rendered_present", "tech.raw_internal_links_fewer_rendered", "tech.rendered_word_count_delta",
    "tech.console_errors_present", "template.console_errors",
)
LAB_CHECKS = (
    "template.low_lighthouse_performance", "template.low_lighthouse_seo", "template.high_lcp", "template.high_tbt",
    "template.lighthouse_unavailable",
)
BROWSER_TEMPLATE_CHECKS = ("template.console_errors", "template.js_required_content", "template.playwright_unavailable")
HOST_CHECKS = (
    "tech.https_reachable", "tech.http_to_https_redirect", "tech.www_non_www_consistency", "tech.http_version_support",
    "tech.content_security_policy", "tech.permissions_policy", "tech.referrer_policy", "tech.x_content_type_options",
    "tech.x_frame_options", "tech.hsts_header",
)
DELIVERY_CHECKS = ("tech.compression_header", "tech.cache_control_header", "tech.cdn_cache_signals")
AI_POLICY = r"^geo\.(robots_blocks_txt_files|robots_mentions_(applebot|bytespider|ccbot|chatgpt_user|claude_web|claudebot|google_extended|gptbot|oai_searchbot|perplexitybot))$"
LLMS_FILES = ("geo.llms_txt_present", "geo.llms_txt_http_status")
INVENTORY = r"((^|\.)(noindex_pages|nofollow_pages|schema_types_coverage_summary|status_code_distribution|security_headers_inventory)$)|((inventory|distribution|summary)$)|(third_party_scripts_detected$)"
CONDITIONAL = r"(article_coverage|article_blog_pages_article_schema|product_coverage|breadcrumb_missing|breadcrumblist|faqpage|hreflang)|(^template\.)"
OPTIONAL = (
    r"(open_graph|twitter_|social_|og_image|webmanifest|speakable)|(llms|markdown_twin|ai_bots|robots_mentions_|robots_blocks_txt)"
    r"|(preconnect|preload|visible_publish_date|author_bio|external_sources|person_present_missing)|(about_linked|contact_linked|datenschutz_linked|impressum_linked)"
    r"|(opportunity|best_practice)|(compression_header|cache_control_header|http_version_support|cdn_cache_signals)"
    r"|(hsts_header|content_security_policy|x_frame_options|x_content_type_options|referrer_policy|permissions_policy)"
    r"|(favicon_missing|app_icons_incomplete|images_without_width_height|images_without_lazy_loading)"
    r"|(html_semantics_summary|consent_technical_signals|too_many_js|too_many_css|resource_hints_summary)"
    r"|(organization_missing|website_missing|local_business|person_schema|organization_same_as)"
)
SHARED_UNITS = {
    "tech.article_coverage_on_article_like_pages": "site:structured_data:article_coverage",
    "geo.article_blog_pages_article_schema": "site:structured_data:article_coverage",
    "tech.raw_h1_missing_rendered_present": "site:render_diagnostic:raw_rendered_content",
    "tech.raw_internal_links_fewer_rendered": "site:render_diagnostic:raw_rendered_content",
    "tech.rendered_word_count_delta": "site:render_diagnostic:raw_rendered_content",
    "tech.console_errors_present": "site:browser_diagnostic:console",
    "template.console_errors": "site:browser_diagnostic:console",
    "template.low_lighthouse_performance": "module:lighthouse:performance",
    "template.high_lcp": "module:lighthouse:performance",
    "template.high_tbt": "module:lighthouse:performance",
    "template.low_lighthouse_seo": "module:lighthouse:seo",
}


def render_context(metrics: DataFrame) -> DataFrame:
    """Render plan counts of a run, as the availability rules need them."""
    need, decision, ran = c("render_need"), c("render_decision"), c("browser_run") == 1
    return metrics.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("planned"), F.count_if(need == "render_required").alias("required"), F.count_if(ran).alias("rendered"),
        F.count_if(decision == "render_budget_exhausted").alias("exhausted"), F.count_if(decision == "render_unavailable").alias("unavailable"),
        F.count_if((need == "render_recommended") & ~ran).alias("optional_open"), F.count_if((need == "render_required") & ~ran).alias("missing_required"),
    )


def evidence_class(check: Column, render_required: Column) -> Column:
    return (
        F.when(check == "tech.js_dependent_content", F.when(render_required > 0, "primary_conditional").otherwise("secondary_diagnostic"))
        .when((check == "tech.critical_content_raw_html_signal") | check.rlike(AI_POLICY) | check.isin(*LLMS_FILES), "primary_required")
        .when(check == "geo.ai_bots_policy_summary", "inventory").when(check.isin(*HOST_CHECKS), "primary_required")
        .when(check.isin(*DELIVERY_CHECKS), "primary_conditional").when(check.isin(*BROWSER_DIAGNOSTICS), "secondary_diagnostic")
        .when(check.isin(*LAB_CHECKS), "primary_conditional").when(check.isin(*BROWSER_TEMPLATE_CHECKS), "secondary_diagnostic")
        .when(check.rlike(INVENTORY), "inventory").when(check.rlike(CONDITIONAL), "primary_conditional")
        .when(check.rlike(OPTIONAL) | check.rlike(r"^(geo|trust|llm)\."), "optional_opportunity").otherwise("primary_required")
    )


def unit_key(check: Column) -> Column:
    shared = F.create_map(*[F.lit(x) for pair in SHARED_UNITS.items() for x in pair])
    return (
        F.when(check == "tech.critical_content_raw_html_signal", "site:html:raw_content_integrity").when(check.rlike(AI_POLICY), F.concat(F.lit("site:ai_policy:"), check))
        .when(check.isin(*LLMS_FILES), "site:ai_files:llms_txt").when(check == "geo.ai_bots_policy_summary", "site:ai_policy:summary")
        .when(check.isin(*HOST_CHECKS), F.concat(F.lit("site:http_host_security:"), check)).when(check.isin(*DELIVERY_CHECKS), F.concat(F.lit("site:http_infrastructure:"), check))
        .otherwise(F.coalesce(F.try_element_at(shared, check), F.concat(F.lit("check:"), check)))
    )


def weight_of(evidence: Column) -> Column:
    column = None
    for name, weight in CLASS_WEIGHTS.items():
        column = F.when(evidence == name, F.lit(weight)) if column is None else column.when(evidence == name, F.lit(weight))
    return column.otherwise(F.lit(0.0))


def check_facts(results: DataFrame) -> DataFrame:
    """What depends on the check id alone, worked out once per distinct id instead of once per result."""
    check = c("check_id")
    browser = check.isin(*BROWSER_DIAGNOSTICS) | (check == "tech.js_dependent_content")
    sensitive = browser | check.isin(*LAB_CHECKS, *BROWSER_TEMPLATE_CHECKS) | check.rlike("(title|meta_description|canonical|h1|html_lang|hreflang|open_graph)")
    columns = {"class_plain": evidence_class(check, F.lit(0)), "class_when_rendered": evidence_class(check, F.lit(1)), "coverage_unit": unit_key(check), "render_sensitive": sensitive}
    return U.computed_once(results.select("check_id").distinct(), columns)


def annotate(results: DataFrame, runs: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Evidence class, coverage unit and the execution, evidence and coverage status of every result.

    ``runs`` gives per run: source_type, lab_sampling, browser_sampling and the render plan counts render_required,
    render_optional_open, render_exhausted, render_unavailable. It is one row per run and joins by hash. ``checks`` may give the
    distinct check ids, so that the results are not read again for them.
    """
    context = runs.select("run_id", "source_type", "lab_sampling", "browser_sampling", "render_required", "render_optional_open", "render_exhausted", "render_unavailable")
    rows = results.join(context, "run_id", "left").join(check_facts(results if checks is None else checks), "check_id")
    check, state = c("check_id"), c("evaluation_state")
    kind = F.when(F.coalesce(c("render_required"), F.lit(0)) > 0, c("class_when_rendered")).otherwise(c("class_plain"))
    rows = rows.withColumn("evidence_class", kind)
    done = state.isin("pass", "fail", "inventory")
    diagnostic = c("evidence_class").isin("secondary_diagnostic", "optional_opportunity")
    import_only = (check == "tech.imported_resource_performance_signals") & (c("source_type") != "import")
    lab_off = check.isin(*LAB_CHECKS) & (F.coalesce(c("lab_sampling"), F.lit(0)) == 0)
    browser_off = check.isin(*BROWSER_TEMPLATE_CHECKS) & (F.coalesce(c("browser_sampling"), F.lit(0)) == 0)
    browser_check = check.isin(*BROWSER_DIAGNOSTICS) | (check == "tech.js_dependent_content")
    not_planned = browser_check & (c("render_required") == 0) & ~state.isin("pass", "fail")
    short = F.size(F.coalesce(c("missing_facts"), F.array())) > 0 if "missing_facts" in results.columns else F.lit(False)
    sensitive = c("render_sensitive")
    exhausted, gone = sensitive & (c("render_exhausted") > 0), sensitive & (c("render_unavailable") > 0)
    disabled = import_only | lab_off | browser_off
    execution = (
        F.when(disabled, "disabled").when(not_planned, F.when(c("render_optional_open") > 0, "render_optional_not_selected").otherwise("skipped_by_render_plan"))
        .when((state == "not_applicable") | done, "completed").when(exhausted, "skipped_by_budget").when((state == "technical_error") | gone, "technical_error").otherwise("not_executed")
    )
    broken = (state == "technical_error") | F.coalesce(gone, F.lit(False))
    evidence = (
        F.when(disabled | not_planned | (state == "not_applicable"), "not_required").when(done & short & diagnostic, "optional_unavailable").when(done & short, "required_but_missing")
        .when(done, "complete").when(broken, "technical_error").when(diagnostic, "optional_unavailable").otherwise("required_but_missing")
    )
    coverage = (
        F.when(disabled | not_planned | (state == "not_applicable"), "excluded").when(done & ~short, "covered").when(diagnostic, "diagnostic_unavailable").otherwise("uncovered")
    )
    output = rows.withColumns({"execution_status": execution, "evidence_status": evidence, "coverage_status": coverage, "coverage_weight": weight_of(c("evidence_class"))})
    return output.drop("class_plain", "class_when_rendered", "render_sensitive", "source_type", "lab_sampling", "browser_sampling", "render_required", "render_optional_open", "render_exhausted", "render_unavailable")
