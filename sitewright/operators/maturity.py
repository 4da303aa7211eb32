"""Effective values, display semantics, review and report summaries, maturity of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.functions import url as U
from sitewright.operators.scoring import half_up, lookup
from sitewright.session import stored

c = F.col

# fixed values: category weights and the checks of each category
CATEGORY_WEIGHT = {
    "technical-seo": 1.2, "html-head": 0.8, "structure-quality": 1.0, "media-performance": 0.9, "structured-data": 1.3, "geo-readiness": 1.4,
    "ai-crawler-policy": 0.8, "trust-entity": 1.2, "security-server": 0.5, "template-rendering": 0.9, "uncategorized": 0.2,
}
CATEGORY_CHECKS = {
    "technical-seo": (
        "tech.https_reachable",
        "tech.http_to_https_redirect",
        "tech.www_non_www_consistency",
        "tech.status_code_distribution",
        "tech.synthetic_not_found_handling",
        "tech.4xx_pages",
        "tech.5xx_pages",
        "tech.redirect_pages",
        "tech.x_robots_tag_unusual",
        "tech.content_type_html_correct",
        "tech.robots_txt_present",
        "tech.sitemap_present",
        "tech.sitemap_in_robots",
        "tech.sitemap_urls_non_200",
        "tech.internal_search_noindex_policy",
        "tech.noindex_pages",
        "tech.nofollow_pages",
        "tech.canonical_missing",
        "tech.canonical_non_self",
        "tech.canonical_to_other_domain",
        "tech.canonical_target_non_200",
        "tech.internal_links_to_3xx",
        "tech.internal_links_to_4xx_5xx",
        "tech.orphan_like_sitemap_urls",
        "tech.hreflang_x_default_missing",
        "template.noindex_pattern",
        "template.canonical_pattern_issue",
    ),
    "html-head": (
        "tech.title_missing",
        "tech.title_too_short",
        "tech.title_too_long",
        "tech.duplicate_titles",
        "tech.meta_description_missing",
        "tech.meta_description_too_short",
        "tech.meta_description_too_long",
        "tech.duplicate_meta_descriptions",
        "tech.h1_missing",
        "tech.multiple_h1",
        "tech.html_semantics_summary",
        "tech.html_lang_missing",
        "tech.viewport_missing",
        "tech.open_graph_basics_missing",
        "tech.favicon_missing",
        "tech.app_icons_incomplete",
        "tech.webmanifest_missing",
        "tech.charset_utf8_present",
        "template.title_pattern_issue",
        "template.meta_pattern_issue",
    ),
    "structure-quality": (
        "geo.tables_present",
        "geo.bulletpoints_lists_present",
        "geo.source_or_external_links_present",
        "geo.visible_dates_present",
        "geo.author_hints_present",
        "trust.eeat_signal_summary",
        "trust.ymyl_review_signal",
        "geo.low_structured_sections",
    ),
    "media-performance": (
        "tech.compression_header",
        "tech.cache_control_header",
        "tech.cdn_cache_signals",
        "tech.http_version_support",
        "tech.raw_html_size_large",
        "tech.too_many_js",
        "tech.too_many_css",
        "tech.large_js_total",
        "tech.large_css_total",
        "tech.third_party_scripts_detected",
        "tech.preload_missing",
        "tech.preconnect_missing",
        "tech.resource_hints_summary",
        "tech.imported_resource_performance_signals",
        "tech.high_ttfb",
        "tech.images_without_alt",
        "tech.empty_alt_texts",
        "tech.images_without_width_height",
        "tech.images_without_lazy_loading",
        "tech.large_image_resources",
        "tech.modern_image_format_coverage_low",
        "tech.videoobject_schema_present_missing",
        "template.large_html_pattern",
        "template.low_lighthouse_performance",
        "template.low_lighthouse_seo",
        "template.high_lcp",
        "template.high_tbt",
    ),
    "structured-data": (
        "tech.json_ld_parse_errors",
        "tech.schema_types_coverage_summary",
        "tech.organization_missing",
        "tech.website_missing",
        "tech.breadcrumb_missing_low_coverage",
        "tech.faqpage_missing_low_coverage",
        "tech.article_coverage_on_article_like_pages",
        "tech.product_coverage_on_product_like_pages",
        "tech.localbusiness_present_missing",
        "tech.person_present_missing",
        "tech.speakable_missing",
        "tech.organization_sameas_missing",
        "geo.faq_html_present_schema_missing",
        "geo.organization_schema_sameas",
        "geo.breadcrumblist_present",
        "geo.speakable_present",
        "geo.article_blog_pages_article_schema",
        "template.schema_missing_pattern",
    ),
    "geo-readiness": (
        "geo.llms_txt_present",
        "geo.llms_txt_http_status",
        "geo.llms_full_txt_present",
        "geo.robots_blocks_txt_files",
        "geo.markdown_twin_homepage",
    ),
    "ai-crawler-policy": (
        "geo.robots_mentions_gptbot",
        "geo.robots_mentions_oai_searchbot",
        "geo.robots_mentions_chatgpt_user",
        "geo.robots_mentions_claudebot",
        "geo.robots_mentions_claude_web",
        "geo.robots_mentions_perplexitybot",
        "geo.robots_mentions_google_extended",
        "geo.robots_mentions_ccbot",
        "geo.robots_mentions_applebot",
        "geo.robots_mentions_bytespider",
        "geo.ai_bots_policy_summary",
    ),
    "trust-entity": (
        "geo.impressum_linked",
        "geo.datenschutz_linked",
        "geo.about_linked",
        "geo.contact_linked",
    ),
    "security-server": (
        "tech.hsts_header",
        "tech.content_security_policy",
        "tech.x_frame_options",
        "tech.x_content_type_options",
        "tech.referrer_policy",
        "tech.permissions_policy",
        "tech.consent_technical_signals",
    ),
    "template-rendering": (
        "tech.critical_content_raw_html_signal",
        "tech.rendered_word_count_delta",
        "tech.raw_h1_missing_rendered_present",
        "tech.raw_internal_links_fewer_rendered",
        "tech.console_errors_present",
        "tech.js_dependent_content",
        "template.console_errors",
        "template.js_required_content",
        "template.lighthouse_unavailable",
        "template.playwright_unavailable",
    ),
}
LOW_AVAILABILITY = ("geo.llms_txt_present", "geo.llms_txt_http_status", "geo.llms_full_txt_present", "geo.markdown_twin_homepage", "geo.markdown_twin_coverage")
POLICY_CHECKS = CATEGORY_CHECKS["ai-crawler-policy"]
TOOL_CHECKS = ("template.lighthouse_unavailable", "template.playwright_unavailable")
# fixed values: wording of findings that contradict or lack a signal
CONTRADICTION = r"\bstatus recorded:\s*(4\d\d|5\d\d)\b|\breturned\s+(4\d\d|5\d\d|fetch failed)\b|\bdid not return\b|\bnot found\b|\bnot available\b|\bunavailable\b|\bnot explicitly mentioned\b|\bdoes not explicitly mention\b"
MISSING_SIGNAL = (
    r"\bmissing\b|\blacks?\b|\bwithout\b|\bnot found\b|\bnot detected\b|\bnot present\b|\bnot available\b|\bunavailable\b|\bdid not return\b|\bnot return\b"
    r"|\breturned\s+(4\d\d|5\d\d|fetch failed)\b|\bno checked\b.*\breturned\b|\bdoes not explicitly mention\b|\bnot explicitly mentioned\b|_missing\b|present_missing"
)
STRATEGIC = ("technical-seo", "structure-quality", "structured-data", "geo-readiness", "trust-entity", "media-performance", "template-rendering")
# fixed values: labels by upper bound
LABELS = ((2, "Kritisch"), (4, "Unausgereift"), (5.5, "Basis vorhanden"), (7, "Fortgeschritten"), (8.5, "Stark"))


def effective_values(findings: DataFrame) -> DataFrame:
    """Manual review values before stored ones."""
    columns = {"review_status": F.coalesce("review_status", F.lit("unreviewed")), "action_status": F.coalesce("action_status", F.lit("open"))}
    override = F.lit(False)
    for name in ("status", "priority", "effort", "finding", "recommendation"):
        if name in findings.columns:
            manual = F.nullif(c(f"manual_{name}"), F.lit("")) if f"manual_{name}" in findings.columns else F.lit(None).cast("string")
            columns[f"effective_{name}"] = F.coalesce(manual, c(name))
            override = override | manual.isNotNull()
    return findings.withColumns(columns).withColumn("has_override", override)


def display_semantics(findings: DataFrame) -> DataFrame:
    """Report section, display status and review flags of every finding."""
    status = c("effective_status")
    findings = U.computed_once(findings, {"_text": F.lower(F.concat_ws(" ", c("check_id"), c("category"), F.coalesce(c("report_grouping_key"), F.lit(""))))})
    text = c("_text")
    browser = text.rlike("webmanifest|browser metadata opportunity|pwa")
    kind = (
        F.when(status.isin("OK", "NA"), "info").when(browser, "opportunity").when(F.lower(c("category")).contains("security"), "best_practice")
        .when(c("finding_type").isin("llm_assisted", "core_issue", "opportunity", "best_practice", "info"), c("finding_type")).otherwise("core_issue")
    )
    rows = U.computed_once(findings, {"display_type": kind})
    ignored = c("review_status").isin("false_positive", "ignored")
    issue = status.isin("Warning", "Error")
    manual_na = (status == "NA") & (c("review_recommended") == 1) & (c("display_type") != "info")
    reviewable = ~ignored & (issue | manual_na)
    section = (
        F.when(ignored, "all_findings").when(status == "OK", "passed_checks").when(status == "NA", "not_applicable").when(text.rlike(r"template performance|javascript & rendering|^template\."), "template_performance")
        .when(text.contains("media"), "media_findings").when(text.contains("security") | (c("display_type") == "best_practice"), "security_best_practices").when(c("display_type") == "llm_assisted", "geo_opportunities")
        .when((c("display_type") == "core_issue") & text.rlike(r"geo\.(robots_mentions_|robots_blocks_txt_files|llms_txt_)"), "action_items")
        .when((c("check_area") == "geo") | (c("display_type") == "opportunity") | text.rlike("geo|ai crawler policy|ai bot|speakable|llms|webmanifest|pwa"), "geo_opportunities")
        .when(c("display_type") == "core_issue", "action_items").otherwise("technical_appendix")
    )
    rows = U.computed_once(rows, {"reviewable": reviewable, "report_section": section}).drop("_text")
    review = F.when(c("review_status") != "unreviewed", c("review_status")).when(~c("reviewable"), "not_required").otherwise("unreviewed")
    rows = rows.withColumn("display_review_status", review)
    action = F.when(c("action_status") != "open", c("action_status")).when(~c("reviewable") | (c("display_review_status") == "not_required"), "none").otherwise("open")
    actionable = ~ignored & c("report_section").isin("action_items", "geo_opportunities", "security_best_practices", "media_findings", "template_performance")
    return rows.withColumns(
        {
            "display_status": F.when((c("display_type") == "opportunity") & issue, "Opportunity").otherwise(status), "display_action_status": action, "actionable": actionable,
            "display_review_recommended": c("reviewable") & ((c("review_recommended") == 1) | c("confidence").isin("low", "medium")),
        }
    )


def review_summary(displayed: DataFrame) -> DataFrame:
    sections = ("action_items", "geo_opportunities", "security_best_practices", "media_findings", "template_performance", "passed_checks", "not_applicable")
    return displayed.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if("reviewable").alias("reviewable"), F.count_if("display_review_recommended").alias("review_recommended"), F.count_if("actionable").alias("actionable"),
        F.count_if(c("display_review_status") == "not_required").alias("not_required"), F.count_if(c("reviewable") & (c("confidence") == "low")).alias("low_confidence"),
        F.count_if(c("reviewable") & (c("confidence") == "medium")).alias("medium_confidence"), *[F.count_if(c("report_section") == name).alias(name) for name in sections],
    )


def core_action_items(displayed: DataFrame) -> DataFrame:
    low_bot = (c("effective_priority") == "Low") & c("check_id").rlike(r"geo\.(robots_mentions_|llms_txt_)")
    return displayed.where(
        (c("report_section") == "action_items") & c("effective_status").isin("Warning", "Error") & (c("effective_priority").isin("High", "Medium") | low_bot)
        & F.coalesce(c("confidence"), F.lit("medium")).isin("high", "medium") & (c("affected_count") > 0)
    )


def ordered_findings(displayed: DataFrame, top: int) -> DataFrame:
    """First findings of a run by priority, then status, then reach."""
    order = Window.partitionBy("run_id").orderBy(
        lookup(c("effective_priority"), {"High": 0, "Medium": 1, "Low": 2}, 3), lookup(c("effective_status"), {"Error": 0, "Warning": 1, "NA": 2, "OK": 3}, 4), F.desc("affected_count"), "finding_id"
    )
    return displayed.withColumn("position", F.row_number().over(order)).where(c("position") <= top)


def points(displayed: DataFrame) -> DataFrame:
    """Maturity point of every finding; excluded ones have no point."""
    status = F.when(c("effective_status").isin("NA", "OK"), c("effective_status")).when(c("display_status") == "Opportunity", "Opportunity").otherwise(c("effective_status"))
    kind = F.lower(c("display_type"))
    text = F.lower(F.concat_ws(" ", c("finding"), F.coalesce(c("effective_finding"), F.lit(""))))
    named = F.lower(F.concat_ws(" ", c("check_id"), c("finding"), F.coalesce(c("effective_finding"), F.lit(""))))
    excluded = (status == "NA") | (c("check_id").isin(*TOOL_CHECKS) & (status != "Error")) | (c("report_section") == "not_applicable")
    contradiction = (status == "OK") & text.rlike(CONTRADICTION)
    special = c("check_id").isin(*LOW_AVAILABILITY, *POLICY_CHECKS)
    point = (
        F.when(excluded, F.lit(None)).when(contradiction, 1).when(special, F.when(status == "OK", 10).otherwise(1)).when((status != "OK") & named.rlike(MISSING_SIGNAL), 1).when(status == "OK", 10)
        .when((status == "Opportunity") | (kind == "opportunity") | (kind == "best_practice"), 6).when(status == "Warning", 4).when(status == "Error", 1)
    )
    label = F.when(contradiction & ~excluded, F.when(kind == "opportunity", "Opportunity").otherwise("Warning")).otherwise(status)
    table = F.create_map(*[F.lit(x) for name, ids in CATEGORY_CHECKS.items() for check in ids for x in (check, name)])
    category = F.coalesce(F.try_element_at(table, c("check_id")), F.lit("uncategorized"))
    return U.computed_once(displayed, {"point": point, "maturity_status": label, "maturity_category": category})


def label(score: Column) -> Column:
    rule = F.when(score.isNull(), F.lit("Nicht bewertet"))
    for bound, name in LABELS:
        rule = rule.when(score < bound, F.lit(name))
    return rule.otherwise(F.lit("Top"))


def _by_category(pointed: DataFrame) -> DataFrame:
    status, used = c("maturity_status"), c("point").isNotNull()
    rows = pointed.groupBy("run_id", "maturity_category").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(used).alias("evaluated"), half_up(F.avg("point"), 1).alias("score"), F.count_if(used & (status == "OK")).alias("passed"),
        F.count_if(used & (status == "Warning")).alias("warnings"), F.count_if(used & (status == "Error")).alias("errors"), F.count_if(used & (status == "Opportunity")).alias("opportunities"), F.count_if(~used).alias("excluded"),
        F.sum("point").alias("points"),
    )
    return rows.withColumns({"weight": lookup(c("maturity_category"), CATEGORY_WEIGHT, 1.0), "label": label(c("score"))})


def category_scores(pointed: DataFrame) -> DataFrame:
    return _by_category(pointed).drop("points")


def run_maturity(pointed: DataFrame) -> DataFrame:
    """Weighted, plain and per-check averages of a run with its label, summed up from its categories in one pass."""
    weight = F.when(c("score").isNotNull(), c("weight"))
    rows = _by_category(pointed).groupBy("run_id").agg(
        half_up(F.round(F.sum(c("score") * weight) / F.nullif(F.sum(weight), F.lit(0.0)), 8), 1).alias("maturity_score"), half_up(F.round(F.avg("score"), 8), 1).alias("unweighted_score"),
        F.nullif(F.count("score"), F.lit(0)).alias("categories"), half_up(F.sum("points") / F.nullif(F.sum("evaluated"), F.lit(0)), 1).alias("check_average"), F.sum("checks").alias("checks"), F.sum("excluded").alias("excluded"),
    )
    return rows.withColumn("label", label(c("maturity_score")))


def highlights(pointed: DataFrame, top: int = 5) -> DataFrame:
    """Strengths, weaknesses and next steps: up to ``top`` categories of each kind per run."""
    # Three rankings read the scores; stored, they are worked out once.
    rows = stored(category_scores(pointed).where(c("score").isNotNull()))
    strong = Window.partitionBy("run_id").orderBy(F.desc("score"), F.desc("weight"), F.desc("passed"), "maturity_category")
    weak = Window.partitionBy("run_id").orderBy("score", F.desc("weight"), F.desc("errors"), F.desc("warnings"), "maturity_category")
    bad = c("warnings") + c("errors") + c("opportunities") > 0
    parts = [
        (rows.where(c("score") >= 7), strong, "strength"), (rows.where((c("score") < 7) | bad), weak, "weakness"), (rows.where(c("maturity_category").isin(*STRATEGIC) & (c("score") < 8.5)), weak, "next_step"),
    ]
    output = None
    for part, window, kind in parts:
        ranked = part.withColumn("position", F.row_number().over(window)).where(c("position") <= top)
        chosen = ranked.select("run_id", F.lit(kind).alias("kind"), "position", "maturity_category", "score")
        output = chosen if output is None else output.unionByName(chosen)
    return output


def quick_wins(pointed: DataFrame, top: int = 5) -> DataFrame:
    """Findings worth doing first: small effort, then priority, then reach."""
    rows = pointed.where(c("point").isNotNull() & ~c("maturity_status").isin("OK", "NA"))
    text = F.lower(F.concat_ws(" ", c("check_id"), c("category")))
    estimated = (
        F.when(text.rlike("robots_mentions|ai_bots|open_graph|webmanifest|favicon|html_lang|viewport|security|header|llms"), "S")
        .when(text.rlike("schema|structured|breadcrumb|title|meta|h1"), "M").otherwise("unknown")
    )
    effort = F.coalesce(F.when(c("effective_effort").isin("S", "M", "L"), c("effective_effort")), estimated)
    candidate = (c("effort_used") == "S") | ((c("effort_used") == "M") & (c("effective_priority") != "High")) | c("display_type").isin("opportunity", "best_practice")
    order = Window.partitionBy("run_id").orderBy(lookup(c("effort_used"), {"S": 0, "M": 1, "L": 2}, 3), lookup(c("effective_priority"), {"High": 0, "Medium": 1, "Low": 2}, 3), F.desc("affected_count"), "finding_id")
    ranked = rows.withColumn("effort_used", effort).where(candidate).withColumn("position", F.row_number().over(order))
    return ranked.where(c("position") <= top).select("run_id", "position", "finding_id", "check_id", "effort_used", "effective_priority", "affected_count")


def latest_reviews(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Last review per finding; reviews of unknown findings are left out."""
    fields = [name for name in reviews.columns if name not in ("run_id", "finding_id", "reviewed_at")]
    last = reviews.groupBy("run_id", "finding_id").agg(F.max_by(F.struct(*fields), "reviewed_at").alias("m")).select("run_id", "finding_id", "m.*")
    return last.join(findings.select("run_id", "finding_id"), ["run_id", "finding_id"], "left_semi")
