"""Matching of findings with a manual review: rule mapping, candidate scores, coverage of items, extra findings.

Candidates come from equi-joins on what can link an item with a finding: a mapped check, the family of a mapped check,
or the category together with a shared word. A pair without any of these has no usable mapping signal and cannot cover
an item, so no all-pairs join is needed. A run holds at most one finding per check here, which bounds the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.functions import text as TX
from sitewright.functions import url as U
from sitewright.operators.maturity import CATEGORY_CHECKS
from sitewright.session import stored

c = F.col
# fixed values: mapping rules (pattern, category, checks, needs)
RULES = {
    "title": (
        "title|titel|seitentitel",
        "html-head",
        ("tech.title_missing", "tech.title_too_short", "tech.title_too_long", "tech.duplicate_titles", "template.title_pattern_issue"),
        "",
    ),
    "meta-description": (
        "meta.?description|meta.?beschreibung|description tag|description length",
        "html-head",
        ("tech.meta_description_missing", "tech.meta_description_too_short", "tech.meta_description_too_long", "tech.duplicate_meta_descriptions", "template.meta_pattern_issue"),
        "",
    ),
    "h1": (
        r"\bh1\b|headline",
        "html-head",
        ("tech.h1_missing", "tech.multiple_h1"),
        "",
    ),
    "noindex": (
        "noindex|nicht indexierbar|indexierbarkeit|indexability",
        "technical-seo",
        ("tech.noindex_pages", "template.noindex_pattern"),
        "",
    ),
    "canonical": (
        "canonical|kanonisch",
        "technical-seo",
        ("tech.canonical_missing", "tech.canonical_non_self", "tech.canonical_to_other_domain", "tech.canonical_target_non_200", "template.canonical_pattern_issue"),
        "",
    ),
    "status-redirect": (
        "status.?code|4xx|5xx|redirect|weiterleitung|server.?error",
        "technical-seo",
        ("tech.status_code_distribution", "tech.4xx_pages", "tech.5xx_pages", "tech.redirect_pages"),
        "",
    ),
    "internal-links": (
        "internal link|interne link|broken link|3xx|4xx|orphan",
        "technical-seo",
        ("tech.internal_links_to_3xx", "tech.internal_links_to_4xx_5xx", "tech.orphan_like_sitemap_urls"),
        "",
    ),
    "robots-sitemap-pagination": (
        r"robots\.txt|sitemap|pagination|rel=next|paginated",
        "technical-seo",
        ("tech.robots_txt_present", "tech.sitemap_present", "tech.sitemap_in_robots", "tech.sitemap_urls_non_200"),
        "",
    ),
    "schema": (
        "schema|structured data|strukturierte daten|json.?ld",
        "structured-data",
        ("tech.schema_types_coverage_summary", "tech.json_ld_parse_errors", "template.schema_missing_pattern"),
        "",
    ),
    "article-schema": (
        "article schema|artikel.?schema|blog.*article",
        "structured-data",
        ("tech.article_coverage_on_article_like_pages", "geo.article_blog_pages_article_schema", "template.schema_missing_pattern"),
        "",
    ),
    "image-alt": (
        "alt.?text|fehlende alt|image alt|bilder.*alt",
        "media-performance",
        ("tech.images_without_alt", "tech.empty_alt_texts"),
        "",
    ),
    "security-headers": (
        "security|hsts|csp|content security|x-frame|x-content|referrer|permissions policy",
        "security-server",
        ("tech.hsts_header", "tech.content_security_policy", "tech.x_frame_options", "tech.x_content_type_options", "tech.referrer_policy", "tech.permissions_policy"),
        "",
    ),
    "cache-cdn": (
        "cache|cdn|edge|expires|x-cache|cf-cache",
        "media-performance",
        ("tech.cache_control_header", "tech.cdn_cache_signals"),
        "",
    ),
    "crux-psi": (
        "crux|psi|page.?speed|core web vitals|lcp|inp|field data",
        "media-performance",
        ("template.low_lighthouse_performance", "template.high_lcp", "template.high_tbt"),
        "external",
    ),
    "open-graph": (
        r"open graph|\bog:|social preview|social metadata",
        "html-head",
        ("tech.open_graph_basics_missing",),
        "",
    ),
    "consent-privacy-tagmanager": (
        "consent|cookie banner|cookiebot|onetrust|tag manager|gtm|gdpr|dsgvo",
        "consent-privacy",
        ("tech.consent_technical_signals",),
        "human",
    ),
    "llms": (
        r"llms\.txt|llms-full|markdown twin",
        "geo-readiness",
        ("geo.llms_txt_present", "geo.llms_txt_http_status", "geo.llms_full_txt_present", "geo.markdown_twin_homepage"),
        "",
    ),
    "ai-bots": (
        "ai bot|gptbot|oai-searchbot|chatgpt-user|claudebot|perplexity|google-extended|ccbot|applebot|bytespider|crawler policy",
        "ai-crawler-policy",
        CATEGORY_CHECKS["ai-crawler-policy"],
        "",
    ),
    "trust-entity": (
        "e-?e-?a-?t|trust|author|external source|entity|brand|about|kontakt|contact|impressum|datenschutz",
        "trust-entity",
        ("trust.eeat_signal_summary", "geo.impressum_linked", "geo.datenschutz_linked", "geo.about_linked", "geo.contact_linked", "geo.source_or_external_links_present", "geo.author_hints_present"),
        "human",
    ),
}
PAGE_WORDS = ("pdp", "product", "produkt", "plp", "category", "kategorie", "article", "artikel", "blog", "magazine", "facette", "facet", "filter")
TEMPLATE_WORDS = "template|pattern|pdp|plp|category|kategorie|article|artikel|schema|canonical|title|meta|h1"


# fixed values: coarse family of each check; a check that is not listed is its own family
CHECK_FAMILIES = {
    "title": (
        "tech.duplicate_titles",
        "tech.title_missing",
        "tech.title_too_long",
        "tech.title_too_short",
        "template.title_pattern_issue",
    ),
    "meta-description": (
        "tech.duplicate_meta_descriptions",
        "tech.meta_description_missing",
        "tech.meta_description_too_long",
        "tech.meta_description_too_short",
        "template.meta_pattern_issue",
    ),
    "h1": (
        "tech.multiple_h1",
    ),
    "canonical": (
        "tech.canonical_missing",
        "tech.canonical_non_self",
        "tech.canonical_target_non_200",
        "tech.canonical_to_other_domain",
        "template.canonical_pattern_issue",
    ),
    "crawl-indexability": (
        "tech.internal_search_noindex_policy",
        "tech.noindex_pages",
        "tech.orphan_like_sitemap_urls",
        "tech.robots_txt_present",
        "tech.sitemap_in_robots",
        "tech.sitemap_present",
        "tech.sitemap_urls_non_200",
        "template.noindex_pattern",
    ),
    "structured-data": (
        "geo.article_blog_pages_article_schema",
        "geo.breadcrumblist_present",
        "geo.faq_html_present_schema_missing",
        "geo.organization_schema_sameas",
        "tech.article_coverage_on_article_like_pages",
        "tech.breadcrumb_missing_low_coverage",
        "tech.json_ld_parse_errors",
        "tech.product_coverage_on_product_like_pages",
        "tech.schema_types_coverage_summary",
        "tech.videoobject_schema_present_missing",
        "template.schema_missing_pattern",
    ),
    "cache-performance": (
        "tech.cache_control_header",
        "tech.cdn_cache_signals",
        "tech.compression_header",
        "tech.high_ttfb",
    ),
    "resource-performance": (
        "tech.imported_resource_performance_signals",
        "tech.js_dependent_content",
        "tech.large_css_total",
        "tech.large_js_total",
        "tech.preconnect_missing",
        "tech.preload_missing",
        "tech.resource_hints_summary",
        "tech.third_party_scripts_detected",
        "tech.too_many_css",
        "tech.too_many_js",
        "template.high_lcp",
        "template.high_tbt",
        "template.js_required_content",
        "template.lighthouse_unavailable",
        "template.low_lighthouse_performance",
        "template.low_lighthouse_seo",
    ),
    "image-media": (
        "tech.empty_alt_texts",
        "tech.images_without_alt",
        "tech.images_without_lazy_loading",
        "tech.images_without_width_height",
        "tech.large_image_resources",
        "tech.modern_image_format_coverage_low",
    ),
    "security-headers": (
        "tech.hsts_header",
        "tech.http_to_https_redirect",
        "tech.https_reachable",
        "tech.permissions_policy",
        "tech.referrer_policy",
        "tech.www_non_www_consistency",
        "tech.x_content_type_options",
        "tech.x_frame_options",
    ),
    "open-graph": (
        "tech.open_graph_basics_missing",
    ),
    "app-icons": (
        "tech.app_icons_incomplete",
        "tech.favicon_missing",
        "tech.webmanifest_missing",
    ),
    "consent": (
        "tech.consent_technical_signals",
    ),
    "javascript-rendering": (
        "tech.critical_content_raw_html_signal",
        "tech.raw_h1_missing_rendered_present",
        "tech.raw_html_size_large",
        "tech.raw_internal_links_fewer_rendered",
        "tech.rendered_word_count_delta",
    ),
    "html-semantics": (
        "tech.html_semantics_summary",
        "tech.http_version_support",
    ),
    "llms": (
        "geo.llms_full_txt_present",
        "geo.llms_txt_http_status",
        "geo.llms_txt_present",
        "geo.markdown_twin_coverage",
        "geo.markdown_twin_homepage",
    ),
    "ai-bots": (
        "geo.ai_bots_policy_summary",
        "geo.robots_mentions_applebot",
        "geo.robots_mentions_bytespider",
        "geo.robots_mentions_ccbot",
        "geo.robots_mentions_chatgpt_user",
        "geo.robots_mentions_claude_web",
        "geo.robots_mentions_claudebot",
        "geo.robots_mentions_google_extended",
        "geo.robots_mentions_gptbot",
        "geo.robots_mentions_oai_searchbot",
        "geo.robots_mentions_perplexitybot",
    ),
    "trust-entity": (
        "geo.about_linked",
        "geo.author_hints_present",
        "geo.contact_linked",
        "geo.datenschutz_linked",
        "geo.impressum_linked",
        "geo.source_or_external_links_present",
        "trust.eeat_signal_summary",
        "trust.ymyl_review_signal",
    ),
}


def check_family(check: Column) -> Column:
    """Coarse family of a check id."""
    table = F.create_map(*[F.lit(x) for name, ids in CHECK_FAMILIES.items() for found in ids for x in (found, name)])
    return F.coalesce(F.try_element_at(table, F.lower(check)), F.lower(check))


def map_items(items: DataFrame) -> DataFrame:
    """Rules, checks and needs of every manual item: rules by text, else rules of its category."""
    text = F.lower(F.concat_ws(" ", "title", "description", "recommendation", "category"))
    by_text = F.array_compact(F.array(*[F.when(text.rlike(rule[0]), F.lit(name)) for name, rule in RULES.items()]))
    by_category = F.array_compact(F.array(*[F.when(c("category") == rule[1], F.lit(name)) for name, rule in RULES.items()]))
    rows = U.computed_once(items, {"text_rules": by_text, "category_rules": by_category})
    rows = rows.withColumn("rules", F.when(F.size("text_rules") > 0, c("text_rules")).otherwise(c("category_rules")))
    table = F.create_map(*[x for name, rule in RULES.items() for x in (F.lit(name), F.array(*[F.lit(check) for check in rule[2]]))])
    checks = F.array_distinct(F.flatten(F.transform("rules", lambda name: F.try_element_at(table, name))))
    needs = lambda kind: F.arrays_overlap(c("rules"), F.array(*[F.lit(name) for name, rule in RULES.items() if rule[3] == kind]))
    confidence = F.when(F.size("text_rules") > 0, "high").when(F.size("rules") > 0, "medium").otherwise("low")
    return rows.withColumns({"expected_checks": F.coalesce(checks, F.array().cast("array<string>")), "needs_external": needs("external"), "needs_human": needs("human"), "mapping_confidence": confidence}).drop("text_rules", "category_rules")


def candidates(mapped: DataFrame, findings: DataFrame) -> DataFrame:
    """Scored (item, finding) pairs with a usable link and a score of 25 or more. A run has one finding for each check; of several the one of smallest id counts."""
    others = [name for name in findings.columns if name not in ("run_id", "check_id")]
    # Families, words and scores each read the findings; stored, they are grouped once.
    findings = stored(findings.groupBy("run_id", "check_id").agg(F.min_by(F.struct(*others), "finding_id").alias("one")).select("run_id", "check_id", "one.*"))
    left = mapped.select("run_id", "item_id", "title", "description", "recommendation", "category", "priority", F.col("affected_count").alias("item_affected"), "expected_checks")
    tagged = left.select("run_id", "item_id", F.explode(F.array_distinct(F.transform("expected_checks", check_family))).alias("family"))
    family = findings.withColumn("family", check_family(c("check_id"))).select("run_id", "finding_id", "family")
    words = left.select("run_id", "item_id", "category", F.explode(TX.tokens(F.concat_ws(" ", "title", "category"))).alias("word"))
    finding_words = findings.select("run_id", "finding_id", F.col("category_key").alias("category"), F.explode(TX.tokens(F.concat_ws(" ", "check_name", "finding", "category"))).alias("word"))
    pairs = tagged.join(family, ["run_id", "family"]).select("run_id", "item_id", "finding_id").unionByName(words.join(finding_words, ["run_id", "category", "word"]).select("run_id", "item_id", "finding_id")).distinct()
    right = findings.select("run_id", "finding_id", "check_id", "check_name", "finding", F.col("category").alias("finding_category"), "category_key", F.col("priority").alias("finding_priority"), "affected_count", "status")
    rows = pairs.join(left, ["run_id", "item_id"]).join(right, ["run_id", "finding_id"])
    item_text = F.lower(F.concat_ws(" ", "title", "description", "recommendation", "category"))
    finding_text = F.lower(F.concat_ws(" ", "check_name", "finding", "finding_category"))
    check_text = F.lower(F.concat_ws(" ", "check_id", "check_name", "finding"))
    ratio = F.least("item_affected", "affected_count") / F.greatest("item_affected", "affected_count")
    facts = {
        "direct": F.array_contains("expected_checks", c("check_id")), "family_match": F.exists("expected_checks", lambda check: check_family(check) == check_family(c("check_id"))), "category_match": c("category") == c("category_key"),
        "title_score": TX.token_similarity(c("title"), finding_text), "text_score": TX.token_similarity(item_text, finding_text),
        "affected_score": F.when((F.coalesce(c("item_affected"), F.lit(0)) == 0) | (c("affected_count") == 0), 0).when(ratio >= 0.8, 10).when(ratio >= 0.4, 6).otherwise(2),
        "page_overlap": F.array_contains(F.array(*[item_text.contains(word) & check_text.contains(word) for word in PAGE_WORDS]), True), "template_overlap": item_text.rlike(TEMPLATE_WORDS) & check_text.rlike(TEMPLATE_WORDS),
    }
    rows = U.computed_once(rows, facts)
    near = lambda column, floor, cap, scale: F.when(column >= floor, F.least(F.lit(cap), F.floor(column * scale + 0.5))).otherwise(0)
    score = (
        F.when(c("direct"), 50).when(c("family_match"), 25).otherwise(0) + F.when(c("affected_score") > 0, c("affected_score")).when(c("affected_count") > 0, 6).otherwise(0) + F.when(c("category_match"), 10).otherwise(0)
        + near(c("title_score"), 0.16, 12, 45) + near(c("text_score"), 0.18, 12, 40) + F.when(c("page_overlap"), 8).otherwise(0) + F.when(c("template_overlap"), 10).otherwise(0) + F.lit(5) + F.when(c("priority") == c("finding_priority"), 4).otherwise(0)
    )
    usable = c("direct") | c("family_match") | (c("category_match") & (c("title_score") >= 0.16) & (c("text_score") >= 0.18))
    return rows.withColumn("match_score", F.least(F.lit(100), score).cast("int")).where(usable & (c("match_score") >= 25)).select(
        "run_id", "item_id", "finding_id", "check_id", "status", "affected_count", "direct", "family_match", "category_match", "match_score"
    )


def coverage(mapped: DataFrame, scored: DataFrame) -> DataFrame:
    """Coverage status per item from its best active candidates; several related ones lift the score by at most 22."""
    active = scored.where(c("status").isin("Warning", "Error"))
    order = Window.partitionBy("run_id", "item_id").orderBy(F.desc("direct"), F.desc("family_match"), F.desc("match_score"), F.desc("affected_count"), "finding_id")
    best = active.withColumn("position", F.row_number().over(order)).groupBy("run_id", "item_id").agg(
        F.max("match_score").alias("best"), F.count_distinct("check_id").alias("checks"), F.count_distinct(check_family(c("check_id"))).alias("families"), F.count(F.lit(1)).alias("related"), F.bool_or(c("direct") | c("family_match")).alias("mapped"), F.max("affected_count").alias("reach"),
        F.min_by("check_id", "position").alias("matched_check_id"),
    )
    boost = F.when(c("related") >= 2, F.least(F.lit(22), (c("checks") - 1) * 5 + (c("families") - 1) * 4)).otherwise(0)
    rows = mapped.join(best, ["run_id", "item_id"], "left").withColumn("score", F.coalesce(F.least(F.lit(100), c("best") + boost), F.lit(0)).cast("int"))
    found, needs = c("best").isNotNull(), c("needs_external") | c("needs_human")
    status = (
        F.when(found & (c("score") >= 72) & c("mapped") & (c("reach") > 0) & ~needs, "covered").when(found, "partially_covered").when(c("needs_external"), "needs_external_data").when(c("needs_human"), "needs_human_review")
        .when(F.size("expected_checks") > 0, "false_negative_candidate").otherwise("not_covered")
    )
    return rows.select("run_id", "item_id", "category", "priority", "mapping_confidence", "score", "matched_check_id", "expected_checks", status.alias("coverage_status"))


def extra_findings(findings: DataFrame, scored: DataFrame, covered: DataFrame) -> DataFrame:
    """Active findings that no item matched, classified by how much they add."""
    matched = scored.select("run_id", "finding_id").distinct()
    indirect = covered.where(c("coverage_status").isin("covered", "partially_covered")).select("run_id", F.explode("expected_checks").alias("check_id")).distinct().withColumn("indirect", F.lit(True))
    rows = findings.where(c("status").isin("Warning", "Error")).join(matched, ["run_id", "finding_id"], "left_anti").join(indirect, ["run_id", "check_id"], "left")
    kind = (
        F.when((c("affected_count") == 0) | ((c("confidence") == "low") & (c("priority") == "Low")), "false_positive_candidate").when(c("indirect"), "already_covered_indirectly")
        .when((c("review_recommended") == 1) & c("finding_type").isin("opportunity", "best_practice"), "needs_review").when(c("finding_type") == "opportunity", "low_priority").when(c("confidence") == "low", "needs_review").when(c("priority") == "Low", "low_priority").otherwise("likely_relevant")
    )
    return rows.select("run_id", "finding_id", "check_id", kind.alias("classification"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    """Items per status and the weighted share of covered ones."""
    weight = F.when(c("coverage_status") == "covered", 1.0).when(c("coverage_status") == "partially_covered", 0.5).otherwise(0.0)
    return covered.groupBy("run_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(c("coverage_status") == "covered").alias("covered"), F.count_if(c("coverage_status") == "partially_covered").alias("partial"), F.round(F.avg(weight) * 100, 1).alias("weighted_coverage"))
