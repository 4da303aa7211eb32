"""Checks over the page table, grouped by area. All of them run through ``evaluate_checks``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.config import (
    STATE_FAIL,
    STATE_INSUFFICIENT,
    STATE_NOT_APPLICABLE,
    STATE_NOT_EXECUTED,
    STATE_PASS,
    STATE_TECHNICAL,
    THRESHOLDS,
)
from sitewright.functions import http
from sitewright.functions import page_type as PT
from sitewright.functions import url as U
from sitewright.functions.schema_types import in_family
from sitewright.operators import scopes as S
from sitewright.operators.predicates import (
    ZERO,
    Check,
    _fail_count,
    count_of,
    flag_off,
    has,
    issue,
    ladder,
    no_rows,
    none,
    presence,
)

c = F.col
T = THRESHOLDS
HEAD, CRAWL, HOST = "HTML Head & Meta", "Crawling & Indexing", "Server & Infrastructure"
DATA, RENDER, BROWSER = "Structured Data", "JavaScript & Rendering", "Browser Metadata Opportunity"
STRUCTURE, TRUST = "Content Structure Signals", "Trust & Review Signals"

# fixed values
OPEN_GRAPH_FIELDS = ("og:title", "og:description", "og:image", "og:url", "og:type")
TOPIC_WORDS = (
    "gesundheit", "health", "krankheit", "tierarzt", "veterinaer", "veterinär", "futterberatung", "ernaehrung",
    "ernährung", "versicherung", "recht", "law", "finanz", "finance", "medikament", "symptom",
)


def _array(name: str) -> Column:
    return F.coalesce(c(name), F.array().cast("array<string>"))


def _text_length(name: str, short: bool, limit: int) -> Column:
    size = F.length(c(name))
    return (F.coalesce(c(name), F.lit("")) != "") & ((size < limit) if short else (size > limit))


def prepare(pages: DataFrame) -> DataFrame:
    """Pages with the derived columns that several checks read: attempt stability, search class, listing by URL."""
    found = PT.classify_search(
        c("url"), c("page_type"), F.concat_ws(" ", c("title"), c("h1_text")), types=_array("schema_types"),
        explicit_results=c("search_result_text"), main_forms=c("main_search_forms"), result_lists=c("search_result_lists"), search_action=c("search_action"), forms=c("search_forms"),
    )
    return U.computed_once(
        pages,
        {"http_stability": http.stability(c("attempts")), "search_class": found["classification"], "listing_by_url": PT.listing_by_url(c("url"))},
    )


def head_checks() -> list[Check]:
    content, ok, complete = S.content_html(), S.successful_html(), S.complete_state()
    pending = content & ~complete
    checks = [
        issue("tech.title_missing", HEAD, content & complete & S.blank(c("title")), scope=content, incomplete=pending, fail_status="Error", evidence=("scope", "open")),
        issue("tech.meta_description_missing", HEAD, content & complete & S.blank(c("meta_description")), scope=content, incomplete=pending, priority="Low", score_eligible=False),
        issue("tech.html_lang_missing", HEAD, ok & complete & S.blank(c("html_lang")), scope=ok, incomplete=ok & ~complete),
    ]
    for check_id, name, short, limit in (
        ("tech.title_too_short", "title", True, T.title_min),
        ("tech.title_too_long", "title", False, T.title_max),
        ("tech.meta_description_too_short", "meta_description", True, T.description_min),
        ("tech.meta_description_too_long", "meta_description", False, T.description_max),
    ):
        hit = content & complete & _text_length(name, short, limit)
        checks.append(issue(check_id, HEAD, hit, incomplete=pending, priority="Low", score_eligible=False))
    missing_fields = F.size(F.array_except(F.array(*[F.lit(x) for x in OPEN_GRAPH_FIELDS]), _array("og_fields"))) > 0
    comparable = lambda url: F.regexp_replace(F.lower(url), "/+$", "")
    og_differs = comparable(c("og_url")) != comparable(F.get(c("canonical_values"), F.lit(0)))
    og_hit = content & complete & (missing_fields | F.coalesce(og_differs, F.lit(False)))
    og_state = ladder(
        (lambda m: (m["scope"] == 0) & (m["html"] == 0), STATE_NOT_EXECUTED),
        (none("scope"), STATE_NOT_APPLICABLE),
        (has("hit"), STATE_FAIL),
        (has("open"), STATE_INSUFFICIENT),
    )
    hreflang_rows = ok & complete & (F.size(_array("hreflang")) > 0)
    no_default = hreflang_rows & ~F.exists(_array("hreflang"), lambda code: F.lower(code) == "x-default")
    tags, vendors = S.is_html() & (c("has_tag_manager") == 1), S.is_html() & (F.size(_array("consent_vendors")) > 0)
    consent_state = ladder(
        (none("html"), STATE_NOT_EXECUTED),
        (lambda m: (m["tags"] == 0) & (m["vendors"] == 0), STATE_NOT_APPLICABLE),
        (none("vendors"), STATE_FAIL),
    )
    hard = (c("main_regions") != 1) | (c("empty_headings") > 0)
    weak = ok & (hard | (c("nav_regions") < 1) | (c("heading_skips") > 0) | (c("h1_count") > 1))
    semantics_state = ladder((none("scope"), STATE_INSUFFICIENT), (has("hard"), STATE_FAIL))
    hints = S.is_html() & ((c("has_preload") == 1) | (c("has_preconnect") == 1))
    favicon_state = ladder((none("html"), STATE_INSUFFICIENT), (has("hit"), STATE_FAIL))
    checks += [
        issue("tech.h1_missing", HEAD, content & complete & (F.coalesce(c("h1_count"), F.lit(0)) == 0), scope=content, incomplete=pending, priority="Low", score_eligible=False),
        issue("tech.multiple_h1", HEAD, ok & complete & (c("h1_count") > 1), incomplete=ok & ~complete, priority="Low", score_eligible=False),
        issue("tech.viewport_missing", HEAD, ok & S.blank(c("viewport")), scope=ok, needs_rows=True),
        issue("tech.webmanifest_missing", BROWSER, ok & S.blank(c("manifest")), scope=ok, needs_rows=True, priority="Low"),
        Check("tech.open_graph_basics_missing", "HTML Head & Meta Opportunity", {"scope": content, "html": S.is_html(), "hit": og_hit, "open": pending}, og_state, _fail_count(og_state, "hit"), sample="hit", priority="Low"),
        Check("tech.favicon_missing", BROWSER, {"html": S.is_html(), "hit": S.is_html() & S.blank(c("favicon"))}, favicon_state, _fail_count(favicon_state, "hit"), sample="hit", priority="Low"),
        issue("tech.app_icons_incomplete", BROWSER, S.is_html() & (S.blank(c("favicon")) | (c("touch_icons") <= 0)), priority="Low"),
        Check(
            "tech.hreflang_x_default_missing", HEAD, {"rows": hreflang_rows, "open": ok & ~complete, "hit": no_default},
            ladder((lambda m: (m["rows"] == 0) & (m["open"] > 0), STATE_INSUFFICIENT), (none("rows"), STATE_NOT_APPLICABLE), (has("hit"), STATE_FAIL)),
            count_of("hit"), sample="hit", priority="Low",
        ),
        Check("tech.consent_technical_signals", "Consent/Privacy Technical Review", {"html": S.is_html(), "tags": tags, "vendors": vendors}, consent_state, _fail_count(consent_state, "tags"), sample="tags", priority="Low", evidence=("tags", "vendors")),
        Check("tech.html_semantics_summary", "HTML Semantics & Accessibility Signals", {"scope": ok, "hard": ok & hard, "weak": weak}, semantics_state, count_of("weak"), sample="weak", priority="Low", evidence=("hard", "weak")),
        issue("tech.raw_html_size_large", "Performance Light", c("raw_html_size") > T.html_bytes, needs_rows=True, priority="Low"),
        Check("tech.resource_hints_summary", "Performance Light", {"html": S.is_html(), "hints": hints}, ladder((none("hints"), STATE_INSUFFICIENT)), ZERO, sample=None, priority="Low", evidence=("html", "hints")),
    ]
    return checks


def crawl_checks() -> list[Check]:
    html = S.is_html()
    legal = S.page_type() == "legal"
    stable = c("http_stability")
    client = S.between(c("status_code"), 400, 500)
    sure, unsure = client & ~c("status_code").isin(408, 429), client & c("status_code").isin(408, 429)
    server = S.between(c("status_code"), 500, 600)
    confirmed, open_server = server & (stable == "confirmed"), server & (stable != "confirmed")
    noindex = html & ((F.coalesce(c("noindex"), F.lit(0)) == 1) | S.robots_text().contains("noindex"))
    nofollow = html & ((F.coalesce(c("nofollow"), F.lit(0)) == 1) | S.robots_text().contains("nofollow"))
    header = http.robots_directives(c("x_robots_tag"))
    meta = http.robots_directives(c("meta_robots"))
    blocked = F.arrays_overlap(header, F.array(F.lit("noindex"), F.lit("none")))
    tagged = F.coalesce(c("x_robots_tag"), F.lit("")) != ""
    markup = F.coalesce(F.lower(c("content_type")).rlike("html"), F.lit(False))
    other_types = F.coalesce(~S.page_type().isin("legal", "contact"), F.lit(True))
    conflict = tagged & (F.size(meta) > 0) & (F.size(header) > 0) & (F.array_join(meta, ",") != F.array_join(header, ","))
    inventory = ladder((none("html"), STATE_NOT_EXECUTED), last=STATE_NOT_APPLICABLE)
    kind = c("search_class")
    open_search = html & (kind == "internal_search") & (F.coalesce(c("noindex"), F.lit(0)) == 0) & ~S.robots_text().contains("noindex")
    search_state = ladder(
        (none("html"), STATE_NOT_EXECUTED),
        (lambda m: (m["search"] == 0) & (m["unclear"] > 0), STATE_INSUFFICIENT),
        (none("search"), STATE_NOT_APPLICABLE),
        (has("hit"), STATE_FAIL),
    )
    client_state = ladder(
        (has("hit"), STATE_FAIL),
        (has("technical"), STATE_TECHNICAL),
        (has("unsure"), STATE_INSUFFICIENT),
    )
    server_state = ladder((has("hit"), STATE_FAIL), (has("technical"), STATE_TECHNICAL), (has("unsure"), STATE_INSUFFICIENT))
    return [
        Check("tech.4xx_pages", HOST, {"hit": sure, "unsure": unsure, "technical": unsure & (stable == "technical_error")}, client_state, _fail_count(client_state, "hit"), sample="hit", evidence=("unsure",)),
        Check("tech.5xx_pages", HOST, {"hit": confirmed, "unsure": open_server, "technical": open_server & (stable == "technical_error")}, server_state, _fail_count(server_state, "hit"), sample="hit", fail_status="Error", priority="High", evidence=("unsure",)),
        Check("tech.redirect_pages", HOST, {"hit": S.between(c("initial_status_code"), 300, 400)}, ladder(), count_of("hit"), sample="hit", score_eligible=False),
        issue("tech.content_type_html_correct", HOST, c("content_type").isNull() | ~html, priority="Low"),
        issue("tech.charset_utf8_present", HOST, html & (F.coalesce(c("header_utf8"), F.lit(0)) == 0) & (F.coalesce(c("meta_utf8"), F.lit(0)) == 0), scope=html, empty=STATE_INSUFFICIENT, priority="Low"),
        Check("tech.noindex_pages", CRAWL, {"html": html, "content": noindex & ~legal, "legal": noindex & legal}, inventory, ZERO, evidence=("content", "legal"), score_eligible=False),
        Check("tech.nofollow_pages", CRAWL, {"html": html, "content": nofollow & ~legal, "legal": nofollow & legal}, inventory, ZERO, priority="Low", evidence=("content", "legal"), score_eligible=False),
        Check(
            "tech.x_robots_tag_unusual", HOST,
            {"hit": tagged & blocked & other_types & markup, "present": tagged, "legal": tagged & legal & blocked, "other": tagged & ~markup, "conflict": conflict},
            ladder((flag_off("store_headers"), STATE_NOT_EXECUTED), (has("hit"), STATE_FAIL)),
            lambda m: F.when(m.run("store_headers") == 0, F.lit(0)).otherwise(m["hit"]), sample="hit", evidence=("present", "legal", "other", "conflict"),
        ),
        Check("tech.internal_search_noindex_policy", CRAWL, {"html": html, "search": html & (kind == "internal_search"), "unclear": html & (kind == "unclear"), "hit": open_search}, search_state, _fail_count(search_state, "hit"), sample="hit", priority="Low", evidence=("search", "unclear")),
    ]


def rendering_checks() -> list[Check]:
    ok = S.successful_html()
    stable = ok & S.settled()
    more_words = (c("word_count_rendered") > c("word_count_raw") * T.rendered_word_ratio) & (c("word_count_rendered") - c("word_count_raw") > 50)
    fewer_links = (c("rendered_links") > c("internal_links") * 1.5) & (c("rendered_links") - c("internal_links") > 5)
    heading = (c("h1_count") == 0) & (c("rendered_h1_count") > 0)

    def rendered(check_id: str, condition: Column, facts: bool, **options) -> Check:
        steps = [
            (flag_off("use_browser"), STATE_NOT_EXECUTED),
            (lambda m: (m["stable"] == 0) & (m["errors"] > 0), STATE_TECHNICAL),
            (none("stable"), STATE_INSUFFICIENT),
        ]
        if facts:
            steps.append((none("facts"), STATE_INSUFFICIENT))
        state = ladder(*steps, (has("hit"), STATE_FAIL))
        measures = {"stable": stable, "facts": stable & S.has_text_facts(), "errors": c("navigation_error").isNotNull(), "hit": stable & condition}
        return Check(check_id, RENDER, measures, state, _fail_count(state, "hit"), sample="hit", evidence=("stable", "errors"), **options)

    html = S.is_html()
    few_words = (c("word_count_raw") < 100) & (c("word_count_rendered") > c("word_count_raw") * 2) & (c("word_count_rendered") > 200)
    dependent = html & S.settled() & (heading | few_words | fewer_links)
    thin = html & ((F.coalesce(c("h1_count"), F.lit(0)) == 0) | (c("page_type").isin("article", "product", "category") & (c("word_count_raw") < 80)))
    critical_state = ladder(
        (none("html"), STATE_INSUFFICIENT),
        (lambda m: m["facts"] < m["html"], STATE_INSUFFICIENT),
        (has("hit"), STATE_FAIL),
    )
    raw, first, final = c("raw_main_words"), c("initial_main_words"), c("settled_main_words")
    grew = (final >= F.greatest(F.lit(100.0), first * 1.8)) & (final - first >= 50)
    content_gap = (raw < 50) & (final >= 100) & (grew | (first >= 100))
    heading_gap = (c("h1_count") == 0) & (c("rendered_h1_count") > 0)
    conclusive = stable & ((raw >= 50) | (final >= 100) | heading_gap)
    js_state = ladder(
        (flag_off("use_browser"), STATE_NOT_EXECUTED),
        (lambda m: (m["stable"] == 0) & (m["failed"] > 0), STATE_TECHNICAL),
        (lambda m: m["stable"] < 2, STATE_INSUFFICIENT),
        (lambda m: m["sure"] < 2, STATE_INSUFFICIENT),
        (has("hit"), STATE_FAIL),
    )
    return [
        rendered("tech.rendered_word_count_delta", more_words, True),
        rendered("tech.raw_h1_missing_rendered_present", heading, False, priority="Low", score_eligible=False),
        rendered("tech.raw_internal_links_fewer_rendered", fewer_links, True),
        Check(
            "tech.critical_content_raw_html_signal", RENDER, {"html": html, "facts": html & S.has_text_facts(), "hit": dependent, "thin": thin}, critical_state,
            lambda m: F.when((m["html"] == 0) | (m["facts"] < m["html"]), F.lit(0)).when(m["hit"] > 0, m["hit"]).otherwise(m["thin"]),
            sample="hit", evidence=("hit", "thin"),
        ),
        Check(
            "tech.js_dependent_content", RENDER,
            {"stable": stable, "failed": ok & c("render_status").isin("unstable", "technical_error"), "sure": conclusive, "hit": conclusive & (content_gap | heading_gap)},
            js_state, _fail_count(js_state, "hit"), sample="hit", evidence=("stable", "sure"),
        ),
    ]


def breadcrumb_scope() -> Column:
    address = F.lower(c("url"))
    outside = S.page_type().isin("homepage", "blog_index", "article_index", "product_index", "category_index", "legal", "contact")
    inside = S.page_type().isin("article", "product", "category", "location")
    facts = address.contains("/fakta/") | address.contains("/fakten/") | address.contains("/facts/")
    return S.is_html() & ~outside & (inside | facts | (c("depth") > 1))


def schema_family_measures(page_type: str, family: str) -> dict[str, Column]:
    """Candidates of one page type and whether they carry the expected type family."""
    scope = S.successful_html() & (c("page_type") == page_type) & ~c("listing_by_url")
    typed = in_family(_array("schema_types"), family)
    address = F.lower(c("url"))
    fallback = (
        (S.has_text_facts() & address.rlike("/(beitrag|post|posts|article|articles|artikel)/"))
        if page_type == "article"
        else F.lit(False)
    )
    sure = (c("page_type_confidence") == "high") | typed | fallback
    eligible = scope & (c("indexable") == 1)
    return {
        "scope": eligible,
        "unknown": scope & c("indexable").isNull(),
        "unsure": eligible & ~sure,
        "hit": eligible & sure & ~typed,
    }


def structured_data_page_checks() -> list[Check]:
    def family_check(check_id: str, page_type: str, family: str, **options) -> Check:
        state = ladder(
            (lambda m: (m["hit"] == 0) & (m["unsure"] + m["unknown"] > 0), STATE_INSUFFICIENT),
            (none("scope"), STATE_NOT_APPLICABLE),
            (has("hit"), STATE_FAIL),
        )
        return Check(check_id, DATA, schema_family_measures(page_type, family), state, _fail_count(state, "hit"), sample="hit", evidence=("scope", "unsure", "unknown"), **options)

    crumbs = breadcrumb_scope()
    has_crumbs = F.array_contains(_array("schema_types"), "BreadcrumbList")
    faq, weak_faq = c("has_faq") == 1, (c("has_faq") == 0) & (c("has_weak_faq") == 1)
    faq_missing = faq & ~F.array_contains(_array("schema_types"), "FAQPage")
    faq_state = ladder(
        (lambda m: (m["scope"] == 0) & (m["weak"] > 0), STATE_INSUFFICIENT), (none("scope"), STATE_NOT_APPLICABLE), (has("hit"), STATE_FAIL),
    )
    faq_check = lambda check_id, category: Check(check_id, category, {"scope": faq, "weak": weak_faq, "hit": faq_missing}, faq_state, _fail_count(faq_state, "hit"), sample="hit", priority="Low", evidence=("scope", "weak"))
    video, video_missing = c("has_video") == 1, (c("has_video") == 1) & ~F.array_contains(_array("schema_types"), "VideoObject")
    return [
        family_check("tech.article_coverage_on_article_like_pages", "article", "Article", priority="Low"),
        family_check("tech.product_coverage_on_product_like_pages", "product", "Product"),
        family_check("geo.article_blog_pages_article_schema", "article", "Article", score_eligible=False),
        issue("tech.breadcrumb_missing_low_coverage", DATA, crumbs & ~has_crumbs, scope=crumbs, priority="Low", evidence=("scope",)),
        presence("geo.breadcrumblist_present", DATA, crumbs & has_crumbs, crumbs, crumbs & ~has_crumbs, empty=STATE_INSUFFICIENT, priority="Low"),
        faq_check("tech.faqpage_missing_low_coverage", DATA),
        faq_check("geo.faq_html_present_schema_missing", "Structured Content"),
        issue("tech.videoobject_schema_present_missing", "Media SEO", video_missing, scope=video, priority="Low"),
    ]


def content_signal_checks() -> list[Check]:
    html = S.is_html()
    article = html & (S.page_type() == "article")

    def signal(check_id: str, name: str) -> Check:
        state = ladder((lambda m: (m["scope"] > 0) & (m["open"] > 0), STATE_INSUFFICIENT), (none("scope"), STATE_NOT_APPLICABLE), (has("hit"), STATE_FAIL))
        measures = {"scope": article, "open": article & ~S.has_text_facts(), "hit": article & (F.coalesce(c(name), F.lit(0)) == 0)}
        return Check(check_id, "Entity & Freshness Signals", measures, state, _fail_count(state, "hit"), sample="hit", priority="Low")

    lists_state = ladder((none("html"), STATE_INSUFFICIENT), (none("lists"), STATE_FAIL))
    source_missing = article & (F.coalesce(c("source_links"), F.lit(0)) == 0)
    topics = F.lower(F.concat_ws(" ", F.coalesce(c("url"), F.lit("")), F.coalesce(c("title"), F.lit(""))))
    topical = html & topics.rlike("|".join(TOPIC_WORDS))
    weak = article & (F.coalesce(c("has_author"), F.lit(0)) == 0) & (F.coalesce(c("source_links"), F.lit(0)) == 0)
    trust_schema = html & F.exists(_array("schema_types"), lambda name: F.lower(name).rlike("organization|localbusiness|person"))
    trust_state = ladder((none("html"), STATE_INSUFFICIENT), (has("open"), STATE_INSUFFICIENT), (has("hit"), STATE_FAIL))
    low = c("low_structure") == 1
    low_state = ladder((has("open"), STATE_INSUFFICIENT), (has("hit"), STATE_FAIL))
    return [
        Check("geo.tables_present", STRUCTURE, {"html": html, "tables": c("has_tables") == 1}, ladder((lambda m: (m["html"] == 0) | (m["tables"] == 0), STATE_INSUFFICIENT)), ZERO, priority="Low", evidence=("html", "tables")),
        Check("geo.bulletpoints_lists_present", STRUCTURE, {"html": html, "lists": c("has_lists") == 1}, lists_state, _fail_count(lists_state, "html"), priority="Low", evidence=("html", "lists")),
        signal("geo.visible_dates_present", "has_date"),
        signal("geo.author_hints_present", "has_author"),
        presence("geo.source_or_external_links_present", "Content Structure", article & (c("source_links") > 0), article, source_missing, priority="Low"),
        Check("trust.eeat_signal_summary", TRUST, {"html": html, "open": article & ~S.has_text_facts(), "hit": weak, "schema": trust_schema}, trust_state, _fail_count(trust_state, "hit"), sample="hit", priority="Low", evidence=("schema",)),
        issue("trust.ymyl_review_signal", TRUST, topical, priority="Low"),
        Check("geo.low_structured_sections", "Content Structure", {"hit": low, "open": low & ~S.has_text_facts()}, low_state, _fail_count(low_state, "hit"), sample="hit", priority="Low"),
    ]


def all_page_checks() -> list[Check]:
    return head_checks() + crawl_checks() + rendering_checks() + structured_data_page_checks() + content_signal_checks()
