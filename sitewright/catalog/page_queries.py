"""Registered queries over page checks, with the DuckDB texts they are compared with."""

from __future__ import annotations

from sitewright.catalog import inputs
from sitewright.catalog import oracle as O
from sitewright.catalog.oracle import COMPLETE, CONTENT, HTML, OK, ROBOTS, SETTLED, check, failed, issue, state_case, union
from sitewright.catalog.site_views import Site, with_views
from sitewright.operators import page_checks
from sitewright.operators.predicates import affected_rows, evaluate_checks

QUERIES = {}
ORACLE = {}


def _family(builder):
    def run(spark, folder):
        site = Site(spark, folder)
        rows = inputs.pages(site)
        if builder in (page_checks.crawl_checks, page_checks.structured_data_page_checks):
            rows = page_checks.prepare(rows)
        return inputs.flat_results(evaluate_checks(rows, site.table("site_runs"), builder()))

    return run


NF, IE, NE, FAIL, TE = "not_applicable", "insufficient_evidence", "not_executed", "fail", "technical_error"
BLANK = "coalesce(trim({0}), '') = ''".format
PENDING = f"{CONTENT} AND NOT {COMPLETE}"
SCOPED = f"{CONTENT} AND {COMPLETE}"
OGMISS = "(og_fields <> 'og:title,og:description,og:image,og:url,og:type' OR coalesce(regexp_replace(lower(og_url), '/+$', '') <> regexp_replace(lower(split_part(canonical_values, ' ', 1)), '/+$', ''), false))"
HREF = f"{OK} AND {COMPLETE} AND hreflang <> ''"
HARD = "(main_regions <> 1 OR empty_headings > 0)"


def _length(check_id, column, test):
    hit = f"{SCOPED} AND coalesce({column}, '') <> '' AND length({column}) {test}"
    return issue(check_id, hit, pending=PENDING)


def _details(spark, folder):
    rows = inputs.pages(Site(spark, folder))
    return affected_rows(rows, [found for found in page_checks.head_checks() if found.id in DETAILS], "run_id", "page_id", "url")


DETAILS = {
    "tech.title_missing": f"{SCOPED} AND {BLANK('title')}",
    "tech.meta_description_missing": f"{SCOPED} AND {BLANK('meta_description')}",
    "tech.html_lang_missing": f"{OK} AND {COMPLETE} AND {BLANK('html_lang')}",
    "tech.title_too_short": f"{SCOPED} AND coalesce(title, '') <> '' AND length(title) < 20",
    "tech.title_too_long": f"{SCOPED} AND coalesce(title, '') <> '' AND length(title) > 65",
    "tech.h1_missing": f"{SCOPED} AND h1_count = 0",
}
QUERIES["detail_head_pages"] = _details
ORACLE["detail_head_pages"] = union([f"SELECT run_id, page_id, url, '{check_id}' AS check_id FROM site_pages WHERE {hit}" for check_id, hit in DETAILS.items()])

QUERIES["checks_head_and_meta"] = _family(page_checks.head_checks)
ORACLE["checks_head_and_meta"] = union([
    issue("tech.title_missing", f"{SCOPED} AND {BLANK('title')}", scope=CONTENT, pending=PENDING, fail="'Error'", evidence=("scope", "open")),
    issue("tech.meta_description_missing", f"{SCOPED} AND {BLANK('meta_description')}", scope=CONTENT, pending=PENDING),
    issue("tech.html_lang_missing", f"{OK} AND {COMPLETE} AND {BLANK('html_lang')}", scope=OK, pending=f"{OK} AND NOT {COMPLETE}"),
    _length("tech.title_too_short", "title", "< 20"),
    _length("tech.title_too_long", "title", "> 65"),
    _length("tech.meta_description_too_short", "meta_description", "< 70"),
    _length("tech.meta_description_too_long", "meta_description", "> 160"),
    issue("tech.h1_missing", f"{SCOPED} AND h1_count = 0", scope=CONTENT, pending=PENDING),
    issue("tech.multiple_h1", f"{OK} AND {COMPLETE} AND h1_count > 1", pending=f"{OK} AND NOT {COMPLETE}"),
    issue("tech.viewport_missing", f"{OK} AND {BLANK('viewport')}", scope=OK, needs_rows=True),
    issue("tech.webmanifest_missing", f"{OK} AND {BLANK('manifest')}", scope=OK, needs_rows=True),
    check("tech.open_graph_basics_missing", "site_pages", {"scope": CONTENT, "html": HTML, "hit": f"{SCOPED} AND {OGMISS}", "open": PENDING},
          state_case(("scope = 0 AND html = 0", NE), ("scope = 0", NF), ("hit > 0", FAIL), ("open > 0", IE)), failed("hit"), f"{SCOPED} AND {OGMISS}"),
    check("tech.favicon_missing", "site_pages", {"html": HTML, "hit": f"{HTML} AND {BLANK('favicon')}"}, state_case(("html = 0", IE), ("hit > 0", FAIL)), failed("hit"), f"{HTML} AND {BLANK('favicon')}"),
    issue("tech.app_icons_incomplete", f"{HTML} AND ({BLANK('favicon')} OR touch_icons <= 0)"),
    check("tech.hreflang_x_default_missing", "site_pages", {"rs": HREF, "open": f"{OK} AND NOT {COMPLETE}", "hit": f"{HREF} AND hreflang NOT LIKE '%x-default%'"},
          state_case(("rs = 0 AND open > 0", IE), ("rs = 0", NF), ("hit > 0", FAIL)), "hit", f"{HREF} AND hreflang NOT LIKE '%x-default%'"),
    check("tech.consent_technical_signals", "site_pages", {"html": HTML, "tags": f"{HTML} AND has_tag_manager = 1", "vendors": f"{HTML} AND consent_vendors <> ''"},
          state_case(("html = 0", NE), ("tags = 0 AND vendors = 0", NF), ("vendors = 0", FAIL)), failed("tags"), f"{HTML} AND has_tag_manager = 1", evidence=("tags", "vendors")),
    check("tech.html_semantics_summary", "site_pages", {"scope": OK, "hard": f"{OK} AND {HARD}", "weak": f"{OK} AND ({HARD} OR nav_regions < 1 OR heading_skips > 0 OR h1_count > 1)"},
          state_case(("scope = 0", IE), ("hard > 0", FAIL)), "weak", f"{OK} AND ({HARD} OR nav_regions < 1 OR heading_skips > 0 OR h1_count > 1)", evidence=("hard", "weak")),
    issue("tech.raw_html_size_large", "raw_html_size > 256000", needs_rows=True),
    check("tech.resource_hints_summary", "site_pages", {"html": HTML, "hints": f"{HTML} AND (has_preload = 1 OR has_preconnect = 1)"}, state_case(("hints = 0", IE)), "0", None, evidence=("html", "hints")),
])

STABLE = ("CASE attempt_statuses WHEN '500,500' THEN 'confirmed' WHEN '503,200' THEN 'transient' WHEN '503' THEN 'insufficient_evidence' "
          "WHEN '429' THEN 'insufficient_evidence' WHEN 'timeout,200' THEN 'transient' ELSE 'confirmed' END")
LEGAL = "coalesce(page_type, 'other') = 'legal'"
NOINDEX = f"({HTML} AND (coalesce(noindex, 0) = 1 OR {ROBOTS} LIKE '%noindex%'))"
NOFOLLOW = f"({HTML} AND (coalesce(nofollow, 0) = 1 OR {ROBOTS} LIKE '%nofollow%'))"
TAGGED = "coalesce(x_robots_tag, '') <> ''"
BLOCKED = "x_robots_tag IN ('noindex', 'none; nosnippet')"
QUERY = "regexp_extract(url, '[?]([^#]*)', 1)"
PATH = "lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1))"
SEARCH_PATH = f"regexp_matches({PATH}, '(^|/)(search|suche|site-search)(/|$)')"
HEADING = "(search_result_text > 0 OR regexp_matches(lower(concat(coalesce(title,''), ' ', h1_text)), 'search results?|suchergebnisse'))"
PLUS = f"(CASE WHEN {SEARCH_PATH} THEN 3 ELSE 0 END + CASE WHEN {HEADING} THEN 3 ELSE 0 END + CASE WHEN main_search_forms > 0 THEN 2 ELSE 0 END + CASE WHEN search_result_lists > 0 THEN 2 ELSE 0 END + search_action)"
MINUS = (f"(CASE WHEN page_type IN ('category_index', 'category') THEN -3 ELSE 0 END + CASE WHEN regexp_matches({PATH}, '(^|/)(tag|tags|kategorie|category)(/|$)') THEN -3 ELSE 0 END"
         f" + CASE WHEN {QUERY} LIKE '%page=%' THEN -2 ELSE 0 END)")
STRONG = f"(CASE WHEN {SEARCH_PATH} THEN 1 ELSE 0 END + CASE WHEN {HEADING} THEN 1 ELSE 0 END + CASE WHEN main_search_forms > 0 THEN 1 ELSE 0 END + CASE WHEN search_result_lists > 0 THEN 1 ELSE 0 END)"
CERTAIN = f"({STRONG} >= 2 AND {PLUS} + {MINUS} >= 5 AND {MINUS} > -3)"
UNCLEAR = f"(NOT {CERTAIN} AND {PLUS} >= 2)"
OPEN_SEARCH = f"{HTML} AND {CERTAIN} AND coalesce(noindex, 0) = 0 AND {ROBOTS} NOT LIKE '%noindex%'"
MARKUP = "coalesce(lower(content_type) LIKE '%html%', false)"
XHIT = f"{TAGGED} AND {BLOCKED} AND page_type NOT IN ('legal', 'contact') AND {MARKUP}"
FIRST_META = "CASE meta_robots WHEN 'noindex, follow' THEN 'noindex,follow' WHEN 'index, nofollow' THEN 'index,nofollow' ELSE meta_robots END"
FIRST_HEADER = "CASE x_robots_tag WHEN 'none; nosnippet' THEN 'none,nosnippet' ELSE x_robots_tag END"

QUERIES["checks_crawling_and_status"] = _family(page_checks.crawl_checks)
ORACLE["checks_crawling_and_status"] = union([
    check("tech.4xx_pages", "site_pages", {"hit": "status_code BETWEEN 400 AND 499 AND status_code NOT IN (408, 429)", "unsure": "status_code IN (408, 429)"},
          state_case(("hit > 0", FAIL), ("unsure > 0", IE)), failed("hit"), "status_code BETWEEN 400 AND 499 AND status_code NOT IN (408, 429)", evidence=("unsure",)),
    check("tech.5xx_pages", "site_pages", {"hit": f"status_code >= 500 AND {STABLE} = 'confirmed'", "unsure": f"status_code >= 500 AND {STABLE} <> 'confirmed'"},
          state_case(("hit > 0", FAIL), ("unsure > 0", IE)), failed("hit"), f"status_code >= 500 AND {STABLE} = 'confirmed'", fail="'Error'", evidence=("unsure",)),
    check("tech.redirect_pages", "site_pages", {"hit": "initial_status_code BETWEEN 300 AND 399"}, "'pass'", "hit", "initial_status_code BETWEEN 300 AND 399"),
    issue("tech.content_type_html_correct", f"content_type IS NULL OR NOT {HTML}"),
    issue("tech.charset_utf8_present", f"{HTML} AND header_utf8 = 0 AND meta_utf8 = 0", scope=HTML, empty=IE),
    check("tech.noindex_pages", "site_pages", {"html": HTML, "content": f"{NOINDEX} AND NOT {LEGAL}", "legal": f"{NOINDEX} AND {LEGAL}"}, state_case(("html = 0", NE), last=NF), "0", None, evidence=("content", "legal")),
    check("tech.nofollow_pages", "site_pages", {"html": HTML, "content": f"{NOFOLLOW} AND NOT {LEGAL}", "legal": f"{NOFOLLOW} AND {LEGAL}"}, state_case(("html = 0", NE), last=NF), "0", None, evidence=("content", "legal")),
    check("tech.x_robots_tag_unusual", "site_pages", {"hit": XHIT, "present": TAGGED, "legal": f"{TAGGED} AND {LEGAL} AND {BLOCKED}", "other": f"{TAGGED} AND NOT {MARKUP}",
          "conflict": f"{TAGGED} AND meta_robots IS NOT NULL AND {FIRST_META} <> {FIRST_HEADER}"},
          state_case(("store_headers = 0", NE), ("hit > 0", FAIL)), "CASE WHEN store_headers = 0 THEN 0 ELSE hit END", XHIT, evidence=("present", "legal", "other", "conflict")),
    check("tech.internal_search_noindex_policy", "site_pages", {"html": HTML, "search": f"{HTML} AND {CERTAIN}", "unclear": f"{HTML} AND {UNCLEAR}", "hit": OPEN_SEARCH},
          state_case(("html = 0", NE), ("search = 0 AND unclear > 0", IE), ("search = 0", NF), ("hit > 0", FAIL)), failed("hit"), OPEN_SEARCH, evidence=("search", "unclear")),
])

STABLE_PAGE = f"({OK} AND {SETTLED})"
WORDS = "(word_count_rendered > word_count_raw * 1.5 AND word_count_rendered - word_count_raw > 50)"
LINKS = "(rendered_links > internal_links * 1.5 AND rendered_links - internal_links > 5)"
H1GAP = "(h1_count = 0 AND rendered_h1_count > 0)"


def _rendered(check_id, condition, facts):
    steps = [("use_browser = 0", NE), ("stable = 0 AND errors > 0", TE), ("stable = 0", IE)] + ([("facts = 0", IE)] if facts else []) + [("hit > 0", FAIL)]
    measures = {"stable": STABLE_PAGE, "facts": f"{STABLE_PAGE} AND text_facts = 1", "errors": "navigation_error IS NOT NULL", "hit": f"{STABLE_PAGE} AND {condition}"}
    return check(check_id, "site_pages", measures, state_case(*steps), failed("hit"), f"{STABLE_PAGE} AND {condition}", evidence=("stable", "errors"))


FEW = "(word_count_raw < 100 AND word_count_rendered > word_count_raw * 2 AND word_count_rendered > 200)"
DEPENDENT = f"{HTML} AND {SETTLED} AND ({H1GAP} OR {FEW} OR {LINKS})"
THIN = f"{HTML} AND (h1_count = 0 OR (page_type IN ('article', 'product', 'category') AND word_count_raw < 80))"
GREW = "(settled_main_words >= greatest(100.0, initial_main_words * 1.8) AND settled_main_words - initial_main_words >= 50)"
GAP = f"(raw_main_words < 50 AND settled_main_words >= 100 AND ({GREW} OR initial_main_words >= 100))"
SURE = f"({STABLE_PAGE} AND (raw_main_words >= 50 OR settled_main_words >= 100 OR {H1GAP}))"

QUERIES["checks_rendering"] = _family(page_checks.rendering_checks)
ORACLE["checks_rendering"] = union([
    _rendered("tech.rendered_word_count_delta", WORDS, True),
    _rendered("tech.raw_h1_missing_rendered_present", H1GAP, False),
    _rendered("tech.raw_internal_links_fewer_rendered", LINKS, True),
    check("tech.critical_content_raw_html_signal", "site_pages", {"html": HTML, "facts": f"{HTML} AND text_facts = 1", "hit": DEPENDENT, "thin": THIN},
          state_case(("html = 0", IE), ("facts < html", IE), ("hit > 0", FAIL)), "CASE WHEN html = 0 OR facts < html THEN 0 WHEN hit > 0 THEN hit ELSE thin END", DEPENDENT, evidence=("hit", "thin")),
    check("tech.js_dependent_content", "site_pages", {"stable": STABLE_PAGE, "failedp": f"{OK} AND render_status IN ('unstable', 'technical_error')", "sure": SURE, "hit": f"{SURE} AND ({GAP} OR {H1GAP})"},
          state_case(("use_browser = 0", NE), ("stable = 0 AND failedp > 0", TE), ("stable < 2", IE), ("sure < 2", IE), ("hit > 0", FAIL)), failed("hit"), f"{SURE} AND ({GAP} OR {H1GAP})", evidence=("stable", "sure")),
])


def _typed(*names):
    return "(" + " OR ".join(f"(',' || schema_types || ',') LIKE '%,{name},%'" for name in names) + ")"


LISTED = f"regexp_matches({PATH}, '(^|/)[0-9]{{4}}(/|$)')"


def _family_sql(check_id, page_type, typed, fallback):
    scope = f"{OK} AND page_type = '{page_type}' AND NOT {LISTED}"
    sure = f"(page_type_confidence = 'high' OR {typed} OR {fallback})"
    hit = f"{scope} AND indexable = 1 AND {sure} AND NOT {typed}"
    measures = {"scope": f"{scope} AND indexable = 1", "unknown": f"{scope} AND indexable IS NULL", "unsure": f"{scope} AND indexable = 1 AND NOT {sure}", "hit": hit}
    return check(check_id, "site_pages", measures, state_case(("hit = 0 AND unsure + unknown > 0", IE), ("scope = 0", NF), ("hit > 0", FAIL)), failed("hit"), hit, evidence=("scope", "unsure", "unknown"))


ARTICLE = _typed("Article", "BlogPosting")
ARTICLE_FALLBACK = "(text_facts = 1 AND regexp_matches(lower(url), '/(beitrag|post|posts|article|articles|artikel)/'))"
CRUMBS = (f"({HTML} AND page_type NOT IN ('homepage', 'blog_index', 'article_index', 'product_index', 'category_index', 'legal', 'contact') AND "
          "(page_type IN ('article', 'product', 'category', 'location') OR depth > 1))")
CRUMB = _typed("BreadcrumbList")


def _faq(check_id):
    hit = f"has_faq = 1 AND NOT {_typed('FAQPage')}"
    return check(check_id, "site_pages", {"scope": "has_faq = 1", "weak": "has_faq = 0 AND has_weak_faq = 1", "hit": hit},
                 state_case(("scope = 0 AND weak > 0", IE), ("scope = 0", NF), ("hit > 0", FAIL)), failed("hit"), hit, evidence=("scope", "weak"))


QUERIES["checks_structured_data_pages"] = _family(page_checks.structured_data_page_checks)
ORACLE["checks_structured_data_pages"] = union([
    _family_sql("tech.article_coverage_on_article_like_pages", "article", ARTICLE, ARTICLE_FALLBACK),
    _family_sql("tech.product_coverage_on_product_like_pages", "product", _typed("Product"), "false"),
    _family_sql("geo.article_blog_pages_article_schema", "article", ARTICLE, ARTICLE_FALLBACK),
    issue("tech.breadcrumb_missing_low_coverage", f"{CRUMBS} AND NOT {CRUMB}", scope=CRUMBS, evidence=("scope",)),
    check("geo.breadcrumblist_present", "site_pages", {"signal": f"{CRUMBS} AND {CRUMB}", "scope": CRUMBS, "missing": f"{CRUMBS} AND NOT {CRUMB}"},
          state_case(("scope = 0", IE), ("signal = 0", FAIL)), failed("missing"), f"{CRUMBS} AND NOT {CRUMB}"),
    _faq("tech.faqpage_missing_low_coverage"),
    _faq("geo.faq_html_present_schema_missing"),
    issue("tech.videoobject_schema_present_missing", f"has_video = 1 AND NOT {_typed('VideoObject')}", scope="has_video = 1"),
])

ARTICLE_PAGE = f"({HTML} AND coalesce(page_type, 'other') = 'article')"


def _signal(check_id, column):
    hit = f"{ARTICLE_PAGE} AND {column} = 0"
    return check(check_id, "site_pages", {"scope": ARTICLE_PAGE, "open": f"{ARTICLE_PAGE} AND text_facts = 0", "hit": hit},
                 state_case(("scope > 0 AND open > 0", IE), ("scope = 0", NF), ("hit > 0", FAIL)), failed("hit"), hit)


TOPICAL = f"{HTML} AND regexp_matches(lower(concat(coalesce(url, ''), ' ', coalesce(title, ''))), '{'|'.join(page_checks.TOPIC_WORDS)}')"
QUERIES["checks_content_and_trust"] = _family(page_checks.content_signal_checks)
ORACLE["checks_content_and_trust"] = union([
    check("geo.tables_present", "site_pages", {"html": HTML, "tables": "has_tables = 1"}, state_case(("html = 0 OR tables = 0", IE)), "0", None, evidence=("html", "tables")),
    check("geo.bulletpoints_lists_present", "site_pages", {"html": HTML, "lists": "has_lists = 1"}, state_case(("html = 0", IE), ("lists = 0", FAIL)), failed("html"), None, evidence=("html", "lists")),
    _signal("geo.visible_dates_present", "has_date"),
    _signal("geo.author_hints_present", "has_author"),
    check("geo.source_or_external_links_present", "site_pages", {"signal": f"{ARTICLE_PAGE} AND source_links > 0", "scope": ARTICLE_PAGE, "missing": f"{ARTICLE_PAGE} AND source_links = 0"},
          state_case(("scope = 0", NF), ("signal = 0", FAIL)), failed("missing"), f"{ARTICLE_PAGE} AND source_links = 0"),
    check("trust.eeat_signal_summary", "site_pages", {"html": HTML, "open": f"{ARTICLE_PAGE} AND text_facts = 0", "hit": f"{ARTICLE_PAGE} AND has_author = 0 AND source_links = 0",
          "schema": f"{HTML} AND {_typed('Organization', 'LocalBusiness', 'Person')}"},
          state_case(("html = 0", IE), ("open > 0", IE), ("hit > 0", FAIL)), failed("hit"), f"{ARTICLE_PAGE} AND has_author = 0 AND source_links = 0", evidence=("schema",)),
    issue("trust.ymyl_review_signal", TOPICAL),
    check("geo.low_structured_sections", "site_pages", {"hit": "low_structure = 1", "open": "low_structure = 1 AND text_facts = 0"}, state_case(("open > 0", IE), ("hit > 0", FAIL)), failed("hit"), "low_structure = 1"),
])

ORACLE = {name: with_views(text) for name, text in ORACLE.items()}
