"""Link graph operators: target facts, status checks, orphans, per-page aggregates, navigation links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.config import (
    STATE_FAIL,
    STATE_INSUFFICIENT,
    STATE_NOT_APPLICABLE,
    STATE_NOT_EXECUTED,
    STATE_TECHNICAL,
)
from sitewright.functions import http
from sitewright.functions import url as U
from sitewright.operators import scopes as S
from sitewright.operators.predicates import Check, _fail_count, evaluate_checks, flag_off, has, ladder

c = F.col
CRAWL = "Crawling & Indexing"


def target_facts(pages: DataFrame, queue: DataFrame) -> DataFrame:
    """What is known of every URL, keyed by (run, normalised URL): page facts with the queue state beside them."""
    page_side = pages.select(
        "run_id", "normalized_url", F.col("status_code").alias("target_status"), F.col("initial_status_code").alias("target_initial_status"),
        F.col("content_type").alias("target_content_type"), "attempts",
    )
    queue_side = queue.select("run_id", "normalized_url", F.col("status").alias("queue_status"), F.col("last_error_type").alias("queue_error"))
    return page_side.join(queue_side, ["run_id", "normalized_url"], "full_outer")


def links_with_targets(links: DataFrame, pages: DataFrame, queue: DataFrame) -> DataFrame:
    """Targets of internal links with their occurrences and facts.

    Navigation makes a few targets very popular. The facts depend on the target alone, so occurrences are summed up for each
    target, in part before the shuffle, and what joins is one row for each of them.
    """
    counts = (
        links.where(c("link_type") == "internal")
        .groupBy("run_id", F.col("normalized_target_url").alias("normalized_url"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )
    return counts.join(target_facts(pages, queue), ["run_id", "normalized_url"], "left")


def hydrate_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Copy status and redirect facts of the target page onto links that were written exactly as requested."""
    facts = pages.select(
        "run_id", F.col("normalized_url").alias("normalized_target_url"), F.col("url").alias("requested_url"), "initial_status_code",
        F.col("status_code").alias("final_status_code"), "final_url",
    )
    joined = links.join(facts, ["run_id", "normalized_target_url"], "left")
    same = U.normalize(c("target_url"), keep_trailing_slash=True) == U.normalize(c("requested_url"), keep_trailing_slash=True)
    keep = (c("link_type") == "internal") & F.coalesce(same, F.lit(False))
    columns = {name: F.when(keep, c(name)) for name in ("initial_status_code", "final_status_code", "final_url")}
    return joined.withColumns(columns).drop("requested_url")


def status_checks(links: DataFrame, pages: DataFrame, queue: DataFrame, runs: DataFrame) -> DataFrame:
    """Links to redirects and links to errors: occurrences, distinct targets and the priority by volume."""
    rows = links_with_targets(links, pages, queue).where(U.is_likely_page(c("normalized_url")))
    stable = http.stability(c("attempts"))
    redirect = S.between(c("target_initial_status"), 300, 400)
    error = S.between(c("target_status"), 400, 600) & ~c("target_status").isin(408, 429)
    broken = error & ((c("target_status") < 500) | (stable == "confirmed"))
    open_error = c("target_status").isNull() | c("target_status").isin(408, 429) | ((c("target_status") >= 500) & (stable != "confirmed"))
    rows = rows.select(
        "run_id", "normalized_url", "occurrences",
        F.coalesce(redirect, F.lit(False)).alias("to_redirect"), c("target_initial_status").isNull().alias("redirect_open"),
        F.coalesce(broken, F.lit(False)).alias("to_error"), F.coalesce(open_error, F.lit(True)).alias("error_open"),
        (c("queue_status") == "failed").alias("failed"),
    )
    # Per target first: distinct targets become plain sums and the popular ones are reduced before the run level.
    weigh = lambda condition: F.sum(F.when(condition, c("occurrences")).otherwise(F.lit(0)))
    per_target = rows.groupBy("run_id", "normalized_url").agg(
        weigh(c("to_redirect")).alias("redirects"), weigh(c("redirect_open")).alias("redirects_open"),
        weigh(c("to_error")).alias("errors"), weigh(c("error_open")).alias("errors_open"),
        weigh(c("redirect_open") & c("failed")).alias("redirects_failed"), weigh(c("error_open") & c("failed")).alias("errors_failed"),
    )
    total = per_target.groupBy("run_id").agg(
        *[F.sum(name).alias(name) for name in ("redirects", "redirects_open", "errors", "errors_open", "redirects_failed", "errors_failed")],
        F.count_if(c("redirects") > 0).alias("redirect_targets"), F.count_if(c("errors") > 0).alias("error_targets"),
    )
    joined = runs.join(total, "run_id", "left").na.fill(0)

    def result(check_id: str, hit: str, open_name: str, failed: str, targets: str, status: str, priority: Column) -> Column:
        state = (
            F.when(c("store_all_links") == 0, STATE_NOT_EXECUTED).when(c(hit) > 0, STATE_FAIL)
            .when((c(open_name) > 0) & (c(failed) > 0), STATE_TECHNICAL).when(c(open_name) > 0, STATE_INSUFFICIENT).otherwise("pass")
        )
        return F.struct(
            F.lit(check_id).alias("check_id"), state.alias("evaluation_state"),
            F.when(state == "pass", "OK").when(state == STATE_FAIL, status).otherwise("NA").alias("status"), priority.alias("priority"),
            F.when(state == STATE_FAIL, c(hit)).otherwise(F.lit(0)).cast("bigint").alias("affected_count"),
            F.when(state == STATE_FAIL, c(targets)).otherwise(F.lit(0)).cast("bigint").alias("unique_targets"),
        )

    high = F.when((c("errors") > 0) & (c("error_targets") < 3) & (c("errors") < 10), "Medium").otherwise("High")
    results = joined.select(
        "run_id",
        F.inline(
            F.array(
                result("tech.internal_links_to_3xx", "redirects", "redirects_open", "redirects_failed", "redirect_targets", "Warning", F.lit("Medium")),
                result("tech.internal_links_to_4xx_5xx", "errors", "errors_open", "errors_failed", "error_targets", "Error", high),
            )
        ),
    )
    return results


def orphan_pages(pages: DataFrame, queue: DataFrame, links: DataFrame) -> DataFrame:
    """Pages that a sitemap lists and no internal link reaches."""
    listed = queue.where(c("source_type").startswith("sitemap") | c("source_type").startswith("robots_sitemap")).select("run_id", "normalized_url")
    linked = links.where(c("link_type") == "internal").select("run_id", F.col("normalized_target_url").alias("normalized_url")).distinct()
    return pages.join(listed, ["run_id", "normalized_url"]).join(linked, ["run_id", "normalized_url"], "left_anti")


def link_aggregates(links: DataFrame, sample_size: int = 20) -> DataFrame:
    """Per page: internal and external counts, distinct targets, nofollow and image links, first sample targets.

    Equal targets of a page are merged first, so distinct counts are plain sums and no task collects a whole page.
    """
    edges = links.groupBy("run_id", "source_url", "link_type", F.col("normalized_target_url").alias("target")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.lower(c("rel")).rlike(r"\bnofollow\b")).alias("nofollow")
    )
    external = c("link_type") == "external"
    is_image = F.lower(c("target")).rlike(r"\.(png|jpe?g|webp|gif|svg)([?#]|$)")
    weigh = lambda condition: F.sum(F.when(condition, c("n")).otherwise(F.lit(0)))
    totals = edges.groupBy("run_id", "source_url").agg(
        weigh(~external).alias("internal_links"), weigh(external).alias("external_links"),
        F.count_if(~external).alias("internal_targets"), F.count_if(external).alias("external_targets"),
        F.sum("nofollow").alias("nofollow_links"), weigh(is_image).alias("image_links"),
    )
    window = Window.partitionBy("run_id", "source_url").orderBy("target", "link_type")
    heads = (
        edges.withColumn("position", F.row_number().over(window))
        .where(c("position") <= sample_size)
        .groupBy("run_id", "source_url")
        .agg(F.array_sort(F.collect_list("target")).alias("samples"))
    )
    return totals.join(heads, ["run_id", "source_url"])


def inlinks(links: DataFrame, first: int = 5) -> DataFrame:
    """In-link count of every target with its first sources; sources are reduced before they are ranked."""
    edges = links.where(c("link_type") == "internal").groupBy("run_id", "normalized_target_url", "source_url").agg(F.count(F.lit(1)).alias("n"))
    totals = edges.groupBy("run_id", "normalized_target_url").agg(F.sum("n").alias("inlink_count"))
    ranked = edges.withColumn(
        "position", F.row_number().over(Window.partitionBy("run_id", "normalized_target_url").orderBy("source_url"))
    ).where(c("position") <= first)
    heads = ranked.groupBy("run_id", "normalized_target_url").agg(F.array_sort(F.collect_list("source_url")).alias("first_sources"))
    return totals.join(heads, ["run_id", "normalized_target_url"])


# fixed values: words that mark trust links in a target or an anchor
NAVIGATION = {
    "geo.impressum_linked": ("impressum", "legal notice"),
    "geo.datenschutz_linked": ("datenschutz", "privacy"),
    "geo.contact_linked": ("contact", "kontakt"),
}
ABOUT_PATH = r"(^|/)(about|about-us|ueber|ueber-uns|über-uns|ueber-mich|über-mich|unternehmen|company|team)(/|$)"
ABOUT_LABELS = (
    "about", "about us", "ueber", "ueber uns", "über uns", "ueber mich", "über mich", "unternehmen", "company", "team",
    "das team",
)


def about_link() -> Column:
    address = F.regexp_replace(F.lower(F.coalesce(F.try_url_decode(U.path(c("target_url"))), U.path(c("target_url")))), "/+$", "")
    label = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c("anchor_text")), r"\s+", " "), "[|:;,.!?]+$", ""))
    return address.rlike(ABOUT_PATH) | label.isin(*ABOUT_LABELS)


def navigation_checks(links: DataFrame, pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Impressum, privacy, about and contact links; cut link rows or rendered-only links block a missing verdict."""
    internal = c("link_type") == "internal"
    words = F.concat_ws("\n", F.lower(c("target_url")), F.lower(c("anchor_text")))
    hits = {name: internal & words.rlike("|".join(needles)) for name, needles in NAVIGATION.items()}
    hits["geo.about_linked"] = internal & about_link()
    found = links.groupBy("run_id").agg(*[F.count_if(F.coalesce(hit, F.lit(False))).alias(name.split(".")[1]) for name, hit in hits.items()])
    page_counts = pages.groupBy("run_id").agg(
        F.count_if(F.coalesce(S.is_html(), F.lit(False))).alias("html"),
        F.count_if(c("links_truncated") == 1).alias("cut"),
        F.count_if((c("render_status") == "success") & (F.coalesce(c("rendered_links"), F.lit(0)) > F.coalesce(c("internal_links"), F.lit(0)))).alias("rendered_only"),
    )
    joined = runs.join(page_counts, "run_id", "left").join(found, "run_id", "left").na.fill(0)

    def result(check_id: str) -> Column:
        name = check_id.split(".")[1]
        state = (
            F.when(c("store_all_links") == 0, STATE_NOT_EXECUTED).when(c("html") == 0, STATE_INSUFFICIENT)
            .when(c(name) > 0, "pass").when((c("cut") > 0) | (c("rendered_only") > 0), STATE_INSUFFICIENT).otherwise(STATE_FAIL)
        )
        return F.struct(
            F.lit(check_id).alias("check_id"), state.alias("evaluation_state"),
            F.when(state == "pass", "OK").when(state == STATE_FAIL, "Warning").otherwise("NA").alias("status"),
            F.when(state == STATE_FAIL, 1).otherwise(0).cast("bigint").alias("affected_count"), c(name).cast("bigint").alias("matches"),
        )

    return joined.select("run_id", F.inline(F.array(*[result(name) for name in hits])))


def trust_links(links: DataFrame) -> DataFrame:
    """Trust signals that the internal links of a run show."""
    text = F.lower(F.concat_ws(" ", F.coalesce(c("target_url"), F.lit("")), F.coalesce(c("anchor_text"), F.lit(""))))
    signals = {
        "impressum": "impressum|legal notice",
        "privacy": "datenschutz|privacy",
        "about_company": r"(^|[/\s-])(about|about-us|ueber|über|unternehmen|company|team)([/\s-]|$)",
        "contact": "kontakt|contact",
    }
    flags = [F.bool_or(text.rlike(pattern)).alias(name) for name, pattern in signals.items()]
    found = links.where(c("link_type") == "internal").groupBy("run_id").agg(*flags)
    names = F.array_compact(F.array(*[F.when(c(name), F.lit(name)) for name in signals]))
    return found.select("run_id", names.alias("trust_links"))


def orphan_check(pages: DataFrame, queue: DataFrame, links: DataFrame, runs: DataFrame, discovery: DataFrame) -> DataFrame:
    """Orphan verdict per run; ``discovery`` says how many sitemap URLs were planned and whether discovery ended."""
    orphans = orphan_pages(pages, queue, links).select("run_id", "url", F.lit(True).alias("orphan"))
    from_sitemap = c("source_type").startswith("sitemap") | c("source_type").startswith("robots_sitemap")
    processed = queue.groupBy("run_id").agg(F.count_if(from_sitemap & (c("status") == "done")).alias("processed"))
    extended = runs.join(discovery, "run_id", "left").join(processed, "run_id", "left").na.fill(0, ["planned", "discovery_complete", "processed"])
    complete = (c("discovery_complete") == 1) & (c("processed") >= c("planned"))
    state = ladder(
        (flag_off("store_all_links"), STATE_NOT_EXECUTED),
        (lambda m: m.run("planned") == 0, STATE_NOT_APPLICABLE),
        (lambda m: ~complete, STATE_INSUFFICIENT),
        (has("hit"), STATE_FAIL),
    )
    check = Check("tech.orphan_like_sitemap_urls", CRAWL, {"hit": c("orphan")}, state, _fail_count(state, "hit"), sample="hit", priority="Low", score_eligible=False, evidence=("hit",))
    return evaluate_checks(orphans, extended, [check])


def sitemap_status_check(pages: DataFrame, queue: DataFrame, runs: DataFrame, discovery: DataFrame) -> DataFrame:
    """Listed URLs that do not answer 200 directly; inconclusive answers are kept apart."""
    listed = queue.where(c("source_type").startswith("sitemap") | c("source_type").startswith("robots_sitemap"))
    facts = pages.select("run_id", "normalized_url", "status_code", "initial_status_code", "attempts")
    rows = listed.select("run_id", "url", "normalized_url", F.col("status").alias("queue_status")).join(facts, ["run_id", "normalized_url"], "left")
    status, first = c("status_code"), c("initial_status_code")
    inconclusive = F.coalesce(status.isin(408, 429) | ((status >= 500) & (http.stability(c("attempts")) != "confirmed")), F.lit(False))
    missing = status.isNull() | first.isNull() | inconclusive
    hit = ~inconclusive & ~(F.coalesce(first, status).eqNullSafe(200) & status.eqNullSafe(200))
    extended = runs.join(discovery, "run_id", "left").na.fill(0, ["planned", "discovery_complete"])
    state = ladder(
        (lambda m: (m.rows == 0) & (m.run("planned") > 0), STATE_NOT_EXECUTED),
        (lambda m: m.rows == 0, STATE_NOT_APPLICABLE),
        (lambda m: (m["hit"] == 0) & ((m.run("discovery_complete") == 0) | (m.rows - m["missing"] < m.run("planned"))) & (m["failed"] > 0), STATE_TECHNICAL),
        (lambda m: (m["hit"] == 0) & ((m.run("discovery_complete") == 0) | (m.rows - m["missing"] < m.run("planned"))), STATE_INSUFFICIENT),
        (has("hit"), STATE_FAIL),
    )
    measures = {"hit": hit, "missing": missing, "inconclusive": inconclusive, "failed": missing & (c("queue_status") == "failed")}
    check = Check("tech.sitemap_urls_non_200", CRAWL, measures, state, _fail_count(state, "hit"), sample="hit", evidence=("missing", "inconclusive"))
    return evaluate_checks(rows, extended, [check], repeated=True)


