"""Small relations around runs, pages and findings: schedules, reach, report signals, representatives, detail joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
SIGNALS = ("has_faq", "has_tables", "has_lists", "has_date", "has_author", "has_video", "source_links")


def schedule_summary(runs: DataFrame) -> DataFrame:
    """Runs of every schedule by outcome, and its latest completed run."""
    done = c("status") == "completed"
    return runs.groupBy("schedule_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(done).alias("completed"), F.count_if(c("status").isin("running", "queued", "paused")).alias("active"), F.count_if(c("status") == "failed").alias("failed"),
        F.max_by(F.when(done, c("run_id")), F.when(done, F.struct("finished_at", "run_id"))).alias("latest_run"),
    )


def runs_with_projects(runs: DataFrame, projects: DataFrame, schedules: DataFrame) -> DataFrame:
    """Runs of known projects with the facts of their project and, if any, their schedule."""
    return runs.join(projects, "project_id").join(schedules, "schedule_id", "left")


def reach_by_page_type(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Pages of every type in a run, and those on which at least one active finding lies. ``findings`` has run_id and url."""
    hit = findings.select("run_id", "url").distinct().withColumn("hit", F.lit(1))
    kind = F.coalesce(c("page_type"), F.lit("other"))
    return pages.join(hit, ["run_id", "url"], "left").groupBy("run_id", kind.alias("page_type")).agg(F.count(F.lit(1)).alias("pages"), F.count("hit").alias("affected_pages"))


def content_signals(pages: DataFrame) -> DataFrame:
    """Seven content signals of a run in one row."""
    return pages.groupBy("run_id").agg(*[F.count_if(F.coalesce(c(name), F.lit(0)) > 0).alias(name) for name in SIGNALS])


def page_outcomes(pages: DataFrame) -> DataFrame:
    """Pages of a run by class of status, and indexable ones."""
    status = c("status_code")
    return pages.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if((status >= 200) & (status < 300)).alias("ok"), F.count_if((status >= 300) & (status < 400)).alias("redirected"), F.count_if(status >= 400).alias("failing"),
        F.count_if(c("indexable") == 1).alias("indexable"),
    )


def representatives(pages: DataFrame, most: int = 5) -> DataFrame:
    """The first page of each page type, at most ``most`` of a run, and the first page with a query."""
    kind = F.coalesce(c("page_type"), F.lit("other"))
    first = pages.groupBy("run_id", kind.alias("kind")).agg(F.min(F.struct("page_id", "url")).alias("first")).select("run_id", "kind", "first.page_id", "first.url")
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("page_id"))
    chosen = first.withColumn("place", place).where(c("place") <= most).drop("place")
    queried = pages.where(F.contains("url", F.lit("?"))).groupBy("run_id").agg(F.min(F.struct("page_id", "url")).alias("first")).select("run_id", F.lit("with_query").alias("kind"), "first.page_id", "first.url")
    return chosen.unionByName(queried)


def targeted_urls(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """URLs for a targeted job from several sources, each URL of a run once, named by the first source that has it."""
    parts = [rows.select("run_id", "url", F.lit(rank).alias("rank"), F.lit(name).alias("source")) for rank, (name, rows) in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, parts).where(F.coalesce("url", F.lit("")) != "")
    return rows.groupBy("run_id", "url").agg(F.min_by("source", "rank").alias("source"))


def review_sample(pages: DataFrame, ranks: dict[str, int], limit: int) -> DataFrame:
    """Pages for an outside review: indexable ones first, then by rank of their type, then by id; with a hash of what is shown."""
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    rank = F.coalesce(F.try_element_at(table, F.coalesce(c("page_type"), F.lit("other"))), F.lit(len(ranks)))
    order = Window.partitionBy("run_id").orderBy(F.desc(F.coalesce(c("indexable"), F.lit(0))), rank, "page_id")
    shown = F.concat_ws("|", "url", F.coalesce("title", F.lit("")), F.coalesce("meta_description", F.lit("")))
    return pages.withColumn("place", F.row_number().over(order)).where(c("place") <= limit).select("run_id", "page_id", "url", c("place").cast("bigint").alias("place"), F.sha2(shown, 256).alias("input_hash"))


def sample_details(samples: DataFrame, lab: DataFrame, browser: DataFrame, device: str) -> DataFrame:
    """Sampled pages with their lab measurement on a device and their browser run, where there are such."""
    measured = lab.where(c("device") == device).select("run_id", "page_id", "performance_score", "lcp_ms", "tbt_ms", "error_message")
    seen = browser.select("run_id", "page_id", c("status").alias("browser_status"), "js_required", "console_errors")
    return samples.select("run_id", "cluster_key", "page_id", "url").join(measured, ["run_id", "page_id"], "left").join(seen, ["run_id", "page_id"], "left")


def render_details(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """Detail rows with the render decision and settling state of their page."""
    facts = metrics.select("run_id", "page_id", "render_decision", "settling_status", "browser_run")
    return rows.join(facts, ["run_id", "page_id"], "left")


# fixed values: checks that need facts of a live crawl
LIVE_CHECKS = (
    "tech.https_reachable",
    "tech.http_to_https_redirect",
    "tech.www_non_www_consistency",
    "tech.robots_txt_present",
    "tech.sitemap_present",
    "tech.sitemap_in_robots",
    "geo.llms_txt_present",
    "geo.llms_txt_http_status",
    "geo.llms_full_txt_present",
    "geo.robots_blocks_txt_files",
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
    "geo.markdown_twin_homepage",
)


def import_aware(results: DataFrame, runs: DataFrame, live_checks: tuple[str, ...] = LIVE_CHECKS) -> DataFrame:
    """Results in which checks that need a live crawl are not executed for imported runs."""
    origin = runs.select("run_id", "source_type")
    skip = F.coalesce(c("source_type") == "import", F.lit(False)) & c("check_id").isin(*live_checks)
    joined = results.join(origin, "run_id", "left")
    changes: dict[str, Column] = {
        "evaluation_state": F.when(skip, F.lit("not_executed")).otherwise(c("evaluation_state")),
        "status": F.when(skip, F.lit("NA")).otherwise(c("status")),
        "affected_count": F.when(skip, F.lit(0)).otherwise(c("affected_count")).cast("bigint"),
    }
    return joined.withColumns(changes).drop("source_type")
