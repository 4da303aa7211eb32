"""Render planning, settling of snapshots, browser events, run metrics and cost models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.functions import url as U
from sitewright.operators.percentiles import percentiles
from sitewright.operators import scopes as S

c = F.col
# fixed values: weights and limits of the render gate
CONTENT_TYPES = ("homepage", "article", "product", "category", "service", "location", "blog_index")
UTILITY_TYPES = ("legal", "search", "filter", "utility")
WEIGHTS = {
    "near_empty_document": 6, "thin_primary_document": 4, "missing_title": 3, "missing_canonical": 2, "missing_html_language": 1, "missing_primary_heading": 1, "low_internal_links": 1,
    "executable_structure_corroboration": 1, "substantial_main_content": -4, "substantial_visible_content": -4, "primary_heading_present": -2, "critical_metadata_complete": -2,
    "useful_internal_links_present": -1, "relevant_structured_data_present": -1, "complete_utility_document": -8, "non_indexable_document": -8,
}
RECOMMEND_AT = 4
STABLE_SNAPSHOTS, MINIMUM_OBSERVATION_MS = 3, 4000
# fixed values: bytes a stored page and its optional parts take
PAGE_BYTES = 1400
STORED_BYTES = {"store_all_links": 450, "store_all_images": 1800, "store_all_resources": 2600, "store_headers": 500}


def _facts() -> dict[str, Column]:
    visible, main = F.coalesce(c("word_count_raw"), F.lit(0)), F.coalesce(c("raw_main_words"), F.lit(0))
    present = F.coalesce(c("main_regions"), F.lit(0)) > 0
    indexable = F.coalesce(c("indexable"), F.lit(1)) == 1
    return {
        "visible": visible, "main": main, "main_present": present, "comparable": F.when(present, main).otherwise(visible), "h1": F.coalesce(c("h1_count"), F.lit(0)), "links": F.coalesce(c("internal_links"), F.lit(0)), "is_indexable": indexable,
        "content": indexable & S.page_type().isin(*CONTENT_TYPES), "scripted": (c("script_count") >= 1) | (c("hydration_bytes") > 0), "has_title": ~S.blank(c("title")), "has_canonical": F.size(F.coalesce(c("canonical_values"), F.array())) > 0, "has_lang": ~S.blank(c("html_lang")),
    }


def render_need(pages: DataFrame) -> DataFrame:
    """Decision, confidence, score and strength of the current gate for every page."""
    rows = U.computed_once(pages, _facts())
    utility = S.page_type().isin(*UTILITY_TYPES) & c("has_title") & (c("h1") > 0) & (c("comparable") >= 15)
    unknown = c("is_indexable") & (S.page_type() == "other") & (c("comparable") <= 49) & (c("h1") == 0) & c("scripted")
    shell = (c("content") | unknown) & (c("comparable") <= 49) & (c("visible") <= 99) & ((c("h1") == 0) | (c("links") < 3))
    no_main = c("content") & c("main_present") & (c("main") < 30)
    gap = c("content") & (c("comparable") <= 49) & (c("h1") == 0)
    empty = (c("visible") <= 14) & (c("comparable") <= 14) & (c("h1") == 0)
    thin = c("content") & (c("comparable") <= 49) & (c("visible") <= 99) & (c("h1") > 0) & (c("links") >= 2)
    rows = U.computed_once(rows, {"shell": shell, "no_main": no_main, "gap": gap, "empty": empty, "thin": thin})
    toward = {
        "near_empty_document": c("empty"), "thin_primary_document": c("thin"), "missing_title": c("is_indexable") & ~c("has_title"), "missing_canonical": c("is_indexable") & ~c("has_canonical"),
        "missing_html_language": c("is_indexable") & ~c("has_lang"), "missing_primary_heading": c("is_indexable") & (c("h1") == 0), "low_internal_links": c("content") & (c("links") < 2),
    }
    against = {
        "substantial_main_content": c("main_present") & (c("main") >= 100), "substantial_visible_content": c("visible") >= 100, "primary_heading_present": c("h1") > 0,
        "critical_metadata_complete": c("has_title") & c("has_canonical") & c("has_lang"), "useful_internal_links_present": c("links") >= 2, "relevant_structured_data_present": F.size("schema_types") > 0,
        "complete_utility_document": utility, "non_indexable_document": ~c("is_indexable"),
    }
    weigh = lambda table: sum((F.when(condition, F.lit(WEIGHTS[name])).otherwise(F.lit(0)) for name, condition in table.items()), F.lit(0))
    names = lambda table: F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in table.items()]))
    rows = U.computed_once(rows, {"plus": weigh(toward)})
    corroborated = c("scripted") & (c("plus") > 0)
    rows = U.computed_once(rows, {"score": c("plus") + F.when(corroborated, 1).otherwise(0) + weigh(against), "signals": names(toward), "negative_signals": names(against)})
    hard = c("shell").cast("int") + c("no_main").cast("int") + c("gap").cast("int")
    by_check = (c("empty") | c("thin")) & c("scripted")
    decision = F.when((hard > 0) | by_check, "render_required").when(c("score") >= RECOMMEND_AT, "render_recommended").otherwise("render_not_required")
    rows = U.computed_once(rows, {"hard": hard, "decision": decision})
    strength = F.when(c("decision") == "render_required", 300 + F.greatest(F.lit(0), 100 - c("comparable")) + c("hard") * 10).when(c("decision") == "render_recommended", 200 + c("score")).otherwise(100 - c("score"))
    confidence = F.when(c("decision") == "render_required", "high").when((c("decision") == "render_not_required") & (c("score") <= 0), "high").otherwise("medium")
    raw_class = F.when(c("comparable") == 0, "empty").when(c("comparable") < 50, "thin").when(c("comparable") < 100, "moderate").otherwise("substantial")
    return rows.select("run_id", "page_id", "url", S.page_type().alias("page_type"), *[name for name in ("cluster_key", "status_code", "initial_status_code", "content_type") if name in pages.columns], "decision", confidence.alias("confidence"), "score", strength.alias("strength"), "signals", "negative_signals", raw_class.alias("raw_class"))


def render_need_v1(pages: DataFrame) -> DataFrame:
    """Decision of the first gate version."""
    rows = U.computed_once(pages, _facts())
    unknown = c("is_indexable") & (S.page_type() == "other") & (c("comparable") < 50) & (c("h1") == 0) & c("scripted")
    utility = S.page_type().isin(*UTILITY_TYPES) & c("has_title") & (c("h1") > 0) & (c("comparable") >= 15)
    hard = ((c("content") | unknown) & (c("comparable") < 50) & (c("visible") < 100) & ((c("h1") == 0) | (c("links") < 3))) | (c("content") & c("main_present") & (c("main") < 30)) | (c("content") & (c("comparable") < 50) & (c("h1") == 0))
    full = (c("comparable") >= 100) & (c("h1") > 0) & c("has_title")
    missing = sum((F.when(flag, 0).otherwise(1) for flag in (c("has_title"), ~S.blank(c("meta_description")), c("has_canonical"), c("has_lang"))), F.lit(0))
    few = c("content") & (c("links") < 2)
    rows = U.computed_once(rows, {"missing": missing, "few": few})
    decision = F.when(hard, "render_required").when(utility, "render_not_required").when(full & (c("missing") == 0), "render_not_required").otherwise("render_recommended")
    strength = (
        F.when(hard, 300 + F.greatest(F.lit(0), 100 - c("comparable")) + c("missing") * 8 + F.when(c("few"), 5).otherwise(0)).when(utility | (full & (c("missing") == 0)), 0)
        .when((c("is_indexable") & (c("missing") > 0)) | (c("h1") == 0) | c("few"), 200 + c("missing") * 8 + F.when(c("h1") == 0, 10).otherwise(0) + F.when(c("few"), 5).otherwise(0)).otherwise(190)
    )
    return rows.select("run_id", "page_id", decision.alias("decision"), strength.alias("strength"))


def confirm_minimum(classified: DataFrame, minimum: int = 2) -> DataFrame:
    """Promote pages so that a run with one required page gets a second measurement, new templates first.

    At most ``minimum - 1`` pages of a run are promoted, so the best candidate per run is enough: a bounded ranking.
    """
    usable = S.between(F.coalesce(c("status_code"), F.lit(200)), 200, 300) & S.between(F.coalesce(c("initial_status_code"), c("status_code"), F.lit(200)), 200, 300) & F.coalesce(F.lower(c("content_type")).contains("html"), F.lit(True))
    planned = classified.where(usable & (c("decision") != "render_not_required")).groupBy("run_id").agg(F.count(F.lit(1)).alias("planned"), F.count_if(c("decision") == "render_required").alias("required"))
    short = planned.where((c("required") > 0) & (c("planned") < minimum))
    taken = classified.where(usable & (c("decision") != "render_not_required")).select("run_id", "cluster_key").distinct().withColumn("taken", F.lit(1))
    candidates = classified.where(usable & (c("decision") == "render_not_required")).join(short, "run_id").join(taken, ["run_id", "cluster_key"], "left")
    order = Window.partitionBy("run_id").orderBy(F.coalesce(c("taken"), F.lit(0)), "url")
    chosen = candidates.withColumn("position", F.row_number().over(order)).where(c("position") <= minimum - 1).select("run_id", "page_id", F.lit(True).alias("promoted"))
    joined = classified.join(chosen, ["run_id", "page_id"], "left")
    promoted = F.coalesce(c("promoted"), F.lit(False))
    return joined.withColumns({"decision": F.when(promoted, "render_recommended").otherwise(c("decision")), "strength": F.when(promoted, F.greatest(F.lit(180), c("strength"))).otherwise(c("strength")), "promoted": promoted})


def render_plan(classified: DataFrame, max_pages: int, render_ms: int = 5000, max_ms: int | None = None, page_bytes: int = 30000, max_bytes: int | None = None) -> DataFrame:
    """Pages to render under a budget: need first, then fresh templates, then strength, then URL.

    Every render costs the same, so all three limits reduce to one page count. The order inside a template matters for
    its first three pages only, and the plan needs the first ``limit`` pages of a run: both are bounded rankings.
    """
    limits = [max_pages] + ([max_ms // render_ms] if max_ms is not None else []) + ([max_bytes // page_bytes] if max_bytes is not None else [])
    limit = min(limits)
    template = F.coalesce(c("cluster_key"), F.concat(F.lit("url:"), c("url")))
    first = classified.select("run_id", "page_id", template.alias("template"), "url").withColumn("ordinal", F.row_number().over(Window.partitionBy("run_id", "template").orderBy("url", "page_id")) - 1).where(c("ordinal") <= 1)
    rows = classified.where(c("decision") != "render_not_required").join(first.select("run_id", "page_id", "ordinal"), ["run_id", "page_id"], "left").withColumn("ordinal", F.coalesce(c("ordinal"), F.lit(2)))
    need = F.when(c("decision") == "render_required", 3).otherwise(2)
    order = Window.partitionBy("run_id").orderBy(F.desc("need"), "ordinal", F.desc("strength"), "url", "page_id")
    return rows.withColumn("need", need).withColumn("position", F.row_number().over(order)).where(c("position") <= limit).select("run_id", "page_id", "url", "decision", "ordinal", "strength", "position")


def plan_summary(classified: DataFrame, plan: DataFrame, render_ms: int = 5000, page_bytes: int = 30000) -> DataFrame:
    wanted = classified.groupBy("run_id").agg(F.count(F.lit(1)).alias("urls"), F.count_if(c("decision") == "render_not_required").alias("not_required"))
    planned = plan.groupBy("run_id").agg(F.count(F.lit(1)).alias("planned"))
    rows = wanted.join(planned, "run_id", "left").na.fill(0)
    return rows.withColumns({"excluded": c("urls") - c("not_required") - c("planned"), "render_ms": c("planned") * render_ms, "bytes": c("planned") * page_bytes})


def template_evidence(observations: DataFrame) -> DataFrame:
    """Whether two independent comparable renders confirm that a template needs no browser."""
    comparable = c("same_page_type") & c("same_structure") & c("render_succeeded")
    counts = observations.groupBy("run_id", "cluster_key").agg(F.count_if(comparable).alias("n"), F.count_if(comparable & c("difference")).alias("bad"))
    return counts.select("run_id", "cluster_key", F.when(c("n") < 2, "insufficient_evidence").when(c("bad") > 0, "invalidated").otherwise("confirmed_raw_sufficient_template").alias("status"))


def render_cost(parameters: DataFrame) -> DataFrame:
    """Expected durations and bytes for a parameter table."""
    rendered = F.ceil(c("url_count") * F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("render_share"))))
    rows = parameters.withColumn("rendered", rendered)
    launch = F.when(c("rendered") > 0, c("launch_ms")).otherwise(0)
    total = lambda ms: launch + c("url_count") * c("fetch_ms") + F.ceil(c("rendered") / F.greatest(F.lit(1), c("concurrency"))) * ms
    return rows.withColumns(
        {"p50_ms": total(c("p50_render_ms")), "p90_ms": total(F.greatest("p50_render_ms", "p90_render_ms")), "bytes": c("rendered") * c("bytes_per_render"), "slow": (c("url_count") >= 1000) & (c("concurrency") == 1)}
    )


def settling(snapshots: DataFrame) -> DataFrame:
    """Verdict per snapshot sequence from its trailing run of equal fingerprints.

    The run ends at the last snapshot that differs from its predecessor, so one ordered pass and one aggregate do.
    """
    order = Window.partitionBy("snapshot_key").orderBy("seq")
    rows = snapshots.withColumn("changed", F.coalesce(c("fingerprint") != F.lag("fingerprint").over(order), F.lit(False)))
    totals = rows.groupBy("snapshot_key").agg(
        F.count(F.lit(1)).alias("snapshots"), F.max(F.when(c("changed"), c("seq"))).alias("last_change"), F.max("seq").alias("last_seq"), F.max("elapsed_ms").alias("elapsed"), F.max_by(F.struct("loading_indicators", "visible_words"), "seq").alias("m"),
    )
    tail = rows.join(totals.select("snapshot_key", "last_change"), "snapshot_key").where(c("last_change").isNull() | (c("seq") >= c("last_change"))).groupBy("snapshot_key").agg(F.count(F.lit(1)).alias("stable_count"))
    joined = totals.join(tail, "snapshot_key")
    stable = (c("stable_count") >= STABLE_SNAPSHOTS) & (c("elapsed") >= MINIMUM_OBSERVATION_MS) & (c("m.loading_indicators") == 0)
    status = F.when(stable & (c("m.visible_words") > 0), "settled").when(stable, "content_remained_empty").when(c("last_change").isNotNull(), "rendering_unstable").otherwise("settling_timeout")
    return joined.select("snapshot_key", "snapshots", "stable_count", status.alias("status"))


def change_timing(snapshots: DataFrame, limits: tuple[int, ...] = (1000, 2000, 3000, 4000, 5000, 6000)) -> DataFrame:
    """How many sequences still change after each limit, and how many never change."""
    start = snapshots.groupBy("snapshot_key").agg(F.min("elapsed_ms").alias("start"), F.count(F.lit(1)).alias("n")).where(c("n") >= 2)
    rows = snapshots.join(start, "snapshot_key").withColumn("age", c("elapsed_ms") - c("start")).withColumn("limit_ms", F.explode(F.array(*[F.lit(limit) for limit in limits])))
    base = rows.groupBy("snapshot_key", "limit_ms").agg(F.max_by("fingerprint", F.when(c("age") <= c("limit_ms"), c("seq"))).alias("before"), F.min(F.when(c("age") > c("limit_ms"), c("fingerprint"))).alias("lo"), F.max(F.when(c("age") > c("limit_ms"), c("fingerprint"))).alias("hi"))
    changed = F.coalesce((c("lo") != c("before")) | (c("hi") != c("before")), F.lit(False))
    return base.groupBy("limit_ms").agg(F.count(F.lit(1)).alias("measured"), F.count_if(changed).alias("changed"))


def stability_share(snapshots: DataFrame) -> DataFrame:
    keys = snapshots.groupBy("snapshot_key").agg((F.min("fingerprint") == F.max("fingerprint")).alias("steady"))
    return keys.agg(F.count(F.lit(1)).alias("measured"), F.count_if("steady").alias("steady"))


def browser_events(events: DataFrame) -> DataFrame:
    """Equal events of a page merged, with count, first and last time and impact."""
    serious = c("type").isin("pageerror", "navigation_error", "request_failed", "response_5xx", "service_worker_error")
    merged = events.groupBy("page_key", "type", "phase", "message").agg(F.count(F.lit(1)).alias("count"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), F.max("content_missing").alias("content_missing"))
    impact = F.when((c("content_missing") == 1) & serious, "content_unavailable").when(c("type") == "csp_violation", "security_policy").otherwise("diagnostic")
    return merged.withColumn("impact", impact).drop("content_missing")


def console_results(events: DataFrame) -> DataFrame:
    """Pages with relevant browser events: content loss, repeated console errors, or one seen on two pages."""
    merged = browser_events(events)
    spread = merged.where(c("type") == "console_error").groupBy("message").agg(F.count_distinct("page_key").alias("pages"))
    rows = merged.join(spread, "message", "left")
    relevant = (c("impact") == "content_unavailable") | ((c("type") == "console_error") & ((c("count") >= 2) | (c("pages") >= 2)))
    return rows.where(relevant).groupBy("page_key").agg(F.count(F.lit(1)).alias("events"), F.bool_or(c("impact") == "content_unavailable").alias("content_lost"))


def distribution(metrics: DataFrame, value: str) -> DataFrame:
    """Count, mean and percentiles of a measurement, overall and by four groupings, from one scan."""
    groupings = ("page_type", "raw_content_class", "render_decision", "settling_status")
    pairs = F.array(F.struct(F.lit("all").alias("grouping"), F.lit("").alias("value")), *[F.struct(F.lit(name).alias("grouping"), F.coalesce(c(name), F.lit("unknown")).alias("value")) for name in groupings])
    rows = metrics.select("run_id", F.col(value).alias("x"), F.explode(pairs).alias("g"))
    flat = rows.select("run_id", c("g.grouping").alias("grouping"), c("g.value").alias("value"), "x")
    keys = ["run_id", "grouping", "value"]
    totals = flat.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count("x").alias("measured"), F.round(F.avg("x"), 4).alias("mean"), F.max("x").alias("maximum"))
    shares = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    points = percentiles(flat, keys, {name: (c("x"), share) for name, share in shares.items()})
    return totals.join(points, keys, "left").select(*keys, "rows", "measured", "mean", *[F.round(name, 4).alias(name) for name in shares], "maximum")


def run_metrics(metrics: DataFrame) -> DataFrame:
    """Counters, sums and forecast inputs of a run."""
    ran = c("browser_run") == 1
    cost = F.when(ran, c("navigation_ms") + c("settling_ms"))
    totals = metrics.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("urls"), F.count_if(ran).alias("rendered"), F.count_if(~ran & (c("render_decision") == "render_not_required")).alias("avoided"), F.count_if(c("render_decision") == "render_budget_exhausted").alias("exhausted"),
        F.count_if(c("settling_status") == "settling_timeout").alias("timeouts"), F.count_if(c("settling_status") == "rendering_unstable").alias("unstable"), F.sum("fetch_ms").alias("fetch_ms"), F.sum(F.when(ran, c("provenance_bytes"))).alias("bytes"),
        F.round(F.avg(F.when(ran, c("provenance_bytes"))), 4).alias("bytes_per_render"),
    )
    points = percentiles(metrics, ["run_id"], {"p50_fetch_ms": (c("fetch_ms"), 0.5), "p50_render_ms": (cost, 0.5), "p90_render_ms": (cost, 0.9)})
    rounded = points.select("run_id", *[F.round(name, 4).alias(name) for name in ("p50_fetch_ms", "p50_render_ms", "p90_render_ms")])
    return totals.join(rounded, "run_id", "left")


def forecasts(metrics: DataFrame, sizes: tuple[int, ...] = (10, 100, 1000, 10000)) -> DataFrame:
    facts = run_metrics(metrics).select("run_id", (c("rendered") / c("urls")).alias("render_share"), c("p50_fetch_ms").alias("fetch_ms"), F.lit(0).alias("launch_ms"), "p50_render_ms", "p90_render_ms", "bytes_per_render", F.lit(1).alias("concurrency")).na.fill(0)
    return render_cost(facts.withColumn("url_count", F.explode(F.array(*[F.lit(size) for size in sizes]))))


def budget_usage(metrics: DataFrame, max_pages: int, max_ms: int) -> DataFrame:
    """Used render budget of a run and its verdict."""
    ran = c("browser_run") == 1
    used = metrics.groupBy("run_id").agg(F.count_if(ran).alias("rendered"), F.sum(F.when(ran, F.coalesce("navigation_ms", F.lit(0.0)) + F.coalesce("settling_ms", F.lit(0.0))).otherwise(0.0)).alias("used_ms"), F.count_if(ran & (c("settling_status") == "navigation_failed")).alias("failures"))
    return used.withColumn("verdict", F.when(c("rendered") >= max_pages, "max_rendered_urls").when(c("used_ms") >= max_ms, "max_total_render_time_ms").otherwise("within_budget"))


def document_state(pages: DataFrame) -> DataFrame:
    """Effective value per field (settled before raw), change marks and a fingerprint of the effective state."""
    settled = F.coalesce(S.settled(), F.lit(False))
    words = F.when(settled, c("settled_main_words")).otherwise(c("raw_main_words"))
    heads = F.when(settled, F.greatest(c("h1_count"), c("rendered_h1_count"))).otherwise(c("h1_count"))
    state = F.struct(c("title").alias("title"), c("html_lang").alias("lang"), heads.alias("h1_count"), words.alias("words"))
    rows = U.computed_once(pages, {"effective_words": words, "effective_h1": heads, "fingerprint": F.sha2(F.to_json(state), 256)})
    return rows.withColumns({"source": F.when(settled, "settled").otherwise("raw"), "changed_after_initial": settled & (c("settled_main_words") != c("initial_main_words"))})


def storage_estimate(configs: DataFrame) -> DataFrame:
    """Bytes a run would store from its configuration; one row per configuration."""
    per_page = F.lit(PAGE_BYTES)
    for flag, size in STORED_BYTES.items():
        per_page = per_page + F.when(c(flag) == 1, size).otherwise(0)
    return configs.withColumn("estimated_bytes", per_page.cast("bigint") * c("processed_urls"))
