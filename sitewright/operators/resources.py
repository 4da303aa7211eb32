"""Resource and image operators: counts, bytes with measurement coverage, hints, formats, image markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.config import (
    STATE_FAIL,
    STATE_INSUFFICIENT,
    STATE_NOT_APPLICABLE,
    STATE_NOT_EXECUTED,
    STATE_TECHNICAL,
    THRESHOLDS,
)
from sitewright.operators import scopes as S
from sitewright.operators.predicates import Check, _fail_count, evaluate_checks, flag_off, has, issue, ladder, none

c = F.col
T = THRESHOLDS
LIGHT, MEDIA = "Performance Light", "Media SEO"


def page_totals(resources: DataFrame) -> DataFrame:
    """One row per page with all resource counts and bytes that the checks need."""
    kind = c("resource_type")
    hinted = kind.isin("script", "stylesheet", "font")
    aggregates = []
    for name in ("script", "stylesheet", "image"):
        rows = kind == name
        aggregates += [
            F.count_if(rows).alias(f"{name}_count"),
            F.sum(F.when(rows, c("size_bytes"))).alias(f"{name}_bytes"),
            F.count_if(rows & c("size_bytes").isNotNull()).alias(f"{name}_measured"),
            F.count_if(rows & c("size_error").isNotNull()).alias(f"{name}_errors"),
        ]
    aggregates += [
        F.count_if((kind == "script") & (c("third_party") == 1)).alias("third_party_scripts"),
        F.count_if(hinted).alias("key_resources"),
        F.count_if(hinted & (c("third_party") == 1)).alias("third_party_key_resources"),
    ]
    return resources.groupBy("run_id", "page_url", "final_url").agg(*aggregates)


def measurement_kinds(resources: DataFrame) -> DataFrame:
    """Known sizes per run, resource type and way of measuring."""
    return (
        resources.where(c("size_bytes").isNotNull())
        .groupBy("run_id", "resource_type", F.coalesce(c("size_kind"), F.lit("unknown")).alias("size_kind"))
        .agg(F.count(F.lit(1)).alias("measured"), F.sum("size_bytes").alias("bytes"))
    )


def resource_checks() -> list[Check]:
    gate = (flag_off("store_all_resources"), STATE_NOT_EXECUTED)

    def counted(check_id: str, hit: Column, **options) -> Check:
        return issue(check_id, LIGHT, hit, gate="store_all_resources", priority="Low", **options)

    def sized(check_id: str, name: str, limit: int) -> Check:
        # Coverage is a statement over all resources, so the counts are summed through weighted measures.
        measures = {
            "hit": c(f"{name}_bytes") > limit,
            "some": c(f"{name}_count") > 0,
            "unmeasured": c(f"{name}_measured") < c(f"{name}_count"),
            "measured": c(f"{name}_measured") > 0,
            "unexplained": c(f"{name}_errors") < c(f"{name}_count"),
        }
        state = ladder(
            gate,
            (none("some"), STATE_NOT_APPLICABLE),
            (has("hit"), STATE_FAIL),
            (lambda m: (m["unmeasured"] > 0) & (m["measured"] == 0) & (m["unexplained"] == 0), STATE_TECHNICAL),
            (has("unmeasured"), STATE_INSUFFICIENT),
        )
        return Check(check_id, LIGHT, measures, state, _fail_count(state, "hit"), sample="hit")

    return [
        counted("tech.too_many_js", c("script_count") > T.scripts_per_page),
        counted("tech.too_many_css", c("stylesheet_count") > T.styles_per_page),
        sized("tech.large_js_total", "script", T.script_bytes),
        sized("tech.large_css_total", "stylesheet", T.style_bytes),
        counted("tech.third_party_scripts_detected", c("third_party_scripts") > 0, score_eligible=False),
        counted("tech.preload_missing", (c("key_resources") > 10) & (c("has_preload") == 0)),
        counted("tech.preconnect_missing", (c("third_party_key_resources") >= 3) & (c("has_preconnect") == 0)),
        Check(
            "tech.imported_resource_performance_signals", LIGHT,
            {"known": (c("script_count") > 0) | (c("stylesheet_count") > 0),
             "hit": (c("script_count") > T.scripts_per_page) | (c("stylesheet_count") > T.styles_per_page) | (c("script_bytes") > T.script_bytes) | (c("stylesheet_bytes") > T.style_bytes)},
            ladder((none("known"), STATE_INSUFFICIENT), (has("hit"), STATE_FAIL)), lambda m: m["hit"], sample="hit",
        ),
    ]


def resource_results(resources: DataFrame, pages: DataFrame, runs: DataFrame) -> DataFrame:
    """All resource checks: one aggregation per page, one join with the hint flags, one aggregation per run."""
    hints = pages.select("run_id", "final_url", "has_preload", "has_preconnect").dropDuplicates(["run_id", "final_url"])
    rows = page_totals(resources).join(hints, ["run_id", "final_url"], "left").withColumn("url", c("page_url"))
    return evaluate_checks(rows, runs, resource_checks(), repeated=True)


def image_checks() -> list[Check]:
    content = S.non_decorative_image()
    absent = (c("alt_present") == 0) & content
    blank = (c("alt_present") == 1) & (F.trim(c("alt_value")) == "") & content
    no_size = (S.blank(c("width")) | S.blank(c("height"))) & content & (F.lower(F.coalesce(c("extension"), F.lit(""))) != ".svg")
    not_lazy = (F.coalesce(F.lower(c("loading")), F.lit("")) != "lazy") & content
    lazy = not_lazy & S.not_small_image() & S.not_hero_image()
    unknown_alt = c("alt_present").isNull()

    def alt(check_id: str, hit: Column, aside: Column, **options) -> Check:
        state = ladder((flag_off("store_all_images"), STATE_NOT_EXECUTED), (has("open"), STATE_INSUFFICIENT), (has("hit"), STATE_FAIL))
        return Check(check_id, MEDIA, {"open": unknown_alt, "hit": hit, "aside": aside}, state, _fail_count(state, "hit"), sample="hit", evidence=("aside",), **options)

    def markup(check_id: str, hit: Column, open_rows: Column | None, **aside: Column) -> Check:
        steps = [(flag_off("store_all_images"), STATE_NOT_EXECUTED), (lambda m: m.rows == 0, STATE_NOT_APPLICABLE)]
        measures = {"hit": hit, **aside}
        if open_rows is not None:
            measures["open"] = open_rows
            steps.append((has("open"), STATE_INSUFFICIENT))
        state = ladder(*steps, (has("hit"), STATE_FAIL))
        return Check(check_id, MEDIA, measures, state, _fail_count(state, "hit"), sample="hit", priority="Low", evidence=tuple(aside))

    return [
        alt("tech.images_without_alt", absent, (c("alt_present") == 0) & S.decorative_image()),
        alt("tech.empty_alt_texts", blank, (c("alt_present") == 1) & (F.trim(c("alt_value")) == "") & S.decorative_image(), priority="Low"),
        markup("tech.images_without_width_height", no_size, None, decorated=(S.blank(c("width")) | S.blank(c("height"))) & S.decorative_image()),
        markup("tech.images_without_lazy_loading", lazy, c("image_role").isNull(), small=not_lazy & ~S.not_small_image(), hero=not_lazy & S.not_small_image() & ~S.not_hero_image()),
    ]


def image_results(images: DataFrame, runs: DataFrame) -> DataFrame:
    return evaluate_checks(images.withColumn("url", c("page_url")), runs, image_checks(), repeated=True)


def large_image_results(resources: DataFrame, runs: DataFrame) -> DataFrame:
    rows = resources.where(c("resource_type") == "image").withColumn("url", c("page_url"))
    state = ladder(
        (flag_off("store_all_resources"), STATE_NOT_EXECUTED), (lambda m: m.rows == 0, STATE_NOT_APPLICABLE), (has("hit"), STATE_FAIL),
        (lambda m: (m["measured"] == 0) & (m["errors"] == m.rows), STATE_TECHNICAL), (lambda m: m["measured"] < m.rows, STATE_INSUFFICIENT),
    )
    measures = {"hit": c("size_bytes") > T.image_bytes, "measured": c("size_bytes").isNotNull(), "errors": c("size_error").isNotNull()}
    check = Check("tech.large_image_resources", MEDIA, measures, state, _fail_count(state, "hit"), sample="hit", priority="Low", evidence=("measured", "errors"))
    return evaluate_checks(rows, runs, [check], repeated=True)


def image_formats(images: DataFrame, resources: DataFrame) -> DataFrame:
    """Format of every distinct raster image URL of a run; the content type decides before the extension."""
    by_markup = images.groupBy("run_id", F.col("image_url").alias("resource_url")).agg(F.max(F.lower("extension")).alias("extension"))
    by_resource = (
        resources.where(c("resource_type") == "image").groupBy("run_id", "resource_url").agg(F.max(F.lower("content_type")).alias("content_type"))
    )
    kind, ext = F.coalesce(c("content_type"), F.lit("")), c("extension")
    state = (
        F.when(kind.contains("image/svg") | (ext == ".svg"), F.lit(None))
        .when(kind.rlike("image/(webp|avif)"), F.lit("modern")).when(kind.rlike("image/(jpeg|jpg|png|gif)"), F.lit("legacy"))
        .when(ext.rlike("^[.](webp|avif)$"), F.lit("modern")).when(ext.rlike("^[.](jpe?g|png|gif)$"), F.lit("legacy")).otherwise(F.lit("unknown"))
    )
    merged = by_markup.join(by_resource, ["run_id", "resource_url"], "full_outer")
    return merged.withColumn("format", state).where(c("format").isNotNull()).select("run_id", "resource_url", "format")


def modern_format_results(images: DataFrame, resources: DataFrame, runs: DataFrame) -> DataFrame:
    rows = image_formats(images, resources).withColumn("url", c("resource_url"))
    state = ladder(
        (flag_off("store_all_images"), STATE_NOT_EXECUTED), (lambda m: m.rows == 0, STATE_NOT_APPLICABLE), (has("unknown"), STATE_INSUFFICIENT),
        (lambda m: m["modern"] / m.rows < 0.3, STATE_FAIL),
    )
    measures = {"modern": c("format") == "modern", "unknown": c("format") == "unknown", "legacy": c("format") == "legacy"}
    check = Check("tech.modern_image_format_coverage_low", MEDIA, measures, state, lambda m: F.when(state(m) == STATE_FAIL, m.rows - m["modern"]).otherwise(F.lit(0)), sample="legacy", priority="Low", evidence=("modern", "legacy"))
    return evaluate_checks(rows, runs, [check])


def unlisted_images(images: DataFrame, resources: DataFrame) -> DataFrame:
    """Image resources that no image element of their page names."""
    named = images.select("run_id", "page_url", F.col("image_url").alias("resource_url")).distinct()
    return resources.where(c("resource_type") == "image").join(named, ["run_id", "page_url", "resource_url"], "left_anti")


def timing_medians(timings: DataFrame) -> DataFrame:
    """Median of repeated timings per URL; eligible with three or more valid ones of one place and one mode."""
    valid = (c("warmup") == 0) & c("error").isNull() & (c("ttfb_ms") >= 0) & (c("ttfb_ms") <= 120000)
    only = lambda column: F.when(valid, column)
    grouped = timings.groupBy("run_id", "url").agg(
        F.count(F.lit(1)).alias("stored"), F.count_if(valid).alias("valid"), F.count_if(c("error").isNotNull()).alias("errors"),
        F.count_if((c("warmup") == 0) & c("error").isNull() & ((c("ttfb_ms") < 0) | (c("ttfb_ms") > 120000))).alias("outliers"),
        F.median(only(c("ttfb_ms"))).alias("median_ms"),
        F.count_distinct(only(c("location"))).alias("locations"), F.count_distinct(only(c("mode"))).alias("modes"),
        F.count_if(valid & (S.blank(c("location")) | S.blank(c("mode")))).alias("unlabelled"),
    )
    eligible = (c("valid") >= 3) & (c("locations") == 1) & (c("modes") == 1) & (c("unlabelled") == 0)
    return grouped.withColumn("eligible", eligible)


def timing_results(timings: DataFrame, runs: DataFrame) -> DataFrame:
    rows = timing_medians(timings)
    state = ladder(
        (lambda m: m.rows == 0, STATE_NOT_EXECUTED),
        (lambda m: (m["eligible"] == 0) & (m["clean"] == 0), STATE_TECHNICAL),
        (none("eligible"), STATE_INSUFFICIENT), (has("hit"), STATE_FAIL),
    )
    measures = {"eligible": c("eligible"), "clean": c("errors") + c("outliers") < c("stored"), "hit": c("eligible") & (c("median_ms") > T.ttfb_ms)}
    check = Check("tech.high_ttfb", LIGHT, measures, state, _fail_count(state, "hit"), sample="hit", evidence=("eligible",))
    return evaluate_checks(rows, runs, [check])
