"""Canonical evaluation: declared values against the page, host relations, facts of the targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.config import STATE_FAIL, STATE_INSUFFICIENT, STATE_NOT_APPLICABLE
from sitewright.functions import url as U
from sitewright.operators import scopes as S
from sitewright.operators.predicates import Check, _fail_count, evaluate_checks, has, issue, ladder, none

c = F.col
CRAWL = "Crawling & Indexing"


def evaluate(pages: DataFrame, site_url: Column | None = None) -> DataFrame:
    """Canonical columns of every page; ``site_url`` is the primary URL the host relation is measured against."""
    final = F.coalesce(c("final_url"), c("normalized_url"), c("url"))
    declared = F.transform(F.coalesce(c("canonical_values"), F.array().cast("array<string>")), lambda value: U.canonical_comparable(value, final))
    primary = site_url if site_url is not None else final
    step = U.computed_once(pages, {"expected_canonical": U.canonical_comparable(final), "declared_canonicals": F.array_compact(declared)})
    step = step.withColumns({"canonicals": F.array_distinct("declared_canonicals"), "declared_count": F.size("declared_canonicals")}).drop("declared_canonicals")
    count = F.size(c("canonicals"))
    own = (count == 1) & (F.get(c("canonicals"), F.lit(0)) == c("expected_canonical"))
    foreign = F.filter(c("canonicals"), lambda value: U.canonical_relationship(value, primary) == "cross_registrable_domain")
    other = F.size(F.array_remove(c("canonicals"), c("expected_canonical"))) > 0
    return U.computed_once(
        step,
        {
            "canonical_missing": count == 0,
            "canonical_conflict": count > 1,
            "canonical_repeated": (c("declared_count") > 1) & (count == 1),
            "canonical_self": F.coalesce(own, F.lit(False)),
            "canonical_foreign": foreign,
            "canonical_issue": F.when(count > 1, "conflicting_canonical_tags").when(other, "non_self").when(count > 0, "self").otherwise("missing"),
        },
    )


def target_index(pages: DataFrame) -> DataFrame:
    """First page (lowest id) per comparable URL, for requested URLs and, apart from them, for final URLs."""
    facts = F.struct("page_id", "status_code", "initial_status_code", "content_type", "final_url")
    keys = F.array(
        F.struct(F.lit(0).alias("rank"), U.canonical_comparable(c("url")).alias("key")),
        F.struct(F.lit(0).alias("rank"), U.canonical_comparable(c("normalized_url")).alias("key")),
        F.struct(F.lit(1).alias("rank"), U.canonical_comparable(c("final_url")).alias("key")),
    )
    exploded = pages.select("run_id", facts.alias("facts"), F.explode(F.array_distinct(keys)).alias("k"))
    return (
        exploded.where(c("k.key").isNotNull())
        .groupBy("run_id", c("k.key").alias("canonical"))
        .agg(F.min_by("facts", F.struct(c("k.rank"), c("facts.page_id"))).alias("target"))
    )


def targets(evaluated: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per (page, declared canonical) with what is known of the target; requested URLs win over final ones."""
    rows = evaluated.withColumn("canonical", F.explode("canonicals"))
    joined = rows.join(target_index(pages), ["run_id", "canonical"], "left")
    status, first, kind = c("target.status_code"), c("target.initial_status_code"), c("target.content_type")
    known = status.isNotNull()
    html = F.lower(F.coalesce(kind, F.lit(""))).contains("html")
    redirect = known & S.between(first, 300, 400)
    non_200 = known & (status != 200)
    non_html = known & (status == 200) & (F.coalesce(kind, F.lit("")) != "") & ~html
    complete = known & first.isNotNull() & ((status != 200) | (F.coalesce(F.trim(kind), F.lit("")) != ""))
    flags = {"target_known": known, "target_redirect": redirect, "target_non_200": non_200, "target_non_html": non_html, "target_measured": complete}
    issue_type = (
        F.when(c("target_redirect"), "canonical_target_redirect").when(c("target_non_200"), "canonical_target_non_200")
        .when(c("target_non_html"), "canonical_target_non_html").when(c("target_known"), "canonical_target_200").otherwise("canonical_target_unknown")
    )
    flagged = joined.withColumns({name: F.coalesce(flag, F.lit(False)) for name, flag in flags.items()})
    return flagged.withColumn("target_issue", issue_type)


def in_scope(pages: DataFrame) -> DataFrame:
    return pages.where(S.content_html())


def canonical_checks() -> list[Check]:
    complete = S.complete_state()
    scope = F.lit(True)
    pending = ~complete
    non_self = complete & ~c("canonical_missing") & (~c("canonical_self") | c("canonical_conflict"))
    return [
        issue("tech.canonical_missing", CRAWL, complete & c("canonical_missing"), scope=scope, incomplete=pending),
        issue("tech.canonical_non_self", CRAWL, non_self, scope=scope, incomplete=pending, priority="Low", score_eligible=False),
        issue("tech.canonical_to_other_domain", CRAWL, complete & (F.size("canonical_foreign") > 0), scope=scope, incomplete=pending, score_eligible=False),
    ]


def canonical_results(pages: DataFrame, runs: DataFrame) -> DataFrame:
    site = runs.select("run_id", F.col("final_domain").alias("site_url"))
    rows = evaluate(in_scope(pages).join(site, "run_id", "left"), c("site_url"))
    return evaluate_checks(rows, runs, canonical_checks())


def target_results(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Known targets that redirect, fail or are not HTML; open measurements block a pass."""
    scoped = in_scope(pages)
    evaluated = evaluate(scoped).where(S.complete_state())
    found = targets(evaluated, pages).select(
        "run_id", "url", F.lit(False).alias("page_row"), F.lit(False).alias("pending"),
        (c("target_redirect") | c("target_non_200") | c("target_non_html")).alias("hit"), (~c("target_measured")).alias("open"),
    )
    page_rows = scoped.select("run_id", "url", F.lit(True).alias("page_row"), (~S.complete_state()).alias("pending"), F.lit(False).alias("hit"), F.lit(False).alias("open"))
    state = ladder((none("pages"), STATE_NOT_APPLICABLE), (has("hit"), STATE_FAIL), (lambda m: (m["pending"] > 0) | (m["open"] > 0), STATE_INSUFFICIENT))
    measures = {"pages": c("page_row"), "pending": c("pending"), "hit": c("hit"), "open": c("open")}
    check = Check("tech.canonical_target_non_200", CRAWL, measures, state, _fail_count(state, "hit"), sample="hit", evidence=("open",))
    return evaluate_checks(found.unionByName(page_rows), runs, [check], repeated=True)
