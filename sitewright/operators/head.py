"""Head populations and duplicate head values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewright.config import STATE_FAIL, STATE_INSUFFICIENT, THRESHOLDS
from sitewright.functions import text as TX
from sitewright.functions import url as U
from sitewright.operators import canonical as CA
from sitewright.operators import scopes as S
from sitewright.operators.predicates import Check, evaluate_checks, ladder

c = F.col
FAMILIES = {"title": "html_meta.duplicate_title", "meta_description": "html_meta.duplicate_description"}
CHECK_IDS = {"title": "tech.duplicate_titles", "meta_description": "tech.duplicate_meta_descriptions"}


def population(pages: DataFrame, field: str) -> DataFrame:
    """Content pages with the comparable head value; incomplete and canonicalised pages are flagged, not dropped."""
    evaluated = CA.evaluate(CA.in_scope(pages)).withColumn("evaluated", S.complete_state())
    consolidated = c("evaluated") & ~c("canonical_missing") & (~c("canonical_self") | c("canonical_conflict"))
    value = F.when(c("evaluated") & c(field).isNotNull(), TX.collapse(c("folded")))
    folded = evaluated.withColumn("folded", TX.compatibility_form(c(field)))
    rows = U.computed_once(folded, {"consolidated": consolidated, "head_value": value}).drop("folded")
    return rows.withColumn("head_key", F.lower(F.coalesce("head_value", F.lit(""))))


def population_counts(pages: DataFrame, field: str) -> DataFrame:
    return population(pages, field).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if(~c("evaluated")).alias("incomplete"),
        F.count_if(c("consolidated")).alias("consolidated"), F.count_if(c("evaluated") & ~c("consolidated")).alias("compared"),
    )


def duplicate_groups(pages: DataFrame, field: str, sample_size: int = THRESHOLDS.sample_size) -> DataFrame:
    """Groups of two or more URLs with one head value.

    The URL list of a group may be as long as the site, so the group keeps its count and the first URLs only; all
    members are the rows of ``duplicate_members``.
    """
    members = (
        population(pages, field)
        .where(c("evaluated") & ~c("consolidated") & (c("head_key") != ""))
        .groupBy("run_id", "head_key", "url")
        .agg(F.min("head_value").alias("head_value"), F.min(S.page_type()).alias("page_type"))
    )
    groups = (
        members.groupBy("run_id", "head_key")
        .agg(F.count(F.lit(1)).alias("url_count"), F.min("head_value").alias("value"), F.array_sort(F.collect_set("page_type")).alias("page_types"))
        .where(c("url_count") > 1)
    )
    ranked = members.withColumn("position", F.row_number().over(Window.partitionBy("run_id", "head_key").orderBy("url"))).where(c("position") <= sample_size)
    heads = ranked.groupBy("run_id", "head_key").agg(F.array_sort(F.collect_list("url")).alias("sample_urls"))
    keyed = groups.join(heads, ["run_id", "head_key"])
    cause = F.concat(F.lit(f"{FAMILIES[field]}:"), F.left(F.sha2(F.concat(F.lit(f"{field}:"), c("head_key")), 256), F.lit(20)))
    return keyed.withColumn("root_cause_key", cause)


def duplicate_results(pages: DataFrame, runs: DataFrame, field: str) -> DataFrame:
    groups = duplicate_groups(pages, field).groupBy("run_id").agg(F.sum("url_count").alias("affected"), F.count(F.lit(1)).alias("groups"))
    extended = runs.join(groups, "run_id", "left").na.fill(0, ["affected", "groups"])
    state = ladder((lambda m: m.run("affected") > 0, STATE_FAIL), (lambda m: m["open"] > 0, STATE_INSUFFICIENT))
    check = Check(CHECK_IDS[field], "HTML Head & Meta", {"open": ~S.complete_state()}, state, lambda m: m.run("affected"), evidence=("open",))
    return evaluate_checks(CA.in_scope(pages), extended, [check], with_samples=False)
