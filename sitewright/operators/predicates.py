"""Predicate checks fused into one aggregation per input table.

A check names boolean *measures* of a row, then derives its evaluation state and its affected count from the
per-run counts of those measures. ``evaluate_checks`` computes the measures of all given checks with one hash
aggregate (partial counts before the shuffle, one row per run after it), so a further check adds no scan and no
shuffle. Samples take a second narrow pass: failing rows are ranked per (run, check), and the rank filter is pushed
below the shuffle, so no task ever holds more than the sample size per group and partition.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
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

# Wide aggregates leave whole-stage code generation above this many output fields.
MAX_FUSED_MEASURES = 90


class Counts:
    """Access to the aggregated measures of one check and to the flags of its run."""

    def __init__(self, prefix: str):
        self._prefix = prefix

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self._prefix}{name}")

    @property
    def rows(self) -> Column:
        return F.col("rows_total")

    @staticmethod
    def run(flag: str) -> Column:
        return F.col(flag)


StateRule = Callable[[Counts], Column]


@dataclass(frozen=True)
class Check:
    id: str
    category: str
    measures: Mapping[str, Column]
    state: StateRule
    affected: StateRule
    sample: str | None = None
    fail_status: str | StateRule = "Warning"
    priority: str = "Medium"
    score_eligible: bool = True
    evidence: Sequence[str] = field(default_factory=tuple)


# --- state rules -------------------------------------------------------------------------------------------------

def ladder(*steps: tuple[StateRule, str], last: str = STATE_PASS) -> StateRule:
    """First matching step decides; ``last`` is the state when none matches."""

    def rule(counts: Counts) -> Column:
        column = None
        for condition, state in steps:
            test = condition(counts)
            column = F.when(test, F.lit(state)) if column is None else column.when(test, F.lit(state))
        return F.lit(last) if column is None else column.otherwise(F.lit(last))

    return rule


def has(name: str) -> StateRule:
    return lambda counts: counts[name] > 0


def none(name: str) -> StateRule:
    return lambda counts: counts[name] == 0


def no_rows(counts: Counts) -> Column:
    return counts.rows == 0


def flag_off(flag: str) -> StateRule:
    return lambda counts: counts.run(flag) == 0


def count_of(name: str) -> StateRule:
    return lambda counts: counts[name]


def count_when(name: str, condition: StateRule) -> StateRule:
    return lambda counts: F.when(condition(counts), counts[name]).otherwise(F.lit(0))


ZERO: StateRule = lambda counts: F.lit(0)


# --- check builders ----------------------------------------------------------------------------------------------

def issue(
    id: str,
    category: str,
    predicate: Column,
    *,
    scope: Column | None = None,
    incomplete: Column | None = None,
    gate: str | None = None,
    empty: str = STATE_NOT_APPLICABLE,
    needs_rows: bool = False,
    **options,
) -> Check:
    """Rows that match a predicate are the issue; optional scope, completeness and stored-fact gates."""
    measures = {"hit": predicate}
    steps = []
    if gate:
        steps.append((flag_off(gate), STATE_NOT_EXECUTED))
    if needs_rows:
        steps.append((no_rows, STATE_INSUFFICIENT))
    if scope is not None:
        measures["scope"] = scope
        steps.append((none("scope"), empty))
    steps.append((has("hit"), STATE_FAIL))
    if incomplete is not None:
        measures["open"] = incomplete
        steps.append((has("open"), STATE_INSUFFICIENT))
    options.setdefault("sample", "hit")
    return Check(id, category, measures, ladder(*steps), _fail_count(ladder(*steps), "hit"), **options)


def _fail_count(state: StateRule, name: str) -> StateRule:
    return lambda counts: F.when(state(counts) == STATE_FAIL, counts[name]).otherwise(F.lit(0))


def presence(
    id: str,
    category: str,
    signal: Column,
    scope: Column,
    missing: Column,
    *,
    empty: str = STATE_NOT_APPLICABLE,
    **options,
) -> Check:
    """One row with the signal is enough to pass; otherwise the rows without it are the issue."""
    state = ladder((none("scope"), empty), (none("signal"), STATE_FAIL))
    options.setdefault("sample", "missing")
    return Check(
        id, category, {"signal": signal, "scope": scope, "missing": missing}, state, _fail_count(state, "missing"), **options
    )


# --- evaluation --------------------------------------------------------------------------------------------------

def status_of(state: Column, fail_status: Column) -> Column:
    return F.when(state == STATE_PASS, F.lit("OK")).when(state == STATE_FAIL, fail_status).otherwise(F.lit("NA"))


def _prefix(position: int) -> str:
    return f"m{position}_"


def measure_counts(rows: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per run with the count of every measure of every check."""
    aggregates = [F.count(F.lit(1)).alias("rows_total")]
    for position, check in enumerate(checks):
        for name, condition in check.measures.items():
            aggregates.append(F.count_if(F.coalesce(condition, F.lit(False))).alias(f"{_prefix(position)}{name}"))
    return rows.groupBy("run_id").agg(*aggregates)


def samples(
    rows: DataFrame,
    conditions: Mapping[str, Column],
    url: str = "url",
    limit: int = THRESHOLDS.sample_size,
    repeated: bool = False,
) -> DataFrame:
    """First ``limit`` distinct URLs, in URL order, per run and condition.

    ``repeated`` says that one URL may occur on many rows (links, images, resources); those are reduced to distinct
    pairs first, so that a popular URL cannot fill a group.
    """
    hits = F.array_compact(
        F.array(*[F.when(F.coalesce(condition, F.lit(False)), F.lit(key)) for key, condition in conditions.items()])
    )
    failing = rows.select("run_id", F.col(url).alias("sample_url"), F.explode(hits).alias("check_id"))
    ranked = (
        (failing.distinct() if repeated else failing)
        .withColumn(
            "position", F.dense_rank().over(Window.partitionBy("run_id", "check_id").orderBy(F.col("sample_url")))
        )
        .where(F.col("position") <= limit)
    )
    return ranked.groupBy("run_id", "check_id").agg(F.array_sort(F.collect_set("sample_url")).alias("sample_urls"))


def evaluate_checks(
    rows: DataFrame,
    runs: DataFrame,
    checks: Sequence[Check],
    url: str = "url",
    with_samples: bool = True,
    repeated: bool = False,
) -> DataFrame:
    """Result rows of all checks for all runs; runs without rows are kept."""
    batches: list[list[Check]] = [[]]
    width = 0
    for check in checks:
        if width + len(check.measures) > MAX_FUSED_MEASURES:
            batches.append([])
            width = 0
        batches[-1].append(check)
        width += len(check.measures)

    output = None
    for batch in batches:
        counted = runs.join(measure_counts(rows, batch), "run_id", "left")
        names = ["rows_total"] + [
            f"{_prefix(position)}{name}" for position, check in enumerate(batch) for name in check.measures
        ]
        counted = counted.na.fill(0, names)
        structs = []
        for position, check in enumerate(batch):
            counts = Counts(_prefix(position))
            state = check.state(counts)
            fail = check.fail_status(counts) if callable(check.fail_status) else F.lit(check.fail_status)
            notes = [F.concat(F.lit(f"{name}="), counts[name].cast("string")) for name in check.evidence]
            structs.append(
                F.struct(
                    F.lit(check.id).alias("check_id"),
                    F.lit(check.category).alias("category"),
                    F.lit(check.priority).alias("priority"),
                    state.alias("evaluation_state"),
                    status_of(state, fail).alias("status"),
                    check.affected(counts).cast("bigint").alias("affected_count"),
                    (F.lit(check.score_eligible) & state.isin(STATE_PASS, STATE_FAIL)).alias("score_eligible"),
                    F.concat_ws(";", *notes).alias("evidence") if notes else F.lit("").alias("evidence"),
                )
            )
        part = counted.select("run_id", F.inline(F.array(*structs)))
        output = part if output is None else output.unionByName(part)

    if not with_samples:
        return output.withColumn("sample_urls", F.array().cast("array<string>"))
    conditions = {check.id: check.measures[check.sample] for check in checks if check.sample}
    sampled = samples(rows, conditions, url, repeated=repeated)
    joined = output.join(sampled, ["run_id", "check_id"], "left")
    return joined.withColumn(
        "sample_urls",
        F.when(F.col("affected_count") > 0, F.coalesce("sample_urls", F.array().cast("array<string>"))).otherwise(
            F.array().cast("array<string>")
        ),
    )


def runnable(rows: DataFrame, checks: Sequence[Check]) -> tuple[list[Check], dict[str, str]]:
    """Checks whose measures the rows can give, and why the others cannot run. Only the analyser is asked, no job runs."""
    able, failed = [], {}
    for check in checks:
        try:
            _ = rows.select(*[condition.alias(name) for name, condition in check.measures.items()]).schema
            able.append(check)
        except AnalysisException as error:
            failed[check.id] = error.getCondition() or type(error).__name__
    return able, failed


def evaluate_all(rows: DataFrame, runs: DataFrame, checks: Sequence[Check], **options) -> DataFrame:
    """Result rows of all checks: one that cannot run gives a row of state technical_error for every run and does not stop the others."""
    able, failed = runnable(rows, checks)
    broken = {check.id: check for check in checks if check.id in failed}
    errors = F.array(*[
        F.struct(F.lit(check.id).alias("check_id"), F.lit(check.category).alias("category"), F.lit(check.priority).alias("priority"), F.lit(failed[check.id]).alias("evidence")) for check in broken.values()
    ]) if broken else None
    if errors is None:
        return evaluate_checks(rows, runs, able, **options)
    technical = runs.select("run_id", F.inline(errors)).withColumns({
        "evaluation_state": F.lit(STATE_TECHNICAL), "status": F.lit("NA"), "affected_count": F.lit(0).cast("bigint"), "score_eligible": F.lit(False), "sample_urls": F.array().cast("array<string>"),
    })
    return evaluate_checks(rows, runs, able, **options).unionByName(technical) if able else technical


def with_evidence(results: DataFrame) -> DataFrame:
    """Findings without evidence become insufficient evidence: a warning or error that neither counts, names a sample nor notes a measure proves nothing."""
    bare = _is_issue() & (F.coalesce(F.col("affected_count"), F.lit(0)) <= 0) & (F.size(F.coalesce(F.col("sample_urls"), F.array().cast("array<string>"))) == 0) & (F.trim(F.coalesce(F.col("evidence"), F.lit(""))) == "")
    return results.withColumns({
        "evaluation_state": F.when(bare, F.lit(STATE_INSUFFICIENT)).otherwise(F.col("evaluation_state")), "status": F.when(bare, F.lit("NA")).otherwise(F.col("status")),
        "affected_count": F.greatest(F.coalesce(F.col("affected_count"), F.lit(0)), F.lit(0)).cast("bigint"), "score_eligible": F.when(bare, F.lit(False)).otherwise(F.col("score_eligible")),
    })


def _is_issue() -> Column:
    return F.coalesce(F.col("status").isin("Warning", "Error"), F.lit(False))


def affected_rows(rows: DataFrame, checks: list[Check], *columns: str) -> DataFrame:
    """All detail rows behind the checks: a row with each check whose sample measure selects it, from one scan."""
    hits = [F.when(F.coalesce(check.measures[check.sample or "hit"], F.lit(False)), F.lit(check.id)) for check in checks]
    return rows.select(*columns, F.explode(F.array_compact(F.array(*hits))).alias("check_id"))


def availability(
    required: Column,
    observed: Column,
    *,
    minimum: float = 1.0,
    measurements: Column | None = None,
    minimum_measurements: int = 0,
    technical_error: Column | None = None,
    executed: Column | None = None,
    applicable: Column | None = None,
    age_ms: Column | None = None,
    maximum_age_ms: int | None = None,
    successful_retries: Column | None = None,
    minimum_retries: int = 0,
) -> Column:
    """Evaluation state of one subject from the facts it needs and the facts it has."""
    needed = F.array_distinct(required)
    missing = F.size(F.array_except(needed, observed))
    coverage = F.when(F.size(needed) > 0, (F.size(needed) - missing) / F.size(needed)).otherwise(F.lit(1.0))
    short = (missing > 0) | (coverage < min(1.0, max(0.0, minimum)))
    if minimum_measurements > 0 and measurements is not None:
        short = short | F.coalesce(measurements < minimum_measurements, F.lit(True))
    if minimum_retries > 0 and successful_retries is not None:
        short = short | F.coalesce(successful_retries < minimum_retries, F.lit(True))
    if maximum_age_ms is not None and age_ms is not None:
        short = short | F.coalesce(age_ms > maximum_age_ms, F.lit(False))
    column = F.when(technical_error, F.lit(STATE_TECHNICAL)) if technical_error is not None else None
    for condition, state in ((executed, STATE_NOT_EXECUTED), (applicable, STATE_NOT_APPLICABLE)):
        if condition is not None:
            column = F.when(~condition, F.lit(state)) if column is None else column.when(~condition, F.lit(state))
    column = F.when(short, F.lit(STATE_INSUFFICIENT)) if column is None else column.when(short, F.lit(STATE_INSUFFICIENT))
    return column.otherwise(F.lit(STATE_PASS))
