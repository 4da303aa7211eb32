"""HTTP status semantics: stability of repeated attempts, redirect chains, retry rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: statuses that one observation does not prove
RETRY_SENSITIVE = (408, 429, 500, 502, 503, 504)
STORED_ATTEMPTS = 5


def parse_attempts(text: Column) -> Column:
    """Comma-separated outcomes (a status or an error word) as an array of attempts."""
    return F.transform(
        F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda item: item != ""),
        lambda item: F.struct(
            F.when(item.rlike("^[0-9]{3}$"), item.cast("int")).alias("final_status"),
            F.when(~item.rlike("^[0-9]{3}$"), item).alias("error_type"),
        ),
    )


def last_attempts(attempts: Column) -> Column:
    """At most the last five attempts."""
    size = F.size(attempts)
    return F.when(size > STORED_ATTEMPTS, F.slice(attempts, -STORED_ATTEMPTS, STORED_ATTEMPTS)).otherwise(attempts)


def stability(attempts: Column) -> Column:
    """confirmed, transient, insufficient_evidence or technical_error, from all attempts; only the stored history is cut."""
    kept = attempts
    done = F.filter(kept, lambda item: item["final_status"].isNotNull())
    errors = F.size(F.filter(kept, lambda item: item["error_type"].isNotNull()))
    seen = F.size(F.array_distinct(F.transform(done, lambda item: item["final_status"])))
    last = F.try_element_at(done, F.lit(-1))["final_status"]
    return (
        F.when(attempts.isNull() | (F.size(kept) <= 0), F.lit("insufficient_evidence"))
        .when((F.size(done) == 0) & (errors > 0), F.lit("technical_error"))
        .when(F.size(done) == 0, F.lit("insufficient_evidence"))
        .when((seen > 1) | (errors > 0), F.lit("transient"))
        .when(last.isin(*RETRY_SENSITIVE) & (F.size(done) < 2), F.lit("insufficient_evidence"))
        .otherwise(F.lit("confirmed"))
    )


def stability_of_counts(answers: Column, errors: Column, mixed: Column, last_status: Column) -> Column:
    """The same verdict from counters: attempts with a status, attempts with an error, whether statuses differ, and the last status."""
    return (
        F.when((answers == 0) & (errors > 0), F.lit("technical_error"))
        .when(answers == 0, F.lit("insufficient_evidence"))
        .when(mixed | (errors > 0), F.lit("transient"))
        .when(last_status.isin(*RETRY_SENSITIVE) & (answers < 2), F.lit("insufficient_evidence"))
        .otherwise(F.lit("confirmed"))
    )


def permanent_chain(statuses: Column) -> Column:
    """True when a chain has redirects and all of them are permanent."""
    return (F.size(statuses) > 0) & F.forall(statuses, lambda status: status.isin(301, 308))


def robots_directives(text: Column) -> Column:
    """First word of every directive, lower case, in written order."""
    return F.filter(
        F.transform(
            F.split(F.lower(F.coalesce(text, F.lit(""))), "[;,]"),
            lambda item: F.try_element_at(F.split(F.trim(item), r"\s+"), F.lit(1)),
        ),
        lambda item: item != "",
    )
