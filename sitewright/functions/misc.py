"""Further scalar functions: imported values, hreflang codes, URL filters, schedules, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewright.functions.numbers import half_up, root_cause_id, scope_factor

__all__ = ["human_bytes", "hreflang_code", "imported_flag", "imported_list", "imported_number", "imported_score", "next_due", "root_cause_id", "scope_factor", "size_risk", "url_filter"]


def imported_number(text: Column) -> Column:
    """Number of an exported cell: percent sign dropped, the first comma read as a point."""
    clean = F.regexp_replace(F.regexp_replace(F.replace(text.cast("string"), F.lit("%"), F.lit("")), "^([^,]*),", "$1."), r"[^\d.\-]", "")
    return F.nullif(clean, F.lit("")).try_cast("double")


def imported_score(value: Column) -> Column:
    """Scores above one are percentages."""
    number = imported_number(value) if not isinstance(value, Column) else value.cast("double")
    return F.when(number > 1, F.round(number / 100, 3)).otherwise(number)


def imported_flag(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text.cast("string"), F.lit("")))).isin("1", "true", "yes", "y", "ja", "indexable")


def imported_list(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[|,;]"), lambda part: F.trim(part))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda part: part != "")))


def hreflang_code(text: Column) -> Column:
    code = F.trim(F.coalesce(text, F.lit("")))
    pattern = "(?i)^([a-z]{2,3})(?:-([a-z]{2}|[0-9]{3}))?$"
    default = F.lower(code) == "x-default"
    language = F.nullif(F.lower(F.regexp_extract(code, pattern, 1)), F.lit(""))
    return F.struct(
        F.when(default, "x-default").otherwise(language).alias("language"), F.when(~default, F.nullif(F.upper(F.regexp_extract(code, pattern, 2)), F.lit(""))).alias("region"), default.alias("is_default"), (~default & language.isNull()).alias("invalid"),
    )


def _matches(url: Column, pattern: str) -> Column:
    """A pattern is ``/regex/flags`` or plain text that must occur, without case."""
    slashed = re.match(r"^/(.+)/([a-z]*)$", pattern)
    if slashed and slashed.group(2):
        return url.rlike(("(?i)" if "i" in slashed.group(2) else "") + slashed.group(1))
    return F.contains(F.lower(url), F.lit(pattern.lower()))


def url_filter(url: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """included, excluded or not_included; exclusion wins."""
    hit = lambda patterns: [_matches(url, pattern) for pattern in patterns]
    any_of = lambda tests: F.array_contains(F.array(*tests), True) if tests else F.lit(False)
    return F.when(any_of(hit(exclude)), "excluded").when(F.lit(not include) | any_of(hit(include)), "included").otherwise("not_included")


def next_due(last: Column, frequency: Column, interval: Column, zone: str = "UTC") -> Column:
    """Next run of a daily, weekly or monthly schedule at the same local time; a month that is too short ends on its last day.

    Days and months are added in the schedule's zone, so the hour stays when the clocks change. Timestamps are in UTC.
    """
    local = F.from_utc_timestamp(last, zone)
    day = F.to_date(local)
    clock = F.unix_timestamp(local) - F.unix_timestamp(day.cast("timestamp"))
    moved = F.when(frequency == "daily", F.date_add(day, interval)).when(frequency == "weekly", F.date_add(day, interval * 7)).otherwise(F.add_months(day, interval))
    return F.to_utc_timestamp(F.timestamp_seconds(F.unix_timestamp(moved.cast("timestamp")) + clock), zone)


def is_due(next_run: Column, now: Column) -> Column:
    """A schedule without a next run, or with one that has come, is due."""
    return F.coalesce(next_run <= now, F.lit(True))

def human_bytes(size: Column) -> Column:
    return (
        F.when(size.isNull(), F.lit(None)).when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, F.format_string("%.1f KB", half_up(size / 1024.0, 1)))
        .otherwise(F.format_string("%.1f MB", half_up(size / 1048576.0, 1)))
    )


def size_risk(size: Column) -> Column:
    return F.when(size > 10 * 1024**3, "high").when(size > 1024**3, "medium").otherwise("low")
