"""Rounding, lookup tables, and the factors and ids of root causes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: weight of a finding by its scope
SCOPE_FACTOR = {"url": 1.0, "template": 1.15, "sitewide": 1.25, "resource": 1.0, "external": 0.75, "service": 1.15, "unknown": 1.0}


def half_up(value: Column, places: int = 0) -> Column:
    """Rounding of positive numbers with ties upwards."""
    scale = float(10**places)
    return F.floor(value * scale + 0.5) / scale


def lookup(column: Column, table: dict, default) -> Column:
    rule = None
    for key, value in table.items():
        rule = F.when(column == key, F.lit(value)) if rule is None else rule.when(column == key, F.lit(value))
    return rule.otherwise(F.lit(default))


def scope_factor(count: Column, scope: Column) -> Column:
    growth = F.least(F.lit(1.75), 1 + F.log10(F.greatest(F.lit(1.0), count.cast("double"))) * 0.25)
    return half_up(F.least(F.lit(2.0), growth * lookup(scope, SCOPE_FACTOR, 1.0)), 4)


def root_cause_id(key: Column) -> Column:
    return F.concat(F.lit("rc_"), F.left(F.sha2(F.coalesce(key, F.lit("unknown")), 256), F.lit(16)))
