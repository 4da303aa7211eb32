"""Public suffixes and registrable domains of hosts by a table of rules.

Rules are written as public lists have them: `com` and `co.uk` (a suffix), `*.ck` (every label below is a suffix), `!www.ck` (except this one). All tails of
the distinct hosts are joined with the rules by equality, whatever the number of rules; an exception wins, else the longest suffix does, else the last label is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.functions.url import computed_once

c = F.col


def rule_table(lines: DataFrame) -> DataFrame:
    """Rules (key, wild, exception) of lines ``value``: comments, blank lines and what follows a space are left out."""
    text = F.lower(F.regexp_extract(F.trim("value"), r"^(\S*)", 1))
    rules = lines.select(text.alias("rule")).where((c("rule") != "") & ~c("rule").startswith("//"))
    wild, exception = c("rule").startswith("*."), c("rule").startswith("!")
    return rules.select(F.regexp_replace("rule", r"^(\*\.|!|\.)", "").alias("key"), wild.alias("wild"), exception.alias("exception")).where("key <> '' AND key <> '*'").distinct()


def _clean(host: str):
    return F.regexp_replace(F.lower(F.trim(host)), r"\.+$", "")


def resolved(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, suffix and apex of every distinct ``host``. The apex is null where the host is a suffix itself; addresses of numbers have neither."""
    names = computed_once(hosts.select(_clean("host").alias("host")).where("host <> ''").distinct(), {"labels": F.split("host", r"\.")})
    size = F.size("labels")
    tails = names.withColumn("start", F.explode(F.sequence(F.lit(1), size))).select("host", "start", size.alias("size"), F.array_join(F.slice("labels", c("start"), size), ".").alias("key"))
    length = c("size") - c("start") + 1
    # labels of the suffix: one more under a wildcard, where the host has one more, and one less for an exception
    found = tails.join(rules, "key").where(~c("wild") | (c("start") > 1)).groupBy("host").agg(
        F.max(F.struct("exception", (length + F.when(c("wild"), 1).otherwise(0) - F.when(c("exception"), 1).otherwise(0)).alias("labels"))).alias("best"))
    joined = names.join(found, "host", "left").withColumn("n", F.coalesce("best.labels", F.lit(1)))
    number = c("host").rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | c("host").contains(":")
    tail = lambda count: F.array_join(F.slice("labels", size - count + 1, count), ".")
    return joined.select("host", F.when(~number, tail(F.least(c("n"), size))).alias("suffix"), F.when(~number & (size > c("n")), tail(c("n") + 1)).alias("apex"))


def with_apex(rows: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """The rows with suffix and apex of their host column."""
    known = resolved(rows.select(c(host).alias("host")), rules).withColumnRenamed("host", "__host")
    return rows.withColumn("__clean", _clean(host)).join(known, c("__clean") == c("__host"), "left").drop("__clean", "__host")
