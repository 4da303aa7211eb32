"""robots.txt, sitemap and llms.txt files as tables: parsing, states, bot policies, reconciliation, checks."""

from __future__ import annotations

import gzip
import re
import xml.etree.ElementTree as ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.config import AI_BOTS
from sitewright.functions import url as U
from sitewright.session import stored

c = F.col
# fixed values: limits of a sitemap file and words that name no project

SITEMAP_MAX_LOCATIONS = 50_000
GENERIC_NAMES = r"(?i)^(llms(\.txt)?|documentation|docs|website|site|home|index|readme)$"
TEXT_TYPES = r"(?i)^(text/plain|text/markdown|text/x-markdown|application/markdown)(;|$)"


# --- robots.txt --------------------------------------------------------------------------------------------------

def _line_struct(raw: Column, index: Column) -> Column:
    body = F.trim(F.regexp_replace(raw, "(?s)#.*$", ""))
    return F.struct(
        (index + 1).alias("line"), (body == "").alias("blank"), body.contains(":").alias("directive"),
        F.lower(F.trim(F.regexp_extract(body, "(?s)^([^:]*):", 1))).alias("name"), F.trim(F.regexp_extract(body, "(?s)^[^:]*:(.*)$", 1)).alias("value"),
    )


def robots_lines(assets: DataFrame) -> DataFrame:
    """Lines of every file with directive name, value and group number.

    A file is one row and its lines stay an array, so no shuffle is needed. A group starts at a named user agent, unless the last line before it that opens or closes
    a run of agents was one too. The starts cut the lines into slices, each of which is copied once: time is linear in the lines.
    """
    text = F.regexp_replace(F.coalesce(c("content"), F.lit("")), "^\ufeff", "")
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), _line_struct), lambda line: ~line["blank"])
    rows = U.computed_once(assets, {"__lines": lines})
    is_agent = lambda line: line["directive"] & (line["name"] == "user-agent")
    mark = lambda line, at: F.struct(at.alias("at"), (is_agent(line) & (line["value"] != "")).alias("named"), (line["directive"] & ~is_agent(line)).alias("closing"))
    rows = U.computed_once(rows, {"__marks": F.filter(F.transform("__lines", mark), lambda m: m["named"] | m["closing"])})
    start = lambda m, at: F.when(m["named"] & F.coalesce(~F.get("__marks", at - 1)["named"], F.lit(True)), m["at"])
    rows = U.computed_once(rows, {"__starts": F.array_compact(F.transform("__marks", start))})
    spans = F.zip_with(F.concat(F.array(F.lit(0)), "__starts"), F.concat("__starts", F.array(F.size("__lines"))), lambda low, high: F.struct(low.alias("low"), (high - low).alias("size")))
    rows = U.computed_once(rows, {"__spans": spans})

    def row(line: Column, group: Column) -> Column:
        agent, rule = is_agent(line), line["directive"] & line["name"].isin("allow", "disallow")
        error = F.when(~line["directive"], "malformed_directive").when(agent & (line["value"] == ""), "empty_user_agent").when(rule & (group == 0), "rule_without_user_agent")
        return F.struct(line["line"].alias("line"), line["name"].alias("name"), line["value"].alias("value"), group.alias("grp"), error.alias("error"))

    parsed = F.flatten(F.transform("__spans", lambda span, group: F.transform(F.slice("__lines", span["low"] + 1, span["size"]), lambda line: row(line, group))))
    return U.computed_once(rows, {"parsed": parsed}).drop("__lines", "__marks", "__starts", "__spans")


def robots_directives(assets: DataFrame) -> DataFrame:
    rows = robots_lines(assets).select("asset_id", "run_id", "url", F.explode("parsed").alias("d"))
    pattern = c("d.value")
    plain = F.regexp_replace(F.replace(pattern, F.lit("*"), F.lit("")), r"\$$", "")
    specificity = F.when(c("d.name").isin("allow", "disallow"), F.octet_length(plain))
    return rows.select("asset_id", "run_id", "url", c("d.line").alias("line"), c("d.name").alias("name"), pattern.alias("value"), c("d.grp").alias("group_id"), c("d.error").alias("error"), specificity.alias("specificity"))


def robots_state(assets: DataFrame) -> DataFrame:
    """State of a robots file from status, measurement and representation."""
    status, measured = c("status_code"), c("measurement_state")
    html = F.coalesce(c("content"), F.lit("")).rlike(r"(?i)<\s*!doctype\s+html|<\s*html(\s|>)")
    state = (
        F.when(status.isNull() | (measured == "technical_error"), "technical_error").when(measured.isin("rate_limited", "transient", "unstable") | (status == 429) | (status >= 500), "temporarily_unreachable")
        .when(status.isin(404, 410), "absent").when(status.isin(401, 403), "access_restricted").when((status < 200) | (status >= 300), "unexpected_status").when(c("truncated") == 1, "truncated")
        .when(html, "invalid_html_representation").when(F.trim(F.coalesce(c("content"), F.lit(""))) == "", "valid_empty").otherwise("valid")
    )
    rows = assets.withColumn("robots_state", state)
    default = F.when(c("robots_state").isin("absent", "valid_empty"), "allowed").when(c("robots_state") == "valid", "rules_apply").otherwise("unknown")
    return rows.withColumn("crawl_default", default)


def latest_asset(assets: DataFrame) -> DataFrame:
    """Last stored file of a run."""
    fields = [name for name in assets.columns if name != "run_id"]
    return assets.groupBy("run_id").agg(F.max_by(F.struct(*fields), "asset_id").alias("m")).select("run_id", "m.*")


def sitemap_directives(assets: DataFrame) -> DataFrame:
    """Distinct Sitemap lines of a file; only absolute http(s) addresses are valid."""
    rows = robots_directives(assets).where((c("name") == "sitemap") & F.coalesce(c("error"), F.lit("")).eqNullSafe(""))
    absolute = c("value").rlike(r"(?i)^https?://[^/?#\s]+")
    key = F.when(absolute, F.regexp_replace(c("value"), "#.*$", "")).otherwise(F.concat(F.lit("invalid:"), c("value")))
    return rows.groupBy("asset_id", "run_id", "url", key.alias("key")).agg(F.min("line").alias("line"), F.first(absolute).alias("valid")).withColumn(
        "same_host", F.when(c("valid"), U.host(c("key")) == U.host(c("url")))
    )


def bot_policies(assets: DataFrame, paths: Column, bots: tuple[str, ...] = AI_BOTS) -> DataFrame:
    """Policy of every bot per file: chosen groups, blocked paths and status. ``paths`` is an array of tested paths."""
    parsed = robots_lines(assets.withColumn("paths", F.array_distinct(paths)))
    usable = F.filter(c("parsed"), lambda d: d["error"].isNull())
    fatal = F.exists(c("parsed"), lambda d: F.coalesce(d["error"].isin("empty_user_agent", "rule_without_user_agent"), F.lit(False)))
    agents = F.transform(F.filter(usable, lambda d: d["name"] == "user-agent"), lambda d: F.struct(F.lower(d["value"]).alias("agent"), d["grp"].alias("grp")))
    rules = F.transform(
        F.filter(usable, lambda d: d["name"].isin("allow", "disallow") & (d["value"] != "")),
        lambda d: F.struct(
            F.octet_length(F.regexp_replace(F.replace(d["value"], F.lit("*"), F.lit("")), r"\$$", "")).alias("specificity"), (d["name"] == "allow").cast("int").alias("allow"), (-d["line"]).alias("neg_line"), d["grp"].alias("grp"),
            F.concat(
                F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(d["value"], r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*"),
                F.when(d["value"].endswith("$"), F.lit("$")).otherwise(F.lit("")),
            ).alias("pattern"),
        ),
    )
    base = U.computed_once(parsed, {"agents": agents, "rules": rules, "parser_valid": ~fatal})
    rows = base.withColumn("bot", F.explode(F.array(*[F.lit(bot) for bot in bots])))
    groups_of = lambda name: F.transform(F.filter(c("agents"), lambda a: a["agent"] == name), lambda a: a["grp"])
    rows = U.computed_once(rows, {"explicit": groups_of(F.lower(c("bot"))), "wildcard": groups_of(F.lit("*"))})
    source = F.when(F.size("explicit") > 0, "explicit").when(F.size("wildcard") > 0, "wildcard").otherwise("default")
    rows = rows.withColumn("policy_source", source)
    chosen = F.when(c("policy_source") == "explicit", c("explicit")).otherwise(c("wildcard"))
    active = F.filter(c("rules"), lambda rule: F.array_contains(chosen, rule["grp"]))
    rows = U.computed_once(rows, {"active": active})
    # The winner of a path: most specific rule, allow before disallow, then the earlier line.
    verdicts = F.transform(c("paths"), lambda path: F.coalesce(F.array_max(F.filter(c("active"), lambda rule: F.rlike(path, rule["pattern"])))["allow"] == 1, F.lit(True)))
    rows = U.computed_once(rows, {"blocked": F.size(F.filter(verdicts, lambda allowed: ~allowed))})
    status = (
        F.when(~c("parser_valid"), "unclear").when(c("blocked") > 0, "blocked").when((c("policy_source") == "explicit") & (F.size("paths") > 0), "explicitly_allowed").otherwise("implicitly_allowed")
    )
    rows = rows.withColumn("status", status)
    policy = (
        F.when(c("status") == "blocked", F.when(c("policy_source") == "explicit", "blocked_explicitly").otherwise("blocked_by_wildcard")).when(c("status") == "explicitly_allowed", "allowed_explicitly")
        .when(c("policy_source") == "wildcard", "inherited_wildcard_allowed").otherwise("not_mentioned_default_allowed")
    )
    return rows.select("run_id", "asset_id", "bot", "parser_valid", "policy_source", F.size("paths").alias("tested_paths"), c("blocked").alias("blocked_paths"), "status", policy.alias("policy_status"))


def _result(check_id: Column, state: Column, affected: Column) -> list[Column]:
    status = F.when(c("evaluation_state") == "pass", "OK").when(c("evaluation_state") == "fail", "Warning").otherwise("NA")
    return [check_id.alias("check_id"), state.alias("evaluation_state"), status.alias("status"), affected.cast("bigint").alias("affected_count")]


def robots_results(assets: DataFrame, runs: DataFrame) -> DataFrame:
    """Robots presence and the sitemap reference, from the last robots file of each run."""
    state = robots_state(latest_asset(assets))
    valid = sitemap_directives(latest_asset(assets)).groupBy("run_id").agg(F.count_if("valid").alias("valid"))
    rows = runs.select("run_id").join(state.select("run_id", "robots_state"), "run_id", "left").join(valid, "run_id", "left")
    s = c("robots_state")
    present = (
        F.when(s.isNull(), "not_executed").when(s == "technical_error", "technical_error").when(s.isin("temporarily_unreachable", "unexpected_status"), "insufficient_evidence").when(s == "invalid_html_representation", "fail").otherwise("pass")
    )
    listed = (
        F.when(s.isNull(), "not_executed").when(s == "absent", "not_applicable").when(s == "technical_error", "technical_error").when(~s.isin("valid", "valid_empty"), "insufficient_evidence")
        .when(F.coalesce(c("valid"), F.lit(0)) > 0, "pass").otherwise("fail")
    )
    both = F.array(F.struct(F.lit("tech.robots_txt_present").alias("check_id"), present.alias("evaluation_state")), F.struct(F.lit("tech.sitemap_in_robots").alias("check_id"), listed.alias("evaluation_state")))
    long = rows.select("run_id", F.inline(both))
    return long.select("run_id", *_result(c("check_id"), c("evaluation_state"), F.when(c("evaluation_state") == "fail", 1).otherwise(0)))


def bot_results(assets: DataFrame, runs: DataFrame, paths: Column) -> DataFrame:
    """One result per bot, the llms.txt access result and the summary counts, gated by the state of the file."""
    last = robots_state(latest_asset(assets))
    policies = bot_policies(last.withColumn("content", F.when(c("robots_state") == "absent", F.lit("")).otherwise(c("content"))), paths)
    llms = bot_policies(last.withColumn("content", F.when(c("robots_state") == "absent", F.lit("")).otherwise(c("content"))), F.array(F.lit("/llms.txt")))
    s = c("robots_state")
    gate = (
        F.when(s.isNull(), "not_executed").when(c("status_code").isNull(), "technical_error").when(c("provenance_complete") == 0, "insufficient_evidence").when(s == "absent", F.lit(None))
        .when(s == "technical_error", "technical_error").when(~s.isin("valid", "valid_empty"), "insufficient_evidence").when(~F.coalesce(c("parser_valid"), F.lit(True)), "insufficient_evidence")
    )
    base = runs.select("run_id").join(last.select("run_id", "robots_state", "status_code", "provenance_complete"), "run_id", "left")
    named = base.withColumn("bot", F.explode(F.array(*[F.lit(bot) for bot in AI_BOTS])))
    rows = named.join(policies.select("run_id", "bot", "parser_valid", c("status").alias("policy"), "blocked_paths"), ["run_id", "bot"], "left")
    bot_state = F.when(gate.isNotNull(), gate).when(c("policy") == "explicitly_allowed", "pass").otherwise("fail")
    check_id = F.concat(F.lit("geo.robots_mentions_"), F.regexp_replace(F.lower("bot"), "[^a-z0-9]+", "_"))
    bots = rows.withColumn("evaluation_state", bot_state).select("run_id", *_result(check_id, c("evaluation_state"), F.when(c("evaluation_state") == "fail", F.greatest(F.lit(1), c("blocked_paths"))).otherwise(0)))
    access = llms.groupBy("run_id").agg(F.count_if(c("status") == "blocked").alias("blocked"), F.bool_and("parser_valid").alias("parser_valid"))
    open_rows = base.join(access, "run_id", "left")
    txt_state = F.when(gate.isNotNull(), gate).when(c("blocked") > 0, "fail").otherwise("pass")
    files = open_rows.withColumn("evaluation_state", txt_state).select("run_id", *_result(F.lit("geo.robots_blocks_txt_files"), c("evaluation_state"), F.when(c("evaluation_state") == "fail", c("blocked")).otherwise(0)))
    return bots.unionByName(files)


def policy_summary(policies: DataFrame) -> DataFrame:
    status = c("status")
    return policies.groupBy("run_id", "asset_id").agg(
        F.count_if(status == "explicitly_allowed").alias("explicitly_allowed"), F.count_if(status == "implicitly_allowed").alias("implicitly_allowed"), F.count_if(status == "blocked").alias("blocked"), F.count_if(status == "unclear").alias("unclear"),
    )


# --- sitemaps ----------------------------------------------------------------------------------------------------

_PARSED = "document_type string, valid boolean, parse_error string, locations array<string>"


def _parse_document(payload) -> dict:
    """Root type and locations of one sitemap file."""
    raw = payload if isinstance(payload, (bytes, bytearray)) else str(payload or "").encode("utf-8")
    failed = lambda kind, reason: {"document_type": kind, "valid": False, "parse_error": reason, "locations": []}
    if raw[:2] == b"\x1f\x8b":
        try:
            raw = gzip.decompress(raw)
        except (OSError, EOFError):
            return failed("invalid", "gzip_decode_failed")
    text = raw.decode("utf-8", "replace").lstrip("﻿")
    if not text.strip():
        return failed("empty", "empty_document")
    if re.search("<!DOCTYPE", text, re.I):
        return failed("invalid", "doctype_not_allowed")
    try:
        root = ElementTree.fromstring(text.strip())
    except ElementTree.ParseError:
        return failed("html" if re.search(r"<\s*html(\s|>)", text, re.I) else "invalid", "invalid_xml")
    local = lambda element: element.tag.rsplit("}", 1)[-1]
    name = local(root)
    if name not in ("urlset", "sitemapindex"):
        return failed("html" if name == "html" else "unsupported_root", f"unsupported_root:{name}")
    wanted = "url" if name == "urlset" else "sitemap"
    found = [(child.text or "").strip() for entry in root if local(entry) == wanted for child in entry if local(child) == "loc"]
    return {"document_type": name, "valid": True, "parse_error": None, "locations": [text for text in found if text]}


def _parse_batch(payloads: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_parse_document(payload) for payload in payloads], columns=["document_type", "valid", "parse_error", "locations"])


def parse_sitemaps(assets: DataFrame) -> DataFrame:
    """Document type, validity, locations and their counts for every stored sitemap file."""
    parse = F.pandas_udf(_parse_batch, _PARSED)
    rows = assets.withColumn("s", parse("content")).select(*assets.columns, "s.document_type", "s.valid", "s.parse_error", "s.locations")
    count = F.size("locations")
    return rows.withColumns(
        {"location_count": count, "unique_location_count": F.size(F.array_distinct("locations")), "duplicate_location_count": count - F.size(F.array_distinct("locations")), "limit_exceeded": count > SITEMAP_MAX_LOCATIONS}
    )


def reconcile(parsed: DataFrame) -> DataFrame:
    """Class of every listed URL: invalid, external, duplicate or unique. The first occurrence of a run is the unique one."""
    rows = parsed.where((c("document_type") == "urlset") & c("valid")).select("run_id", "asset_id", F.posexplode("locations").alias("pos", "listed"))
    rows = U.computed_once(rows, {"listed_url": U.normalize(c("listed"))})
    inside = U.is_internal(c("listed_url"), c("run_id"))
    first = rows.where(c("listed_url").isNotNull() & inside).groupBy("run_id", "listed_url").agg(F.min(F.struct("asset_id", "pos")).alias("first"))
    joined = rows.join(first, ["run_id", "listed_url"], "left")
    kind = F.when(c("listed_url").isNull(), "invalid").when(~inside, "external").when(c("first") == F.struct("asset_id", "pos"), "unique").otherwise("duplicate")
    return joined.withColumn("listing", kind).drop("first")


def reconciliation_counts(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("run_id", "asset_id").agg(F.count(F.lit(1)).alias("listed"), *[F.count_if(c("listing") == name).alias(name) for name in ("unique", "duplicate", "external", "invalid")])


def planned_urls(reconciled: DataFrame, cap: int, per_template: int | None = None) -> DataFrame:
    """URLs to queue: unique ones in listing order up to the cap, optionally at most ``per_template`` per URL template."""
    rows = reconciled.where(c("listing") == "unique")
    if per_template is not None:
        rows = rows.withColumn("url_pattern", U.url_template(c("listed_url"), F.lit("other")))
        order = Window.partitionBy("run_id", "url_pattern").orderBy("asset_id", "pos")
        rows = rows.withColumn("template_position", F.row_number().over(order)).where(c("template_position") <= per_template)
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy("run_id").orderBy("asset_id", "pos")))
    return ranked.where(c("position") <= cap)


def expand_indexes(parsed: DataFrame) -> DataFrame:
    """Files reachable from the files that no index names, with the level at which each is first reached.

    The references are parsed and stored once. Every level keeps only files not seen before, so cycles end and a file that
    many indexes name is followed once; the walk goes on until a level adds nothing.
    """
    links = stored(
        parsed.where((c("document_type") == "sitemapindex") & c("valid"))
        .select("run_id", F.col("url").alias("parent"), F.explode("locations").alias("child")).where(c("parent") != c("child")).distinct()
    )
    known = stored(parsed.select("run_id", "url", "document_type").dropDuplicates(["run_id", "url"]))
    named = links.select("run_id", F.col("child").alias("url")).distinct()
    reached = stored(known.select("run_id", "url").join(named, ["run_id", "url"], "left_anti").withColumn("level", F.lit(0)))
    level = 0
    while True:
        level += 1
        ahead = reached.where(c("level") == level - 1).select("run_id", F.col("url").alias("parent")).join(links, ["run_id", "parent"])
        fresh = ahead.select("run_id", F.col("child").alias("url")).distinct().join(reached.select("run_id", "url"), ["run_id", "url"], "left_anti")
        fresh = stored(fresh.withColumn("level", F.lit(level)))
        if fresh.isEmpty():
            return known.join(reached, ["run_id", "url"])
        reached = reached.unionByName(fresh)


def sitemap_results(parsed: DataFrame, runs: DataFrame) -> DataFrame:
    """Verdict over all sitemap files of a run."""
    ok = F.coalesce(F.when((c("status_code") >= 200) & (c("status_code") < 300), True), F.lit(False))
    declared = c("source_type") == "robots_sitemap"
    failing = declared & (c("status_code").isNull() | (c("status_code") >= 400))
    counts = parsed.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(ok & c("valid")).alias("valid"), F.count_if(ok & ~c("valid")).alias("invalid"), F.count_if(failing).alias("failing"),
        F.count_if(failing & (c("status_code") >= 400) & (c("status_code") < 500) & (c("status_code") != 429)).alias("definite"), F.count_if(ok & ~c("valid") & declared).alias("invalid_declared"),
        F.count_if(ok & c("valid") & c("limit_exceeded")).alias("over"), F.count_if(failing & (c("status_code").isNull() | (c("status_code") == 429) | (c("status_code") >= 500))).alias("transient"),
    )
    rows = runs.select("run_id").join(counts, "run_id", "left").na.fill(0)
    broken = c("invalid_declared") + c("definite") + c("over")
    state = (
        F.when(c("files") == 0, "not_executed").when((c("valid") > 0) & (broken > 0), "fail").when(c("valid") > 0, "pass").when((c("transient") > 0) & (c("invalid") == 0), "technical_error").otherwise("fail")
    )
    affected = F.when(c("evaluation_state") != "fail", 0).when(c("valid") > 0, broken).when(c("invalid") + c("failing") > 0, c("invalid") + c("failing")).otherwise(1)
    return rows.withColumn("evaluation_state", state).select("run_id", *_result(F.lit("tech.sitemap_present"), c("evaluation_state"), affected))


# --- llms.txt ----------------------------------------------------------------------------------------------------

def analyze_llms(assets: DataFrame) -> DataFrame:
    """Designation, sections, internal targets, encoding and the reasons against a file; a fold over its lines."""
    text = F.regexp_replace(F.coalesce(c("content"), F.lit("")), "^﻿", "")
    heading = r"^\s*(#{1,6})\s+(.+?)\s*#*\s*$"

    def clean(value: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(value, r"[*_`~\[\]]", ""), r"\s+", " "))

    start = F.struct(F.lit(0).alias("level"), F.lit(False).alias("used"), F.lit(0).alias("sections"), F.lit(0).alias("headings"), F.lit(None).cast("string").alias("name"))

    def step(state: Column, line: Column) -> Column:
        marks = F.length(F.regexp_extract(line, heading, 1))
        title = clean(F.regexp_extract(line, heading, 2))
        is_heading = (marks > 0) & (title != "")
        is_text = ~is_heading & (F.trim(line) != "") & ~F.trim(line).startswith("<!--")
        counts = is_text & (state["level"] >= 2) & ~state["used"]
        found = (marks == 1) & is_heading & state["name"].isNull() & ~title.rlike(GENERIC_NAMES)
        return F.struct(
            F.when(is_heading, marks).otherwise(state["level"]).alias("level"), F.when(is_heading, F.lit(False)).otherwise(state["used"] | counts).alias("used"),
            (state["sections"] + counts.cast("int")).alias("sections"), (state["headings"] + is_heading.cast("int")).alias("headings"), F.when(found, title).otherwise(state["name"]).alias("name"),
        )

    folded = F.aggregate(F.split(text, r"\r?\n"), start, step)
    candidates = F.concat(F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\((https?://[^)\s]+|/[^)\s]*)\)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>)\]]+)"), F.lit(1)))
    resolved = F.transform(candidates, lambda ref: F.regexp_replace(U.resolve(F.regexp_replace(ref, "[.,;:!?]+$", ""), c("url")), "#.*$", ""))
    internal = F.array_distinct(F.filter(resolved, lambda ref: ref.isNotNull() & U.is_internal(ref, U.host(c("url")))))
    rows = U.computed_once(assets, {"fold": folded, "internal_urls": F.size(internal)})
    kind = F.lower(F.trim(F.coalesce(c("content_type"), F.lit(""))))
    charset = F.regexp_extract(kind, r"""charset\s*=\s*["']?([^;"'\s]+)""", 1)
    html = F.trim(text).rlike(r"(?i)<\s*!doctype\s+html|<\s*html(\s|>)|<\s*(head|body|title)(\s|>)")
    reasons = F.array_compact(
        F.array(
            F.when(F.trim(text) == "", F.lit("empty_or_whitespace_body")), F.when(html, F.lit("html_or_soft_error_representation")), F.when(~kind.rlike(TEXT_TYPES), F.lit("unsupported_content_type")),
            F.when(~charset.isin("", "utf-8", "utf8"), F.lit("not_valid_utf8")), F.when(c("fold.name").isNull(), F.lit("missing_site_or_project_designation")),
            F.when((c("fold.sections") == 0) & (c("internal_urls") == 0), F.lit("missing_usable_section_or_internal_target")),
        )
    )
    rows = rows.withColumns({"designation": c("fold.name"), "usable_sections": c("fold.sections"), "heading_count": c("fold.headings"), "content_hash": F.sha2(text, 256)})
    return U.computed_once(rows, {"content_reasons": reasons}).drop("fold")


def llms_results(assets: DataFrame, runs: DataFrame) -> DataFrame:
    """Presence and HTTP perspective of the last llms.txt of every run."""
    rows = analyze_llms(latest_asset(assets))
    direct = (c("initial_status") == 200) & (c("final_status") == 200)
    good = direct & (c("measurement_state") == "confirmed") & (F.size("content_reasons") == 0)
    joined = runs.select("run_id").join(rows.withColumn("good", good), "run_id", "left")
    state = (
        F.when(c("asset_id").isNull(), "not_executed").when(c("final_status").isNull() | (c("measurement_state") == "technical_error"), "technical_error")
        .when((c("truncated") == 1) | c("measurement_state").isin("transient", "unstable", "rate_limited", "historical_unknown"), "insufficient_evidence").when(c("good"), "pass").otherwise("fail")
    )
    long = joined.withColumn("evaluation_state", state).withColumn("check_id", F.explode(F.array(F.lit("geo.llms_txt_present"), F.lit("geo.llms_txt_http_status"))))
    return long.select("run_id", *_result(c("check_id"), c("evaluation_state"), F.when(c("evaluation_state") == "fail", 1).otherwise(0)))


def markdown_twins(assets: DataFrame, runs: DataFrame) -> DataFrame:
    """A run passes when one of its text files answers and looks like Markdown or plain text."""
    kind, address = F.lower(F.coalesce(c("content_type"), F.lit(""))), F.lower(c("url"))
    content = F.trim(F.coalesce(c("content"), F.lit("")))
    looks = content.rlike(r"(?m)^#\s|^- |\[[^\]\n]+\]\([^)\n]+\)") | ~content.rlike(r"(?i)<html[\s>]")
    text = F.when(kind.rlike("text/markdown|text/plain|application/markdown"), True).when(kind.contains("text/html"), False).when(address.rlike(r"\.(md|markdown|txt)([?#]|$)"), looks).otherwise(False)
    found = assets.groupBy("run_id").agg(F.count_if((c("final_status") >= 200) & (c("final_status") < 300) & text).alias("twins"))
    rows = runs.select("run_id").join(found, "run_id", "left").na.fill(0).withColumn("evaluation_state", F.when(c("twins") > 0, "pass").otherwise("fail"))
    return rows.select("run_id", *_result(F.lit("geo.markdown_twin_homepage"), c("evaluation_state"), F.when(c("twins") > 0, 0).otherwise(1)))


def text_references(assets: DataFrame, links: DataFrame, resources: DataFrame, needle: str) -> DataFrame:
    """Files, links and resources that mention a file name."""
    parts = [
        assets.where(F.lower(c("content")).contains(needle)).select("run_id", F.lit("asset").alias("source"), F.col("url").alias("source_url")),
        links.where(F.lower(c("target_url")).contains(needle)).select("run_id", F.lit("html_link").alias("source"), "source_url"),
        resources.where(F.lower(c("resource_url")).contains(needle)).select("run_id", F.lit("resource").alias("source"), F.col("page_url").alias("source_url")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
