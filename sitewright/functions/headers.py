"""HTTP header policies as expressions over a header map.

Each function takes a map of lower-case header name to value and gives the state of one policy as a text column.
``passes`` and ``severity`` derive from the state, so the parsing is written (and evaluated) once per header.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewright.config import THRESHOLDS

# fixed values: token lists and limits of the policies
REFERRER_VALUES = (
    "no-referrer", "no-referrer-when-downgrade", "origin", "origin-when-cross-origin", "same-origin",
    "strict-origin", "strict-origin-when-cross-origin", "unsafe-url",
)
REFERRER_UNSAFE = ("unsafe-url", "no-referrer-when-downgrade")
SENSITIVE_FEATURES = ("camera", "geolocation", "microphone", "payment", "usb")
RESOURCE_DIRECTIVES = ("default-src", "script-src", "object-src", "style-src", "img-src", "connect-src")
EMBEDDER = (("require-corp", "credentialless", "unsafe-none"), ("require-corp", "credentialless"))
OPENER = (("same-origin", "same-origin-allow-popups", "unsafe-none"), ("same-origin", "same-origin-allow-popups"))
RESOURCE = (("same-origin", "same-site", "cross-origin"), ("same-origin", "same-site"))
COMPRESSIBLE = r"(^text/|javascript|json|xml|svg)"


def header_bag(headers: Column) -> Column:
    """Trimmed lower-case names, trimmed values, no empty names and no NULL values."""
    entries = F.filter(
        F.map_entries(headers), lambda entry: (F.trim(entry["key"]) != "") & entry["value"].isNotNull()
    )
    return F.map_from_entries(
        F.transform(entries, lambda entry: F.struct(F.lower(F.trim(entry["key"])), F.trim(entry["value"])))
    )


def header(headers: Column, name: str) -> Column:
    """Value of one header; NULL when it is absent or blank."""
    return F.nullif(F.trim(F.try_element_at(headers, F.lit(name))), F.lit(""))


def _tokens(text: Column, pattern: str, fold=F.lower) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), pattern)
    return F.filter(F.transform(parts, lambda part: fold(F.trim(part))), lambda part: part != "")


# fixed values: states that pass and states that weigh more than a low severity
PASSING = (
    "protected", "configured", "protected_by_csp", "protected_by_xfo", "html_no_store_observed", "html_revalidation",
    "html_revalidation_observed", "html_policy_unspecified", "compressed",
)
MEDIUM = ("dangerously_weak", "dangerously_open")


def passes(state: Column) -> Column:
    return state.isin(*PASSING)


def severity(state: Column) -> Column:
    return (
        F.when(state.isin(*MEDIUM), F.lit("Medium"))
        .when(state.isin(*PASSING, "not_applicable", "insufficient_evidence"), F.lit("Info"))
        .otherwise(F.lit("Low"))
    )


def _state(rows: list[tuple[Column | None, str]]) -> Column:
    """State of the first matching row; the last row has no condition."""
    column = None
    for condition, name in rows:
        if condition is None:
            return F.lit(name) if column is None else column.otherwise(F.lit(name))
        column = F.when(condition, F.lit(name)) if column is None else column.when(condition, F.lit(name))
    return column


def _csp_policies(text: Column) -> Column:
    """Array of policies; a policy is an array of (name, sources) in written order."""
    return F.transform(
        _tokens(text, ",", fold=lambda part: part),
        lambda policy: F.transform(
            _tokens(policy, ";", fold=lambda part: part),
            lambda part: F.struct(
                F.lower(F.try_element_at(F.split(part, r"\s+"), F.lit(1))).alias("name"),
                F.slice(F.split(part, r"\s+"), F.lit(2), F.greatest(F.size(F.split(part, r"\s+")) - 1, F.lit(0))).alias("sources"),
            ),
        ),
    )


def _sources(policy: Column, name: str) -> Column:
    return F.get(F.filter(policy, lambda part: part["name"] == name), F.lit(0))["sources"]


def _policy_errors(policy: Column) -> Column:
    names = F.transform(policy, lambda part: part["name"])
    return (
        (F.size(policy) == 0)
        | F.exists(names, lambda name: ~name.rlike("^[a-z][a-z0-9-]*$"))
        | (F.size(names) != F.size(F.array_distinct(names)))
    )


def _severe(policy: Column) -> Column:
    executable = F.coalesce(_sources(policy, "script-src"), _sources(policy, "default-src"), F.array().cast("array<string>"))
    objects = F.coalesce(_sources(policy, "object-src"), F.array().cast("array<string>"))
    nonce = F.exists(executable, lambda token: token.rlike("^'(nonce-|sha256-|sha384-|sha512-)"))
    return (
        F.array_contains(executable, "'unsafe-eval'")
        | (F.array_contains(executable, "'unsafe-inline'") & ~nonce)
        | F.array_contains(executable, "*")
        | F.array_contains(objects, "*")
    )


def frame_ancestors(headers: Column) -> Column:
    policies = _csp_policies(header(headers, "content-security-policy"))
    return F.flatten(
        F.transform(policies, lambda policy: F.coalesce(_sources(policy, "frame-ancestors"), F.array().cast("array<string>")))
    )


def content_security_policy(headers: Column) -> Column:
    enforced = _csp_policies(header(headers, "content-security-policy"))
    report = header(headers, "content-security-policy-report-only")
    errors = F.exists(enforced, _policy_errors)
    protects = F.exists(
        enforced, lambda policy: F.exists(policy, lambda part: part["name"].isin(*RESOURCE_DIRECTIVES))
    )
    none = F.size(enforced) == 0
    return _state(
        [
            (none & report.isNotNull(), "report_only"),
            (none, "missing"),
            (errors, "invalid"),
            (~protects, "incomplete_protection"),
            (F.exists(enforced, _severe), "dangerously_weak"),
            (None, "protected"),
        ]
    )


def permissions_policy(headers: Column) -> Column:
    text = header(headers, "permissions-policy")
    # Commas inside an allow list or inside quotes do not separate directives.
    pieces = F.filter(
        F.transform(
            F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"((?:\([^)]*\)|\"[^\"]*\"|'[^']*'|[^,(])+)"), F.lit(1)),
            lambda piece: F.trim(piece),
        ),
        lambda piece: piece != "",
    )
    directive = r"(?i)^([a-z][a-z0-9-]*)\s*=\s*\((.*)\)$"
    parsed = F.transform(
        pieces,
        lambda piece: F.struct(
            F.lower(F.regexp_extract(piece, directive, 1)).alias("feature"),
            F.regexp_extract_all(F.regexp_extract(piece, directive, 2), F.lit(r"(\"[^\"]*\"|'[^']*'|\S+)"), F.lit(1)).alias("allow"),
        ),
    )
    token_ok = lambda token: (
        token.isin("*", "self", "'self'")
        | F.regexp_replace(token, '^"|"$', "").rlike(r"(?i)^https?://[^\s/]+(:\d+)?$")
    )
    bad = F.exists(parsed, lambda part: (part["feature"] == "") | ~F.forall(part["allow"], token_ok))
    opened = F.exists(
        parsed, lambda part: part["feature"].isin(*SENSITIVE_FEATURES) & F.array_contains(part["allow"], "*")
    )
    return _state(
        [
            (text.isNull(), "missing"),
            (bad | (F.size(parsed) == 0), "invalid"),
            (opened, "dangerously_open"),
            (None, "configured"),
        ]
    )


def referrer_policy(headers: Column) -> Column:
    text = header(headers, "referrer-policy")
    values = _tokens(text, ",")
    known = F.array(*[F.lit(value) for value in REFERRER_VALUES])
    invalid = F.size(F.array_except(values, known)) > 0
    effective = F.try_element_at(values, F.lit(-1))
    return _state(
        [
            (text.isNull(), "missing"),
            ((F.size(values) == 0) | invalid, "invalid"),
            (effective.isin(*REFERRER_UNSAFE), "unsafe"),
            (None, "configured"),
        ]
    )


def content_type_options(headers: Column) -> Column:
    values = _tokens(header(headers, "x-content-type-options"), ",")
    return _state(
        [
            (F.size(values) == 0, "missing"),
            (F.exists(values, lambda value: value != "nosniff"), "invalid"),
            (None, "protected"),
        ]
    )


def frame_protection(headers: Column) -> Column:
    ancestors = frame_ancestors(headers)
    values = _tokens(header(headers, "x-frame-options"), ",", fold=F.upper)
    valid = (
        (F.size(values) > 0)
        & F.forall(values, lambda value: value.isin("DENY", "SAMEORIGIN"))
        & (F.size(F.array_distinct(values)) == 1)
    )
    return _state(
        [
            ((F.size(ancestors) > 0) & F.array_contains(ancestors, "*"), "unprotected"),
            (F.size(ancestors) > 0, "protected_by_csp"),
            (valid, "protected_by_xfo"),
            (F.size(values) > 0, "invalid"),
            (None, "missing"),
        ]
    )


def transport_security(headers: Column, url: Column, minimum: int = THRESHOLDS.hsts_min_age) -> Column:
    text = header(headers, "strict-transport-security")
    parts = F.transform(
        _tokens(text, ";", fold=lambda part: part),
        lambda part: F.struct(
            F.lower(F.regexp_extract(part, "^([^=]*)", 1)).alias("name"),
            F.trim(F.regexp_extract(part, "^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )
    names = F.transform(parts, lambda part: part["name"])
    age_text = F.get(F.filter(parts, lambda part: part["name"] == "max-age"), F.lit(0))["value"]
    age = F.when(age_text.rlike(r"^\d+$"), age_text.try_cast("decimal(38,0)"))
    repeated = F.size(names) != F.size(F.array_distinct(names))
    return _state(
        [
            (F.coalesce(url, F.lit("")).rlike(".") & ~url.startswith("https://"), "not_applicable"),
            (text.isNull(), "missing"),
            (repeated | age.isNull(), "invalid"),
            (age == 0, "disabled"),
            (age < minimum, "too_short"),
            (None, "protected"),
        ]
    )


def _enumerated(headers: Column, name: str, rule: tuple[tuple[str, ...], tuple[str, ...]]) -> Column:
    allowed, protective = rule
    values = _tokens(header(headers, name), ",")
    bad = F.exists(values, lambda value: ~value.isin(*allowed)) | (F.size(F.array_distinct(values)) > 1)
    return (
        F.when(F.size(values) == 0, F.lit("not_configured"))
        .when(bad, F.lit("invalid_or_conflicting"))
        .when(F.get(values, F.lit(0)).isin(*protective), F.lit("protective"))
        .otherwise(F.lit("permissive"))
    )


def cross_origin_policies(headers: Column) -> Column:
    return F.struct(
        _enumerated(headers, "cross-origin-embedder-policy", EMBEDDER).alias("embedder"),
        _enumerated(headers, "cross-origin-opener-policy", OPENER).alias("opener"),
        _enumerated(headers, "cross-origin-resource-policy", RESOURCE).alias("resource"),
    )


def _cache_directives(headers: Column) -> Column:
    return F.transform(
        _tokens(header(headers, "cache-control"), ",", fold=lambda part: part),
        lambda part: F.struct(
            F.lower(F.regexp_extract(part, "^([^=]*)", 1)).alias("name"),
            F.trim(F.regexp_replace(F.regexp_extract(part, "^[^=]*=(.*)$", 1), '^"|"$', "")).alias("value"),
        ),
    )


def _age(parts: Column, name: str) -> Column:
    value = F.try_element_at(F.filter(parts, lambda part: part["name"] == name), F.lit(-1))["value"]
    return F.when(value.rlike(r"^\d+$"), value.try_cast("bigint"))


def cache_ttl(headers: Column) -> Column:
    """Shared age before private age, in seconds."""
    parts = _cache_directives(headers)
    return F.coalesce(_age(parts, "s-maxage"), _age(parts, "max-age"))


def cache_policy(headers: Column, kind: Column, personalized: Column | None = None) -> Column:
    """Cache state of a response; ``kind`` is ``html`` or ``static``."""
    parts = _cache_directives(headers)
    names = F.transform(parts, lambda part: part["name"])
    validator = header(headers, "etag").isNotNull() | header(headers, "last-modified").isNotNull()
    silent = header(headers, "cache-control").isNull() & header(headers, "expires").isNull() & ~validator
    never = (
        F.array_contains(names, "no-store")
        | F.coalesce(_age(parts, "max-age") == 0, F.lit(False))
        | F.coalesce(_age(parts, "s-maxage") == 0, F.lit(False))
    )
    revalidate = F.array_contains(names, "no-cache")
    static, html = kind == "static", kind == "html"
    repeated = F.size(names) != F.size(F.array_distinct(names))
    return _state(
        [
            (personalized if personalized is not None else F.lit(False), "not_applicable"),
            (static & (never | revalidate), "static_uncacheable"),
            (static & silent, "static_policy_missing"),
            (html & F.array_contains(names, "no-store"), "html_no_store_observed"),
            (html & revalidate & validator, "html_revalidation"),
            (html & revalidate, "html_revalidation_observed"),
            (html & silent, "html_policy_unspecified"),
            (repeated, "invalid"),
            (None, "configured"),
        ]
    )


def compression(headers: Column, content_type: Column, body_bytes: Column, minimum: int = THRESHOLDS.compression_min_bytes) -> Column:
    kind = F.lower(F.coalesce(F.nullif(content_type, F.lit("")), header(headers, "content-type"), F.lit("")))
    encoding = F.lower(F.coalesce(header(headers, "content-encoding"), F.lit("")))
    return _state(
        [
            (~kind.rlike(COMPRESSIBLE), "not_applicable"),
            (body_bytes.isNull(), "insufficient_evidence"),
            (body_bytes < minimum, "not_applicable"),
            (~encoding.rlike(r"\b(gzip|br|zstd)\b"), "uncompressed"),
            (None, "compressed"),
        ]
    )
