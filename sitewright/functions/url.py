"""URL functions as Catalyst expressions: resolve, normalise, host facts, templates and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.config import (
    FONT_EXTENSIONS,
    IMAGE_EXTENSIONS,
    MULTI_LABEL_SUFFIXES,
    NON_PAGE_EXTENSIONS,
    TRACKING_PARAMS,
)

_PARTS = r"(?is)^(https?):[/\\]{2}([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_SCHEME = r"(?i)^[a-z][a-z0-9+.\-]*:"


def let(value: Column, body) -> Column:
    """Bind a value once for an expression that uses it many times, so that plans stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a generator, so that later filters and projections read them instead of repeating them.

    The optimizer copies an expensive expression into every filter and projection that names it; it does not look
    through a generator. ``inline`` over one struct yields exactly one row per input row.
    """
    struct = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.drop(*columns).select("*", F.inline(F.array(struct)))


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Host with a non-default port, lower case and without user info."""
    host = F.lower(F.regexp_replace(_part(url, 2), "^.*@", ""))
    return (
        F.when(scheme(url) == "http", F.regexp_replace(host, ":(80)?$", ""))
        .when(scheme(url) == "https", F.regexp_replace(host, ":(443)?$", ""))
        .otherwise(host)
    )


def host(url: Column) -> Column:
    return F.nullif(F.regexp_replace(authority(url), r":\d+$", ""), F.lit(""))


def origin(url: Column) -> Column:
    return F.when(scheme(url) != "", F.concat(scheme(url), F.lit("://"), authority(url)))


def path(url: Column) -> Column:
    raw = _part(url, 3)
    return F.when(scheme(url) == "", F.lit(None)).otherwise(F.when(raw == "", F.lit("/")).otherwise(raw))


def query(url: Column) -> Column:
    return F.regexp_replace(_part(url, 4), r"^\?", "")


def resolve(href: Column, base: Column) -> Column:
    """Absolute http(s) URL of an authored reference; NULL for other schemes and invalid input."""

    def against(ref: Column) -> Column:
        directory = F.regexp_replace(path(base), "[^/]*$", "")
        return (
            F.when(ref.isNull() | (ref == ""), F.lit(None))
            .when(ref.rlike(r"(?i)^https?:[/\\]{2}"), ref)
            .when(ref.rlike(_SCHEME), F.lit(None))
            .when(scheme(base) == "", F.lit(None))
            .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
            .when(ref.startswith("/"), F.concat(origin(base), ref))
            .when(ref.startswith("?"), F.concat(origin(base), path(base), ref))
            .when(ref.startswith("#"), F.concat(origin(base), path(base), _part(base, 4)))
            .otherwise(F.concat(origin(base), directory, ref))
        )

    return let(F.trim(href), against)


def _without_dots(raw: Column) -> Column:
    folded = F.aggregate(
        F.split(raw, "/"),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part == ".", acc)
        .when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(part))),
    )
    closed = F.concat(F.array_join(folded, "/"), F.when(raw.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit("")))
    return F.when(raw.rlike(r"(^|/)\.{1,2}(/|$)"), closed).otherwise(raw)


def _escaped(text: Column) -> Column:
    unsafe = r'[^!-~]|["<>`{}]'
    letters = F.transform(
        F.split(text, ""),
        lambda ch: F.when(ch.rlike(f"^({unsafe})$"), F.regexp_replace(F.url_encode(ch), r"\+", "%20")).otherwise(ch),
    )
    return F.when(text.rlike(unsafe), F.array_join(letters, "")).otherwise(text)


def _clean_path(raw: Column, keep_trailing_slash: bool) -> Column:
    """Dot segments removed, unsafe characters escaped, runs of slashes collapsed."""

    def finish(text: Column) -> Column:
        if keep_trailing_slash:
            return text
        return F.when(F.regexp_replace(text, "/+$", "") == "", F.lit("/")).otherwise(F.regexp_replace(text, "/+$", ""))

    plain = let(F.regexp_replace(raw, r"\\", "/"), _without_dots)
    return let(F.regexp_replace(let(plain, _escaped), "/{2,}", "/"), finish)


def _clean_query(raw: Column) -> Column:
    """Tracking keys dropped, pairs sorted by key (stable) and re-serialised."""
    tracking = [F.lit(name) for name in TRACKING_PARAMS]

    def recode(text: Column) -> Column:
        return F.url_encode(F.coalesce(F.try_url_decode(text), text))

    pairs = F.transform(
        F.filter(F.split(raw, "&"), lambda piece: piece != ""),
        lambda piece, index: F.struct(
            recode(F.regexp_extract(piece, "(?s)^([^=]*)", 1)).alias("k"),
            index.alias("i"),
            recode(F.regexp_extract(piece, "(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda pair: ~F.lower(pair["k"]).isin(*tracking))
    text = F.array_join(F.transform(F.array_sort(kept), lambda pair: F.concat(pair["k"], F.lit("="), pair["v"])), "&")
    marked = let(text, lambda joined: F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined)))
    return F.when(raw == "", F.lit("")).otherwise(marked)


def normalize(url: Column, base: Column | None = None, keep_trailing_slash: bool = False) -> Column:
    """Page identity of a URL; with ``keep_trailing_slash`` the form that is requested."""

    def rebuild(absolute: Column) -> Column:
        text = F.concat(origin(absolute), _clean_path(path(absolute), keep_trailing_slash), _clean_query(query(absolute)))
        return F.when(absolute.rlike(r"(?is)^https?:[/\\]{2}[^/?#\\]"), text)

    return let(resolve(url, base) if base is not None else F.trim(url), rebuild)


def canonical_comparable(url: Column, base: Column | None = None) -> Column:
    """Normalised URL with unreserved percent escapes decoded and the others in upper case."""

    def decode(normal: Column) -> Column:
        pieces = F.transform(
            F.regexp_extract_all(normal, F.lit(r"(?s)(%[0-9A-Fa-f]{2}|.)"), F.lit(1)),
            lambda piece: F.when(
                piece.rlike(r"(?i)^%(2d|2e|5f|7e|3[0-9]|4[1-9a-f]|5[0-9a]|6[1-9a-f]|7[0-9a])$"), F.url_decode(piece)
            )
            .when(piece.rlike("(?i)^%[0-9a-f]{2}$"), F.upper(piece))
            .otherwise(piece),
        )
        return F.when(normal.contains("%"), F.array_join(pieces, "")).otherwise(normal)

    return let(normalize(url, base), decode)


def strip_www(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"^www\.", "")


def is_internal(url: Column, site_host: Column) -> Column:
    return F.coalesce(strip_www(host(url)) == strip_www(site_host), F.lit(False))


def registrable_domain(name: Column) -> Column:
    """Apex of a host by the suffix table; hosts under unknown suffixes keep their last two labels."""
    clean = F.regexp_replace(F.lower(F.trim(name)), r"\.$", "")
    labels = F.split(clean, r"\.")
    last_two = F.concat_ws(".", F.slice(labels, -2, 2))
    return (
        F.when(F.size(labels) < 2, F.lit(None))
        .when(last_two.isin(*MULTI_LABEL_SUFFIXES) & (F.size(labels) < 3), F.lit(None))
        .when(last_two.isin(*MULTI_LABEL_SUFFIXES), F.concat_ws(".", F.slice(labels, -3, 3)))
        .otherwise(last_two)
    )


def host_relation(requested: Column, candidate: Column) -> Column:
    left = F.regexp_replace(F.lower(F.trim(requested)), r"\.$", "")
    right = F.regexp_replace(F.lower(F.trim(candidate)), r"\.$", "")
    different = F.lit("different_registrable_domain")
    return (
        F.when(F.coalesce(left, F.lit("")).eqNullSafe("") | F.coalesce(right, F.lit("")).eqNullSafe(""), different)
        .when(left == right, F.lit("same"))
        .when(strip_www(left) == strip_www(right), F.lit("www_variant"))
        .when(registrable_domain(left) == registrable_domain(right), F.lit("subdomain"))
        .otherwise(different)
    )


def canonical_relationship(canonical: Column, primary: Column) -> Column:
    def relate(left: Column, right: Column) -> Column:
        return (
            F.when(left.isNull() | right.isNull(), F.lit("invalid_url"))
            .when(left == right, F.lit("same_host"))
            .when(strip_www(left) == strip_www(right), F.lit("www_host_variant"))
            .when(
                F.coalesce(registrable_domain(left), left) == F.coalesce(registrable_domain(right), right),
                F.lit("same_registrable_domain_subdomain"),
            )
            .otherwise(F.lit("cross_registrable_domain"))
        )

    return let(F.struct(host(canonical).alias("l"), host(primary).alias("r")), lambda pair: relate(pair["l"], pair["r"]))


def extension(url: Column) -> Column:
    return F.regexp_extract(F.lower(path(url)), r"(\.[a-z0-9]{1,8})$", 1)


def resource_type(url: Column) -> Column:
    ext = extension(url)
    return (
        F.when(ext.isin(*IMAGE_EXTENSIONS), F.lit("image"))
        .when(ext == ".css", F.lit("stylesheet"))
        .when(ext == ".js", F.lit("script"))
        .when(ext.isin(*FONT_EXTENSIONS), F.lit("font"))
        .otherwise(F.lit("other"))
    )


def is_likely_page(url: Column) -> Column:
    return ~F.coalesce(extension(url), F.lit("")).isin(*NON_PAGE_EXTENSIONS)


# fixed values: first path segments that are kept as they are in a URL template
STATIC_ROOTS = (
    "blog", "magazin", "ratgeber", "wissen", "news", "shop", "c", "p", "store", "stores", "produkt", "produkte",
    "product", "products", "category", "kategorie", "standorte", "locations", "de", "en",
)


def url_template(url: Column, page_type: Column) -> Column:
    """Path with variable segments replaced by placeholders; the last one depends on the page type."""
    parts = F.filter(F.split(path(url), "/"), lambda part: part != "")
    decoded = F.transform(
        parts,
        lambda part: F.coalesce(F.try_url_decode(F.regexp_replace(part, r"\+", "%2B")), part),
    )
    count = F.size(decoded)
    tail = (
        F.when(page_type == "location", F.lit("{city}"))
        .when(page_type == "category", F.lit("{category}"))
        .otherwise(F.lit("{slug}"))
    )

    def token(part: Column, index: Column) -> Column:
        low = F.lower(part)
        return (
            F.when(low.rlike("^([0-9]+|[a-f0-9]{8,})$"), F.lit("{id}"))
            .when(low.rlike("^[a-z0-9]{10,}$") & low.rlike("[0-9]"), F.lit("{id}"))
            .when(low.rlike("^[a-z]{2}(-[a-z]{2})?$"), low)
            .when((index == 0) & low.isin(*STATIC_ROOTS), low)
            .when(index == count - 1, tail)
            .when((count >= 3) & (index == count - 2), F.lit("{subcategory}"))
            .otherwise(F.lit("{category}"))
        )

    return F.when(F.coalesce(count, F.lit(0)) <= 0, F.lit("/")).otherwise(
        F.concat(F.lit("/"), F.array_join(F.transform(decoded, token), "/"))
    )


def shard(url: Column, shards: int) -> Column:
    """Shard of a URL: 32-bit FNV-1a over host and first path segment, modulo the shard count."""
    first = F.regexp_extract(path(url), "^/([^/]*)", 1)
    key = F.coalesce(F.concat(host(url), F.lit("/"), F.lower(first)), F.lit("unknown/"))
    offset, prime, mask = 2166136261, 16777619, 4294967295
    hashed = F.aggregate(
        F.filter(F.split(key, ""), lambda ch: ch != ""),
        F.lit(offset).cast("bigint"),
        lambda acc, ch: (acc.bitwiseXOR(F.ascii(ch).cast("bigint")) * F.lit(prime).cast("bigint")).bitwiseAND(
            F.lit(mask).cast("bigint")
        ),
    )
    return F.when(F.lit(shards) <= 1, F.lit(0)).otherwise((hashed % shards).cast("int"))
