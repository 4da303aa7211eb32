"""Text functions: head keys, visible words, token similarity, patterns, hashes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; both ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def _nfkc_batch(values: pd.Series) -> pd.Series:
    return values.map(lambda text: unicodedata.normalize("NFKC", text) if isinstance(text, str) else text)


def compatibility_form(text: Column) -> Column:
    """Unicode NFKC form, the one text rule without a built-in expression. ASCII texts are their own form and stay in the JVM."""
    other = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(F.pandas_udf(_nfkc_batch, "string")(other), text)


def head_text(text: Column) -> Column:
    """Comparable head value: compatibility forms folded, white space collapsed."""
    return collapse(compatibility_form(text))


def head_key(text: Column) -> Column:
    return F.lower(head_text(text))


def visible_words(text: Column) -> Column:
    """Words of letters, digits, apostrophes and hyphens that start and end at a word boundary."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    return F.regexp_count(clean, F.lit(r"(?U)\b[\p{L}\p{N}'-]+\b")).cast("bigint")


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of three or more letters (German alphabet) or digits."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9äöüß]+", " ")
    return F.array_distinct(F.filter(F.split(plain, " "), lambda word: F.length(word) >= 3))


def token_similarity(left: Column, right: Column) -> Column:
    """Shared distinct tokens over the larger token count."""
    a, b = tokens(left), tokens(right)
    larger = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / larger
    )


def text_pattern(text: Column) -> Column:
    """Shape of a text: numbers and hashes replaced, punctuation dropped; NULL for blank text."""
    low = F.lower(F.trim(text))
    masked = F.regexp_replace(F.regexp_replace(low, "[0-9]+", "{num}"), "[a-f0-9]{8,}", "{hash}")
    shape = F.trim(F.regexp_replace(masked, r"[^\p{L}\p{N}{}]+", " "))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", shape)


def short_hash(text: Column) -> Column:
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.left(F.sha1(F.trim(text)), F.lit(16)))
