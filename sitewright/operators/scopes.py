"""Named row scopes that most checks share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

c = F.col


def is_html() -> Column:
    kind = F.lower(c("content_type"))
    return kind.contains("text/html") | kind.contains("application/xhtml")


def between(column: Column, low: int, high: int) -> Column:
    return (column >= low) & (column < high)


def successful_html() -> Column:
    first = F.coalesce(c("initial_status_code"), c("status_code"))
    return is_html() & between(c("status_code"), 200, 300) & between(first, 200, 300)


def page_type() -> Column:
    return F.coalesce(c("page_type"), F.lit("other"))


def content_html() -> Column:
    """Successful, indexable HTML that is not a legal page."""
    return successful_html() & (c("indexable") == 1) & (page_type() != "legal")


def complete_state() -> Column:
    return F.coalesce(c("metadata_complete"), F.lit(0)) == 1


def blank(column: Column) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def has_text_facts() -> Column:
    return F.coalesce(c("text_facts"), F.lit(0)) == 1


def settled() -> Column:
    return (c("render_status") == "success") & c("settling_status").isin("settled", "content_remained_empty")


def robots_text() -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(c("meta_robots"), F.lit("")), F.coalesce(c("x_robots_tag"), F.lit(""))))


def non_decorative_image() -> Column:
    flags = [F.coalesce(c(name), F.lit(0)) == 0 for name in ("decorative", "badge", "pixel", "icon")]
    return flags[0] & flags[1] & flags[2] & flags[3]


def decorative_image() -> Column:
    return ~non_decorative_image()


def _size(name: str) -> Column:
    return F.coalesce(F.regexp_extract(c(name), r"^\s*(\d{1,9})", 1).try_cast("int"), F.lit(0))


def not_small_image() -> Column:
    unknown = F.coalesce(c("width"), F.lit("")).eqNullSafe("") | F.coalesce(c("height"), F.lit("")).eqNullSafe("")
    return unknown | (_size("width") > 64) | (_size("height") > 64)


def not_hero_image() -> Column:
    address = F.lower(F.coalesce(c("image_url"), F.lit("")))
    named = address.contains("hero") | address.contains("masthead") | address.contains("banner")
    return (F.coalesce(c("image_role"), F.lit("")) != "hero") & ~named
