"""Schema.org type names and family membership."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: direct parents of the types that the checks know
TYPE_PARENTS = {
    "Article": ("CreativeWork",),
    "BlogPosting": ("SocialMediaPosting", "Article"),
    "LiveBlogPosting": ("BlogPosting", "Article"),
    "NewsArticle": ("Article",),
    "TechArticle": ("Article",),
    "ScholarlyArticle": ("Article",),
    "Report": ("Article",),
    "Review": ("CreativeWork",),
    "SocialMediaPosting": ("Article",),
    "Product": ("Thing",),
    "ProductGroup": ("Product",),
    "IndividualProduct": ("Product",),
    "ProductModel": ("Product",),
    "SomeProducts": ("Product",),
    "Organization": ("Thing",),
    "Corporation": ("Organization",),
    "LocalBusiness": ("Organization", "Place"),
    "Person": ("Thing",),
    "BreadcrumbList": ("ItemList",),
    "WebSite": ("CreativeWork",),
    "WebPage": ("CreativeWork",),
    "CollectionPage": ("WebPage",),
    "ProfilePage": ("WebPage",),
    "FAQPage": ("WebPage",),
}


def family(name: str) -> tuple[str, ...]:
    """The type and every known type below it."""
    members = {name}
    grown = True
    while grown:
        below = {child for child, parents in TYPE_PARENTS.items() if members.intersection(parents)}
        grown = not below <= members
        members |= below
    return tuple(sorted(members))


def type_name(value: Column) -> Column:
    """Name without a schema.org prefix; NULL for blank input."""
    text = F.trim(value)
    local = F.regexp_extract(text, r"^(?:https?://schema\.org/|schema:)([^/#?]+)/?$", 1)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(None)).when(
        local != "", F.coalesce(F.try_url_decode(local), local)
    ).otherwise(text)


def in_family(types: Column, name: str) -> Column:
    """True when an array of type names holds a member of the family."""
    return F.arrays_overlap(F.coalesce(types, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in family(name)]))
