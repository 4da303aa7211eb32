import pytest
from pyspark.sql import functions as F

from sitewright.functions import headers as H
from sitewright.functions import http as HT
from sitewright.functions import misc as MI
from sitewright.functions import page_type as PT
from sitewright.functions import text as TX
from sitewright.functions import url as U
from sitewright.functions.schema_types import family, type_name

c = F.col


def values(spark, rows, schema, *columns):
    return [tuple(row) for row in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    "href,base,expected",
    [
        ("/Page/?utm_source=x&b=2&a=1#frag", "https://Example.com/base/", "https://example.com/Page?a=1&b=2"),
        ("mailto:a@b", "https://example.com/", None),
        ("../x/./y", "https://example.com/a/b/c", "https://example.com/a/x/y"),
        ("//cdn.test//a//b", "https://example.com/", "https://cdn.test/a/b"),
        ("?q=1", "https://example.com/a/", "https://example.com/a?q=1"),
        ("http://example.com:80/", "https://example.com/", "http://example.com/"),
        ("/für", "https://example.com/", "https://example.com/f%C3%BCr"),
    ],
)
def test_normalize(spark, href, base, expected):
    assert values(spark, [(href, base)], "href string, base string", U.normalize(c("href"), c("base"))) == [(expected,)]


def test_request_form_keeps_the_slash(spark):
    assert values(spark, [("https://e.com/a/",)], "u string", U.normalize(c("u"), keep_trailing_slash=True), U.normalize(c("u"))) == [("https://e.com/a/", "https://e.com/a")]


def test_template_and_hosts(spark):
    rows = [("https://e.com/blog/a-post", "article"), ("https://e.com/de/123", "other"), ("https://e.com/c/shoes/red/x", "category"), ("https://e.com/", "homepage")]
    assert [r[0] for r in values(spark, rows, "u string, t string", U.url_template(c("u"), c("t")))] == ["/blog/{slug}", "/de/{id}", "/c/{category}/{subcategory}/{category}", "/"]
    hosts = [("www.example.co.uk", "example.co.uk"), ("docs.example.co.uk", "example.co.uk"), ("a.com", "b.com"), ("a.com", "a.com")]
    assert [r[0] for r in values(spark, hosts, "a string, b string", U.host_relation(c("a"), c("b")))] == ["www_variant", "subdomain", "different_registrable_domain", "same"]


def test_canonical_comparable(spark):
    assert values(spark, [("https://e.com/%7ea/%2fb%c3",)], "u string", U.canonical_comparable(c("u"))) == [("https://e.com/~a/%2Fb%C3",)]


@pytest.mark.parametrize(
    "outcomes,expected",
    [("404", "confirmed"), ("503", "insufficient_evidence"), ("503,503", "confirmed"), ("503,200", "transient"), ("timeout", "technical_error"), ("", "insufficient_evidence"), ("200,200,200,200,200,timeout", "transient")],
)
def test_stability(spark, outcomes, expected):
    assert values(spark, [(outcomes,)], "o string", HT.stability(HT.parse_attempts(c("o")))) == [(expected,)]


@pytest.mark.parametrize(
    "url,expected",
    [("https://e.com/", "homepage"), ("https://e.com/p/x", "product"), ("https://e.com/c/a/b", "category"), ("https://e.com/impressum", "legal"), ("https://e.com/kontakt", "contact"), ("https://e.com/blog", "blog_index"), ("https://e.com/x", "other")],
)
def test_page_type(spark, url, expected):
    assert values(spark, [(url,)], "u string", PT.classify(c("u"))["page_type"]) == [(expected,)]


def test_scope_factor(spark):
    got = [r[0] for r in values(spark, [(n,) for n in (1, 10, 100, 1000)], "n int", MI.scope_factor(c("n"), F.lit("url")))]
    assert got == [1.0, 1.25, 1.5, 1.75]


def test_header_states(spark):
    rows = [({"content-security-policy": "default-src 'self'"},), ({"content-security-policy-report-only": "default-src 'self'"},), ({"permissions-policy": "camera=(*)"},), ({},)]
    got = values(spark, rows, "h map<string,string>", H.content_security_policy(c("h")), H.permissions_policy(c("h")))
    assert got == [("protected", "missing"), ("report_only", "missing"), ("missing", "dangerously_open"), ("missing", "missing")]


def test_text(spark):
    got = values(spark, [("It's a well-known Über fact, 42!",)], "t string", TX.visible_words(c("t")), TX.text_pattern(c("t")))
    assert got == [(6, "it s a well known über fact {num}")]
    assert values(spark, [("alpha beta gamma", "beta gamma delta eps")], "a string, b string", TX.token_similarity(c("a"), c("b"))) == [(0.5,)]
    assert values(spark, [("ﬁx  Ａ",)], "t string", TX.head_key(c("t"))) == [("fix a",)]


def test_schema_types(spark):
    assert "LiveBlogPosting" in family("Article") and "LocalBusiness" in family("Organization") and "Product" not in family("Article")
    assert values(spark, [("https://schema.org/Product",), ("schema:Thing",), (" ",)], "t string", type_name(c("t"))) == [("Product",), ("Thing",), (None,)]


def test_schedules_keep_their_local_hour(spark):
    from sitewright.functions import misc as MI

    rows = spark.createDataFrame([("2024-03-30 08:00:00", "daily"), ("2024-10-20 07:00:00", "weekly"), ("2024-01-31 08:00:00", "monthly")], "t string, f string").withColumn("t", c("t").cast("timestamp"))
    due = MI.next_due(c("t"), c("f"), F.lit(1), "Europe/Berlin")
    got = [row[0] for row in rows.select(due.cast("string")).collect()]
    assert got == ["2024-03-31 07:00:00", "2024-10-27 08:00:00", "2024-02-29 08:00:00"]
    assert [row[0] for row in rows.select(MI.is_due(due, F.lit("2024-03-31 07:00:00").cast("timestamp"))).collect()] == [True, False, True]
