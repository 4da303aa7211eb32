"""Dates, bylines, players, questions and source links from markup, and pages from HTML into the checks."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewright.operators import extraction as EX
from sitewright.operators import page_checks as PC
from sitewright.operators import page_facts as PF
from sitewright.operators import structured_data as SD
from sitewright.operators.html_walk import walk
from sitewright.operators.predicates import evaluate_checks

c = F.col


def page(content, head="", tail=""):
    return f"<html><head>{head}</head><body><main><article>{content}</article></main>{tail}</body></html>"


DATES = [
    ("<time>2024-01-31</time>", ["2024-01-31"], True),
    ("<p class='post-date'>1. 2. 2023</p>", ["1. 2. 2023"], True),
    ("<p class='publish'>März 2024</p>", ["März 2024"], True),
    ("<p class='date'>am 3. April 1999</p>", ["am 3. April 1999"], True),
    ("<p class='date'>May 5, 2020</p>", ["May 5, 2020"], True),
    ("<p class='date'>soon, 2020</p>", ["soon, 2020"], False),
    ("<p class='date'><time>2024-13-01</time></p>", ["2024-13-01"], False),
    ("<p hidden class='date'>2024-01-01</p>", [], False),
    ("<div style='display: none'><time>2024-01-01</time></div>", [], False),
    ("<p>2024-01-01</p>", [], False),
]


@pytest.fixture(scope="module")
def dated(spark):
    rows = [(i, "https://e.com/blog/x", page(html)) for i, (html, _, _) in enumerate(DATES)]
    rows += [
        (100, "https://e.com/", "<body><time>2024-01-01</time></body>"),
        (101, "https://e.com/", page("", head='<meta property="article:published_time" content="2024-01-01"><meta name="author" content="A">')),
        (102, "https://e.com/", page("", head='<script type="application/ld+json">{"@type":"Article","datePublished":"2024-01-01","author":"A"}</script>')),
        (103, "https://e.com/", page("x on 2024-01-01")),
        (104, "https://e.com/", None),
    ]
    return {r.page_id: r for r in EX.pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_dates(dated):
    for i, (_, texts, found) in enumerate(DATES):
        assert (dated[i].dates, dated[i].has_date) == (texts, found), DATES[i]


def test_ranked_evidence(dated):
    assert [dated[i].date_evidence for i in (0, 9, 100, 101, 102, 103, 104)] == ["markup", "wording", None, "meta", "json_ld", "wording", None]
    assert [dated[i].author_evidence for i in (0, 101, 102)] == [None, "meta", "json_ld"]


def test_bylines_and_players():
    found = walk(page('<p class="Author">no</p><p class="author">by <b>Ann</b><i class="byline">x</i></p><a rel="nofollow author" href="/t">Jo</a><span class="byline"><img alt="Pic"></span><span class="author"></span>', tail='<p class="author">late</p>'))
    assert found.notes["byline"] == ["by Annx", "Jo", "Pic"]
    found = walk('<video></video><iframe src="https://player.vimeo.com/1"></iframe><iframe src="/map"></iframe><iframe></iframe>')
    assert found.counts["videos"] == 2


def test_questions(spark):
    rows = [
        (1, page("<h2>Why?</h2><h3>How?</h3><p>FAQ</p>")), (2, page("<h2>Why?</h2><h3>How?</h3>")), (3, page("<div id='faq-1'><button>Why?</button><summary>How?</summary></div>")),
        (4, page("<details><summary>Why?</summary></details>")), (5, page("<div class='myFAQ'></div>")), (6, page("<h2>Plain</h2>")), (7, page("<details><summary>a?</summary></details><details open><summary>b?</summary></details>")),
    ]
    docs = spark.createDataFrame([(i, "https://e.com/x", html) for i, html in rows], "page_id long, url string, html string")
    got = {r.page_id: (r.has_faq, r.has_weak_faq) for r in EX.pages(docs).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (True, False), 4: (False, True), 5: (False, True), 6: (False, False), 7: (True, False)}


def test_source_links(spark):
    html = page(
        '<p class="References"><a href="https://a.test/x">x</a><a href="https://a.test/x#f">again</a></p><a href="https://b.test/doi/1">y</a><a href="https://c.test/">a study</a><a href="https://d.test/">plain</a>'
        '<a href="https://www.e.com/report">own report</a><div hidden><a href="https://f.test/report">r</a></div><nav><a href="https://g.test/report">r</a></nav><div role="contentinfo"><a href="https://h.test/report">r</a></div>',
        tail='<a href="https://i.test/report">r</a>',
    )
    docs = spark.createDataFrame([(1, "https://e.com/x", html)], "page_id long, url string, html string")
    assert EX.pages(docs).first().source_targets == ["https://a.test/x", "https://b.test/doi/1", "https://c.test/"]


@pytest.mark.parametrize("html", ["<p class='date'>" * 20_000 + "2024-01-01", "<main>" + "<div class='byline'><h2>" * 10_000 + "x", "<main>" + "<a rel=author>" * 20_000 + "x"])
def test_nested_marks_take_linear_time(html):
    begin = time.perf_counter()
    walk(html)
    assert time.perf_counter() - begin < 5


def test_stored_facts_give_the_same_outputs(spark):
    docs = spark.createDataFrame([(i, "https://e.com/blog/x", page(html + '<img src="/x.png"><a href="/y">y</a>', head='<title>T</title><script src="/s.js"></script>')) for i, (html, _, _) in enumerate(DATES)], "page_id long, url string, html string")
    facts = EX.tokenize(docs)
    for output in (EX.pages, EX.links, EX.images, EX.resources, EX.json_ld_blocks):
        assert sorted(map(str, output(facts).collect())) == sorted(map(str, output(docs).collect()))


def test_pages_from_html_into_checks(spark):
    docs = spark.createDataFrame(
        [(1, "https://e.com/blog/a", page("<time>2024-01-01</time><p class='author'>Ann</p>", head="<title>A title of fair length here</title>")), (2, "https://e.com/blog/b", page("<h1>x</h1>", head='<meta charset="utf-8">'))],
        "page_id long, url string, html string",
    )
    fetched = spark.createDataFrame([(1, 200, "text/html; charset=UTF-8"), (2, 503, "text/html")], "page_id long, status_code int, content_type string")
    types = SD.entities(EX.json_ld_blocks(docs)).select("page_id", "schema_type")
    for crawl, failing in ((None, {"tech.title_missing": 1, "geo.author_hints_present": 1, "tech.charset_utf8_present": 1}), (fetched, {"tech.title_missing": 0, "tech.charset_utf8_present": 0, "geo.author_hints_present": 1})):
        rows = PC.prepare(PF.from_html(EX.pages(docs), EX.links(docs), types, crawl))
        runs = rows.select("run_id").distinct().withColumn("store_headers", F.lit(1))
        got = {r.check_id: r.affected_count for r in evaluate_checks(rows, runs, [*PC.head_checks(), *PC.crawl_checks(), *PC.content_signal_checks()]).collect()}
        assert {name: got[name] for name in failing} == failing


def test_facts_leave_the_worker_in_pieces():
    """However many documents a batch holds, only a piece of them is parsed before its facts are handed on."""
    count = 3 * EX.PIECE + 1
    batch = pd.DataFrame({"page_id": range(count), "url": "https://a.test/", "html": ["<title>t</title>"] * (count - 1) + [None]})
    pieces = list(EX._parsed(["page_id", "url", "titles"])(iter([batch])))
    assert [len(piece) for piece in pieces] == [EX.PIECE] * 3 + [1]
    assert [x for piece in pieces for x in piece["page_id"]] == list(range(count))
    assert pieces[0]["titles"][0] == ["t"] and pieces[3]["titles"][0] == []
