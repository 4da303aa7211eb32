import gzip
import random

import pytest
from pyspark.sql import functions as F

from sitewright.catalog import inputs
from sitewright.catalog.site_views import Site
from sitewright.operators import assets as AS
from sitewright.operators import extraction as EX
from sitewright.operators import frontier as FR
from sitewright.operators import page_checks
from sitewright.operators import rendering as RN
from sitewright.operators import scoring as SC
from sitewright.operators import structured_data as SD
from sitewright.operators.html_walk import walk
from sitewright.operators.predicates import evaluate_checks

SF = "/root/testdata/sf0.001"
c = F.col

HTML = """<!doctype html><html lang="de"><head><title> A  title </title><meta name="description" content="Text"><link rel="canonical" href="/x/">
<script type="application/ld+json">{"@type":"Product","offers":{"@type":"Offer"}}</script></head><body><header><nav><a href="/a">Eins</a></nav></header>
<main><h1><img alt="Logo name" src="/logo.png"></h1><h3>Three</h3><p>One two <b>three<p>four</p><div hidden>no</div><details><summary>Sum</summary>closed</details>
<ul><li>x</li></ul><img src="/p.jpg" width="10" height="10"></main><script>var no = 1;</script></body></html>"""


def test_walk_text_kinds_and_headings():
    page = walk(HTML)
    assert page.titles == ["A title"]
    text = " ".join(" ".join(page.visible).split())
    assert text == "Eins Three One two three four Sum x"
    assert [(h["level"], h["name"], h["name_source"]) for h in page.headings] == [(1, "Logo name", "image_alt"), (3, "Three", "visible_text")]


def test_extraction_rows(spark):
    docs = spark.createDataFrame([(1, "https://e.com/shop/product/x", HTML)], "page_id bigint, url string, html string")
    row = EX.pages(docs).collect()[0]
    assert (row.title, row.word_count, row.heading_skips, row.html_lang, row.canonicals) == ("A title", 8, 1, "de", ["https://e.com/x"])
    assert {r.image_role for r in EX.images(docs).collect()} == {"icon", "tracking_pixel"}
    assert [r.schema_type for r in SD.entities(EX.json_ld_blocks(docs)).orderBy("entity_path").collect()] == ["Product", "Offer"]


def test_visible_words_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    got = {r.page_id: r.visible_text for r in EX.tokenize(docs).select("page_id", "visible_text").collect()}
    for row in docs.collect():
        assert got[row.page_id] == " ".join(" ".join(walk(row.html).visible).split())


def test_sitemap_documents():
    body = b"<urlset><url><loc>https://e.com/a</loc></url><url><loc>https://e.com/a</loc></url></urlset>"
    assert AS._parse_document(gzip.compress(body))["locations"] == ["https://e.com/a"] * 2
    assert AS._parse_document("<!DOCTYPE x><urlset/>")["parse_error"] == "doctype_not_allowed"
    assert AS._parse_document("<html><body>")["document_type"] == "html"


def test_bot_policy_specificity(spark):
    text = "User-agent: *\nDisallow: /a\nAllow: /a/b\nUser-agent: GPTBot\nDisallow:\n"
    rows = spark.createDataFrame([("r", 1, "https://e.com/robots.txt", text)], "run_id string, asset_id bigint, url string, content string")
    got = {r.bot: (r.status, r.blocked_paths) for r in AS.bot_policies(rows, F.array(F.lit("/a/b/c"), F.lit("/a/x"))).collect()}
    assert got["GPTBot"] == ("explicitly_allowed", 0) and got["CCBot"] == ("blocked", 1)


def test_settling(spark):
    rows = [("a", i, fp, i * 2000, 0, 10) for i, fp in enumerate("xyyy")] + [("b", i, fp, i * 2000, 0, 0) for i, fp in enumerate("zzz")] + [("d", i, fp, i * 2000, 0, 5) for i, fp in enumerate("zzx")]
    df = spark.createDataFrame(rows, "snapshot_key string, seq int, fingerprint string, elapsed_ms bigint, loading_indicators int, visible_words int")
    assert {r.snapshot_key: (r.status, r.stable_count) for r in RN.settling(df).collect()} == {"a": ("settled", 3), "b": ("content_remained_empty", 3), "d": ("rendering_unstable", 1)}


def _score(spark, rows):
    schema = "run_id string, finding_id string, check_id string, category string, check_area string, status string, evaluation_state string, priority string, confidence string, severity string, finding_type string, scope_type string, root_cause_key string, affected_count bigint, occurrence_count bigint"
    context = spark.createDataFrame([("r", "crawl", 1, 1, 0, 0, 0, 0)], "run_id string, source_type string, lab_sampling int, browser_sampling int, render_required int, render_optional_open int, render_exhausted int, render_unavailable int")
    full = [("r", f"f{i}", check, "Crawling & Indexing", "tech", "Error", "fail", None, "high", severity, kind, "url", None, n, n) for i, (check, severity, kind, n) in enumerate(rows)]
    return SC.scores(spark.createDataFrame(full, schema), context).where("model = 'overall'").collect()[0]


def test_severity_order_and_monotone_reach(spark):
    by_severity = [_score(spark, [("tech.canonical_missing", s, "core_issue", 5)]).raw_penalty for s in ("low", "medium", "high", "critical")]
    assert by_severity == sorted(by_severity) and len(set(by_severity)) == 4
    reach = [_score(spark, [("tech.canonical_missing", "high", "core_issue", n)]).raw_penalty for n in (1, 10, 100, 1000)]
    assert reach == sorted(reach)


def test_duplicates_are_not_penalised_twice(spark):
    one = _score(spark, [("tech.canonical_missing", "high", "core_issue", 5)])
    two = _score(spark, [("tech.canonical_missing", "high", "core_issue", 5)] * 2)
    assert (one.raw_penalty, one.root_causes) == (two.raw_penalty, two.root_causes)


def test_optional_lows_are_capped(spark):
    lows = _score(spark, [(f"tech.optional_{i}", "low", "opportunity", 1) for i in range(20)])
    critical = _score(spark, [("tech.canonical_missing", "critical", "core_issue", 1)])
    assert lows.applied_penalty == pytest.approx(5, abs=0.01) and lows.applied_penalty < critical.applied_penalty


def test_groups_of_results_give_what_their_rows_give(spark):
    """Causes, coverage and counts from groups, against the same operators over single rows; states, scopes and other values may be null or unknown."""
    draw = random.Random(5)
    checks = ["tech.js_dependent_content", "template.high_lcp", "tech.console_errors_present", "tech.sitemap_present", "geo.llms_txt_present", "tech.images_without_alt", "tech.external_links", None]
    pick = lambda *values: draw.choice(values)
    rows = [
        (
            pick("a", "b", "none", None), pick(f"f{i}", "f0", None), draw.choice(checks), pick("Media SEO", None), pick("tech", "geo", None), pick("Error", "Warning", None), pick("pass", "fail", "fail", "inventory", "not_applicable", "odd", None),
            pick("High", "odd", None), pick("high", "Medium", "low", "", None), pick("Critical", "low", "none", "", None), pick("core_issue", "info", "odd", "", None), pick("url", "Resource", "service", "template", "odd", "", None),
            pick("Own Key", "own-key", "", None), pick(0, 1, 7, None), pick(0, 2, None), pick(None, True, False), pick(None, [], ["x"]), pick(None, [], [("k", 3)], [("k", None), (None, 2)]),
        )
        for i in range(1500)
    ]
    schema = "run_id string, finding_id string, check_id string, category string, check_area string, status string, evaluation_state string, priority string, confidence string, severity string, finding_type string, scope_type string, root_cause_key string, affected_count bigint, occurrence_count bigint, score_eligible boolean, missing_facts array<string>, candidates array<struct<key:string,count:int>>"
    context = "run_id string, source_type string, lab_sampling int, browser_sampling int, render_required int, render_optional_open int, render_exhausted int, render_unavailable int"
    runs = spark.createDataFrame([("a", "crawl", 0, 1, 0, 0, 0, 0), ("b", "import", 1, 0, 1, 1, 0, 1), ("b", None, None, None, None, None, None, None)], context)
    results = spark.createDataFrame(rows, schema)
    flat = lambda df: sorted(map(repr, df.collect()))
    for part in (results, results.drop("score_eligible", "missing_facts", "candidates")):
        single, grouped = SC.per_model(SC.prepare(part, runs)), SC.per_model(SC.prepared_groups(part, runs))
        causes = SC.root_causes(single).drop("member_count")
        assert flat(causes) == flat(SC.group_causes(grouped).select(causes.columns))
        units = SC.coverage_units(single)
        assert flat(units) == flat(SC.coverage_units(grouped).select(units.columns))
        # sums of weights depend on the order of rows in their last place
        coverage = SC.run_coverage(single, units).select("run_id", "model", "primary_coverage", "weighted_coverage", "results", "failing", "excluded_results", "render_coverage", "score_status")
        assert flat(coverage) == flat(SC.run_coverage(grouped, SC.coverage_units(grouped)).select(coverage.columns))


def test_order_independence_and_run_isolation(spark):
    site = Site(spark, SF)
    pages, runs = inputs.pages(site), site.table("site_runs")
    flat = lambda df: sorted(tuple(map(str, r)) for r in inputs.flat_results(df).collect())
    whole = flat(evaluate_checks(pages, runs, page_checks.head_checks()))
    assert whole == flat(evaluate_checks(pages.repartition(7, F.rand(3)), runs, page_checks.head_checks()))
    one = runs.where("processed_urls > 0").orderBy("run_id").first().run_id
    alone = flat(evaluate_checks(pages.where(c("run_id") == one), runs.where(c("run_id") == one), page_checks.head_checks()))
    assert alone == [row for row in whole if row[0] == one]


def test_upsert_keeps_the_last_write(spark):
    old = spark.createDataFrame([("r", "u", 1, "a"), ("r", "v", 2, "b")], "run_id string, normalized_url string, page_id int, title string")
    new = spark.createDataFrame([("r", "u", 0, "c")], old.schema)
    assert sorted((r.normalized_url, r.title) for r in FR.upsert(old, new, ["run_id", "normalized_url"], "page_id").collect()) == [("u", "c"), ("v", "b")]


def test_plan_does_not_depend_on_row_order(spark):
    rows = [("r", i, f"https://e.com/{i}", "other", f"t{i % 3}", 200, 200, "text/html", random.Random(i).choice(["render_required", "render_recommended", "render_not_required"]), 100 + i) for i in range(40)]
    schema = "run_id string, page_id int, url string, page_type string, cluster_key string, status_code int, initial_status_code int, content_type string, decision string, strength int"
    plans = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        plans.append(sorted(map(tuple, RN.render_plan(spark.createDataFrame(rows, schema), 7).collect())))
    assert plans[0] == plans[1] and len(plans[0]) == 7


def test_page_walk_is_linear_and_uncut():
    from sitewright.operators.html_walk import walk

    heads = "".join(f"<h1>head {i}</h1>" for i in range(80))
    page = walk(f"<html><head><meta http-equiv=Content-Type content='text/html; charset=latin1'></head><body><p><b>a<p>b{heads}<a href='/x'>{'word ' * 400}</a><main><form role=search></form></main>")
    assert (len(page.headings), len(page.links[0]["anchor"]), page.charset(), page.counts["search:main_forms"]) == (80, 1999, "latin1", 1)
    deep = walk("<body>" + "<p><b>text <i>" * 50_000)
    assert deep.counts["p"] == 50_000 and len(deep.raw) == 50_000


def test_deep_and_cyclic_sitemap_indexes(spark):
    from sitewright.operators import assets

    chain = [("r", f"s{i}", "sitemapindex", True, [f"s{i + 1}", f"s{max(0, i - 1)}"]) for i in range(7)] + [("r", "s7", "urlset", True, ["u"])]
    rows = spark.createDataFrame([("r", "top", "sitemapindex", True, ["s0"]), *chain], "run_id string, url string, document_type string, valid boolean, locations array<string>")
    assert {row.url: row.level for row in assets.expand_indexes(rows).collect()} == {"top": 0} | {f"s{i}": i + 1 for i in range(8)}


def test_markup_far_into_a_robots_file(spark):
    from sitewright.operators import assets

    row = spark.createDataFrame([(200, "ok", "# x\n" * 3000 + "<html>", 0)], "status_code int, measurement_state string, content string, truncated int")
    assert assets.robots_state(row).first().robots_state == "invalid_html_representation"


def test_sitemap_of_many_bytes_keeps_its_locations():
    from sitewright.operators.assets import _parse_document

    body = "<urlset>" + "<url><loc>http://e.com/" + "a" * 1000 + "</loc></url>"
    text = body + "<!--" + "x" * (51 * 1024 * 1024) + "--></urlset>"
    assert len(_parse_document(text)["locations"]) == 1
