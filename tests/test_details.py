"""Robots groups, keyset pages, checks that cannot run, findings without evidence, and inputs beyond former limits."""

import random
import time

from pyspark.sql import functions as F

from sitewright.operators import assets as AS
from sitewright.operators import details as DT
from sitewright.operators import frontier as FR
from sitewright.operators import matching as MA
from sitewright.operators.predicates import evaluate_all, evaluate_checks, issue, runnable, with_evidence

c = F.col
ASSET = "asset_id long, run_id string, url string, content string"


def plain_groups(text):
    group, opened, rows = 0, False, []
    for number, raw in enumerate(text.split("\n"), 1):
        body = raw.split("#")[0].strip()
        if not body:
            continue
        name, colon, value = body.partition(":")
        name, value = name.strip().lower(), value.strip()
        agent = bool(colon) and name == "user-agent"
        if agent and value:
            group += not opened or not group
            opened = True
        elif colon and not agent:
            opened = False
        rows.append((number, group))
    return rows


def test_robots_groups(spark):
    draw = random.Random(2)
    lines = ["User-agent: a", "user-agent: b", "User-agent:", "Disallow: /x", "Allow: /", "no directive", "", "# note", "Sitemap: https://e/s.xml", "Crawl-delay: 1"]
    texts = ["\n".join(draw.choice(lines) for _ in range(draw.randrange(14))) for _ in range(200)]
    rows = AS.robots_directives(spark.createDataFrame([(i, "r", "u", text) for i, text in enumerate(texts)], ASSET))
    got = {}
    for row in rows.orderBy("asset_id", "line").collect():
        got.setdefault(row.asset_id, []).append((row.line, row.group_id))
    assert got == {i: plain_groups(text) for i, text in enumerate(texts) if plain_groups(text)}


def test_robots_time_is_linear(spark):
    text = "User-agent: a\nDisallow: /x\n" * 50_000
    frame = spark.createDataFrame([(1, "r", "u", text)], ASSET)
    begin = time.perf_counter()
    assert AS.robots_directives(frame).agg(F.max("group_id").alias("n")).first().n == 50_000
    assert time.perf_counter() - begin < 30


def test_twin_of_a_long_file(spark):
    """What stands behind the first characters of a file counts."""
    asset = "run_id string, url string, content_type string, final_status int, content string"
    files = [("late", "https://e/x.md", "", 200, "x" * 500 + "\n<html >"), ("list", "https://e/x.md", "", 200, "<html >" + "x" * 500 + "\n- item"), ("plain", "https://e/x.md", "", 200, "x" * 500)]
    runs = spark.createDataFrame([(row[0],) for row in files], "run_id string")
    got = {r.run_id: r.evaluation_state for r in AS.markdown_twins(spark.createDataFrame(files, asset), runs).collect()}
    assert got == {"late": "fail", "list": "pass", "plain": "pass"}


def test_pages_by_keys(spark):
    draw = random.Random(3)
    rows = [(draw.choice([None, "a", "b", "c"]), n) for n in range(37)]
    frame = spark.createDataFrame(rows, "url string, page_id int")
    want = sorted(rows, key=lambda row: (row[0] is not None, row[0] or "", row[1]))
    got, after = [], None
    while page := [tuple(row) for row in FR.page_after(frame, ["url", "page_id"], after, 5).collect()]:
        got += page
        after = page[-1]
    assert got == want
    assert FR.totals(frame).first().total == 37


def checks():
    return [issue("t.one", "C", c("x") > 1), issue("t.two", "C", c("gone") > 1, priority="High"), issue("t.three", "C", c("y") == "a")]


def test_checks_that_cannot_run(spark):
    rows = spark.createDataFrame([("r", "u1", 5, "a"), ("r", "u2", 0, "b")], "run_id string, url string, x int, y string")
    runs = spark.createDataFrame([("r",), ("s",)], "run_id string")
    able, failed = runnable(rows, checks())
    assert [check.id for check in able] == ["t.one", "t.three"] and list(failed) == ["t.two"]
    got = {(r.run_id, r.check_id): (r.evaluation_state, r.status, r.affected_count) for r in evaluate_all(rows, runs, checks()).collect()}
    assert got[("r", "t.one")] == ("fail", "Warning", 1) and len(got) == 6
    assert {got[(run, "t.two")] for run in "rs"} == {("technical_error", "NA", 0)}
    assert evaluate_all(rows, runs, checks()[:1]).count() == 2
    assert {r.evaluation_state for r in evaluate_all(rows, runs, checks()[1:2]).collect()} == {"technical_error"}


def test_findings_need_evidence(spark):
    schema = "check_id string, evaluation_state string, status string, affected_count long, sample_urls array<string>, evidence string, score_eligible boolean"
    rows = [("bare", "fail", "Error", 0, [], " ", True), ("null", "fail", "Warning", None, None, None, True), ("counted", "fail", "Error", 2, [], "", True), ("sampled", "fail", "Error", 0, ["u"], "", True), ("noted", "fail", "Error", 0, [], "n=1", True), ("ok", "pass", "OK", 0, [], "", True)]
    got = {r.check_id: (r.evaluation_state, r.status, r.score_eligible) for r in with_evidence(spark.createDataFrame(rows, schema)).collect()}
    assert {name for name, row in got.items() if row == ("insufficient_evidence", "NA", False)} == {"bare", "null"}
    assert got["ok"] == ("pass", "OK", True) and got["noted"] == ("fail", "Error", True)


def test_details_scan_only_what_is_chosen(spark):
    pages = spark.createDataFrame([("r", "u1", 1), ("r", "u2", 0)], "run_id string, url string, x int")
    images = spark.createDataFrame([("r", "p", "i.png", 1)], "run_id string, page_url string, image_url string, x int")
    families = {
        "pages": DT.Family("pages", lambda: [issue("t.page", "C", c("x") == 1)], "url"),
        "images": DT.Family("images", lambda: [issue("t.image", "C", c("x") == 1)], "image_url", lambda rows: rows.withColumn("url", c("page_url"))),
    }
    both = DT.rows_of({"pages": pages, "images": images}, None, families)
    assert {tuple(row) for row in both.collect()} == {("r", "t.page", "u1", "u1"), ("r", "t.image", "p", "i.png")}
    assert [tuple(row) for row in DT.rows_of({"pages": pages}, {"t.page"}, families).collect()] == [("r", "t.page", "u1", "u1")]


def test_candidates_take_one_finding_of_a_check(spark):
    items = MA.map_items(spark.createDataFrame([("r", 1, "Title tags too long", "", "", "html-head", "Low", 10)], "run_id string, item_id int, title string, description string, recommendation string, category string, priority string, affected_count int"))
    columns = "run_id string, finding_id string, check_id string, check_name string, finding string, category string, category_key string, priority string, affected_count int, status string"
    row = ("tech.title_too_long", "title too long", "12 titles are too long", "HTML Head & Meta", "html-head", "Low", 12, "Warning")
    findings = spark.createDataFrame([("r", f"f{n}", *row) for n in range(300)], columns)
    assert [r.finding_id for r in MA.candidates(items, findings).collect()] == ["f0"]


def test_same_rows_with_and_without_errors(spark):
    rows = spark.createDataFrame([("r", "u1", 5, "a")], "run_id string, url string, x int, y string")
    runs = spark.createDataFrame([("r",)], "run_id string")
    able = checks()[::2]
    assert sorted(map(str, evaluate_all(rows, runs, able).collect())) == sorted(map(str, evaluate_checks(rows, runs, able).collect()))
