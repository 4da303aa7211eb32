import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from sitewright.operators import matching as MA
from sitewright.sources import crawler_exports as CE
from sitewright.sources import delimited as D
from sitewright.sources import exports as XP
from sitewright.streaming import pages as ST

c = F.col


def test_types_of_exports(spark):
    given = [
        (1, ["address", "status_code", "status", "indexability"], "in/response_codes_all.csv", "response_codes", "high"),
        (2, ["source", "destination", "anchor_text", "follow"], "in/all_inlinks.csv", "inlinks", "high"),
        (3, ["address", "strange"], "in/Page Titles/part-1.csv", "page_titles", "high"),
        (4, ["og_title", "og_image"], "x.csv", "opengraph", "medium"),
        (5, ["nothing"], "x.csv", "unknown", "low"),
        (6, ["source", "destination", "type"], "links.csv", "inlinks", "high"),
    ]
    rows = spark.createDataFrame([row[:3] for row in given], "n int, names array<string>, path string").select("n", CE.export_type(c("names"), c("path")).alias("t"))
    assert {r.n: (r.t.kind, r.t.confidence) for r in rows.collect()} == {row[0]: row[3:] for row in given}


def _write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8", newline="")
    return str(folder / name)


def test_import(spark, tmp_path):
    pages = _write(tmp_path, "internal_html.csv", '\ufeff"Address","Status Code","Content Type","Indexability","Title 1","H1-1","Word Count","Crawl Depth"\n"https://E.com/a/","200","text/html","Indexable","One, ""two""","H","1.204","2"\n"https://e.com/b","404","text/html","Non-Indexable","","","","1"\n')
    codes = _write(tmp_path, "response_codes.csv", "Address;Status Code;Status;Indexability;Strange Column\r\nhttps://e.com/a;301;Moved;Non-Indexable;x\r\n")
    links = _write(tmp_path, "all_inlinks.csv", "Source,Destination,Anchor Text,Follow,Type\nhttps://e.com/a,https://e.com/b,To b,true,Hyperlink\n")
    rows, edges, pictures, files = CE.import_exports(spark, [pages, codes, links], "r1")
    got = {r.url: (r.status_code, r.indexable, r.title, r.depth) for r in rows.collect()}
    assert got == {"https://e.com/a": (301, 0, 'One, "two"', 2), "https://e.com/b": (404, 0, None, 1)}
    assert [(r.source_url, r.normalized_target_url) for r in edges.collect()] == [("https://e.com/a", "https://e.com/b")]
    assert pictures.count() == 0
    assert {r.export_type for r in CE.missing_exports(files).collect()} == set(CE.EXPECTED) - {"internal_html", "response_codes", "inlinks"}
    ignored = CE.column_report(files).where(F.size("fields") == 0)
    assert {(r.export_type, r.header) for r in ignored.collect()} == {("response_codes", "Status"), ("response_codes", "Strange Column"), ("inlinks", "Follow")}
    shown = _write(tmp_path, "images_all.csv", "Source,Image,Alt Text,Size (Bytes)\nhttps://e.com/a,https://e.com/x.png,A cat,10\nhttps://e.com/a,/y.png,,20\n")
    pages, _, pictures, _ = CE.import_exports(spark, [shown], "r1")
    assert [(r.image_url, r.alt_value) for r in pictures.orderBy("image_url").collect()] == [("https://e.com/x.png", "A cat"), ("https://e.com/y.png", None)]
    assert [r.url for r in pages.collect()] == ["https://e.com/a"]


PIECES = ["a", '"', "\n", ",", ";", "\t", " ", "\r\n", "é", "x" * 30, '""', ""]


@pytest.mark.parametrize("split", [90, 700, 1 << 20])
def test_records_over_split_ends(spark, tmp_path, monkeypatch, split):
    """Files of three dialects, cut every few bytes, give the rows of a plain reader."""
    draw, want = random.Random(split), {}
    for n in range(4):
        rows = [[f"https://e.com/{n}/{i}", "".join(draw.choice(PIECES) for _ in range(draw.randrange(9))), draw.choice(["", "plain"]), str(i)] for i in range(40)]
        text = io.StringIO()
        writer = csv.writer(text, delimiter=",;\t"[n % 3], lineterminator="\r\n" if n % 2 else "\n")
        writer.writerow(["Address", "Title 1", "Size (Bytes)", "Last One's"])
        writer.writerows(rows)
        _write(tmp_path, f"file {n}.csv", ("\ufeff" if n % 2 else "") + text.getvalue().rstrip("\r\n" if n == 3 else ""))
        want[f"file%20{n}.csv"] = rows
    kept = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        files, rows = D.table(spark, [str(tmp_path)])
        known = {r.file: r for r in files.collect()}
        got = {}
        for r in rows.orderBy("file", "block", "seq").collect():
            got.setdefault(known[r.file].path.rsplit("/", 1)[-1], []).append(r.cells)
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert got == want
    assert {tuple(r.names) for r in known.values()} == {("address", "title_1", "size", "last_ones")}
    assert all(r.bytes == len((tmp_path / r.path.rsplit("/", 1)[-1].replace("%20", " ")).read_bytes()) for r in known.values())


def test_odd_files(spark, tmp_path):
    _write(tmp_path, "blank.csv", "Address;Title 1\n\n;  ;\nx;y;further\nshort\n")
    _write(tmp_path, "open.csv", 'Address,Title 1\nx,"never closed\nstill,the same\n')
    _write(tmp_path, "twice.csv", "Title 1,Address,Title 1\nfirst,x,last\n")
    _write(tmp_path, "broken.csv", 'Address,Title 1\nx,12" wide" y\n')
    _write(tmp_path, "empty.csv", "")
    _write(tmp_path, "header.csv", '"Address","Title\n1"\n')
    files, rows = D.table(spark, [str(tmp_path)])
    names = {r.file: r.path.rsplit("/", 1)[-1] for r in files.collect()}
    got = {}
    for r in rows.select("file", "block", "seq", D.cell("address").alias("a"), D.cell("title_1").alias("t")).orderBy("file", "block", "seq").collect():
        got.setdefault(names[r.file], []).append((r.a, r.t))
    assert got == {"blank.csv": [("x", "y"), ("short", None)], "open.csv": [("x", "never closed\nstill,the same")], "twice.csv": [("x", "last")], "broken.csv": [("x", "12 wide y")]}
    assert sorted(names.values()) == ["blank.csv", "broken.csv", "header.csv", "open.csv", "twice.csv"]
    assert {tuple(r.names) for r in files.where("path LIKE '%header.csv'").collect()} == {("address", "title_1")}


def test_bundle_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r", i, ["x"]) for i in range(5)], "run_id string, n int, tags array<string>")
    manifest = XP.bundle({"rows": df}, str(tmp_path / "bundle")).collect()[0]
    assert (manifest.total_rows, manifest.stored_rows) == (5, 5)
    assert spark.read.json(str(tmp_path / "bundle" / "rows")).count() == 5
    XP.write_table(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).where(c("tags") == '["x"]').count() == 5


def _stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("r", f"u{i % 3}", i, 200 if i % 2 else 404) for i in range(12)]
    df = spark.createDataFrame(rows, "run_id string, normalized_url string, page_id int, status_code int").withColumn("fetched_at", F.timestamp_seconds(F.lit(1700000000) + c("page_id") * 60))
    df.repartition(3).write.parquet(folder)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_equals_batch(spark, tmp_path):
    batch, stream = _stream(spark, tmp_path)
    for checkpoint in ("cp", "cp", "other"):  # several epochs, a restart without new data, and a new checkpoint
        ST.upsert_into(stream, str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination(60)
    stored = {r.normalized_url: r.page_id for r in ST.latest(spark, str(tmp_path / "out")).collect()}
    assert len(list((tmp_path / "out").glob("writer=*/epoch=*"))) > 2
    assert stored == {r.normalized_url: r.m for r in batch.groupBy("normalized_url").agg(F.max("page_id").alias("m")).collect()}
    seen = ST.first_seen(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    seen.awaitTermination(60)
    assert spark.table("seen").count() == 3


def test_matching_by_brute_force(spark):
    items = spark.createDataFrame([("r", 1, "Title tags too long", "", "", "html-head", "Low", 10), ("r", 2, "Nothing known", "", "", "none", "Low", 5)], "run_id string, item_id int, title string, description string, recommendation string, category string, priority string, affected_count int")
    findings = spark.createDataFrame(
        [("r", "f1", "tech.title_too_long", "title too long", "12 titles are too long", "HTML Head & Meta", "html-head", "Low", 12, "Warning", "high", "core_issue", 0), ("r", "f2", "tech.hsts_header", "hsts header", "missing", "Security", "security-server", "Low", 3, "Warning", "high", "best_practice", 1)],
        "run_id string, finding_id string, check_id string, check_name string, finding string, category string, category_key string, priority string, affected_count int, status string, confidence string, finding_type string, review_recommended int",
    )
    mapped = MA.map_items(items)
    scored = MA.candidates(mapped, findings)
    assert [(r.item_id, r.finding_id, r.direct) for r in scored.collect()] == [(1, "f1", True)]
    covered = {r.item_id: r.coverage_status for r in MA.coverage(mapped, scored).collect()}
    assert covered == {1: "covered", 2: "not_covered"}
    assert {r.finding_id: r.classification for r in MA.extra_findings(findings, scored, MA.coverage(mapped, scored)).collect()} == {"f2": "needs_review"}
