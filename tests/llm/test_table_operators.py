"""Mixing, archives, search and the classifiers, with nulls, empty tables, repeats and clashing columns."""

import random

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.llm import archives, languages, mixing, neighbours, quality, toxicity

SF = "/root/testdata/sf0.001"


def mixed_rows():
    draw = random.Random(3)
    sources = ["b", "a", "é", "Z", None, "hot"]
    rows = [(i, " ".join(["w"] * draw.randrange(0, 900)), draw.choice(sources) if i % 3 else "hot") for i in range(150)]
    return rows + [(200, None, "only null"), (201, "", "a"), (202, "x " * 70_000, "b"), (203, "x", "tiny")]


def test_mixing(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({name: F.lit("x") for name in ("size", "digest", "key", "block", "row", "weight", "lang")})
    got = mixing.report(docs).toPandas()
    base = duckdb.connect()
    base.register("documents", docs.select("doc_id", "text", "source").toPandas())
    want = base.execute(mixing.ORACLE).df()
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))
    assert (got.taken <= 3 * got["size"]).all()
    by_source = got.assign(source=got.source.fillna("")).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert ((by_source.target - by_source.taken).abs() < 1).all()
    assert abs(by_source.target.sum() - by_source["size"].sum()) < 1e-6
    stage = mixing.mixed(docs)
    assert set(docs.columns) <= set(stage.columns)
    assert stage.count() == (got.taken > 0).sum()


def test_schedule_draws_evenly_at_every_length(spark):
    docs = spark.createDataFrame([(i, "w " * 2000, "abc"[i % 3]) for i in range(90)], "doc_id long, text string, source string")
    sizes = mixing.sized(docs).withColumn("row", F.monotonically_increasing_id())
    slots = mixing.slots(mixing.targets(sizes)).orderBy("t").toPandas()
    for length in (50, 120, 400):
        shares = slots.head(length).key.value_counts(normalize=True)
        assert all(abs(shares.get(key, 0) - (key + 1) / 6) < 0.05 for key in (0, 1, 2))


def test_mixing_repeats_and_nothing(spark):
    schema = "doc_id long, text string, source string"
    again = spark.createDataFrame([(1, "a b c", "s")] * 4 + [(None, "d e", None)] * 2, schema)
    got = mixing.report(again).collect()
    assert len(got) == 6 and sum(row.taken for row in got) <= 16
    assert mixing.report(spark.createDataFrame([], schema)).count() == 0
    assert [row.taken for row in mixing.report(spark.createDataFrame([(1, None, "s")], schema)).collect()] == [0]


PAGES = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, "same"), (4, "u r\r\nl", "a\r\n\r\nWARC/1.0\r\nx"), (5, "u", None), (6, "u", ""), (7, "u", "ü" * 5000), (8, "u", "once"), (None, "u", "same")]


@pytest.mark.parametrize("least", [0, 10])
def test_archives(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({name: F.lit("x") for name in ("digest", "size", "page", "original", "value")})
    got = [tuple(row) for row in archives.report(pages, least).collect()]
    want = brute.records([(page_id, html) for page_id, _, html in PAGES])
    if least:
        want = [(*row[:3], "response", None) if row[1] < least else row for row in want]
    key = lambda row: (row[0] is None, row[0] or 0)
    assert sorted([row[:5] for row in got], key=key) == sorted(want, key=key)
    assert all(row[5] for row in got)
    assert archives.report(pages.limit(0)).count() == 0


def test_archive_headers(spark, tmp_path):
    import gzip

    archives.write(spark.createDataFrame(PAGES, "page_id long, url string, html string"), str(tmp_path / "warc"))
    text = b"".join(gzip.decompress(path.read_bytes()) for path in (tmp_path / "warc").glob("*.gz"))
    assert text.count(b"WARC-Type: response\r\n") == 5 and text.count(b"WARC-Type: revisit\r\n") == 4
    assert text.count(archives.PROFILE.encode()) == 4 and b"WARC-Target-URI: u%20r%20l\r\n" in text


def test_archive_dates_are_utc_and_ids_differ(spark, tmp_path):
    import gzip
    from datetime import UTC, datetime

    kept = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        for name in ("one", "two"):
            archives.write(spark.createDataFrame(PAGES, "page_id long, url string, html string"), str(tmp_path / name))
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)
    texts = [b"".join(gzip.decompress(path.read_bytes()) for path in (tmp_path / name).glob("*.gz")).decode() for name in ("one", "two")]
    dates = [datetime.strptime(line.split(": ")[1], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC) for line in texts[0].split("\r\n") if line.startswith("WARC-Date")]
    assert len(dates) == 9 and all(abs((datetime.now(UTC) - date).total_seconds()) < 600 for date in dates)
    named = [{line for line in text.split("\r\n") if line.startswith("WARC-Record-ID")} for text in texts]
    assert len(named[0]) == 9 and not named[0] & named[1]
    # the page that three others repeat has no address, the one that an empty page repeats has
    assert [line for line in texts[0].split("\r\n") if line.startswith("WARC-Refers-To-Target-URI")] == ["WARC-Refers-To-Target-URI: u"]
    assert sum(line.startswith("WARC-Refers-To-Date: ") for line in texts[0].split("\r\n")) == 4


def test_tags_that_never_close_take_linear_time(spark):
    import time

    for part in ("<!--", "<script ", "<style", "<a "):
        page = spark.createDataFrame([(1, part * (1_000_000 // len(part)) + " x")], "page_id long, html string")
        begin = time.perf_counter()
        assert page.select(F.regexp_replace("html", languages._TAGS, " ").alias("t")).first().t.strip() == ""
        assert time.perf_counter() - begin < 10


def test_neighbours(spark):
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(1500, 24)).astype(np.float32)
    vectors[100:400] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(5000, None), (5001, []), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [1.0] * 23 + [None]), (5080, [float("inf")] * 24), (5100, [1.0] * 7), (None, [1.0] * 24), (20, vectors[20].tolist())]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({name: F.lit(1) for name in ("rank", "score", "query_id", "bucket", "part")})
    found = {}
    for row in neighbours.nearest(frame).orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append((row.vec_id, row.score))
    exact = vectors.astype(float)
    hits = 0
    for query in range(0, 1500, 20):
        scores = (exact[query] * exact).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(1500), -scores)) if i != query][:20]
        own = found[query]
        assert len(own) == 20 and all(abs(score - scores[i]) < 1e-12 for i, score in own)
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in own} & set(order))
        if query == 100:
            assert [i for i, _ in own] == order
    assert set(found) == set(range(0, 1500, 20))
    assert hits >= 0.9 * 75 * 20
    assert neighbours.nearest(frame.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert neighbours.nearest(few).count() == 2


def recalls(spark, vectors, k=20, every=20):
    """Share of its true neighbours that each query finds."""
    frame = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>")
    found = {}
    for row in neighbours.nearest(frame, k, every).collect():
        found.setdefault(row.query_id, set()).add(row.vec_id)
    out = []
    for query in range(0, len(vectors), every):
        scores = vectors @ vectors[query]
        scores[query] = -np.inf
        out.append(len(found.get(query, set()) & set(np.argsort(-scores)[:k].tolist())) / k)
    return np.array(out)


def clustered(draw, count, width=32, size=100):
    vectors = np.repeat(draw.normal(size=(count // size, width)), size, axis=0) + 0.35 * draw.normal(size=(count, width))
    return draw.permutation(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))


@pytest.mark.parametrize("norms", ["one large", "spread"])
def test_neighbours_of_unequal_norms(spark, monkeypatch, norms):
    monkeypatch.setattr(neighbours, "BUCKET", 16)
    draw = np.random.default_rng(2)
    vectors = clustered(draw, 6000)
    if norms == "one large":
        vectors[7] *= 10
    else:
        vectors *= draw.uniform(0.2, 1, size=(6000, 1))
    assert recalls(spark, vectors).mean() >= 0.9


def test_neighbours_of_isolated_among_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET", 16)
    draw = np.random.default_rng(4)
    alone = draw.normal(size=(2400, 32))
    vectors = draw.permutation(np.concatenate([clustered(draw, 3600), alone / np.linalg.norm(alone, axis=1, keepdims=True)]))
    found = np.sort(recalls(spark, vectors))
    print("recall", found.mean(), "lowest tenth", found[:30].mean())
    assert found.mean() >= 0.9 and found[:30].mean() >= 0.75


def test_queries_of_a_bucket_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERIES", 50)
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    seen, search = spark.sparkContext.accumulator(0), neighbours._block_search

    def watched(k):
        inner = search(k)

        def found(left, right):
            if len(left) > 100 or len(right) > 200:
                seen.add(1)
            return inner(left, right)

        return found

    monkeypatch.setattr(neighbours, "_block_search", watched)
    assert recalls(spark, clustered(np.random.default_rng(6), 1000), every=2).mean() == 1
    assert seen.value == 0


def test_scanned_cells_hold_the_neighbours(spark, monkeypatch):
    """Large tables are scanned by blocks of queries; no query or vector is dealt out by buckets."""
    for name, value in (("CELL", 16), ("SENT", 100), ("AT_ONCE", 4096)):
        monkeypatch.setattr(neighbours.vector_scan, name, value)
    monkeypatch.setattr(neighbours, "SCANNED", 1000)
    monkeypatch.setattr(neighbours, "_blocks", None)
    draw = np.random.default_rng(4)
    alone = draw.normal(size=(1200, 32))
    vectors = np.concatenate([clustered(draw, 1800), alone / np.linalg.norm(alone, axis=1, keepdims=True)])
    vectors[:1500] *= draw.uniform(0.2, 1, size=(1500, 1))
    vectors[7] *= 10
    found = np.sort(recalls(spark, draw.permutation(vectors)))
    assert found.mean() >= 0.9 and found[:15].mean() >= 0.7


def test_scanned_tables_give_what_buckets_give(spark, monkeypatch):
    """Odd rows, copies, an id with two vectors, very small and very large numbers; each query gets k neighbours."""
    monkeypatch.setattr(neighbours, "SCANNED", 0)
    monkeypatch.setattr(neighbours, "_blocks", None)
    test_neighbours(spark)
    draw = np.random.default_rng(9)
    vectors = draw.normal(size=(400, 8))
    vectors[100:200] *= 1e-200
    vectors[200:300] *= 1e120
    rows = [*enumerate(vectors.tolist()), (20, vectors[3].tolist())]
    found = {}
    for row in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        found.setdefault(row.query_id, []).append((-row.score, row.vec_id))
    ids, all_vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for query in range(0, 400, 20):
        items = {(-float((v * own).sum()), i) for q, own in rows if q == query for i, v in zip(ids.tolist(), all_vectors, strict=True) if i != query}
        assert np.allclose([far for far, _ in sorted(found[query])], [far for far, _ in sorted(items)[:20]], rtol=1e-9, atol=0)


@pytest.mark.parametrize("hashes", [1, 4, 8])
def test_visits_reach_their_chance_with_many_directions(hashes):
    hashing = neighbours._Hashing(64, neighbours.BUCKET * 4**hashes, 1.0)
    assert hashing.hashes == hashes
    query = np.random.default_rng(8).normal(size=64)
    chances = hashing.chances(0, hashing.projections(0, query[None, :], True)[0], 0.42)
    codes = hashing.likely(chances, neighbours.REACH)
    held = np.ones(len(codes))
    for i, own in enumerate(chances):
        held *= own[codes // 6**i % 6]
    assert len(set(codes.tolist())) == len(codes)
    assert neighbours.REACH <= held.sum() <= neighbours.REACH + max(held.min() * 1.01, 1e-9)


@pytest.fixture(scope="module")
def given(spark):
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, "word " * 40_000, None, None, 1)], table("documents").schema)
    return table("documents").unionByName(odd), table("labels"), table("pages")


def test_toxicity(given, spark):
    docs, labels, _ = given
    got = toxicity.report(docs, labels).withColumn("held_out", toxicity.held_out()).toPandas()
    assert len(got) == docs.count()
    assert (abs(got.p_mild + got.p_severe - got.expected_severity) < 1e-9).all() and (got.p_severe <= got.p_mild).all()
    both = got.merge(labels.toPandas(), on="doc_id", suffixes=("", "_label"))
    assert ((both.toxic == (both.toxic_label == 1)).mean()) > 0.95
    kept = toxicity.without_toxic(docs.withColumn("toxic", F.lit(1)), labels)
    assert kept.count() == (~got.toxic).sum() and "toxic" in kept.columns
    none = spark.createDataFrame([], labels.schema)
    assert not toxicity.report(docs, none).where("toxic").count()
    assert toxicity.report(docs.limit(0), labels).count() == 0


def test_ordinal_fit_shares_weights_across_ordered_cuts():
    draw = np.random.default_rng(0)
    value = draw.uniform(0, 2, size=2000)
    score = 3 * value + draw.logistic(size=2000)
    grade = (score > 2).astype(int) + (score > 5)
    weights, cuts = toxicity.fit_ordinal(np.arange(2000), np.zeros(2000, dtype=int), value, grade, 1, steps=1500)
    assert abs(weights[0] - 3) < 0.4 and abs(cuts[0] - 2) < 0.4 and abs(cuts[1] - 5) < 0.6


def test_languages(given, spark):
    docs, _, pages = given
    got = languages.classify(docs, pages).toPandas()
    assert len(got) == docs.count() + pages.count()
    known = got[got.doc_id.notna()].merge(docs.where("lang IS NOT NULL AND length(text) > 50").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (known.language == known.lang).mean() > 0.97
    # two words of text: markup and host decide
    short = spark.createDataFrame([(i, "https://x.example.de/1", f"<html lang='{lang}'><body>{text}</body>") for i, (lang, text) in enumerate([("de", "Die einung schen ung der"), ("fr", "les aux de")] * 12 + [("de", ""), ("fr", "")])], "page_id long, url string, html string")
    rows = {row.page_id: row.language for row in languages.classify(docs, short).where("kind = 'page'").collect()}
    assert rows[24] == "de" and rows[25] == "fr"
    empty = spark.createDataFrame([], docs.schema)
    assert languages.classify(empty, pages).where("language IS NULL").count() == pages.count()


def test_quality(given, spark):
    docs, labels, _ = given
    got = quality.report(docs.withColumns({name: F.lit(1) for name in ("label", "words", "capitals", "features", "score")}), labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()
    both = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert ((both.predicted == both.quality).mean()) > 0.9
    none = spark.createDataFrame([], labels.schema)
    assert set(quality.report(docs, none).toPandas().score) == {0.5}
    assert quality.report(docs.limit(0), labels).count() == 0


def test_statistics(spark):
    row = quality.statistics(spark.createDataFrame([(1, "AB ab ab\n12! %%\n12! %%")], "doc_id long, text string")).first()
    assert (row.chars_per_word, row.words_per_line, row.distinct_lines) == (22 / 7, 7 / 3, 2 / 3)
    assert (round(row.distinct_words, 6), round(row.repeated_words, 6), round(row.capitals, 6)) == (round(4 / 7, 6), round(1 / 7, 6), round(2 / 22, 6))
