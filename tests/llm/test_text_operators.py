"""Operators over texts against plain Python, on a table with nulls, empty and long texts, repeats and clashing columns."""

import random

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sitewright.llm import decontamination, near_duplicates, substrings, token_counts

CLASHING = ("d", "t", "size", "n_words", "spans", "items", "fp", "bands", "label", "taken", "target", "row", "bucket", "shingles", "toxic", "words", "n_hit", "__spare")


def texts():
    draw = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("ka", "Lo", "mi", "ñu", "pe") for b in ("ra", "te", "so", "vi", "da", "x")]
    word = lambda: draw.choice(vocabulary)
    shared = " ".join(word() for _ in range(60))
    base = [word() for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "a b c d"), (7, "A b  c\nd"), (8, "a b c d e")]
    rows += [(10 + i, " ".join(word() for _ in range(draw.randrange(1, 90)))) for i in range(25)]
    rows += [(40 + i, f"{word()} {shared}\n{word()} {word()}") for i in range(6)]
    for i in range(8):
        changed = list(base)
        for _ in range(i % 4):
            changed[draw.randrange(120)] = word()
        rows.append((60 + i, " ".join(changed)))
    rows += [(80, " ".join(base)), (81, "loop de " * 40), (82, " ".join(word() for _ in range(30_000))), (83, f"x {shared}")]
    return rows


ROWS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return frame.withColumns({name: F.lit(name) for name in CLASHING})


def test_substring_dedup(docs):
    got = {row.doc_id: (row.n_words, row.n_removed, row.kept_sha256) for row in substrings.removal_report(docs).collect()}
    assert got == brute.removals(ROWS)


def test_substring_dedup_over_many_buffers(docs, monkeypatch):
    monkeypatch.setattr(substrings, "BUFFER", 50)
    got = {row.doc_id: (row.n_words, row.n_removed, row.kept_sha256) for row in substrings.removal_report(docs).collect()}
    assert got == brute.removals(ROWS)


def test_cut_texts_keep_columns_and_clean_texts(docs):
    kept = substrings.without_repeats(docs)
    assert kept.columns == docs.columns
    want = brute.removals(ROWS)
    got = {row.doc_id: row.text for row in kept.select("doc_id", "text").collect()}
    before = dict(ROWS)
    assert set(got) == {doc_id for doc_id, (n, removed, _) in want.items() if not n or removed < n}
    for doc_id, text in got.items():
        if want[doc_id][1] == 0:
            assert text == before[doc_id]
        else:
            assert len(brute.split(text)) == want[doc_id][0] - want[doc_id][1]


def test_substring_dedup_without_ids_and_with_repeats(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(None, passage), (7, passage + " end"), (7, passage + " end"), (None, "z " + passage)]
    got = sorted((row.doc_id is None, row.n_words, row.n_removed) for row in substrings.removal_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 31, 0), (False, 31, 0), (True, 30, 30), (True, 31, 30)]


def hot_anchor_rows():
    """Texts with eight common words of a small hash, so that all windows over them, all different, have one anchor."""
    import numpy as np
    import pyarrow as pa

    from sitewright.llm import words

    draw = random.Random(9)
    phrases = [" ".join(f"c{draw.randrange(10**6)}" for _ in range(8)) for _ in range(3000)]
    hashes = np.concatenate([words.runs(piece, 8)[0] for piece in words.slices(pa.array(phrases), words.WHITE_SPACE, lower=False)])
    common = phrases[int(hashes.argmin())]
    word = lambda: f"w{draw.randrange(10**6)}"
    rows = [(i, " ".join([*(word() for _ in range(12)), common, *(word() for _ in range(12))])) for i in range(400)]
    return rows + [(1000 + i, rows[i][1]) for i in range(0, 400, 40)]


def test_edges_of_a_hot_anchor_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 200)
    rows = hot_anchor_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {row.doc_id: (row.n_words, row.n_removed, row.kept_sha256) for row in substrings.removal_report(frame).collect()}
    assert got == brute.removals(rows)
    parts = {}
    for row in substrings._dealt(frame, 20, 8).collect():
        kind, columns = substrings._unpack(row.blob)
        parts[row.part] = parts.get(row.part, 0) + (int(columns[5].sum()) if kind else 0)
    assert sum(parts.values()) >= 400 * 13
    assert max(parts.values()) < 0.6 * sum(parts.values())


def test_edges_of_an_anchor_are_told_apart_by_all_bits():
    import numpy as np
    import pyarrow as pa

    edge = np.array([2**40, 2**40 + 1, 2**40 + 2**15, 2**40], dtype=np.uint64)
    blob = substrings._pack_paths(edge, np.full(4, 7, dtype=np.uint64), np.arange(4), np.zeros(4, dtype=np.int64), np.arange(4), np.zeros(4, dtype=np.int64))
    found = substrings._decide(20)(pa.table({"part": [0], "blob": [blob]}))
    assert found.to_pylist() == [{"d": 3, "t": 0, "start": 0, "size": 20}]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, percent):
    want, sizes = brute.components(ROWS, percent)
    got = {row.doc_id: (row.n_shingles, row.component_id, row.kept) for row in near_duplicates.report(docs, percent).collect()}
    assert got == {doc_id: (size, component, component == doc_id) for (doc_id, _), component, size in zip(ROWS, want, sizes, strict=True)}


def test_large_bucket_loses_no_link(spark, monkeypatch):
    """A chain in which only neighbours are linked, compared a few at a time."""
    monkeypatch.setattr(near_duplicates, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_duplicates, "PIVOTS", 1)
    monkeypatch.setattr(near_duplicates, "BLOCK", 2)
    rows = [(i, " ".join(f"w{j}" for j in range(4 * i, 4 * i + 80))) for i in range(9)]
    want, _ = brute.components(rows, 80)
    got = {row.doc_id: row.component_id for row in near_duplicates.report(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()}
    assert got == {doc_id: component for (doc_id, _), component in zip(rows, want, strict=True)}
    assert set(got.values()) == {0}


@pytest.mark.parametrize("block", [4096, 7])
def test_large_buckets_are_stored_by_class(spark, monkeypatch, block):
    """Sixty classes that share twenty buckets make rows by class, and by bucket and pivot, but none for each class of each bucket."""
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    draw = random.Random(11)
    sets = [[draw.getrandbits(62) for _ in range(100)] for _ in range(58)]
    sets += [sets[50][:95] + [1, 2, 3, 4, 5], sets[51][:50] + sets[52][50:]]

    class Links(near_duplicates._Links):
        asked = []

        def confirm(self, pairs):
            self.asked.append(sorted((min(row), max(row)) for row in pairs.collect()))
            self.links = spark.createDataFrame([], "a long, b long")

    links = Links(near_duplicates.Bands.of(80), None, spark.createDataFrame(list(enumerate(sets)), "fp long, shingles array<long>"))
    members = spark.createDataFrame([(bucket, fp) for bucket in range(20) for fp in range(60)], "bucket long, fp long")
    counts, stored = [], near_duplicates.tables.stored

    def counted(frame):
        frame = stored(frame)
        counts.append(frame.count())
        return frame

    monkeypatch.setattr(near_duplicates.tables, "stored", counted)
    near_duplicates._candidates(members, links)
    assert links.asked[1] == [(50, 58)]
    assert max(counts) == 20 * near_duplicates.PIVOTS


def test_near_duplicate_stage_keeps_one_of_each_group(docs, spark):
    kept = near_duplicates.without_near_duplicates(docs, 80)
    assert kept.columns == docs.columns
    want, _ = brute.components(ROWS, 80)
    assert sorted(row.doc_id for row in kept.select("doc_id").collect()) == sorted(doc_id for (doc_id, _), c in zip(ROWS, want, strict=True) if c == doc_id)
    twice = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (None, "q"), (None, "r")], "doc_id long, text string")
    assert sorted((row.doc_id or 0, row.text) for row in near_duplicates.without_near_duplicates(twice).collect()) == [(0, "q"), (0, "r"), (5, "a b c d e f")]


ITEMS = [(1, " ".join(ROWS[40][1].split()[5:40])), (2, "ONE"), (3, ""), (4, None), (None, "a b, c"), (6, "never there at all"), (2, "ONE"), (8, ROWS[12][1])]


@pytest.mark.parametrize("block_bytes", [4_000_000, 150])
def test_decontamination(docs, spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block_bytes)
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(map(tuple, decontamination.report(docs, benchmark).collect()))
    want = sorted(brute.benchmark_hits(ROWS, ITEMS))
    assert got == want
    assert any(row[-1] for row in want)
    kept = decontamination.without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(row.doc_id for row in kept.select("doc_id").collect()) == sorted(row[0] for row in want if not row[-1])


def test_token_counts(docs, spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = [(-1, "  two\n\n\t x \n"), (-2, "a  b <|endoftext|> don't  it's"), (-3, "日本 語 naïve 12a ..\n.\n"), (-4, "x\x1cy \x1f\xa0z\x85"), (-5, "'s 't \n 've\t'd"), (None, "id")]
    rows = ROWS + odd
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {row.doc_id: tuple(row)[1:] for row in token_counts.count_tokens(frame, path, 100).collect()}
    for (doc_id, text), encoded in zip(rows, token_counts.tokenizer(path).encode_batch([text or "" for _, text in rows], add_special_tokens=False), strict=True):
        assert got[doc_id] == (len((text or "").encode()), len(encoded), len(encoded) > 100)


def test_cutting_agrees_with_the_library_on_all_plain_characters():
    import numpy as np
    import pyarrow as pa

    from sitewright.llm import words

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = [chr(code) for code in range(1, 0x240) if code not in (0x85, 0xA0)]
    samples = [pattern.format(c) for c in plain for pattern in ("a{0}b", " {0}{0} 1{0}", "{0} a", "a \n{0}", "{0}")]
    got = []
    for piece in words.slices(pa.array(samples), words.WHITE_SPACE, lower=False):
        starts, ends, doc = token_counts._pre_tokens(piece)
        assert not len(token_counts._whole_rows(piece, path))
        got.append(np.bincount(doc, weights=token_counts.lengths(path, token_counts._strings(piece.text, starts, ends)), minlength=piece.rows))
    assert np.concatenate(got).astype(int).tolist() == token_counts.lengths(path, samples).tolist()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string, n_chars long")
    items = spark.createDataFrame([], "item_id long, text string")
    assert substrings.removal_report(none).count() == substrings.without_repeats(none).count() == 0
    assert near_duplicates.report(none, 85).count() == near_duplicates.without_near_duplicates(none).count() == 0
    assert decontamination.report(none, items).count() == 0
    assert token_counts.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json"), 9).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(row)[1:4] for row in decontamination.report(some, items).collect()] == [(2, 0, 0)]


def test_two_tokenizers_in_one_session(spark):
    """Lengths that a Python worker keeps belong to one tokenizer."""
    docs = spark.createDataFrame([(i, f"Unbelievably Word{i} tokenization {i * 7919}") for i in range(40)], "doc_id long, text string").repartition(1)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        library = token_counts.tokenizer(path)
        want = {row.doc_id: len(library.encode(row.text, add_special_tokens=False).ids) for row in docs.collect()}
        assert {row.doc_id: row.n_tokens for row in token_counts.count_tokens(docs, path, 10).collect()} == want
