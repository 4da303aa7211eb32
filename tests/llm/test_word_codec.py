"""Token ids and decoded texts against the library, text by text."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sitewright.llm import word_codec

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = ["a", "b", " ", "  ", "\n", "\t", " ", "'s", "'ll", "12", ",", "!!", "x" * 70, "é", "ß", "ÿ", "word", "  \n ", "\r\n", "日本", "<|endoftext|>", "<|endo", "\x0b", "\u0085", "ɐ", "😀"]


def texts():
    draw = random.Random(1)
    found = ["".join(draw.choice(LETTERS if i % 3 else LETTERS[:19]) for _ in range(draw.randrange(0, 60))) for i in range(1200)]
    return [*found, None, "", "", " ", "the quick " * 60_000 + "😀", "日本語 " * 20_000, "y" * 5000, found[7], found[7]]


def expected(text):
    ids = word_codec.library(PATH).encode(text or "", add_special_tokens=False).ids
    decoded = word_codec.library(PATH).decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@pytest.mark.parametrize("frequent", [60_000, 20, 0])
def test_ids_and_texts(spark, monkeypatch, frequent):
    monkeypatch.setattr(word_codec, "FREQUENT", frequent)
    rows = [(i if i % 50 else None, text) for i, text in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({name: F.lit("x") for name in ("ids", "block", "part", "kind", "n_tokens", "decoded", "word")})
    got = word_codec.report(docs, PATH).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(doc_id, *expected(text)) for doc_id, text in rows], key=str)


def test_long_texts_are_cut_for_the_library(spark, monkeypatch):
    monkeypatch.setattr(word_codec, "CUT", 7)
    found = [text for text in texts() if text and len(text) < 5000]
    for text in found[:300]:
        assert "".join(word_codec._chunks(text)) == text
        data, at = text.encode(), 0
        ids = []
        for size in word_codec._library_sizes(text, PATH).tolist():
            ids += word_codec.encoded(PATH, [data[at : at + size]])[0].tolist()
            at += size
        assert at == len(data) and ids == word_codec.library(PATH).encode(text, add_special_tokens=False).ids


def test_every_word_is_encoded_once(spark, monkeypatch):
    """Words outside the table are encoded once in the whole corpus, however many texts have them."""
    monkeypatch.setattr(word_codec, "FREQUENT", 0)
    seen = spark.sparkContext.accumulator(0)
    plain = word_codec.encoded

    def watched(path, words):
        seen.add(len(words))
        return plain(path, words)

    monkeypatch.setattr(word_codec, "encoded", watched)
    docs = spark.createDataFrame([(i, f"same words here {i % 7}") for i in range(400)], "doc_id long, text string").repartition(6)
    assert word_codec.report(docs, PATH).count() == 400
    assert seen.value == 4 + 6


def test_nothing(spark):
    assert word_codec.report(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_bytes_that_are_no_text_decode_as_in_the_library(spark):
    library = word_codec.library(PATH)
    draw = random.Random(4)
    rows = [(i, [draw.randrange(50257) for _ in range(30)]) for i in range(50)]
    frame = spark.createDataFrame([(i, np.array(ids, dtype="<u4").tobytes()) for i, ids in rows] + [(99, None)], "doc_id long, ids binary")
    got = {row.doc_id: row.decoded for row in word_codec.decode(frame, PATH).collect()}
    assert got.pop(99) == ""
    assert got == {i: library.decode(ids, skip_special_tokens=False) for i, ids in rows}


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        word_codec.library(public_tokenizers.path("word_bpe_49k.json"))
