"""Passages of evaluation items in documents, by a prefix-filtered set join.

An item's windows are its runs of `window` words (10); an item with fewer words is one window. Words are runs of letters, digits
and non-ASCII characters, A-Z lowered. A window is a set of positioned shingles of SHINGLE words (or all its words, if fewer).
To occur in a document, all its shingles must: the necessary prefix of the set, ordered by rarity in the whole corpus, is its
rarest shingle. Documents are probed for these prefix shingles alone. A hit and the shingle's place give the only start the window can
have; it must lie inside the text (positional and length bound), and then all its words are compared in turn.

* Shingle counts cover all documents. Each task adds them up before the shuffle.
* Items are broadcast in blocks of about BLOCK_BYTES of text. A larger set of items takes more blocks and as many more passes over
  the documents; nothing else changes.
* What is shuffled are spans of documents with hits, and the documents' ids and word counts; never their texts.

Null and empty texts have no words, and so no windows. Repeated items count once by id; an item without an id is named "null".
Rows that repeat id and text get equal results. Without items or without documents nothing is hit. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm import tables, words

WINDOW, SHINGLE = 10, 3
BLOCK_BYTES = 4_000_000
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_HITS = "d long, t long, spans array<long>, items array<string>"


@dataclass
class _Windows:
    """Distinct windows of a block of items. `words` has a row of word hashes for each, `count` its length, `items` its items."""

    words: np.ndarray
    count: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, texts: list[tuple[str, str]], window: int) -> _Windows:
        found: dict[bytes, set[str]] = {}
        for item, text in texts:
            for piece in words.slices(pa.array([text]), words.NOT_ALPHANUMERIC, lower=True):
                for at in range(max(1, len(piece.hash) - window + 1) if len(piece.hash) else 0):
                    found.setdefault(piece.hash[at : at + window].tobytes(), set()).add(item)
        rows = np.zeros((len(found), window), dtype=np.uint64)
        count = np.array([len(key) // 8 for key in found], dtype=np.int64)
        for row, key in zip(rows, found, strict=True):
            row[: len(key) // 8] = np.frombuffer(key, dtype=np.uint64)
        return cls(rows, count, [sorted(x) for x in found.values()])

    def shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, size, window and place of every shingle of every window."""
        out = []
        for size in range(1, SHINGLE + 1):
            own = np.flatnonzero(np.minimum(self.count, SHINGLE) == size)
            for at in range(self.words.shape[1] - size + 1):
                rows = own[self.count[own] >= at + size]
                if len(rows):
                    out.append((_combined(self.words[rows, at : at + size]), np.full(len(rows), size), rows, np.full(len(rows), at)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)


def _combined(rows: np.ndarray) -> np.ndarray:
    key = np.full(len(rows), np.uint64(rows.shape[1]))
    for column in rows.T:
        key = words.mixed(key ^ column)
    return key


def _shingles(piece: words.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's runs of so many words, and where they start."""
    count = len(piece.hash) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.full(count, np.uint64(size))
    for i in range(size):
        key = words.mixed(key ^ piece.hash[i : i + count])
    whole = np.flatnonzero(piece.doc[size - 1 :] == piece.doc[:count])
    return key[whole], whole


def _member(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in a sorted array, and where. A small bit table turns most away before the search."""
    bits = max(16, int(len(sorted_keys)).bit_length() + 4)
    shift = np.uint64(64 - bits)
    gate = np.zeros(1 << bits, dtype=bool)
    gate[sorted_keys >> shift] = True
    may = np.flatnonzero(gate[keys >> shift])
    at = np.minimum(np.searchsorted(sorted_keys, keys[may]), len(sorted_keys) - 1)
    hit = sorted_keys[at] == keys[may]
    return may[hit], at[hit]


def _corpus_counts(texts: DataFrame, keys: np.ndarray, sizes: list[int]) -> np.ndarray:
    """How often each shingle of the block occurs in all documents."""
    shared = texts.sparkSession.sparkContext.broadcast(keys)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for piece in words.slices(batch.column(0), words.NOT_ALPHANUMERIC, lower=True):
                for size in sizes:
                    counts += np.bincount(_member(known, _shingles(piece, size)[0])[1], minlength=len(known))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["shingle", "n"])

    total = np.zeros(len(keys), dtype=np.int64)
    for row in tables.batched(texts).select("text").mapInArrow(counted, "shingle int, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect():
        total[row.shingle] = row.n
    return total


@dataclass
class _Index:
    """Prefix shingles, sorted; entries bounds[k] to bounds[k + 1] are the windows that have shingle k as prefix."""

    keys: np.ndarray
    bounds: np.ndarray
    window: np.ndarray
    place: np.ndarray
    sizes: list[int]
    windows: _Windows


def _index(texts: DataFrame, windows: _Windows) -> _Index | None:
    shingle, size, window, place = windows.shingles()
    if not len(shingle):
        return None
    keys, inverse = np.unique(shingle, return_inverse=True)
    sizes = sorted(set(size.tolist()))
    rarity = _corpus_counts(texts, keys, sizes)[inverse]
    order = np.lexsort((place, rarity, window))
    prefix = order[np.flatnonzero(np.diff(window[order], prepend=-1))]
    prefix = prefix[np.argsort(shingle[prefix], kind="stable")]
    own, first = np.unique(shingle[prefix], return_index=True)
    return _Index(own, np.append(first, len(prefix)), window[prefix], place[prefix], sizes, windows)


def _found(piece: words.Words, index: _Index) -> tuple[np.ndarray, np.ndarray]:
    """Start and window of every occurrence in a slice."""
    starts, windows = [], []
    for size in index.sizes:
        hashes, at = _shingles(piece, size)
        hit, key = _member(index.keys, hashes)
        many = index.bounds[key + 1] - index.bounds[key]
        entry = np.repeat(index.bounds[key], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        where = np.repeat(at[hit], many)
        window, start = index.window[entry], where - index.place[entry]
        doc, count = piece.doc[where], index.windows.count[window]
        inside = (start >= piece.first[doc]) & (start + count <= piece.first[doc + 1])
        start, window, count = start[inside], window[inside], count[inside]
        for i in range(index.windows.words.shape[1]):
            rest = (count <= i) | (piece.hash[np.minimum(start + i, len(piece.hash) - 1)] == index.windows.words[window, i])
            start, window, count = start[rest], window[rest], count[rest]
        starts.append(start)
        windows.append(window)
    return np.concatenate(starts), np.concatenate(windows)


def _probe(docs: DataFrame, index: _Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for piece in words.slices(batch.column(2), words.NOT_ALPHANUMERIC, lower=True):
                start, window = _found(piece, index)
                if not len(start):
                    continue
                order = np.lexsort((window, start))
                start, window = start[order], window[order]
                doc = piece.doc[start]
                rows = np.flatnonzero(np.diff(doc, prepend=-1))
                spans, items = [], []
                for low, high in zip(rows, np.append(rows[1:], len(doc)), strict=True):
                    own = (start[low:high] - piece.first[doc[low]] << 32) + index.windows.count[window[low:high]]
                    spans.append(np.unique(own).tolist())
                    items.append(sorted({item for w in np.unique(window[low:high]) for item in index.windows.items[w]}))
                at = pa.array(piece.row + doc[rows])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["d", "t", "spans", "items"])

    return tables.batched(docs).select(tables.order_key().alias("d"), tables.text_key().alias("t"), "text").mapInArrow(hits, _HITS)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """d, t, spans (start and size, packed) and items of the documents in which windows occur, one row for each."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    found = None
    for block in range(blocks):
        texts = [(row.item, row.text) for row in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).distinct().collect()]
        index = _index(docs, _Windows.of(texts, window))
        if index:
            own = _probe(docs, index)
            found = own if found is None else found.unionByName(own)
    if found is None:
        return docs.sparkSession.createDataFrame([], _HITS)
    return found.groupBy("d", "t").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _covered(spans: Column) -> Column:
    """Number of words under packed spans, which may overlap."""
    def add(state: Column, span: Column) -> Column:
        low = F.shiftright(span, 32)
        high = low + span.bitwiseAND(F.lit(0xFFFFFFFF))
        return F.struct(F.greatest(state["end"], high).alias("end"), (state["n"] + F.greatest(high - F.greatest(low, state["end"]), F.lit(0))).alias("n"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), add)["n"]


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document."""
    rows = docs.select(F.col("doc_id").cast("long"), tables.order_key().alias("d"), tables.text_key().alias("t"), F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long"))
    return rows.join(hits(docs, benchmark, window), ["d", "t"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window occurs, with all their columns."""
    found = hits(docs, benchmark, window).select(F.col("d").alias("__d"), F.col("t").alias("__t"))
    keyed = docs.withColumns({"__order": tables.order_key(), "__text": tables.text_key()})
    return keyed.join(found, (F.col("__order") == F.col("__d")) & (F.col("__text") == F.col("__t")), "left_anti").select(*docs.columns)
