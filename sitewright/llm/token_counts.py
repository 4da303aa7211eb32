"""Token counts of texts by a two-tier lookup of pre-tokens inside the map tasks.

A byte-level tokenizer cuts a text into pre-tokens that are encoded one by one. Here a pre-token is a word with the space before
it, or a piece of other white space, cut where the vocabulary's pattern cuts too; its number of tokens does not depend on its
neighbours, so a text's count is a sum of lengths.

* First tier: a broadcast table of hashes and lengths of the most frequent pre-tokens of the whole corpus. It has at most
  FREQUENT entries. They come from the largest counts of each task: for every COUNTED pre-tokens at most REPORTED strings are shuffled to
  add their counts up. All other pre-tokens stay in their task.
* Second tier: a cache in each Python worker. What it does not hold is encoded by the tokenizer library, once for each slice; the
  cache starts afresh when full.

Both tiers only save work, every length is the library's own. Texts in which the library might cut otherwise go to it whole:
those with special strings (which count as the library has them by default), with characters from U+0240 on, whose class may
differ between Unicode versions, or with the two other white-space characters below that.

Null and empty texts have no tokens. Repeated rows count alike. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitewright.llm import words
from sitewright.llm.tables import batched

FREQUENT, LONGEST = 50_000, 64
#: Pre-tokens that a task counts at a time, and the largest counts that it reports for them.
COUNTED, REPORTED = 2_000_000, 10_000
#: Entries of a worker's cache.
HELD = 400_000
_SPACE, _WIDE, _TWO = 0x20, 0xC9, 0xC2


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def lengths(path: str, texts: list[str]) -> np.ndarray:
    return np.array([len(found) for found in tokenizer(path).encode_batch(texts, add_special_tokens=False)], dtype=np.int64)


def _whole_rows(piece: words.Words, path: str) -> np.ndarray:
    """Rows whose texts go to the library as they are."""
    text = piece.text
    at = [np.flatnonzero(text >= _WIDE)]
    two = np.flatnonzero(text[:-1] == _TWO)
    at.append(two[np.isin(text[two + 1], (0x85, 0xA0))])
    data = text.tobytes()
    for token in tokenizer(path).get_added_tokens_decoder().values():
        special, found = token.content.encode(), -1
        while (found := data.find(special, found + 1)) >= 0:
            at.append(np.array([found]))
    return np.unique(np.searchsorted(piece.bounds, np.concatenate(at), side="right") - 1)


def _pre_tokens(piece: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every pre-token of a slice."""
    text, start, end, doc = piece.text, piece.start, piece.end, piece.doc
    opens = piece.bounds[doc]
    before = np.where(np.diff(doc, prepend=-1) > 0, opens, np.append(0, end[:-1])) if len(doc) else start
    spaced = (start > before) & (text[start - 1] == _SPACE)
    head = start - 1
    gap = start - before
    long, single = gap > 1, (gap > 0) & ~spaced
    closes = np.append(piece.first[1:], 0)[:-1] - 1
    rows = np.arange(piece.rows)
    tail = np.where(piece.counts > 0, end[closes] if len(end) else 0, piece.bounds[:-1])
    open_end = piece.bounds[1:] > tail
    starts = np.concatenate([start - spaced, before[long], head[single], tail[open_end]])
    ends = np.concatenate([end, head[long], start[single], piece.bounds[1:][open_end]])
    return starts, ends, np.concatenate([doc, doc[long], doc[single], rows[open_end]])


def _strings(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    data = text.tobytes()
    return [data[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def frequent_lengths(texts: DataFrame, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the corpus's frequent pre-tokens, and their lengths."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in words.slices(batch.column(0), words.WHITE_SPACE, lower=False):
                starts, ends, _ = _pre_tokens(piece)
                short = np.flatnonzero(ends - starts <= LONGEST)
                hashes, first, counts = np.unique(piece.parts(starts[short], ends[short]), return_index=True, return_counts=True)
                often = np.flatnonzero(counts > 1)
                held.append((hashes[often], counts[often], _strings(piece.text, starts[short[first[often]]], ends[short[first[often]]])))
                size += len(starts)
                if size >= COUNTED:
                    yield _largest(held)
                    held, size = [], 0
        if held:
            yield _largest(held)

    counts = texts.select("text").mapInArrow(counted, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = [row.token for row in counts.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()]
    hashes = np.zeros(0, dtype=np.uint64)
    if top:
        encoded = [token.encode() for token in top]
        bounds = np.cumsum([0, *map(len, encoded)])
        whole = words.slices(pa.array(["".join(top)]), words.WHITE_SPACE, lower=False)
        hashes = next(whole).parts(bounds[:-1], bounds[1:])
    order = np.argsort(hashes)
    return hashes[order], lengths(path, top)[order] if top else np.zeros(0, dtype=np.int64)


def _largest(held: list) -> pa.RecordBatch:
    hashes, counts = (np.concatenate(column) for column in list(zip(*held, strict=True))[:2])
    tokens = [token for _, _, own in held for token in own]
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    totals = np.bincount(group, weights=counts).astype(np.int64)
    top = np.argsort(-totals, kind="stable")[:REPORTED]
    return pa.RecordBatch.from_arrays([pa.array([tokens[i] for i in first[top]], pa.string()), pa.array(totals[top])], ["token", "n"])


class _Worker:
    """The second tier of a Python worker: hash to length, for one tokenizer. Workers outlive queries, so the tokenizer is part of it."""

    path: str | None = None
    cache: dict[int, int] = {}


def _looked_up(piece: words.Words, starts: np.ndarray, ends: np.ndarray, table: tuple[np.ndarray, np.ndarray], path: str) -> np.ndarray:
    hashes = piece.parts(starts, ends)
    known, sizes = table
    found = np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
    hit = known[at] == hashes if len(known) else np.zeros(len(hashes), dtype=bool)
    found[hit] = sizes[at[hit]]
    rest = np.flatnonzero(~hit)
    if len(rest):
        unknown, first, group = np.unique(hashes[rest], return_index=True, return_inverse=True)
        if _Worker.path != path or len(_Worker.cache) > HELD:
            _Worker.path, _Worker.cache = path, {}
        cache, keys = _Worker.cache, unknown.tolist()
        new = np.array([i for i, key in enumerate(keys) if key not in cache], dtype=np.int64)
        if len(new):
            own = rest[first[new]]
            cache.update(zip(unknown[new].tolist(), lengths(path, _strings(piece.text, starts[own], ends[own])).tolist(), strict=True))
        found[rest] = np.array([cache[key] for key in keys], dtype=np.int64)[group]
    return found


def count_tokens(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the count exceeds the limit, for every document."""
    texts = batched(docs).select(F.col("doc_id").cast("long"), "text")
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(texts, path))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in words.slices(batch.column(1), words.WHITE_SPACE, lower=False):
                starts, ends, doc = _pre_tokens(piece)
                whole = _whole_rows(piece, path)
                if len(whole):
                    plain = ~np.isin(doc, whole)
                    starts, ends, doc = starts[plain], ends[plain], doc[plain]
                totals = np.bincount(doc, weights=_looked_up(piece, starts, ends, table.value, path), minlength=piece.rows).astype(np.int64)
                if len(whole):
                    totals[whole] = lengths(path, _strings(piece.text, piece.bounds[whole], piece.bounds[whole + 1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.row, piece.rows), pa.array(np.diff(piece.bounds)), pa.array(totals), pa.array(totals > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return texts.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
