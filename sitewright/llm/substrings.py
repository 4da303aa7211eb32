"""Removal of long word sequences that occur earlier in the corpus.

The corpus is read as a de Bruijn graph. An edge is a run of `window` words (20); two edges are neighbours if they overlap in
all but one word. Every edge carries an anchor, the smallest hash among its runs of `anchor` words (8), so equal edges carry
equal anchors, and neighbouring edges mostly share one. A run of neighbouring edges of one text that share an anchor is packed into
one record (anchor, source coordinate of its first edge, hashes of its edges), called a path here, and dealt out by anchor. This
replaces compaction: paths of different texts may branch, there is no test of degrees, and edges are matched one by one. All occurrences of an edge so meet in one group, where the smallest source coordinate keeps its words and all others
become spans. Spans of a text are joined back to it by Spark and its remaining words are put together.

* An edge's identity is the 64 bits of its own hash and 32 bits of its anchor's; within one anchor only the 64 bits tell edges apart.
  Texts are not compared again word by word.
* Edges are counted by anchor first, in CELLS counters. A counter of more than HOT edges has its anchors dealt out by the edge's hash
  too, so that no anchor, however many different edges it has, fills a group; equal edges still meet.
* Within a map task only the smallest coordinate of an edge is sent on, the others are decided on the spot. A passage that a
  third of all texts share is thus sent once for each task's buffer, never once for each text.
* Coordinates are ordered by doc_id (null last), then by text, then by position. Rows that repeat id and text are one document.
* Null and empty texts have no words; a text shorter than a window keeps all its words. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from sitewright.llm import tables, words

WINDOW, ANCHOR = 20, 8
#: Edges that a map task holds before it sends them on.
BUFFER = 400_000
#: Counters of edges by anchor, and the edges of one counter from which on its anchors are dealt out by edges too.
CELLS, HOT = 1 << 16, 500_000
_SENT = "part int, blob binary"
_SPANS = "d long, t long, start int, size int"


def _key_columns(docs: DataFrame) -> DataFrame:
    return tables.batched(docs).select(tables.order_key().alias("d"), tables.text_key().alias("t"), "text")


class _Buffer:
    """Edges of the texts read so far, by columns."""

    def __init__(self, window: int, parts: int, shares: np.ndarray) -> None:
        self.window, self.parts, self.shares = window, parts, shares
        self.held, self.count, self.ids, self.texts = [], 0, [], []
        self.docs = 0

    def add_ids(self, ids: np.ndarray, texts: np.ndarray) -> int:
        base = self.docs
        self.ids.append(ids)
        self.texts.append(texts)
        self.docs += len(ids)
        return base

    def add(self, edge: np.ndarray, anchor: np.ndarray, doc: np.ndarray, start: np.ndarray) -> None:
        self.held.append((edge, anchor, doc.astype(np.int32), start.astype(np.int32)))
        self.count += len(edge)

    def rows(self) -> Iterator[tuple[int, bytes]]:
        """What goes to each part: decided spans, and the paths of undecided edges."""
        if self.count:
            edge, anchor, doc, start = (np.concatenate(column) for column in zip(*self.held, strict=True))
            self.held = []
            ids, texts = np.concatenate(self.ids), np.concatenate(self.texts)
            later = _later(edge, anchor, ids[doc], texts[doc], start)
            at = np.flatnonzero(later)
            if len(at):
                yield int(anchor[0] % np.uint64(self.parts)), _pack_spans(*_spans(ids[doc[at]], texts[doc[at]], start[at], self.window))
            at = np.flatnonzero(~later)
            part = _part(edge[at], anchor[at], self.shares, self.parts)
            at = at[np.argsort(part, kind="stable")]
            part = np.sort(part, kind="stable")
            bounds = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                own = at[low:high]
                yield int(part[low]), _pack_paths(edge[own], anchor[own], doc[own], start[own], ids, texts)
        self.__init__(self.window, self.parts, self.shares)


def _part(edge: np.ndarray, anchor: np.ndarray, shares: np.ndarray, parts: int) -> np.ndarray:
    """Where an edge goes: by its anchor, and in a hot cell also by its own hash. Equal edges go to one part."""
    share = words.mixed(edge) % shares[(anchor % np.uint64(len(shares))).astype(np.int64)]
    dealt = np.where(share > 0, words.mixed(anchor + share * np.uint64(0x9E3779B97F4A7C15)), anchor)
    return ((dealt >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _later(edge: np.ndarray, anchor: np.ndarray, ids: np.ndarray, texts: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether an equal edge has a smaller coordinate."""
    order = np.argsort(edge, kind="stable")
    e, a = edge[order], anchor[order]
    shared = np.zeros(len(e), dtype=bool)
    same = e[1:] == e[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    found = np.zeros(len(edge), dtype=bool)
    order = order[shared]
    if len(order):
        order = order[np.lexsort((start[order], texts[order], ids[order], anchor[order], edge[order]))]
        e, a = edge[order], anchor[order]
        group = np.ones(len(order), dtype=bool)
        group[1:] = (e[1:] != e[:-1]) | (a[1:] != a[:-1])
        first = order[np.maximum.accumulate(np.where(group, np.arange(len(order)), 0))]
        found[order] = (ids[order] != ids[first]) | (texts[order] != texts[first]) | (start[order] != start[first])
    return found


def _spans(ids: np.ndarray, texts: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Word spans under edges that are given in the order of their texts; edges that touch make one span."""
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1]) | (start[1:] < start[:-1]) | (start[1:] > start[:-1] + window)
    low = np.flatnonzero(fresh)
    high = np.append(low[1:], len(start)) - 1
    return ids[low], texts[low], start[low].astype(np.int32), (start[high] - start[low] + window).astype(np.int32)


def _pack(kind: int, counts: tuple[int, int, int], *columns: np.ndarray) -> bytes:
    return np.array([kind, *counts], dtype=np.int64).tobytes() + b"".join(column.tobytes() for column in columns)


def _pack_spans(ids: np.ndarray, texts: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    return _pack(0, (len(ids), 0, 0), ids, texts, start, size)


def _pack_paths(edge: np.ndarray, anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, ids: np.ndarray, texts: np.ndarray) -> bytes:
    fresh = np.ones(len(edge), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1])
    low = np.flatnonzero(fresh)
    length = np.diff(np.append(low, len(edge)))
    named, local = np.unique(doc[low], return_inverse=True)
    key = anchor[low]
    return _pack(
        1, (len(low), len(edge), len(named)), ids[named], texts[named],
        (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), local.astype(np.uint32), start[low].astype(np.uint32), length.astype(np.uint32), np.ascontiguousarray(edge),
    )


def _unpack(blob: bytes) -> tuple[int, list[np.ndarray]]:
    kind, rows, edges, named = np.frombuffer(blob, dtype=np.int64, count=4)
    at, columns = 32, []
    layout = [(rows, "i8"), (rows, "i8"), (rows, "i4"), (rows, "i4")] if kind == 0 else [(named, "i8"), (named, "i8"), *[(rows, "u4")] * 4, (edges, "u8")]
    for count, form in layout:
        columns.append(np.frombuffer(blob, dtype=form, count=count, offset=at))
        at += columns[-1].nbytes
    return int(kind), columns


def _anchored(piece: words.Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, anchor and first word of every edge of a slice."""
    edge, at = words.runs(piece, window)
    if not len(at):
        return edge, edge, at
    inner, where = words.runs(piece, anchor)
    marks = np.full(len(piece.hash) - anchor + 1, np.uint64(2**64 - 1))
    marks[where] = inner
    return edge, words.minima(marks, window - anchor + 1)[at], at


def _counted(window: int, anchor: int, cells: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            for piece in words.slices(batch.column(0), words.WHITE_SPACE, lower=False):
                total += np.bincount((_anchored(piece, window, anchor)[1] % np.uint64(cells)).astype(np.int64), minlength=cells)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["cell", "n"])

    return counts


def edge_shares(docs: DataFrame, window: int, anchor: int) -> np.ndarray:
    """Shares into which the edges of each cell are dealt out. Each task sums its edges by cell before the shuffle."""
    counts = tables.batched(docs).select("text").mapInArrow(_counted(window, anchor, CELLS), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    shares = np.ones(CELLS, dtype=np.uint64)
    for row in counts.where(F.col("n") > HOT).collect():
        shares[row.cell] = -(-row.n // HOT)
    return shares


def _send(window: int, anchor: int, parts: int, shares: np.ndarray):
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = _Buffer(window, parts, shares)
        for batch in batches:
            ids, texts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for piece in words.slices(batch.column(2), words.WHITE_SPACE, lower=False):
                edge, lowest, at = _anchored(piece, window, anchor)
                if not len(at):
                    continue
                base = buffer.add_ids(ids[piece.row : piece.row + piece.rows], texts[piece.row : piece.row + piece.rows])
                buffer.add(edge, lowest, base + piece.doc[at], at - piece.first[piece.doc[at]])
                if buffer.count >= BUFFER:
                    yield from _batches(buffer.rows())
        yield from _batches(buffer.rows())

    return edges


def _batches(rows: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    parts, blobs = [], []
    for part, blob in rows:
        parts.append(part)
        blobs.append(blob)
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def _decide(window: int):
    def spans(table: pa.Table) -> pa.Table:
        out, edges, anchors, ids, texts, starts = [], [], [], [], [], []
        for blob in table.column("blob").to_pylist():
            kind, columns = _unpack(blob)
            if kind == 0:
                out.append(columns)
                continue
            named_ids, named_texts, key, local, start, length, edge = columns
            within = np.arange(len(edge)) - np.repeat(np.cumsum(length) - length, length)
            edges.append(edge)
            anchors.append(np.repeat(key, length))
            ids.append(np.repeat(named_ids[local], length))
            texts.append(np.repeat(named_texts[local], length))
            starts.append((np.repeat(start, length) + within).astype(np.int32))
        if edges:
            edge, anchor, doc, text, start = (np.concatenate(x) for x in (edges, anchors, ids, texts, starts))
            at = np.flatnonzero(_later(edge, anchor, doc, text, start))
            if len(at):
                at = at[np.lexsort((start[at], text[at], doc[at]))]
                out.append(_spans(doc[at], text[at], start[at], window))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, dtype=k) for k in ("i8", "i8", "i4", "i4")]
        return pa.table(dict(zip(("d", "t", "start", "size"), columns, strict=True)))

    return spans


def _dealt(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Decided spans and undecided paths, by part."""
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(2 * tables.shuffle_partitions(docs.sparkSession), size // 8_000_000)
    return _key_columns(docs).mapInArrow(_send(window, anchor, parts, edge_shares(docs, window, anchor)), _SENT)


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Word spans (d, t, start, size) under edges that also start earlier. Spans of one text may overlap."""
    return _dealt(docs, window, anchor).groupBy("part").applyInArrow(_decide(window), _SPANS)


def _kept(text: str | None, spans) -> tuple[list[bytes], np.ndarray]:
    own = (text or "").encode().split()
    keep = np.ones(len(own), dtype=bool)
    for packed in spans if spans is not None else ():
        start = packed >> 32
        keep[start : start + (packed & 0xFFFFFFFF)] = False
    return own, keep


def _with_spans(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """The documents with a column __spans of packed spans, null where nothing repeats."""
    spans = repeated_spans(docs, window, anchor).select(F.col("d").alias("__d"), F.col("t").alias("__t"), (F.shiftleft(F.col("start").cast("long"), 32) + F.col("size")).alias("__span"))
    spans = spans.groupBy("__d", "__t").agg(F.collect_list("__span").alias("__spans"))
    keyed = docs.withColumns({"__order": tables.order_key(), "__text": tables.text_key()})
    return keyed.join(spans, (F.col("__order") == F.col("__d")) & (F.col("__text") == F.col("__t")), "left")


def removal_report(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words that stay, joined by single spaces."""
    columns = docs.select("doc_id", "text")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, hashes = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                own, keep = _kept(text.as_py(), spans.as_py())
                stay = int(keep.sum())
                counts.append(len(own))
                removed.append(len(own) - stay)
                hashes.append(hashlib.sha256(b" ".join(own if stay == len(own) else compress(own, keep))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    frame = _with_spans(columns, window, anchor).select(F.col("doc_id").cast("long"), "text", "__spans")
    return frame.mapInArrow(digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The documents with repeated words cut out of their texts; texts that lose nothing stay byte for byte.

    Of a text that loses words, the others are joined by single spaces, with its own line breaks between lines that keep words.
    A document that loses all its words goes. `n_chars` follows the text, where there is such a column.
    """
    frame = _with_spans(docs, window, anchor).select(*docs.columns, "__spans")
    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(text.as_py(), spans.as_py()) for text, spans in zip(batch.column(at), batch.column("__spans"), strict=True)]
            left = [text if spans is None else _cut(text, spans) for text, spans in own]
            columns = batch.columns[:-1]
            columns[at] = pa.array(left, batch.schema.field(at).type)
            gone = pa.array([spans is None or bool(text) for text, (_, spans) in zip(left, own, strict=True)])
            yield pa.RecordBatch.from_arrays([*columns, batch.column("__spans").is_valid()], [*names, "__cut"]).filter(gone)

    stay = frame.mapInArrow(cut, StructType([*schema, StructField("__cut", BooleanType())]))
    if "n_chars" in docs.columns:
        stay = stay.withColumn("n_chars", F.when(F.col("__cut"), F.length("text").cast(schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return stay.select(*docs.columns)


def _cut(text: str | None, spans) -> str:
    own, keep = _kept(text, spans)
    lines, at = [], 0
    for line in (text or "").encode().split(b"\n"):
        count = len(line.split())
        if stay := list(compress(own[at : at + count], keep[at : at + count])):
            lines.append(b" ".join(stay))
        at += count
    return b"\n".join(lines).decode()
