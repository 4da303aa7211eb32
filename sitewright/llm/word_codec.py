"""Token ids of texts by a table of distinct words, and texts of token ids by a table of pieces.

A byte-level tokenizer cuts a text into pre-tokens that it encodes one by one. A word here is one or more whole pre-tokens: a run
of other characters than white space with the space before it, or a piece of other white space. Its ids do not depend on its neighbours. Texts in which the
library might cut otherwise (special strings, characters from U+0240 on) are cut by the library's own rule.

* Split: each slice of about a megabyte of texts becomes one block. Its words are replaced by their ranks in a broadcast table of
  frequent words, at most FREQUENT of at most LONGEST bytes each, which were encoded once. The table comes from the largest counts of each task.
* All other words of a block are sent, once for each block, to the part of their hash. There every distinct word is encoded
  once, and its ids go back to the block in the order asked. A word that no task reports as frequent makes up less than about
  1 / REPORTED of all words, so no part is hot. Words of more than LONGEST bytes are encoded where they lie; they may be any text without a space and are not sent at all.
* Join by position: the places of a block and the ids of its words meet, and the ids are put in the order of the places. Texts are cut twice, once to ask and
  once for the places: that halves what is shuffled.
* Decoding looks each id up in the broadcast table of pieces, which has the size of the vocabulary, and joins their bytes in order. Bytes
  that are no UTF-8 become U+FFFD, as in the library.

Special strings inside texts count as the library has them by default. Null and empty texts have no ids. Rows without doc_id and repeated rows stay rows of their own.
A text's ids must fit into one task. Other columns are not read. The input has to give the same rows in the same partitions when a task is run again, as stored tables do.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitewright.llm import words
from sitewright.llm.tables import batched, shuffle_partitions

FREQUENT, LONGEST = 60_000, 64
#: Words that a task counts at a time, and the largest counts that it reports for them.
COUNTED, REPORTED = 2_000_000, 10_000
#: Bytes of text for each part of words, and characters that the library cuts at a time.
PART_BYTES, CUT = 8_000_000, 200_000
#: Marks a place that is still open.
OPEN = 0xFFFF
_SPACE, _WIDE, _TWO = 0x20, 0xC9, 0xC2
_ASKED, _ANSWERED = "part int, block long, blob binary", "block long, part int, blob binary"
#: Stands for a part in the row that holds the places of a block.
_PLACES = -1
_SAFE = re.compile(r"[A-Za-z](?= [A-Za-z])")


@lru_cache(maxsize=4)
def library(path: str) -> Tokenizer:
    """The tokenizer, which must be a byte-level one without normaliser that adds no space in front."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    form = parts.get("pre_tokenizer") or {}
    if parts.get("normalizer") or form.get("type") != "ByteLevel" or form.get("add_prefix_space") or not form.get("use_regex", True):
        raise ValueError("words are encoded one by one for plain byte-level tokenizers only")
    if any(token["lstrip"] or token["rstrip"] or token["single_word"] for token in parts.get("added_tokens", ())):
        raise ValueError("special strings must not reach beyond themselves")
    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(maxsize=4)
def _special(path: str) -> re.Pattern | None:
    """Splits at special strings, longest first; they stay in the result."""
    found = sorted((token.content for token in library(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None


def encoded(path: str, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and how many each word has."""
    flat, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for low in range(0, len(texts), 10_000):
        found = library(path).encode_batch([text.decode() for text in texts[low : low + 10_000]], add_special_tokens=False)
        sizes[low : low + len(found)] = [len(x.ids) for x in found]
        flat.append(np.array([i for x in found for i in x.ids], dtype=np.uint32))
    return np.concatenate(flat) if flat else np.zeros(0, dtype=np.uint32), sizes


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes first[i], first[i] + 1 ... of size[i] each, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _library_rows(piece: words.Words, path: str) -> np.ndarray:
    """Rows that the library has to cut: special strings, wide characters and rare white space."""
    text, data = piece.text, piece.text.tobytes()
    two = np.flatnonzero(text[:-1] == _TWO)
    at = [np.flatnonzero(text >= _WIDE), two[np.isin(text[two + 1], (0x85, 0xA0))]]
    if pattern := _special(path):
        at.append(np.array([found.start() for found in re.finditer(pattern.pattern.encode(), data)], dtype=np.int64))
    return np.unique(np.searchsorted(piece.bounds, np.concatenate(at), side="right") - 1)


def _chunks(text: str) -> Iterator[str]:
    """A text in pieces that end where a word ends in any case."""
    low = 0
    while found := _SAFE.search(text, low + CUT):
        yield text[low : found.end()]
        low = found.end()
    yield text[low:]


def _library_sizes(text: str, path: str) -> np.ndarray:
    """Bytes of each pre-token of a text, as the library cuts it."""
    sizes, pattern = [], _special(path)
    cut = library(path).pre_tokenizer.pre_tokenize_str
    for at, part in enumerate(pattern.split(text) if pattern else [text]):
        if at % 2:
            sizes.append(len(part.encode()))
        else:
            sizes += [len(name) for chunk in _chunks(part) if chunk for name, _ in cut(chunk)]
    return np.array(sizes, dtype=np.int64)


def _starts(piece: words.Words) -> np.ndarray:
    """First bytes of the words, in order: a run of other characters than white space begins at the space before it, other white space by itself."""
    text, start, end = piece.text, piece.start, piece.end
    spaced = np.zeros(len(start), dtype=bool)
    inner = start > piece.bounds[piece.doc]
    spaced[inner] = text[start[inner] - 1] == _SPACE
    begin = np.zeros(len(text) + 1, dtype=bool)
    begin[start - spaced] = True
    # white space after a run, after the start of a text, and in front of a run that no space joins
    space = np.append(words.WHITE_SPACE[text], False)
    begin[end] |= space[end]
    opens = piece.bounds[:-1]
    begin[opens] = True
    last = start[inner & ~spaced] - 1
    begin[last] |= space[last]
    return np.flatnonzero(begin[: len(text)])


def cut_words(piece: words.Words, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word of a slice, in the order of the text."""
    starts, odd = _starts(piece), _library_rows(piece, path)
    if len(odd):
        rows = np.searchsorted(piece.bounds, starts, side="right") - 1
        own, data = [starts[~np.isin(rows, odd)]], piece.text.tobytes()
        for row in odd.tolist():
            low, high = piece.bounds[row : row + 2]
            sizes = _library_sizes(data[low:high].decode(), path)
            own.append(low + np.cumsum(sizes) - sizes)
        starts = np.sort(np.concatenate(own))
    rows = np.searchsorted(piece.bounds, starts, side="right") - 1
    return starts, np.append(starts[1:], len(piece.text))[: len(starts)], rows


def _strings(data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [data[low:high] for low, high in zip(starts.tolist(), ends.tolist(), strict=True)]


class Table:
    """Frequent words, the most frequent first: their hashes in order with their ranks, and the ids of all ranks in a row."""

    def __init__(self, texts: list[bytes], path: str) -> None:
        bounds = np.cumsum([0, *map(len, texts)])
        hashes = np.zeros(0, dtype=np.uint64)
        if texts:
            hashes = next(words.slices(pa.array([b"".join(texts).decode()]), words.WHITE_SPACE, lower=False)).parts(bounds[:-1], bounds[1:])
        self.ranks = np.argsort(hashes)
        self.hashes = hashes[self.ranks]
        self.ids, self.sizes = encoded(path, texts)
        self.first = np.cumsum(self.sizes) - self.sizes

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks, or OPEN."""
        if not len(self.hashes):
            return np.full(len(hashes), OPEN, dtype=np.uint16)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ranks[at], OPEN).astype(np.uint16)


def frequent_words(texts: DataFrame, path: str) -> list[bytes]:
    """The largest counts of all tasks, added up. For every COUNTED words a task sends REPORTED strings at most."""
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in words.slices(batch.column(0), words.WHITE_SPACE, lower=False):
                starts = _starts(piece)
                ends = np.append(starts[1:], len(piece.text))[: len(starts)]
                short = np.flatnonzero(ends - starts <= LONGEST)
                hashes, first, counts = np.unique(piece.parts(starts[short], ends[short]), return_index=True, return_counts=True)
                often = np.flatnonzero(counts > 1)
                at = short[first[often]]
                held.append((hashes[often], counts[often], _strings(piece.text.tobytes(), starts[at], ends[at])))
                size += len(starts)
                if size >= COUNTED:
                    yield _head(held)
                    held, size = [], 0
        if held:
            yield _head(held)

    counts = texts.select("text").mapInArrow(heads, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(row["word"]) for row in counts.orderBy(F.desc("n"), "word").limit(min(FREQUENT, OPEN)).collect()]


def _head(held: list) -> pa.RecordBatch:
    hashes, counts = (np.concatenate([own[i] for own in held]) for i in (0, 1))
    strings = [string for own in held for string in own[2]]
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    totals = np.bincount(group, weights=counts, minlength=len(first)).astype(np.int64)
    top = np.argsort(-totals, kind="stable")[:REPORTED]
    return pa.RecordBatch.from_arrays([pa.array([strings[i] for i in first[top].tolist()], pa.binary()), pa.array(totals[top])], ["word", "n"])


_codec = pa.Codec("zstd", 1)


def _pack(*columns: tuple[np.ndarray, str]) -> bytes:
    """Arrays as compressed bytes, all first bytes of an array's numbers before all second ones; their lengths in front."""
    planes = [np.ascontiguousarray(values, dtype=kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T.tobytes() for values, kind in columns]
    raw = np.array([len(values) for values, _ in columns], dtype=np.int64).tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = _codec.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    at, found = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(raw, dtype=np.int64, count=len(kinds)).tolist(), kinds, strict=True):
        wide = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, dtype=np.uint8, count=size * wide, offset=at).reshape(wide, size)
        found.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += size * wide
    return found


#: Letters and sizes of words; sizes and ids of words; and of a block: doc_ids, whether they are null, words, ranks, repeated open words, parts of the open words, sizes and ids of the long ones.
_WORD_KINDS = ("u1", "u1")
_PLACE_KINDS = ("i8", "u1", "i4", "u2", "u4", "u2", "i4", "u4")


def _id_kinds(path: str) -> tuple[str, str]:
    return "u1", "u2" if library(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "u4"


class _Block:
    """Words of one slice: ranks of the frequent ones, and the distinct open ones in the order in which they first occur."""

    def __init__(self, piece: words.Words, path: str, table: Table, parts: int) -> None:
        self.piece = piece
        self.starts, self.ends, self.rows = cut_words(piece, path)
        hashes = piece.parts(self.starts, self.ends)
        self.ranks = table.found(hashes)
        places = np.flatnonzero(self.ranks == OPEN)
        distinct, first, group = np.unique(hashes[places], return_index=True, return_inverse=True)
        order = np.argsort(first)
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        self.open, self.heads = number[group], places[first[order]]
        self.long = self.ends[self.heads] - self.starts[self.heads] > LONGEST
        # the last part number stands for words that are encoded here
        self.part = np.where(self.long, parts, (distinct[order] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)

    def strings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters in a row and sizes of the open words at these numbers."""
        sizes = self.ends[self.heads[at]] - self.starts[self.heads[at]]
        return self.piece.text[ragged(self.starts[self.heads[at]], sizes)], sizes

    def asked(self) -> Iterator[tuple[int, bytes]]:
        by = np.argsort(self.part, kind="stable")
        by = by[: len(by) - int(self.long.sum())]
        edges = np.flatnonzero(np.diff(self.part[by], prepend=-1, append=-1))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            yield int(self.part[by[low]]), _pack(*zip(self.strings(by[low:high]), _WORD_KINDS, strict=True))

    def places(self, named: np.ndarray, missing: np.ndarray, path: str) -> bytes:
        letters, sizes = self.strings(np.flatnonzero(self.long))
        ends = np.cumsum(sizes)
        ids, lengths = encoded(path, _strings(letters.tobytes(), ends - sizes, ends))
        # 0 for a word that occurs for the first time, else its number plus one
        again = np.where(np.diff(np.maximum.accumulate(self.open), prepend=-1) > 0, 0, self.open + 1)
        return _pack(*zip((named, missing, np.bincount(self.rows, minlength=self.piece.rows), self.ranks, again, self.part, lengths, ids), _PLACE_KINDS, strict=True))


def _blocks(path: str, shared, parts: int, ask: bool):
    """One row for each part that a block asks, or one row with the places of each block."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0)
            named, missing = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            for piece in words.slices(batch.column(1), words.WHITE_SPACE, lower=False):
                block, here = _Block(piece, path, shared.value, parts), slice(piece.row, piece.row + piece.rows)
                sent = list(block.asked()) if ask else [(_PLACES, block.places(named[here], missing[here], path))]
                if sent:
                    part, blob = zip(*sent, strict=True)
                    columns = {"part": pa.array(part, pa.int32()), "block": pa.array([number] * len(part), pa.int64()), "blob": pa.array(blob, pa.binary())}
                    names = ["part", "block", "blob"] if ask else ["block", "part", "blob"]
                    yield pa.RecordBatch.from_arrays([columns[name] for name in names], names)
                number += 1

    return rows


def _encode_part(path: str):
    def part(table: pa.Table) -> pa.Table:
        numbers, texts, asked, out = {}, [], [], []
        for block, blob in zip(table.column("block").to_pylist(), table.column("blob"), strict=True):
            letters, sizes = _unpack(blob.as_buffer().to_pybytes(), *_WORD_KINDS)
            ends = np.cumsum(sizes, dtype=np.int64)
            own = np.empty(len(sizes), dtype=np.int64)
            for i, text in enumerate(_strings(letters.tobytes(), ends - sizes, ends)):
                if (number := numbers.setdefault(text, len(texts))) == len(texts):
                    texts.append(text)
                own[i] = number
            asked.append((block, own))
        ids, size = encoded(path, texts)
        first, kinds = np.cumsum(size) - size, _id_kinds(path)
        for block, own in asked:
            out.append((block, _pack((size[own], kinds[0]), (ids[ragged(first[own], size[own])], kinds[1]))))
        block, blob = zip(*out, strict=True)
        return pa.table({"block": pa.array(block, pa.int64()), "part": pa.array([table.column("part")[0].as_py()] * len(out), pa.int32()), "blob": pa.array(blob, pa.binary())})

    return part


def _join_block(path: str, shared, parts: int, pieces):
    def block(table: pa.Table) -> pa.Table:
        known, blobs = shared.value, dict(zip(table.column("part").to_pylist(), (blob.as_buffer().to_pybytes() for blob in table.column("blob")), strict=True))
        named, missing, counts, ranks, again, part, sizes, ids = _unpack(blobs.pop(_PLACES), *_PLACE_KINDS)
        flat, base = [known.ids, ids], len(known.ids) + len(ids)
        # where the ids of each open word start, and how many it has
        first, size = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
        at = np.flatnonzero(part == parts)
        first[at], size[at] = len(known.ids) + np.cumsum(sizes, dtype=np.int64) - sizes, sizes
        for number, blob in blobs.items():
            sizes, ids = _unpack(blob, *_id_kinds(path))
            at = np.flatnonzero(part == number)
            first[at], size[at] = base + np.cumsum(sizes, dtype=np.int64) - sizes, sizes
            flat.append(ids)
            base += len(ids)
        fresh = again == 0
        word = np.where(fresh, np.cumsum(fresh) - 1, again.astype(np.int64) - 1)
        is_open = ranks == OPEN
        start, length = np.empty(len(ranks), dtype=np.int64), np.empty(len(ranks), dtype=np.int64)
        start[is_open], length[is_open] = first[word], size[word]
        start[~is_open], length[~is_open] = known.first[ranks[~is_open]], known.sizes[ranks[~is_open]]
        ids = np.concatenate(flat)[ragged(start, length)].astype("<u4")
        ends = np.append(0, np.cumsum(length))[np.append(0, np.cumsum(counts))]
        values = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(4 * ends.astype(np.int64)), pa.py_buffer(ids)])
        found = {"doc_id": pa.array(named, mask=missing.astype(bool)), "n_tokens": pa.array(np.diff(ends)), "ids": values.cast(pa.binary())}
        if pieces is not None:
            found["decoded"] = pa.array([_text(ids[low:high], pieces.value) for low, high in zip(ends[:-1], ends[1:], strict=True)], pa.string())
        return pa.table(found)

    return block


def _text(ids: np.ndarray, pieces: tuple[np.ndarray, np.ndarray, np.ndarray]) -> str:
    letters, first, size = pieces
    own = ids[ids < len(size)]
    return letters[ragged(first[own], size[own])].tobytes().decode(errors="replace")


def encode(docs: DataFrame, path: str, and_decode: bool = False) -> DataFrame:
    """doc_id, n_tokens and the ids (little-endian unsigned 32-bit integers) of every document, and if wanted the text that they decode to."""
    context = docs.sparkSession.sparkContext
    texts = batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = texts.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = min(OPEN, max(2 * shuffle_partitions(docs.sparkSession), size // PART_BYTES))
    shared = context.broadcast(Table(frequent_words(texts, path), path))
    pieces = context.broadcast(piece_bytes(path)) if and_decode else None
    answered = texts.mapInArrow(_blocks(path, shared, parts, True), _ASKED).groupBy("part").applyInArrow(_encode_part(path), _ANSWERED)
    placed = texts.mapInArrow(_blocks(path, shared, parts, False), _ANSWERED)
    joined = "doc_id long, n_tokens long, ids binary" + (", decoded string" if and_decode else "")
    return placed.unionByName(answered).groupBy("block").applyInArrow(_join_block(path, shared, parts, pieces), joined)


def piece_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pieces in a row, and where each id's piece starts and how long it is; ids without a piece have none."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [code for code in range(256) if code not in set(plain)]
    letters = {chr(code): code for code in plain} | {chr(256 + i): code for i, code in enumerate(others)}
    vocabulary = library(path).get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for piece, number in vocabulary.items():
        pieces[number] = bytes(letters[letter] for letter in piece) if all(letter in letters for letter in piece) else piece.encode()
    size = np.array([len(piece) for piece in pieces], dtype=np.int64)
    return np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum(size) - size, size


def decode(encoded_docs: DataFrame, path: str) -> DataFrame:
    """The rows with a column `decoded`, the text of their ids; special tokens give their strings."""
    shared = encoded_docs.sparkSession.sparkContext.broadcast(piece_bytes(path))
    names = encoded_docs.columns
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in encoded_docs.schema) + ", decoded string"

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_text(np.frombuffer(ids.as_py() or b"", dtype="<u4"), shared.value) for ids in batch.column(names.index("ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*names, "decoded"])

    return encoded_docs.mapInArrow(texts, schema)


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the text that they decode to."""
    coded = encode(docs, path, and_decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
