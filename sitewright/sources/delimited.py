"""Delimited text files of any number and size as records, in one job for all of them.

Quoted fields may hold line breaks, so a reader that starts in the middle of a file cannot tell whether it is inside a quoted field. Spark reads
the files as physical lines, split wherever it likes, and:

1. every split reports the parity of its quotes, and where its last record would start if it began outside or inside a quoted field;
2. a window over the splits of a file, one small row each, turns the parities into the state at the start of each split;
3. lines that hold a whole record are records as they are; only lines of records that go over several lines are brought together.

No file has to fit into one task and nothing is read ahead on the driver. A doubled quote inside a quoted field stands for one quote; it does not change parity.
A field that is never closed goes on to the end of its file, as one record, which must fit into a task. The delimiter of a file is the candidate that occurs most often
in its first line, the header is its first record. Records whose fields are all blank are left out; missing fields are null, further ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewright.functions.url import computed_once
from sitewright.session import stored

c = F.col
#: Candidates, the first one winning ties.
DELIMITERS = (",", ";", "\t")
#: A code point that is reserved for use inside programs and never part of a text.
_MARK = "\ufdd0"
_LINE = "file long, block long, seq long, value string, inside int, odd int, outside_start long, inside_start long"
_SPLIT = "file long, block long, odd int, outside_start long, inside_start long"


class _Position:
    """Where a task is: split, line number, parity so far, and the last starts under both assumptions."""

    def __init__(self) -> None:
        self.key, self.seq, self.parity, self.starts = None, 0, 0, [-1, -1]

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array, dict[str, np.ndarray], bool]]:
        """Runs of lines of one split with their numbers; the flag tells that a new split begins."""
        for batch in batches:
            file, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            edges = np.flatnonzero((np.diff(file, prepend=file[:1] - 1) != 0) | (np.diff(block, prepend=block[:1] - 1) != 0)) if len(file) else []
            for low, high in zip(edges, [*edges[1:], len(file)], strict=True):
                key = (int(file[low]), int(block[low]))
                fresh = key != self.key
                if fresh:
                    self.key, self.seq, self.parity, self.starts = key, 0, 0, [-1, -1]
                lines = batch.column(2).slice(low, high - low)
                yield key, lines, self._numbered(lines), fresh

    def _numbered(self, lines: pa.Array) -> dict[str, np.ndarray]:
        odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) & 1
        inside = (self.parity + np.cumsum(odd) - odd) & 1
        seq = self.seq + np.arange(len(odd))
        starts = [np.maximum(np.maximum.accumulate(np.where(inside == state, seq, -1)), self.starts[state]) for state in (0, 1)]
        self.seq, self.parity, self.starts = self.seq + len(odd), int(inside[-1] + odd[-1]) & 1, [int(own[-1]) for own in starts]
        return {"seq": seq, "inside": inside, "odd": odd, "outside_start": starts[0], "inside_start": starts[1]}


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    position = _Position()
    for (file, block), lines, facts, _ in position.batches(batches):
        size = len(lines)
        numbers = [pa.array(np.full(size, value, dtype=np.int64)) for value in (file, block)]
        columns = [*numbers, pa.array(facts["seq"]), lines, pa.array(facts["inside"].astype(np.int32)), pa.array(facts["odd"].astype(np.int32)), pa.array(facts["outside_start"]), pa.array(facts["inside_start"])]
        yield pa.RecordBatch.from_arrays(columns, ["file", "block", "seq", "value", "inside", "odd", "outside_start", "inside_start"])


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    position, found = _Position(), {}
    for key, _, _, _ in position.batches(batches):
        found[key] = (position.parity, *position.starts)
    rows = [(*key, *facts) for key, facts in found.items()]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
    yield pa.RecordBatch.from_arrays(columns, ["file", "block", "odd", "outside_start", "inside_start"])


def _physical(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths, lineSep="\n").select(F.xxhash64("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("block"), "value")


def _states(splits: DataFrame) -> DataFrame:
    """State at the start of each split, and the start of the record that is open there."""
    along = Window.partitionBy("file").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    known = splits.withColumn("state", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    start = F.when(c("state") == 0, c("outside_start")).otherwise(c("inside_start"))
    known = known.withColumn("last", F.when(start >= 0, F.struct("block", start.alias("seq"))))
    return known.select("file", "block", c("state").cast("int").alias("state"), F.last("last", ignorenulls=True).over(before).alias("carried"))


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows (file, block, seq, text): all records, headers included, in the order of (block, seq) within a file."""
    states = stored(_states(_physical(spark, paths).mapInArrow(_splits, _SPLIT)))
    lines = _physical(spark, paths).mapInArrow(_lines, _LINE).join(states, ["file", "block"])
    own = F.when(c("state") == 0, c("outside_start")).otherwise(c("inside_start"))
    inside = (c("inside") + c("state")) % 2
    placed = lines.select("file", "block", "seq", "value", ((inside == 0) & (c("odd") == 0)).alias("whole"), F.when(own >= 0, F.struct("block", own.alias("seq"))).otherwise(c("carried")).alias("start"))
    whole = placed.where("whole").select("file", "block", "seq", c("value").alias("text"))
    parts = placed.where(~c("whole")).groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("parts"))
    return whole.unionByName(parts.select("file", "start.block", "start.seq", F.array_join(F.transform("parts", lambda part: part["value"]), "\n").alias("text")))


def fields(text: Column, delimiter: Column) -> Column:
    """Fields of a record. What lies between quotes is taken as it is, an empty stretch between two quoted ones is a quote."""
    parts = F.split(F.regexp_replace(text, "\r$", ""), '"', -1)
    last = F.size(parts) - 1

    def read(part: Column, at: Column) -> Column:
        quote = (part == "") & (at > 0) & (at < last)
        return F.when(at % 2 == 1, part).when(quote, F.lit('"')).otherwise(F.replace(part, delimiter, F.lit(_MARK)))

    return F.split(F.array_join(F.transform(parts, read), ""), _MARK, -1)


def header_name(header: Column) -> Column:
    """Lower case, without apostrophes and remarks in brackets; everything else but letters and digits is one underscore."""
    plain = F.regexp_replace(F.lower(F.trim(header)), "['’]", "")
    words = F.regexp_replace(F.regexp_replace(plain, r"\s*\([^)]*\)\s*", " "), "[^a-z0-9]+", "_")
    return F.regexp_replace(words, "^_|_$", "")


def files(spark: SparkSession, paths: list[str], found: DataFrame) -> DataFrame:
    """One row for each file: path, size, delimiter, headers, and their names; of equal headers the last one keeps its name."""
    first = found.where((c("block") == 0) & (c("seq") == 0)).select("file", F.regexp_replace("text", "^\ufeff", "").alias("text"))
    line = F.regexp_replace(F.substring_index("text", "\n", 1), "\r$", "")
    counts = [F.struct((F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))).alias("n"), F.lit(-place).alias("place"), F.lit(mark).alias("mark")) for place, mark in enumerate(DELIMITERS)]
    known = computed_once(first, {"delimiter": F.greatest(*counts)["mark"]})
    known = computed_once(known, {"headers": F.transform(fields(c("text"), c("delimiter")), lambda header: F.trim(header))})
    known = computed_once(known, {"names": F.transform("headers", header_name)})
    later = lambda name, at: F.array_contains(F.slice("headers", at + 2, F.size("headers")), F.get("headers", at))
    known = known.withColumn("names", F.transform("names", lambda name, at: F.when(~later(name, at), name)))
    listed = spark.read.format("binaryFile").load(paths).select(F.xxhash64("_metadata.file_path").alias("file"), c("_metadata.file_path").alias("path"), c("_metadata.file_size").alias("bytes"))
    return known.drop("text").join(listed, "file", "left")


def table(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """The files (file, path, bytes, delimiter, headers, names) and the rows below their headers (file, block, seq, names, cells)."""
    found = records(spark, paths)
    known = stored(files(spark, paths, found))
    rows = found.where((c("block") != 0) | (c("seq") != 0)).join(known.select("file", "delimiter", "names"), "file")
    rows = computed_once(rows, {"cells": fields(c("text"), c("delimiter"))})
    return known, rows.where(F.exists("cells", lambda cell: F.trim(cell) != "")).select("file", "block", "seq", "names", "cells")


def cell(*names: str) -> Column:
    """The first cell that is not blank among those with these header names, trimmed."""
    found = [F.nullif(F.trim(F.get("cells", F.array_position("names", name).cast("int") - 1)), F.lit("")) for name in names]
    return F.coalesce(*found)
