"""Language identification by Bayesian fusion of text, markup, address and host.

For each row and language the log posterior is a sum of
* the text's log likelihood under byte trigrams, tempered to the weight of at most EVIDENCE trigrams, as neighbouring ones are not
  independent;
* the log chance of the declared markup language given the language, if one is declared;
* the log chance of the address suffix given the language, if there is an address;
* the log of the host's prior, which is smoothed towards its domain's, which is smoothed towards the corpus's.
The chances and priors come from grouped aggregates of all rows' text posteriors; a row's own part is left out of its host's and domain's
prior. Rows without host have the corpus's prior.

Documents and pages are classified together: a document has its text and its source as host; a page has the text between its tags,
the language declared in its html tag, and the host of its address. `lang` of documents only serves to count trigrams, in a bounded
sample, SAMPLE rows of smallest digest of which crc32(doc_id) mod 4 = 2 is left out for tests; it is no evidence for a row.

Null and empty texts follow the other evidence. Without labelled rows the language is null. Repeated rows are classified alike. Extra
columns are not read. Nothing is gathered by host but sums, which combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm import tables, words
from sitewright.llm.words import text_buffers

SAMPLE = 20_000
BITS = 14
#: Trigrams that count in full; longer texts are tempered to this weight.
EVIDENCE = 40.0
#: Weight of the wider prior, and added counts of declared languages and suffixes.
SMOOTHING, ADDED = 5.0, 0.5
#: What is not closed goes to the end of the page, so no part of it is scanned twice.
_TAGS = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<[^>]*(?:>|\z)"


def _grams(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram bins and their rows; A-Z lowered, no trigram crosses texts."""
    if len(text) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = text.astype(np.uint32)
    low[(text >= 0x41) & (text <= 0x5A)] += 32
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = rows[:-2] == rows[2:]
    bins = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    return bins[whole], rows[:-2][whole]


def _slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    if not len(column):
        return
    data, bounds = text_buffers(column)
    low, rows = 0, len(bounds) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + words.SLICE_BYTES, side="right")) - 1)
        yield low, data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
        low = high


def trigram_model(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and a table of log chances by trigram and language, from rows with text and lang."""
    chosen = labelled.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    chosen = chosen.select(F.col("doc_id").cast("long"), "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(SAMPLE)
    rows = tables.batched(labelled).select(F.col("doc_id").cast("long"), "text", "lang").join(F.broadcast(chosen), ["doc_id", "lang"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for row, text, bounds in _slices(batch.column(0)):
                bins, rows = _grams(text, bounds)
                own = langs[row : row + len(bounds) - 1]
                for lang in sorted(set(own)):
                    counts = np.bincount(bins[(own == lang)[rows]], minlength=1 << BITS)
                    some = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])], ["lang", "bin", "n"])

    counts = rows.select("text", "lang").mapInArrow(counted, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()
    langs = sorted({row.lang for row in counts})
    table = np.full((1 << BITS, len(langs)), 0.5)
    for row in counts:
        table[row.bin, langs.index(row.lang)] += row.n
    return langs, np.log(table / table.sum(axis=0))


def evidence(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """kind, id, text, declared, suffix, host and domain of documents and pages."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    labels = F.split("host", r"\.")
    html = F.coalesce(F.col("html"), F.lit(""))
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    none = lambda column: F.when(column != "", column)
    web = pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), F.regexp_replace(html, _TAGS, " ").alias("text"), none(declared).alias("declared"), none(host).alias("host"))
    web = web.withColumns({"suffix": F.when(F.size(labels) > 1, F.element_at(labels, -1)), "domain": F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2)))})
    own = documents.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), "text", F.lit(None).cast("string").alias("declared"), F.col("source").cast("string").alias("host"))
    own = own.withColumns({"suffix": F.lit(None).cast("string"), "domain": F.lit(None).cast("string")})
    return own.unionByName(web)


def _likelihoods(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """The rows with `text` replaced by tempered log likelihoods, one for each language."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    names = [name for name in rows.columns if name != "text"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for row, text, bounds in _slices(batch.column("text")):
                bins, own = _grams(text, bounds)
                count = np.bincount(own, minlength=len(bounds) - 1)
                weight = EVIDENCE / np.maximum(EVIDENCE, count)
                sums = np.column_stack([np.bincount(own, weights=column[bins], minlength=len(bounds) - 1) * weight for column in table.T])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)), pa.array(sums.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*[batch.column(name).slice(row, len(bounds) - 1) for name in names], lists], [*names, "likelihoods"])

    return rows.select(*names, "text").mapInArrow(scored, "kind string, id long, declared string, host string, suffix string, domain string, likelihoods array<double>")


def _chances(logs: Column) -> Column:
    """Log values turned into chances that add up to one."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda total, y: total + y))


def _sums(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """Text posteriors added up by key, as one array."""
    parts = [F.sum(F.col("chances")[i]).alias(f"c{i}") for i in range(count)]
    return rows.groupBy(*keys).agg(*parts).select(*keys, F.array(*[f"c{i}" for i in range(count)]).alias("sums"))


def _added(first: Column, second: Column) -> Column:
    return F.zip_with(first, second, lambda a, b: a + b)


def _prior(sums: Column, own: Column, wider: Column) -> Column:
    """Shares among the sums without the row's own part, smoothed towards a wider prior."""
    rest = F.zip_with(sums, own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    total = F.aggregate(rest, F.lit(SMOOTHING), lambda x, y: x + y)
    return F.zip_with(rest, wider, lambda a, b: (a + SMOOTHING * b) / total)


def classify(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """kind, doc_id or page_id, language, confidence and the language by text alone, for every document and page."""
    langs, table = trigram_model(documents)
    rows = evidence(documents, pages)
    ids = [F.when(F.col("kind") == kind, F.col("id")).alias(name) for kind, name in (("document", "doc_id"), ("page", "page_id"))]
    if not langs:
        empty = F.lit(None).cast("string")
        return rows.select("kind", *ids, empty.alias("language"), F.lit(0.0).alias("confidence"), empty.alias("text_language"))
    n = len(langs)
    rows = tables.stored(_likelihoods(rows, table).withColumn("chances", _chances(F.col("likelihoods"))))
    corpus = rows.agg(*[F.coalesce(F.sum(F.col("chances")[i]), F.lit(0.0)) for i in range(n)]).first()
    whole = sum(corpus) + n
    prior = F.array(*[F.lit((x + 1) / whole) for x in corpus])
    total = F.array(*[F.lit(x + 1) for x in corpus])
    for name in ("declared", "suffix"):
        kinds = rows.where(F.col(name).isNotNull())
        own = tables.stored(_sums(kinds, n, name).withColumnRenamed("sums", f"{name}_sums"))
        rows = rows.join(own, name, "left")
    hosts = tables.stored(_sums(rows.where("host IS NOT NULL"), n, "kind", "host").withColumnRenamed("sums", "host_sums"))
    domains = tables.stored(_sums(rows.where("domain IS NOT NULL"), n, "domain").withColumnRenamed("sums", "domain_sums"))
    rows = rows.join(hosts, ["kind", "host"], "left").join(domains, "domain", "left")
    wider = F.when(F.col("domain_sums").isNull(), prior).otherwise(_prior(F.col("domain_sums"), F.col("chances"), prior))
    near = F.when(F.col("host_sums").isNull(), wider).otherwise(_prior(F.col("host_sums"), F.col("chances"), wider))
    logs = _added(F.col("likelihoods"), F.transform(near, lambda x: F.log(F.greatest(x, F.lit(1e-9)))))
    for name in ("declared", "suffix"):
        sums = F.col(f"{name}_sums")
        rest = F.zip_with(sums, "chances", lambda a, b: F.greatest(a - b, F.lit(0.0)) + ADDED)
        logs = F.when(sums.isNull(), logs).otherwise(_added(logs, F.zip_with(rest, total, lambda a, b: F.log(a / b))))
    named = F.array(*[F.lit(lang) for lang in langs])
    best = lambda values: F.element_at(named, F.array_position(values, F.array_max(values)).cast("int"))
    final = rows.select("kind", *ids, _chances(logs).alias("fused"), "chances")
    return final.select("kind", "doc_id", "page_id", best(F.col("fused")).alias("language"), F.array_max("fused").alias("confidence"), best(F.col("chances")).alias("text_language"))
