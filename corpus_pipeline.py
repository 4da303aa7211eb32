"""A training corpus from `documents`: five stages, each written as Parquet and reread as the next one's input.

Every stage works on all rows that the one before kept, and all but the last return the columns of documents. A stage's docstring
says what it removes; everything else stays as it is. Nulls, empty and repeated rows, empty tables and extra columns are handled as
the operators' docstrings state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitewright.llm import decontamination, mixing, near_duplicates, substrings, toxicity
from sitewright.llm.tables import load, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression finds toxic go. It is fitted on the labels of the documents at hand."""
    return toxicity.without_toxic(docs, load(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document of smallest id stays."""
    return near_duplicates.without_near_duplicates(docs, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows of 20 words that occur earlier in the corpus are cut out; a document that loses all its words goes."""
    return substrings.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a shorter item whole, go."""
    return decontamination.without_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix does not draw go; the others get their source's target and the words taken of them, repeats counted."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Classifier and digests of texts have no DuckDB form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
