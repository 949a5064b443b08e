"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage takes tables with more columns than COLUMNS, whatever they are called, and gives COLUMNS (the last one pieces). Nulls in any column, empty and very
long texts, repeated ids and repeated rows have the results stated below; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zonalis.llm import fuzzy_lines, mixing, near_dup, packing, quality
from zonalis.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words in a shingle for near-duplicates.
SHINGLE = 5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the base rules or the robust distance reject go. Null and empty texts have no words and go; a null language or source is one of its own; equal rows stay or go together."""
    return quality.judged(docs.select(*COLUMNS), keep_text=True).where("_kept").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: of each group of similar lines the first stays, by id (nulls first), row and line; documents all of whose lines with a word go are left out. Rows are told apart even where ids are null or repeat. Null and empty texts have no lines and stay as they are."""
    return fuzzy_lines.without_repeated_lines(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates: one document of each group stays, that of the smallest id, null ids last; of rows of one id the first. Null and empty texts are like no other and stay."""
    return near_dup.one_of_each_group(docs.select(*COLUMNS), SHINGLE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as the mix draws it, in shards, in local random order. Null and empty texts weigh nothing and come along with their block; a null source is one of its own; equal rows are drawn together."""
    return mixing.mixed_rows(mixing.mix_sources(docs.select(*COLUMNS))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: a row for each piece, with its sequence and place. A null or empty text is one piece, the closing id; each row has pieces of its own."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]
#: Robust fits, edit similarity and tokenising have no SQL twin; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
