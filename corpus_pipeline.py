"""Corpus preparation: stages over ``documents``, each written and read again as the next one's input.

The stages reject documents without a recognised language, keep one document of each
group of copies and near copies, cut passages that repeat across documents, reject
documents with passages of a benchmark item, and encode what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm.bpe import digests
from shoplens.llm.chunking import dedup_substrings
from shoplens.llm.decontamination import find_overlaps
from shoplens.llm.language_id import UNKNOWN, fit, predict, training_rows
from shoplens.llm.queries import word_bpe
from shoplens.llm.simhash import component_firsts
from shoplens.llm.store import packed, unpacked, written


def body() -> Column:
    """What tells rows of one id apart, as the operators compute it."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language that is recognised without doubt; a null text has none."""
    codes = fit(docs.filter(training_rows(F.col("doc_id"))))
    prefix = max(docs.columns, key=len) + "_"  # no column of docs begins with it
    found = predict(docs, codes, prefix=prefix)
    return found.filter((F.col(f"{prefix}pred") != UNKNOWN) & ~F.col(f"{prefix}ambiguous")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of fingerprints linked at 4 or fewer differing bits (4-word shingles), the row with the smallest id (null ids last).

    Rows of equal id and text are one document, of which one row stays.
    """
    kept = component_firsts(docs, words=4, max_bits=4).select(F.col("id").alias("_id"), F.col("body").alias("_kept"))
    rows = packed(docs, doc_id=F.col("doc_id"), body=body())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_kept"))
    return unpacked(rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "body"]), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without passages that an earlier document holds; rows whose whole text went are dropped."""
    found = dedup_substrings(packed(docs, "text", doc_id=F.col("doc_id"), text=F.col("text")))
    changed = F.col("removed_bytes") > 0
    length = F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return unpacked(found.filter(~changed | (F.trim("text") != "")), docs, text=F.col("text"), n_chars=length)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = find_overlaps(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("body").alias("_body")).distinct()
    rows = packed(docs, doc_id=F.col("doc_id"), body=body())
    return unpacked(rows.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body")), "left_anti"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's number of tokens and the digests of its ids and of the text decoded from them."""
    return digests(docs, word_bpe())


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]
# Hashing, fitted codes and tokenizers have no counterpart in SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
