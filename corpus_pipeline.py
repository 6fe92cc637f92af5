"""From raw documents to packed training sequences: language ID, near-duplicate removal, benchmark
decontamination, personal data masking, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last
return the columns of documents. A stage's result is written as Parquet and read again as the next
one's input. No SQL can express the language stage, so ORACLE_SQL is None and tests compare ``run`` with
a brute-force version.

Null and empty texts: the language stage rejects them, as it does texts without a letter. Later stages
accept them all the same. An empty table passes through every stage as an empty table. Columns that have
the name of an operator's own column come through unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rigsense.llm import decontamination, language_id, packing, pii, simhash
from rigsense.llm.base import crc_remainder, new_name, stage, table

ORACLE_SQL = None


def _carrying(docs: DataFrame) -> tuple[DataFrame, str]:
    """doc_id and text, with all other columns in one of a name that no operator uses."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    name = new_name("carried")
    return docs.select("doc_id", "text", F.struct(*[F.col(c) for c in others], F.lit(0).alias(name)).alias(name)), name


def _unpacked(found: DataFrame, name: str, like: DataFrame, lang: Column | None = None) -> DataFrame:
    """The columns of ``like``; a missing ``lang`` becomes the given one."""
    def column(c: str) -> Column:
        old = F.col(name)[c]
        return F.col(c) if c in ("doc_id", "text") else (old if lang is None or c != "lang" else F.coalesce(old, lang)).alias(c)

    return found.select(*map(column, like.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language; the network learns from the known ``lang`` values of docs.

    A missing ``lang`` becomes the predicted one. Where no ``lang`` is known at all there is nothing to learn:
    then only texts without a letter are rejected, and ``lang`` stays missing.
    """
    fold = F.coalesce(crc_remainder(F.col("doc_id"), 4) != 2, F.lit(False))
    net = language_id.learn(docs, fold)
    slim, carried = _carrying(docs)
    if not net.labels:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_id.predict(slim, net).filter(F.col("lang_pred") != language_id.UNKNOWN)
    return _unpacked(found, carried, docs, F.col("lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    slim, carried = _carrying(docs)
    return _unpacked(simhash.keep_one(slim), carried, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    slim, carried = _carrying(docs)
    return _unpacked(decontamination.clean_documents(slim, table(spark, sf_dir, "benchmark")), carried, docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in angle brackets, and n_chars to match."""
    slim, carried = _carrying(docs)
    masked = _unpacked(pii.mask(slim), carried, docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.with_crc(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
