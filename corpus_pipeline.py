"""A corpus pipeline of five stages; each works on all that the one before it kept.

    quality           documents that fail the quality rules go
    lines             lines that several documents share stay only in the one with the smallest id
    near_duplicates   of each group of near copies the document with the smallest id stays
    passages          passages that an earlier document has are taken out
    packing           what is left is tokenized and packed into sequences

All but the last return the columns of documents, with n_chars counted anew where the text changed. No SQL here: the
later stages need hashes, alignments and a tokenizer; they are tested against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import lines, packing, passages, quality, simhash
from ledgerline.llm.common import table, written
from ledgerline.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(lines.dedup_lines(docs))


def first_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(passages.drop_passages(docs, passages.passages(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("lines", dedup_lines),
    ("near_duplicates", first_of_each),
    ("passages", drop_passages),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
