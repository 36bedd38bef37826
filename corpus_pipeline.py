"""Corpus pipeline: raw documents to token ids.

STAGES run in order; each reads what the one before wrote as Parquet:

1. language ID: documents without a decided language go;
2. line dedup: lines that repeat or nearly repeat earlier lines go, documents stay;
3. MinHash near-dedup: one document of each group of near copies stays;
4. mixing: documents are repeated by a Poisson count of their source's rate, shuffled;
5. SentencePiece: token ids of every document row.

All but the last return the columns of documents. Repeated rows of one doc_id count
as one document in near-dedup. A table without rows gives a result without rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheetwise.llm import langid, linededup, minhash, mixing, pieces
from sheetwise.llm.common import prepare, table
from sheetwise.session import materialise

# SQL can express neither the classifier nor the encoder; tests use brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return langid.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return linededup.keep_first_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return minhash.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.keep_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
