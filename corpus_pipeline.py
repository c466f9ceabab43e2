"""A training corpus from raw documents in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and is written as Parquet and read again as the next one's ``docs``. The
first four return the columns of ``documents``; the last returns the packed
pieces. Stages: documents without a letter go, and all if no
language is labelled, while texts in an unlearned language stay; later copies of repeated line
runs are deleted; of each group of near copies one document stays; sources are
mixed to their target weights, so a document may come more than once or in part;
the mix is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, line_dedup, minhash, mixing, packing
from tessera.llm.common import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.in_a_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

#: Language models, minima and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
