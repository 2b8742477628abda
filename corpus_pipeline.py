"""A corpus from documents to packed sequences: language ID, exact dedup, near dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairfold.llm.common import forget, save
from pairfold.llm.exact_dedup import drop_copies
from pairfold.llm.langid import keep_known, train
from pairfold.llm.near_dedup import keep_one_each
from pairfold.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; texts that are null, have no letter or are in a language not learned go."""
    return keep_known(docs, train(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of at least 0.8 of 5-word shingles, that with the smallest id stays."""
    return keep_one_each(docs, shingle=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: SQL can't express the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages leave; each stage's rows are saved, and its input deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = save(stage(spark, docs, sf_dir), name)
        forget(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
