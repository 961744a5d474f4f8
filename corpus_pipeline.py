"""From raw documents to token ids: the stages of a corpus, each written before the next reads it.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents, whatever
they are called.  Rows of a null doc_id count as one document, repeated rows as often as they stand
until a stage removes copies.  An empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import bpe, common, decontamination, exact_dedup, language_id, near_dedup

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are in no learnt language: without a letter or text, or far likelier by chance than by any of them."""
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z case the row with the largest doc_id stays; null counts as empty."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles one stays; those without words all do."""
    return near_dedup.deduplicate(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which ten consecutive words, or half of all, are those of benchmark items; null texts stay."""
    return decontamination.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, decoded again: number of tokens, digests of ids and of bytes; null has none."""
    return bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("byte_bpe", tokenize),
]

#: The language model and the merges cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
