"""The corpus pipeline: language ID, exact dedup, MinHash near-dedup, mixing to target weights, byte-level BPE.

Edge cases: rows with null or empty text, or without a letter, go in the language stage; rows with a null doc_id are
judged like all others and stay. Rows that repeat under one doc_id are equal texts, so exact dedup leaves one; ties go to
the smallest doc_id. A null source is a source of its own in the mix, and a source whose texts are all empty has rate 1.
Without any labelled row the language stage rejects only what has no letter. An empty table goes through all
stages and gives an empty result with the last stage's columns. Extra columns are carried up to the last stage,
but for `copy` and `shuffle_key`, which the mix drops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspan.llm import bpe, exact_dedup, language_id, minhash, mixing
from tallyspan.llm.common import shared_folder, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that the network finds likely, go."""
    return language_id.keep_languages(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays."""
    return minhash.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate, in the shuffled order; copies keep their doc_id."""
    return mixing.mix(docs).drop("copy", "shuffle_key")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every row and of their decoding."""
    return bpe.digests(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("minhash", near), ("mixing", mixed), ("byte_bpe", encode)]
#: No SQL: networks, signatures and merges have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    folder, docs = shared_folder(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, folder, name)
    return docs
