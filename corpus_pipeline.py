"""A training corpus from raw documents in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from segspark.llm import bpe, exact_dedup, language, mixing, shingles
from segspark.llm.common import discard, stash


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language stays in doubt, go.

    Null, empty and wordless texts have no letters. Rows that repeat stay or go together; texts of any length are scored whole; ties between languages go to the first by name, and to a score too low to stay.
    All columns are kept, whatever their names. An empty table gives none.
    """
    return language.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays.

    Null texts equal empty ones; null ids rank lowest; of rows that repeat id and text one stays; texts of any length are compared whole. All columns are kept, whatever their names. An empty table gives none.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity of five-word shingles 0.8 or more) the document with the smallest doc_id stays.

    Covering SimHash proposes, whole shingle sets decide. Null, empty and wordless texts are copies of each other; texts under five words are one shingle. Rows without an
    id stay, and so do all rows of an id that stays; texts of any length are compared whole. All columns are kept, whatever their names. An empty table gives none.
    """
    return shingles.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document appears as often as it is taken.

    A null source is one of its own, last; null texts have size 0; a source without words is not taken. Equal sizes stand in order of a hash of the id, then the id, then
    the text, so reruns agree; rows that repeat count separately; texts of any length count whole. All columns are kept, whatever their names. An empty table gives none.
    """
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix, and of what its ids decode to.

    Null counts as empty; texts of any length are encoded whole; rows that repeat give rows that repeat. Other columns are ignored. An empty table gives none.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: SQL can express neither the language model nor SimHash; every stage is tested against a plain version of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = stash(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
