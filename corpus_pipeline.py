"""From raw documents to packed training sequences, one operator after the other.

What holds for every stage: a null text counts as an empty one; long texts are read whole; rows that
repeat an id, null included, are told apart; an empty table gives an empty result; all but the last
return every column as it came, whatever its name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tapeflow.llm.exact_dedup import drop_copies
from tapeflow.llm.langid import drop_unidentified, train_bytenet
from tapeflow.llm.mixing import mix
from tapeflow.llm.near_dedup import drop_near
from tapeflow.llm.packing import harmonic_pack
from tapeflow.llm.shared import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whose text a language can be told; null, empty and letterless texts go. Repeated
    rows and ties stay as they are. Without labelled rows one unknown language holds all others."""
    return drop_unidentified(docs, train_bytenet(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts: the longest original, of equals the smallest id, null
    last. Empty texts are one class; of repeated rows one stays."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8. The smallest id
    stays, null last; of rows that share it one stays. Texts without words are in no group and stay."""
    return drop_near(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixing rates say, each row by its own rate; repeated rows of one id and
    text alike. Without labels rates are 1 but for what even posteriors allow."""
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, each row a document of its own; an empty text is
    its end token."""
    return harmonic_pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mix_domains),
    ("packing", pack),
]

#: Training, hashing and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
