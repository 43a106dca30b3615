"""From raw documents to packed training windows: five stages over ``documents``.

Each stage is written as Parquet and read again as the next one's input, so that a lost
executor costs a re-read, and each stage's own plan stays small.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kgaudit.llm import exact_dedup, mixing, near_dedup, packing, quality
from kgaudit.session import shared_folder


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    The classifier learns from the labels and the documents that it is given.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.drop_poor(docs, quality.fit(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text; of equal ones the largest id stays."""
    return exact_dedup.drop_copies(docs, keep="largest")


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.draw(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens, as pieces of documents."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good),
    ("exact dedup", distinct),
    ("MinHash near-dedup", dissimilar),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

# A trained classifier and a tokenizer can't be written in SQL; tests/llm compares each stage
# with a plain version on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the pieces of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = shared_folder(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
