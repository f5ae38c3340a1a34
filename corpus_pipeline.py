"""A pipeline from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and all
but the last return the columns of `docs`. `run` writes each stage's rows and reads
them again, so a lost executor costs no more than a task of the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.exact_dedup import without_copies
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.packing import pack_documents
from tidemark.llm.parity_join import one_of_each
from tidemark.llm.toxicity import train, without_toxic
from tidemark.sources.scratch import materialize

TOKENIZER = "word_bpe_49k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a machine fitted on the labelled ones scores as toxic go."""
    return without_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest stays."""
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8) one stays."""
    return one_of_each(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1, repeating; no document more than three times."""
    return mixed_documents(docs, weights=[5, 2, 1], most_copies=3)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their token ids."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# Stages learn, tokenize and hash, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
