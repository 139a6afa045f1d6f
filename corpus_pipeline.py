"""Training-data pipeline over the documents table.

Each stage calls one operator of ``inkwarden.llm``, takes what its predecessor kept, and is written as
Parquet and read again before the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarden.llm import bpe, mixing, near_dedup, quality, toxicity
from inkwarden.session import shared_path, table

META = ["lang", "source"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", META, "quality")
    return quality.accepted(docs, model, "text", META)


def civil_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that it rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    return toxicity.accepted(docs, model, "text")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group of near-duplicates stays."""
    return near_dedup.deduplicate(docs, "doc_id", "text")


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a row for each take of a document, in order of training position."""
    mixed = mixing.mixed_documents(docs, "doc_id", "text", "source")
    return mixed.withColumn("n_chars", F.char_length("text").cast("long"))


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the ids of every text, and whether decoding gave the text back."""
    import public_tokenizers

    coded = bpe.encode(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True, keep=["doc_id", "lang", "source", "text"])
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", bpe.n_tokens().alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES = [
    ("quality", good_documents),
    ("toxicity", civil_documents),
    ("near_dedup", distinct_documents),
    ("mixing", mixed_documents),
    ("encoding", encoded_documents),
]

#: The classifiers and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each read back from the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), shared_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
