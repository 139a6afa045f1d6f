"""The contract queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, html_text, mixing, quality, simhash, token_counts, topk, toxicity, warc, winnowing

#: Tokens above which op9 flags a document.
TOKEN_LIMIT = 1024


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_likeness(table(spark, sf_dir, "documents"), "doc_id", "text")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", shingle=4, radius=4)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, meta = table(spark, sf_dir, "documents"), ["lang", "source"]
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", meta, "quality")
    return quality.score(docs, model, "text", meta, ["doc_id"]).withColumn("keep", F.col("quality_score") >= quality.KEEP)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return coded.select("doc_id", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    return toxicity.score(docs, model, "text", ["doc_id"]).withColumn("toxic", F.col("toxic_probability") >= toxicity.REJECT)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), "page_id", "url", "html")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), "page_id", "url", "html").drop("target_uri")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5, scale=256)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_winnowing, op2_simhash, op3_quality, op4_mixing, op5_byte_bpe, op6_toxicity, op7_html_text, op8_warc, op9_token_counts, op10_top_k)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.MIX_SQL, "op8_warc": warc.ARCHIVE_SQL, "op10_top_k": topk.TOP_K_SQL}
