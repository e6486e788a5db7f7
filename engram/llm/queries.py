"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import ann, bpe, decontaminate, language_id, lm_score, secret_scan, simhash, token_count, toxicity, warc
from engram.llm._common import scratch_path, table


def fold(mod: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo mod; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(mod)), F.lit(0))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.fit(docs.where(fold(5) != 0), "text", "lang", "doc_id")
    return language_id.predict(docs, "doc_id", "text", model).select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.round_trip(pages, "page_id", "url", "html", scratch_path(spark, "warc"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.search(rows, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=10)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(fold(5) != 0)
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic")
    return toxicity.score(docs, "doc_id", "text", model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.encode_batches(docs, "doc_id", "text", columns=("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", fold(7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.contamination(docs, "doc_id", "text", table(spark, sf_dir, "benchmark", "item_id", "text"), "item_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.SQL, "op10_decontaminate": decontaminate.SQL}
