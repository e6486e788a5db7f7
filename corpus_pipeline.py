"""A training-corpus pipeline over `documents`: five stages, each on all that its predecessor kept.

language_id keeps documents whose language is told with a score of at least MIN_LANGUAGE; simhash keeps the document of the smallest id
of each group of near-duplicates (five-word shingles, similarity 0.8); decontaminate drops those that hold a benchmark item; secret_scan replaces secrets by a mark and
sets n_chars anew; byte_bpe encodes and adds ids, their number and the digest of the decoded bytes.

Cases: null and empty texts have no language and go in the first stage. The stages that drop rows know a row by its id and the hash of its
text, so rows without an id are documents like others: copies, near copies and contaminated ones among them go, and clean ones stay. Rows
of one id and one text are one document, of which one row stays; rows of one id with different texts are judged by their texts. Of a group the document of
the smallest id stays, one without an id only if no other has one. Empty tables pass through. Extra columns of documents are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import bpe, decontaminate, language_id, secret_scan, simhash
from engram.llm._common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_LANGUAGE = 0.5
#: Entries of the encoder's memos: executors that have run the other stages have less room left.
MEMO = 250_000


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with `key`, which tells rows apart without an id as well; keys are ordered by id, those without one last."""
    return docs.withColumn("key", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text_hash")))


def _same(a: DataFrame, b: DataFrame) -> Column:
    """Rows of a and b have one key; b's columns are those of the key."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (F.xxhash64(a["text"]) == b["text_hash"])


def _keys(found: DataFrame, tag: str) -> DataFrame:
    """The distinct keys, as a written table. It is joined by merging: it grows with the documents, so no size check would let it be broadcast
    on a large corpus, and small ones are planned alike."""
    return materialize(found.select("key.doc_id", "key.text_hash").distinct(), tag).hint("merge")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs, "text", "lang", "doc_id")
    return language_id.annotate(docs, "text", model).where((F.col("lang_pred") != "und") & (F.col("lang_score") >= MIN_LANGUAGE)).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    found = materialize(simhash.similar_texts(_keyed(docs), "key", "text"), "groups")
    dropped = _keys(found.where(F.col("key") != F.col("component_id")), "dropped")
    again = _keys(found.groupBy("key").count().where("count > 1"), "repeated")
    kept = docs.join(dropped, _same(docs, dropped), "left_anti")
    if again.limit(1).count():
        once = kept.join(again, _same(kept, again), "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(again, _same(kept, again), "left_anti").unionByName(once)
    return kept


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    held = decontaminate.hits(_keyed(docs), "key", "text", items, "item_id", "text")
    dropped = _keys(held.select(F.col("id").alias("key")), "dropped")
    return docs.join(dropped, _same(docs, dropped), "left_anti")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    rows = secret_scan.with_spans(docs, "text", secret_scan.thresholds(docs, "text"))
    text = secret_scan.redacted(F.col("text"), F.col("_spans"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", F.when(F.size("_spans") > 0, F.length(text)).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_batches(docs.select("doc_id", "text"), "doc_id", "text", columns=("ids", "n_tokens", "ids_sha256", "decoded_sha256"), memo=MEMO)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("simhash", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secret_scan", secret_stage),
    ("byte_bpe", encode_stage),
]
#: Language ID, SimHash and BPE are not expressible in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
