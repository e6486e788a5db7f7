"""Contradictions: candidates among neighbours, their classification, and the queue of pending ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram import llm_api
from engram.functions import text
from engram.operators.graph import knn
from engram.schema import require

NEIGHBOURS, LEAST_SIMILARITY = 10, 0.5


def classify_pairs(pairs: DataFrame, a: str = "content_a", b: str = "content_b") -> DataFrame:
    c = pairs.withColumn("_c", text.heuristic_classify(F.col(a), F.col(b)))
    return c.withColumn("verdict", F.col("_c.verdict")).withColumn("confidence", F.col("_c.confidence")).drop("_c")


def classify_by(pairs: DataFrame, provider: llm_api.LlmProvider, a: str = "content_a", b: str = "content_b") -> DataFrame:
    """As classify_pairs(), by a provider; where its answer is no verdict, the heuristic's stands."""
    prompt = F.concat(F.lit(llm_api.contradiction_prompt("", "").split("\nA:")[0] + "\nA: "), F.col(a), F.lit("\nB: "), F.col(b))
    said = llm_api.parse(llm_api.map_prompts(classify_pairs(pairs, a, b).withColumn("prompt", prompt), "prompt", provider), "answer", llm_api.VERDICT)
    ok = F.coalesce(F.lower("parsed.verdict").isin("contradiction", "revision", "neutral"), F.lit(False))
    return said.withColumn("verdict", F.when(ok, F.lower("parsed.verdict")).otherwise(F.col("verdict"))).withColumn("confidence", F.when(ok, F.coalesce("parsed.confidence", F.lit(0.5))).otherwise(F.col("confidence"))).drop("prompt", "answer", "parsed")


def candidates(mem: DataFrame, edges: DataFrame, k: int = NEIGHBOURS, least: float = LEAST_SIMILARITY) -> DataFrame:
    """Near pairs of mem (one scope) that no `contradicts` or `revised_from` edge settles yet: id_a, id_b, similarity, contents."""
    near = knn(mem, "memory_id", "embedding", k - 1).withColumn("similarity", 1 - F.least(F.col("distance"), F.lit(2.0)) / 2).where(F.round("similarity", 9) >= least)
    settled = edges.where(F.col("edge_type").isin("contradicts", "revised_from")).select(F.col("src").alias("id"), F.col("dst").alias("neighbour"))
    open_ = near.join(settled, ["id", "neighbour"], "left_anti")
    rows = mem.where(F.trim("content") != "").select("memory_id", "content")
    a, b = rows.select(F.col("memory_id").alias("id"), F.col("content").alias("content_a")), rows.select(F.col("memory_id").alias("neighbour"), F.col("content").alias("content_b"))
    return open_.join(a, "id").join(b, "neighbour").select(F.col("id").alias("id_a"), F.col("neighbour").alias("id_b"), "similarity", "content_a", "content_b")


def pending(found: DataFrame, now_us: int) -> DataFrame:
    """Classified pairs that are not neutral, as rows of the queue."""
    c = classify_pairs(found).where("verdict <> 'neutral'")
    return c.select(F.sha2(F.concat_ws("/", "id_a", "id_b"), 256).alias("pending_id"), "id_a", "id_b", text.snippet(F.col("content_a")).alias("snippet_a"), text.snippet(F.col("content_b")).alias("snippet_b"), "verdict", "confidence", "similarity", F.lit(now_us).cast("long").alias("created_at"))


def commit(queue: DataFrame, edges: DataFrame, verdicts: DataFrame, now_us: int) -> tuple[DataFrame, DataFrame]:
    """verdicts: (pending_id, verdict, confidence). contradiction: edges both ways; revision: one from b to a; dismiss: none. All leave the queue."""
    unknown = verdicts.join(queue, "pending_id", "left_anti").limit(1).count()
    require(unknown == 0, "a verdict names no pending pair")
    v = queue.select("pending_id", "id_a", "id_b").join(verdicts, "pending_id")
    link = lambda df, src, dst, kind: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("edge_type"), F.col("confidence").cast("double").alias("confidence"), F.lit(now_us).cast("long").alias("ts_us"))
    yes = v.where("verdict = 'contradiction'")
    new = link(yes, "id_a", "id_b", "contradicts").unionByName(link(yes, "id_b", "id_a", "contradicts")).unionByName(link(v.where("verdict = 'revision'"), "id_b", "id_a", "revised_from"))
    return queue.join(verdicts.select("pending_id"), "pending_id", "left_anti"), edges.unionByName(new, allowMissingColumns=True)
