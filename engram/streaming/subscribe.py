"""Subscriptions on Structured Streaming: text comes in pieces, is gathered per subscription, and what is remembered is pushed when it fits.

Input rows: (subscription, kind, text, ts_us); kind is text, flush, pause, resume, reset or close. State per subscription: the buffer,
its number of tokens and first time, the ids pushed so far, and whether it is paused. A buffer is flushed at 15 tokens, after half a second with 3
or more (a processing-time timeout), or when asked.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.functions import text as texts
from engram.functions import vec
from engram.operators import exact
from engram.schema import require

MAX_SUBSCRIPTIONS, REFRESH_US, REFRESH_WRITES = 100, 60_000_000, 100
FLUSH_TOKENS, LEAST_TOKENS, FLUSH_MS, MOST_BYTES = 15, 3, 500, 64 * 1024
LEAST_CENTROID, LEAST_CONFIDENCE, NEIGHBOURS, QUEUE = 0.15, 0.60, 5, 100
KINDS = ("episode", "insight", "revision")
CHUNKS = "subscription string, chunk string, reason string, ts_us long"


def accumulate(rows: DataFrame) -> DataFrame:
    """A stream of whole chunks: (subscription, chunk, reason, ts_us)."""
    state = "buffer string, tokens int, first_us long, paused boolean, closed boolean"

    def step(key: tuple, batches: Iterator, held) -> Iterator:
        import pandas as pd

        buffer, tokens, first, paused, closed = held.get if held.exists else ("", 0, 0, False, False)
        out: list[tuple] = []

        def flush(reason: str, ts: int) -> None:
            nonlocal buffer, tokens, first
            if tokens:
                out.append((key[0], buffer, reason, ts))
            buffer, tokens, first = "", 0, 0

        if held.hasTimedOut:
            if tokens >= LEAST_TOKENS and not paused:
                flush("time", first)
        else:
            rows = sorted((r for pdf in batches for r in pdf[["ts_us", "kind", "text"]].itertuples(index=False)), key=lambda r: r.ts_us)
            for r in rows:
                if closed:
                    break
                if r.kind == "text" and not paused and isinstance(r.text, str) and r.text.strip():
                    if tokens and r.ts_us - first >= FLUSH_MS * 1000 and tokens >= LEAST_TOKENS:
                        flush("time", int(r.ts_us))
                    joined = f"{buffer} {r.text}".strip() if buffer else r.text
                    if len(joined.encode()) > MOST_BYTES:
                        flush("size", int(r.ts_us))
                        joined = r.text
                    first = first or int(r.ts_us)
                    buffer, tokens = joined, len(joined.split())
                    if tokens >= FLUSH_TOKENS:
                        flush("tokens", int(r.ts_us))
                elif r.kind in ("flush", "close"):
                    flush(r.kind, int(r.ts_us))
                    closed = closed or r.kind == "close"
                elif r.kind == "pause":
                    paused = True
                elif r.kind == "resume":
                    paused = False
        held.update((buffer, tokens, first, paused, closed))
        if tokens >= LEAST_TOKENS and not paused and not closed:
            held.setTimeoutDuration(FLUSH_MS)
        yield pd.DataFrame(out, columns=["subscription", "chunk", "reason", "ts_us"])

    return rows.groupBy("subscription").applyInPandasWithState(step, CHUNKS, state, "append", "ProcessingTimeTimeout")


def scope_keywords(mem: DataFrame) -> DataFrame:
    """The distinct keywords of a scope: what the first stage looks a chunk's words up in."""
    return mem.select(F.explode(texts.keywords(F.col("content"))).alias("word")).distinct()


def bloom(words: Sequence[str], fp: float = 0.01, most_hashes: int = 20) -> tuple[np.ndarray, int]:
    """Bits and the number of hashes of a filter of that false-positive rate."""
    n = max(1, len(words))
    m = max(64, int(-n * np.log(fp) / np.log(2) ** 2))
    k = max(1, min(most_hashes, round(m / n * np.log(2))))
    bits = np.zeros(m, dtype=bool)
    for w in words:
        bits[_places(w, m, k)] = True
    return bits, k


def _places(word: str, m: int, k: int) -> list[int]:
    import hashlib

    d = hashlib.blake2b(word.encode(), digest_size=16).digest()
    a, b = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 1
    return [(a + i * b) % m for i in range(k)]


def bloom_has(bits: np.ndarray, k: int, word: str) -> bool:
    return bool(bits[_places(word, len(bits), k)].all())


def centroid(mem: DataFrame) -> list[float]:
    """Unit mean vector of a scope; empty if the scope is."""
    r = vec.mean(mem.where("embedding is not null"), "embedding").first()
    return [] if r is None else vec.normalized(r["vec"])


def matches(chunks: DataFrame, mem: DataFrame, keywords: DataFrame, centre: Sequence[float], entity: str | None = None, kinds: Sequence[str] = KINDS, since_us: int | None = None, least: float = LEAST_CONFIDENCE, k: int = NEIGHBOURS) -> DataFrame:
    """chunks: (chunk_id, chunk, embedding), a micro-batch. Three stages: a keyword of the scope occurs; the chunk is near the centroid; then the k
    nearest rows with enough confidence."""
    scope = mem.where(F.col("kind").isin(list(kinds)) & F.col("embedding").isNotNull())
    scope = scope if entity is None else scope.where(F.col("entity_id") == entity)
    scope = scope if since_us is None else scope.where(F.col("created_at") >= since_us)
    heard = chunks.select("chunk_id", F.explode(texts.keywords(F.col("chunk"))).alias("word")).join(keywords, "word", "left_semi").select("chunk_id").distinct()
    passed = chunks.join(heard, "chunk_id", "left_semi")
    if centre:
        passed = passed.where(vec.dot(F.col("embedding"), list(centre)) >= LEAST_CENTROID)
    return nearest(passed, scope, k).where(F.round("confidence", 9) >= least)


def nearest(chunks: DataFrame, scope: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """(chunk_id, memory_id, confidence): the k nearest rows of scope for each chunk. Different vectors of both meet in tiles of bounded size."""
    found = exact.nearest(chunks.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("v")), scope.select(F.col("memory_id").alias("id"), F.col("embedding").alias("v")), k, block)
    return found.select(F.col("id").alias("chunk_id"), F.col("neighbour").alias("memory_id"), F.greatest(F.lit(0.0), 1 - F.col("distance")).alias("confidence"))


def stages(chunks: DataFrame, keywords: DataFrame, centre: Sequence[float]) -> DataFrame:
    """chunks with `stage`, what stops them: bloom (no keyword of the scope), coarse (far from its centroid) or null (they go on)."""
    heard = chunks.select("chunk_id", F.explode(texts.keywords(F.col("chunk"))).alias("word")).join(keywords, "word", "left_semi").select("chunk_id").distinct().withColumn("_heard", F.lit(True))
    far = vec.dot(F.col("embedding"), list(centre)) < LEAST_CENTROID if len(centre) else F.lit(False)
    return chunks.join(heard, "chunk_id", "left").withColumn("stage", F.when(F.col("_heard").isNull(), "bloom").when(far, "coarse")).drop("_heard")


def stats(staged: DataFrame, pushes: DataFrame, capacity: int = QUEUE) -> DataFrame:
    """A row for each subscription: chunks processed, rejected by keywords and by the centroid, pushes sent, and dropped from its ring."""
    c = staged.groupBy("subscription").agg(F.count("*").alias("chunks_processed"), F.count_if(F.col("stage") == "bloom").alias("chunks_bloom_rejected"), F.count_if(F.col("stage") == "coarse").alias("chunks_coarse_rejected"))
    p = pushes.groupBy("subscription").agg(F.count("*").alias("pushes_sent"), F.greatest(F.lit(0), F.count("*") - capacity).alias("pushes_dropped"))
    none = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    return c.join(p, "subscription", "full_outer").select("subscription", *map(none, ("chunks_processed", "chunks_bloom_rejected", "chunks_coarse_rejected", "pushes_sent", "pushes_dropped")))


def new_writes(written: DataFrame, contexts: DataFrame) -> DataFrame:
    """written: new rows of the memory table, a micro-batch; contexts: a row for each open subscription (subscription, tenant_id, entity_id or null, kinds,
    since_us or null, embedding of its last chunk). (subscription, memory_id, confidence) of the rows that are in the scope of a subscription and near
    enough to what it heard last. Subscriptions are bounded (MAX_SUBSCRIPTIONS) and meet the rows of their tenant."""
    c = contexts.select("subscription", "tenant_id", F.col("entity_id").alias("_entity"), "kinds", "since_us", F.col("embedding").alias("_heard"))
    both = written.where("embedding is not null").join(F.broadcast(c), "tenant_id")
    inside = (F.col("_entity").isNull() | (F.col("entity_id") == F.col("_entity"))) & F.array_contains("kinds", F.col("kind")) & (F.col("since_us").isNull() | (F.col("created_at") >= F.col("since_us")))
    near = both.where(inside).withColumn("confidence", vec.dot_relevance(F.col("embedding"), F.col("_heard")))
    return near.where(F.round("confidence", 9) >= LEAST_CONFIDENCE).select("subscription", "memory_id", "confidence")


def open_subscription(held: DataFrame, new: DataFrame, most: int = MAX_SUBSCRIPTIONS) -> DataFrame:
    """The registry (subscription, ...) with new ones, of which there may be `most` in all."""
    known = held.count()
    require(known + new.count() <= most, f"at most {most} subscriptions")
    require(new.join(held.select("subscription"), "subscription", "left_semi").limit(1).count() == 0, "the subscription is open already")
    return held.unionByName(new)


def refresh_due(last_us: int, writes: int, now_us: int) -> bool:
    """Whether a scope's keywords and centroid are to be made anew: after a minute, or 100 writes in the scope."""
    return now_us - last_us >= REFRESH_US or writes >= REFRESH_WRITES


def reset_dedup(pushed: DataFrame, subscription: str) -> DataFrame:
    """What was pushed, without that of a subscription, so that it may be pushed to it again."""
    return pushed.where(F.col("subscription") != subscription)


def not_pushed(found: DataFrame, pushed: DataFrame) -> DataFrame:
    """Matches whose memory was not pushed to the subscription before."""
    return found.join(pushed.select("subscription", "memory_id"), ["subscription", "memory_id"], "left_anti")


def ring(pushes: DataFrame, capacity: int = QUEUE) -> DataFrame:
    """The newest pushes of each subscription, and how many were dropped."""
    newest = W.partitionBy("subscription").orderBy(F.desc("ts_us"), "memory_id")
    kept = pushes.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= capacity).drop("r")
    total = pushes.groupBy("subscription").agg(F.greatest(F.lit(0), F.count("*") - capacity).alias("dropped"))
    return kept.join(total, "subscription")


def config(**changes) -> str:
    """The settings of a subscription as JSON, with defaults."""
    return json.dumps({"flush_tokens": FLUSH_TOKENS, "flush_ms": FLUSH_MS, "least_confidence": LEAST_CONFIDENCE, "neighbours": NEIGHBOURS, "queue": QUEUE} | changes, sort_keys=True)
