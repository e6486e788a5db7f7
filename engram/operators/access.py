"""Point reads, pages and exports of the memory table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions import scoring
from engram.schema import FOREVER, check_kind, check_top_k, require

EXPORT_MAX = 10_000


def get(mem: DataFrame, memory_id: str) -> DataFrame:
    require(len(memory_id) == 32, "a memory id has 32 hex digits")
    return mem.where(F.col("memory_id") == memory_id)


def batch_get(mem: DataFrame, ids: Sequence[str]) -> DataFrame:
    """In the order of the ids, missing ones left out; `pos` is the place in the list."""
    wanted = mem.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "pos long, memory_id string")
    return mem.join(F.broadcast(wanted), "memory_id").orderBy("pos")


def list_memories(mem: DataFrame, limit: int = 100, after: str | None = None, entity: str | None = None, kind: str | None = None) -> DataFrame:
    """A page in the order of ids; the last id of a full page is the cursor of the next."""
    check_top_k(limit)
    rows = mem
    if entity is not None:
        rows = rows.where(F.col("entity_id") == entity)
    if kind is not None:
        rows = rows.where(F.col("kind") == check_kind(kind))
    if after is not None:
        rows = rows.where(F.col("memory_id") > after)
    return rows.orderBy("memory_id").limit(limit)


def page(mem: DataFrame, limit: int = 100, **filters) -> tuple[list, str | None]:
    rows = list_memories(mem, limit, **filters).collect()
    return rows, rows[-1]["memory_id"] if len(rows) == limit else None


def list_by_entity(mem: DataFrame, entity: str, limit: int) -> DataFrame:
    return mem.where(F.col("entity_id") == entity).orderBy("created_at", "memory_id").limit(limit)


def list_entities(mem: DataFrame) -> DataFrame:
    return mem.where("entity_id is not null").select("entity_id").distinct().orderBy("entity_id")


def query_temporal(mem: DataFrame, entity: str, start: int = 0, end: int = FOREVER, newest_first: bool = False, limit: int | None = None) -> DataFrame:
    rows = mem.where((F.col("entity_id") == entity) & (F.col("created_at") >= start) & (F.col("created_at") < end))
    rows = rows.orderBy(F.desc("created_at"), F.desc("memory_id")) if newest_first else rows.orderBy("created_at", "memory_id")
    return rows if limit is None else rows.limit(limit)


def count_entity(mem: DataFrame, entity: str) -> DataFrame:
    return mem.where(F.col("entity_id") == entity).agg(F.count("*").alias("n"))


def export(mem: DataFrame, entity: str | None = None, limit: int = EXPORT_MAX) -> tuple[DataFrame, bool]:
    """Rows of an entity or all, and whether the limit cut them."""
    require(1 <= limit <= EXPORT_MAX, f"at most {EXPORT_MAX} rows")
    rows = mem if entity is None else mem.where(F.col("entity_id") == entity)
    some = rows.orderBy("created_at", "memory_id").limit(limit + 1)
    return some.limit(limit), some.count() > limit


def inspect(mem: DataFrame, edges: DataFrame, memory_id: str, now_us: int, most: int = 10_000) -> DataFrame:
    """A row with its decay as of now and its outgoing edges, of a hub the first `most` by type and target (the others by graph.outgoing)."""
    first = edges.where(F.col("src") == memory_id).orderBy("edge_type", "dst").limit(most)
    own = first.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("edge_type", "dst", "confidence"))).alias("edges"))
    return get(mem, memory_id).withColumn("decay_now", scoring.decay(now_us)).join(own, F.col("memory_id") == F.col("src"), "left").drop("src")


def count_by(mem: DataFrame, *columns: str) -> DataFrame:
    """Rows for each combination of the columns; in all without any."""
    return mem.groupBy(*columns).agg(F.count("*").alias("n"))


def content_groups(mem: DataFrame) -> DataFrame:
    """(content_hash, n, memory_id): how many rows have one content, and the most important of them (ties to the smaller id). Copies meet before
    the shuffle."""
    best = F.min_by("memory_id", F.struct((-F.col("importance")).alias("i"), "memory_id"))
    return mem.groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.count("*").alias("n"), best.alias("memory_id"))


def of_tenant(df: DataFrame, tenant: str) -> DataFrame:
    return df.where(F.col("tenant_id") == tenant)
