"""State transitions as pure functions from tables to tables; store.MemoryStore commits what they return."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.functions import scoring
from engram.schema import DAY_US, MAX_CONTENT_BYTES, MAX_CONTEXT_BYTES, check_kind, require

SNAPSHOTS = 100
TOMBSTONE_DAYS = 90
FORGET_BATCH, FORGET_MAX = 1_000, 100_000
SWEEP_EPSILON, AUTO_FORGET_BELOW = 0.001, 0.01


def new_ids(now_us: int, key: Column) -> Column:
    """32 hex digits: milliseconds, then a hash of the key; sorted by time. A row that is computed again gets the same id."""
    return F.concat(F.lpad(F.lower(F.hex(F.lit(now_us // 1000))), 12, "0"), F.substring(F.sha2(F.concat(F.lit(str(now_us)), F.lit("/"), key), 256), 1, 20))


def remember(mem: DataFrame, new: DataFrame, now_us: int, tenant: str = "default") -> DataFrame:
    """mem with the rows of new (content; optional importance, context, entity_id, embedding, kind, device_id, memory_id). Every row without an
    id gets one of its own, equal rows too: the id's hash is of the row and its number in new, which needs no shuffle."""
    has = set(new.columns)
    get = lambda c, kind, default: F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in has and default is not None else (F.col(c).cast(kind) if c in has else F.lit(default).cast(kind))
    importance = get("importance", "double", 0.5)
    bad = F.octet_length("content") > MAX_CONTENT_BYTES
    checked = F.when(F.col("content").isNull() | bad, F.raise_error(F.lit(f"content is missing or above {MAX_CONTENT_BYTES} bytes"))).otherwise(F.col("content"))
    context = get("context", "string", None)
    context = F.when(F.octet_length(context) > MAX_CONTEXT_BYTES, F.raise_error(F.lit(f"context above {MAX_CONTEXT_BYTES} bytes"))).otherwise(context)
    in_range = F.when((importance < 0) | (importance > 1), F.raise_error(F.lit("importance outside 0..1"))).otherwise(importance)
    vector = F.col("embedding").cast("array<double>") if "embedding" in has else F.lit(None).cast("array<double>")
    key = F.concat(F.monotonically_increasing_id().cast("string"), F.lit("/"), F.to_json(F.struct(*sorted(has - {"embedding"}))))
    rows = new.select(
        F.lit(tenant).alias("tenant_id"), (F.col("memory_id") if "memory_id" in has else new_ids(now_us, key)).alias("memory_id"), checked.alias("content"), in_range.alias("importance"), context.alias("context"),
        get("entity_id", "string", None).alias("entity_id"), vector.alias("embedding"), vector.alias("assoc_embedding"), *(F.lit(now_us).cast("long").alias(c) for c in ("created_at", "updated_at", "last_accessed_at")),
        F.lit(0).cast("long").alias("access_count"), in_range.alias("decay_score"), get("kind", "string", "episode").alias("kind"), get("device_id", "string", None).alias("device_id"), F.lit(0).cast("long").alias("logical_clock"), F.lit(False).alias("is_snapshot"),
    )
    return mem.unionByName(rows, allowMissingColumns=True)


def merge_context(old: Column, new: Column) -> Column:
    """Top-level merge of JSON objects: keys of the new one win. Values keep their types, as text."""
    kind = "map<string,variant>"
    read = lambda c: F.from_json(F.coalesce(c, F.lit("{}")), kind)
    a, b = read(old), read(new)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))))


def revise(mem: DataFrame, edges: DataFrame, changes: DataFrame, now_us: int, replace_context: bool = False) -> tuple[DataFrame, DataFrame]:
    """changes: memory_id and any of content, importance, context, entity_id, embedding. The row keeps its id; what it was is kept as a
    snapshot under a new id, with a `revised_from` edge to it."""
    has = set(changes.columns)
    c = changes.select(*(F.col(x).alias(f"_{x}") for x in changes.columns))
    joined = mem.join(c, F.col("memory_id") == F.col("_memory_id"), "left")
    hit = F.col("_memory_id").isNotNull()
    pick = lambda x: F.coalesce(F.col(f"_{x}"), F.col(x)) if x in has else F.col(x)
    context = F.col("context")
    if "context" in has:
        merged = F.col("_context") if replace_context else merge_context(F.col("context"), F.col("_context"))
        context = F.when(hit & F.col("_context").isNotNull(), merged).otherwise(F.col("context"))
    new = {"content": pick("content"), "importance": pick("importance"), "entity_id": pick("entity_id"), "context": context, "decay_score": pick("importance"), "kind": F.lit("revision"), "updated_at": F.lit(now_us).cast("long"), "logical_clock": F.coalesce(F.col("logical_clock"), F.lit(0)) + 1 if "logical_clock" in mem.columns else F.lit(1)}
    if "embedding" in has:
        new["embedding"] = pick("embedding")
    out = joined.select(*(F.when(hit, new[x]).otherwise(F.col(x)).alias(x) if x in new else F.col(x) for x in mem.columns))
    before = mem.join(changes.select("memory_id"), "memory_id", "left_semi")
    snapshot_id = new_ids(now_us, F.concat(F.lit("snapshot/"), F.col("memory_id")))
    named = before.withColumn("_new", snapshot_id)
    links = named.select(*([F.lit("default").alias("tenant_id")] if "tenant_id" in edges.columns else []), F.col("memory_id").alias("src"), F.col("_new").alias("dst"), F.lit("revised_from").alias("edge_type"), F.lit(1.0).alias("confidence"), F.lit(now_us).cast("long").alias("ts_us"))
    snapshots = named.withColumn("memory_id", F.col("_new")).drop("_new")
    if "is_snapshot" in mem.columns:
        snapshots = snapshots.withColumn("is_snapshot", F.lit(True))
    return out.unionByName(snapshots.select(*mem.columns)), edges.unionByName(links)


def snapshots_of(edges: DataFrame) -> DataFrame:
    """(owner, snapshot): targets of `revised_from` whose incoming edges are of that type only."""
    only = edges.groupBy("dst").agg(F.bool_and(F.col("edge_type") == "revised_from").alias("only")).where("only").select("dst")
    return edges.where("edge_type = 'revised_from'").join(only, "dst").select(F.col("src").alias("owner"), F.col("dst").alias("snapshot"))


def surplus_snapshots(edges: DataFrame, keep: int = SNAPSHOTS) -> DataFrame:
    """Snapshots beyond the newest `keep` of their owner."""
    newest = W.partitionBy("owner").orderBy(F.desc("snapshot"))
    return snapshots_of(edges).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") > keep).drop("_r")


def reinforce(mem: DataFrame, hits: DataFrame, now_us: int) -> DataFrame:
    """Rows that a recall returned were accessed now."""
    ids = hits.select("memory_id").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    new = {"last_accessed_at": F.lit(now_us).cast("long"), "access_count": F.col("access_count") + 1}
    return mem.join(ids, "memory_id", "left").select(*(F.when(hit, new[x]).otherwise(F.col(x)).alias(x) if x in new else F.col(x) for x in mem.columns))


@dataclass(frozen=True)
class Criteria:
    """What to forget; all that is given must hold, and something must be given."""

    ids: tuple[str, ...] = ()
    entity: str | None = None
    not_accessed_since_us: int | None = None
    access_below: int | None = None
    kind: str | None = None
    decay_below: float | None = None

    def predicate(self) -> Column:
        parts = []
        if self.ids:
            parts.append(F.col("memory_id").isin(list(self.ids)))
        if self.entity is not None:
            parts.append(F.col("entity_id") == self.entity)
        if self.not_accessed_since_us is not None:
            parts.append(F.col("last_accessed_at") < self.not_accessed_since_us)
        if self.access_below is not None:
            parts.append(F.col("access_count") < self.access_below)
        if self.kind is not None:
            parts.append(F.col("kind") == check_kind(self.kind))
        if self.decay_below is not None:
            parts.append(F.col("decay_score") < self.decay_below)
        require(len(parts) > 0, "forget needs a criterion")
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def describe(self) -> str:
        parts = [f"ids:{len(self.ids)}"] if self.ids else []
        parts += [f"entity:{self.entity}"] if self.entity is not None else []
        parts += ["staleness<" + str(self.not_accessed_since_us)] if self.not_accessed_since_us is not None else []
        parts += [f"access<{self.access_below}"] if self.access_below is not None else []
        parts += [f"kind:{self.kind}"] if self.kind is not None else []
        parts += [f"decay<{self.decay_below:.3f}"] if self.decay_below is not None else []
        return ",".join(parts)


@dataclass
class Forgotten:
    memories: DataFrame
    edges: DataFrame
    tombstones: DataFrame
    stale_insights: DataFrame


def forget(mem: DataFrame, edges: DataFrame, criteria: Criteria, now_us: int, most: int | None = None) -> Forgotten:
    """Delete what the criteria name, with its snapshots and edges; tombstones say what went, and which insights lost a source."""
    chosen = mem.where(criteria.predicate())
    if most is not None:
        require(1 <= most <= FORGET_MAX, f"at most {FORGET_MAX} rows")
        chosen = chosen.orderBy("memory_id").limit(most)
    ids = chosen.select("memory_id")
    snaps = snapshots_of(edges).join(ids.withColumnRenamed("memory_id", "owner"), "owner", "left_semi").select(F.col("snapshot").alias("memory_id"))
    gone = ids.unionByName(snaps).distinct()
    marks = chosen.select("memory_id", "entity_id", "kind", F.lit(criteria.describe()).alias("criteria"), F.sha2("content", 256).alias("content_hash"), F.lit(now_us).cast("long").alias("forgotten_at"))
    links = edges.join(gone.withColumnRenamed("memory_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("memory_id", "dst"), "dst", "left_anti").select(*edges.columns)
    return Forgotten(mem.join(gone, "memory_id", "left_anti").select(*mem.columns), links, marks, stale_insights(edges, ids).join(gone, "memory_id", "left_anti"))


def delete(mem: DataFrame, edges: DataFrame, memory_id: str) -> tuple[DataFrame, DataFrame]:
    return mem.where(F.col("memory_id") != memory_id), edges.where((F.col("src") != memory_id) & (F.col("dst") != memory_id))


def stale_insights(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Insights with an `insight_from` edge to one of the changed rows."""
    return edges.where("edge_type = 'insight_from'").join(changed.select(F.col("memory_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("memory_id")).distinct()


def decay_sweep(mem: DataFrame, now_us: int, half_life_us: int = scoring.HALF_LIFE_US, epsilon: float = SWEEP_EPSILON, below: float = AUTO_FORGET_BELOW) -> DataFrame:
    """mem's ids with the old and the new decay score, whether it is to be written, and whether the row may be forgotten: one projection."""
    new = scoring.decay(now_us, half_life_us)
    return mem.select("memory_id", F.col("decay_score").alias("old_score"), new.alias("new_score")).withColumn("changed", F.abs(F.col("new_score") - F.col("old_score")) > epsilon).withColumn("candidate", F.col("new_score") < below)


def apply_sweep(mem: DataFrame, now_us: int, half_life_us: int = scoring.HALF_LIFE_US, epsilon: float = SWEEP_EPSILON) -> DataFrame:
    new = scoring.decay(now_us, half_life_us)
    return mem.withColumn("decay_score", F.when(F.abs(new - F.col("decay_score")) > epsilon, new).otherwise(F.col("decay_score")))


def auto_forget(mem: DataFrame, edges: DataFrame, candidates: DataFrame, now_us: int) -> Forgotten:
    """Forget the candidates of a sweep; their ids stay a table."""
    ids = candidates.where("candidate").select("memory_id")
    chosen = mem.join(ids, "memory_id", "left_semi")
    snaps = snapshots_of(edges).join(ids.withColumnRenamed("memory_id", "owner"), "owner", "left_semi").select(F.col("snapshot").alias("memory_id"))
    gone = ids.unionByName(snaps).distinct()
    marks = chosen.select("memory_id", "entity_id", "kind", F.lit("auto").alias("criteria"), F.sha2("content", 256).alias("content_hash"), F.lit(now_us).cast("long").alias("forgotten_at"))
    links = edges.join(gone.withColumnRenamed("memory_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("memory_id", "dst"), "dst", "left_anti").select(*edges.columns)
    return Forgotten(mem.join(gone, "memory_id", "left_anti").select(*mem.columns), links, marks, stale_insights(edges, ids).join(gone, "memory_id", "left_anti"))


def gc_tombstones(tombstones: DataFrame, now_us: int, days: int = TOMBSTONE_DAYS) -> DataFrame:
    return tombstones.where(F.col("forgotten_at") >= now_us - days * DAY_US)


@dataclass(frozen=True)
class Policy:
    """What set_policy stores for a tenant; revise and the sweep read it."""

    max_snapshots: int = SNAPSHOTS
    auto_forget_below: float = AUTO_FORGET_BELOW
    half_life_us: int = scoring.HALF_LIFE_US
