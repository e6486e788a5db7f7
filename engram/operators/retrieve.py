"""Recall: four strategies over the memory table, their merge under the composite score, and priming for an entity.

Each strategy is one scan, a projection and a bounded top-k (TakeOrderedAndProject): nothing is shuffled but k rows a task.
Rows are ordered by score and then by memory_id, so that ties have one order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.functions import scoring, vec
from engram.functions.scoring import Weights
from engram.operators import graph
from engram.schema import DAY_US, FOREVER, MAX_PRIME, STRATEGIES, check_top_k, require

OVERSAMPLE = 4


def _entity(mem: DataFrame, entity: str | None) -> DataFrame:
    return mem if entity is None else mem.where(F.col("entity_id") == entity)


def search_similar(mem: DataFrame, cue: Sequence[float], k: int, column: str = "embedding") -> DataFrame:
    """The k rows nearest to the cue, with their inner-product distance."""
    near = mem.withColumn("distance", vec.distance(F.col(column), list(cue))).where(F.col("distance").isNotNull())
    return near.orderBy("distance", "memory_id").limit(k)


def similarity(mem: DataFrame, cue: Sequence[float], k: int = 10, entity: str | None = None, prefilter: bool = True) -> DataFrame:
    """mem's columns, relevance and strategy. Without prefilter, the entity is looked for among 4k nearest rows only."""
    check_top_k(k)
    if entity is None or prefilter:
        hits = search_similar(_entity(mem, entity), cue, k)
    else:
        hits = _entity(search_similar(mem, cue, OVERSAMPLE * k), entity).orderBy("distance", "memory_id").limit(k)
    return hits.withColumn("relevance", F.greatest(F.lit(0.0), 1 - F.col("distance"))).withColumn("strategy", F.lit("similarity"))


def temporal(mem: DataFrame, entity: str, k: int = 10, start: int = 0, end: int = FOREVER) -> DataFrame:
    """The newest k rows of the entity in [start, end); relevance falls evenly from 1 by rank."""
    check_top_k(k)
    require(entity is not None, "temporal recall needs an entity")
    hits = _entity(mem, entity).where((F.col("created_at") >= start) & (F.col("created_at") < end)).orderBy(F.desc("created_at"), F.desc("memory_id")).limit(k)
    newest = W.orderBy(F.desc("created_at"), F.desc("memory_id"))  # over k rows at most
    rank, total = F.row_number().over(newest) - 1, F.count("*").over(W.partitionBy())
    return hits.withColumn("rank", rank).withColumn("relevance", F.when(total <= 1, 1.0).otherwise(1 - F.col("rank") / total)).drop("rank").withColumn("strategy", F.lit("temporal"))


def causal(mem: DataFrame, seed: Sequence[float], seed_id: str, offsets: dict[str, Sequence[float]], k: int = 10, types: Sequence[str] | None = None, direction: str = "both", entity: str | None = None) -> DataFrame:
    """Neighbours of seed + offset (forward) and seed - offset (backward) for each edge type with a learned offset: k for each,
    the first in the order of types and directions wins, then the k most relevant (mem's columns, distance, edge_type, relevance, strategy)."""
    check_top_k(k)
    require(direction in ("forward", "backward", "both"), f"direction {direction!r}")
    probes = []
    for t in types or list(offsets):
        if t in offsets:
            for sign in {"forward": (1,), "backward": (-1,), "both": (1, -1)}[direction]:
                probes.append((t, vec.normalized([s + sign * o for s, o in zip(seed, offsets[t], strict=True)])))
    if not probes:
        return mem.limit(0).withColumn("edge_type", F.lit("")).withColumn("relevance", F.lit(0.0)).withColumn("strategy", F.lit("causal"))
    # one scan: the distances to all probes, then k for each probe with a limit in every task, of ids and numbers only
    base = _entity(mem, entity).where(F.col("memory_id") != seed_id)
    each = F.array(*(F.struct(F.lit(order).alias("probe"), F.lit(t).alias("edge_type"), vec.distance(F.col("assoc_embedding"), cue).alias("distance")) for order, (t, cue) in enumerate(probes)))
    flat = base.select("memory_id", F.explode(each).alias("p")).select("memory_id", "p.*").where(F.col("distance").isNotNull())
    near = flat.withColumn("_r", F.row_number().over(W.partitionBy("probe").orderBy("distance", "memory_id"))).where(F.col("_r") <= k)
    first = near.groupBy("memory_id").agg(F.min(F.struct("probe", "distance", "edge_type")).alias("p")).select("memory_id", "p.distance", "p.edge_type")
    best = first.withColumn("relevance", F.greatest(F.lit(0.0), 1 - F.col("distance"))).orderBy(F.desc("relevance"), "memory_id").limit(k)
    # k rows, so they may be broadcast whatever mem holds
    return mem.join(F.broadcast(best), "memory_id").withColumn("strategy", F.lit("causal"))


def causal_by_edges(mem: DataFrame, visited: DataFrame, max_depth: int, k: int = 10, entity: str | None = None) -> DataFrame:
    """For a seed without embedding: rows reached over edges (graph.traverse), the nearer the more relevant."""
    reached = visited if entity is None else visited.join(_entity(mem, entity).select("memory_id"), "memory_id", "left_semi")
    near = reached.orderBy("depth", "memory_id").limit(k)
    return mem.join(F.broadcast(near), "memory_id").withColumn("relevance", F.greatest(F.lit(0.0), 1 - F.col("depth") / max_depth)).withColumn("strategy", F.lit("causal"))


def analogical(mem: DataFrame, cue: Sequence[float], cue_context: dict | None = None, k: int = 10, entity: str | None = None, alpha: float = 0.5) -> DataFrame:
    """Of the max(3k, 30) nearest rows (four times as many with an entity, which is then looked for), the k best by a blend of similarity and structure."""
    check_top_k(k)
    alpha = min(1.0, max(0.0, alpha))
    n = max(3 * k, 30) * (OVERSAMPLE if entity is not None else 1)
    near = _entity(search_similar(mem, cue, n), entity).withColumn("embedding_similarity", F.greatest(F.lit(0.0), 1 - F.col("distance")))
    both = near.withColumn("structural_similarity", scoring.structural_similarity(cue_context or {}, entity))
    blend = both.withColumn("relevance", alpha * F.col("embedding_similarity") + (1 - alpha) * F.col("structural_similarity"))
    return blend.orderBy(F.desc("relevance"), "memory_id").limit(k).withColumn("strategy", F.lit("analogical"))


def analogy(mem: DataFrame, a: Sequence[float], b: Sequence[float], c: Sequence[float], k: int = 10, entity: str | None = None) -> DataFrame:
    """A is to B as C is to what: neighbours of C moved along the direction from A to B."""
    check_top_k(k)
    step = vec.normalized([y - x for x, y in zip(a, b, strict=True)])
    target = vec.normalized([x + y for x, y in zip(c, step, strict=True)])
    hits = _entity(search_similar(mem, target, k * OVERSAMPLE if entity is not None else k, "assoc_embedding"), entity)
    return hits.withColumn("relevance", F.greatest(F.lit(0.0), 1 - F.col("distance"))).orderBy(F.desc("relevance"), "memory_id").limit(k).withColumn("strategy", F.lit("analogical"))


def resolve_seed(mem: DataFrame, cue: Sequence[float] | None, seed_id: str | None = None, text: str | None = None, entity: str | None = None) -> tuple[str, list[float]] | None:
    """(id, associative embedding) of the seed of causal recall: an id, a cue that is an id, or the nearest row."""
    named = seed_id or (text if text and len(text) == 32 and all(x in "0123456789abcdef" for x in text) else None)
    if named:
        row = mem.where(F.col("memory_id") == named).select("memory_id", "entity_id", F.coalesce("assoc_embedding", "embedding").alias("e")).first()
        require(row is None or entity is None or row["entity_id"] == entity, "the seed belongs to another entity")
    else:
        require(cue is not None, "causal recall needs a seed or a cue")
        row = _entity(search_similar(mem, cue, 1 if entity is None else OVERSAMPLE), entity).orderBy("distance", "memory_id").select("memory_id", F.coalesce("assoc_embedding", "embedding").alias("e")).first()
    return None if row is None else (row["memory_id"], row["e"])


def merge_and_rank(hits: Sequence[DataFrame], now_us: int, weights: Weights = Weights(), k: int = 10) -> DataFrame:
    """One row for each memory with its highest relevance and the strategies that found it; of equal contents the most relevant; by score."""
    columns = ["memory_id", "content", "entity_id", "kind", "importance", "created_at", "access_count"]
    union = None
    for h in hits:
        part = h.select(*columns, "relevance", "strategy")
        union = part if union is None else union.unionByName(part)
    require(union is not None, "no strategy")
    one = union.groupBy(*columns).agg(F.max("relevance").alias("relevance"), F.array_sort(F.collect_set("strategy")).alias("strategies"))
    alone = one.withColumn("_r", F.row_number().over(W.partitionBy(F.sha2("content", 256)).orderBy(F.desc("relevance"), "memory_id"))).where("_r = 1").drop("_r")
    return alone.withColumn("score", scoring.composite(F.col("relevance"), now_us, weights)).orderBy(F.desc("score"), "memory_id").limit(k)


@dataclass
class Recall:
    """What recall returns: the ranked rows, the strategies that failed with their reasons, and those with k or more hits."""

    results: DataFrame
    errors: dict[str, str] = field(default_factory=dict)
    parts: dict[str, DataFrame] = field(default_factory=dict)
    k: int = 10

    def truncated(self) -> dict[str, bool]:
        return {name: df.count() >= self.k for name, df in self.parts.items()}


def recall(mem: DataFrame, strategies: Sequence[str], now_us: int, cue: Sequence[float] | Callable[[], Sequence[float]] | None = None, k: int = 10, entity: str | None = None, weights: Weights = Weights(), context: dict | None = None, alpha: float = 0.5, time_range: tuple[int, int] = (0, FOREVER), offsets: dict | None = None, seed_id: str | None = None, edge_types: Sequence[str] | None = None, direction: str = "both", edges: DataFrame | None = None, max_depth: int = 5) -> Recall:
    """Run the strategies and merge. The cue is embedded once; a strategy that fails is named in errors, the others count. Causal recall from
    a seed without embedding walks the edges instead, max_depth hops at most."""
    check_top_k(k)
    require(len(strategies) > 0 and all(s in STRATEGIES for s in strategies), f"strategies {strategies!r}")
    failed = None
    try:
        vector = cue() if callable(cue) else cue
    except Exception as e:  # an embedder may fail in any way; temporal recall needs none
        if "temporal" not in strategies:
            raise
        vector, failed = None, str(e)
    parts, errors = {}, {}
    for s in dict.fromkeys(strategies):
        try:
            if s == "temporal":
                parts[s] = temporal(mem, entity, k, *time_range)
                continue
            require(vector is not None or (s == "causal" and seed_id), failed or f"{s} recall needs a cue")
            if s == "similarity":
                parts[s] = similarity(mem, vector, k, entity)
            elif s == "analogical":
                parts[s] = analogical(mem, vector, context, k, entity, alpha)
            else:
                seed = resolve_seed(mem, vector, seed_id, None, entity)
                if seed and seed[1] is None:
                    require(edges is not None, "the seed has no embedding, and there are no edges to walk")
                    parts[s] = causal_by_edges(mem, graph.traverse(edges, seed[0], max_depth, edge_types), max_depth, k, entity)
                elif seed:
                    parts[s] = causal(mem, seed[1], seed[0], offsets or {}, k, edge_types, direction, entity)
        except ValueError as e:
            errors[s] = str(e)
    require(len(parts) > 0 or len(errors) == 0, "; ".join(f"{s}: {e}" for s, e in errors.items()))
    ranked = merge_and_rank(list(parts.values()), now_us, weights, k) if parts else mem.limit(0)
    return Recall(ranked, errors, parts, k)


def prime(mem: DataFrame, entity: str, cue: Sequence[float], now_us: int, most: int = 20, window_us: int = 7 * DAY_US, weights: Weights = Weights(), scan: int = 500) -> DataFrame:
    """What to load for an entity: its newest rows of the window, oldest first, then by score the rows nearest to the cue among its newest."""
    require(1 <= most <= MAX_PRIME, f"at most {MAX_PRIME} rows")
    half = most // 2
    own = _entity(mem, entity)
    recent = own.where((F.col("created_at") >= now_us - window_us) & (F.col("created_at") < now_us)).orderBy(F.desc("created_at"), F.desc("memory_id")).limit(half)
    oldest = W.orderBy("created_at", "memory_id")  # over half of `most` rows
    first = recent.withColumn("ord", F.row_number().over(oldest)).withColumn("relevance", 1 - (F.col("ord") - 1) / F.count("*").over(W.partitionBy()))
    first = first.withColumn("section", F.lit("temporal"))
    newest = own.orderBy(F.desc("created_at"), F.desc("memory_id")).limit(scan).join(recent.select("memory_id"), "memory_id", "left_anti")
    scored = newest.withColumn("relevance", vec.dot_relevance(F.col("embedding"), list(cue))).withColumn("score", scoring.composite(F.col("relevance"), now_us, weights))
    best = scored.orderBy(F.desc("score"), "memory_id").limit(most - half)
    second = best.withColumn("ord", F.row_number().over(W.orderBy(F.desc("score"), "memory_id"))).drop("score").withColumn("section", F.lit("similarity"))
    return first.unionByName(second)


def across(stores: dict[str, DataFrame], k: int) -> DataFrame:
    """Ranked results of several stores as one list."""
    union = None
    for name, df in stores.items():
        part = df.withColumn("store", F.lit(name))
        union = part if union is None else union.unionByName(part)
    return union.orderBy(F.desc("score"), "store", "memory_id").limit(k)


def prime_across(stores: dict[str, DataFrame], entity: str, cue: Sequence[float], now_us: int, most: int = 20, **how) -> DataFrame:
    """prime() over several stores: each store's rows in its order, the stores in theirs, `most` in all, each content once."""
    union = None
    for n, (name, mem) in enumerate(stores.items()):
        part = prime(mem, entity, cue, now_us, most, **how).withColumn("store", F.lit(name)).withColumn("_n", F.lit(n))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    place = F.struct(F.when(F.col("section") == "temporal", 0).otherwise(1), "ord", "_n", "memory_id")
    first = union.withColumn("_r", F.row_number().over(W.partitionBy(F.sha2("content", 256)).orderBy(place))).where("_r = 1").drop("_r")
    return first.orderBy(place).limit(most).drop("_n")


def contradictions_among(results: DataFrame, edges: DataFrame) -> DataFrame:
    """Unordered pairs of results that a `contradicts` edge joins."""
    ids = results.select("memory_id")
    pairs = edges.where("edge_type = 'contradicts'").join(ids.withColumnRenamed("memory_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("memory_id", "dst"), "dst", "left_semi")
    return pairs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "confidence").groupBy("a", "b").agg(F.max("confidence").alias("confidence"))
