"""Typed directed edges: neighbourhoods, traversal, learned offsets, similarity graphs, clusters and a projection."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.functions import vec
from engram.operators import exact, querylog
from engram.schema import EDGE_TYPES, MAX_DEPTH, require

LEARNING_RATE = 0.1


def outgoing(edges: DataFrame, memory_id: str, types: Sequence[str] | None = None) -> DataFrame:
    found = edges.where(F.col("src") == memory_id)
    return found if types is None else found.where(F.col("edge_type").isin(list(types)))


def incoming(edges: DataFrame, memory_id: str, types: Sequence[str] | None = None) -> DataFrame:
    found = edges.where(F.col("dst") == memory_id)
    return found if types is None else found.where(F.col("edge_type").isin(list(types)))


def both_directions(edges: DataFrame, memory_id: str) -> DataFrame:
    part = lambda df, other, name: df.select(F.lit(name).alias("direction"), "edge_type", F.col(other).alias("other"), "confidence", "ts_us")
    return part(outgoing(edges, memory_id), "dst", "outgoing").unionByName(part(incoming(edges, memory_id), "src", "incoming"))


def add_edge(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert on (src, edge_type, dst): the last written wins."""
    both = edges.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = W.partitionBy("src", "edge_type", "dst").orderBy(F.desc("_new"), F.desc("ts_us"))
    return both.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_new")


def drop_edges_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that touch none of the ids (memory_id)."""
    return edges.join(ids.select(F.col("memory_id").alias("src")), "src", "left_anti").join(ids.select(F.col("memory_id").alias("dst")), "dst", "left_anti").select(*edges.columns)


def traverse(edges: DataFrame, seed: str, depth: int, types: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    """(memory_id, depth) of what directed edges reach from the seed, which is left out; the least depth counts, then the id."""
    require(1 <= depth <= MAX_DEPTH, f"depth must be within 1..{MAX_DEPTH}")
    use = edges if types is None else edges.where(F.col("edge_type").isin(list(types)))
    hops = use.select(F.col("src").alias("memory_id"), "dst")
    spark = edges.sparkSession
    seen = spark.createDataFrame([(seed, 0)], "memory_id string, depth int")
    front = seen
    for d in range(1, depth + 1):
        # only the frontier's edges are read into the join; what was seen before is taken off
        step = hops.join(front.select("memory_id"), "memory_id").select(F.col("dst").alias("memory_id")).distinct().join(seen, "memory_id", "left_anti").withColumn("depth", F.lit(d))
        front = exact.cut(step)  # each hop reads the written fronts, so plans do not grow with the depth
        seen = seen.unionByName(front)
    out = seen.where("depth > 0")
    return out if most is None else out.orderBy("depth", "memory_id").limit(most)


def subgraph(mem: DataFrame, edges: DataFrame, seed: str, depth: int = 2, nodes: int = 100) -> tuple[DataFrame, DataFrame]:
    """Nodes within the depth, the seed first, and the edges between them."""
    require(1 <= depth <= 5 and 1 <= nodes <= 500, "depth within 1..5, nodes within 1..500")
    ids = traverse(edges, seed, depth, most=nodes - 1).unionByName(edges.sparkSession.createDataFrame([(seed, 0)], "memory_id string, depth int"))
    between = edges.join(ids.select(F.col("memory_id").alias("src")), "src", "left_semi").join(ids.select(F.col("memory_id").alias("dst")), "dst", "left_semi")
    return mem.join(F.broadcast(ids), "memory_id"), between


def learn_offsets(edges: DataFrame, mem: DataFrame, rate: float = LEARNING_RATE, start: dict[str, list[float]] | None = None) -> dict[str, list[float]]:
    """For each edge type the running direction from source to destination, o = unit(o + rate * (dst - src)), in the order of ts_us, src, dst,
    from the directions of start on. A store folds new edges only, and keeps the result.

    The fold depends on the order, so each type is folded by one task over a stream of sorted differences: nine types at most, and a
    task holds one batch at a time."""
    e = mem.select("memory_id", "assoc_embedding")
    diffs = edges.where(F.col("edge_type").isin(list(EDGE_TYPES))).join(e.select(F.col("memory_id").alias("src"), F.col("assoc_embedding").alias("_a")), "src").join(e.select(F.col("memory_id").alias("dst"), F.col("assoc_embedding").alias("_b")), "dst").select("edge_type", "ts_us", "src", "dst", vec.sub(F.col("_b"), F.col("_a")).alias("diff"))

    def fold(batches):
        import pyarrow as pa

        state: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, d in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                o = state.get(t, np.array((start or {}).get(t, 0.0))) + rate * np.array(d)
                n = np.linalg.norm(o)
                state[t] = o / n if n > 0 else o
        yield pa.RecordBatch.from_arrays([pa.array(list(state), pa.string()), pa.array([v.tolist() for v in state.values()], pa.list_(pa.float64()))], names=["edge_type", "offset"])

    folded = diffs.repartition("edge_type").sortWithinPartitions("edge_type", "ts_us", "src", "dst").mapInArrow(fold, "edge_type string, offset array<double>")
    return {r["edge_type"]: r["offset"] for r in folded.collect()}


def knn(items: DataFrame, id_col: str, vector_col: str, k: int, block: int | None = None) -> DataFrame:
    """(id, neighbour, distance): the k nearest others of every item, exactly (exact.nearest). Equal vectors are compared once; where all differ, the
    products are quadratic, in tasks of bounded memory."""
    return exact.nearest(items.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), None, k, block)


def similarity_graph(neighbours: DataFrame, edges: DataFrame, least: float = 0.5) -> DataFrame:
    """Unordered pairs (a, b, kind, weight): similar neighbours first, stored edges where no similarity stands."""
    near = neighbours.withColumn("weight", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("distance") / 2))).where(F.col("weight") > least)
    pairs = near.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), F.lit("similarity").alias("kind"), "weight", F.lit(0).alias("_p"))
    stored = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("edge_type").alias("kind"), F.col("confidence").alias("weight"), F.lit(1).alias("_p"))
    first = W.partitionBy("a", "b").orderBy("_p", F.desc("weight"), "kind")
    return pairs.unionByName(stored).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_p")


def connected(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root): the smallest id that undirected pairs (a, b) reach, by minimum labels with pointer jumping, until nothing moves."""
    both = exact.cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = exact.cut(nodes.select("id", F.col("id").alias("root")))
    while True:
        heard = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("low"))
        told = labels.join(heard, "id", "left").select("id", "root", F.least("root", F.coalesce("low", "root")).alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("root").alias("lower"))
        new = exact.cut(told.join(jump, "low", "left").select("id", F.least("low", F.coalesce("lower", "low")).alias("root"), (F.least("low", F.coalesce("lower", "low")) < F.col("root")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        labels = new.select("id", "root")
        if not moved:
            return labels


def cluster_by_distance(neighbours: DataFrame, nodes: DataFrame, share: float = 0.65, least: int = 3) -> DataFrame:
    """(id, cluster): components over the edges that are not longer than the distance at `share` of their order; components
    of fewer than `least` are -1, the others are numbered by their smallest id."""
    edges = neighbours.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), "distance").groupBy("a", "b").agg(F.min(F.round(F.col("distance") * 10**9)).cast("long").alias("place"))
    edges = exact.cut(edges)  # neighbours are found once
    n = edges.count()
    bar = querylog.percentile(edges, "place", share, first=math.ceil(n * share) - int(n * share))
    kept = edges.where(F.col("place") <= bar) if n else edges.limit(0)
    rooted = connected(kept, nodes)
    sizes = rooted.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    numbered = sizes.withColumn("cluster", F.dense_rank().over(W.orderBy("root")) - 1)  # one row for each cluster of the view
    return rooted.join(numbered, "root", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def project_2d(vectors: np.ndarray, epochs: int = 200, neighbours: int = 15, seed: int = 42, scale: float = 200.0) -> np.ndarray:
    """A layout of one view's vectors in the plane: a fuzzy neighbour graph, then attraction along it and sampled repulsion."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    if n < 3:
        return np.zeros((n, 2)) if n < 2 else np.array([[-scale, 0.0], [scale, 0.0]])
    k = min(neighbours, n - 1)
    d = 1 - vectors @ vectors.T
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, axis=1)
    spread = np.maximum(1e-9, (dist - dist[:, :1]).mean(axis=1, keepdims=True))
    weight = np.zeros((n, n))
    np.put_along_axis(weight, near, np.exp(-(dist - dist[:, :1]) / spread), axis=1)
    weight = weight + weight.T - weight * weight.T
    y = rng.normal(scale=1.0, size=(n, 2))
    i, j = np.nonzero(weight)
    w = weight[i, j][:, None]
    for epoch in range(epochs):
        rate = 0.1 * (1 - epoch / epochs)
        delta = y[i] - y[j]
        pull = w * delta / (1 + (delta**2).sum(axis=1, keepdims=True))
        np.add.at(y, i, -rate * pull)
        other = rng.integers(0, n, size=(n, 5))
        away = y[:, None, :] - y[other]
        y += rate * (away / (0.1 + (away**2).sum(axis=2, keepdims=True)) ** 2).clip(-4, 4).mean(axis=1)
    y -= y.mean(axis=0)
    return y / max(1e-9, np.abs(y).max()) * scale


def with_pins(layout: DataFrame, pins: DataFrame) -> DataFrame:
    """Coordinates (id, x, y), with pinned ones in their place."""
    p = pins.select("id", F.col("x").alias("_px"), F.col("y").alias("_py"))
    return layout.join(p, "id", "left").select("id", F.coalesce("_px", "x").alias("x"), F.coalesce("_py", "y").alias("y"), F.col("_px").isNotNull().alias("pinned"))
