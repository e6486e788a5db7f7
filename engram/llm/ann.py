"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions by random rotations, one a curve, shifted and cut into cells; the Hilbert index of its
cell gives each vector a place on each curve. Spark sorts every curve by range partitions; runs of `block_rows` successive places
are blocks, and a query looks at all blocks within its window around its own place. Candidates of all curves are merged, and reranked by
the exact distance.

The window is a share of the rows, fitted on a bounded sample (`sample_rows` vectors, `sample_queries` of them as queries): the
least share on a fixed ladder at which the sample's recall reaches `target`. In the whole table neighbours are nearer than in a sample, so
the share is on the safe side. Where neighbours are close against the spread of the data, windows are narrow. Where all distances are
nearly alike, as in random directions, no ordering can separate them; once the windows of all curves together hold as many rows as the
table (2 * curves * share >= 1), curves cost more than they save, and the queries, in blocks, are compared with every row: one pass without
a shuffle of the rows for each block of `pass_bytes` of queries. The rule is the same at every size, and never more distances are
computed than there are queries times rows.

Within a block of rows distances are first estimated by a product, after the mean of the queries is subtracted from both sides; all rows whose estimate
may be among the nearest, given its rounding error, are then measured exactly. So vectors far from the origin and any number of
ties lose nothing.

Equal vectors are one item in the index, which keeps the `k + 1` smallest of their ids; so copies, however many, cost nothing and ties
among them go to the smaller ids.

Cases: vectors that are null, empty, zero, of another length than most, or hold a null or non-finite component take no part, neither as
queries nor as candidates; null ids take no part; fewer than k candidates: all of them; empty tables: no rows. A repeated id with
equal vectors is one; with different vectors it is a candidate by its nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.llm._common import forget, map_batches, materialize

CURVES = 4
DIMENSIONS = 6
CELL_BITS = 8
BLOCK_ROWS = 2_048
LANE_QUERIES = 65_536
PASS_BYTES = 16_000_000
PASS_ROWS = 250_000
SAMPLE_ROWS = 8_000
SAMPLE_QUERIES = 200
TARGET = 0.95
LADDER = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0)


def hilbert(cells: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    """Place on the Hilbert curve of rows of non-negative integers below 2**bits; dimensions * bits must be below 64."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    m = 1 << (bits - 1)
    q = m
    while q > 1:  # undo the turns of each level
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = m
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


class Curves:
    """The orderings: rotations, and per curve the shift and width of its cells, from a sample."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, dimensions: int = DIMENSIONS, seed: int = 11):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.maps, self.low, self.width = [], [], []
        for _ in range(curves):
            turned, _ = np.linalg.qr(rng.normal(size=(d, min(d, dimensions))))
            p = sample @ turned
            low, high = p.min(axis=0), p.max(axis=0)
            room = np.maximum(1e-12, high - low)
            self.maps.append(turned)
            self.low.append(low - room * rng.uniform(0.05, 0.5, size=len(low)))
            self.width.append(1.6 * room / (1 << CELL_BITS))

    def places(self, x: np.ndarray) -> list[np.ndarray]:
        top = (1 << CELL_BITS) - 1
        return [hilbert(np.clip((x @ m - lo) / w, 0, top).astype(np.int64)) for m, lo, w in zip(self.maps, self.low, self.width, strict=True)]


def fit_share(sample: np.ndarray, curves: Curves, k: int, queries: int = SAMPLE_QUERIES, target: float = TARGET) -> float:
    """The least share of the ladder, of the rows to each side of a query, at which enough of the true neighbours are in a window."""
    n = len(sample)
    if n <= 2 * k:
        return 1.0
    own = np.linspace(0, n - 1, min(queries, n)).astype(int)
    ranks = []
    for p in curves.places(sample):
        rank = np.empty(n, dtype=np.int64)
        rank[np.argsort(p, kind="stable")] = np.arange(n)
        ranks.append(rank)
    nearest = np.empty((len(own), k))
    for i, q in enumerate(own):
        d = ((sample - sample[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        true = np.argsort(d, kind="stable")[:k]
        nearest[i] = np.min([np.abs(r[true] - r[q]) for r in ranks], axis=0)
    for share in LADDER:
        if (nearest <= share * n).mean() >= target:
            return share
    return 1.0


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of numbers of one length, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Nearest:
    """The `keep` nearest items of each query among all rows shown so far; ties go to the smaller id."""

    def __init__(self, queries: np.ndarray, keep: int):
        self.y, self.keep = queries, keep
        self.mean = queries.mean(axis=0)
        self.centred = queries - self.mean
        self.norms = (self.centred**2).sum(axis=1)
        self.best = np.full(len(queries), np.inf)  # square of a distance beyond which nothing is wanted
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, list]] = []
        self.held = 0

    def show(self, x: np.ndarray, ids: list) -> None:
        first = np.array([i[0] for i in ids], dtype=np.int64)
        ids = np.fromiter(ids, dtype=object, count=len(ids))
        centred = x - self.mean
        norms = (centred**2).sum(axis=1)
        error = 1e-15 * (x.shape[1] + 8) * (norms.max() + self.norms)  # of an estimate
        for at in range(0, len(self.y), 256):
            own = slice(at, at + 256)
            far = norms[None, :] - 2 * self.centred[own] @ centred.T + self.norms[own][:, None]
            bar = self.best[own]
            if len(x) > self.keep:
                bar = np.minimum(bar, np.partition(far, self.keep - 1, axis=1)[:, self.keep - 1])
            q, r = np.nonzero(far <= (bar + 4 * error[own])[:, None])
            exact = np.sqrt(((x[r] - self.y[own][q]) ** 2).sum(axis=1))
            self._add(q + at, exact, first[r], ids[r])
        if self.held > 4 * self.keep * len(self.y) + 100_000:
            self._trim()

    def _add(self, q: np.ndarray, exact: np.ndarray, first: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((q, exact, first, ids))
        self.held += len(q)

    def _trim(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        q, exact, first, ids = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        order = np.lexsort((first, exact, q))
        start = np.searchsorted(q[order], np.arange(len(self.y)))
        order = order[np.arange(len(order)) - start[q[order]] < self.keep]
        part = q[order], exact[order], first[order], ids[order]
        self.parts, self.held = [part], len(order)
        full = np.bincount(part[0], minlength=len(self.y)) == self.keep
        last = np.searchsorted(part[0], np.arange(len(self.y)), side="right") - 1
        self.best[full] = part[1][last[full]] ** 2 * (1 + 1e-12)
        return part

    def rows(self, names: list) -> dict[str, pa.Array]:
        q, exact, _, ids = self._trim() if self.parts else (np.zeros(0, dtype=int), np.zeros(0), None, [])
        return {"query": pa.array([names[i] for i in q.tolist()], pa.int64()), "ids": pa.array(list(ids), pa.list_(pa.int64())), "score": pa.array(exact, pa.float64())}


_FOUND = "query long, ids array<long>, score double"


def _all_rows(items: DataFrame, n: int, width: int, k: int, pass_bytes: int) -> DataFrame:
    """Every query against every item, a block of queries at a time."""
    spark = items.sparkSession
    asked = items.where("q").select("item", "v")
    blocks = max(1, -(-asked.count() // max(1, pass_bytes // (8 * width))))
    numbered = materialize(asked.withColumn("block", F.pmod(F.xxhash64("item", F.lit(5)), F.lit(blocks)).cast("int")), "asked")
    candidates = items.select("v", "ids").coalesce(max(spark.sparkContext.defaultParallelism, -(-n // PASS_ROWS)))

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, y = shared.value
            best = Nearest(y, k + 1)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(at, BLOCK_ROWS)
                    best.show(matrix(part.column(0)), part.column(1).to_pylist())
            out = best.rows(names)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

        return run

    found = []
    for b in range(blocks):
        rows = numbered.where(F.col("block") == b).toArrow()  # pass_bytes of vectors on average, and not much more
        if rows.num_rows:
            shared = spark.sparkContext.broadcast((rows["item"].to_pylist(), matrix(rows["v"])))
            found.append(materialize(candidates.mapInArrow(scan(shared), _FOUND), "pass"))
    return reduce(DataFrame.unionByName, found)


def _by_curves(items: DataFrame, n: int, order: Curves, k: int, curves: int, block_rows: int, share: float) -> DataFrame:
    """Queries against the items in their windows on each curve."""

    def make():
        def step(batch):
            both = np.stack(order.places(matrix(batch.column(1))), axis=1)
            return {"item": batch.column(0), "places": pa.array(both.tolist(), pa.list_(pa.int64()))}

        return step

    placed = materialize(map_batches(items.select("item", "v"), make, "item long, places array<long>").select("item", F.posexplode("places").alias("curve", "place")), "places")
    # the rank on each curve: range partitions, their sizes, and the count within
    parts = max(1, -(-n * curves // 200_000))
    ranged = materialize(placed.repartitionByRange(parts, "curve", "place", "item").withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("curve", "part").count()
    offset = counts.select("curve", "part", F.coalesce(F.sum("count").over(W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("part", "curve").orderBy("place", "item")) - 1
    ranked = ranged.withColumn("inside", inside).join(offset, ["curve", "part"]).select("item", "curve", (F.col("before") + F.col("inside")).alias("rank"))
    full = materialize(items.join(ranked, "item").select("item", "curve", "rank", "v", "ids", "q"), "ranked")
    forget(placed, ranged)
    blocks, reach = -(-n // block_rows), int(np.ceil(share * n))
    block = lambda r: F.least(F.lit(blocks - 1), F.greatest(F.lit(0), F.floor(r / block_rows))).cast("int")
    # a task holds one block and one lane of the queries that look at it, so that neither side grows with the table
    lanes = max(1, -(-int(items.where("q").count() * min(1.0, 2 * share)) // LANE_QUERIES))
    cand = full.select("curve", block(F.col("rank")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "v", "ids")
    spread = F.sequence(block(F.col("rank") - reach), block(F.col("rank") + reach))
    asked = full.where("q").select("curve", F.explode(spread).alias("block"), F.pmod(F.xxhash64("item", F.lit(3)), F.lit(lanes)).cast("int").alias("lane"), "item", "v")

    def scan(c: pa.Table, q: pa.Table) -> pa.Table:
        if not c.num_rows or not q.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        best = Nearest(matrix(q["v"]), k + 1)
        best.show(matrix(c["v"]), c["ids"].to_pylist())
        return pa.table(best.rows(q["item"].to_pylist()))

    return cand.groupBy("curve", "block", "lane").cogroup(asked.groupBy("curve", "block", "lane")).applyInArrow(scan, _FOUND)


def search(df: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 10, curves: int = CURVES, block_rows: int = BLOCK_ROWS, share: float | None = None, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """For each row of df for which is_query holds its k nearest other rows: query_id, rank, vec_id, score (Euclidean distance)."""
    spark = df.sparkSession
    vec = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(vec))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    d = sizes[0]["d"]
    # equal vectors are one item, named by a hash of the components (0.0 and -0.0 alike)
    rows = rows.where(F.size("v") == d).withColumn("v", F.transform("v", lambda x: x + 0.0)).withColumn("h", F.struct(F.xxhash64("v"), F.hash("v")))
    rows = rows.select("id", "q", "v", F.col("h.col1").alias("h1"), F.col("h.col2").alias("h2"))
    ids = rows.select("h1", "h2", "id").distinct().withColumn("r", F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= k + 1)
    members = ids.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    vectors = rows.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.max("q").alias("q"))
    items = materialize(vectors.join(members, ["h1", "h2"]).withColumn("item", F.xxhash64("h1", "h2")), "items")
    if not items.where("q").limit(1).count():
        return empty
    n = items.count()
    sample = matrix(items.orderBy("item").select("v").limit(SAMPLE_ROWS).toArrow()["v"])
    order = Curves(sample, curves)
    share = fit_share(sample, order, k) if share is None else share
    if 2 * curves * share >= 1.0:
        pairs = _all_rows(items, n, d, k, pass_bytes)
    else:
        pairs = _by_curves(items, n, order, k, curves, block_rows, share)
    by_id = pairs.select("query", "score", F.explode("ids").alias("id")).groupBy("query", "id").agg(F.min("score").alias("score"))
    best = by_id.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("score", "id"))).where(F.col("r") <= k + 1).select("query", "id", "score")
    found = materialize(best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("found")), "found")
    asking = materialize(rows.where("q").select("id", F.xxhash64("h1", "h2").alias("query")).distinct(), "queries")
    lists = asking.join(found, "query").select(F.col("id").alias("query_id"), F.slice(F.filter("found", lambda f: f["id"] != F.col("id")), 1, k).alias("found"))
    return lists.select("query_id", F.posexplode("found").alias("pos", "f")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.score").alias("score"))
