"""A store of tables in versions, and the facade that most callers use.

A table is a list of folders of Parquet files, its parts, that are never changed. A commit writes new parts, each into a folder of its own
name that no other attempt shares, and then one small manifest named by the next version, by a rename that fails if the name is taken:
readers see all of a commit or nothing, and of two writers one loses without touching what the other wrote. A commit that only appends
parts does not depend on what others did, and is put on top of theirs instead. Paths go through Hadoop's file systems, so a store
may be on any of them.

Every tenant has tables of its own, so no commit reads or writes another tenant's rows. New memories, tombstones and accesses are
appended; accesses are summed up when memories are read, and become part of them at the next rewrite (revise, forget, sweep, compact).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import embed, schema
from engram.functions.scoring import Weights
from engram.operators import access, graph, lifecycle, reflect, reports, retrieve
from engram.streaming import subscribe

RETRIES = 20
ACCESSES = "memory_id string, last_accessed_at long, n long"
OFFSETS = "edge_type string, offset array<double>"
POLICIES = "max_snapshots int, auto_forget_below double, half_life_us long"


class Conflict(RuntimeError):
    """Another writer has committed since this one read."""


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return 0
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return max([int(n) for n in names if n.isdigit()], default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """The parts of every table, as folders below the root, in the order of their commits."""
        v = self.version() if version is None else version
        if not v:
            return {}
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/_commits/{v}").first()[0])

    def parts(self, name: str, version: int | None = None) -> list[DataFrame]:
        return [self.spark.read.parquet(f"{self.root}/{p}") for p in self.manifest(version).get(name, [])]

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        found = self.manifest(version).get(name)
        return self.spark.read.parquet(*(f"{self.root}/{p}" for p in found)) if found else None

    def _write(self, name: str, df: DataFrame) -> str:
        part = f"data/{name}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{part}")
        return part

    def commit(self, tables: dict[str, DataFrame | None], base: int, append: dict[str, DataFrame] | None = None) -> int:
        """Put the tables (None: empty) and the appended parts as the version after base. Without tables, as the version after the newest."""
        new = {name: [] if df is None else [self._write(name, df)] for name, df in tables.items()}
        more = {name: self._write(name, df) for name, df in (append or {}).items()}
        for attempt in range(RETRIES):
            held = self.manifest(base) | new
            for name, part in more.items():
                held[name] = [*held.get(name, []), part]
            if self._publish(base + 1, held):
                return base + 1
            if tables or attempt == RETRIES - 1:
                raise Conflict(f"version {base + 1} exists")
            base = self.version()
        return base

    def _publish(self, version: int, held: dict[str, list[str]]) -> bool:
        self._fs.mkdirs(self._path(f"{self.root}/_commits"))
        draft, target = self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}"), self._path(f"{self.root}/_commits/{version}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(held, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            return False
        return True

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete parts that none of the newest `keep` versions names. What a writer is writing now has no version yet: none may run."""
        now = self.version()
        used = {p for k in range(max(1, now - keep + 1), now + 1) for found in self.manifest(k).values() for p in found}
        gone, top = [], self._path(f"{self.root}/data")
        for table in self._fs.listStatus(top) if self._fs.exists(top) else ():
            for part in self._fs.listStatus(table.getPath()):
                name = f"data/{table.getPath().getName()}/{part.getPath().getName()}"
                if name not in used:
                    self._fs.delete(part.getPath(), True)
                    gone.append(name)
        return sorted(gone)


class MemoryTables:
    """A TableStore's interface over rows held by the driver: for tests and small stores that need no files."""

    def __init__(self, spark: SparkSession):
        self.spark, self._parts = spark, {}
        self._versions: list[dict[str, list[str]]] = [{}]

    def version(self) -> int:
        return len(self._versions) - 1

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        return self._versions[self.version() if version is None else version]

    def parts(self, name: str, version: int | None = None) -> list[DataFrame]:
        return [self.spark.createDataFrame(*self._parts[p]) for p in self.manifest(version).get(name, [])]

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        found = self.parts(name, version)
        return reduce(DataFrame.unionByName, found) if found else None

    def _hold(self, df: DataFrame) -> str:
        part = uuid.uuid4().hex
        self._parts[part] = (df.collect(), df.schema)
        return part

    def commit(self, tables: dict[str, DataFrame | None], base: int, append: dict[str, DataFrame] | None = None) -> int:
        new = {name: [] if df is None else [self._hold(df)] for name, df in tables.items()}
        more = {name: self._hold(df) for name, df in (append or {}).items()}
        if tables and base != self.version():
            raise Conflict(f"version {base + 1} exists")
        held = self.manifest() | new
        for name, part in more.items():
            held[name] = [*held.get(name, []), part]
        self._versions.append(held)
        return self.version()

    def vacuum(self, keep: int = 2) -> list[str]:
        used = {p for held in self._versions[-max(1, keep) :] for found in held.values() for p in found}
        gone = sorted(set(self._parts) - used)
        for p in gone:
            del self._parts[p]
        return gone


class HashEmbedder:
    """The default of a store without a model: hashes, in Spark."""

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def of(self, spark: SparkSession, text: str) -> list[float]:
        return list(spark.range(1).select(embed.hash_embedding(F.lit(text), self.dimensions).alias("e")).first()["e"])


class MemoryStore:
    """remember, get, recall, prime, revise, forget, sweep, reflect, subscribe, insights and count over a TableStore, for one tenant."""

    def __init__(self, spark: SparkSession, root: str | MemoryTables, tenant: str = "default", embedder: HashEmbedder | None = None):
        self.spark, self.tenant = spark, schema.check_tenant(tenant)
        self.tables = TableStore(spark, root) if isinstance(root, str) else root
        self.embedder = embedder or HashEmbedder(64)

    @classmethod
    def open(cls, spark: SparkSession, root: str | MemoryTables, tenant: str = "default") -> MemoryStore:
        return cls(spark, root, tenant)

    def _name(self, table: str) -> str:
        return f"{table}@{self.tenant}"

    def _read(self, table: str, empty: object) -> DataFrame:
        df = self.tables.read(self._name(table))
        return self.spark.createDataFrame([], empty) if df is None else df

    def memories(self) -> DataFrame:
        """The rows, with the accesses since they were written."""
        rows, seen = self._read("memories", schema.MEMORIES), self.tables.read(self._name("accesses"))
        if seen is None:
            return rows
        sums = seen.groupBy("memory_id").agg(F.max("last_accessed_at").alias("_last"), F.sum("n").alias("_n"))
        new = {"last_accessed_at": F.greatest("last_accessed_at", "_last"), "access_count": F.col("access_count") + F.coalesce("_n", F.lit(0))}
        return rows.join(sums, "memory_id", "left").select(*(new[c].alias(c) if c in new else F.col(c) for c in rows.columns))

    def edges(self) -> DataFrame:
        """The edges; of several parts the last written of equal ones."""
        parts = self.tables.parts(self._name("edges"))
        if len(parts) < 2:
            return parts[0] if parts else self.spark.createDataFrame([], schema.EDGES)
        union = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
        last = W.partitionBy("src", "edge_type", "dst").orderBy(F.desc("_part"), F.desc("ts_us"))
        return union.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_part")

    def tombstones(self) -> DataFrame:
        return self._read("tombstones", schema.TOMBSTONES)

    def offsets(self) -> dict[str, list[float]]:
        """The learned direction of each edge type."""
        return {r["edge_type"]: r["offset"] for r in self._read("offsets", OFFSETS).collect()}

    def _rewrite(self, base: int, memories: DataFrame | None = None, edges: DataFrame | None = None, append: dict[str, DataFrame] | None = None, **other: DataFrame) -> int:
        tables = {self._name(k): v for k, v in other.items()}
        if memories is not None:
            tables |= {self._name("memories"): memories.withColumn("tenant_id", F.lit(self.tenant)), self._name("accesses"): None}
        if edges is not None:
            tables[self._name("edges")] = edges.withColumn("tenant_id", F.lit(self.tenant))
        return self.tables.commit(tables, base, {self._name(k): v for k, v in (append or {}).items()})

    def remember(self, rows: Sequence[dict] | DataFrame, now_us: int, edges: Sequence[tuple[str, str, str, float]] = ()) -> DataFrame:
        """Append rows, and edges (src, dst, type, confidence), whose types' offsets learn from them in their order."""
        base = self.tables.version()
        new = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(list(rows))
        if "embedding" not in new.columns:
            new = new.withColumn("embedding", embed.hash_embedding(F.col("content"), self.embedder.dimensions))
        added = {"memories": lifecycle.remember(self.spark.createDataFrame([], schema.MEMORIES), new, now_us, self.tenant)}
        if edges:
            added["edges"] = self.spark.createDataFrame([(self.tenant, s, d, t, float(c), now_us) for s, d, t, c in edges], schema.EDGES)
        self.tables.commit({}, base, {self._name(k): v for k, v in added.items()})
        if edges:
            self._learn([(s, d, t) for s, d, t, _ in edges])
        return self.memories().where(F.col("created_at") == now_us)

    def _learn(self, edges: Sequence[tuple[str, str, str]]) -> None:
        """Fold new edges into the offsets; a writer that comes second folds into what the first left."""
        df = self.spark.createDataFrame([(s, d, t, i) for i, (s, d, t) in enumerate(edges)], "src string, dst string, edge_type string, ts_us long")
        for attempt in range(RETRIES):
            base = self.tables.version()
            held = self.offsets()
            learnt = held | graph.learn_offsets(df, self._read("memories", schema.MEMORIES), start=held)
            try:
                self._rewrite(base, offsets=self.spark.createDataFrame(sorted(learnt.items()), OFFSETS))
                return
            except Conflict:
                if attempt == RETRIES - 1:
                    raise

    def get(self, memory_id: str) -> DataFrame:
        return access.get(self.memories(), memory_id)

    def count(self) -> int:
        return self._read("memories", schema.MEMORIES).count()

    def recall(self, cue: str, now_us: int, strategies: Sequence[str] = ("similarity",), k: int = 10, entity: str | None = None, weights: Weights = Weights(), reinforce: bool = True, **more) -> list:
        vector = self.embedder.of(self.spark, cue)
        if "causal" in strategies:
            more = {"offsets": self.offsets(), "edges": self.edges()} | more
        found = retrieve.recall(self.memories(), strategies, now_us, vector, k, entity, weights, **more)
        rows = found.results.collect()  # k rows, before they are reinforced
        if reinforce and rows:
            hits = self.spark.createDataFrame([(r["memory_id"], now_us, 1) for r in rows], ACCESSES)
            self._rewrite(self.tables.version(), append={"accesses": hits.coalesce(1)})
        return rows

    def prime(self, entity: str, now_us: int, cue: str | None = None, **more) -> list:
        vector = self.embedder.of(self.spark, cue or entity)
        return retrieve.prime(self.memories(), entity, vector, now_us, **more).collect()

    def revise(self, memory_id: str, now_us: int, replace_context: bool = False, **changes) -> None:
        """Change a row, keep what it was as a snapshot, and of its snapshots as many as the policy says."""
        base = self.tables.version()
        df = self.spark.createDataFrame([(memory_id, *changes.values())], "memory_id string, " + ", ".join(f"{k} {'double' if k == 'importance' else 'string'}" for k in changes))
        if "content" in changes:
            df = df.withColumn("embedding", embed.hash_embedding(F.col("content"), self.embedder.dimensions))
        mem, links = lifecycle.revise(self.memories(), self.edges(), df, now_us, replace_context)
        surplus = lifecycle.surplus_snapshots(links, self.policy().max_snapshots).select(F.col("snapshot").alias("memory_id"))
        self._rewrite(base, mem.join(surplus, "memory_id", "left_anti").select(*mem.columns), graph.drop_edges_of(links, surplus))

    def forget(self, now_us: int, **criteria) -> int:
        base = self.tables.version()
        return self._forgotten(base, lifecycle.forget(self.memories(), self.edges(), lifecycle.Criteria(**criteria), now_us))

    def _forgotten(self, base: int, gone: lifecycle.Forgotten) -> int:
        version = self._rewrite(base, gone.memories, gone.edges, append={"tombstones": gone.tombstones})
        return self.tables.parts(self._name("tombstones"), version)[-1].count()

    def sweep(self, now_us: int, policy: lifecycle.Policy | None = None) -> None:
        """Write decay scores anew, by the stored policy unless another is given."""
        base = self.tables.version()
        self._rewrite(base, lifecycle.apply_sweep(self.memories(), now_us, (policy or self.policy()).half_life_us))

    def auto_forget(self, now_us: int, policy: lifecycle.Policy | None = None) -> int:
        """Forget what has decayed below the policy's bar; the number of rows."""
        base, p = self.tables.version(), policy or self.policy()
        mem = self.memories()
        return self._forgotten(base, lifecycle.auto_forget(mem, self.edges(), lifecycle.decay_sweep(mem, now_us, p.half_life_us, below=p.auto_forget_below), now_us))

    def insights(self, **filters) -> DataFrame:
        return reports.insights(self.memories(), **filters)

    def reflect(self, now_us: int, provider, entity: str | None = None) -> int:
        """Consolidate a scope (500 rows at most) into insights by a provider, and store them; their number."""
        rows = [(r["memory_id"], r["content"], r["embedding"]) for r in reflect.scope(self.memories(), entity=entity).collect()]
        found = reflect.propose(rows, provider, [r["content"] for r in self.insights(entity=entity).select("content").collect()])
        if found:
            new, links = reflect.insight_rows(self.memories(), found, now_us, entity)
            df = new.withColumn("embedding", embed.hash_embedding(F.col("content"), self.embedder.dimensions))
            added = lifecycle.remember(self.spark.createDataFrame([], schema.MEMORIES), df, now_us, self.tenant)
            self._rewrite(self.tables.version(), append={"memories": added, "edges": links.withColumn("tenant_id", F.lit(self.tenant))})
        return len(found)

    def subscribe(self, chunks: DataFrame, entity: str | None = None, **how) -> DataFrame:
        """The memories that chunks of text (chunk_id, chunk) call up: three stages, see streaming.subscribe."""
        mem = self.memories() if entity is None else self.memories().where(F.col("entity_id") == entity)
        asked = chunks if "embedding" in chunks.columns else chunks.withColumn("embedding", embed.hash_embedding(F.col("chunk"), self.embedder.dimensions))
        return subscribe.matches(asked, mem, subscribe.scope_keywords(mem), subscribe.centroid(mem), **how)

    def set_policy(self, policy: lifecycle.Policy) -> None:
        self._rewrite(self.tables.version(), policies=self.spark.createDataFrame([(policy.max_snapshots, policy.auto_forget_below, policy.half_life_us)], POLICIES))

    def policy(self) -> lifecycle.Policy:
        r = self._read("policies", POLICIES).first()
        return lifecycle.Policy() if r is None else lifecycle.Policy(r["max_snapshots"], r["auto_forget_below"], r["half_life_us"])

    def compact(self) -> None:
        """Rewrite memories and edges as one part each, with the accesses."""
        self._rewrite(self.tables.version(), self.memories(), self.edges())
