"""Registered queries over the supplied tables, with equivalent SQL for DuckDB. Columns of a pair have the same names."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram import embed
from engram.functions import scoring, text, vec
from engram.operators import access, contradict, graph, ingest, lifecycle, querylog, reflect, reports, retrieve
from engram.schema import MEMORIES
from engram.sources import fixtures
from engram.sources.fixtures import NOW_US, SQL_ALL, SQL_D, SQL_E, SQL_M, SQL_Q, SQL_V
from engram.streaming import subscribe

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
USER, CUE, ALL_TIME = "user_7", 7, (0, 1 << 62)
DAY = 86_400_000_000
SEED = 4321


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def six(c: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def mem(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.memories(spark, d)


def mev(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.memories(spark, d, vectors=True)


def key(event_id: int) -> str:
    return format(event_id + 1, "032x")


# SQL fragments
_CUE = f"(select cast(embedding as double[]) from embeddings where vec_id = {CUE})"
_NORM = "list_transform({x}, lambda z: z / sqrt(list_dot_product({x}, {x})))"


def _composite(rel: str) -> str:
    return (
        f"(0.5::double * least(1.0::double, greatest(0.0::double, {rel})) + 0.2::double * case when created_at >= {NOW_US} then 1.0::double else least(1.0::double, greatest(0.0::double, 1 - ({NOW_US} - created_at) / 2592000000000.0::double)) end"
        " + 0.2::double * least(1.0::double, greatest(0.0::double, importance)) + 0.1::double * least(1.0::double, log2(1 + access_count) / log2(101)))"
    )


_DECAY = f"(case when importance <= 0 then 0.0::double else importance * pow(2.0::double, -(greatest(0, {NOW_US} - last_accessed_at) / 2592000000000.0::double)) * (1 + log2(1 + least(access_count, 100)) / log2(101)) end)"
_DIST = f"1 - list_dot_product(embedding, {_CUE})"


# ---- recall


@query(f"with {SQL_V}, h as (select *, {_DIST} as dist from v order by dist, memory_id limit 10) select memory_id, content, round(greatest(0.0::double, 1 - dist), 6) as relevance, round({_composite('1 - dist')}, 6) as score from h")
def recall_similarity(spark, d):
    hits = retrieve.similarity(mev(spark, d), fixtures.vector(spark, d, CUE), 10)
    return hits.select("memory_id", "content", six("relevance"), six(scoring.composite(F.col("relevance"), NOW_US), "score"))


@query(f"with {SQL_V} select memory_id, round(greatest(0.0::double, 1 - dist), 6) as relevance from (select *, {_DIST} as dist from v where entity_id = '{USER}' order by dist, memory_id limit 10)")
def recall_similarity_entity(spark, d):
    return retrieve.similarity(mev(spark, d), fixtures.vector(spark, d, CUE), 10, USER).select("memory_id", six("relevance"))


@query(f"with {SQL_V}, n as (select *, {_DIST} as dist from v order by dist, memory_id limit 400) select memory_id, round(greatest(0.0::double, 1 - dist), 6) as relevance from n where entity_id = '{USER}' order by dist, memory_id limit 100")
def recall_similarity_oversample(spark, d):
    return retrieve.similarity(mev(spark, d), fixtures.vector(spark, d, CUE), 100, USER, prefilter=False).select("memory_id", six("relevance"))


@query(f"with {SQL_M}, h as (select * from m where entity_id = '{USER}' order by created_at desc, memory_id desc limit 20) select memory_id, round(1 - (row_number() over (order by created_at desc, memory_id desc) - 1) / (count(*) over ())::double, 6) as relevance from h")
def recall_temporal(spark, d):
    return retrieve.temporal(mem(spark, d), USER, 20).select("memory_id", six("relevance"))


@query(f"with {SQL_M}, h as (select * from m where entity_id = '{USER}' and created_at >= {NOW_US - 20 * DAY} and created_at < {NOW_US - 5 * DAY} order by created_at desc, memory_id desc limit 50) select memory_id, created_at, round(1 - (row_number() over (order by created_at desc, memory_id desc) - 1) / (count(*) over ())::double, 6) as relevance from h")
def recall_temporal_range(spark, d):
    return retrieve.temporal(mem(spark, d), USER, 50, NOW_US - 20 * DAY, NOW_US - 5 * DAY).select("memory_id", "created_at", six("relevance"))


_STRUCT = "(0.4::double * (1.0::double / 2) + 0.3::double * 1.0::double + 0.2::double * case when kind = 'episode' then 1.0::double else 0.0::double end + 0.1::double * case when entity_id is null then 0.5::double else 0.0::double end)"


@query(f"with {SQL_V}, n as (select *, {_DIST} as dist from v order by dist, memory_id limit 75), s as (select *, greatest(0.0::double, 1 - dist) as es, {_STRUCT} as st from n) select memory_id, round(es, 6) as embedding_similarity, round(st, 6) as structural_similarity, round(0.5::double * es + 0.5::double * st, 6) as relevance from s order by 0.5::double * es + 0.5::double * st desc, memory_id limit 25")
def recall_analogical(spark, d):
    hits = retrieve.analogical(mev(spark, d), fixtures.vector(spark, d, CUE), {"k": 1, "kind": "episode"}, 25)
    return hits.select("memory_id", six("embedding_similarity"), six("structural_similarity"), six("relevance"))


_E = lambda i: f"(select cast(embedding as double[]) from embeddings where vec_id = {i})"


@query(
    f"with {SQL_V}, t0 as (select list_transform(list_zip({_E(11)}, {_E(10)}), lambda p: p[1] - p[2]) as x), t1 as (select list_transform(list_zip({_E(12)}, {_NORM.format(x='x')}), lambda p: p[1] + p[2]) as x from t0), t as (select {_NORM.format(x='x')} as x from t1) "
    "select memory_id, round(greatest(0.0::double, list_dot_product(embedding, t.x)), 6) as relevance from v, t order by 1 - list_dot_product(embedding, t.x), memory_id limit 15"
)
def analogy_abc(spark, d):
    a, b, c = (fixtures.vector(spark, d, i) for i in (10, 11, 12))
    return retrieve.analogy(mev(spark, d), a, b, c, 15).select("memory_id", six("relevance"))


_PAIRS = {"caused_by": (key(20), key(31)), "followed_by": (key(42), key(53))}


def _offsets(spark: SparkSession, d: str) -> dict[str, list[float]]:
    rows = [(s, t, e, 1.0, i) for i, (e, (s, t)) in enumerate(_PAIRS.items())]
    return graph.learn_offsets(spark.createDataFrame(rows, "src string, dst string, edge_type string, confidence double, ts_us long"), mev(spark, d))


_OFFSET = lambda s, t: f"list_transform(list_zip({_E(t)}, {_E(s)}), lambda p: p[1] - p[2])"
_OFF_SQL = f"o0 as (select 'caused_by' as edge_type, 0 as ord, {_OFFSET(20, 31)} as x union all select 'followed_by', 1, {_OFFSET(42, 53)}), o as (select edge_type, ord, {_NORM.format(x='x')} as o from o0)"


@query(f"with {_OFF_SQL}, u as (select edge_type, unnest(o) as x, generate_subscripts(o, 1) - 1 as pos from o) select edge_type, pos::bigint as pos, round(x, 6) as x from u")
def type_offsets_one_edge(spark, d):
    rows = [(t, i, float(x)) for t, o in sorted(_offsets(spark, d).items()) for i, x in enumerate(o)]
    return spark.createDataFrame(rows, "edge_type string, pos long, x double").select("edge_type", "pos", six("x"))


def _causal_sql(signs: tuple[int, ...]) -> str:
    probes = " union all ".join(f"select edge_type, ord * 2 + {0 if s > 0 else 1} as probe, list_transform(list_zip({_E(SEED % 500)}, o), lambda p: p[1] + {s} * p[2]) as c from o" for s in signs)
    return (
        f"with {SQL_V}, {_OFF_SQL}, p0 as ({probes}), p as (select edge_type, probe, {_NORM.format(x='c')} as c from p0), h as (select edge_type, probe, memory_id, 1 - list_dot_product(embedding, c) as dist from v, p where memory_id <> '{key(SEED)}'), "
        "t as (select *, row_number() over (partition by probe order by dist, memory_id) as r from h), f as (select *, row_number() over (partition by memory_id order by probe, dist) as f from t where r <= 12) "
        "select memory_id, edge_type, round(greatest(0.0::double, 1 - dist), 6) as relevance from f where f = 1 order by greatest(0.0::double, 1 - dist) desc, memory_id limit 12"
    )


def _causal(spark: SparkSession, d: str, direction: str) -> DataFrame:
    seed = fixtures.vector(spark, d, SEED % 500)
    return retrieve.causal(mev(spark, d), seed, key(SEED), _offsets(spark, d), 12, ("caused_by", "followed_by"), direction).select("memory_id", "edge_type", six("relevance"))


@query(_causal_sql((1,)))
def recall_causal_forward(spark, d):
    return _causal(spark, d, "forward")


@query(_causal_sql((-1,)))
def recall_causal_backward(spark, d):
    return _causal(spark, d, "backward")


@query(_causal_sql((1, -1)))
def recall_causal_both(spark, d):
    return _causal(spark, d, "both")


_MERGE = (
    f"with {SQL_V}, s as (select *, greatest(0.0::double, list_dot_product(embedding, {_CUE})) as relevance, 'similarity' as strategy from v where entity_id = '{USER}' order by {_DIST}, memory_id limit 15), "
    f"t0 as (select * from v where entity_id = '{USER}' order by created_at desc, memory_id desc limit 15), t as (select *, 1 - (row_number() over (order by created_at desc, memory_id desc) - 1) / (count(*) over ())::double as relevance, 'temporal' as strategy from t0), "
    "u as (select * from s union all select * from t), g as (select memory_id, content, importance, created_at, access_count, max(relevance) as relevance, string_agg(distinct strategy, ',' order by strategy) as strategies from u group by all), "
    "w as (select *, row_number() over (partition by sha256(content) order by relevance desc, memory_id) as r from g) "
    f"select memory_id, strategies, round(relevance, 6) as relevance, round({_composite('relevance')}, 6) as score from w where r = 1 order by {_composite('relevance')} desc, memory_id limit 15"
)


@query(_MERGE)
def recall_multi_merge(spark, d):
    r = retrieve.recall(mev(spark, d), ["similarity", "temporal"], NOW_US, fixtures.vector(spark, d, CUE), 15, USER)
    return r.results.select("memory_id", F.array_join("strategies", ",").alias("strategies"), six("relevance"), six("score"))


_PRIME = (
    f"with {SQL_V}, e as (select * from v where entity_id = '{USER}'), r as (select * from e where created_at >= {NOW_US - 7 * DAY} and created_at < {NOW_US} order by created_at desc, memory_id desc limit 10), "
    "a as (select memory_id, 'temporal' as section, row_number() over (order by created_at, memory_id) as ord, count(*) over () as n from r), "
    f"b as (select *, greatest(0.0::double, list_dot_product(embedding, {_CUE})) as relevance from (select * from e order by created_at desc, memory_id desc limit 500) z where memory_id not in (select memory_id from r)), "
    f"c as (select *, {_composite('relevance')} as score from b order by score desc, memory_id limit 10) "
    "select memory_id, section, ord::bigint as ord, round(1 - (ord - 1) / n::double, 6) as relevance from a union all select memory_id, 'similarity', row_number() over (order by score desc, memory_id), round(relevance, 6) from c"
)


@query(_PRIME)
def prime_entity(spark, d):
    return retrieve.prime(mev(spark, d), USER, fixtures.vector(spark, d, CUE), NOW_US).select("memory_id", "section", F.col("ord").cast("long").alias("ord"), six("relevance"))


@query(f"with {SQL_ALL}, p as (select least(src, dst) as a, greatest(src, dst) as b, confidence from edges where edge_type = 'contradicts' and src in (select memory_id from m where tenant_id = 'default') and dst in (select memory_id from m where tenant_id = 'default')) select a, b, max(confidence) as confidence from p group by a, b")
def contradictions_in_results(spark, d):
    return retrieve.contradictions_among(access.of_tenant(mem(spark, d), "default"), fixtures.edges(spark, d))


@query(f"with {SQL_V}, h as (select *, {_DIST} as dist from v order by dist, memory_id limit 10) select m.memory_id, m.access_count + case when h.memory_id is null then 0 else 1 end as access_count, case when h.memory_id is null then m.last_accessed_at else {NOW_US} end as last_accessed_at from m left join h on m.memory_id = h.memory_id")
def reinforce_after_recall(spark, d):
    hits = retrieve.similarity(mev(spark, d), fixtures.vector(spark, d, CUE), 10)
    return lifecycle.reinforce(mem(spark, d), hits, NOW_US).select("memory_id", "access_count", "last_accessed_at")


# ---- scores


@query(f"with {SQL_M} select memory_id, round({_composite('importance')}, 6) as score from m")
def composite_score(spark, d):
    return mem(spark, d).select("memory_id", six(scoring.composite(F.col("importance"), NOW_US), "score"))


@query(f"with {SQL_M} select memory_id, round({_DECAY}, 6) as decay from m")
def decay_scores(spark, d):
    return mem(spark, d).select("memory_id", six(scoring.decay(NOW_US), "decay"))


@query(f"with {SQL_M}, s as (select memory_id, decay_score, {_DECAY} as new from m) select memory_id, round(decay_score, 6) as old_score, round(new, 6) as new_score from s where abs(new - decay_score) > 0.001")
def decay_sweep_updates(spark, d):
    return lifecycle.decay_sweep(mem(spark, d), NOW_US).where("changed").select("memory_id", six("old_score"), six("new_score"))


@query(f"with {SQL_M} select memory_id, round({_DECAY}, 6) as new_score from m where {_DECAY} < 0.01")
def auto_forget_candidates(spark, d):
    return lifecycle.decay_sweep(mem(spark, d), NOW_US).where("candidate").select("memory_id", six("new_score"))


@query(f"with {SQL_M}, c as (select memory_id from m where {_DECAY} < 0.01) select kind, count(*) as n from m where memory_id not in (select memory_id from c) group by kind")
def auto_forget_rest(spark, d):
    m = mem(spark, d)
    left = lifecycle.auto_forget(m, fixtures.edges(spark, d), lifecycle.decay_sweep(m, NOW_US), NOW_US).memories
    return left.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"with {SQL_M} select memory_id, round(least(1.0::double, greatest(0.0::double, 0.7::double * importance + 0.3::double * decay_score + ln(1 + access_count) / 10)), 6) as insight_importance from m where kind = 'insight'")
def insight_importance(spark, d):
    return mem(spark, d).where("kind = 'insight'").select("memory_id", six(scoring.insight_importance(F.col("importance"), F.col("decay_score"), F.col("access_count")), "insight_importance"))


@query(f"with {SQL_M} select memory_id, round({_STRUCT}, 6) as structure from m")
def structural_similarity(spark, d):
    return mem(spark, d).select("memory_id", six(scoring.structural_similarity({"k": 1, "kind": "episode"}, None), "structure"))


# ---- graph


@query(f"with {SQL_E} select edge_type, dst as other, round(confidence, 6) as confidence, ts_us from edges where src = '{key(SEED)}'")
def edges_out(spark, d):
    return graph.outgoing(fixtures.edges(spark, d), key(SEED)).select("edge_type", F.col("dst").alias("other"), six("confidence"), "ts_us")


@query(f"with {SQL_E} select edge_type, src as other, round(confidence, 6) as confidence, ts_us from edges where dst = '{key(SEED)}'")
def edges_in(spark, d):
    return graph.incoming(fixtures.edges(spark, d), key(SEED)).select("edge_type", F.col("src").alias("other"), six("confidence"), "ts_us")


_BFS = "with recursive {e}, b as (select '{s}' as memory_id, 0 as depth union select e.dst, b.depth + 1 from b join edges e on e.src = b.memory_id where b.depth < {n}{t})"


@query(_BFS.format(e=SQL_E, s=key(SEED), n=3, t=" and e.edge_type in ('followed_by', 'caused_by')") + f" select memory_id, min(depth)::bigint as depth from b where memory_id <> '{key(SEED)}' group by memory_id")
def recall_causal_bfs(spark, d):
    seen = graph.traverse(fixtures.edges(spark, d), key(SEED), 3, ("followed_by", "caused_by"))
    return seen.select("memory_id", F.col("depth").cast("long").alias("depth"))


_SUB = _BFS.format(e=SQL_E, s=key(SEED), n=2, t="") + f", s as (select memory_id, min(depth) as depth from b group by memory_id), n as (select * from (select *, row_number() over (order by depth, memory_id) as r from s) z where r <= 100)"


@query(_SUB + " select m.memory_id, n.depth::bigint as depth, m.kind from n join m using (memory_id)")
def subgraph_nodes(spark, d):
    nodes, _ = graph.subgraph(mem(spark, d), fixtures.edges(spark, d), key(SEED))
    return nodes.select("memory_id", F.col("depth").cast("long").alias("depth"), "kind")


@query(_SUB + " select src, dst, edge_type from edges where src in (select memory_id from n) and dst in (select memory_id from n)")
def subgraph_edges(spark, d):
    _, edges = graph.subgraph(mem(spark, d), fixtures.edges(spark, d), key(SEED))
    return edges.select("src", "dst", "edge_type")


_KNN = "x as (select vec_id, cast(embedding as double[]) as v from embeddings), p as (select a.vec_id as id, b.vec_id as neighbour, 1 - list_dot_product(a.v, b.v) as distance from x a join x b on a.vec_id <> b.vec_id), k as (select *, row_number() over (partition by id order by round(distance, 9), neighbour) as r from p)"


def _knn(spark: SparkSession, d: str, k: int) -> DataFrame:
    return graph.knn(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding"), "vec_id", "embedding", k)


@query(f"with {_KNN} select id, neighbour, round(distance, 6) as distance from k where r <= 15")
def knn_snapshot(spark, d):
    return _knn(spark, d, 15).select("id", "neighbour", six("distance"))


@query(f"with {_KNN}, s as (select least(id, neighbour) as a, greatest(id, neighbour) as b, max(least(1.0::double, greatest(0.0::double, 1 - distance / 2))) as weight from k where r <= 3 group by 1, 2) select a, b, round(weight, 6) as weight from s where weight > 0.5")
def knn_graph_edges(spark, d):
    none = spark.createDataFrame([], "src long, dst long, edge_type string, confidence double")
    return graph.similarity_graph(_knn(spark, d, 3), none).select("a", "b", six("weight"))


_CUT = (
    f"with recursive {_KNN}, u as (select least(id, neighbour) as a, greatest(id, neighbour) as b, min(round(distance, 9)) as d from k where r <= 4 group by 1, 2), bar as (select d from (select d, row_number() over (order by d) - 1 as i from u) z where i = (select floor(count(*) * 0.65)::bigint from u)), "
    "e as (select a, b from u where d <= (select d from bar)), g as (select a, b from e union select b, a from e), c as (select vec_id as id, vec_id as root from embeddings union select g.b, c.root from c join g on g.a = c.id), r as (select id, min(root) as root from c group by id), "
    "n as (select root, dense_rank() over (order by root) - 1 as cluster from (select root from r group by root having count(*) >= 3) z) select id, coalesce(cluster, -1)::bigint as cluster from r left join n using (root)"
)


@query(_CUT)
def knn_components(spark, d):
    nodes = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"))
    return graph.cluster_by_distance(_knn(spark, d, 4), nodes).select("id", F.col("cluster").cast("long").alias("cluster"))


@query()
def umap_projection(spark, d):
    import numpy as np

    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").limit(500).collect()  # a view shows 500 nodes at most
    xy = graph.project_2d(np.array([r["embedding"] for r in rows]))
    return spark.createDataFrame([(r["vec_id"], float(x), float(y)) for r, (x, y) in zip(rows, xy, strict=True)], "vec_id long, x double, y double")


# ---- point access and pages


@query(f"with {SQL_M} select memory_id, content, kind from m where memory_id = '{key(77)}'")
def get_memory(spark, d):
    return access.get(mem(spark, d), key(77)).select("memory_id", "content", "kind")


_IDS = [key(i) for i in (5, 99, 3, 999_999_999, 42)]


@query(f"with {SQL_M}, w(pos, memory_id) as (values {', '.join(f'({i}::bigint, {x!r})' for i, x in enumerate(_IDS))}) select w.pos, m.memory_id, m.content from w join m using (memory_id)")
def batch_get(spark, d):
    return access.batch_get(mem(spark, d), _IDS).select("pos", "memory_id", "content")


@query(f"with {SQL_M} select memory_id, created_at from m where kind = 'insight' and memory_id > '{key(500)}' order by memory_id limit 100")
def list_memories_page(spark, d):
    return access.list_memories(mem(spark, d), 100, key(500), kind="insight").select("memory_id", "created_at")


@query(f"with {SQL_M} select memory_id, created_at from m where entity_id = '{USER}' order by created_at, memory_id limit 40")
def list_by_entity(spark, d):
    return access.list_by_entity(mem(spark, d), USER, 40).select("memory_id", "created_at")


@query(f"with {SQL_M} select distinct entity_id from m where entity_id is not null")
def list_entities(spark, d):
    return access.list_entities(mem(spark, d))


@query(f"with {SQL_M} select kind, tenant_id, count(*) as n from m group by kind, tenant_id")
def count_by_kind(spark, d):
    return access.count_by(mem(spark, d), "kind", "tenant_id")


@query(f"with {SQL_M} select memory_id, created_at from m where entity_id = '{USER}' and created_at >= {NOW_US - 25 * DAY} and created_at < {NOW_US - 3 * DAY}")
def query_temporal(spark, d):
    return access.query_temporal(mem(spark, d), USER, NOW_US - 25 * DAY, NOW_US - 3 * DAY).select("memory_id", "created_at")


@query(f"with {SQL_M} select memory_id, content, round(importance, 6) as importance from m where entity_id = '{USER}' order by created_at, memory_id limit 10000")
def export_entity(spark, d):
    return access.export(mem(spark, d), USER)[0].select("memory_id", "content", six("importance"))


@query(f"with {SQL_E}, o as (select src, count(*) as n from edges where src = '{key(SEED)}' group by src) select memory_id, round({_DECAY}, 6) as decay, coalesce(o.n, 0) as n_edges from m left join o on o.src = m.memory_id where memory_id = '{key(SEED)}'")
def inspect_memory(spark, d):
    row = access.inspect(mem(spark, d), fixtures.edges(spark, d), key(SEED), NOW_US)
    return row.select("memory_id", six("decay_now", "decay"), F.coalesce(F.size("edges"), F.lit(0)).cast("long").alias("n_edges"))


@query(f"with {SQL_M} select tenant_id, count(distinct entity_id) as entities, min(created_at) as first_us from m where tenant_id = 'tenant_b' group by tenant_id")
def tenant_scope(spark, d):
    return access.of_tenant(mem(spark, d), "tenant_b").groupBy("tenant_id").agg(F.countDistinct("entity_id").alias("entities"), F.min("created_at").alias("first_us"))


# ---- lifecycle


def _forget(spark: SparkSession, d: str, **criteria) -> lifecycle.Forgotten:
    return lifecycle.forget(mem(spark, d), fixtures.edges(spark, d), lifecycle.Criteria(**criteria), NOW_US)


@query(f"with {SQL_M} select memory_id from m where not entity_id = '{USER}'")
def forget_by_entity(spark, d):
    return _forget(spark, d, entity=USER).memories.select("memory_id")


@query(f"with {SQL_M} select memory_id from m where not last_accessed_at < {NOW_US - 20 * DAY}")
def forget_stale(spark, d):
    return _forget(spark, d, not_accessed_since_us=NOW_US - 20 * DAY).memories.select("memory_id")


@query(f"with {SQL_M} select memory_id from m where not (access_count < 5 and entity_id = '{USER}')")
def forget_low_access(spark, d):
    return _forget(spark, d, access_below=5, entity=USER).memories.select("memory_id")


@query(f"with {SQL_E}, g as (select memory_id from m where kind = 'proposition' and decay_score < 0.2) select edge_type, count(*) as n from edges where src not in (select memory_id from g) and dst not in (select memory_id from g) group by edge_type")
def forget_kind_and_decay(spark, d):
    return _forget(spark, d, kind="proposition", decay_below=0.2).edges.groupBy("edge_type").agg(F.count("*").alias("n"))


@query(f"with {SQL_M} select memory_id, kind, 'entity:{USER}' as criteria, sha256(content) as content_hash, {NOW_US}::bigint as forgotten_at from m where entity_id = '{USER}'")
def tombstones(spark, d):
    return _forget(spark, d, entity=USER).tombstones.select("memory_id", "kind", "criteria", "content_hash", "forgotten_at")


@query(f"with {SQL_E}, g as (select memory_id from m where entity_id = '{USER}' and kind = 'episode') select distinct src as memory_id from edges where edge_type = 'insight_from' and dst in (select memory_id from g) and src not in (select memory_id from g)")
def stale_insights(spark, d):
    return _forget(spark, d, entity=USER, kind="episode").stale_insights


@query(f"with {SQL_M} select memory_id, created_at as forgotten_at from m where kind = 'proposition' and created_at >= {NOW_US - 10 * DAY}")
def gc_tombstones(spark, d):
    marks = mem(spark, d).where("kind = 'proposition'").select("memory_id", F.col("created_at").alias("forgotten_at"))
    return lifecycle.gc_tombstones(marks, NOW_US, 10)


_REV = f"c as (select memory_id as id, 'revised ' || content as content, json_object('k', k + 1, 'note', 'x') as context from m where kind = 'proposition')"


@query(f"with {SQL_M}, {_REV} select m.memory_id, coalesce(c.content, m.content) as content, case when c.id is null then m.kind else 'revision' end as kind, case when c.id is null then m.k else m.k + 1 end as k, case when c.id is not null then 'x' end as note, m.created_at, case when c.id is null then m.updated_at else {NOW_US} end as updated_at from (select *, created_at as updated_at from m) m left join c on c.id = m.memory_id")
def revise_context_merge(spark, d):
    m = mem(spark, d)
    return _revised(m, fixtures.edges(spark, d))[0].where("not is_snapshot").select("memory_id", "content", "kind", F.get_json_object("context", "$.k").cast("long").alias("k"), F.get_json_object("context", "$.note").alias("note"), "created_at", "updated_at")


def _revised(m: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    m = m.withColumn("is_snapshot", F.lit(False))
    changes = m.where("kind = 'proposition'").select("memory_id", F.concat(F.lit("revised "), F.col("content")).alias("content"), F.to_json(F.struct((F.col("k") + 1).alias("k"), F.lit("x").alias("note"))).alias("context"))
    return lifecycle.revise(m, edges, changes, NOW_US)


@query(f"with {SQL_M} select memory_id as owner, content, kind, {NOW_US}::bigint as ts_us from m where kind = 'proposition'")
def revise_snapshots(spark, d):
    m, edges = _revised(mem(spark, d), fixtures.edges(spark, d))
    links = edges.where("edge_type = 'revised_from'").select(F.col("src").alias("owner"), F.col("dst").alias("memory_id"), "ts_us")
    return m.where("is_snapshot").join(links, "memory_id").select("owner", "content", "kind", "ts_us")


@query(f"with {SQL_M}, e as (select entity_id as owner, memory_id as snapshot from m) select owner, snapshot from (select *, row_number() over (partition by owner order by snapshot desc) as r from e) z where r > 5")
def snapshot_prune(spark, d):
    links = mem(spark, d).select(F.col("entity_id").alias("src"), F.col("memory_id").alias("dst"), F.lit("revised_from").alias("edge_type"))
    return lifecycle.surplus_snapshots(links, 5)


@query(f"with {SQL_E} select edge_type, count(*) as n, round(sum(confidence), 4) as total from (select src, dst, edge_type, max_by(confidence, new) as confidence from (select src, dst, edge_type, confidence, 0 as new from edges union all select src, dst, edge_type, 0.25::double, 1 from edges where edge_type = 'contradicts') z group by src, dst, edge_type) y group by edge_type")
def add_edge_upsert(spark, d):
    e = fixtures.edges(spark, d)
    more = e.where("edge_type = 'contradicts'").withColumn("confidence", F.lit(0.25))
    return graph.add_edge(e, more).groupBy("edge_type").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("total"))


@query(f"with {SQL_M} select event_type as kind, count(*) as n, round(sum(least(1.0::double, value / 500)), 4) as importance from (select event_type, value from events) z group by event_type")
def remember_events(spark, d):
    new = spark.read.parquet(f"{d}/events.parquet").select(F.concat_ws(" ", "event_type", "props").alias("content"), F.least(F.lit(1.0), F.col("value") / 500).alias("importance"), F.col("event_type").alias("entity_id"), F.lpad(F.lower(F.hex(F.col("event_id") + 1)), 32, "0").alias("memory_id"))
    none = spark.createDataFrame([], MEMORIES)
    return lifecycle.remember(none, new, NOW_US).groupBy(F.col("entity_id").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("importance"), 4).alias("importance"))


# ---- contradictions and text


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_HAS = lambda t, words: f"len(list_filter({_list(words)}, lambda w: contains({t}, w)))"
_ANT = "len(list_filter([" + ", ".join(f"['{x}', '{y}']" for x, y in text.ANTONYMS) + "], lambda p: (contains(a, p[1]) and contains(b, p[2])) or (contains(a, p[2]) and contains(b, p[1]))))"
_W = lambda t: f"list_distinct(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> ''))"
_N = lambda t: f"list_filter({_W(t)}, lambda w: regexp_matches(w, '[0-9]'))"
_NUM = f"(len({_N('a')}) > 0 and len({_N('b')}) > 0 and len(list_intersect({_W('a')}, {_W('b')})) >= 3 and not list_has_any({_N('a')}, {_N('b')}))"
_CLASSIFY = f"(select *, {_HAS('a', text.REVISIONS)} as ra, len(list_filter({_list(text.REVISIONS)}, lambda w: contains(a, w) or contains(b, w))) * 0.3::double as rev, least(0.75::double, case when ({_HAS('a', text.NEGATIONS)} = 0) <> ({_HAS('b', text.NEGATIONS)} = 0) then 0.35::double else 0.0::double end + {_ANT} * 0.25::double + case when {_NUM} then 0.2::double else 0.0::double end) as s from pairs)"
_PAIRED = "pairs as (select x.doc_id, lower(x.text) as a, lower(y.text) as b from documents x join documents y on y.doc_id = x.doc_id + 1)"


def _doc_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return docs.withColumnRenamed("text", "content_a").join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("content_b")), "doc_id")


@query(f"with {_PAIRED} select doc_id, case when rev > 0.2 then 'revision' when round(s, 9) >= 0.35 then 'contradiction' else 'neutral' end as verdict, round(case when rev > 0.2 then least(0.75::double, rev * 0.75) when round(s, 9) >= 0.35 then s else 0.0::double end, 6) as confidence from {_CLASSIFY} z")
def heuristic_classify(spark, d):
    return contradict.classify_pairs(_doc_pairs(spark, d)).select("doc_id", "verdict", six("confidence"))


@query(f"with {_PAIRED} select doc_id, {_NUM} as differ from pairs")
def numeric_disagreement(spark, d):
    return _doc_pairs(spark, d).select("doc_id", text.numeric_disagreement(F.lower("content_a"), F.lower("content_b")).alias("differ"))


@query(f"with {_KNN}, c as (select id, neighbour, 1 - least(distance, 2.0::double) / 2 as s from k where r <= 9) select id as id_a, neighbour as id_b, round(s, 6) as similarity from c where round(s, 9) >= 0.5 and (id, neighbour) not in (select src, dst from (select vec_id as src, vec_id + 1 as dst from embeddings where vec_id % 3 = 0) z)")
def contradiction_candidates(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    m = e.select(F.col("vec_id").alias("memory_id"), "embedding", F.lit("text").alias("content"))
    settled = e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst"), F.lit("contradicts").alias("edge_type"))
    return contradict.candidates(m, settled).select("id_a", "id_b", six("similarity"))


_STOP = _list(text.STOP_WORDS)


@query(f"select conv_id, turn, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: octet_length(encode(w)) >= 3 and not list_contains({_STOP}, w)), ' ') as keywords from conversations")
def keywords(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


@query(r"select doc_id, md5(array_to_string(list_filter(string_split(concat('TODO', chr(10), text, chr(10), '{{x}}', chr(10), '---'), chr(10)), lambda l: not regexp_matches(trim(l), '(?i)^(tbd|todo|n/a|fixme|placeholder|coming soon|---)\.?$') and not regexp_matches(trim(l), '^(\{\{.*\}\}|\[[^\]]*\]|<[^>]*>)$')), chr(10))) as digest from documents")
def boilerplate_strip(spark, d):
    t = F.concat(F.lit("TODO\n"), F.col("text"), F.lit("\n{{x}}\n---"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(text.strip_boilerplate(t)).alias("digest"))


@query(r"select doc_id, array_to_string(list_transform(regexp_extract_all('see [[Note ' || doc_id || '|label]] and [[ Other#part]] ' || source, '\[\[([^\]|#]+)', 1), lambda x: trim(x)), ',') as links from documents")
def wiki_links(spark, d):
    t = F.concat(F.lit("see [[Note "), F.col("doc_id").cast("string"), F.lit("|label]] and [[ Other#part]] "), F.col("source"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(text.wiki_links(t), ",").alias("links"))


@query("select doc_id, 'sha256:' || sha256(trim(text, ' ')) as hash, (octet_length(encode(text)) // 4)::bigint as tokens, case when length(text) > 80 then substr(text, 1, 80) || '...' else text end as preview from documents")
def text_hashes(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.proposition_hash(F.col("text")).alias("hash"), text.estimate_tokens(F.col("text")).alias("tokens"), text.preview(F.col("text"), 80).alias("preview"))


@query(f"with {SQL_D} select content_hash, n, memory_id from (select sha256(content) as content_hash, count(*) over (partition by sha256(content)) as n, memory_id, row_number() over (partition by sha256(content) order by importance desc, memory_id) as r from d) z where r = 1")
def content_dedup(spark, d):
    return access.content_groups(fixtures.document_memories(spark, d))


# ---- reports


@query(f"with {SQL_M} select strftime(make_timestamp(created_at), '%Y-%m-%d') as day, count(*) filter (kind <> 'insight') as memories, count(*) filter (kind = 'insight') as insights from m group by day")
def timeline_daily(spark, d):
    return reports.timeline_daily(mem(spark, d))


@query(f"with {SQL_M} select memory_id from m where created_at <= {NOW_US - 15 * DAY}")
def timeline_snapshot(spark, d):
    return reports.timeline_snapshot(mem(spark, d), NOW_US - 15 * DAY)


@query(f"with {SQL_M} select memory_id, created_at as forgotten_at from m where kind = 'proposition' order by created_at desc, memory_id limit 100")
def forgotten_recent(spark, d):
    marks = mem(spark, d).where("kind = 'proposition'").select("memory_id", F.col("created_at").alias("forgotten_at"))
    return reports.forgotten(marks)


_THREE = f"(0.2::double * case when created_at >= {NOW_US} then 1.0::double else least(1.0::double, greatest(0.0::double, 1 - ({NOW_US} - created_at) / 2592000000000.0::double)) end + 0.2::double * importance + 0.1::double * least(1.0::double, log2(1 + access_count) / log2(101)))"


@query(f"with {SQL_M} select memory_id, round({_THREE}, 6) as score from m order by {_THREE} desc, memory_id limit 10")
def dashboard_top(spark, d):
    return reports.dashboard_top(mem(spark, d), NOW_US).select("memory_id", six("score"))


@query(f"with {SQL_M} select kind, count(*) as n, count(distinct entity_id) as entities, round(avg(importance), 6) as mean_importance from m group by kind")
def dashboard_counts(spark, d):
    return reports.dashboard_counts(mem(spark, d))


@query(f"with {SQL_M} select memory_id, round(importance, 6) as importance from m where contains(lower(content), 'purchase') order by importance desc, memory_id limit 25 offset 25")
def memory_list_search(spark, d):
    return reports.memory_list(mem(spark, d), "Purchase", sort="importance", page=2, per_page=25).select("memory_id", six("importance"))


@query(f"with {SQL_M} select memory_id, round(importance, 6) as importance from (select * from m where kind = 'insight' and importance >= 0.4 order by memory_id limit 100) z")
def insights_filter(spark, d):
    return reports.insights(mem(spark, d), least_importance=0.4).select("memory_id", six("importance"))


@query(f"with {SQL_E} select m.memory_id, coalesce(string_agg(e.dst, ',' order by e.dst), '') as sources from m left join edges e on e.src = m.memory_id and e.edge_type = 'insight_from' where m.kind = 'insight' group by m.memory_id")
def insight_lineage(spark, d):
    rows = reports.lineage(mem(spark, d), fixtures.edges(spark, d)).where("kind = 'insight'")
    return rows.select("memory_id", F.array_join("source_memory_ids", ",").alias("sources"))


_LBL = f"w as (select label as cluster, unnest(regexp_split_to_array(t, '\\s+')) as word from (select doc_id % 10 as label, text as t from documents) z), c as (select cluster, lower(regexp_replace(word, '[^\\p{{L}}\\p{{N}}_-]', '', 'g')) as word from w), f as (select * from c where octet_length(encode(word)) >= 2 and not list_contains({_list(reports.LABEL_STOP_WORDS)}, word)), g as (select cluster, word, count(*) as n, row_number() over (partition by cluster order by count(*) desc, word) as r from f group by cluster, word)"


@query(f"with {_LBL}, t as (select cluster, max(n) filter (r = 2) = max(n) filter (r = 3) as tie from g where r <= 3 group by cluster) select cluster, string_agg(upper(substr(word, 1, 1)) || substr(word, 2), ' & ' order by r) as label from g join t using (cluster) where r <= 2 or (r = 3 and tie) group by cluster")
def cluster_labels(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select((F.col("doc_id") % 10).alias("cluster"), F.col("text").alias("label"))
    return reports.cluster_labels(docs)


@query(f"with {SQL_M}, s as (select memory_id, case when access_count % 5 = 0 then 'stale' when access_count % 7 = 0 then 'orphaned' else 'synced' end as state from m) select count(*) as total, count(*) filter (state = 'synced') as synced, count(*) filter (state = 'stale') as stale, count(*) filter (state = 'orphaned') as orphaned, (count(*) filter (state = 'synced') * 100 // count(*))::bigint as indexing_pct, 'indexing' as code from s")
def status_counts(spark, d):
    s = mem(spark, d).select(F.when(F.col("access_count") % 5 == 0, "stale").when(F.col("access_count") % 7 == 0, "orphaned").otherwise("synced").alias("state"))
    return reports.status(s)


@query(f"with {SQL_Q} select id, timestamp_us, latency_us from q where caller = 'click' and operation = 'recall' and contains(query, '1') and latency_us >= 1000 order by timestamp_us desc, id desc limit 50 offset 10")
def query_log_list(spark, d):
    return querylog.listing(fixtures.query_log(spark, d), "click", "recall", "1", 1000, offset=10).select("id", "timestamp_us", "latency_us")


@query(f"with {SQL_Q}, s as (select latency_us, row_number() over (order by latency_us) - 1 as i, count(*) over () as n from q) select count(*) as total, floor(avg(latency_us))::bigint as avg_latency_us, max(latency_us) as max_latency_us, max(latency_us) filter (i = least(ceil(0.99 * n), n - 1)) as p99_latency_us from s")
def query_log_stats(spark, d):
    return querylog.stats(fixtures.query_log(spark, d))


@query(f"with {SQL_Q} select caller, count(*) as n, floor(avg(latency_us))::bigint as avg_latency_us from q group by caller")
def query_log_by_caller(spark, d):
    return querylog.by_caller(fixtures.query_log(spark, d))


@query(f"with {SQL_Q} select id from (select id, row_number() over (order by timestamp_us desc, id desc) as r from q where timestamp_us >= {NOW_US - 20 * DAY}) z where r <= 2000")
def query_log_compact(spark, d):
    return querylog.compact(fixtures.query_log(spark, d), NOW_US, 20, 2000).select("id")


# ---- reflection


@query(f"with {SQL_M} select memory_id, created_at from m where kind = 'episode' and created_at >= {NOW_US - 20 * DAY} order by memory_id limit 500")
def reflect_scope(spark, d):
    return reflect.scope(mev(spark, d), since_us=NOW_US - 20 * DAY).select("memory_id", "created_at")


@query()
def kmeans_reflect(spark, d):
    import numpy as np

    rows = reflect.scope(mev(spark, d)).select("memory_id", "embedding").collect()  # a scope has 500 rows at most
    label = reflect.cluster(np.array([r["embedding"] for r in rows]))
    return spark.createDataFrame([(r["memory_id"], int(x)) for r, x in zip(rows, label, strict=True)], "memory_id string, cluster int")


# ---- ingestion


_OLD = "o as (select source as file, doc_id, md5(text) as h from documents where doc_id % 5 <> 0)"
_NEW = "n as (select source as file, doc_id, case when doc_id % 7 = 0 then md5('new' || text) else md5(text) end as h from documents where doc_id % 11 <> 0)"


@query(f"with {_OLD}, {_NEW} select coalesce(o.file, n.file) as file_path, coalesce(o.doc_id, n.doc_id)::varchar as heading, case when n.h is null then 'orphaned' when o.h is null then 'stale' when o.h = n.h then 'synced' else 'content_stale' end as state from o full outer join n on o.file = n.file and o.doc_id = n.doc_id")
def section_diff(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    path = F.array(F.col("doc_id").cast("string"))
    old = docs.where("doc_id % 5 <> 0").select(F.col("source").alias("file_path"), path.alias("heading_path"), F.col("doc_id").cast("string").alias("section_id"), F.md5("text").alias("section_hash"))
    new = docs.where("doc_id % 11 <> 0").select(F.col("source").alias("file_path"), path.alias("heading_path"), F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat(F.lit("new"), "text"))).otherwise(F.md5("text")).alias("section_hash"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("stop"))
    return ingest.section_diff(old, new).select("file_path", F.get("heading_path", F.lit(0)).alias("heading"), "state")


@query("with s as (select distinct source as file, sha256(text) as h from documents where doc_id % 3 <> 0), n as (select distinct source as file, sha256(text) as h from documents where doc_id % 4 <> 0) select coalesce(s.file, n.file) as file_path, coalesce(s.h, n.h) as hash, case when s.h is null then 'add' when n.h is null then 'drop' else 'keep' end as action from s full outer join n on s.file = n.file and s.h = n.h")
def proposition_merge(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("file_path"), F.sha2("text", 256).alias("hash"), "doc_id")
    stored = docs.where("doc_id % 3 <> 0").select("file_path", "hash").distinct().withColumn("memory_id", F.substring("hash", 1, 32))
    return ingest.merge_propositions(stored, docs.where("doc_id % 4 <> 0").select("file_path", "hash").distinct()).select("file_path", "hash", "action")


@query("select doc_id as file_path, md5(text) as checksum from documents where doc_id % 9 = 0 or doc_id % 2 = 1")
def find_changed_files(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("file_path"), F.md5("text").alias("checksum"))
    known = docs.where("file_path % 2 = 0").withColumn("checksum", F.when(F.col("file_path") % 9 == 0, "old").otherwise(F.col("checksum")))
    return ingest.changed_files(docs, known)


# ---- subscriptions


@query(f"with {SQL_V}, u as (select unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as pos from v where entity_id = '{USER}'), a as (select pos, avg(x) as x from u group by pos), n as (select sqrt(sum(x * x)) as n from a) select pos::bigint as pos, round(x / n, 6) as x from a, n")
def scope_centroid(spark, d):
    c = subscribe.centroid(mev(spark, d).where(F.col("entity_id") == USER))
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(c)], "pos long, x double").select("pos", six("x"))


_KW = f"kw as (select distinct w as word from (select unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: octet_length(encode(w)) >= 3 and not list_contains({_STOP}, w))) as w from benchmark) z)"


@query(f"with {_KW}, c as (select conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: octet_length(encode(w)) >= 3 and not list_contains({_STOP}, w))) as w from conversations) select count(*) - (select count(*) from (select distinct conv_id, turn from c where w in (select word from kw)) z) as rejected, count(*) as chunks from conversations")
def bloom_reject_count(spark, d):
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("text").alias("content"))
    chunks = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text")
    words = subscribe.scope_keywords(items)
    passed = chunks.select("conv_id", "turn", F.explode(text.keywords(F.col("text"))).alias("word")).join(words, "word", "left_semi").select("conv_id", "turn").distinct()
    return chunks.agg(F.count("*").alias("chunks")).crossJoin(passed.agg(F.count("*").alias("n"))).select((F.col("chunks") - F.col("n")).alias("rejected"), "chunks")


@query(
    f"with {SQL_V}, c as (select vec_id as chunk_id, cast(embedding as double[]) as e from embeddings where vec_id % 3 <> 1), p as (select chunk_id, memory_id, greatest(0.0::double, list_dot_product(e, embedding)) as confidence from c, v where kind in ('episode', 'insight', 'revision')), r as (select *, row_number() over (partition by chunk_id order by round(confidence, 9) desc, memory_id) as r from p) select chunk_id, memory_id, round(confidence, 6) as confidence from r where r <= 5 and round(confidence, 9) >= 0.6"
)
def subscribe_batch_matches(spark, d):
    chunk = F.when(F.col("vec_id") % 3 == 0, "a click, then").when(F.col("vec_id") % 3 == 1, "nothing that is known").otherwise("the last purchase")
    chunks = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), chunk.alias("chunk"), F.col("embedding").cast("array<double>").alias("embedding"))
    m = mev(spark, d)
    return subscribe.matches(chunks, m, subscribe.scope_keywords(m), []).select("chunk_id", "memory_id", six("confidence"))


@query()
def hash_embeddings(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", embed.hash_embedding(F.col("text"), 32).alias("e"))
    return docs.select("doc_id", six(vec.norm(F.col("e")), "norm"), six(F.get("e", F.lit(0)), "first"))


def queries() -> dict[str, Query]:
    importlib.import_module("engram.plans.more")  # registers the others
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    importlib.import_module("engram.plans.more")
    return dict(_SQL)
