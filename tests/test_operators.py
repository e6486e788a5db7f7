import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram import embed, llm_api, schema
from engram.functions import framing, scoring, text, vec
from engram.operators import graph, ingest, lifecycle, reflect, reports, retrieve, service
from engram.operators import contradict, querylog
from engram.sources import markdown
from engram.sources.store import Conflict, MemoryStore, MemoryTables, TableStore
from engram.streaming import subscribe

NOW = 1_700_000_000_000_000


def memories(spark, rows):
    return lifecycle.remember(spark.createDataFrame([], schema.MEMORIES), spark.createDataFrame(rows), NOW)


def test_weights_and_bounds():
    assert scoring.parse_weights("1:0:0:0").relevance == 1.0
    for bad in ("1:2:3", "a:b:c:d"):
        with pytest.raises(schema.InvalidInput):
            scoring.parse_weights(bad)
    with pytest.raises(schema.InvalidInput):
        schema.check_top_k(1001)
    with pytest.raises(schema.InvalidInput):
        lifecycle.Criteria().predicate()
    assert lifecycle.Criteria(ids=("a",), entity="x", decay_below=0.5).describe() == "ids:1,entity:x,decay<0.500"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(vec.dot(F.col("a"), F.col("b")).alias("d"), vec.dot(F.col("a"), [1.0, 1.0]).alias("l"), vec.normalize(F.col("a")).alias("n"), vec.dot(F.col("a"), [1.0]).alias("other")).first()
    assert (r.d, r.l, r.n, r.other) == (3.0, 7.0, [0.6, 0.8], None)
    assert vec.mean(df, "a").first().vec == [3.0, 4.0]


def test_decay_edges(spark):
    df = spark.createDataFrame([(1.0, 0, NOW), (1.0, 100, NOW), (0.0, 5, NOW), (1.0, 0, NOW - 30 * schema.DAY_US), (1.0, 0, NOW + 5)], "importance double, access_count long, last_accessed_at long")
    assert [round(r[0], 6) for r in df.select(scoring.decay(NOW)).collect()] == [1.0, 2.0, 0.0, 0.5, 1.0]


def test_structure_types(spark):
    df = spark.createDataFrame([('{"a": 1.5, "b": "x"}', "episode", None), ('{"a": "1"}', "insight", "e"), (None, "episode", None), ("not json", "episode", None)], "context string, kind string, entity_id string")
    got = [round(r[0], 6) for r in df.select(scoring.structural_similarity({"a": 3, "b": "y"}, None)).collect()]
    assert got == [round(0.4 + 0.3 + 0.1 + 0.05, 6), round(0.4 * 0.5 + 0.1, 6), 0.15, 0.15]


@pytest.mark.parametrize(("a", "b", "verdict"), [("the api is reliable", "the api is unreliable", "contradiction"), ("we used to like it", "we like it", "revision"), ("all fine here", "all fine there", "neutral"), ("", "", "neutral"), ("Prices INCREASE", "prices decrease never", "contradiction")])
def test_classifier(spark, a, b, verdict):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(text.heuristic_classify(F.col("a"), F.col("b")).alias("c")).first().c.verdict == verdict


def test_traverse_and_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string").withColumns({"edge_type": F.lit("related_to"), "confidence": F.lit(1.0), "ts_us": F.lit(1)})
    assert {(r.memory_id, r.depth) for r in graph.traverse(e, "a", 5).collect()} == {("b", 1), ("c", 2), ("d", 3)}
    n = spark.createDataFrame([(i,) for i in range(9)], "id long")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(5)] + [(7, 8)], "a long, b long")
    assert {(r.id, r.root) for r in graph.connected(pairs, n).collect()} == {(i, 0) for i in range(6)} | {(6, 6), (7, 7), (8, 7)}


def test_knn_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {(r.id, r.neighbour) for r in graph.knn(df, "id", "v", 3, block=16).collect()}
    d = 1 - x @ x.T
    np.fill_diagonal(d, 9)
    assert got == {(i, int(j)) for i in range(60) for j in np.argsort(d[i])[:3]}


def test_knn_of_equal_vectors_and_ties(spark):
    rng = np.random.default_rng(4)
    few = rng.integers(-1, 2, size=(12, 3)).astype(float)
    x = few[rng.integers(0, 12, 90)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    for block in (None, 4):
        got = {i: set() for i in range(90)}
        for r in graph.knn(df, "id", "v", 7, block=block).collect():
            got[r.id].add(r.neighbour)
        assert got == {i: set(sorted((j for j in range(90) if j != i), key=lambda j: (round(1 - float(x[i] @ x[j]), 9), j))[:7]) for i in range(90)}


def test_clusters_find_neighbours_once(spark):
    """cluster_by_distance reads its neighbours in one job: the costly step is not done again for the border and the components."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    n = [(i, i + 1, i / 100) for i in range(20)]
    near = spark.createDataFrame(n, "id long, neighbour long, distance double").mapInArrow(count, "id long, neighbour long, distance double")
    nodes = spark.createDataFrame([(i,) for i in range(21)], "id long")
    got = {r.id: r.cluster for r in graph.cluster_by_distance(near, nodes).collect()}
    assert got == {i: 0 if i <= 14 else -1 for i in range(21)} and seen.value == 20


def test_learned_offset_is_an_ordered_fold(spark):
    m = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.6, 0.8])], "memory_id string, assoc_embedding array<double>")
    e = spark.createDataFrame([("a", "b", "caused_by", 1.0, 1), ("b", "c", "caused_by", 1.0, 2)], "src string, dst string, edge_type string, confidence double, ts_us long")
    o = np.zeros(2)
    for d in ([-1.0, 1.0], [0.6, -0.2]):
        o = o + 0.1 * np.array(d)
        o /= np.linalg.norm(o)
    assert np.allclose(graph.learn_offsets(e, m)["caused_by"], o)


def test_partial_failure(spark):
    m = memories(spark, [{"content": "x", "entity_id": "e", "embedding": [1.0, 0.0]}])
    r = retrieve.recall(m, ["similarity", "temporal"], NOW, [1.0, 0.0], 5)
    assert list(r.errors) == ["temporal"] and r.results.count() == 1 and r.truncated() == {"similarity": False}

    def broken():
        raise RuntimeError("no model")

    r = retrieve.recall(m, ["similarity", "temporal"], NOW, broken, 5, "e")
    assert list(r.errors) == ["similarity"] and r.results.count() == 1
    with pytest.raises(RuntimeError):
        retrieve.recall(m, ["similarity"], NOW, broken, 5)


@pytest.mark.parametrize("kind", ["files", "memory"])
def test_store_round_trip(spark, tmp_path, kind):
    root = str(tmp_path / "s") if kind == "files" else MemoryTables(spark)
    s = MemoryStore.open(spark, root)
    s.remember([{"content": "cats purr", "entity_id": "pets", "importance": 0.9}, {"content": "dogs bark", "entity_id": "pets", "importance": 0.4}], NOW)
    assert s.count() == 2
    top = s.recall("cats purr", NOW + 1)[0]
    assert top["content"] == "cats purr" and top["access_count"] == 0
    again = s.get(top["memory_id"]).first()
    assert again.access_count == 1 and again.last_accessed_at == NOW + 1
    s.revise(top["memory_id"], NOW + 2, content="cats meow", context='{"a": 1}')
    now = s.get(top["memory_id"]).first()
    assert (now.content, now.kind, now.logical_clock, now.created_at) == ("cats meow", "revision", 1, NOW) and s.count() == 3
    other = MemoryStore.open(spark, root, "b")
    other.remember([{"content": "hidden"}], NOW + 3)
    assert (s.count(), other.count()) == (3, 1)
    assert s.forget(NOW + 4, entity="pets", kind="revision") == 1
    assert {r.content for r in s.memories().collect()} == {"dogs bark"} and s.edges().count() == 0
    s.set_policy(lifecycle.Policy(max_snapshots=5))
    assert s.policy().max_snapshots == 5 and other.policy().max_snapshots == 100
    s.sweep(NOW + 60 * schema.DAY_US)
    assert s.memories().first().decay_score < 0.4


def test_stale_writer_fails(spark, tmp_path):
    t = TableStore(spark, str(tmp_path / "t"))
    df = spark.range(3)
    t.commit({"a": df}, 0)
    t.commit({"b": df}, 1)
    with pytest.raises(Conflict):
        t.commit({"a": spark.range(100, 107)}, 1)
    assert t.version() == 2 and t.read("a").count() == 3 and t.read("b").count() == 3  # the winners' rows are still there
    t.commit({"a": df.limit(1)}, 2)
    assert len(t.vacuum(keep=1)) == 2 and t.read("b").count() == 3 and t.read("a").count() == 1  # the first "a", and what the loser wrote


def test_two_writers_on_one_version(spark, tmp_path):
    one, two = (TableStore(spark, str(tmp_path / "t")) for _ in range(2))
    base = one.version()
    one.commit({"a": spark.range(10)}, base)
    with pytest.raises(Conflict):
        two.commit({"a": spark.range(50, 55)}, base)
    assert [r.id for r in two.read("a").orderBy("id").collect()] == list(range(10))
    assert two.commit({}, base, {"a": spark.range(90, 92)}) == 2  # what only appends goes on top
    assert one.read("a").count() == 12 and one.read("a", 1).count() == 10


def test_recall_appends_accesses_only(spark, tmp_path):
    s, other = (MemoryStore.open(spark, str(tmp_path / "s"), t) for t in ("a", "b"))
    s.remember([{"content": "cats purr"}, {"content": "dogs bark"}], NOW)
    other.remember([{"content": "cats purr"}], NOW)
    before = s.tables.manifest()
    for k in range(3):
        s.recall("cats purr", NOW + k, k=1)
    after = s.tables.manifest()
    assert all(after[t] == parts for t, parts in before.items()) and len(after["accesses@a"]) == 3
    assert sorted((r.access_count, r.last_accessed_at) for r in s.memories().collect()) == [(0, NOW), (3, NOW + 2)]
    s.compact()
    assert s.tables.manifest()["accesses@a"] == [] and sorted(r.access_count for r in s.memories().collect()) == [0, 3]
    assert [r.access_count for r in other.memories().collect()] == [0]
    assert s.forget(NOW + 9, kind="episode") == 2 and other.tombstones().count() == 0 and other.count() == 1


def test_equal_rows_have_ids_of_their_own(spark):
    rows = [{"content": "same", "entity_id": "e"}] * 40
    assert memories(spark, rows).select("memory_id").distinct().count() == 40


def test_policy_has_effect(spark, tmp_path):
    s = MemoryStore.open(spark, str(tmp_path / "s"))
    s.remember([{"content": "v0", "memory_id": "a" * 32}], NOW)
    s.set_policy(lifecycle.Policy(max_snapshots=2, auto_forget_below=0.2, half_life_us=schema.DAY_US))
    for k in range(1, 5):
        s.revise("a" * 32, NOW + k * 1_000_000, content=f"v{k}")
    kept = s.memories().where("is_snapshot")
    assert sorted(r.content for r in kept.collect()) == ["v2", "v3"] and s.edges().count() == 2
    s.sweep(NOW + 10 * schema.DAY_US)
    assert s.get("a" * 32).first().decay_score < 0.01
    assert s.auto_forget(NOW + 10 * schema.DAY_US) >= 1 and s.count() == 0


def test_offsets_are_learnt_once_and_stored(spark, tmp_path):
    s = MemoryStore.open(spark, str(tmp_path / "s"))
    ids = [format(i, "032x") for i in range(4)]
    x = np.eye(4)
    s.remember([{"memory_id": i, "content": f"m{k}", "embedding": x[k].tolist()} for k, i in enumerate(ids)], NOW)
    s.remember([{"content": "more", "embedding": [0.5] * 4}], NOW + 1, [(ids[0], ids[1], "caused_by", 1.0)])
    s.remember([{"content": "again", "embedding": [-0.5] * 4}], NOW + 2, [(ids[1], ids[2], "caused_by", 1.0)])
    want = graph.learn_offsets(s.edges(), s.memories())
    assert np.allclose(s.offsets()["caused_by"], want["caused_by"]) and s.edges().count() == 2


def test_causal_recall_without_embedding_walks_edges(spark):
    ids = [format(i, "032x") for i in range(4)]
    m = memories(spark, [{"memory_id": i, "content": f"m{k}", "embedding": None if k == 0 else [1.0, float(k)]} for k, i in enumerate(ids)])
    e = spark.createDataFrame([("t", ids[k], ids[k + 1], "caused_by", 1.0, k) for k in range(3)], schema.EDGES)
    r = retrieve.recall(m, ["causal"], NOW, None, 5, seed_id=ids[0], edges=e, max_depth=2)
    assert {(x.memory_id, x.relevance) for x in r.results.collect()} == {(ids[1], 0.5), (ids[2], 0.0)}
    r = retrieve.recall(m, ["causal", "similarity"], NOW, [1.0, 0.0], 5, seed_id=ids[0])
    assert list(r.errors) == ["causal"] and r.results.count() > 0


def test_priming_over_stores(spark):
    one = memories(spark, [{"content": f"one {k}", "entity_id": "e", "embedding": [1.0, 0.0]} for k in range(4)])
    two = memories(spark, [{"content": "one 1", "entity_id": "e", "embedding": [1.0, 0.0]}, {"content": "two", "entity_id": "e", "embedding": [0.0, 1.0]}])
    rows = retrieve.prime_across({"a": one, "b": two}, "e", [1.0, 0.0], NOW + 1, 4).collect()
    assert len(rows) == 4 and len({r.content for r in rows}) == 4


def test_facade_subscribes_and_reflects(spark, tmp_path):
    s = MemoryStore.open(spark, str(tmp_path / "s"))
    rng = np.random.default_rng(2)
    s.remember([{"content": f"budget plan {i}", "entity_id": "e", "embedding": (np.eye(64)[i % 2] + rng.uniform(-0.1, 0.1, 64)).tolist()} for i in range(12)], NOW)
    assert s.reflect(NOW + 1, llm_api.MockProvider(), "e") >= 1 and s.insights().count() >= 1 and s.edges().where("edge_type = 'insight_from'").count() >= 6
    chunks = spark.createDataFrame([("c", "the budget", np.eye(64)[0].tolist())], "chunk_id string, chunk string, embedding array<double>")
    assert s.subscribe(chunks, least=0.5).count() >= 1


def test_links_in_code_do_not_count(spark):
    df = spark.createDataFrame([("[[A|x]] `[[no]]` #tag\n```\n[[no]] #no\n```\n[[ B#p]]",), ("```\n[[open]]",), (None,)], "t string")
    got = df.select(text.wiki_links(F.col("t")).alias("l"), text.hashtags(F.col("t")).alias("h")).collect()
    assert [tuple(r) for r in got] == [(["A", "B"], ["tag"]), ([], []), (None, None)]


def test_snippets_are_cut_by_bytes(spark):
    df = spark.createDataFrame([("abc",), ("aéé",), ("é" * 5,), (None,)], "t string")
    assert [r[0] for r in df.select(text.snippet(F.col("t"), 3)).collect()] == ["abc", "aé", "éé", None]


def test_labels_fall_back(spark):
    items = spark.createDataFrame([(0, "Budget plan"), (0, "Budget team"), (1, "Zebra")], "cluster int, label string")

    def name(labels):
        if "Zebra" in labels:
            raise RuntimeError("no model")
        return "Money"

    assert {(r.cluster, r.label) for r in reports.cluster_labels_by(items, name).collect()} == {(0, "Money"), (1, "Zebra")}


def test_limits_are_enforced(spark):
    with pytest.raises(Exception, match="above 65536 bytes"):
        memories(spark, [{"content": "x" * 70_000}]).collect()
    with pytest.raises(Exception, match="outside 0..1"):
        memories(spark, [{"content": "x", "importance": 2.0}]).collect()


NOTE = "---\ntitle: T\ntags:\n  - a\n---\nintro text that is long enough to stand alone as a section here\n\n# One\n" + "body " * 20 + "[[Link|x]] #tag `[[no]]`\n```\n# not a heading [[no]]\n```\n## Two\nshort\n## Three\n" + "more " * 20


def test_markdown():
    meta, sections = markdown.parse(NOTE)
    assert meta == {"title": "T", "tags": ["a"]}
    assert [s["heading_path"] for s in sections] == [[], ["One"], ["One", "Three"]]
    assert sections[1]["links"] == ["Link"] and sections[1]["tags"] == ["tag"]
    body, stale = markdown.read_section(NOTE, sections[1]["start"], sections[1]["stop"])
    assert body.startswith("body body") and not stale
    assert markdown.read_section("x", 0, 99) == ("", True)
    assert markdown.front_matter("---\nnot yaml\n---\nx") == ({}, 0)


def test_scan_and_ingest(spark, tmp_path):
    (tmp_path / "v/.hidden").mkdir(parents=True)
    (tmp_path / "v/sub").mkdir()
    (tmp_path / "v/a.md").write_text(NOTE)
    (tmp_path / "v/sub/b.md").write_text("# B\n" + "text " * 30)
    (tmp_path / "v/.hidden/c.md").write_text("no")
    notes = markdown.scan(spark, str(tmp_path / "v"))
    assert {r.file_path for r in notes.collect()} == {"a.md", "sub/b.md"}
    sections = markdown.parsed(notes)
    assert sections.count() == 4
    old = spark.createDataFrame([], "file_path string, heading_path array<string>, section_id string, section_hash string")
    first = ingest.section_diff(old, sections)
    assert {r.state for r in first.collect()} == {"stale"}
    again = ingest.section_diff(first, sections)
    assert {r.state for r in again.collect()} == {"synced"}
    assert ingest.mark_synced(ingest.orphan_file(first, "a.md"), sections).where("file_path = 'a.md'").count() == 0
    asked = ingest.extract(ingest.requests(notes), llm_api.MockProvider())
    props = ingest.propositions(asked)
    assert props.count() == 2 and ingest.documents(notes).count() == 2
    rows = spark.createDataFrame([("f", 0, "m1", "Ann met Bob"), ("f", 1, "m2", "bob left")], "file_path string, pos int, memory_id string, content string")
    rel = spark.createDataFrame([("f", "Ann", "Bob", "knows"), ("f", "left", "Ann", "x")], "file_path string, source string, target string, type string")
    assert [(r.src, r.dst) for r in ingest.mention_edges(rows, rel).collect()] == [("m2", "m1")]


def test_watcher_events(spark):
    ev = spark.createDataFrame([("a", "created", 0), ("a", "deleted", 100), ("b", "deleted", 0), ("b", "created", 100), ("c", "modified", 0), ("c", "modified", 9_000_000)], "file_path string, kind string, ts_us long")
    assert sorted((r.file_path, r.kind) for r in ingest.coalesce_events(ev).collect()) == [("b", "modified"), ("c", "modified"), ("c", "modified")]


def test_clusters_are_found():
    rng = np.random.default_rng(1)
    x = np.concatenate([np.eye(16)[c] + rng.uniform(-0.15, 0.15, size=(10, 16)) for c in range(4)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = reflect.cluster(x)
    assert len(set(label)) == 4 and all(len(set(label[i : i + 10])) == 1 for i in range(0, 40, 10))
    assert reflect.cluster(x[:2]).tolist() == [-1, -1] and len(reflect.cluster(x[:0])) == 0


def test_reflection(spark):
    rng = np.random.default_rng(2)
    rows = [{"content": f"m{i}", "entity_id": "e", "embedding": (np.eye(8)[i % 2] + rng.uniform(-0.1, 0.1, 8)).tolist(), "memory_id": format(i, "032x")} for i in range(12)]
    m = memories(spark, rows)
    session = reflect.prepare(m, NOW)
    found = [reflect.Insight("x", 0.8, (session.clusters[0][0],))]
    assert reflect.commit(session, found, NOW + 1) == found
    with pytest.raises(schema.InvalidInput):
        reflect.commit(session, found, NOW + 2)
    scoped = [(r.memory_id, r.content, r.embedding) for r in reflect.scope(m).collect()]
    made = reflect.propose(scoped, llm_api.MockProvider())
    new, links = reflect.insight_rows(m, made, NOW)
    assert new.count() >= 1 and links.count() >= 6 and new.first().entity_id == "e"
    c = reflect.set_cursor(spark.createDataFrame([("e", 1)], "entity_id string, cursor_us long"), 5, "e")
    assert [(r.entity_id, r.cursor_us) for r in c.collect()] == [("e", 5)]
    s = reflect.Schedule()
    s.ran(NOW)
    s.wrote(50)
    assert s.due(NOW + 1)


def test_contradiction_queue(spark):
    found = spark.createDataFrame([("a", "b", 0.9, "it is reliable", "it is unreliable")], "id_a string, id_b string, similarity double, content_a string, content_b string")
    q = contradict.pending(found, NOW)
    none = spark.createDataFrame([], schema.EDGES)
    left, edges = contradict.commit(q, none, q.select("pending_id", F.lit("contradiction").alias("verdict"), F.lit(0.9).alias("confidence")), NOW)
    assert left.count() == 0 and {(r.src, r.dst) for r in edges.collect()} == {("a", "b"), ("b", "a")}
    with pytest.raises(schema.InvalidInput):
        contradict.commit(q, none, spark.createDataFrame([("nope", "dismiss", 0.1)], "pending_id string, verdict string, confidence double"), NOW)


@pytest.mark.parametrize("n", [1, 2, 7, 100, 101])
def test_percentile_is_exact(spark, n):
    values = [(i * 7919) % 10_007 - 50 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for p in (0.0, 0.5, 0.99):
        assert querylog.percentile(df, "x", p, ways=16) == sorted(values)[min(math.ceil(p * n), n - 1)]
    assert querylog.percentile(df.limit(0), "x", 0.5) is None


def test_reports(spark):
    items = spark.createDataFrame([(0, "Budget plan"), (0, "Budget team"), (0, "the Plan"), (1, "Zebra"), (-1, "x y")], "cluster int, label string")
    assert {(r.cluster, r.label) for r in reports.cluster_labels(items).collect()} == {(0, "Budget & Plan"), (1, "Zebra")}
    empty = spark.createDataFrame([], "state string, file_path string")
    assert reports.status(empty).first().code == "empty"


def test_embedders(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "t string").select(embed.hash_embedding(F.col("t"), 16).alias("e"))
    a, b, c = (np.array(r.e) for r in df.collect())
    assert (a == b).all() and abs(np.linalg.norm(a) - 1) < 1e-9 and abs(a @ c) < 0.99

    class Length:
        dimensions = 2

        def embed_batch(self, texts):
            return [[len(t), 1.0] for t in texts]

    assert embed.with_embeddings(spark.createDataFrame([("abc",)], "t string"), "t", Length()).first().embedding == pytest.approx([3 / 10**0.5, 1 / 10**0.5])
    assert np.allclose(embed.pool(np.ones((1, 3, 2)), np.array([[1, 1, 0]])), [[0.5**0.5, 0.5**0.5]])


def test_frames(spark):
    rows = [b"", b"123456789", b"x" * 1000, bytes(range(256)), None]
    df = spark.createDataFrame([(r,) for r in rows], "b binary")
    got = df.select(framing.crc32c(F.col("b")).alias("c"), framing.frame(F.col("b")).alias("f")).collect()
    assert [r.c for r in got][:2] == [0, 0xE3069283] and got[4].c is None
    assert bytes(got[1].f) == b"\x01123456789" + (0xE3069283).to_bytes(4, "little")
    broken = [bytes(r.f[:-1]) + b"\x00" for r in got[1:4]]
    back = spark.createDataFrame([(bytes(r.f),) for r in got[1:4]] + [(x,) for x in broken] + [(b"\x00plain",), (b"old",), (b"",)], "f binary").select(framing.unframe(F.col("f")).alias("u")).collect()
    assert [bytes(r.u.payload) for r in back[:3]] == rows[1:4] and [r.u.ok for r in back] == [True] * 3 + [False] * 3 + [True, True, False]
    assert bytes(back[6].u.payload) == b"plain" and bytes(back[7].u.payload) == b"old"


def test_services_over_http():
    import urllib.error

    asked, fails = [], [2]

    def post(url, headers, body):
        asked.append(body)
        if fails[0]:
            fails[0] -= 1
            raise urllib.error.URLError("down")
        if "input" in body:
            return {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
        text = json.dumps({"insights": [{"content": "c", "sources": ["a"]}], "verdict": "accepted", "confidence": 0.7})
        return {"content": [{"text": text}], "choices": [{"message": {"content": "``` " + text + " ```"}}], "candidates": [{"content": {"parts": [{"text": text}]}}], "response": text}

    for style in llm_api.STYLES:
        p = llm_api.HttpProvider("http://here", "m", style, post=post)
        assert p.propose([("a", "one")]) == [{"content": "c", "confidence": 0.5, "sources": ["a"], "tags": []}]
        assert p.validate("c", [])["verdict"] == "accepted"
    assert embed.HttpEmbedder("http://here", "m", 2, post=post).embed_batch(["a", "bcd"]) == [[1.0, 1.0], [3.0, 1.0]]
    with pytest.raises(ValueError):
        embed.HttpEmbedder("http://here", "m", 3, post=post).embed_batch(["a"])
    assert llm_api.complete_parallel(llm_api.MockProvider(), [str(i) for i in range(20)], 3) == llm_api.complete_batch(llm_api.MockProvider(), [str(i) for i in range(20)])
    assert len(llm_api.within_budget([("a" * 32, "x" * 100)] * 50, 100)) == 2


def test_classification_by_a_provider_falls_back(spark):
    class Half:
        def complete(self, prompt):
            return '{"verdict": "Contradiction", "confidence": 0.9}' if "first" in prompt else "I can not tell"

    pairs = spark.createDataFrame([("first", "other"), ("it is reliable", "it is unreliable")], "content_a string, content_b string")
    got = {r.content_a: r for r in contradict.classify_by(pairs, Half()).collect()}
    want = {r.content_a: r for r in contradict.classify_pairs(pairs).collect()}
    assert (got["first"].verdict, got["first"].confidence) == ("contradiction", 0.9)
    assert (got["it is reliable"].verdict, got["it is reliable"].confidence) == (want["it is reliable"].verdict, want["it is reliable"].confidence)


def test_phase_two_and_rebuild(spark):
    notes = spark.createDataFrame([("a.md", "# A\n" + "ann met bob. " * 10), ("b.md", "# B\n" + "nothing else " * 10)], "file_path string, content string")
    sections = markdown.parsed(notes)
    first = ingest.rebuild(notes, sections, llm_api.MockProvider())
    rows = first.rows.collect()
    assert sorted(r.kind for r in rows) == ["document", "document", "proposition", "proposition"]
    assert {r.state for r in first.sections.collect()} == {"synced"} and first.dropped.count() == 0
    assert {r.edge_type for r in first.edges.collect()} == {"proposition_of"} and first.edges.count() == 2
    stored = spark.createDataFrame([(r.entity_id, spark.createDataFrame([(r.content,)], "c string").select(text.proposition_hash(F.col("c"))).first()[0], r.memory_id) for r in rows if r.kind == "proposition"], "file_path string, hash string, memory_id string")
    changed = spark.createDataFrame([("a.md", "# A\n" + "carl left. " * 10), ("b.md", "# B\n" + "nothing else " * 10)], "file_path string, content string")
    second = ingest.phase2(changed, ingest.section_diff(first.sections, markdown.parsed(changed)), stored, llm_api.MockProvider())
    assert {r.entity_id for r in second.rows.collect()} == {"a.md"} and second.dropped.count() == 1


def test_metrics_text(spark):
    log = spark.createDataFrame([("recall", 500), ("recall", 20_000)], "operation string, latency_us long")
    lines = reports.exposition(reports.metrics(log, spark.createDataFrame([("episode",)], "kind string"))).splitlines()
    assert 'engram_memories{kind="episode"} 1' in lines and 'engram_operation_duration_seconds_bucket{operation="recall",le="0.001"} 1' in lines
    assert 'engram_operation_duration_seconds_bucket{operation="recall",le="+Inf"} 2' in lines and 'engram_operation_duration_seconds_sum{operation="recall"} 0.0205' in lines


def test_subscription_registry(spark):
    held = spark.createDataFrame([("a",)], "subscription string")
    assert subscribe.open_subscription(held, spark.createDataFrame([("b",)], "subscription string"), 2).count() == 2
    for new, most in (("a", 5), ("b", 1)):
        with pytest.raises(schema.InvalidInput):
            subscribe.open_subscription(held, spark.createDataFrame([(new,)], "subscription string"), most)
    assert subscribe.refresh_due(0, 0, 60_000_000) and subscribe.refresh_due(0, 100, 1) and not subscribe.refresh_due(0, 99, 1)
    pushed = spark.createDataFrame([("a", "m"), ("b", "m")], "subscription string, memory_id string")
    assert [r.subscription for r in subscribe.reset_dedup(pushed, "a").collect()] == ["b"]
    chunks = spark.createDataFrame([("a", 1, "budget plan", [1.0, 0.0]), ("a", 2, "zzz", [1.0, 0.0]), ("b", 3, "the budget", [0.0, 1.0])], "subscription string, chunk_id int, chunk string, embedding array<double>")
    staged = subscribe.stages(chunks, spark.createDataFrame([("budget",)], "word string"), [1.0, 0.0])
    got = {r.subscription: r for r in subscribe.stats(staged, spark.createDataFrame([("a", "m", 1), ("c", "m", 1)], "subscription string, memory_id string, ts_us long")).collect()}
    assert tuple(got["a"])[1:] == (2, 1, 0, 1, 0) and tuple(got["b"])[1:] == (1, 0, 1, 0, 0) and tuple(got["c"])[1:] == (0, 0, 0, 1, 0)


def test_service():
    limit = service.RateLimiter({"read": (1, 2)})
    assert [limit.allow("t", "read", NOW) for _ in range(3)] == [True, True, False] and limit.allow("t", "read", NOW + 1_000_000)
    key, held = service.generate_key()
    assert service.hash_key(key) == held
    with pytest.raises(schema.InvalidInput):
        service.authorize(service.READ, service.WRITE)


def test_layout_is_stable():
    x = np.eye(8)
    assert np.array_equal(graph.project_2d(x, epochs=5), graph.project_2d(x, epochs=5)) and np.abs(graph.project_2d(x, epochs=5)).max() <= 200
