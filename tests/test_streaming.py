import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.streaming import subscribe


def test_chunks_from_a_stream(spark, tmp_path):
    rows = [("s", "text", "one two three", 1), ("s", "text", " ".join(f"w{i}" for i in range(12)), 2), ("s", "text", "four five", 3), ("t", "text", "a b c d", 1), ("t", "flush", None, 2), ("u", "pause", None, 1), ("u", "text", "lost words here now", 2), ("u", "flush", None, 3)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "subscription string, kind string, text string, ts_us long").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("subscription string, kind string, text string, ts_us long").parquet(source)
    q = subscribe.accumulate(stream).writeStream.format("memory").queryName("chunks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    import time

    for _ in range(120):  # a query with timeouts never runs out of batches by itself
        if spark.table("chunks").count() >= 2:
            break
        time.sleep(0.5)
    q.stop()
    got = {(r.subscription, r.reason, len(r.chunk.split())) for r in spark.table("chunks").collect()}
    assert got == {("s", "tokens", 15), ("t", "flush", 4)}


def test_bloom_has_no_false_negatives():
    words = [f"word{i}" for i in range(500)]
    bits, k = subscribe.bloom(words)
    assert all(subscribe.bloom_has(bits, k, w) for w in words)
    assert sum(subscribe.bloom_has(bits, k, f"other{i}") for i in range(2000)) < 60


def test_ring_and_dedup(spark):
    p = spark.createDataFrame([("s", f"m{i}", i) for i in range(5)], "subscription string, memory_id string, ts_us long")
    r = subscribe.ring(p, 2).collect()
    assert {x.memory_id for x in r} == {"m3", "m4"} and {x.dropped for x in r} == {3}
    assert subscribe.not_pushed(p, p.where("memory_id = 'm1'")).count() == 4


@pytest.mark.parametrize("centre", [[], [1.0, 0.0]])
def test_three_stages(spark, centre):
    m = spark.createDataFrame([("a", "tea party", "episode", [1.0, 0.0]), ("b", "coffee", "document", [1.0, 0.0]), ("c", "tea", "episode", [0.0, 1.0])], "memory_id string, content string, kind string, embedding array<double>").withColumn("entity_id", F.lit("e"))
    chunks = spark.createDataFrame([(1, "more tea please", [1.0, 0.0]), (2, "nothing known", [1.0, 0.0])], "chunk_id long, chunk string, embedding array<double>")
    got = subscribe.matches(chunks, m, subscribe.scope_keywords(m), centre).collect()
    assert [(r.chunk_id, r.memory_id, r.confidence) for r in got] == [(1, "a", 1.0)]
    assert np.allclose(subscribe.centroid(m.where("memory_id <> 'b'")), [0.5**0.5, 0.5**0.5])


def test_nearest_of_many_equal_vectors_makes_small_tiles(spark):
    """A scope whose rows share few vectors meets a chunk once for each of them; ties go to smaller ids, over blocks too."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(7, 4))
    scope = spark.createDataFrame([(f"m{i:03d}", v[i % 7].tolist()) for i in range(300)], "memory_id string, embedding array<double>")
    c = np.vstack([rng.normal(size=(20, 4)), np.zeros((1, 4))])
    chunks = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "chunk_id long, embedding array<double>")
    for block in (None, 3):
        df = subscribe.nearest(chunks, scope, 50, block)
        got = {i: [] for i in range(21)}
        for r in df.collect():
            got[r.chunk_id].append(r.memory_id)
        for i, x in enumerate(c):
            want = sorted(range(300), key=lambda j: (round(1 - float(x @ v[j % 7]), 9), j))[:50]
            assert sorted(got[i]) == sorted(f"m{j:03d}" for j in want)


def test_nearest_rows_of_a_tile_are_bounded():
    """The products held at once do not grow with the rows of a tile."""
    import tracemalloc

    from engram.operators.exact import best_of

    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(3000, 8)), rng.normal(size=(30_000, 8))
    tracemalloc.start()
    rows, cols, _ = best_of(a, b, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == 15_000 and most < 200e6  # all products: 720 MB
    assert set(cols[:5]) == set(np.argsort(1 - b @ a[0])[:5])
