"""The pipeline against a brute-force version of every stage, and on rows without ids."""

import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_decontaminate import holds

import corpus_pipeline as c
from engram.llm import bpe, language_id, secret_scan, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})


def roots(texts):
    """For each text the place of the first that links of similarity 0.8 or more reach."""
    sets = [set(simhash.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


def test_stages_are_brute_force(spark, data, encoding):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(*c.COLUMNS)
    model = language_id.fit(docs, "text", "lang")
    left = []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        if r.text and language_id.has_letter(r.text):
            (_,), (score,) = model.predict([r.text])
            if score >= c.MIN_LANGUAGE:
                left.append((r.doc_id, r.text))
    root = roots([t for _, t in left])
    left = [x for k, x in enumerate(left) if root[k] == k]
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    left = [(i, t) for i, t in left if not any(holds(t, x) for x in items)]
    kept = spark.createDataFrame(left, "doc_id long, text string")
    spans = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] for r in secret_scan.scan(kept, "doc_id", "text").collect()}

    def redact(i, t):
        out, at = [], 0
        for a, b in sorted(spans[i]):
            out += [t[at:a], "[SECRET]"] if a >= at else []
            at = max(at, b)
        return "".join([*out, t[at:]])

    want = {i: encoding.encode_ordinary(redact(i, t)) for i, t in left}
    got = {r.doc_id: r for r in c.run(spark, data).collect()}
    assert {i: r.ids for i, r in got.items()} == want
    for i, r in got.items():
        assert (r.n_tokens, r.decoded_sha256) == (len(want[i]), hashlib.sha256(encoding.decode_bytes(want[i])).hexdigest())
        assert not re.search("AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", encoding.decode(want[i]))


def words(tag, n=60):
    return " ".join(f"{tag}word{k}" for k in range(n))


def test_rows_without_ids(spark, tmp_path):
    near = words("near").replace("nearword59", "other")
    rows = [(1, words("a")), (None, words("a")), (None, words("b")), (None, words("b")), (None, words("near")), (7, near), (None, words("c")), (None, f"x {words('item', 20)} y"), (3, words("d")), (3, words("d")), (3, words("e")), (9, words("e"))]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).withColumn("key", F.lit(1))
    spark.createDataFrame([(1, words("item", 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    once = c.dedup_stage(spark, docs, str(tmp_path))
    want = {(1, words("a")), (None, words("b")), (7, near), (None, words("c")), (None, rows[7][1]), (3, words("d")), (3, words("e"))}
    assert {(r.doc_id, r.text) for r in once.collect()} == want and once.count() == len(want)
    clean = c.decontaminate_stage(spark, once, str(tmp_path))
    assert {(r.doc_id, r.text) for r in clean.collect()} == want - {(None, rows[7][1])}
    assert clean.columns == list(c.COLUMNS)


def test_odd_rows(spark, tmp_path):
    folder = str(tmp_path / "odd")
    long = "Der schnelle braune Fuchs springt ueber den faulen Hund und noch viel weiter. " * 30
    rows = [(1, long, "de", "s", 5), (1, long, "de", "s", 5), (2, long, "de", "s", 5), (None, "ein Text ohne Nummer aber mit vielen Worten darin", None, None, None), (3, None, "de", "s", 0), (4, "", None, "s", 0), (5, "the other language has other words in it " * 9, "en", None, None)]
    spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit(9)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert sorted((r.doc_id or -1) for r in c.run(spark, folder).collect()) == [-1, 1, 5]
    none = str(tmp_path / "none")
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{none}/{t}.parquet")
    assert c.run(spark, none).count() == 0
