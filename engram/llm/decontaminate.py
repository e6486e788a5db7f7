"""Benchmark decontamination by spaced-seed hashing. DataFrame functions only.

Texts are lower-cased and cut into runs of letters and digits. A seed is the hash of some of 9 tokens, chosen by a fixed mask that
ignores the others. Documents and benchmark items have seeds at every token. Seeds are joined; around each hit the aligned tokens of
document and item, from 8 before to 15 behind, are compared, and a document holds an item if 11 of some 13 successive ones
are equal (for an item of 9 to 12 tokens: four fifths of all of it, rounded up). The three masks are chosen so that every
such overlap shares a seed, wherever the substituted tokens and the passage stand (by enumeration, see the tests), so the recall of what the rule accepts is 1.
Items of fewer than 9 tokens have one seed, the hash of all their tokens, and are held where these stand in a row.

Long texts are cut into blocks of 256 places before windows are made, so no row holds the windows of a whole text. The benchmark's seeds are
broadcast if it has at most `broadcast_tokens` tokens, which bounds them to about 100 MB; beyond that both sides are shuffled by seed,
the documents' as (block, place) only, and blocks are fetched again for what the join has found.

Cases: null and empty texts hold nothing, items without a token are held by none; empty tables: no hit. Rows with one id, null
included, share their hits; repeated rows stay. Ties do not matter: all items that a document holds are listed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm._common import materialize

SPAN = 9
MASKS = ((0, 5, 6, 7), (1, 3, 5, 8), (1, 3, 6, 8))
BEFORE, BEHIND = 8, 16
STRETCH, EQUAL, SHARE = 13, 11, 0.8
BLOCK = 256
BROADCAST_TOKENS = 120_000


def token_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def tokens_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t): the tokens of each row, as hashes. They are made by a generator of one row, as filters on their number would else be moved below
    and cut the text a second time."""
    return df.select(F.col(id_col).alias("id"), F.explode(F.array(token_hashes(F.col(text_col)))).alias("t"))


def blocks(tokens: DataFrame) -> DataFrame:
    """(id, n, places, block): successive places of a text, BLOCK at most, and their tokens from BEFORE the first to BEHIND the last,
    null beyond the text; n is of the text."""
    none = F.lit(None).cast("long")
    padded = tokens.where(F.size("t") >= SPAN).select("id", F.size("t").alias("n"), F.concat(F.array_repeat(none, BEFORE), F.col("t"), F.array_repeat(none, BEHIND)).alias("p"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - SPAN, F.lit(BLOCK)), lambda s: F.struct(F.least(F.lit(BLOCK), F.col("n") - SPAN + 1 - s).alias("places"), F.slice(F.col("p"), s + 1, BLOCK + BEFORE + BEHIND - 1).alias("block")))
    return padded.select("id", "n", F.explode(cut).alias("b")).select("id", "n", "b.places", "b.block")


def window(block: Column, k: Column) -> Column:
    """Tokens around place k (from 1) of a block."""
    return F.slice(block, k, BEFORE + BEHIND)


def seeded(cut: DataFrame) -> DataFrame:
    """(columns of cut, place, seed) for every place of a block, from 1, and every mask. The tokens that masks look at are laid side by side, so that
    places are made, hashed and joined in generated code; the block is only passed on."""
    seen = sorted({i for mask in MASKS for i in mask})
    beside = F.arrays_zip(F.sequence(F.lit(1), F.col("places")), *(F.slice("block", F.lit(BEFORE + 1 + i), F.col("places")) for i in seen))
    names = {i: f"t{i}" for i in seen}
    each = cut.select(*cut.columns, F.inline(beside).alias("place", *names.values()))
    seeds = F.array(*(F.xxhash64(F.lit(m), *(F.col(names[i]) for i in mask)) for m, mask in enumerate(MASKS)))
    return each.select(*cut.columns, "place", F.explode(seeds).alias("seed"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def overlap(ours: Column, theirs: Column, n: Column) -> Column:
    """Whether enough of the aligned tokens agree, for an item of n tokens."""
    starts = F.sequence(F.lit(1), F.lit(BEFORE + BEHIND - STRETCH + 1))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    enough = lambda same: F.when(n < STRETCH, total(same) >= F.ceil(n * SHARE)).otherwise(F.exists(starts, lambda s: total(F.slice(same, s, STRETCH)) >= EQUAL))
    return _let(F.zip_with(ours, theirs, lambda a, b: F.when(a == b, 1).otherwise(0)), enough)


def _runs(tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, seed): the hash of each run of so many successive tokens."""
    longest = max(sizes)
    cut = F.transform(F.sequence(F.lit(1), F.size("t"), F.lit(BLOCK)), lambda s: F.slice(F.col("t"), s, BLOCK + longest - 1))
    part = tokens.where(F.size("t") > 0).select("id", F.explode(cut).alias("b"))

    def of(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size("b") - n + 1), lambda k: F.xxhash64(F.lit(n), F.slice(F.col("b"), k, n)))
        return F.when(F.size("b") >= n, made).otherwise(F.array().cast("array<bigint>"))

    every = F.flatten(F.array(*map(of, sizes)))
    return part.select("id", F.explode(F.array_distinct(every)).alias("seed"))


def hits(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(id, item) of every document and benchmark item that it holds, once each."""
    ours, theirs = tokens_of(docs, id_col, text_col), tokens_of(items, item_id, item_text)
    sizes = {r["n"]: r["count"] for r in theirs.groupBy(F.least(F.size("t"), F.lit(SPAN)).alias("n")).count().collect()}  # at most 10 rows
    total = theirs.agg(F.coalesce(F.sum(F.size("t")), F.lit(0))).first()[0] if sizes else 0
    small = total <= broadcast_tokens
    hint = F.broadcast if small else lambda x: x
    item_seeds = seeded(blocks(theirs)).select("seed", F.col("id").alias("item"), F.col("n").alias("item_n"), window(F.col("block"), F.col("place")).alias("item_win")).distinct()
    ok = overlap(window(F.col("block"), F.col("place")), F.col("item_win"), F.col("item_n"))
    if small:
        found = seeded(blocks(ours)).select("id", "block", "place", "seed").join(hint(item_seeds), "seed").where(ok).select("id", "item")
    else:
        cut = materialize(blocks(ours).withColumn("key", F.monotonically_increasing_id()), "blocks")
        met = materialize(seeded(cut).select("key", "place", "seed").join(item_seeds.select("seed").distinct(), "seed", "left_semi"), "met")
        found = met.join(cut.select("key", "id", "block"), "key").select("id", "seed", "block", "place").join(item_seeds, "seed").where(ok).select("id", "item")
    short = sorted(n for n in sizes if 0 < n < SPAN)
    if short:
        whole = theirs.where(F.size("t").isin(short)).select(F.col("id").alias("item"), F.xxhash64(F.size("t"), F.col("t")).alias("seed")).distinct()
        found = found.unionByName(_runs(ours, short).join(hint(whole), "seed").select("id", "item"))
    return found.distinct()


def contamination(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """One row for each row of docs: id, contaminated, n_items, items (ids in order, joined by commas)."""
    held = hits(docs, id_col, text_col, items, item_id, item_text, broadcast_tokens)
    by = held.groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = docs.select(F.col(id_col).alias("doc")).join(by, F.col("doc").eqNullSafe(F.col("id")), "left")
    return out.select(
        F.col("doc").alias(id_col),
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("items"),
    )


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_SAME = "list_transform(range(-8, 16), lambda k: CASE WHEN p + k >= 0 AND q + k >= 0 AND coalesce(w[p + k + 1] = v[q + k + 1], false) THEN 1 ELSE 0 END)"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS s, item_id, {_WORDS} AS v FROM benchmark),
dp AS (SELECT r, unnest(range(0, len(w) - 8)) AS p, unnest(list_transform(range(0, len(w) - 8), lambda i: w[i + 1:i + 9])) AS g FROM d WHERE len(w) >= 9),
bq AS (SELECT s, unnest(range(0, len(v) - 8)) AS q, unnest(list_transform(range(0, len(v) - 8), lambda i: v[i + 1:i + 9])) AS g FROM b WHERE len(v) >= 9),
ds AS ({" UNION ALL ".join(f"SELECT r, p, {k} AS m, concat_ws(' ', {', '.join(f'g[{i + 1}]' for i in mask)}) AS seed FROM dp" for k, mask in enumerate(MASKS))}),
bs AS ({" UNION ALL ".join(f"SELECT s, q, {k} AS m, concat_ws(' ', {', '.join(f'g[{i + 1}]' for i in mask)}) AS seed FROM bq" for k, mask in enumerate(MASKS))}),
a AS (SELECT DISTINCT r, p, s, q FROM ds JOIN bs USING (m, seed)),
c AS (SELECT doc_id, item_id, len(v) AS n, {_SAME} AS same FROM a JOIN d USING (r) JOIN b USING (s)),
h AS (SELECT doc_id, item_id FROM c WHERE CASE WHEN n < 13 THEN list_sum(same) >= ceil(n * 0.8) ELSE len(list_filter(range(1, 13), lambda s: list_sum(same[s:s + 12]) >= 11)) > 0 END
  UNION SELECT doc_id, item_id FROM d JOIN b ON len(v) BETWEEN 1 AND 8 AND len(w) >= len(v) AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(v, ' ') || ' ')),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, g.items IS NOT NULL AS contaminated, coalesce(g.n_items, 0)::BIGINT AS n_items, coalesce(g.items, '') AS items
FROM d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id
"""
