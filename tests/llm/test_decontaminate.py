"""Decontamination against its rule applied to every alignment, and its SQL."""

import itertools
import math
import re

import pytest

from engram.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def holds(text, item):
    """The rule itself, at every alignment of document and item."""
    w, v = words(text), words(item)
    n = len(v)
    if not v:
        return False
    if n < d.SPAN:
        return any(w[k : k + n] == v for k in range(len(w) - n + 1))
    for shift in range(-n, len(w)):  # the item's first token stands at `shift`
        same = [int(0 <= shift + j < len(w) and w[shift + j] == x) for j, x in enumerate(v)]
        if n < d.STRETCH:
            if sum(same) >= math.ceil(n * d.SHARE):
                return True
        elif any(sum(same[k : k + d.STRETCH]) >= d.EQUAL for k in range(n - d.STRETCH + 1)):
            return True
    return False


@pytest.mark.parametrize("n", [9, 10, 11, 12, 13, 14, 15])
def test_masks_find_all_that_the_rule_accepts(n):
    need = math.ceil(n * d.SHARE) if n < d.STRETCH else n - (d.STRETCH - d.EQUAL)
    for k in range(n - need + 1):
        for lost in itertools.combinations(range(n), k):
            assert any(not any(p + i in lost for i in mask) for p in range(n - d.SPAN + 1) for mask in d.MASKS), (n, lost)


def cases():
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(1, 19)] + [(19, None), (20, "?!")]
    rows = []
    for n in (1, 2, 5, 8, 9, 10, 11, 12, 13, 14, 17):
        own = words(items[n - 1][1])
        for lost in [(), *itertools.combinations(range(n), 1), *itertools.islice(itertools.combinations(range(n), 2), 0, None, 3), *itertools.islice(itertools.combinations(range(n), 3), 0, None, 29)]:
            before = len(rows) % 4
            rows.append((len(rows), ", ".join(["x"] * before + [f"o{k}" if k in lost else w for k, w in enumerate(own)] + ["Y"] * (len(rows) % 3))))
    rows += [(len(rows) + k, " ".join(f"z{j}" for j in range(700 + k)) + " " + items[15][1] + " end" * 300) for k in range(12)]  # over the edges of blocks
    return items, [*rows, (None, items[12][1]), (None, "clean"), (-1, None), (-2, "")]


def test_hits_are_the_rule(spark):
    items, rows = cases()
    want = {(i, k) for i, text in rows for k, item in items if holds(text, item)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.id, r.item) for r in d.hits(docs, "doc_id", "text", bench, "item_id", "text").collect()} == want
    assert {(r.id, r.item) for r in d.hits(docs, "doc_id", "text", bench, "item_id", "text", broadcast_tokens=0).collect()} == want


def test_sql_is_the_query(spark):
    import duckdb

    items, rows = cases()
    con = duckdb.connect()
    for name, schema, data in (("documents", "doc_id BIGINT, text VARCHAR", rows[:-4] + rows[-2:]), ("benchmark", "item_id BIGINT, text VARCHAR", items)):
        con.execute(f"create table {name} ({schema})")
        con.executemany(f"insert into {name} values (?, ?)", data)
    docs = spark.createDataFrame(rows[:-4] + rows[-2:], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, d.contamination(docs, "doc_id", "text", bench, "item_id", "text").collect())) == sorted(con.execute(d.SQL).fetchall())
