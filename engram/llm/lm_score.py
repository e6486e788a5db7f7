"""Language-model scores: a probabilistic suffix tree over words, beside its root, a unigram base.

Texts are lower-cased (A-Z); symbols are the words between ASCII white space, and one end for each text, which also stands before its
first word. A context is the one, two, ... `DEPTH` symbols before a place, never from before the text. It is retained as a state if the
distribution of what follows it diverges from that of its parent (the context without its first symbol) by more than chance does: the
training symbols after it gain over `MIN_GAIN` nats against the parent's distribution when each is predicted from all the others
(leave-one-out), so that sparse contexts, which always diverge by counts alone, do not pass. Only retained states are expanded. The
next-symbol distribution of a state is smoothed by Witten and Bell towards its parent's: (count + kinds * parent) / (n + kinds), down to
the root, (count + 1) / (N + V + 1). A text is scored from the state of the longest retained suffix of each place.

Counts are of all training texts; there is no least share and no bound on states, which live in tables: batches of texts send each of their distinct words, and
later each distinct pair of context and next symbol, once with its training count to a bucket chosen by its 64-bit hash; the bucket sends the
totals back. Neither words nor states come to the driver, and none is joined with the documents that hold it, so frequent words are no hot
keys. A context of over `hot` training places is dealt out over several buckets by its next symbols, which sum its test in parts; at
most N / hot contexts are so, 100,000 at any size, and only their sums come to the driver. Two words of one hash would
count as one; at 10^10 words 3 such pairs are expected. Next symbols within one context are told apart by 32 bits of their hash.

Cases: null and empty texts have one token, the end; no training text: base counts are 0 and there is no state but the root; null ids and
repeated rows are rows like others; ids come back as they were; bytes that are not UTF-8 count as the replacement character.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm._common import bucketed, materialize, release, valid

DEPTH = 2
#: Nats that a state must save on the training places that it stands for.
MIN_GAIN = 8.0
BATCH_BYTES = 5_000_000
BUCKET_BYTES = 8_000_000
#: Training places of a context from which it is dealt out over several buckets, at least.
HOT = 1_000_000
_END = xxhash.xxh64_intdigest(b" ", 0)  # no word holds a blank
_ODD = np.uint64(0x9E3779B97F4A7C15)


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[bytes], list[bool]]]:
    """(ids, lowered texts, training flags) of successive rows, of about `limit` bytes."""
    ids, texts, train, size = [], [], [], 0
    for batch in batches:
        for i, text, t in zip(*batch.columns, strict=True):
            ids.append(i.as_py())
            texts.append(lowered(text.as_py() or ""))
            train.append(bool(t.as_py()))
            size += len(texts[-1]) + 16
            if size >= limit:
                yield ids, texts, train
                ids, texts, train, size = [], [], [], 0
    if ids:
        yield ids, texts, train


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs of hashes."""
    x = (a ^ (a >> np.uint64(31))) * _ODD + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ascends with the hash."""
    return (hashes >> np.uint64(33)).astype(np.int64) * buckets >> 31


def _pack(a: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(a.astype(kind).tobytes(), 1)


def _pack_hashes(h: np.ndarray) -> bytes:
    """Hashes that mostly ascend: differences, byte by byte of all of them, so that the high bytes, which are mostly 0, take no room."""
    d = h.astype("<u8")
    d[1:] -= h[:-1]
    return zstandard.compress(d.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack_hashes(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


class Pairs:
    """The distinct pairs of context and next symbol of a batch: by number, and in the order in which buckets get them."""

    def __init__(self, batch: Batch, places: np.ndarray, buckets: int, hot: int):
        """places: those of the batch whose context is asked for."""
        self.places = places
        symbol = batch.symbols[places]
        key = batch.before[places].astype(np.int64) * len(batch.hashes) + symbol
        order = np.argsort(key)
        key = key[order]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        del key
        self.number = np.empty(len(order), dtype=np.int32)  # of the pair at each of the places
        self.number[order] = np.cumsum(fresh, dtype=np.int32) - 1
        at = order[fresh]
        del order, fresh
        word, at_place = batch.hashes[symbol[at]], places[at]
        del symbol, at
        context = batch.grams[batch.before[at_place]]
        self.n, self.parent, self.gram = batch.before_count[at_place], batch.share[at_place], mix(context, word)
        near = word.astype(np.uint32)
        del word, at_place
        parts = (1 + (self.n - 1) // hot).astype(np.int32)  # a hot context is dealt out by the next symbol
        home, many = context, np.nonzero(parts > 1)[0]
        if len(many):
            part = near[many].astype(np.int64) * parts[many] >> 32
            home = context.copy()
            home[many] = mix(context[many], part.astype(np.uint64))
        self.order = np.argsort(home, kind="stable").astype(np.int32)
        self.bucket, self.context = bucket_of(home[self.order], buckets), context[self.order]
        del home, context
        self.sent = {"n": self.n[self.order], "parts": parts[self.order], "next": near[self.order], "parent": np.minimum(255, np.rint(self.parent * -20)).astype(np.uint8)[self.order]}  # for the test, twentieths of a decade
        self.sent["learnt"] = np.bincount(self.number[batch.learnt[places]], minlength=len(self.order)).astype(np.int32)[self.order]
        begins = np.ones(len(self.order), dtype=bool)
        begins[1:] = (self.context[1:] != self.context[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        self.first = np.nonzero(begins)[0]
        self.group = np.cumsum(begins, dtype=np.int32) - 1

    def rows(self, number: int) -> Iterator[dict]:
        edges = np.concatenate([[0], np.nonzero(self.bucket[1:] != self.bucket[:-1])[0] + 1, [len(self.bucket)]])
        sent = self.sent
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a < b:
                lo, hi = np.searchsorted(self.first, [a, b])
                heads = self.first[lo:hi]
                size = np.diff(np.append(heads, b))
                yield {"batch": number, "bucket": int(self.bucket[a]), "context": _pack_hashes(self.context[heads]), "n": _pack(sent["n"][heads], "<i8"), "size": _pack(size, "<i4"), "parts": _pack(sent["parts"][heads], "<i8"), "next": sent["next"][a:b].tobytes(), "learnt": _pack(sent["learnt"][a:b], "<i8"), "parent": _pack(sent["parent"][a:b], "u1")}

    def heard(self, counts: np.ndarray, kinds: np.ndarray, hot: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """counts: of each pair in the order sent; kinds: of each context sent, those of its next symbols, or 0 if it is no state, or -1: look
        among the hot ones. Returns for each pair its count and its context's kinds."""
        kinds = kinds.copy()
        for k in np.nonzero(kinds < 0)[0]:
            kinds[k] = hot.get(int(self.context[self.first[k]].view(np.int64)), 0)
        c, t = np.empty(len(self.order), dtype=np.int64), np.empty(len(self.order), dtype=np.int64)
        c[self.order], t[self.order] = counts, kinds[self.group]
        return c, t


class Batch:
    """A batch of texts as symbols, and what it has heard from the buckets so far."""

    def __init__(self, row: dict):
        hashes = np.frombuffer(row["hashes"], "<u8")  # by falling frequency in the batch
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.hashes = hashes[order]
        self.symbols = place[_unpack(row["symbols"], "<u2" if len(order) <= 65_536 else "<u4")]
        self.sizes = np.frombuffer(row["sizes"], "<i8")
        self.train = np.frombuffer(row["train"], np.int8) > 0
        self.start = np.cumsum(self.sizes) - self.sizes
        self.learnt = np.repeat(self.train, self.sizes)
        self.inside = (np.arange(len(self.symbols)) - np.repeat(self.start, self.sizes)).astype(np.int32)

    def root(self, counts: np.ndarray, tokens: int, kinds: int) -> None:
        """counts: of each word of the batch, by its hash."""
        count = counts[self.symbols]
        self.known = count > 0
        self.base = (np.log10(counts + 1.0) - np.log10(tokens + kinds + 1.0))[self.symbols]
        self.share = self.base.copy()
        self.grams = self.hashes  # by number
        self._before(self.symbols, count)
        end = np.searchsorted(self.hashes, np.uint64(_END))
        self.before[self.start], self.before_count[self.start] = end, counts[end]
        self.open = np.ones(len(self.symbols), dtype=bool)  # places whose context of the level before was a state

    def _before(self, number: np.ndarray, count: np.ndarray) -> None:
        """For each place the number and the training count of its next context, which is what ends at the place before."""
        self.before, self.before_count = np.roll(number, 1), np.roll(count, 1)
        self.before_count[self.start] = 0

    def ask(self, level: int, buckets: int, hot: int) -> Pairs:
        return Pairs(self, np.nonzero(self.open & (self.inside >= level - 1) & (self.before_count >= 2))[0], buckets, hot)

    def hear(self, asked: Pairs, counts: np.ndarray, kinds: np.ndarray, hot: dict[int, int]) -> None:
        c, t = asked.heard(counts, kinds, hot)
        share = np.where(t > 0, np.log10((c + t * 10.0**asked.parent) / (asked.n + np.maximum(t, 1)) + (t == 0)), asked.parent)
        self.share[asked.places] = share[asked.number]
        self.open[:] = False
        self.open[asked.places] = (t > 0)[asked.number]
        number, count = np.zeros(len(self.symbols), dtype=np.int32), np.zeros(len(self.symbols), dtype=np.int64)
        number[asked.places], count[asked.places] = asked.number, c[asked.number]
        self.grams = asked.gram
        self._before(number, count)

    def by_text(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.start)


def total_words(table: pa.Table) -> pa.Table:
    """One bucket of words: their training counts back to each batch, and a row for the whole with kinds and tokens."""
    parts = [_unpack_hashes(x.as_py()) for x in table["context"]]
    learnt = np.concatenate([_unpack(x.as_py(), "<i8") for x in table["learnt"]])
    words, at = np.unique(np.concatenate(parts), return_inverse=True)
    sums = np.bincount(at, weights=learnt, minlength=len(words)).astype(np.int64)
    ends = np.cumsum([len(x) for x in parts])
    back = [_pack(x, "<i8") for x in np.split(sums[at], ends[:-1])]
    return _answers(table, back, [None] * len(parts), {"tokens": int(sums.sum()), "kinds": int((sums > 0).sum())})


def total_pairs(table: pa.Table, min_gain: float) -> pa.Table:
    """One bucket of pairs: counts back to each batch, and whether contexts are states (the number of kinds that follow, else 0)."""
    heads = [_unpack_hashes(x.as_py()) for x in table["context"]]
    sizes = [_unpack(x.as_py(), "<i4") for x in table["size"]]
    n, parts = (np.concatenate([_unpack(x.as_py(), "<i8") for x in table[c]]) for c in ("n", "parts"))
    head = np.concatenate(heads)
    near = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table["next"]])
    learnt = np.concatenate([_unpack(x.as_py(), "<i8") for x in table["learnt"]])
    parent = np.concatenate([_unpack(x.as_py(), "u1") for x in table["parent"]]) / -20.0
    # a hot context has several parts, which may meet in one bucket and are tested together then
    contexts, first, of = np.unique(head, return_index=True, return_inverse=True)
    of_pair = np.repeat(of, np.concatenate(sizes))
    _, at, pair = np.unique(mix(contexts[of_pair], near.astype(np.uint64)), return_index=True, return_inverse=True)
    c = np.bincount(pair, weights=learnt, minlength=len(at))
    owner, known = of_pair[at], c > 0
    kinds = np.bincount(owner[known], minlength=len(contexts))
    n, parts = n[first].astype(np.float64), parts[first]
    whole = np.where(parts > 1, kinds * parts, kinds).astype(np.float64)  # next symbols are dealt evenly to the parts
    t, p, own = whole[owner[known]], 10.0 ** parent[at][known], n[owner[known]]
    saved = c[known] * np.log(((c[known] - 1) + t * p) / ((own - 1 + t) * p))
    gain = np.bincount(owner[known], weights=saved, minlength=len(contexts))
    hot = parts > 1
    answer = np.where(hot, -1, np.where(gain >= min_gain, kinds, 0))
    back = [_pack(x, "<i8") for x in np.split(c[pair].astype(np.int64), np.cumsum([x.sum() for x in sizes])[:-1])]
    told = [_pack(x, "<i8") for x in np.split(answer[of], np.cumsum([len(x) for x in heads])[:-1])]
    more = {"kinds": int((answer > 0).sum()), "hot": contexts[hot].view(np.int64).tolist(), "hot_kinds": kinds[hot].tolist(), "hot_gain": gain[hot].tolist()}
    return _answers(table, back, told, more)


_ANSWER = "batch long, bucket int, counts binary, states binary, tokens long, kinds long, hot array<long>, hot_kinds array<long>, hot_gain array<double>"


def _answers(table: pa.Table, counts: list, states: list, whole: dict) -> pa.Table:
    n = len(counts)
    last = lambda name, kind: pa.array([*[None] * n, whole.get(name)], kind)
    return pa.table({
        "batch": pa.array([*table["batch"].to_pylist(), -1], pa.int64()), "bucket": pa.array([*table["bucket"].to_pylist(), -1], pa.int32()), "counts": pa.array([*counts, None], pa.binary()), "states": pa.array([*states, None], pa.binary()),
        "tokens": last("tokens", pa.int64()), "kinds": last("kinds", pa.int64()), "hot": last("hot", pa.list_(pa.int64())), "hot_kinds": last("hot_kinds", pa.list_(pa.int64())), "hot_gain": last("hot_gain", pa.list_(pa.float64())),
    })


_ASKED = "batch long, bucket int, context binary, n binary, size binary, parts binary, next binary, learnt binary, parent binary"
_ASKED_ARROW = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("context", "n", "size", "parts", "next", "learnt", "parent"))])


class Rules:
    """What every step needs to know of the whole corpus."""

    def __init__(self, buckets: int, hot: int, min_gain: float):
        self.buckets, self.hot, self.min_gain = buckets, hot, min_gain
        self.tasks = min(buckets, 50_000)  # of a shuffle: their number follows the corpus, so what one reads does not
        self.tokens = self.kinds = 0
        self.hot_states: list[dict[int, int]] = []  # for each level the hot contexts that are states, and the kinds that follow

    def replay(self, row: dict, answers: pa.Table) -> Batch:
        """The batch after all levels that `answers` hold."""
        batch = Batch(row)
        by = defaultdict(list)
        for level, bucket, counts, states in zip(*(answers[c].to_pylist() for c in ("level", "bucket", "counts", "states")), strict=True):
            by[level].append((bucket, counts, states))
        join = lambda level, k: np.concatenate([np.zeros(0, dtype=np.int64), *(_unpack(x[k], "<i8") for x in sorted(by[level], key=lambda x: x[0]))])
        batch.root(join(0, 1), self.tokens, self.kinds)
        for level in range(1, len(self.hot_states) + 1):
            batch.hear(batch.ask(level, self.buckets, self.hot), join(level, 1), join(level, 2), self.hot_states[level - 1])
        return batch


def _batch_rows(ids: list, texts: list[bytes], train: list[bool], number: int, buckets: int) -> Iterator[dict]:
    local: defaultdict = defaultdict(itertools.count().__next__)
    end = local[b" "]
    found = [np.fromiter(itertools.chain(map(local.__getitem__, t.split()), (end,)), dtype=np.int64) for t in texts]
    sizes = np.array([len(f) for f in found])
    symbols = np.concatenate(found)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in local), dtype=np.uint64, count=len(local))
    often = np.argsort(-np.bincount(symbols, minlength=len(hashes)), kind="stable")
    rank = np.empty(len(often), dtype=np.int64)
    rank[often] = np.arange(len(often))
    flags = np.array(train, dtype=np.int8)
    yield {"batch": number, "bucket": -1, "ids": ids, "sizes": sizes.astype("<i8").tobytes(), "train": flags.tobytes(), "hashes": hashes[often].tobytes(), "symbols": _pack(rank[symbols], "<u2" if len(hashes) <= 65_536 else "<u4")}
    learnt = np.bincount(symbols[np.repeat(flags > 0, sizes)], minlength=len(hashes))
    order = np.argsort(hashes, kind="stable")
    hashes, learnt = hashes[order], learnt[order]
    bucket = bucket_of(hashes, buckets)
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.unique(bucket).tolist():
        lo, hi = edges[b], edges[b + 1]
        yield {"batch": number, "bucket": b, "context": _pack_hashes(hashes[lo:hi]), "learnt": _pack(learnt[lo:hi], "<i8")}


def score(df: DataFrame, id_col: str, text_col: str, is_train: Column, depth: int = DEPTH, min_gain: float = MIN_GAIN, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """One row for each row of df: id, train, n_tokens, n_known, train_tokens, base_score, score."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), valid(F.col(text_col)).alias("text"), F.coalesce(is_train, F.lit(False)).alias("train"))
    size = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.lit(0))).first()[0]
    rules = Rules(max(1, -(-size // bucket_bytes)), hot, min_gain)
    arrow = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), *((n, pa.binary()) for n in ("context", "learnt", "sizes", "train", "hashes", "symbols"))])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, id_type = TaskContext.get().partitionId(), None

        def typed(stream):
            nonlocal id_type
            for b in stream:
                id_type = b.schema.field(0).type
                yield b

        for k, group in enumerate(groups(typed(batches), batch_bytes)):
            made = list(_batch_rows(*group, (part << 24) | k, rules.buckets))
            columns = [pa.array([r.get(f.name) for r in made], f.type) for f in arrow]
            columns.append(pa.array([r.get("ids") for r in made], pa.list_(id_type)))
            yield pa.RecordBatch.from_arrays(columns, names=[*arrow.names, "ids"])

    # batches lie in files by their number, so that answers come to them and they are not moved
    made = rows.mapInArrow(send, f"batch long, bucket int, context binary, learnt binary, sizes binary, train binary, hashes binary, symbols binary, ids array<{kind}>")
    sent, drop = bucketed(made.withColumn("texts", (F.col("bucket") < 0).cast("int")), "batches", "batch", rules.buckets, "texts")
    docs = sent.where("texts = 1").select("batch", "ids", "sizes", "train", "hashes", "symbols")
    words = materialize(sent.where("texts = 0").select("batch", "bucket", "context", "learnt").repartition(rules.tasks, "bucket").groupBy("bucket").applyInArrow(total_words, _ANSWER), "words")
    drop(0)
    release(rows.sparkSession)
    rules.tokens, rules.kinds = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    rules.hot = max(hot, rules.tokens // 100_000)
    told = lambda answers, level: answers.where("batch >= 0").select("batch", F.lit(level).alias("level"), "bucket", "counts", "states")
    heard = told(words, 0)

    def ask(level: int):
        def step(table: pa.Table, answers: pa.Table) -> pa.Table:
            made = []
            for row in table.to_pylist():
                batch = rules.replay(row, answers)
                made += batch.ask(level, rules.buckets, rules.hot).rows(row["batch"])
            return pa.Table.from_pylist(made, _ASKED_ARROW)

        return step

    for level in range(1, depth + 1):
        asked = docs.drop("ids").groupBy("batch").cogroup(heard.groupBy("batch")).applyInArrow(ask(level), _ASKED)
        found = materialize(asked.repartition(rules.tasks, "bucket").groupBy("bucket").applyInArrow(lambda t: total_pairs(t, min_gain), _ANSWER), "pairs")
        release(rows.sparkSession)
        sums = found.where("batch < 0 and size(hot) > 0").select(F.explode(F.arrays_zip("hot", "hot_kinds", "hot_gain")).alias("h")).groupBy("h.hot").agg(F.sum("h.hot_kinds").alias("kinds"), F.sum("h.hot_gain").alias("gain"))
        rules.hot_states.append({r["hot"]: r["kinds"] for r in sums.where(F.col("gain") >= min_gain).collect()})  # at most N / hot rows
        heard = heard.unionByName(told(found, level))
        if not rules.hot_states[-1] and not found.where("batch < 0 and kinds > 0").limit(1).count():
            break  # no state to expand

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("train", "n_tokens", "n_known", "base_score", "score")}
        ids: list = []
        for row in table.to_pylist():
            batch = rules.replay(row | {"ids": None}, answers)
            ids += row["ids"]
            for name, x in (("train", batch.train), ("n_tokens", batch.sizes), ("n_known", batch.by_text(batch.known.astype(np.int64))), ("base_score", batch.by_text(batch.base)), ("score", batch.by_text(batch.share))):
                out[name].append(x)
        return pa.table({"id": pa.array(ids, table["ids"].type.value_type)} | {n: pa.array(np.concatenate(x)) for n, x in out.items()})

    done = docs.groupBy("batch").cogroup(heard.groupBy("batch")).applyInArrow(finish, f"id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(rules.tokens).cast("long").alias("train_tokens"), "base_score", "score")
