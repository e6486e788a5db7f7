"""Toxicity scores by a counterfactual-regularised linear classifier.

A text is the set of its words and of their first four to six letters. In every labelled text that names a group, the
identity terms are swapped for terms of other groups, and logistic regression is fitted with a penalty on the change of
the score between the two: a weight that only tells which group was named costs, and neutral mentions stay low.

Bounds: the model is fitted on at most `per_class` labelled rows a class, drawn by a hash of the id, and keeps at most
`max_features` features, those that set the classes apart most clearly. Scoring reads whole texts.

Cases: null and empty texts get the score of a text without features; no labels, or no toxic ones: every score is 0; null
labels and ids are no labels; of several labels for one id the largest holds; repeated rows are scored alike; bytes that are not UTF-8
count as the replacement character.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm._common import forget, map_batches, materialize, valid

PER_CLASS = 6_000
MAX_FEATURES = 1_500
COUNTERFACTUAL = 4.0
RIDGE = 2e-4
#: Words of a group may stand for each other.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "arab"), ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("immigrant", "refugee", "native", "foreigner"), ("immigrants", "refugees", "natives", "foreigners"), ("disabled", "blind", "deaf"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs", "arabes"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einheimische"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos", "gitanos"),
)
_SWAPS = {t: [x for x in group if x != t] for group in IDENTITY_TERMS for t in group}
_WORD = re.compile(r"[^\W\d_]+")


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass"))


def word_features(word: str) -> list[int]:
    return [_hash(word), *(_hash(f"{word[:n]}*") for n in (4, 5, 6) if len(word) > n)]


def text_features(text: str) -> tuple[list[int], list[int] | None]:
    """Feature hashes of a text, and of its counterfactual if it names a group."""
    words = {w for token in set(text.lower().split()) for w in _WORD.findall(token)}
    named = sorted(w for w in words if w in _SWAPS)
    own = {h for w in words for h in word_features(w)}
    if not named:
        return list(own), None
    changed = words - set(named)
    for w in named:
        options = _SWAPS[w]
        changed.add(options[_hash(w) % len(options)])
    return list(own), list({h for w in changed for h in word_features(w)})


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -np.inf
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def score(self, text: str) -> float:
        if self.bias == -np.inf:
            return 0.0
        memo, found = self.memo, set()
        for token in set(text.lower().split()):
            hit = memo.get(token)
            if hit is None:
                hit = tuple(h for w in _WORD.findall(token) for h in word_features(w) if h in self.weights)
                if len(memo) >= 700_000:
                    memo.clear()
                if len(token) <= 64:
                    memo[token] = hit
            if hit:
                found.update(hit)
        z = self.bias + sum(self.weights[h] for h in sorted(found))
        return float(1 / (1 + np.exp(-max(-500.0, min(500.0, z)))))


def fit_rows(rows: list[tuple[int, list[int], list[int] | None]], features: list[int], prior: float = 0.5, counterfactual: float = COUNTERFACTUAL, ridge: float = RIDGE, rounds: int = 400) -> Model:
    """rows: (label, features of the text, those of its counterfactual or None). prior: the share of label 1 that the bias stands for."""
    y = np.array([r[0] for r in rows], dtype=np.float64)
    if not len(y) or y.sum() == 0:
        return Model()
    place = {h: i for i, h in enumerate(features)}
    x = np.zeros((len(rows), len(features)), dtype=np.float32)
    change = []
    for i, (_, own, other) in enumerate(rows):
        x[i, [place[h] for h in own if h in place]] = 1
        if other is not None:
            d = x[i].copy()
            d[[place[h] for h in other if h in place]] -= 1
            change.append(d)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    d = np.array(change, dtype=np.float32).reshape(len(change), len(features))
    w, b = np.zeros(len(features)), 0.0
    vw, vb, first_w, first_b = np.zeros(len(features)), 0.0, np.zeros(len(features)), 0.0
    for t in range(1, rounds + 1):  # Adam on the full batch
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30)))
        e = (p - y) * share
        g = x.T @ e.astype(np.float32) + 2 * ridge * w
        if len(d):
            g = g + 2 * counterfactual / len(d) * (d.T @ (d @ w.astype(np.float32)))
        gb = e.sum()
        first_w, first_b = 0.9 * first_w + 0.1 * g, 0.9 * first_b + 0.1 * gb
        vw, vb = 0.99 * vw + 0.01 * g * g, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= rate * first_w / (np.sqrt(vw) + 1e-9)
        b -= rate * first_b / (np.sqrt(vb) + 1e-9)
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    return Model({h: float(w[i]) for h, i in place.items() if abs(w[i]) > 1e-3}, float(b + np.log(prior / (1 - prior))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int = PER_CLASS, max_features: int = MAX_FEATURES) -> Model:
    """docs: (id, text); labels: (id, 0 or 1), both already without the rows that are held out."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    if not counts.get(1):
        return Model()
    order = F.xxhash64(F.col(id_col).cast("string"))
    drawn = [one.where(F.col("y") == y).orderBy(order, id_col).limit(per_class) for y in counts]
    sample = drawn[0] if len(drawn) == 1 else drawn[0].unionByName(drawn[1])

    def make():
        def step(batch):
            both = [text_features(x.as_py() or "") for x in batch.column(1)]
            return {"y": batch.column(0), "own": pa.array([a for a, _ in both], pa.list_(pa.int64())), "other": pa.array([b for _, b in both], pa.list_(pa.int64()))}

        return step

    # the sample has 2 * per_class rows at most, so it may be broadcast whatever the tables' sizes; of several texts with one id the least counts
    joined = docs.select(id_col, valid(F.col(text_col)).alias("text")).join(F.broadcast(sample), id_col).groupBy(id_col).agg(F.max("y").alias("y"), F.min("text").alias("text")).select("y", "text")
    found = materialize(map_batches(joined, make, "y int, own array<long>, other array<long>"), "features")
    seen = {r["y"]: r["count"] for r in found.groupBy("y").count().collect()}
    pos, neg = seen.get(1, 0), seen.get(0, 0)
    if not pos:
        return Model()
    per = found.select("y", F.explode("own").alias("f")).groupBy("f").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    share = (F.col("p") + F.col("n")) / float(pos + neg)
    z = F.abs(F.col("p") / float(max(1, pos)) - F.col("n") / float(max(1, neg))) / F.sqrt(share * (1.0000001 - share) * (1.0 / max(1, pos) + 1.0 / max(1, neg)))
    chosen = sorted(r["f"] for r in per.where(F.col("p") + F.col("n") >= 3).withColumn("z", z).where("z > 3").orderBy(F.desc("z"), "f").limit(max_features).collect())
    shared = set(chosen)

    def narrow():
        def step(batch):
            lists = [pa.array([None if v is None else [h for h in v if h in shared] for v in batch.column(k).to_pylist()], pa.list_(pa.int64())) for k in (1, 2)]
            return {"y": batch.column(0), "own": lists[0], "other": lists[1]}

        return step

    rows = [(r["y"], r["own"], r["other"]) for r in map_batches(found, narrow, "y int, own array<long>, other array<long>").collect()]
    forget(found)
    return fit_rows(sorted(rows, key=lambda r: (r[0], sorted(r[1]))), chosen)


def score(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """One row for each row of df: id, score (0 to 1), predicted (1 if score >= 0.5)."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def make():
        m = Model(*shared.value)

        def step(batch):
            s = [m.score(x.as_py() or "") for x in batch.column(1)]
            return {id_col: batch.column(0), "score": pa.array(s, pa.float64()), "predicted": pa.array([int(x >= 0.5) for x in s], pa.int32())}

        return step

    return map_batches(df.select(id_col, valid(F.col(text_col))), make, f"{id_col} {df.schema[id_col].dataType.simpleString()}, score double, predicted int")
