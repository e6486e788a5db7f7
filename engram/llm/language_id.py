"""Language identification by blended-spectrum string kernels.

Two texts are compared by the character n-grams that both hold, whatever their number: for each length n the kernel is
|A and B| / sqrt(|A| |B|), and the blend is their sum. Some training texts are landmarks; the Nystroem map sends a text
to K(text, landmarks) K(landmarks, landmarks)^-1/2, and one-versus-rest kernel ridge regression on it gives a weight per
language. Both are linear in the presence vectors, so weights are kept per n-gram, and a batch of texts is scored by one
matrix product for each n.

N-grams are hashed to 2**20 bins; only bins that occur in a landmark count, in both the product and the norms.

Bounds: the model is fitted on at most `per_language` distinct training texts a language, drawn by a hash of the text, of longer ones a passage of
`train_chars` characters from a place that the hash chooses. Prediction reads whole texts of any length.

Cases: null text, or one without a letter: `und`, score 0. No training row: every row is `und`. One language only: that
one, score 1. Repeated rows, ties: the same text always gets the same answer; equal scores go to the smaller name. Bytes that are not UTF-8
count as the replacement character. Columns named lang_pred or lang_score are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.llm._common import map_batches, valid

LENGTHS = (1, 2, 3, 4)
BITS = 20
PER_LANGUAGE = 400
LANDMARKS = 24
TRAIN_CHARS = 20_000
#: Contrast of the class scores when they become shares.
SHARPNESS = 8.0
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)
_LETTER = regex.compile(r"\p{L}")


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


def gram_bins(text: str) -> list[np.ndarray]:
    """For each n the bin of every n-gram of the lower-cased text, repeats included. White space runs count as one blank."""
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out, value = [], np.zeros(len(points), dtype=np.uint32)
    for n in LENGTHS:
        value = value[: len(points) - n + 1] * _MULTIPLIERS[1] + points[n - 1 :] * _MULTIPLIERS[0] if n > 1 else points * _MULTIPLIERS[0]
        mixed = (value ^ (value >> np.uint32(15))) * _MULTIPLIERS[2]
        out.append((mixed >> np.uint32(32 - BITS)).astype(np.int64))
    return out


@dataclass
class Model:
    languages: list[str]
    slots: list[np.ndarray]  # for each n: bin -> place among the landmarks' n-grams, or -1
    weights: list[np.ndarray]  # for each n: places x languages
    bias: np.ndarray

    def presence(self, texts: list[str]) -> list[np.ndarray]:
        rows = [np.zeros((len(texts), len(w)), dtype=np.float32) for w in self.weights]
        for i, text in enumerate(texts):
            for row, slot, bins in zip(rows, self.slots, gram_bins(text), strict=True):
                place = slot[bins]
                row[i, place[place >= 0]] = 1.0
        return rows

    def scores(self, texts: list[str]) -> np.ndarray:
        total = np.tile(self.bias, (len(texts), 1))
        for x, w in zip(self.presence(texts), self.weights, strict=True):
            total += (x @ w) / np.sqrt(np.maximum(1.0, x.sum(axis=1)))[:, None]
        return total

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        if len(self.languages) == 1:
            return self.languages * len(texts), [1.0] * len(texts)
        s = self.scores(texts) * SHARPNESS
        share = np.exp(s - s.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return [self.languages[k] for k in best], [min(1.0, float(share[i, k])) for i, k in enumerate(best)]


def fit_rows(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = 1e-2) -> Model:
    """rows: (language, text), landmarks taken from the front of each language's rows."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return Model([], [], [], np.zeros(0, dtype=np.float32))
    by = {lang: [t for x, t in rows if x == lang] for lang in languages}
    marks = [t for lang in languages for t in by[lang][:landmarks]]
    slots, sizes = [], []
    marked = [gram_bins(t) for t in marks]
    for k in range(len(LENGTHS)):
        used = np.unique(np.concatenate([m[k] for m in marked]))
        slot = np.full(1 << BITS, -1, dtype=np.int32)
        slot[used] = np.arange(len(used), dtype=np.int32)
        slots.append(slot)
        sizes.append(len(used))
    blank = Model(languages, slots, [np.zeros((n, 1), dtype=np.float32) for n in sizes], np.zeros(1, dtype=np.float32))
    unit = [x / np.sqrt(np.maximum(1.0, x.sum(axis=1)))[:, None] for x in blank.presence(marks)]
    kernel = sum(x @ x.T for x in unit).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    keep = values > 1e-6 * max(1e-12, values[-1])
    root = vectors[:, keep] / np.sqrt(values[keep])
    order = [(lang, t) for lang in languages for t in by[lang]]
    features = np.zeros((len(order), root.shape[1]))
    for at in range(0, len(order), 64):
        part = blank.presence([t for _, t in order[at : at + 64]])
        k = sum((x / np.sqrt(np.maximum(1.0, x.sum(axis=1)))[:, None]) @ u.T for x, u in zip(part, unit, strict=True))
        features[at : at + 64] = k @ root
    target = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _ in order])
    counts = {lang: len(by[lang]) for lang in languages}
    weight = np.array([1.0 / counts[lang] for lang, _ in order])[:, None] / len(languages)
    mean_f, mean_t = (features * weight).sum(axis=0), (target * weight).sum(axis=0)
    f, t = features - mean_f, target - mean_t
    solved = np.linalg.solve(f.T @ (f * weight) + ridge * np.eye(f.shape[1]) / len(languages), f.T @ (t * weight))
    dual = root @ solved
    return Model(languages, slots, [(u.T @ dual).astype(np.float32) for u in unit], (mean_t - mean_f @ solved).astype(np.float32))


def fit(train: DataFrame, text_col: str, lang_col: str, id_col: str | None = None, per_language: int = PER_LANGUAGE, train_chars: int = TRAIN_CHARS, landmarks: int = LANDMARKS) -> Model:
    """Fit on a bounded sample of the labelled rows: for each language the `per_language` distinct texts of the smallest hash. Each
    language's number of distinct texts sets a threshold first, so that only about twice that many are shuffled. Of a text of over `train_chars`
    characters a passage of that length is taken, from a place that its hash chooses."""
    known = train.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}")).select(F.col(lang_col).alias("lang"), valid(F.col(text_col)).alias("text")).withColumn("h", F.xxhash64("text"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").agg(F.approx_count_distinct("h")).collect()}  # a row for each language
    if not counts:
        return fit_rows([])
    draw = F.pmod(F.xxhash64("h"), F.lit(1_000_000))
    wanted: Column = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (draw < int(min(1_000_000, 1 + 2_000_000 * per_language / max(1, n)))))
    start = F.pmod("h", F.greatest(F.lit(1), F.length("text") - train_chars + 1)).cast("int") + 1
    once = known.where(wanted).groupBy("lang", draw.alias("draw"), "h").agg(F.first(F.substr("text", start, F.lit(train_chars))).alias("text"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("draw", "h"))
    rows = once.withColumn("place", place).where(F.col("place") <= per_language).where(F.col("text").rlike("\\p{L}")).collect()
    return fit_rows([(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["lang"], r["place"]))], landmarks)


def annotate(df: DataFrame, text_col: str, model: Model, columns: tuple[str, ...] | None = None) -> DataFrame:
    """df, or its named columns, with lang_pred and lang_score. Rows pass through as Arrow batches, in their order."""
    keep = tuple(c for c in columns or df.columns if c not in ("lang_pred", "lang_score"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def step(batch):
            names, scores = [], []
            texts, size = [], 0

            def flush():
                known = [t for t in texts if t is not None]
                got = iter(zip(*m.predict(known), strict=True)) if known else iter(())
                for t in texts:
                    lang, s = ("und", 0.0) if t is None else next(got)
                    names.append(lang)
                    scores.append(s)
                texts.clear()

            for x in batch.column(0):
                text = x.as_py() or ""
                texts.append(text if has_letter(text) else None)
                size += len(text)
                if len(texts) >= 64 or size > 4_000_000:
                    flush()
                    size = 0
            flush()
            return {c: batch.column(i + 1) for i, c in enumerate(keep)} | {"lang_pred": pa.array(names, pa.string()), "lang_score": pa.array(scores, pa.float64())}

        return step

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(df.select(valid(F.col(text_col)), *keep), make, f"{kinds}, lang_pred string, lang_score double")


def predict(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """One row for each row of df: id, lang_pred, score."""
    return annotate(df, text_col, model, (id_col,)).withColumnRenamed("lang_score", "score")
