"""Vector columns: arrays of numbers, computed in double precision inside Spark."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A product with a literal vector of at most so many dimensions is unrolled into generated code.
UNROLL = 128


def _balanced(terms: list[Column]) -> Column:
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def _of(vector: Column | Sequence[float]) -> Column:
    return vector if isinstance(vector, Column) else F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    """Inner product; null if either is null or their lengths differ."""
    if not isinstance(b, Column) and 0 < len(b) <= UNROLL:
        return F.when(F.size(a) == len(b), _balanced([F.get(a, F.lit(i)).cast("double") * float(x) for i, x in enumerate(b)]))
    other = _of(b)
    total = F.aggregate(F.zip_with(a, other, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(other), total)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(a: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    return F.element_at(F.transform(F.array(F.struct(a.alias("v"), norm(a).alias("n"))), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"])), 1)


def is_normalized(a: Column, tolerance: float = 1e-3) -> Column:
    return F.abs(norm(a) - 1) < tolerance


def distance(a: Column, b: Column | Sequence[float]) -> Column:
    """Inner-product distance of unit vectors, 0 to 2."""
    return 1 - dot(a, b)


def dot_relevance(a: Column, b: Column | Sequence[float]) -> Column:
    """The scale of recall: dot product, not below 0."""
    return F.greatest(F.lit(0.0), dot(a, b))


def half_similarity(a: Column, b: Column | Sequence[float]) -> Column:
    """The scale of contradictions and the graph: (1 + dot) / 2, within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 + dot(a, b)) / 2))


def mean(df, column: str, *by: str):
    """Element-wise mean of a vector column for each group (`by` may be empty): rows (by..., vec)."""
    parts = df.select(*by, F.posexplode(column).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("vec"))


def normalized(v: Sequence[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n > 0 else list(v)
