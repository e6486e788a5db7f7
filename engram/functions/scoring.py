"""Scores as column expressions over the memory table; the clock is always an argument."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.schema import DAY_US, InvalidInput

HALF_LIFE_US = 30 * DAY_US
REINFORCEMENT_CAP = 100


@dataclass(frozen=True)
class Weights:
    """Shares of the composite score and the constants of its signals."""

    relevance: float = 0.5
    recency: float = 0.2
    importance: float = 0.2
    reinforcement: float = 0.1
    max_age_us: int = 30 * DAY_US
    reinforcement_cap: int = REINFORCEMENT_CAP


def parse_weights(text: str) -> Weights:
    """`R:T:I:F`, four numbers."""
    parts = text.split(":")
    try:
        numbers = [float(x) for x in parts]
    except ValueError as e:
        raise InvalidInput(f"weights {text!r}") from e
    if len(numbers) != 4:
        raise InvalidInput(f"weights {text!r}: four numbers are needed")
    return Weights(*numbers)


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def recency(created_at: Column, now_us: int, max_age_us: int) -> Column:
    if max_age_us == 0:
        return F.lit(1.0)
    return F.when(F.lit(now_us) <= created_at, 1.0).otherwise(clamp(1 - (F.lit(now_us) - created_at) / float(max_age_us)))


def reinforcement(access_count: Column, cap: int) -> Column:
    if cap == 0:
        return F.lit(0.0)
    return F.least(F.lit(1.0), F.log2(1.0 + access_count) / F.log2(F.lit(1.0 + cap)))


def composite(relevance: Column, now_us: int, w: Weights = Weights()) -> Column:
    return w.relevance * clamp(relevance) + w.recency * recency(F.col("created_at"), now_us, w.max_age_us) + w.importance * clamp(F.col("importance")) + w.reinforcement * reinforcement(F.col("access_count"), w.reinforcement_cap)


def breakdown(relevance: Column, now_us: int, w: Weights = Weights()) -> Column:
    """Struct of each signal: raw, weight, weighted."""
    signals = {"relevance": (clamp(relevance), w.relevance), "recency": (recency(F.col("created_at"), now_us, w.max_age_us), w.recency), "importance": (clamp(F.col("importance")), w.importance), "reinforcement": (reinforcement(F.col("access_count"), w.reinforcement_cap), w.reinforcement)}
    return F.struct(*(F.struct(raw.alias("raw"), F.lit(weight).alias("weight"), (raw * weight).alias("weighted")).alias(name) for name, (raw, weight) in signals.items()))


def decay(now_us: int, half_life_us: int = HALF_LIFE_US, cap: int = REINFORCEMENT_CAP) -> Column:
    """importance * 2^-(age / half-life) * (1 + reinforcement); the age counts from the last access and is never negative."""
    if half_life_us == 0:
        return F.lit(0.0)
    age = F.greatest(F.lit(0), F.lit(now_us) - F.col("last_accessed_at"))
    boost = 1 + (F.log2(1.0 + F.least(F.col("access_count"), F.lit(cap))) / F.log2(F.lit(1.0 + cap)) if cap else F.lit(0.0))
    return F.when(F.col("importance") <= 0, 0.0).otherwise(F.col("importance") * F.pow(F.lit(2.0), -(age / float(half_life_us))) * boost)


def insight_importance(mean_importance: Column, confidence: Column, n: Column, weight: float = 0.7) -> Column:
    return clamp(weight * mean_importance + (1 - weight) * confidence + F.log(1.0 + n) / 10)


def json_type(value: Column) -> Column:
    """One of null, boolean, number, string, array, object; of a VARIANT."""
    kind = F.schema_of_variant(value)
    return F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")


def _python_type(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return {int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(value)]


def structural_similarity(cue_context: dict, cue_entity: str | None, key_weight: float = 0.4, type_weight: float = 0.3, kind_weight: float = 0.2, entity_weight: float = 0.1) -> Column:
    """Agreement of a memory's context, kind and entity with those of a cue."""
    context = F.coalesce(F.col("context"), F.lit("{}"))
    keys = F.coalesce(F.json_object_keys(context), F.array().cast("array<string>"))
    if cue_context:
        own = F.array(*(F.lit(k) for k in cue_context))
        shared, union = F.size(F.array_intersect(keys, own)), F.size(F.array_union(keys, own))
        overlap = F.when(F.size(keys) == 0, 0.0).otherwise(shared / union)
        parsed = F.try_parse_json(context)
        alike = F.lit(0)
        for k, v in cue_context.items():
            there = F.array_contains(keys, k) & (json_type(F.try_variant_get(parsed, f"$['{k}']", "variant")) == _python_type(v))
            alike = alike + F.when(there, 1).otherwise(0)
        types = F.when(shared == 0, 0.0).otherwise(alike / shared)
    else:
        overlap, types = F.lit(0.0), F.lit(0.0)
    kind = cue_context.get("kind") if isinstance(cue_context.get("kind"), str) else None
    kind_match = F.lit(0.5) if kind is None else F.when(F.col("kind") == kind, 1.0).otherwise(0.0)
    if cue_entity is None:
        entity = F.when(F.col("entity_id").isNull(), 0.5).otherwise(0.0)
    else:
        entity = F.when(F.col("entity_id") == cue_entity, 1.0).otherwise(0.0)
    return key_weight * overlap + type_weight * types + kind_weight * kind_match + entity_weight * entity


def parse_context(text: str | None) -> dict:
    value = json.loads(text) if text else {}
    if not isinstance(value, dict):
        raise InvalidInput("context must be a JSON object")
    return value
