"""Schemas, enumerations, limits and driver-side validation of the memory tables."""

from __future__ import annotations

import re

from pyspark.sql import types as T

KINDS = ("episode", "insight", "revision", "document", "proposition")
EDGE_TYPES = ("caused_by", "related_to", "followed_by", "revised_from", "insight_from", "contradicts", "has_entity", "entity_relation", "proposition_of")
STRATEGIES = ("similarity", "temporal", "causal", "analogical")
MAX_CONTENT_BYTES = 64 * 1024
MAX_CONTEXT_BYTES = 16 * 1024
MAX_TOP_K, MAX_DEPTH, MAX_PRIME = 1000, 10, 200
DEFAULT_IMPORTANCE = 0.5
FOREVER = (1 << 63) - 1
DAY_US = 86_400_000_000

MEMORIES = T.StructType([
    T.StructField("tenant_id", T.StringType()), T.StructField("memory_id", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("importance", T.DoubleType()), T.StructField("context", T.StringType()), T.StructField("entity_id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("assoc_embedding", T.ArrayType(T.DoubleType())),
    T.StructField("created_at", T.LongType()), T.StructField("updated_at", T.LongType()), T.StructField("last_accessed_at", T.LongType()),
    T.StructField("access_count", T.LongType()), T.StructField("decay_score", T.DoubleType()), T.StructField("kind", T.StringType()),
    T.StructField("device_id", T.StringType()), T.StructField("logical_clock", T.LongType()), T.StructField("is_snapshot", T.BooleanType()),
])
EDGES = T.StructType([
    T.StructField("tenant_id", T.StringType()), T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()),
    T.StructField("edge_type", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("ts_us", T.LongType()),
])
TOMBSTONES = T.StructType([
    T.StructField("memory_id", T.StringType()), T.StructField("entity_id", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("criteria", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("forgotten_at", T.LongType()),
])


class InvalidInput(ValueError):
    """An argument outside the documented bounds; raised before anything is planned."""


def require(ok: bool, what: str) -> None:
    if not ok:
        raise InvalidInput(what)


def check_tenant(tenant: str) -> str:
    require(bool(re.fullmatch(r"[A-Za-z0-9_-]{1,128}", tenant)), f"tenant id {tenant!r}")
    return tenant


def check_kind(kind: str) -> str:
    require(kind in KINDS, f"unknown kind {kind!r}")
    return kind


def check_top_k(k: int, most: int = MAX_TOP_K) -> int:
    require(1 <= k <= most, f"top_k must be within 1..{most}")
    return k
