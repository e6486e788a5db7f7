"""The log of recalls and primes: append, list, compaction and statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.schema import DAY_US, require

SCHEMA = "id long, timestamp_us long, operation string, caller string, query string, strategy string, top_k long, result_count long, result_memory_ids array<string>, top_score double, latency_us long, entity_id string, store string"


def append(log: DataFrame, entries: DataFrame) -> DataFrame:
    return log.unionByName(entries, allowMissingColumns=True)


def listing(log: DataFrame, caller: str | None = None, operation: str | None = None, contains: str | None = None, least_latency_us: int | None = None, since_us: int | None = None, until_us: int | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Newest first."""
    require(1 <= limit <= 500 and offset >= 0, "limit within 1..500")
    rows = log
    if caller is not None:
        rows = rows.where(F.col("caller") == caller)
    if operation is not None:
        rows = rows.where(F.col("operation") == operation)
    if contains is not None:
        rows = rows.where(F.lower("query").contains(contains.lower()))
    if least_latency_us is not None:
        rows = rows.where(F.col("latency_us") >= least_latency_us)
    if since_us is not None:
        rows = rows.where(F.col("timestamp_us") >= since_us)
    if until_us is not None:
        rows = rows.where(F.col("timestamp_us") < until_us)
    return rows.orderBy(F.desc("timestamp_us"), F.desc("id")).offset(offset).limit(limit)


def get(log: DataFrame, entry: int) -> DataFrame:
    return log.where(F.col("id") == entry)


def compact(log: DataFrame, now_us: int, max_age_days: int | None = None, keep: int | None = None) -> DataFrame:
    """Entries that are young enough, and of those the newest `keep`: all newer than the time of the keep-th, and of its own time the largest ids."""
    rows = log if max_age_days is None else log.where(F.col("timestamp_us") >= now_us - max_age_days * DAY_US)
    if keep is None:
        return rows
    # the border is one row of a top-k, so no window over the whole log is needed
    border = rows.select("timestamp_us", "id").orderBy(F.desc("timestamp_us"), F.desc("id")).offset(keep - 1).limit(1).first()
    if border is None:
        return rows
    t, i = border
    return rows.where((F.col("timestamp_us") > t) | ((F.col("timestamp_us") == t) & (F.col("id") >= i)))


def stats(log: DataFrame) -> DataFrame:
    """total, avg_latency_us (floor), max_latency_us, p99_latency_us (the value at ceil(0.99 n), from 0, or the last)."""
    sums = log.agg(F.count("*").alias("total"), F.floor(F.avg("latency_us")).cast("long").alias("avg_latency_us"), F.max("latency_us").alias("max_latency_us"))
    return sums.withColumn("p99_latency_us", F.lit(percentile(log, "latency_us", 0.99)).cast("long"))


def percentile(df: DataFrame, column: str, share: float, ways: int = 4096, first: int = 0) -> int | None:
    """The value at place ceil(share * n), counted from `first` and not beyond the last, of the sorted whole numbers of a column, exactly. Each pass counts the rows in
    `ways` equal ranges and goes on with the one that holds the place: no sort, and at most `ways` rows leave a task."""
    v = F.col(column).cast("long")
    low, high, n = df.agg(F.min(v), F.max(v), F.count(v)).first()
    if not n:
        return None
    place = max(0, min(math.ceil(share * n) - first, n - 1))
    while low < high:
        width = -(-(high - low + 1) // ways)
        bucket = F.floor((v - low) / width) if width > 1 else v - low
        counts = df.where((v >= low) & (v <= high)).groupBy(bucket.cast("long").alias("b")).count().collect()
        for b, c in sorted(counts):
            if place < c:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            place -= c
    return low


def by_caller(log: DataFrame) -> DataFrame:
    return log.groupBy("caller").agg(F.count("*").alias("n"), F.floor(F.avg("latency_us")).cast("long").alias("avg_latency_us"))
