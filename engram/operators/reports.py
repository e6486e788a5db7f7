"""Reports over the whole store: timelines, dashboards, pages, health, details, cluster labels, insights and status."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.functions import scoring, text
from engram.functions.scoring import Weights
from engram.operators import querylog
from engram.schema import require

LABEL_STOP_WORDS = tuple(sorted({*text.STOP_WORDS, "we", "it", "i", "my", "me", "new", "use", "used", "using", "vs", "via", "per"}))
FADED = 0.01


def day_of(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd")


def timeline_daily(mem: DataFrame) -> DataFrame:
    """(day, memories, insights) for each UTC day."""
    insight = F.col("kind") == "insight"
    return mem.groupBy(day_of(F.col("created_at")).alias("day")).agg(F.count_if(~insight).alias("memories"), F.count_if(insight).alias("insights"))


def timeline_totals(mem: DataFrame) -> DataFrame:
    return mem.agg(F.min("created_at").alias("first_us"), F.max("created_at").alias("last_us"), F.count_if("kind <> 'insight'").alias("memories"), F.count_if("kind = 'insight'").alias("insights"))


def timeline_snapshot(mem: DataFrame, at_us: int) -> DataFrame:
    return mem.where(F.col("created_at") <= at_us).select("memory_id")


def forgotten(tombstones: DataFrame, limit: int = 100) -> DataFrame:
    """The newest tombstones."""
    return tombstones.orderBy(F.desc("forgotten_at"), "memory_id").limit(limit)


def three_signals(now_us: int, w: Weights = Weights(), half_life_us: int = scoring.HALF_LIFE_US) -> Column:
    """The composite score without relevance; the greatest age is the half-life."""
    return w.recency * scoring.recency(F.col("created_at"), now_us, half_life_us) + w.importance * scoring.clamp(F.col("importance")) + w.reinforcement * scoring.reinforcement(F.col("access_count"), w.reinforcement_cap)


def dashboard_top(mem: DataFrame, now_us: int, n: int = 10) -> DataFrame:
    return mem.withColumn("score", three_signals(now_us)).orderBy(F.desc("score"), "memory_id").limit(n)


def dashboard_newest(mem: DataFrame, n: int = 15) -> DataFrame:
    return mem.orderBy(F.desc("created_at"), F.desc("memory_id")).limit(n)


def dashboard_counts(mem: DataFrame) -> DataFrame:
    return mem.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("entities"), F.round(F.avg("importance"), 6).alias("mean_importance"))


SORT_KEYS = ("created_at", "updated_at", "importance", "access_count", "decay_score", "content")


def memory_list(mem: DataFrame, search: str | None = None, state: str | None = None, file: str | None = None, sort: str = "created_at", descending: bool = True, page: int = 1, per_page: int = 50) -> DataFrame:
    require(page >= 1 and 1 <= per_page <= 200 and sort in SORT_KEYS, "page from 1, per_page within 1..200, a known sort key")
    rows = _listed(mem, search, state, file)
    key = F.desc(sort) if descending else F.asc(sort)
    return rows.orderBy(key, "memory_id").offset((page - 1) * per_page).limit(per_page)


def total_pages(mem: DataFrame, per_page: int = 50, **filters) -> DataFrame:
    return _listed(mem, filters.get("search"), filters.get("state"), filters.get("file")).agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("long"))


def _listed(mem: DataFrame, search: str | None, state: str | None, file: str | None) -> DataFrame:
    rows = mem
    if search:
        places = [F.lower(c).contains(search.lower()) for c in ("content", "label", "file_path") if c in mem.columns]
        ok = places[0]
        for p in places[1:]:
            ok = ok | p
        rows = rows.where(ok)
    if state is not None:
        rows = rows.where(F.col("state") == state)
    if file is not None:
        rows = rows.where(F.col("file_path") == file)
    return rows


def panel_filter(mem: DataFrame, state: str | None = None, file: str | None = None, importance: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    return _listed(mem, None, state, file).where(F.col("importance").between(*importance))


def health(sections: DataFrame, mem: DataFrame, now_us: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files with stale sections and how many, orphaned sections, and memories that have faded."""
    stale = sections.where(F.col("state").isin("stale", "content_stale")).groupBy("file_path").agg(F.count("*").alias("n"))
    return stale, sections.where("state = 'orphaned'"), mem.withColumn("decay_now", scoring.decay(now_us)).where(F.col("decay_now") <= FADED)


def memory_detail(mem: DataFrame, edges: DataFrame, neighbours: DataFrame, memory_id: str, now_us: int, most: int = 10_000) -> DataFrame:
    """One row: score breakdown, edges both ways (of a hub the first `most` of each), nearest others, and the sources of an insight."""
    one = mem.where(F.col("memory_id") == memory_id).withColumn("signals", scoring.breakdown(F.lit(0.0), now_us)).withColumn("decay_now", scoring.decay(now_us))
    out = edges.where(F.col("src") == memory_id).orderBy("edge_type", "dst").limit(most).agg(F.array_sort(F.collect_list(F.struct("edge_type", "dst", "confidence"))).alias("outgoing"))
    into = edges.where(F.col("dst") == memory_id).orderBy("edge_type", "src").limit(most).agg(F.array_sort(F.collect_list(F.struct("edge_type", "src", "confidence"))).alias("incoming"))
    near = neighbours.where(F.col("id") == memory_id).agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("neighbours"))
    sources = edges.where((F.col("src") == memory_id) & (F.col("edge_type") == "insight_from")).agg(F.array_sort(F.collect_list("dst")).alias("sources"))
    for part in (out, into, near, sources):  # one row each
        one = one.crossJoin(F.broadcast(part))
    return one


def cluster_labels(items: DataFrame) -> DataFrame:
    """items: (cluster, label). For each cluster the two most frequent words of its labels (three if the third is as frequent as the second)."""
    word = F.lower(F.regexp_replace("word", "[^\\p{L}\\p{N}_-]", ""))
    words = items.where("cluster >= 0").select("cluster", F.explode(F.split("label", "\\s+")).alias("word")).select("cluster", word.alias("word")).where((F.octet_length("word") >= 2) & ~F.col("word").isin(*LABEL_STOP_WORDS))
    ranked = words.groupBy("cluster", "word").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("n"), "word"))).where("r <= 3")
    top = ranked.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "n", "word"))).alias("w"))
    three = (F.size("w") == 3) & (F.get("w", F.lit(2))["n"] == F.get("w", F.lit(1))["n"])
    chosen = F.slice("w", F.lit(1), F.when(three, 3).otherwise(2))
    return top.select("cluster", F.array_join(F.transform(chosen, lambda s: F.concat(F.upper(F.substring(s["word"], 1, 1)), F.substr(s["word"], F.lit(2)))), " & ").alias("label"))


def cluster_labels_by(items: DataFrame, name: Callable[[Sequence[str]], str], sample: int = 20) -> DataFrame:
    """Labels by a callable over up to `sample` labels of each cluster; where it fails or gives nothing, those of cluster_labels()."""
    def call(labels):
        def one(xs) -> str | None:
            try:
                return name(list(xs)) or None
            except Exception:  # a model may fail in any way; the heuristic label stands in
                return None

        return labels.map(one)

    head = items.where("cluster >= 0").withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy("label"))).where(F.col("r") <= sample)
    named = head.groupBy("cluster").agg(F.array_sort(F.collect_list("label")).alias("labels")).select("cluster", F.pandas_udf(call, "string", F.PandasUDFType.SCALAR)("labels").alias("_own"))
    return named.join(cluster_labels(items), "cluster", "left").select("cluster", F.coalesce("_own", "label").alias("label"))


def insights(mem: DataFrame, entity: str | None = None, least_importance: float = 0.0, limit: int = 100, rank_first: bool = False) -> DataFrame:
    """Insights by importance; the limit is taken in the order of ids first unless rank_first."""
    rows = mem.where((F.col("kind") == "insight") & (F.col("importance") >= least_importance))
    rows = rows if entity is None else rows.where(F.col("entity_id") == entity)
    rows = rows if rank_first else rows.orderBy("memory_id").limit(limit)
    return rows.orderBy(F.desc("importance"), "memory_id").limit(limit)


def lineage(mem: DataFrame, edges: DataFrame) -> DataFrame:
    """mem with source_memory_ids: what each insight came from; null for others."""
    sources = edges.where("edge_type = 'insight_from'").groupBy(F.col("src").alias("memory_id")).agg(F.array_sort(F.collect_list("dst")).alias("source_memory_ids"))
    joined = mem.join(sources, "memory_id", "left")
    return joined.withColumn("source_memory_ids", F.when(F.col("kind") == "insight", F.coalesce("source_memory_ids", F.array().cast("array<string>"))))


def section_counts(sections: DataFrame) -> DataFrame:
    stale = F.col("state").isin("stale", "content_stale")
    return sections.agg(F.count("*").alias("total"), F.count_if(F.col("state") == "synced").alias("synced"), F.count_if(stale).alias("stale"), F.count_if(F.col("state") == "orphaned").alias("orphaned"))


def status(sections: DataFrame) -> DataFrame:
    """Counts, indexing_pct (only while some are stale) and a readiness code: empty, indexing or ready."""
    c = section_counts(sections)
    pct = F.when(F.col("stale") > 0, F.floor(F.col("synced") * 100 / F.col("total")).cast("long"))
    return c.withColumn("indexing_pct", pct).withColumn("code", F.when(F.col("total") == 0, "empty").when(F.col("stale") > 0, "indexing").otherwise("ready"))


#: Upper bounds of the latency histogram, in seconds.
BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 5.0, 10.0)


def metrics(log: DataFrame, mem: DataFrame) -> DataFrame:
    """(name, labels, value): the latency histogram of each operation, cumulative as scrapers want it, its count and sum in seconds, and the number
    of memories of each kind. One pass over each table."""
    sec = F.col("latency_us") / 1e6
    bounds = F.array(*(F.struct(F.lit(f"{b:g}").alias("le"), F.when(sec <= b, 1).otherwise(0).alias("n")) for b in BUCKETS), F.struct(F.lit("+Inf").alias("le"), F.lit(1).alias("n")))
    flat = log.select("operation", F.explode(bounds).alias("b")).groupBy("operation", "b.le").agg(F.sum("b.n").cast("double").alias("value"))
    label = lambda key, c: F.concat(F.lit(f'{key}="'), c, F.lit('"'))
    hist = flat.select(F.lit("operation_duration_seconds_bucket").alias("name"), F.concat(label("operation", F.col("operation")), F.lit(","), label("le", F.col("le"))).alias("labels"), "value")
    sums = log.groupBy("operation").agg(F.count("*").cast("double").alias("count"), F.sum(sec).alias("sum"))
    rest = sums.select(label("operation", F.col("operation")).alias("labels"), F.explode(F.array(F.struct(F.lit("operation_duration_seconds_count").alias("name"), F.col("count").alias("value")), F.struct(F.lit("operation_duration_seconds_sum").alias("name"), F.col("sum").alias("value")))).alias("m")).select("m.name", "labels", "m.value")
    held = mem.groupBy("kind").agg(F.count("*").cast("double").alias("value")).select(F.lit("memories").alias("name"), label("kind", F.col("kind")).alias("labels"), "value")
    return hist.unionByName(rest).unionByName(held)


def exposition(rows: DataFrame) -> str:
    """The rows of metrics() as text, a line each, sorted: a few for each operation and kind."""
    return "".join(f"engram_{r['name']}{{{r['labels']}}} {r['value']:g}\n" for r in rows.orderBy("name", "labels").collect())


def latency_percentiles(df: DataFrame, column: str) -> DataFrame:
    """One row: p50, p95, p99 and p999 of a column of whole numbers, exactly, by histograms in passes (querylog.percentile)."""
    found = {n: querylog.percentile(df, column, p, first=1) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))}
    return df.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"{n} long" for n in found))
