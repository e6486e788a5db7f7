"""The memory tables as views of the supplied tables, in Spark and as common table expressions for DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NOW_US = 1_706_745_600_000_000
_TEXT = """select lpad(lower({hex}(event_id+1)),32,'0') as memory_id, event_type||' '||props as content, least(cast(1 as double),value/500) as importance, props as context,
 'user_'||cast(user_id as {str}) as entity_id, {us} as created_at, event_id%150 as access_count, {us}+(event_id%7)*86400000000 as last_accessed_at,
 case event_type when 'click' then 'episode' when 'view' then 'document' when 'purchase' then 'insight' when 'error' then 'proposition' else 'revision' end as kind,
 case when user_id%2=0 then 'default' else 'tenant_b' end as tenant_id, least(cast(1 as double),value/500) as decay_score, event_id, user_id, event_type, {k} as k from {events}"""
_EDGES = """select src, dst, 'followed_by' as edge_type, cast(1.0 as double) as confidence, ts_us from (select memory_id as src, lag(memory_id) over(partition by user_id order by created_at,event_id) as dst, created_at as ts_us from {m}) f where dst is not null
union all select src, dst, 'caused_by', cast(0.8 as double), ts_us from (select memory_id as src, event_type, created_at as ts_us, substr(max(case when event_type='click' then lpad(cast(created_at as {str}),20,'0')||memory_id end) over(partition by user_id order by created_at,event_id rows between unbounded preceding and 1 preceding),21) as dst from {m}) c where event_type='error' and dst is not null
union all select src, dst, 'related_to', cast(0.5 as double), ts_us from (select memory_id as src, lag(memory_id) over(partition by k order by event_id) as dst, created_at as ts_us from {m}) r where dst is not null
union all select src, dst, 'insight_from', importance, ts_us from (select memory_id as src, kind, importance, created_at as ts_us, lag(memory_id,1) over(partition by user_id order by created_at,event_id) as dst from {m}) i where kind='insight' and dst is not null
union all select src, dst, 'insight_from', importance, ts_us from (select memory_id as src, kind, importance, created_at as ts_us, lag(memory_id,2) over(partition by user_id order by created_at,event_id) as dst from {m}) j where kind='insight' and dst is not null
union all select a.memory_id, b.memory_id, 'contradicts', cast(0.7 as double), a.created_at from {m} a join {m} b on b.event_id=a.event_id+1 where a.event_id%97=0
union all select b.memory_id, a.memory_id, 'contradicts', cast(0.7 as double), b.created_at from {m} a join {m} b on b.event_id=a.event_id+1 where a.event_id%97=0"""
_DUCK = {"hex": "to_hex", "str": "varchar", "us": "epoch_us(ts)", "k": "cast(json_extract(props,'$.k') as bigint)", "events": "events"}
_SPARK = {"hex": "hex", "str": "string", "us": "unix_micros(cast(ts as timestamp))", "k": "cast(get_json_object(props,'$.k') as bigint)"}

SQL_M = f"m as ({_TEXT.format(**_DUCK)})"
SQL_V = f"{SQL_M}, v as (select m.*, cast(e.embedding as double[]) as embedding from m join embeddings e on e.vec_id = m.event_id % 500)"
SQL_E = f"{SQL_M}, edges as ({_EDGES.format(m='m', **_DUCK)})"
SQL_ALL = f"{SQL_V}, edges as ({_EDGES.format(m='m', **_DUCK)})"
SQL_D = "d as (select 'f0'||lpad(lower(to_hex(d.doc_id)),30,'0') as memory_id, text as content, source as entity_id, 1704067200000000+d.doc_id*60000000 as created_at, case when l.quality=1 then cast(0.8 as double) else cast(0.5 as double) end as importance, 'document' as kind from documents d left join labels l on l.doc_id=d.doc_id)"
SQL_Q = "q as (select event_id as id, epoch_us(ts) as timestamp_us, case when event_id%2=0 then 'recall' else 'prime' end as operation, event_type as caller, props as query, 10::bigint as top_k, 'user_'||user_id as entity_id, least(1.0::double, value/500) as top_score, cast(round(value*100) as bigint) as latency_us from events)"


def memories(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = spark.sql(_TEXT.format(**_SPARK, events="{events}"), events=events)
    out = out.withColumn("updated_at", F.col("created_at"))
    if vectors:
        # 500 rows at most, whatever the table holds
        e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id >= 0 and vec_id < 500").select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        out = out.join(F.broadcast(e), F.col("event_id") % 500 == F.col("vec_id")).drop("vec_id").withColumn("assoc_embedding", F.col("embedding"))
    return out


def edges(spark: SparkSession, sf_dir: str, task_rows: int = 250_000) -> DataFrame:
    """The edges of SQL_E. Rows are ordered within users and keys without their texts, in tasks of about task_rows rows whatever the table holds."""
    m = memories(spark, sf_dir).select("event_id", "user_id", "created_at", "event_type", "kind", "importance", "k")
    parts = max(1, -(-m.select().count() // task_rows))
    name = lambda c: F.lpad(F.lower(F.hex(F.col(c) + 1)), 32, F.lit("0"))
    edge = lambda df, dst, kind, confidence, src="event_id", ts="created_at": df.where(F.col(dst).isNotNull()).select(name(src).alias("src"), name(dst).alias("dst"), F.lit(kind).alias("edge_type"), confidence.cast("double").alias("confidence"), F.col(ts).alias("ts_us"))
    order = W.partitionBy("user_id").orderBy("created_at", "event_id")
    click = F.when((F.col("event_type") == "click") & F.col("created_at").isNotNull(), F.struct("created_at", "event_id"))
    users = m.select("event_id", "user_id", "created_at", "event_type", "kind", "importance").repartition(parts, "user_id")
    users = users.select("*", F.lag("event_id").over(order).alias("one"), F.lag("event_id", 2).over(order).alias("two"), F.max(click).over(order.rowsBetween(W.unboundedPreceding, -1))["event_id"].alias("click"))
    keys = m.select("event_id", "k", "created_at").repartition(parts, "k").withColumn("one", F.lag("event_id").over(W.partitionBy("k").orderBy("event_id")))
    a = m.where("event_id % 97 = 0").select("event_id", "created_at", (F.col("event_id") + 1).alias("next"))
    pairs = a.join(m.select(F.col("event_id").alias("next"), F.col("created_at").alias("later")), "next")
    insights = users.where("kind = 'insight'")
    found = [
        edge(users, "one", "followed_by", F.lit(1.0)), edge(users.where("event_type = 'error'"), "click", "caused_by", F.lit(0.8)), edge(keys, "one", "related_to", F.lit(0.5)),
        edge(insights, "one", "insight_from", F.col("importance")), edge(insights, "two", "insight_from", F.col("importance")),
        edge(pairs, "next", "contradicts", F.lit(0.7)), edge(pairs, "event_id", "contradicts", F.lit(0.7), "next", "later"),
    ]
    return reduce(DataFrame.unionByName, found)


def document_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = SQL_D[len("d as (") : -1].replace("to_hex", "hex").replace("documents d", "{d}").replace("labels l on", "{l} l on")
    text = text.replace("from {d}", "from {d} d")
    return spark.sql(text, d=spark.read.parquet(f"{sf_dir}/documents.parquet"), l=spark.read.parquet(f"{sf_dir}/labels.parquet"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp_us"), F.when(F.col("event_id") % 2 == 0, "recall").otherwise("prime").alias("operation"),
        F.col("event_type").alias("caller"), F.col("props").alias("query"), F.lit(10).cast("long").alias("top_k"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("entity_id"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("top_score"), F.round(F.col("value") * 100).cast("long").alias("latency_us"),
    )


def vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    row = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]
