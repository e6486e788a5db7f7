"""Ingestion of notes: what changed, extraction, and the rows and edges that follow; staged DataFrame jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram import llm_api
from engram.functions import text

SUMMARY_TOKENS, PER_FILE, DOCUMENT_IMPORTANCE, PROPOSITION_IMPORTANCE = 4096, 200, 0.6, 0.5


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose checksum differs from the known one, or that are new."""
    k = known.select("file_path", F.col("checksum").alias("_old"))
    return files.join(k, "file_path", "left").where(~F.col("checksum").eqNullSafe(F.col("_old"))).drop("_old")


def section_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer join on (file_path, heading_path) -> state: synced (the same), content_stale (the text changed; the id stays), stale (new), orphaned (gone)."""
    o = old.select("file_path", "heading_path", "section_id", F.col("section_hash").alias("_oh"))
    last = W.partitionBy("file_path", "heading_path").orderBy(F.desc("start"))  # equal headings of one file: the last stands
    n = new.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("file_path", "heading_path", F.col("section_hash").alias("_nh"), "start", "stop")
    both = o.join(n, ["file_path", "heading_path"], "full_outer")
    state = F.when(F.col("_nh").isNull(), "orphaned").when(F.col("_oh").isNull(), "stale").when(F.col("_oh") == F.col("_nh"), "synced").otherwise("content_stale")
    fresh = F.sha2(F.concat_ws("/", "file_path", F.array_join("heading_path", "/")), 256)
    return both.select("file_path", "heading_path", F.coalesce("section_id", F.substring(fresh, 1, 32)).alias("section_id"), F.coalesce("_nh", "_oh").alias("section_hash"), "start", "stop", state.alias("state"))


def orphan_file(sections: DataFrame, file_path: str) -> DataFrame:
    return sections.withColumn("state", F.when(F.col("file_path") == file_path, "orphaned").otherwise(F.col("state")))


def mark_synced(sections: DataFrame, done: DataFrame) -> DataFrame:
    """Sections of files that were extracted are synced; orphaned ones are dropped with them."""
    d = done.select("file_path").distinct().withColumn("_done", F.lit(True))
    joined = sections.join(d, "file_path", "left")
    return joined.where(~(F.coalesce("_done", F.lit(False)) & (F.col("state") == "orphaned"))).withColumn("state", F.when(F.col("_done"), "synced").otherwise(F.col("state"))).drop("_done")


def requests(notes: DataFrame, by_section: DataFrame | None = None) -> DataFrame:
    """(file_path, title, body) one a file, or one a section if sections are given."""
    if by_section is None:
        return notes.select("file_path", F.col("file_path").alias("title"), text.strip_boilerplate(F.col("content")).alias("body"))
    return by_section.select("file_path", F.array_join("heading_path", " / ").alias("title"), text.strip_boilerplate(F.col("section")).alias("body"))


def extract(asked: DataFrame, provider: llm_api.LlmProvider) -> DataFrame:
    """asked with `parsed`: propositions, entities and relations."""
    prompt = F.concat(F.lit("Extract propositions, entities and relations as JSON.\n# "), F.col("title"), F.lit("\n"), F.col("body"))
    return llm_api.parse(llm_api.map_prompts(asked.withColumn("prompt", prompt), "prompt", provider), "answer")


def documents(notes: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """The document row of each file: its text, or its summary if it is above 4096 tokens and there is one."""
    rows = notes.withColumn("tokens", text.estimate_tokens(F.col("content")))
    if summaries is not None:
        rows = rows.join(summaries, "file_path", "left").withColumn("content", F.when((F.col("tokens") > SUMMARY_TOKENS) & F.col("summary").isNotNull(), F.col("summary")).otherwise(F.col("content")))
    return rows.select(F.sha2(F.concat(F.lit("document/"), F.col("file_path")), 256).substr(1, 32).alias("memory_id"), "file_path", "content", F.lit("document").alias("kind"), F.lit(DOCUMENT_IMPORTANCE).alias("importance"))


def propositions(extracted: DataFrame, per_file: int | None = PER_FILE) -> DataFrame:
    """(file_path, content, hash, confidence): the first of equal propositions of a file, and at most per_file of them (None: all), in their order."""
    p = extracted.select("file_path", F.posexplode("parsed.propositions").alias("pos", "p")).select("file_path", "pos", F.col("p.text").alias("content"), F.col("p.confidence").alias("confidence")).where(F.trim("content") != "").withColumn("hash", text.proposition_hash(F.col("content")))
    one = p.withColumn("_r", F.row_number().over(W.partitionBy("file_path", "hash").orderBy("pos"))).where("_r = 1")
    if per_file is None:
        return one.drop("_r")
    return one.withColumn("_r", F.row_number().over(W.partitionBy("file_path").orderBy("pos"))).where(F.col("_r") <= per_file).drop("_r")


def merge_propositions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer join of hashes -> (file_path, hash, memory_id, action): keep, add or drop."""
    s = stored.select("file_path", "hash", F.col("memory_id"), F.lit(True).alias("_s"))
    n = new.select("file_path", "hash", F.lit(True).alias("_n"))
    action = F.when(F.col("_s").isNull(), "add").when(F.col("_n").isNull(), "drop").otherwise("keep")
    return s.join(n, ["file_path", "hash"], "full_outer").select("file_path", "hash", F.coalesce("memory_id", F.sha2(F.concat_ws("/", "file_path", "hash"), 256).substr(1, 32)).alias("memory_id"), action.alias("action"))


def mention_edges(rows: DataFrame, relations: DataFrame) -> DataFrame:
    """relations: (file_path, source, target, type). Edges between the first rows of the file that mention the names."""
    named = relations.select("file_path", F.explode(F.array("source", "target")).alias("name")).distinct()
    seen = rows.join(named, "file_path").where(F.instr(F.lower("content"), F.lower("name")) > 0)
    first = seen.groupBy("file_path", "name").agg(F.min_by("memory_id", F.struct("pos", "memory_id")).alias("memory_id"))
    a, b = first.select("file_path", F.col("name").alias("source"), F.col("memory_id").alias("src")), first.select("file_path", F.col("name").alias("target"), F.col("memory_id").alias("dst"))
    return relations.join(a, ["file_path", "source"]).join(b, ["file_path", "target"]).where("src <> dst").select("src", "dst", F.lit("entity_relation").alias("edge_type"), F.lit(1.0).alias("confidence")).distinct()


@dataclass
class Ingested:
    """What phase two makes of the notes of stale files: rows for remember(), ids that go, edges, and the sections as they are then."""

    rows: DataFrame
    dropped: DataFrame
    edges: DataFrame
    sections: DataFrame


def phase2(notes: DataFrame, sections: DataFrame, stored: DataFrame, provider: llm_api.LlmProvider) -> Ingested:
    """notes: (file_path, content); sections: those of section_diff(); stored: (file_path, hash, memory_id) of propositions. Files with a stale section
    are extracted anew: their document, the propositions that are new, edges from propositions to their document and between the first mentions of
    related names; propositions that no longer stand in the file go."""
    todo = sections.where(F.col("state") != "synced").select("file_path").distinct()
    own = notes.join(todo, "file_path", "left_semi")
    extracted = extract(requests(own), provider)
    doc = documents(own)
    found = propositions(extracted)
    actions = merge_propositions(stored.join(todo, "file_path", "left_semi"), found.select("file_path", "hash"))
    new = found.join(actions.where("action = 'add'").select("file_path", "hash", "memory_id"), ["file_path", "hash"])
    kept = found.join(actions.where("action <> 'drop'").select("file_path", "hash", "memory_id"), ["file_path", "hash"])
    rows = doc.select("memory_id", "content", "kind", "importance", F.col("file_path").alias("entity_id")).unionByName(new.select("memory_id", "content", F.lit("proposition").alias("kind"), F.lit(PROPOSITION_IMPORTANCE).alias("importance"), F.col("file_path").alias("entity_id")))
    of_document = kept.join(doc.select("file_path", F.col("memory_id").alias("dst")), "file_path").select(F.col("memory_id").alias("src"), "dst", F.lit("proposition_of").alias("edge_type"), F.col("confidence").cast("double").alias("confidence"))
    relations = extracted.select("file_path", F.explode("parsed.relations").alias("r")).select("file_path", "r.source", "r.target", "r.type")
    edges = of_document.unionByName(mention_edges(kept.select("file_path", "pos", "memory_id", "content"), relations))
    return Ingested(rows, actions.where("action = 'drop'").select("memory_id"), edges, mark_synced(sections, todo))


def rebuild(notes: DataFrame, parsed: DataFrame, provider: llm_api.LlmProvider) -> Ingested:
    """Everything anew, as if nothing had been stored: parsed has the sections of the notes (sources.markdown.parsed)."""
    none = notes.sparkSession.createDataFrame([], "file_path string, heading_path array<string>, section_id string, section_hash string")
    stored = notes.sparkSession.createDataFrame([], "file_path string, hash string, memory_id string")
    return phase2(notes, section_diff(none, parsed), stored, provider)


def coalesce_events(events: DataFrame, quiet_us: int = 500_000) -> DataFrame:
    """events: (file_path, kind, ts_us) of a watcher. One row for each quiet spell of a file: created and deleted within it is nothing, a
    deletion followed by a creation is a change, else the last kind counts."""
    order = W.partitionBy("file_path").orderBy("ts_us")
    starts = F.when(F.col("ts_us") - F.lag("ts_us").over(order) <= quiet_us, 0).otherwise(1)
    spells = events.withColumn("_s", starts).withColumn("spell", F.sum("_s").over(order.rowsBetween(W.unboundedPreceding, 0)))
    ends = spells.groupBy("file_path", "spell").agg(F.min_by("kind", "ts_us").alias("first"), F.max_by("kind", "ts_us").alias("last"), F.max("ts_us").alias("ts_us"), F.count("*").alias("n"))
    kind = F.when((F.col("first") == "created") & (F.col("last") == "deleted"), None).when((F.col("first") == "deleted") & (F.col("last") == "created"), "modified").when((F.col("first") == "created"), "created").otherwise(F.col("last"))
    return ends.withColumn("kind", kind).where("kind is not null").select("file_path", "kind", "ts_us", "n")
