"""Markdown notes: scanning a folder of any store, parsing them into sections, and writing notes."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.text import glob_regex

DEFAULT_IGNORE = (".git", ".obsidian", ".trash", "node_modules", ".engram")
MIN_SECTION = 50
SECTION = "array<struct<heading_path: array<string>, level: int, start: long, stop: long, content: string, links: array<string>, tags: array<string>>>"
PARSED = f"struct<front_matter: string, sections: {SECTION}>"
_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
_LINK = re.compile(r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]")
_TAG = re.compile(r"(?:^|(?<=\s))#([A-Za-z][\w/-]*)")


def ignore_patterns(configured: list[str] | None = None, ignore_file: str | None = None) -> list[str]:
    """Defaults, those of the configuration, and the lines of an ignore file, each once."""
    lines = [x.strip() for x in (ignore_file or "").splitlines() if x.strip() and not x.startswith("#")]
    return list(dict.fromkeys([*DEFAULT_IGNORE, *(configured or []), *lines]))


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(file_path, content, checksum, modified) of every note below root; hidden and ignored files and folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    path = F.regexp_replace("path", "^" + re.escape("file:") if root.startswith("/") else "^$", "")
    rel = F.regexp_replace(path, "^/*" + re.escape(root.removeprefix("file:").strip("/")) + "/", "")
    hidden = F.exists(F.split(rel, "/"), lambda p: p.startswith(".") | p.rlike(glob_regex(ignore or ignore_patterns())))
    return files.select(rel.alias("file_path"), F.decode("content", "utf-8").alias("content"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("checksum"), F.col("modificationTime").alias("modified")).where(~hidden)


def front_matter(text: str) -> tuple[dict, int]:
    """The block of `key: value` lines between --- at the very start, and where the text goes on; invalid blocks are text."""
    if not text.startswith("---\n"):
        return {}, 0
    end = text.find("\n---", 3)
    if end < 0:
        return {}, 0
    out: dict = {}
    key = None
    for line in text[4:end].splitlines():
        if line.startswith(("  - ", "- ")) and key is not None:
            held = out.get(key)
            out[key] = [*(held if isinstance(held, list) else []), line.split("- ", 1)[1].strip().strip("\"'")]
        elif ":" in line:
            key, _, value = line.partition(":")
            key, value = key.strip(), value.strip()
            if value.startswith("[") and value.endswith("]"):
                out[key] = [x.strip().strip("\"'") for x in value[1:-1].split(",") if x.strip()]
            else:
                out[key] = value.strip("\"'")
        elif line.strip() and not line.startswith("#"):
            return {}, 0
    stop = text.find("\n", end + 1)
    return out, len(text) if stop < 0 else stop + 1


def parse(text: str, split_level: int = 2, least: int = MIN_SECTION) -> tuple[dict, list[dict]]:
    """Front matter, and sections cut at headings up to split_level; offsets are bytes. Headings in code fences are text."""
    meta, at = front_matter(text)
    sections: list[dict] = []
    stack: list[tuple[int, str]] = []
    here = {"heading_path": [], "level": 0, "start": len(text[:at].encode()), "lines": []}
    pos, fenced = here["start"], False
    for line in text[at:].splitlines(keepends=True):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        m = None if fenced else _HEADING.match(line.rstrip("\n"))
        if m and len(m[1]) <= split_level:
            sections.append(here | {"stop": pos})
            level = len(m[1])
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, m[2]))
            here = {"heading_path": [h for _, h in stack], "level": level, "start": pos, "lines": []}
        else:
            here["lines"].append(line)
        pos += len(line.encode())
    sections.append(here | {"stop": pos})
    out: list[dict] = []
    for s in sections:
        body = "".join(s.pop("lines"))
        if body.strip():
            out.append(s | {"content": body.strip("\n")})
    return meta, [s | _marks(s["content"]) for s in merge_short(out, least)]


def merge_short(sections: list[dict], least: int = MIN_SECTION) -> list[dict]:
    """A section below the least length goes to the one behind it, the last one to that before it."""
    out: list[dict] = []
    carried: dict | None = None
    for s in sections:
        if carried is not None:
            s = s | {"content": carried["content"] + "\n" + s["content"], "start": carried["start"]}
            carried = None
        if len(s["content"].strip()) < least:
            carried = s
        else:
            out.append(s)
    if carried is not None:
        if out:
            out[-1] = out[-1] | {"content": out[-1]["content"] + "\n" + carried["content"], "stop": carried["stop"]}
        else:
            out.append(carried)
    return out


def _marks(text: str) -> dict:
    plain = re.sub(r"`[^`\n]*`", "", re.sub(r"(?ms)^(```|~~~).*?^\1", "", text))
    return {"links": [x.strip() for x in _LINK.findall(plain)], "tags": list(dict.fromkeys(_TAG.findall(plain)))}


def parsed(notes: DataFrame, split_level: int = 2, least: int = MIN_SECTION) -> DataFrame:
    """notes with one row for each section: heading_path, level, start, stop, section, links, tags, front_matter, section_hash."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in notes.schema if f.name != "content")
    keep = [f.name for f in notes.schema if f.name != "content"]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                meta, sections = parse(r["content"] or "", split_level, least)
                for s in sections:
                    rows.append({k: r[k] for k in keep} | {"front_matter": json.dumps(meta, sort_keys=True), "heading_path": s["heading_path"], "level": s["level"], "start": s["start"], "stop": s["stop"], "section": s["content"], "links": s["links"], "tags": s["tags"], "section_hash": "sha256:" + hashlib.sha256(s["content"].encode()).hexdigest()})
            yield pd.DataFrame(rows, columns=[*keep, "front_matter", "heading_path", "level", "start", "stop", "section", "links", "tags", "section_hash"])

    return notes.mapInPandas(run, f"{schema}, front_matter string, heading_path array<string>, level int, start long, stop long, section string, links array<string>, tags array<string>, section_hash string")


def read_section(content: str, start: int, stop: int) -> tuple[str, bool]:
    """The section's text without its heading, and whether the offsets no longer fit the file."""
    data = content.encode()
    if stop > len(data) or start > stop:
        return "", True
    text = data[start:stop].decode("utf-8", "replace")
    first, _, rest = text.partition("\n")
    return (rest if _HEADING.match(first) else text).strip("\n"), False


def note(title: str, meta: dict, body: str) -> str:
    lines = [f"{k}: {json.dumps(v) if isinstance(v, list) else v}" for k, v in meta.items()]
    return "---\n" + "\n".join(lines) + "\n---\n\n# " + title + "\n\n" + body + "\n"


def insight_notes(insights: DataFrame) -> DataFrame:
    """(file_path, text) of one note for each insight, with its sources (source_memory_ids) as links."""
    links = F.array_join(F.transform(F.coalesce("source_memory_ids", F.array().cast("array<string>")), lambda s: F.concat(F.lit("- [["), s, F.lit("]]"))), "\n")
    head = F.concat(F.lit("---\nkind: insight\nid: "), F.col("memory_id"), F.lit("\nimportance: "), F.col("importance").cast("string"), F.lit("\n---\n\n"))
    return insights.select(F.concat(F.lit("insights/"), F.col("memory_id"), F.lit(".md")).alias("file_path"), F.concat(head, F.col("content"), F.lit("\n\n## Sources\n"), links, F.lit("\n")).alias("text"))


def contradiction_notes(pairs: DataFrame) -> DataFrame:
    """(file_path, text) of one note for each pair (id_a, id_b, snippet_a, snippet_b, confidence)."""
    body = F.concat(F.lit("---\nkind: contradiction\nconfidence: "), F.col("confidence").cast("string"), F.lit("\n---\n\n- [["), F.col("id_a"), F.lit("]] "), F.col("snippet_a"), F.lit("\n- [["), F.col("id_b"), F.lit("]] "), F.col("snippet_b"), F.lit("\n"))
    return pairs.select(F.concat(F.lit("contradictions/"), F.substring("id_a", 1, 16), F.lit("-"), F.substring("id_b", 1, 16), F.lit(".md")).alias("file_path"), body.alias("text"))


def write_notes(notes: DataFrame, root: str) -> None:
    """One partition folder a note, written by Spark to any store; a note is the folder's only file."""
    notes.select(F.col("text").alias("value"), "file_path").write.mode("overwrite").option("lineSep", "\n").partitionBy("file_path").text(root)
