"""WARC archives: writing records, and reading them back by boundary-chain verification.

Writing: a record is one value of Spark's text writer with CR LF CR LF as the line separator, which is just how WARC ends a
record; files are written by any number of tasks to any store that Spark writes. Of records with equal payloads of at least
`min_bytes`, that with the smallest id is a response, the others are revisits of it.

Reading: the text reader splits files at the magic "WARC/1.", wherever it occurs, also inside payloads and at any block
boundary. Tasks emit for each occurrence the offset within its block, and where its header can be parsed the offset of the record
that would follow. Prefix sums over blocks make offsets in the file. Then pointers are doubled: after k rounds the first 2**k
records from the start of each file are known, and an occurrence that the chain never reaches is payload. The chain tables are joined by
merging, as they compress so well that their size in files says little of their size in memory. A record whose payload holds the
magic is put together again from the pieces of its file, which are read once more, with offsets of their own, so it does not
matter whether Spark then splits the file elsewhere; pieces meet their record by 64 kB stretches of the file, not by the file.
Every record that the chain reaches is returned, or the read fails.

Cases: null payload is empty; null url is empty, line breaks in it are dropped; null ids are written as "null" and read as null, and
never are the smallest if others exist; rows that repeat the smallest id of a payload are responses all; empty tables give
archives without records; payloads are bytes of any kind and length up to what Spark holds in one value (2 GB).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.llm._common import forget, materialize

MAGIC = "WARC/1."
END = "\r\n\r\n"
ID = "urn:page:"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of a 160-bit digest in hexadecimal: four characters from each five digits."""
    out = []
    for g in range(8):
        v = F.conv(F.substring(hexadecimal, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def write(df: DataFrame, id_col: str, url_col: str, payload_col: str, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row of df as files under path."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    # payloads that occur once, mostly all, need no partner; the rest is small enough to broadcast or else is joined by shuffle
    shared = materialize(rows.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("k")).where("k > 1").select("sha", "first"), "payloads")
    both = rows.join(shared, "sha", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit(f"{MAGIC}1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", ""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha")),
        F.lit("\r\nX-Payload-Length: "), F.col("n").cast("string"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.lit(len(_HTTP)) + F.when(again, 0).otherwise(F.col("n"))).cast("string"),
        F.lit(END + _HTTP),
    )
    body = F.when(again, F.lit("")).otherwise(F.col("payload").cast("string"))
    both.select(F.concat(head, body).alias("value")).write.option("lineSep", END).text(path)
    forget(shared)


def parse(piece: bytes) -> dict | None:
    """Header of a record that stands behind the magic, or None: names in lower case, and `block`, where the block begins."""
    at = piece.find(END.encode())
    if at < 0:
        return None
    lines = piece[:at].split(b"\r\n")
    if not lines[0].isdigit():
        return None
    out: dict = {}
    for line in lines[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        out[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not out.get("content-length", "").isdigit() or "warc-type" not in out:
        return None
    return out | {"block": at + len(END)}


def payload_of(block: bytes, content_type: str) -> bytes:
    if content_type.startswith("application/http"):
        return block.partition(END.encode())[2]
    return block


_FIELDS = "kind string, record_id string, uri string, refers_to string, said_digest string, said_bytes long, content_type string"
_PIECES = f"file string, split long, rel long, size long, head long, length long, {_FIELDS}, bytes long, digest string"


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("value"), "_metadata.file_path", "_metadata.file_block_start")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, offset within the block, piece) in the order of the file."""
    here, rel = None, 0
    for batch in batches:
        for value, file, split in zip(*batch.columns, strict=True):
            value, key = value.as_py() or b"", (file.as_py(), split.as_py())
            if key != here:
                here, rel = key, 0
            yield *key, rel, value
            rel += len(value) + len(MAGIC)


def _emit(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    parts = [x.strip().split(" ") for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(parts)], names=[n for n, _ in parts])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for file, split, rel, piece in _walk(batches):
        h = parse(piece)
        if h is None:
            rows.append((file, split, rel, len(piece), *[None] * 11))
        else:
            begin, n = h["block"], int(h["content-length"])
            whole = begin + n + len(END) <= len(piece)
            payload = payload_of(piece[begin : begin + n], h.get("content-type", "")) if whole else b""
            said = h.get("x-payload-length", "")
            rows.append((
                file, split, rel, len(piece), begin, n, h["warc-type"], h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), int(said) if said.isdigit() else None,
                h.get("content-type", ""), len(payload) if whole else None, base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else None,
            ))
        if len(rows) >= 5_000:
            yield _emit(rows, _PIECES)
            rows = []
    yield _emit(rows, _PIECES)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files under path, one row each: file, offset, kind, record_id, uri, refers_to, said_digest, said_bytes, bytes and
    digest of the payload in the file (that of a revisit is empty)."""
    pieces = materialize(_scan(spark, path).mapInArrow(_pieces, _PIECES), "pieces")
    placed = materialize(_placed(pieces), "placed")
    follow = F.col("off") + len(MAGIC) + F.col("head") + F.col("length") + len(END)
    reached = _reach(placed.where("head is not null").select("file", "off", follow.alias("next")))
    records = placed.join(reached.hint("merge"), ["file", "off"])
    fields = ["file", "off", "kind", "record_id", "uri", "refers_to", "said_digest", "said_bytes", "bytes", "digest"]
    whole = records.where("bytes is not null").select(fields)
    broken = materialize(records.where("bytes is null").select("file", "off", follow.alias("next"), "head", "length", "content_type", "kind", "record_id", "uri", "refers_to", "said_digest", "said_bytes"), "broken")
    forget(pieces)
    if not broken.limit(1).count():
        return whole
    return whole.unionByName(_join_pieces(spark, path, broken).select(fields))


def _reach(links: DataFrame) -> DataFrame:
    """(file, off) of the records that the chain from offset 0 reaches, by pointer doubling."""
    known = links.select("file", F.col("off").alias("next"), F.lit(True).alias("there"))
    now = materialize(links.join(known.hint("merge"), ["file", "next"], "left").select("file", "off", F.when(F.col("there"), F.col("next")).alias("jump"), (F.col("off") == 0).alias("reached")), "chain")
    while now.where("reached and jump is not null").limit(1).count():
        told = now.where("reached and jump is not null").select("file", F.col("jump").alias("off"), F.lit(True).alias("told"))
        twice = now.where("jump is not null").select("file", F.col("off").alias("jump"), F.col("jump").alias("far"))
        far = now.join(twice.hint("merge"), ["file", "jump"], "left")
        new = materialize(far.join(told.hint("merge"), ["file", "off"], "left").select("file", "off", F.col("far").alias("jump"), (F.col("reached") | F.coalesce("told", F.lit(False))).alias("reached")), "chain")
        forget(now)
        now = new
    return now.where("reached").select("file", "off")


def _placed(pieces: DataFrame) -> DataFrame:
    """pieces with `off`, their offset in the file: what the blocks before hold is summed up. The first piece of a file, which stands before
    any magic, goes."""
    held = pieces.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("held"))
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    base = held.select("file", "split", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return pieces.join(base, ["file", "split"]).withColumn("off", F.col("base") + F.col("rel") - len(MAGIC)).where("off >= 0").drop("base")


def _join_pieces(spark: SparkSession, path: str, broken: DataFrame) -> DataFrame:
    """Records whose payload holds the magic: the pieces of their files are read again, and joined in order."""
    files = materialize(broken.select("file").distinct(), "files")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for file, split, rel, piece in _walk(batches):
            rows.append((file, split, rel, len(piece), piece))
            size += len(piece) + 100
            if size > 4_000_000:
                yield _emit(rows, "file string, split long, rel long, size long, value binary")
                rows, size = [], 0
        yield _emit(rows, "file string, split long, rel long, size long, value binary")

    there = _scan(spark, path).join(files, F.col("file_path") == F.col("file"), "left_semi")
    texts = materialize(there.mapInArrow(again, "file string, split long, rel long, size long, value binary"), "texts")
    stretch = lambda c: F.shiftright(c, 16)
    spans = broken.select("file", F.col("off").alias("record"), "next", F.explode(F.sequence(stretch("off"), stretch(F.col("next") - 1))).alias("stretch"))
    wanted = _placed(texts).withColumn("stretch", stretch("off")).join(spans, ["file", "stretch"]).where("off >= record and off < next")
    joined = wanted.groupBy("file", F.col("record").alias("off")).agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("parts"))
    parts = F.transform("parts", lambda p: F.concat(F.lit(MAGIC).cast("binary"), p["value"]))
    text = F.unhex(F.array_join(F.transform(parts, F.hex), ""))
    block = F.substr(text, F.lit(len(MAGIC) + 1) + F.col("head").cast("int"), F.col("length").cast("int"))
    rows = broken.join(joined, ["file", "off"]).withColumn("block", block)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, kind in zip(batch.column(0), batch.column(1), strict=True):
                payload = payload_of(block.as_py(), kind.as_py() or "")
                out.append((len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()))
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([n for n, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], names=[*batch.schema.names[2:], "bytes", "digest"])

    keep = ["file", "off", "kind", "record_id", "uri", "refers_to", "said_digest", "said_bytes"]
    whole = (F.length("block") == F.col("length")).alias("complete")
    made = materialize(rows.where(whole).select("block", "content_type", *keep).mapInArrow(digest, "file string, off long, kind string, record_id string, uri string, refers_to string, said_digest string, said_bytes long, bytes long, digest string"), "joined")
    got, want = made.count(), broken.count()
    if got != want:
        raise RuntimeError(f"{want - got} of {want} records that hold the magic could not be put together: the archives are cut off, or changed meanwhile")
    forget(texts, files)
    return made


def id_of(name: Column, kind: str) -> Column:
    return F.regexp_extract(name, f"<{ID}(.*)>", 1).try_cast(kind)


def round_trip(df: DataFrame, id_col: str, url_col: str, payload_col: str, path: str, min_bytes: int = 0) -> DataFrame:
    """Write archives under path and read them: id, payload_bytes, payload_digest, record_type, refers_to."""
    kind = df.schema[id_col].dataType.simpleString()
    write(df, id_col, url_col, payload_col, path, min_bytes)
    found = read(df.sparkSession, path)
    full = F.col("kind") == "response"
    return found.select(
        id_of(F.col("record_id"), kind).alias(id_col),
        F.when(full, F.col("bytes")).otherwise(F.col("said_bytes")).alias("payload_bytes"),
        F.when(full, F.col("digest")).otherwise(F.regexp_replace("said_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        id_of(F.col("refers_to"), kind).alias("refers_to"),
    )


SQL = (
    "WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), d AS (SELECT page_id, octet_length(encode(t))::BIGINT AS n, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS f FROM p), "
    "v AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(h, (5 * g + 1)::INT, 5))::BIGINT) AS g FROM d) "
    f"SELECT page_id, n AS payload_bytes, list_aggregate(list_transform(g, lambda x: substr('{_BASE32}', ((x >> 15) & 31)::INT + 1, 1) || substr('{_BASE32}', ((x >> 10) & 31)::INT + 1, 1) || substr('{_BASE32}', ((x >> 5) & 31)::INT + 1, 1) || substr('{_BASE32}', (x & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest, "
    "CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM v"
)
