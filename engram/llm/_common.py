"""Helpers that the training-data operators share: table reading, shared scratch tables, Arrow mapping."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def valid(text: Column) -> Column:
    """The text with bytes that are not UTF-8 replaced, as Python workers cannot read them; null stays null."""
    return F.make_valid_utf8(text)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset and there is one machine (tests) a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="engram-")
    return _LOCAL["dir"]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone; the shared folder is then cleaned by its owner
        return


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's Python ends."""
    path = f"{scratch_dir(spark)}/engram/{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, key: str, buckets: int, folder: str) -> tuple[DataFrame, Callable[[object], None]]:
    """As materialize(), in files by the hash of a column, so that later groupings by it do not move the table, and in a folder for each value of
    another column; also what deletes the folder of a value that nothing will read again."""
    spark = df.sparkSession
    path, n = scratch_path(spark, tag), max(1, min(buckets, 50_000))
    name = f"engram_{path.rsplit('-', 1)[1]}"
    df.write.partitionBy(folder).bucketBy(n, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name), lambda value: _delete(spark, f"{path}/{folder}={value}")


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps whose results are written: it does so when the driver's garbage is collected, the first time
    plans, the second time what they held."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def forget(*frames: DataFrame) -> None:
    """Delete scratch tables made by materialize() that nothing will read again."""
    for df in frames:
        files = df.inputFiles()
        if files:
            _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def give_back() -> None:
    """Return freed memory to the machine: Python workers are kept between tasks, also while later stages run in the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has it
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, rows: int = 1_000) -> DataFrame:
    """Arrow-batched map. make() runs once in a task and returns a function from a batch of at most `rows` rows to columns."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                out = step(whole.slice(at, rows))
                yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)
            del whole
            give_back()

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> Iterator[str]:
    """Python strings one at a time, null as empty, so that a batch of long texts is not held twice."""
    for x in column:
        yield x.as_py() or ""
