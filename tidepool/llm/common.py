"""What the operators of this folder share: tables, shared folders, files and worker caches."""

from __future__ import annotations

import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one step in a worker handles at a time.
SLICE_CHARS = 2_000_000

WORD = re.compile(r"\w+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one where none is set (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/tidepool"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Deletes tables that stash() wrote, once nothing reads them any more; other tables are left alone."""
    for df in stashed:
        if path := getattr(df, "stashed_at", None):
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over: it does so when what refers to them is collected as garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def filesystem(uri: str):
    """(file system, path) of a URI, for reading and writing from executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def worker_slot(key, build: Callable):
    """What build() made for this key, kept by the Python process for its next tasks. Another key takes its place, so that
    a worker that has run several operators holds the memory of one."""
    held = sys.__dict__.setdefault("_tidepool_slot", {})
    if held.get("key") != key:
        held.clear()
        if build:
            held.update(key=key, value=build())
    return held.get("value")


def in_slices(text: pa.Array, most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of rows with about `most` bytes each; a longer row is alone in its run."""
    size = np.diff(np.frombuffer(text.buffers()[1], dtype=np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + len(text) + 1]) if len(text) else np.zeros(0, int)
    start = total = 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(text):
        yield start, len(text)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in in_slices(batch.column(column), most):
            yield batch.slice(a, b - a)


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, fn: Callable, schema: str, keeps: bool = False, batch: str = "8m") -> DataFrame:
    """df.mapInArrow; unless fn `keeps` something in the worker, what others kept there is let go first.

    Sets the session's bytes for an Arrow batch: whole texts may be long, and each task holds some batches outside the heap.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch)

    def run(batches):
        if not keeps:
            worker_slot(None, None)
        trim()
        yield from fn(batches)
        trim()

    return df.mapInArrow(run, schema)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = 32) -> DataFrame:
    """left joined with right, whose keys are unique: right is copied `salts` times, so that a hot key's rows of left are dealt over as many places."""
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(right, [*keys, "_salt"], how).drop("_salt")


def n_scan_partitions(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())


def crc32_of_text(c) -> F.Column:
    return F.crc32(F.encode(c, "UTF-8"))


def words_of(text: str) -> list[str]:
    """Words for comparing documents: runs of letters, digits and _ in lower case."""
    return WORD.findall(text.lower())

