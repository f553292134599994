"""Content: addresses, duplicates, entropy, chunks, packs, ranges to read, and integrity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidepool.functions import batches, paths

MAX_RANGE, PACK_SIZE = 4 << 20, 64 << 20
CHUNK_MIN, CHUNK_NORMAL, CHUNK_MAX = 512 << 10, 1 << 20, 8 << 20


def byte_entropy(data: Column) -> Column:
    """Shannon entropy over byte values, in bits; 0 for no bytes, null for null."""
    batches.bounded()
    return _byte_entropy(data)


@F.arrow_udf(DoubleType())
def _byte_entropy(data: pa.Array) -> pa.Array:
    def one(x):
        if x is None:
            return None
        if not len(x):
            return 0.0
        n = np.bincount(np.frombuffer(x, np.uint8), minlength=256)
        p = n[n > 0] / len(x)
        return float(-(p * np.log2(p)).sum()) + 0.0

    out = pa.array([one(x) for x in batches.buffers(data)], pa.float64())
    batches.trim()
    return out


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """rows (id, mac, length) -> each address with its copies and the bytes that keeping one saves."""
    return rows.groupBy("mac").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.max("length").alias("length")).withColumn("saved", F.col("length") * (F.col("copies") - 1))


def object_totals(chunks: DataFrame) -> DataFrame:
    """chunks (object, ordinal, length, entropy) -> size, number and length-weighted entropy of each object."""
    return chunks.groupBy("object").agg(F.sum("length").alias("size"), F.count("*").alias("n_chunks"), (F.sum(F.col("entropy") * F.col("length")) / F.nullif(F.sum("length"), F.lit(0))).alias("entropy"))


def reassembled(chunks: DataFrame) -> DataFrame:
    """chunks (object, ordinal, data) -> the object's data, in order."""
    return chunks.groupBy("object").agg(F.array_sort(F.collect_list(F.struct("ordinal", "data"))).alias("c")).select("object", F.array_join(F.col("c.data"), "").alias("data"))


def fixed_chunks(rows: DataFrame, size: int, data: str = "data") -> DataFrame:
    """Chunks of `size` characters, with ordinal and offset."""
    n = F.ceil(F.length(data) / size).cast("int")
    rows = rows.where(F.length(data) > 0).withColumn("ordinal", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("offset", F.col("ordinal").cast("bigint") * size).withColumn("chunk", F.expr(f"substring({data}, cast(offset + 1 as int), {size})")).drop(data)


_GEAR = np.random.default_rng(0x6EA5).integers(0, 1 << 63, 256, np.uint64)
#: Bytes that a rolling hash depends on, and that are hashed at a time.
REACH, SPAN = 64, 1 << 20
#: Chunks, and bytes of their data, that a worker hands on at once.
PIECE_ROWS, PIECE_BYTES = 10_000, 4 << 20


def gear_hashes(data: bytes, start: int, stop: int) -> np.ndarray:
    """The rolling hash at each place of [start, stop): the sum of g(byte) << age over the last REACH bytes, by doubling."""
    first = max(0, start - REACH + 1)
    h, age = _GEAR[np.frombuffer(data, np.uint8, stop - first, first)], 1
    while age < REACH:
        h[age:] = h[age:] + (h[:-age] << np.uint64(age))
        age *= 2
    return h[start - first :]


def cut_points(data: bytes, least: int = CHUNK_MIN, normal: int = CHUNK_NORMAL, most: int = CHUNK_MAX) -> list[int]:
    """Ends of content-defined chunks: a gear hash with a stricter mask before the normal size and a looser one after it.

    Places that a mask accepts are found for the whole of the data first, a span at a time; chunks then go from one to another.
    """
    bits = int(math.log2(normal))
    strict, loose = (np.uint64(((1 << (bits + n)) - 1) << 20) for n in (1, -1))
    found: tuple[list, list] = ([], [])
    for a in range(0, len(data), SPAN):
        h = gear_hashes(data, a, min(len(data), a + SPAN))
        for mask, out in zip((strict, loose), found, strict=True):
            out.append(np.flatnonzero((h & mask) == 0) + a + 1)
    tight, wide = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in found)
    out, start, n = [], 0, len(data)
    while n - start > least:
        stop = min(n, start + most)
        i, j = np.searchsorted(tight, start + least, "right"), np.searchsorted(wide, start + max(normal, least), "right")
        end = min(int(tight[i]) if i < len(tight) and tight[i] <= start + normal else stop, int(wide[j]) if j < len(wide) else stop, stop)
        out.append(end)
        start = end
    return out + [n] if start < n else out


def content_chunks(rows: DataFrame, least: int = CHUNK_MIN, normal: int = CHUNK_NORMAL, most: int = CHUNK_MAX, with_data: bool = False) -> DataFrame:
    """rows (id, content binary) -> id, ordinal, offset, length, mac of each content-defined chunk, and its data if asked for.

    Contents are read in small Arrow batches and where they lie; chunks are handed on in pieces. Ids are passed through
    as they are.
    """
    import hashlib

    def pieces(batch):
        held, size = [], 0
        for row, data in enumerate(batches.buffers(batch.column("content"))):
            at = 0
            for k, end in enumerate(cut_points(data, least, normal, most) if data is not None else ()):
                part = data.slice(at, end - at)
                held.append((row, k, at, end - at, hashlib.sha256(part).hexdigest(), part.to_pybytes() if with_data else None))
                size += end - at if with_data else 0
                at = end
                if len(held) >= PIECE_ROWS or size >= PIECE_BYTES:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(found):
        for batch in found:
            for held in pieces(batch):
                row, *columns = (pa.array(x, kind) for x, kind in zip(zip(*held, strict=True), kinds, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(row), *columns[: len(names) - 1]], names=names)
            batches.trim()

    names = ["id", "ordinal", "offset", "length", "mac", *(["data"] if with_data else [])]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    kind = rows.schema["id"].dataType.simpleString()
    batches.bounded()
    return rows.select("id", "content").mapInArrow(run, f"id {kind}, ordinal int, offset long, length long, mac string" + (", data binary" if with_data else ""))


# -- packs and ranges ------------------------------------------------------------------------------------------------


def pack_offsets(blobs: DataFrame) -> DataFrame:
    """blobs (packfile, seq, length) with the offset at which each is appended."""
    w = Window.partitionBy("packfile").orderBy("seq", "length").rowsBetween(Window.unboundedPreceding, -1)
    return blobs.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)))


def pack_bins(blobs: DataFrame, limit: int = PACK_SIZE) -> DataFrame:
    """blobs (channel, seq, length) with the number of the pack of their channel: a pack is closed once it is over the limit.

    Rows are folded in order, a channel at a time, in Arrow-sized pieces; no channel is held in memory.
    """

    def run(frames):
        channel, n, size = None, 0, 0
        for frame in frames:
            bins = []
            for c, length in zip(frame["channel"], frame["length"], strict=True):
                if c != channel:
                    channel, n, size = c, 0, 0
                bins.append(n)
                size += length
                if size > limit:
                    n, size = n + 1, 0
            yield frame.assign(bin=bins)

    rows = blobs.select("channel", "seq", "length").repartition("channel").sortWithinPartitions("channel", "seq")
    return rows.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", bin long")


def read_plan(locations: DataFrame, most: int = MAX_RANGE) -> DataFrame:
    """locations (packfile, offset, length) -> ranges (packfile, offset, length, blobs): in order, a range takes the next blob while its span stays within `most`; gaps count."""

    def run(frames):
        held = None
        for frame in frames:
            out = []
            for p, o, n in zip(frame["packfile"], frame["offset"], frame["length"], strict=True):
                if held and held[0] == p and o + n - held[1] <= most:
                    held = (p, held[1], o + n - held[1], held[3] + 1)
                else:
                    if held:
                        out.append(held)
                    held = (p, o, n, 1)
            yield pd.DataFrame(out, columns=["packfile", "offset", "length", "blobs"])
        if held:
            yield pd.DataFrame([held], columns=["packfile", "offset", "length", "blobs"])

    rows = locations.select("packfile", F.col("offset").cast("long"), F.col("length").cast("long")).repartition("packfile").sortWithinPartitions("packfile", "offset", "length")
    return rows.mapInPandas(run, f"packfile {rows.schema['packfile'].dataType.simpleString()}, offset long, length long, blobs long")


def runs(locations: DataFrame) -> DataFrame:
    """Contiguous stretches of each packfile."""
    w = Window.partitionBy("packfile").orderBy("offset", "length")
    rows = locations.withColumn("end", F.col("offset") + F.col("length")).withColumn("new", (F.coalesce(F.lag("end").over(w), F.lit(-1)) != F.col("offset")).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("packfile", "run").agg(F.min("offset").alias("offset"), (F.max("end") - F.min("offset")).alias("length"), F.count("*").alias("blobs")).drop("run")


# -- integrity -------------------------------------------------------------------------------------------------------


def check_chunks(refs: DataFrame, store: DataFrame, full: bool = True) -> DataFrame:
    """refs (object, ordinal, mac) with status: ok, chunk missing or (if `full`) chunk corrupted. store: mac, data."""
    held = store.select("mac", (F.sha2("data", 256) == F.col("mac") if full else F.lit(True)).alias("fits"))
    return refs.join(held, "mac", "left").withColumn("status", F.when(F.col("fits").isNull(), "chunk missing").when(F.col("fits"), "ok").otherwise("chunk corrupted")).drop("fits")


def check_objects(objects: DataFrame, checked: DataFrame) -> DataFrame:
    """objects (object) with how their chunks fared: ok, object missing (no chunks known), object corrupted."""
    bad = checked.groupBy("object").agg(F.count_if(F.col("status") != "ok").alias("bad"), F.count("*").alias("n"))
    return objects.join(bad, "object", "left").withColumn("status", F.when(F.col("n").isNull(), "object missing").when(F.col("bad") == 0, "ok").otherwise("object corrupted")).drop("n")


def check_tree(entries: DataFrame, objects: DataFrame, top: str = "/", known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every entry at or below `top` with its status, and one row of counters.

    entries: path, kind, size, object (null for what has no content); objects: object, status, as check_objects gives;
    known: paths that an earlier check found good, which are skipped. Entries are all checked, whatever is found. Counters:
    files, directories, symlinks and size still to check once those skipped are taken off, never below 0; checked bytes; errors.
    """
    rows = entries.where(paths.is_within(F.col("path"), top)).join(objects.select("object", F.col("status").alias("_s")), "object", "left")
    rows = rows.join(known.select("path", F.lit(True).alias("_known")), "path", "left") if known is not None else rows.withColumn("_known", F.lit(None).cast("boolean"))
    status = F.when(F.col("_known"), "skipped").when(F.col("object").isNull() | (F.col("kind") != "regular"), "ok").otherwise(F.coalesce("_s", F.lit("object missing")))
    rows = rows.select("path", "kind", "size", status.alias("status"))
    skipped, size = F.col("status") == "skipped", F.coalesce("size", F.lit(0))
    left = lambda kind: F.greatest(F.lit(0), F.count_if(F.col("kind") == kind) - F.count_if(skipped & (F.col("kind") == kind)))
    counters = rows.agg(
        left("regular").alias("files"),
        left("directory").alias("directories"),
        left("symlink").alias("symlinks"),
        F.greatest(F.lit(0), F.coalesce(F.sum(size), F.lit(0)) - F.coalesce(F.sum(F.when(skipped, size)), F.lit(0))).alias("size"),
        F.coalesce(F.sum(F.when(F.col("status") == "ok", size)), F.lit(0)).alias("checked_bytes"),
        F.count_if(~F.col("status").isin("ok", "skipped")).alias("errors"),
    )
    return rows, counters
