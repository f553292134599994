"""Pack files: blobs end to end, an index of fixed-width records, its address, a footer and the footer's length.

A pack is closed once it is over its limit, so one row holds a pack. Blobs are cut out of it in one go: what is asked of a
pack is gathered first, so its bytes are joined once and not once for each blob.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import codecs
from tidepool.operators import catalog, content

FOOTER = codecs.width(codecs.PACK_FOOTER)
RECORD = codecs.width(codecs.PACK_BLOB)
#: Footer and the four bytes of its length.
TAIL = FOOTER + 4


def joined(parts: Column) -> Column:
    """The bytes of an array of binaries, end to end."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def built(blobs: DataFrame, ts_ns: int) -> DataFrame:
    """blobs (packfile, seq, type, version, mac, flags, data) -> packfile, content."""
    rows = content.pack_offsets(blobs.withColumn("length", F.octet_length("data").cast("long")))
    rows = rows.select("packfile", F.struct("offset", "seq", codecs.record(codecs.PACK_BLOB).alias("record"), "data").alias("b"))
    packs = rows.groupBy("packfile").agg(F.array_sort(F.collect_list("b")).alias("b"))
    packs = packs.select("packfile", F.size("b").alias("count"), joined(F.col("b.data")).alias("data"), joined(F.col("b.record")).alias("index"))
    packs = packs.withColumns({"ts_ns": F.lit(ts_ns), "index_offset": F.octet_length("data").cast("long"), "index_mac": F.sha2("index", 256), "flags": F.lit(0)})
    return packs.select("packfile", F.concat("data", "index", codecs.record(codecs.PACK_FOOTER), F.unhex(F.lit(f"{FOOTER:02X}000000"))).alias("content"))


def opened(packs: DataFrame) -> DataFrame:
    """packs (packfile, content) with footer, index and status: ok, `no footer` or `index corrupted`."""
    size = F.octet_length("content")
    rows = packs.withColumn("footer", F.struct(*codecs.fields(F.expr(f"substring(content, octet_length(content) - {TAIL - 1}, {FOOTER})"), codecs.PACK_FOOTER)))
    start = F.col("footer.index_offset")
    whole = (size >= TAIL) & (start >= 0) & (start + F.col("footer.count") * RECORD + TAIL == size)
    rows = rows.withColumn("index", F.when(whole, F.expr(f"substring(content, cast(footer.index_offset + 1 as int), octet_length(content) - {TAIL} - cast(footer.index_offset as int))")))
    return rows.withColumn("status", F.when(F.col("index").isNull(), "no footer").when(F.sha2("index", 256) == F.col("footer.index_mac"), "ok").otherwise("index corrupted"))


def index_of(packs: DataFrame) -> DataFrame:
    """packfile, type, version, mac, offset, length, flags of every blob of the packs whose index is whole."""
    good = opened(packs).where("status = 'ok' AND footer.count > 0").select("packfile", "index", F.explode(F.expr("sequence(0L, footer.count - 1)")).alias("i"))
    return good.select("packfile", F.expr(f"substring(index, cast(i * {RECORD} + 1 as int), {RECORD})").alias("r")).select("packfile", *codecs.fields(F.col("r"), codecs.PACK_BLOB))


def get_blobs(asked: DataFrame, deltas: DataFrame, packfiles: DataFrame, coloured: DataFrame, packs: DataFrame) -> DataFrame:
    """asked (type, mac) -> type, mac, data, error, a row for each different blob; one that fails doesn't stop the others."""
    at = catalog.locate_blobs(asked.select("type", "mac").distinct(), deltas, packfiles, coloured)
    lost = at.where("packfile IS NULL").select("type", "mac", F.lit(None).cast("binary").alias("data"), F.lit("blob not found").alias("error"))
    wanted = at.where("packfile IS NOT NULL").groupBy("packfile").agg(F.collect_list(F.struct("type", "mac", "offset", "length")).alias("w"))
    held = opened(packs).select("packfile", "content", "status", F.col("footer.index_offset").alias("stop"))
    cut = F.expr("""transform(w, x -> named_struct('type', x.type, 'mac', x.mac,
        'data', CASE WHEN status = 'ok' AND x.offset >= 0 AND x.offset + x.length <= stop THEN substring(content, cast(x.offset + 1 as int), cast(x.length as int)) END,
        'error', CASE WHEN status IS NULL THEN 'packfile missing' WHEN status <> 'ok' THEN status WHEN x.offset < 0 OR x.offset + x.length > stop THEN 'out of bounds' END))""")
    return wanted.join(held, "packfile", "left").select(F.explode(cut).alias("x")).select("x.*").unionByName(lost)


def object_ranges(chunks: DataFrame, most: int = content.MAX_RANGE) -> DataFrame:
    """chunks (object, ordinal, packfile, offset, length) -> the reads of each object in order: a read takes the next chunk while
    that follows in the same pack and the read is below `most`."""

    def run(frames):
        held = None
        for frame in frames:
            out = []
            for o, p, at, n in zip(frame["object"], frame["packfile"], frame["offset"], frame["length"], strict=True):
                if held and held[0] == o and held[2] == p and held[3] + held[4] == at and held[4] < most:
                    held[4], held[5] = held[4] + n, held[5] + 1
                else:
                    if held:
                        out.append(held)
                    held = [o, held[1] + 1 if held and held[0] == o else 0, p, at, n, 1]
            yield pd.DataFrame(out, columns=["object", "step", "packfile", "offset", "length", "chunks"])
        if held:
            yield pd.DataFrame([held], columns=["object", "step", "packfile", "offset", "length", "chunks"])

    rows = chunks.select("object", "ordinal", "packfile", F.col("offset").cast("long"), F.col("length").cast("long")).repartition("object").sortWithinPartitions("object", "ordinal")
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("object", "packfile")}
    return rows.mapInPandas(run, f"object {kind['object']}, step long, packfile {kind['packfile']}, offset long, length long, chunks long")
