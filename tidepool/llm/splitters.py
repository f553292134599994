"""Shards of near equal bytes, cut by sampled splitters.

Rows are ordered by (digest of the text, id, place), so equal texts lie together and no two keys are equal. A size-weighted
sample of these keys gives quantile boundaries; they deal the rows into ranges, and ranges that turn out overfull are
sampled anew and subdivided until none is. Exact sums over ranges, and inside of them, give each row its place in the order.
A shard begins at a sixteenth of all bytes; where that falls into a group of equal texts, at the group's nearer end if that
is within TOLERANCE of a shard, else in the group, at the nearest row. So only groups too large to be moved are cut.

Null texts count as one byte and sort first, under an empty digest; a null id sorts first among equal texts. Rows that are
equal in text and id are interchangeable, and may be any part of all rows. Texts are only measured and hashed, so they may
be of any length. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm import common

#: Ranges at least and at most; rows that one more range is added for; sampled keys for each range; how full a range may be.
LEAST_RANGES, MOST_RANGES, ROWS_A_RANGE, SAMPLES, OVERFULL = 128, 4096, 500_000, 16, 3.0
#: How far a shard's border may be moved to the end of a group of equal texts, as a part of a shard.
TOLERANCE = 0.01
NULL_ID = -(1 << 63)
KEY = ("digest", "id", "place")


def draw(rows: DataFrame, expected: int, total: int, salt: int) -> list[tuple]:
    """Keys kept with a chance in proportion to their size, and the weight that each stands for; about `expected` of them."""
    rate = F.lit(float(expected)) * F.col("size") / F.lit(float(max(total, 1)))
    chance = (F.xxhash64(*KEY, F.lit(salt)).bitwiseAND((1 << 52) - 1)) / F.lit(float(1 << 52))
    return [((bytes(r.digest), r.id, r.place), r.w) for r in rows.where(chance < rate).select(*KEY, F.greatest(rate, F.lit(1.0)).alias("w")).collect()]


def quantiles(sample: Iterable[tuple], pieces: int) -> list[tuple]:
    """Up to pieces - 1 different keys that cut the sampled weight into equal parts."""
    sample = sorted(sample)
    total, run, out = sum(w for _, w in sample), 0.0, []
    for key, w in sample:
        if (run + w) * pieces / total >= len(out) + 1 and len(out) < pieces - 1:
            out.append(key)
        run += w
    return out


def in_ranges(rows: DataFrame, cuts: list[tuple]) -> DataFrame:
    """rows with range: how many cuts are at or below the key."""
    names = rows.columns

    def run(batches):
        for b in batches:
            at = [bisect_right(cuts, k) for k in zip(*(b.column(c).to_pylist() for c in KEY), strict=True)]
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in names} | {"range": pa.array(at, pa.int32())})

    return common.map_arrow(rows, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", range int")


def split(rows: DataFrame, n: int, total: int) -> tuple[list[tuple], list]:
    """The cuts, and a row for each range: its bytes and its rows. No range is overfull, a single row aside."""
    pieces = min(MOST_RANGES, max(LEAST_RANGES, -(-n // ROWS_A_RANGE)))
    cuts, attempt = quantiles(draw(rows, SAMPLES * pieces, total, 0), pieces), 0
    while True:
        attempt += 1
        ranged = in_ranges(rows, cuts)
        loads = {r.range: r for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        full = {k: max(r.bytes * pieces / max(total, 1), r.n * pieces / n) for k, r in loads.items() if r.n > 1}
        full = {k: x for k, x in full.items() if x > OVERFULL}
        if not full:
            return cuts, [loads[k] for k in sorted(loads)]
        # a range is overfull by bytes or by rows, so both weigh
        inside = ranged.where(F.col("range").isin(list(full))).withColumn("size", F.lit(n).cast("double") * F.col("size") / F.lit(float(max(total, 1))) + 1.0)
        weight = inside.agg(F.sum("size")).first()[0]
        more = [(key, w, bisect_right(cuts, key)) for key, w in draw(inside, int(SAMPLES * sum(full.values())), weight, attempt)]
        new = {c for k, x in full.items() for c in quantiles([m[:2] for m in more if m[2] == k], int(2 * x) + 1)}
        cuts = sorted({*cuts, *new, *((d, i, p + 1) for d, i, p in new)})  # a large row gets a range of its own


def borders(placed: DataFrame, total: int, shards: int) -> list[int]:
    """Where shards 1, 2 ... begin, in 2 * shards * bytes. Fifteen rows or fewer are collected at a time."""
    start, stop = F.col("start"), F.col("start") + F.col("size")
    target = F.explode(F.array(*(F.lit(total * s).cast("long") for s in range(1, shards)))).alias("target")
    hit = placed.select("digest", "start", "size", target).where((start * shards < F.col("target")) & (F.col("target") <= stop * shards)).select("digest", "target").collect()
    at = {r.target: bytes(r.digest) for r in hit}
    groups = placed.where(F.col("digest").isin([F.lit(x) for x in set(at.values())])) if at else placed.limit(0)
    ends = {bytes(r.digest): (shards * r.low, shards * r.high) for r in groups.groupBy("digest").agg(F.min("start").alias("low"), F.max(stop).alias("high")).collect()}
    out = []
    for s in range(1, shards):
        t = total * s
        near = min(ends[at[t]], key=lambda e: abs(e - t)) if t in at else t
        out.append(2 * (near if abs(near - t) <= TOLERANCE * total else t))
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, size, text_crc32, shard and slot. Slots number a shard's rows from 0 without gaps."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), common.crc32_of_text(text).alias("text_crc32"), F.coalesce(F.unhex(F.md5(F.encode(text, "UTF-8"))), F.lit(b"")).alias("digest"), F.monotonically_increasing_id().alias("place"))
    rows = common.stash(rows, "shard-keys")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return rows.select(id_col, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    cuts, loads = split(rows, n, total)
    before, rank, offsets = 0, 0, []
    for r in loads:  # MOST_RANGES and those that subdividing adds
        offsets.append((r.range, before, rank))
        before, rank = before + r.bytes, rank + r.n
    offsets = spark.createDataFrame(offsets, "range int, before long, first long")
    w = Window.partitionBy("range").orderBy(*KEY)
    placed = in_ranges(rows, cuts).withColumns({"rn": F.row_number().over(w), "upto": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    placed = placed.join(F.broadcast(offsets), "range").select(id_col, "size", "text_crc32", "digest", (F.col("first") + F.col("rn") - 1).alias("rank"), (F.col("before") + F.col("upto") - F.col("size")).alias("start"))
    placed = common.stash(placed, "shard-places")
    middle = F.lit(shards).cast("long") * (2 * F.col("start") + F.col("size"))
    shard = sum(((middle >= F.lit(b).cast("long")).cast("int") for b in borders(placed, total, shards)), F.lit(0))
    placed = placed.withColumn("shard", shard)
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(id_col, "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def op4_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP4_SQL = f"""
WITH d AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size, text, coalesce(md5(text), '') AS digest FROM documents),
     p AS (SELECT *, sum(size) OVER (ORDER BY digest, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS start, row_number() OVER (ORDER BY digest, doc_id NULLS FIRST) AS rank, sum(size) OVER () AS total FROM d),
     g AS (SELECT digest, 16 * min(start) AS low, 16 * max(start + size) AS high FROM p GROUP BY digest),
     t AS (SELECT s * total AS target, total FROM range(1, 16) r(s), (SELECT sum(size) AS total FROM d)),
     e AS (SELECT target, total, CASE WHEN abs(low - target) <= abs(high - target) THEN low ELSE high END AS near FROM t JOIN p USING (total) JOIN g USING (digest) WHERE 16 * start < target AND target <= 16 * (start + size)),
     b AS (SELECT list(2 * CASE WHEN abs(near - target) <= {TOLERANCE} * total THEN near ELSE target END) AS borders FROM e),
     s AS (SELECT p.*, CAST(len(list_filter(borders, lambda x: 16 * (2 * start + size) >= x)) AS INTEGER) AS shard FROM p, b),
     -- the checksum, byte by byte
     f AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT) ORDER BY n) AS fold FROM range(256) r(n)),
     k AS (SELECT text, CAST(xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, x: xor(c >> 8, fold[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS BIGINT) AS text_crc32 FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), f)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(rank - min(rank) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s LEFT JOIN k USING (text)
"""
