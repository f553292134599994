"""Throughput of I/O samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_NS = 50_000_000
POINTS = (50, 75, 80, 90, 95, 99)


def samples(spans: DataFrame, window_ns: int = WINDOW_NS) -> DataFrame:
    """spans (scope, seq, bytes, dt_ns) -> scope, n, throughput (bytes a second): one whenever active time reaches the window,
    and one of what is left when a scope ends. A scope's spans are folded in order, in one task."""

    def run(frames):
        scope, n, size, time = None, 0, 0, 0
        for frame in frames:
            out = []
            for s, b, dt in zip(frame["scope"], frame["bytes"], frame["dt_ns"], strict=True):
                if s != scope:
                    if time > 0:
                        out.append((scope, n, size / (time / 1e9)))
                    scope, n, size, time = s, 0, 0, 0
                if not b or dt <= 0:
                    continue
                size, time = size + b, time + dt
                if time >= window_ns:
                    out.append((s, n, size / (time / 1e9)))
                    n, size, time = n + 1, 0, 0
            yield pd.DataFrame(out, columns=["scope", "n", "throughput"])
        if time > 0:
            yield pd.DataFrame([(scope, n, size / (time / 1e9))], columns=["scope", "n", "throughput"])

    rows = spans.select("scope", "seq", F.col("bytes").cast("long"), F.col("dt_ns").cast("long")).repartition("scope").sortWithinPartitions("scope", "seq")
    return rows.mapInPandas(run, f"scope {rows.schema['scope'].dataType.simpleString()}, n long, throughput double")


def throughput_stats(taken: DataFrame) -> DataFrame:
    """min, mean, median, max and percentiles of each scope's samples; percentiles are interpolated."""
    p = F.percentile("throughput", F.array(*(F.lit(x / 100) for x in POINTS)))
    out = taken.groupBy("scope").agg(F.count("*").alias("n"), F.min("throughput").alias("least"), F.avg("throughput").alias("mean"), F.max("throughput").alias("most"), p.alias("p"))
    return out.select("scope", "n", "least", "mean", "most", *(F.col("p")[i].alias(f"p{x}") for i, x in enumerate(POINTS)))


def totals(spans: DataFrame) -> DataFrame:
    """bytes, active and wall time of each scope; spans without bytes don't count."""
    rows = spans.where("bytes <> 0")
    wall = F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))
    return rows.groupBy("scope").agg(F.sum("bytes").alias("bytes"), F.coalesce(F.sum(F.when(F.col("dt_ns") > 0, F.col("dt_ns"))), F.lit(0)).alias("active_ns"), wall.alias("wall_us"))


def token_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """requests (scope, seq, at_s, n) with the seconds that each waits for a bucket that refills at `rate` up to `burst`; a rate of 0 or less never waits."""

    def run(frames):
        scope, tokens, last = None, burst, None
        for frame in frames:
            waits = []
            for s, at, n in zip(frame["scope"], frame["at_s"], frame["n"], strict=True):
                if s != scope:
                    scope, tokens, last = s, burst, at
                if rate <= 0:
                    waits.append(0.0)
                    continue
                tokens, last = min(burst, tokens + (at - last) * rate) - n, at
                waits.append(max(0.0, -tokens / rate))
            yield frame.assign(wait_s=waits)

    rows = requests.select("scope", "seq", F.col("at_s").cast("double"), F.col("n").cast("double")).repartition("scope").sortWithinPartitions("scope", "seq")
    return rows.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", wait_s double")


def drained(used: DataFrame, every: str = "1 second") -> DataFrame:
    """used (scope, at, bytes) -> what a throttle gives back each time it is read and set back: scope, start, bytes."""
    return used.groupBy("scope", F.window("at", every).alias("w")).agg(F.sum("bytes").alias("bytes")).select("scope", F.col("w.start").alias("start"), "bytes")
