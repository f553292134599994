"""Streams of events: counts by window, throughput by second, and fan-out of a micro-batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """event_type by window; for streams, windows close once the watermark has passed."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def publish(events: DataFrame, listeners: list[Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Every listener gets every micro-batch; without listeners it is dropped."""

    def each(batch: DataFrame, n: int) -> None:
        if listeners:
            batch.persist()
            for listener in listeners:
                listener(batch, n)
            batch.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- typed events ----------------------------------------------------------------------------------------------------

#: What is reported, and how it went; fixed values. Levels: errors are errors, results are quiet, the rest is information.
SUBJECTS = ("path", "directory", "file", "xattr", "symlink", "object", "chunk")
OUTCOMES = ("", ".ok", ".cached", ".error")
TYPES = tuple(s + o for s in SUBJECTS for o in OUTCOMES)
MORE_TYPES = ("workflow.start", "workflow.end", "result", "fs.summary", "iostats")


def emitted(rows: DataFrame, kind: str, **data: Column) -> DataFrame:
    """rows (ts, repository, snapshot, job, workflow) as events of one type with their data: version, ts, level, type ..., data."""
    if kind not in (*TYPES, *MORE_TYPES):
        raise ValueError(f"no such event: {kind}")
    level = "error" if kind.endswith(".error") else "quiet" if kind == "result" else "info"
    pairs = [x for k, c in data.items() for x in (F.lit(k), c.cast("string"))]
    made = F.map_from_arrays(F.array(*pairs[::2]), F.array(*pairs[1::2])) if pairs else F.create_map().cast("map<string, string>")
    return rows.select(F.lit(1).alias("version"), "ts", F.lit(level).alias("level"), F.lit(kind).alias("type"), "repository", "snapshot", "job", "workflow", made.alias("data"))


def outcomes(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Typed events by window and subject: how many began, were done, were found in the cache, or failed."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    subject = F.substring_index("type", ".", 1)
    rows = rows.where(F.col("type").isin(*TYPES))
    counted = rows.groupBy(F.window("ts", window).alias("w"), subject.alias("subject")).agg(*(F.count_if(F.col("type") == F.concat(subject, F.lit(o))).alias(o.lstrip(".") or "begun") for o in OUTCOMES))
    return counted.select(F.col("w.start").alias("start"), "subject", "begun", "ok", "cached", "error")


def result_of(typed: DataFrame) -> DataFrame:
    """The `result` event of each job: size of its files, errors, and microseconds from its first event to its last."""
    at = F.col("ts").cast("timestamp")
    size = F.coalesce(F.sum(F.when(F.col("type") == "file.ok", F.col("data")["size"].cast("long"))), F.lit(0))
    jobs = typed.groupBy("repository", "snapshot", "job", "workflow").agg(F.max("ts").alias("ts"), size.alias("size"), F.count_if(F.col("type").endswith(".error")).alias("errors"), (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))).alias("us"))
    made = F.map_from_arrays(F.array(*map(F.lit, ("target", "size", "errors", "duration"))), F.array(*(F.col(c).cast("string") for c in ("repository", "size", "errors", "us"))))
    return jobs.select(F.lit(1).alias("version"), "ts", F.lit("quiet").alias("level"), F.lit("result").alias("type"), "repository", "snapshot", "job", "workflow", made.alias("data"))


def sampled(spans: DataFrame, window: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """spans (scope, at, bytes) -> bytes and bytes a second of each scope and window."""
    rows = spans.withColumn("at", F.col("at").cast("timestamp"))
    rows = rows.withWatermark("at", late) if rows.isStreaming else rows
    seconds = F.unix_micros(F.col("w.end")) / 1e6 - F.unix_micros(F.col("w.start")) / 1e6
    return rows.where("bytes <> 0").groupBy("scope", F.window("at", window).alias("w")).agg(F.sum("bytes").alias("bytes")).select("scope", F.col("w.start").alias("start"), "bytes", (F.col("bytes") / seconds).alias("rate"))


def tracked(spans: DataFrame) -> DataFrame:
    """A stream of spans (scope, at_us, bytes, dt_ns) -> bytes, active_ns and wall_us of each scope so far, with each micro-batch.

    Spans without bytes don't count; one without a duration adds its bytes only. The state of a scope is four numbers.
    """

    def step(key, frames, state: GroupState):
        size, active, first, last = state.get if state.exists else (0, 0, None, None)
        for frame in frames:
            frame = frame[frame["bytes"] != 0]
            if len(frame):
                size, active = size + int(frame["bytes"].sum()), active + int(frame["dt_ns"].clip(lower=0).sum())
                low, high = int(frame["at_us"].min()), int(frame["at_us"].max())
                first, last = (low, high) if first is None else (min(first, low), max(last, high))
        state.update((size, active, first, last))
        yield pd.DataFrame([(key[0], size, active, 0 if first is None else last - first)], columns=["scope", "bytes", "active_ns", "wall_us"])

    rows = spans.select(F.col("scope").cast("string"), F.col("at_us").cast("long"), F.coalesce(F.col("bytes").cast("long"), F.lit(0)).alias("bytes"), F.coalesce(F.col("dt_ns").cast("long"), F.lit(0)).alias("dt_ns"))
    return rows.groupBy("scope").applyInPandasWithState(step, "scope string, bytes long, active_ns long, wall_us long", "size long, active long, first long, last long", "update", GroupStateTimeout.NoTimeout)
