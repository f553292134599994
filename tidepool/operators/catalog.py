"""The log of blobs, packfiles and colours: what is live, what is orphaned, which setting is newest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SNAPSHOT, PACKFILE, CHUNK = 5, 4, 9


def live_deltas(deltas: DataFrame, packfiles: DataFrame, coloured: DataFrame | None = None) -> DataFrame:
    """Deltas whose packfile is known and, if colours are given, not coloured."""
    out = deltas.join(packfiles.select("packfile").distinct(), "packfile", "left_semi")
    return out if coloured is None else out.join(coloured.where(F.col("type") == PACKFILE).select(F.col("mac").alias("packfile")).distinct(), "packfile", "left_anti")


def locate_blobs(blobs: DataFrame, deltas: DataFrame, packfiles: DataFrame, coloured: DataFrame) -> DataFrame:
    """A live location of each asked blob (type, mac), that in the smallest packfile; null columns where there is none."""
    place = live_deltas(deltas.join(blobs, ["type", "mac"], "left_semi"), packfiles, coloured).groupBy("type", "mac").agg(F.min(F.struct("packfile", "offset", "length")).alias("at"))
    return blobs.join(place, ["type", "mac"], "left").select("type", "mac", "at.packfile", "at.offset", "at.length")


def live_snapshots(deltas: DataFrame, packfiles: DataFrame, coloured: DataFrame) -> DataFrame:
    gone = coloured.where(F.col("type") == SNAPSHOT).select("mac").distinct()
    return live_deltas(deltas.where(F.col("type") == SNAPSHOT), packfiles).join(gone, "mac", "left_anti")


def orphans(deltas: DataFrame, packfiles: DataFrame) -> DataFrame:
    return deltas.join(packfiles.select("packfile"), "packfile", "left_anti")


def blobs_of_type(deltas: DataFrame, packfiles: DataFrame, kind: int) -> DataFrame:
    """Deltas of one type whose packfile is known, coloured or not."""
    return live_deltas(deltas.where(F.col("type") == kind), packfiles)


def object_locations(objects: DataFrame, deltas: DataFrame, packfiles: DataFrame, coloured: DataFrame) -> DataFrame:
    """objects (object, chunks: array of addresses) -> object, ordinal, mac, and a live location of each chunk, null if it has none."""
    chunks = objects.select("object", F.posexplode("chunks").alias("ordinal", "mac")).withColumn("type", F.lit(CHUNK))
    return chunks.join(locate_blobs(chunks.select("type", "mac").distinct(), deltas, packfiles, coloured), ["type", "mac"], "left").drop("type")


def logical_size(roots: DataFrame) -> DataFrame:
    """roots (snapshot, source, directory, below: sizes of a source's root) -> snapshots and the size of their first sources."""
    return roots.where("source = 0").agg(F.count("*").alias("snapshots"), F.coalesce(F.sum(F.col("directory") + F.col("below")), F.lit(0)).alias("size"))


def commit_totals(roots: DataFrame) -> DataFrame:
    """roots (snapshot, source, directory, below, errors) -> size and errors of each snapshot, over all its sources."""
    return roots.groupBy("snapshot").agg(F.sum(F.col("directory") + F.col("below")).alias("size"), F.sum("errors").alias("errors"))


def new_blobs(blobs: DataFrame, known: DataFrame) -> DataFrame:
    """Blobs not known yet, each once."""
    return blobs.dropDuplicates(["type", "mac"]).join(known.select("type", "mac"), ["type", "mac"], "left_anti")


def merged(base: DataFrame, more: DataFrame, key: list[str], deletes: DataFrame | None = None) -> DataFrame:
    """Rows of both logs, each key once; a row of base is kept before one of more. Merging again changes nothing."""
    both = base.unionByName(more.join(base.select(*key), key, "left_anti").dropDuplicates(key))
    return both if deletes is None else both.join(deletes, key, "left_anti")


def newest_settings(configurations: DataFrame) -> DataFrame:
    """The value with the newest created_at of each key; of equal times the largest value."""
    return configurations.groupBy("key").agg(F.max(F.struct("created_at", "value")).alias("x")).select("key", "x.value", "x.created_at")


def latest_state(states: DataFrame) -> DataFrame:
    """The state that was put in last."""
    return states.agg(F.max_by("state_id", F.struct("ts", "state_id")).alias("state_id"))


def latest_serial(states: DataFrame) -> DataFrame:
    return states.agg(F.max_by("serial", F.struct("ts", "state_id")).alias("serial"))


def state_diff(local: DataFrame, remote: DataFrame, key: str = "state_id") -> DataFrame:
    """side: `missing` is only remote, `outdated` only local."""
    side = lambda a, b, name: a.join(b.select(key), key, "left_anti").select(key, F.lit(name).alias("side"))
    return side(remote, local, "missing").unionByName(side(local, remote, "outdated"))


def generations(states: DataFrame) -> DataFrame:
    """state_id and level: 0 for a state without a known parent, one more than the parent's otherwise.

    Pointers double each round, so a chain of n states takes log2(n) joins.
    """
    spark = states.sparkSession
    known = states.select(F.col("state_id").alias("parent"))
    jump = states.join(known.withColumn("ok", F.lit(True)), "parent", "left").select("state_id", F.when(F.col("ok"), F.col("parent")).alias("up"), F.when(F.col("ok"), 1).otherwise(0).cast("long").alias("level"))
    while True:
        jump = jump.checkpoint() if spark.sparkContext.getCheckpointDir() else jump.persist()
        if jump.where("up IS NOT NULL").isEmpty():
            return jump.select("state_id", "level")
        far = jump.select(F.col("state_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        jump = jump.join(far, "up", "left").select("state_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))


def rebuilt(local: DataFrame, remote: DataFrame, states: DataFrame, key: list[str]) -> DataFrame:
    """The log after states were merged: rows (state_id, key ...) of local states that the remote has no more are dropped, those
    of missing ones are added, states by generation and id, a row of an earlier one before one of a later.

    states (state_id, parent): what the remote has.
    """
    kept = local.join(states.select("state_id"), "state_id", "left_semi")
    added = remote.join(local.select("state_id").distinct(), "state_id", "left_anti").join(states.select("state_id"), "state_id", "left_semi")
    order = generations(states.select("state_id", "parent"))
    both = kept.unionByName(added).join(order, "state_id")
    columns = [c for c in local.columns if c not in key]
    first = both.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct("level", "state_id")).alias("_x"))
    return first.select(*key, "_x.*").select(*local.columns)


def out_of_order(rows: DataFrame, order: list[str], place: str = "place") -> DataFrame:
    """Rows whose key isn't above the one before them: what a check of an index's order finds. place: the rows' numbers, from
    which a row's predecessor is known without a window over all of them."""
    before = rows.select((F.col(place) + 1).alias(place), F.struct(*order).alias("_before"))
    return rows.join(before, place).where(F.struct(*order) <= F.col("_before")).drop("_before")


def coloured_of(coloured: DataFrame, kind: int) -> DataFrame:
    """Addresses of a type that have a colour. A row with `removed` takes an earlier one's colour away."""
    rows = coloured.where(F.col("type") == kind)
    if "removed" in rows.columns:
        rows = last_of(rows, ["type", "mac"], "when_ts").where("NOT coalesce(removed, false)")
    return rows.select("mac").distinct()


def cascade_delete(deltas: DataFrame, packfiles: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return deltas.join(gone, "packfile", "left_anti"), packfiles.join(gone, "packfile", "left_anti")


def used_packfiles(packfiles: DataFrame, deltas: DataFrame, reachable: DataFrame) -> DataFrame:
    """packfiles with how many reachable blobs they hold."""
    held = deltas.join(reachable, ["type", "mac"], "left_semi").groupBy("packfile").agg(F.count("*").alias("blobs"), F.sum("length").alias("bytes"))
    return packfiles.join(held, "packfile", "left").fillna(0, ["blobs", "bytes"])


def stale_locks(locks: DataFrame, now, minutes: int = 10) -> DataFrame:
    return locks.withColumn("stale", F.col("ts") <= F.lit(now) - F.expr(f"INTERVAL {minutes} MINUTES"))


def held_locks(locks: DataFrame, now, minutes: int = 10) -> DataFrame:
    """locks (id, ts, hostname, exclusive, released) is a log: the last row of each id, unless it was given up or is stale."""
    return stale_locks(last_of(locks, ["id"], "ts"), now, minutes).where("NOT released AND NOT stale").drop("stale")


def conflicts(locks: DataFrame, own: str, exclusive: bool, now, minutes: int = 10) -> DataFrame:
    """Locks of others that forbid ours: exclusive ones, and all if ours is exclusive."""
    others = held_locks(locks, now, minutes).where(F.col("id") != own)
    return others if exclusive else others.where("exclusive")


def last_of(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key; of rows at one time, that with the largest values."""
    ties = [F.col(c).desc() for c in sorted(log.columns) if c != order]
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc(), *ties))).where("_n = 1").drop("_n")
