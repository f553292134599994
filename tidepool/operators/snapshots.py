"""A store of snapshots as Parquet tables, and what happens to a snapshot: ingest, fork, delete, synchronise, classify."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import codecs, paths
from tidepool.operators import catalog, content, packs, tree
from tidepool.sources import connectors

#: Tables of a store and their columns.
SCHEMAS = {
    "snapshots": "item_id string, ts timestamp", "entries": None, "objects": "object string, ordinal int, mac string, length long", "errors": "snapshot_id string, path string, parent string, error string", "xattrs": "snapshot_id string, path string, name string, object string",
    "packs": "packfile string, content binary", "deltas": "type int, mac string, packfile string, offset long, length long", "packfiles": "packfile string, ts timestamp", "coloured": "type int, mac string, when_ts timestamp, removed boolean",
    "tombstones": "kind string, name string", "states": "state_id string, parent string, ts timestamp, serial string", "configurations": "key string, value binary, created_at timestamp", "locks": "id string, ts timestamp, hostname string, exclusive boolean, released boolean",
}
TABLES = tuple(SCHEMAS)
#: File information that entries keep.
INFO = tuple(c for c in tree.FILEINFO if c != "size")
#: Bits of a store's mode, and kinds of what stores hold; fixed values.
WRITE, READ = 1 << 1, 1 << 2
RESOURCES = {0: "undefined", 1: "packfile", 2: "state", 3: "lock", 4: "ECC packfile", 5: "ECC state"}
CONFIG, VERSION = 1, 1 << 16


@dataclass
class Settings:
    """What a store is made with; sealed in its `config` table."""

    repository_id: str = ""
    pack_size: int = content.PACK_SIZE
    chunk_least: int = content.CHUNK_MIN
    chunk_normal: int = content.CHUNK_NORMAL
    chunk_most: int = content.CHUNK_MAX
    hashing: str = "SHA256"
    compression: str = "LZ4"
    #: Key derivation, and its salt and canary in hex; empty for a store in the clear.
    derivation: str = ""
    salt: str = ""
    canary: str = ""

    def to_bytes(self, version: int = VERSION) -> bytes:
        return connectors.seal(CONFIG, version, json.dumps(asdict(self), sort_keys=True).encode())

    @classmethod
    def from_bytes(cls, raw: bytes, newest: int = VERSION) -> Settings:
        version, data = connectors.unseal(CONFIG, raw)
        if version > newest:
            raise ValueError(f"store of a later version: {version}")
        return cls(**json.loads(data))


class Store:
    """Tables below one folder. All writes append parts that belong to a transaction; a part is seen once its transaction is
    in `commits`, which is one small write. A deletion is a row in `coloured` or `tombstones`."""

    def __init__(self, spark: SparkSession, folder: str, mode: int = READ | WRITE):
        self.spark, self.folder, self.mode = spark, folder.rstrip("/"), mode
        self.settings, self.key = Settings(), None

    @contextmanager
    def transaction(self) -> Iterator[str]:
        """The name of a transaction; what is appended under it is seen when the block ends, and never if it fails."""
        tx = f"t{uuid.uuid4().hex}"
        yield tx
        self.spark.createDataFrame([(tx,)], "tx string").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def exists(self, name: str) -> bool:
        fs, path = self._path(name)
        return fs.exists(path)

    def sweep(self) -> int:
        """Deletes parts of transactions that never ended, of which none may be running; how many."""
        done = {r.tx for r in self.spark.read.parquet(f"{self.folder}/commits").collect()} if self.exists("commits") else set()
        n = 0
        for name in self.tables():
            fs, path = self._path(name)
            for part in fs.listStatus(path):
                tx = part.getPath().getName().removeprefix("tx=")
                if part.isDirectory() and tx not in done:
                    fs.delete(part.getPath(), True)
                    n += 1
        return n

    @classmethod
    def create(cls, spark: SparkSession, folder: str, settings: Settings, passphrase: str | None = None) -> Store:
        """A new store; an error if there is one. With a passphrase, its settings get a salt and a canary."""
        store = cls(spark, folder)
        if passphrase is not None:
            salt = os.urandom(16)
            settings.derivation = settings.derivation or "SCRYPT"
            store.key = codecs.derive_key(passphrase, salt, settings.derivation)
            settings.salt, settings.canary = salt.hex(), codecs.canary(spark, store.key).hex()
        store.settings = settings
        spark.createDataFrame([(settings.to_bytes(),)], "data binary").coalesce(1).write.parquet(f"{store.folder}/config")
        return store

    @classmethod
    def open(cls, spark: SparkSession, folder: str, passphrase: str | None = None, mode: int = READ | WRITE) -> Store:
        """Checks the seal, the version and the key."""
        store = cls(spark, folder, mode)
        store.settings = s = Settings.from_bytes(bytes(spark.read.parquet(f"{store.folder}/config").first().data))
        if s.canary:
            if passphrase is None:
                raise ValueError("the store asks for a passphrase")
            store.key = codecs.derive_key(passphrase, bytes.fromhex(s.salt), s.derivation)
            if not codecs.opens(spark, bytes.fromhex(s.canary), store.key):
                raise ValueError("wrong passphrase")
        return store

    def tables(self) -> list[str]:
        """Tables that have been written."""
        return [t for t in TABLES if self._path(t)[0].exists(self._path(t)[1])]

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def size(self, name: str = "") -> int:
        """Bytes of a table's files, or of all."""
        fs, path = self._path(name)
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def known(self, name: str) -> DataFrame:
        """A table, or an empty one if it hasn't been written."""
        return self.table(name) if self.exists(name) else self.spark.createDataFrame([], SCHEMAS[name])

    def blobs(self, asked: DataFrame) -> DataFrame:
        """asked (type, mac) -> type, mac, data, error of each different one, cut out of the pack files that are live."""
        return packs.get_blobs(asked, self.deltas(), self.packfiles(), self.known("coloured"), self.known("packs"))

    def ranged(self, asked: DataFrame) -> DataFrame:
        """asked (mac, offset, length) with that part of the chunk; null for unknown chunks."""
        held = self.blobs(asked.select(F.lit(catalog.CHUNK).alias("type"), "mac"))
        return asked.join(held, "mac", "left").select("mac", "offset", "length", F.expr("substring(data, cast(offset + 1 as int), cast(length as int))").alias("data"))

    def lock(self, lock_id: str, hostname: str, now: datetime, exclusive: bool = False) -> None:
        """Writes the lock, then looks for others; where one forbids it, gives it up and says so. Calling again refreshes it."""
        row = lambda at, gone: self.append("locks", self.spark.createDataFrame([(lock_id, at, hostname, exclusive, gone)], "id string, ts timestamp, hostname string, exclusive boolean, released boolean"))
        row(now, False)
        if not catalog.conflicts(self.table("locks"), lock_id, exclusive, now).isEmpty():
            row(now + timedelta(microseconds=1), True)
            raise RuntimeError("the store is locked")

    def unlock(self, lock_id: str, now: datetime) -> None:
        last = catalog.last_of(self.table("locks").where(F.col("id") == lock_id), ["id"], "ts")
        self.append("locks", last.select("id", F.lit(now).alias("ts"), "hostname", "exclusive", F.lit(True).alias("released")))

    def files(self, snapshot_id: str) -> DataFrame:
        """path, content of a snapshot's entries; null where a chunk of it is missing."""
        entries = self.table("entries").where(F.col("snapshot_id") == snapshot_id)
        parts = self.known("objects").join(entries.select("object").distinct(), "object", "left_semi")
        held = self.blobs(parts.select(F.lit(catalog.CHUNK).alias("type"), "mac"))
        parts = parts.join(held, "mac").groupBy("object").agg(F.array_sort(F.collect_list(F.struct("ordinal", "data"))).alias("c"))
        whole = parts.select("object", F.when(F.expr("forall(c, x -> x.data IS NOT NULL)"), packs.joined(F.col("c.data"))).alias("content"))
        return entries.join(whole, "object", "left").select("path", F.when(F.col("size") == 0, F.lit(b"")).otherwise(F.col("content")).alias("content"))

    def synchronize(self, other: Store, snapshot_id: str, packfile: str) -> None:
        """Copies a snapshot, its attributes and its errors into another store, which stores only what it lacks; an error if
        contents are lost."""
        head = self.table("snapshots").where(F.col("item_id") == snapshot_id).first()
        if head is None:
            raise ValueError(f"no such snapshot: {snapshot_id}")
        rows = self.files(snapshot_id)
        if lost := rows.where("content IS NULL").count():
            raise ValueError(f"{lost} entries without content")
        of = lambda name: self.known(name).where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")
        info = [c for c in INFO if c in self.table("entries").columns]
        rows = rows.join(of("entries").select("path", *info), "path") if info else rows
        attributes = None
        if not (named := of("xattrs")).isEmpty():
            parts = self.known("objects").join(named.select("object").distinct(), "object", "left_semi")
            held = self.blobs(parts.select(F.lit(catalog.CHUNK).alias("type"), "mac"))
            whole = parts.join(held, "mac").groupBy("object").agg(F.array_sort(F.collect_list(F.struct("ordinal", "data"))).alias("c")).select("object", packs.joined(F.col("c.data")).alias("content"))
            attributes = named.join(whole, "object", "left").select("path", "name", F.coalesce("content", F.lit(b"")).alias("content"))
        other.ingest(snapshot_id, rows, head.ts, packfile, errors=of("errors").select("path", "error"), xattrs=attributes)
        got = other.table("entries").where(F.col("snapshot_id") == snapshot_id).count()
        if (want := rows.count()) != got:
            raise ValueError(f"synchronisation failed: {want} entries, {got} arrived")

    def table(self, name: str) -> DataFrame:
        """The rows of transactions that have ended."""
        if name not in TABLES:
            raise ValueError(f"no such table: {name}")
        if not self.mode & READ:
            raise PermissionError("the store isn't open for reading")
        done = self.spark.read.parquet(f"{self.folder}/commits")
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{name}").join(done, "tx", "left_semi").drop("tx")

    def append(self, name: str, rows: DataFrame, tx: str | None = None) -> None:
        """Adds rows to a table, as a part of a transaction or as one of its own."""
        if name not in TABLES:
            raise ValueError(f"no such table: {name}")
        if not self.mode & WRITE:
            raise PermissionError("the store isn't open for writing")
        if tx is None:
            with self.transaction() as tx:
                return self.append(name, rows, tx)
        rows.write.mode("append").parquet(f"{self.folder}/{name}/tx={tx}")

    # what is left of the log once deletions are taken off

    def deltas(self) -> DataFrame:
        gone = self.known("tombstones")
        blobs, whole = (gone.where(F.col("kind") == k) for k in ("delta", "packfile"))
        return self.known("deltas").join(blobs.select(F.col("name").alias("mac")), "mac", "left_anti").join(whole.select(F.col("name").alias("packfile")), "packfile", "left_anti")

    def packfiles(self) -> DataFrame:
        return self.known("packfiles").join(self.known("tombstones").where("kind = 'packfile'").select(F.col("name").alias("packfile")), "packfile", "left_anti")

    def states(self) -> DataFrame:
        return self.known("states").join(self.known("tombstones").where("kind = 'state'").select(F.col("name").alias("state_id")), "state_id", "left_anti")

    def bury(self, kind: str, names: DataFrame) -> None:
        """names (name) of deltas, packfiles or states that are gone; a packfile takes its deltas along."""
        if kind not in ("delta", "packfile", "state"):
            raise ValueError(f"{kind} can't be deleted")
        self.append("tombstones", names.select(F.lit(kind).alias("kind"), F.col("name").cast("string").alias("name")))

    def put_state(self, state_id: str, ts: datetime) -> None:
        """A state after the latest one, with that one's serial; the first gets one of its own."""
        last = self.states().orderBy(F.col("ts").desc(), F.col("state_id").desc()).first()
        self.append("states", self.spark.createDataFrame([(state_id, last.state_id if last else None, ts, last.serial if last else uuid.uuid4().hex)], SCHEMAS["states"]))

    def colour(self, kind: int, mac: str, when: datetime, removed: bool = False) -> None:
        self.append("coloured", self.spark.createDataFrame([(kind, mac, when, removed)], SCHEMAS["coloured"]))

    def coloured(self, kind: int) -> DataFrame:
        return catalog.coloured_of(self.known("coloured"), kind)

    def is_coloured(self, kind: int, mac: str) -> bool:
        return not self.coloured(kind).where(F.col("mac") == mac).isEmpty()

    def snapshots(self) -> DataFrame:
        """Headers of the snapshots that are live."""
        live = catalog.live_snapshots(self.deltas(), self.packfiles(), self.coloured(catalog.SNAPSHOT).withColumn("type", F.lit(catalog.SNAPSHOT)))
        return self.known("snapshots").join(live.select(F.col("mac").alias("item_id")).distinct(), "item_id", "left_semi")

    def ingest(self, snapshot_id: str, files: DataFrame, ts: datetime, packfile: str, previous: str | None = None, errors: DataFrame | None = None, xattrs: DataFrame | None = None) -> None:
        """A snapshot of files (path, content, and any file information), errors (path, error) and attributes (path, name,
        content), in one transaction.

        A file whose information is that of the previous snapshot's entry has that entry's object, and its content isn't
        looked at. Other contents are cut into chunks by content; those that the store lacks go into pack files.
        """
        s = self.settings
        info = [c for c in INFO if c in files.columns]
        rows = files.select("path", paths.dirname(F.col("path")).alias("parent"), F.octet_length("content").cast("long").alias("size"), *info, "content")
        if previous is not None and info:
            of = self.table("entries").where(F.col("snapshot_id") == previous)
            old = of.select("path", F.struct("size", *(c for c in info if c in of.columns)).alias("_old"), F.col("object").alias("_object"))
            same = F.col("_old") == F.struct("size", *(c for c in info if c in of.columns))
            rows = rows.join(old, "path", "left").withColumn("_object", F.when(same, F.col("_object"))).drop("_old")
        else:
            rows = rows.withColumn("_object", F.lit(None).cast("string"))
        rows = rows.withColumn("cached", F.col("_object").isNotNull()).withColumn("object", F.coalesce("_object", F.sha2("content", 256))).drop("_object")
        with self.transaction() as tx:
            self.append("entries", rows.select(F.lit(snapshot_id).alias("snapshot_id"), "path", "parent", "size", *info, "object", "cached"), tx)
            contents = rows.where("NOT cached").select("object", "content")
            if xattrs is not None:
                named = xattrs.withColumn("object", F.sha2("content", 256))
                self.append("xattrs", named.select(F.lit(snapshot_id).alias("snapshot_id"), "path", "name", "object"), tx)
                contents = contents.unionByName(named.select("object", "content"))
            if errors is not None:
                self.append("errors", errors.select(F.lit(snapshot_id).alias("snapshot_id"), "path", paths.dirname(F.col("path")).alias("parent"), "error"), tx)
            new = contents.dropDuplicates(["object"]).join(self.known("objects").select("object").distinct(), "object", "left_anti")
            chunks = content.content_chunks(new.withColumnRenamed("object", "id"), s.chunk_least, s.chunk_normal, s.chunk_most, with_data=True)
            chunks.withColumnRenamed("id", "object").select("object", "ordinal", "mac", "length", "data").write.parquet(staged := f"{self.folder}/staged/{tx}")
            chunks = self.spark.read.parquet(staged)
            self.append("objects", chunks.select("object", "ordinal", "mac", "length"), tx)
            fresh = catalog.new_blobs(chunks.select(F.lit(catalog.CHUNK).alias("type"), "mac", "length", "data"), self.deltas())
            total = chunks.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
            channels = max(1, total // (8 * s.pack_size))  # packs are filled in order, a channel at a time
            fresh = fresh.withColumns({"channel": F.pmod(F.xxhash64("mac"), F.lit(channels)), "seq": F.col("mac")})
            bins = content.pack_bins(fresh, s.pack_size).select("seq", "bin")
            named = fresh.join(bins, "seq").withColumn("packfile", F.concat_ws("-", F.lit(packfile), "channel", "bin"))
            built = packs.built(named.withColumns({"version": F.lit(VERSION), "flags": F.lit(0)}).select("packfile", "seq", "type", "version", "mac", "flags", "data"), int(ts.timestamp() * 1e9))
            self.append("packs", built, tx)
            built = self.spark.read.parquet(f"{self.folder}/packs/tx={tx}")
            head = self.spark.createDataFrame([(catalog.SNAPSHOT, snapshot_id, packfile, 0, 0)], SCHEMAS["deltas"])
            self.append("deltas", packs.index_of(built).select(F.col("type").cast("int").alias("type"), "mac", "packfile", "offset", "length").unionByName(head), tx)
            self.append("packfiles", built.select("packfile", F.lit(ts).alias("ts")).unionByName(self.spark.createDataFrame([(packfile, ts)], SCHEMAS["packfiles"])), tx)
            self.append("snapshots", self.spark.createDataFrame([(snapshot_id, ts)], SCHEMAS["snapshots"]), tx)
        fs, path = self._path(f"staged/{tx}")
        fs.delete(path, True)

    def delete(self, snapshot_id: str, when: datetime) -> None:
        self.colour(catalog.SNAPSHOT, snapshot_id, when)


def forked(headers: DataFrame, snapshot_id: str, new_id: str, ts: datetime, dataset: str = "", data_classes: list[str] | None = None) -> DataFrame:
    """A header's copy; the context is not copied, dataset and data classes are given anew."""
    out = headers.where(F.col("item_id") == snapshot_id).withColumns({"item_id": F.lit(new_id), "ts": F.lit(ts)})
    changes = {"context": F.lit(None), "dataset": F.lit(dataset), "data_classes": F.array(*map(F.lit, data_classes or [])).cast("array<string>")}
    return out.withColumns({c: x.cast(out.schema[c].dataType) for c, x in changes.items() if c in out.columns})


CLASSIFIERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def classify(entries: DataFrame, names: list[str]) -> DataFrame:
    """entries with classifications: analyser and classes of every named classifier that found some."""
    out = entries.withColumn("classifications", F.array().cast("array<struct<analyzer: string, classes: array<string>>>"))
    for name in names:
        out = CLASSIFIERS[name](out).withColumn("classifications", F.when(F.size("_classes") > 0, F.array_append("classifications", F.struct(F.lit(name).alias("analyzer"), F.col("_classes").alias("classes")))).otherwise(F.col("classifications"))).drop("_classes")
    return out
