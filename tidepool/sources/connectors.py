"""Named importers, exporters and stores, locations, envelopes, and archives as sinks."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidepool.functions import paths

RECORDS = "pathname string, is_error boolean, error string, is_xattr boolean, xattr_name string, target string, size long, mode long, mtime timestamp, content binary"


def parse_location(text: str, fallback: str = "fs") -> tuple[str, str]:
    """`proto://rest` or `proto:rest` -> (proto, rest); a scheme of one letter is a drive, not a scheme."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):(?://)?(.*)$", text, re.S)
    return (m[1], m[2]) if m else (fallback, text)


@dataclass
class Registry:
    """Backends by name, for one kind of connector."""

    kind: str
    known: dict[str, Callable[..., Any]] = field(default_factory=dict)
    #: Endings of local paths that another backend opens.
    endings: dict[str, str] = field(default_factory=dict)

    def register(self, name: str, backend: Callable[..., Any]) -> bool:
        """False if the name is taken."""
        return self.known.setdefault(name, backend) is backend

    def unregister(self, name: str) -> bool:
        return self.known.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self.known)

    def open(self, location: str, *args: Any, **more: Any) -> Any:
        name, rest = parse_location(location)
        if name == "fs":
            name = next((n for end, n in self.endings.items() if rest.endswith(end)), name)
        if name not in self.known:
            raise ValueError(f"unsupported {self.kind} protocol: {name}")
        return self.known[name](rest, *args, **more)


IMPORTERS, EXPORTERS, STORES = Registry("importer"), Registry("exporter"), Registry("store")


def import_files(path: str, spark: SparkSession) -> DataFrame:
    """Files below a folder as records; contents are read only where they are used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    none = lambda kind: F.lit(None).cast(kind)
    return files.select(F.regexp_replace("path", "^[a-z0-9]+:/*", "/").alias("pathname"), F.lit(False).alias("is_error"), none("string").alias("error"), F.lit(False).alias("is_xattr"), none("string").alias("xattr_name"), none("string").alias("target"), F.col("length").alias("size"), F.lit(0o644).cast("long").alias("mode"), F.col("modificationTime").alias("mtime"), "content")


def export_table(path: str, rows: DataFrame) -> None:
    rows.write.mode("errorifexists").parquet(path)


IMPORTERS.register("fs", import_files)
EXPORTERS.register("fs", export_table)


def merged_roots(importers: DataFrame) -> str:
    """One root for importers (origin, type, root) of the same origin and type."""
    from tidepool.operators import tree

    kinds = importers.select("origin", "type").distinct().limit(2).collect()
    if len(kinds) > 1:
        raise ValueError("importers of one source must have the same origin and type")
    return tree.common_prefix(importers.select(F.col("root").alias("path"))).first()[0]


# -- records ---------------------------------------------------------------------------------------------------------


def split_records(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, attributes, errors); an error stops its own record only."""
    return records.where("NOT is_error AND NOT is_xattr"), records.where("NOT is_error AND is_xattr"), records.where("is_error")


def acknowledged(records: DataFrame) -> DataFrame:
    return records.select("pathname", F.when(F.col("is_error"), F.col("error")).alias("error"))


def valid_entry(name: Column, parent: Column) -> Column:
    """Names are plain and parents clean absolute paths."""
    return ~name.isin("", ".", "..") & ~name.contains("/") & parent.startswith("/") & (paths.clean(parent) == parent)


class GeneratedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.n, self.parts = int(options.get("files", 10)), int(options.get("partitions", 2))

    def partitions(self):
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, part) -> Iterator[tuple]:
        for i in range(part.value, self.n, self.parts):
            data = f"file {i}\n".encode() * (i % 7 + 1)
            yield (f"/mock/{i % 10}/{i}.txt", False, None, False, None, None, len(data), 0o644, None, data)


class GeneratedRecords(DataSource):
    """spark.read.format("mockrecords").option("files", n): records for tests."""

    @classmethod
    def name(cls):
        return "mockrecords"

    def schema(self):
        return RECORDS

    def reader(self, schema):
        return GeneratedReader(self.options)


# -- envelopes -------------------------------------------------------------------------------------------------------

#: Eight bytes that begin an envelope; those of other stores are passed in.
MARK = b"_TIDEPL_"


def seal(kind: int, version: int, data: bytes, mark: bytes = MARK) -> bytes:
    body = mark + struct.pack("<II", kind, version) + data
    return body + hashlib.sha256(body).digest()


def unseal(kind: int, raw: bytes, marks: tuple[bytes, ...] = (MARK,)) -> tuple[int, bytes]:
    """(version, data) of an envelope of that kind; an error if it isn't one or was changed."""
    if len(raw) < 48 or raw[:8] not in marks:
        raise ValueError("not an envelope")
    got, version = struct.unpack("<II", raw[8:16])
    if got != kind:
        raise ValueError("envelope of another kind")
    if hashlib.sha256(raw[:-32]).digest() != raw[-32:]:
        raise ValueError("envelope was changed")
    return version, raw[16:-32]


# -- archives --------------------------------------------------------------------------------------------------------


def archive(files: DataFrame, out: io.IOBase, form: str = "tar", top: str = "/") -> int:
    """Writes files (path, content) to one archive in path order, a row at a time, with paths from `top`; how many."""
    if form not in ("tar", "tar.gz", "zip"):
        raise ValueError(f"unknown archive format: {form}")
    pack = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) if form == "zip" else tarfile.open(fileobj=out, mode="w|gz" if form == "tar.gz" else "w|")
    n = 0
    with pack:
        for row in files.where(paths.is_within(F.col("path"), top)).orderBy("path").toLocalIterator(prefetchPartitions=False):
            name, data = row.path[len(top.rstrip("/")) :].lstrip("/") or row.path.rpartition("/")[2] or ".", bytes(row.content)
            if form == "zip":
                pack.writestr(name, data)
            else:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                pack.addfile(info, io.BytesIO(data))
            n += 1
    return n
