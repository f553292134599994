"""WARC files as a Spark data source, written and read on the executors.

Writing makes one .warc.gz a task, a gzip member for each record, each with its lengths in the gzip header ("sl"), so that
a reader can go on to the next without inflating. Reading plans byte ranges of files; a member belongs to the range in
which it begins. Comparisons on record_type, target_uri, record_id, refers_to and payload_digest are pushed down: headers
are parsed first, and a record that they reject, or whose payload isn't wanted (option payload=false), is skipped undecoded.

Responses are written as an HTTP response with the payload as its body, so other readers of WARC files take them. Null
header columns leave their header out; a null payload is written as an empty one. Repeated rows are all written. A record is
made and read as one value, however long it is. Columns that aren't in SCHEMA are not looked at. An empty table gives an
empty archive, which reads as no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from tidepool.llm import common

#: Columns kept in headers, and the headers' names.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length", "page_id": "X-Page-ID"}
NUMBERS = ("payload_bytes", "page_id")
SCHEMA = ", ".join(f"{c} {'long' if c in NUMBERS else 'string'}" for c in HEADERS) + ", payload binary"
BLOCK = 4 << 20
#: What the format prescribes for a record of each type; fixed values.
HTTP = "application/http; msgtype=response"
MORE_HEADERS = {"response": [f"Content-Type: {HTTP}"], "revisit": [f"Content-Type: {HTTP}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"], "warcinfo": ["Content-Type: application/warc-fields"]}


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member with an "sl" extra field: the member's length, then that of the data."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 20 + len(body) + 8
    extra = b"sl" + (16).to_bytes(2, "little") + total.to_bytes(8, "little") + len(data).to_bytes(8, "little")
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def now() -> str:
    return f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%SZ}"


def record(row: dict) -> bytes:
    """A record of the columns of SCHEMA; a response's payload becomes the body of an HTTP response."""
    payload, kind = row.get("payload") or b"", row.get("record_type")
    if kind == "response":
        payload = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    lines = ["WARC/1.1", *MORE_HEADERS.get(kind, [])]
    for column, name in HEADERS.items():
        if row.get(column) is not None:
            value = str(row[column]).replace("\r", " ").replace("\n", " ")
            lines.append(f"{name}: {value}")
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


class Window:
    """Bytes of a file by offset, fetched a block at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, BLOCK))
        return self.held[at - self.at : at - self.at + n]


def opens(window: Window, at: int) -> bool:
    """Whether a member of a WARC record begins there."""
    if window.get(at, 3) != b"\x1f\x8b\x08":
        return False
    try:
        return zlib.decompressobj(31).decompress(window.get(at, 1024), 5) == b"WARC/"
    except zlib.error:
        return False


def members(window: Window, start: int, stop: int) -> Iterator[tuple[int, int | None]]:
    """(offset, length if the header tells it) of the members that begin in [start, stop)."""
    at = start
    while at and at < stop and not opens(window, at):
        found = window.get(at + 1, BLOCK // 2).find(b"\x1f\x8b\x08")
        at = at + 1 + found if found >= 0 else at + max(1, BLOCK // 2 - 2)
    while at < min(stop, window.size):
        head = window.get(at, 32)
        length = int.from_bytes(head[16:24], "little") if head[3] & 4 and head[12:14] == b"sl" else None
        yield at, length
        if length is None:
            inflate, end = zlib.decompressobj(31), at
            while not inflate.eof:
                chunk = window.get(end, 1 << 16)
                if not chunk:
                    raise ValueError("a WARC file ends inside a record")
                inflate.decompress(chunk)
                end += len(chunk)
            length = end - at - len(inflate.unused_data)
        at += length


def parse(window: Window, at: int, length: int | None, wanted, payload: bool) -> dict | None:
    """The record whose member begins at `at`; the payload is inflated only if the header is wanted."""
    inflate, head, end = zlib.decompressobj(31), b"", at
    while b"\r\n\r\n" not in head and not inflate.eof:
        chunk = window.get(end, 2048)
        if not chunk:
            raise ValueError("a WARC file ends inside a header")
        take = inflate.decompress(chunk, 1024)
        while b"\r\n\r\n" not in head + take and inflate.unconsumed_tail:
            take += inflate.decompress(inflate.unconsumed_tail, 1024)
        head, end = head + take, end + len(chunk)
    raw, _, rest = head.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, found, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:]) if found}
    row = {c: fields.get(name.lower()) for c, name in HEADERS.items()}
    for c in NUMBERS:
        row[c] = int(row[c]) if row[c] is not None else None
    if not wanted(row):
        return None
    row["payload"] = None
    if payload:
        n = int(fields.get("content-length", 0))
        parts, have = [rest], len(rest)
        while have < n:
            data = inflate.unconsumed_tail or window.get(end, 1 << 18)
            end += 0 if inflate.unconsumed_tail else len(data)
            if not data:
                raise ValueError("a WARC file ends inside a payload")
            parts.append(inflate.decompress(data))
            have += len(parts[-1])
        block = b"".join(parts)[:n]
        row["payload"] = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    return row


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema):
        self.folder, self.level = options["path"], int(options.get("level", 6))

    def write(self, batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, top = common.filesystem(self.folder)
        path, out = f"{top}/part-{context.partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None
        for batch in batches:
            if out is None:
                fs.create_dir(top, recursive=True)
                out = fs.open_output_stream(path, compression=None)
                out.write(member(record({"record_type": "warcinfo", "record_id": f"<urn:uuid:{uuid.uuid4()}>", "date": now(), "payload": b"format: WARC File Format 1.1\r\n"}), self.level))
            columns = batch.schema.names
            for values in zip(*(batch.column(c) for c in columns), strict=True):
                out.write(member(record({c: v.as_py() for c, v in zip(columns, values, strict=True)}), self.level))
        if out is not None:
            out.close()
        return Written(path if out is not None else None)

    def commit(self, messages):
        """Only files of tasks that count are listed, so what a repeated task left is never read."""
        fs, top = common.filesystem(self.folder)
        fs.create_dir(top, recursive=True)
        with fs.open_output_stream(f"{top}/_files-{uuid.uuid4().hex}") as out:
            out.write("\n".join(m.path for m in messages if m and m.path).encode())

    def abort(self, messages):
        fs, _ = common.filesystem(self.folder)
        for m in messages:
            if m and m.path:
                fs.delete_file(m.path)


@dataclass
class Span(InputPartition):
    path: str
    start: int
    stop: int

    def __init__(self, path, start, stop):
        self.path, self.start, self.stop = path, start, stop


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.payload = options["path"], str(options.get("payload", "true")).lower() == "true"
        self.span, self.tests = int(options.get("splitbytes", 64 << 20)), []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append(("=", column, f.value))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append(("in", column, tuple(f.value)))
            elif column in HEADERS and isinstance(f, (IsNull, IsNotNull)):
                self.tests.append(("null", column, isinstance(f, IsNull)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append(("starts", column, f.value))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for kind, column, value in self.tests:
            x = row[column]
            if kind == "null":
                ok = (x is None) == value
            else:
                ok = x is not None and (x == value if kind == "=" else x in value if kind == "in" else x.startswith(value))
            if not ok:
                return False
        return True

    def partitions(self):
        from pyarrow.fs import FileSelector

        fs, top = common.filesystem(self.folder)
        entries = fs.get_file_info(FileSelector(top, allow_not_found=True))
        lists = [x.path for x in entries if x.base_name.startswith("_files-")]
        if lists:
            names = [y for x in lists for y in fs.open_input_stream(x).read().decode().split("\n") if y]
            sizes = {x.path: x.size for x in entries}
            files = [(x, sizes[x]) for x in names]
        else:
            files = [(x.path, x.size) for x in entries if x.base_name.endswith(".warc.gz")]
        return [Span(p, a, min(a + self.span, n)) for p, n in files for a in range(0, n, self.span)] or [Span("", 0, 0)]

    def read(self, part):
        if not part.path:
            return
        fs, _ = common.filesystem(self.folder)
        with fs.open_input_file(part.path) as file:
            window, held, size = Window(file, file.size()), [], 0
            for at, length in members(window, part.start, part.stop):
                row = parse(window, at, length, self.wanted, self.payload)
                if row is not None:
                    held.append(row)
                    size += len(row["payload"] or b"")
                if len(held) >= 4096 or size >= BLOCK:
                    yield self.batch(held)
                    held, size = [], 0
            if held:
                yield self.batch(held)

    @staticmethod
    def batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = dict.fromkeys(NUMBERS, pa.int64()) | {"payload": pa.binary()}
        return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in [*HEADERS, "payload"]})


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, schema)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# -- archives of pages -----------------------------------------------------------------------------------------------

#: Rows with one digest are dealt over so many keys when they meet their digest's first page.
SALTS = 32
LEAST_BYTES = 100
#: Revisits (about 100 bytes each) that are sent to all executors at most; more meet the payloads in a shuffle.
MOST_SENT = 500_000


def uuid_of(*parts) -> F.Column:
    """A record id that the same parts always get."""
    return F.regexp_replace(F.md5(F.concat_ws(":", *parts)), "(.{8})(.{4})(.{4})(.{4})(.{12})", "<urn:uuid:$1-$2-$3-$4-$5>")


def records_of(pages: DataFrame, least_bytes: int = LEAST_BYTES, date: str | None = None) -> DataFrame:
    """A WARC record for each page: of equal payloads of at least that many bytes, the smallest page_id is the response.

    Rows that share the smallest page_id are all responses; where they share the payload too, their record ids are the same.
    Null html is an empty payload; a null page_id is a response of its own. date: of all records; null: now.
    """
    text = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    page = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("target_uri"), text.alias("body")).withColumns({"digest": F.sha2("body", 256), "payload_bytes": F.octet_length("body").cast("long")})
    keys = page.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", F.unhex("digest").alias("raw"))
    first = keys.groupBy("raw").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("raw", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    revisits = keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(first, ["raw", "salt"]).where("page_id > first").select("page_id", "raw", "first").distinct()
    revisits = common.stash(revisits, "revisits")
    if revisits.count() <= MOST_SENT:
        revisits = F.broadcast(revisits)
    out = page.withColumn("raw", F.unhex("digest")).join(revisits, ["page_id", "raw"], "left")
    again = F.col("first").isNotNull()
    made = {
        "record_type": F.when(again, "revisit").otherwise("response"), "record_id": F.when(F.col("page_id").isNull(), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))).otherwise(uuid_of("page_id", "digest")), "date": F.lit(date or now()), "target_uri": F.col("target_uri"),
        "refers_to": F.when(again, uuid_of("first", "digest")), "payload_digest": F.concat(F.lit("sha256:"), "digest"), "payload_bytes": F.col("payload_bytes"), "page_id": F.col("page_id"), "payload": F.when(~again, F.col("body")),
    }
    return out.select(*(c.alias(name) for name, c in made.items()))


def read_back(spark, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, lengths and digests from the payloads
    as they are in the archives; a revisit has those of the response that it refers to, null if that isn't there."""
    archive = lambda payload: spark.read.format("warc").option("payload", payload).load(folder)
    responses = archive("true").where("record_type = 'response'").select("page_id", "record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    responses = common.stash(responses, "responses")
    named = responses.groupBy("record_id").agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("payload_bytes"), F.min("payload_digest").alias("payload_digest"))
    revisits = archive("false").where("record_type = 'revisit'").select("page_id", F.col("refers_to").alias("record_id"))
    met = revisits.join(named, "record_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}).select(columns).unionByName(met.withColumn("record_type", F.lit("revisit")).select(columns))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    register(spark)
    folder = common.shared_dir(spark, "warc")
    records_of(common.table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(folder)
    return read_back(spark, folder)


OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
     f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.d = p.d AND p.n >= 100
"""
