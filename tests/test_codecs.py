"""Codecs, signatures, content types, links, checks, the store's settings and locks, and stateful streams."""

from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidepool.functions import codecs, mime, signing
from tidepool.operators import content, locate, snapshots, tree
from tidepool.streaming import events


@pytest.mark.parametrize("algorithm", ["GZIP", "LZ4", "ZSTD"])
def test_compression(spark, algorithm):
    rows = spark.createDataFrame([(1, b"ab" * 5000), (2, b""), (3, None)], "i int, d binary")
    small = rows.withColumn("d", codecs.deflated(F.col("d"), algorithm))
    assert len(small.where("i = 1").first().d) < 500
    assert [r.d for r in small.withColumn("d", codecs.inflated(F.col("d"), algorithm)).orderBy("i").collect()] == [b"ab" * 5000, b"", None]
    with pytest.raises(ValueError):
        codecs.deflated(F.col("d"), "RAR")


@F.arrow_udf(LongType())
def batch_bytes(values: pa.Array) -> pa.Array:
    return pa.array([values.nbytes] * len(values), pa.int64())


@pytest.mark.parametrize("step", [lambda c: codecs.deflated(c, "ZSTD"), lambda c: codecs.inflated(codecs.deflated(c)), content.byte_entropy], ids=["deflated", "inflated", "entropy"])
def test_batches_of_contents(spark, step):
    """20 MB in one task are worked off a few MB at a time."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(0, 2000, 1, 1).select(F.encode(F.repeat(F.sha2(F.col("id").cast("string"), 256), 160), "UTF-8").alias("d"))
    got = rows.select(batch_bytes("d").alias("n"), step(F.col("d")).alias("x")).agg(F.max("n"), F.count("x")).first()
    assert got[0] < 6_000_000 and got[1] == 2000


def test_encryption(spark):
    key, other = b"k" * 32, b"o" * 32
    rows = spark.createDataFrame([(i, d) for i, d in enumerate([b"same", b"same", b"", None, bytes(100_000)])], "i int, d binary")
    sealed = codecs.encoded(rows, "d", "ZSTD", key).persist()
    got = [r.d for r in sealed.orderBy("i").collect()]
    assert got[0] != got[1] and got[3] is None
    assert [r.d for r in codecs.decoded(sealed, "d", "ZSTD", key).orderBy("i").collect()] == [b"same", b"same", b"", None, bytes(100_000)]
    assert all(r.d is None for r in sealed.select(codecs.decrypted(F.col("d"), other).alias("d")).collect())
    changed = spark.createDataFrame([(bytes(got[0])[:-1] + bytes([got[0][-1] ^ 1]),)], "d binary")
    assert changed.select(codecs.decrypted(F.col("d"), key)).first()[0] is None


def test_signatures(spark):
    secret = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public = signing.public_key(secret)
    assert public.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    s = signing.sign(secret, b"")
    assert s.hex() == "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"
    assert signing.verify(public, b"", s) and not signing.verify(public, b"x", s) and not signing.verify(public, b"", s[:-1]) and not signing.verify(bytes(31) + b"\xff", b"", s)
    rows = spark.createDataFrame([(public, b"", s), (public, b"x", s), (public, b"x", None)], "p binary, m binary, s binary")
    assert [r[0] for r in rows.select(signing.verified(F.col("p"), F.col("m"), F.col("s"))).collect()] == [True, False, None]


def test_records(spark):
    for layout, n in ((codecs.DELTA, 85), (codecs.COLOURED, 41), (codecs.PACKFILE, 72), (codecs.DELETE, 66), (codecs.PACK_BLOB, 56), (codecs.PACK_FOOTER, 56)):
        assert codecs.width(layout) == n
        values = tuple(f"{i:02x}" * 32 if size == 32 else (1 << 8 * size - 1) - 1 for i, (_, size) in enumerate(layout))
        rows = spark.createDataFrame([values], ", ".join(f"`{name}` {'string' if size == 32 else 'long'}" for name, size in layout))
        raw = rows.select(codecs.record(layout).alias("raw"))
        assert len(raw.first().raw) == n
        assert tuple(raw.select(*codecs.fields(F.col("raw"), layout)).first()) == values
        assert set(raw.select(*codecs.fields(F.substring("raw", 1, n - 1), layout)).first()) == {None}
    row = spark.createDataFrame([(1, 2, "ab" * 32, "cd" * 32, 258, 3, 4)], "type int, version int, mac string, packfile string, offset int, length int, flags int")
    assert bytes(row.select(codecs.record(codecs.DELTA)).first()[0]) == b"\x01\x02\0\0\0" + b"\xab" * 32 + b"\xcd" * 32 + b"\x02\x01" + bytes(6) + b"\x03\0\0\0\x04\0\0\0"


def test_content_types(spark):
    cases = [(b"\x89PNG\r\n\x1a\n..", "a.txt", "image/png"), (b"plain words", "a", "text/plain; charset=utf-8"), (b"  <html><body>", "a", "text/html; charset=utf-8"), (b"\0\1\2", "a.JSON", "application/json"), (b"\0\1\2", "dir.d/a", mime.UNKNOWN), (b"", "a.html", "text/html"), (None, "a", mime.UNKNOWN), (b"\xff\xfe\xfd", "a", mime.UNKNOWN), (b"#!/bin/sh\n", "run", "text/x-shellscript"), (b"%PDF-1.7", "x", "application/pdf")]
    rows = spark.createDataFrame(cases, "d binary, n string, want string")
    assert not rows.select("want", mime.sniffed(F.col("d"), F.col("n")).alias("got")).where("NOT want <=> got").collect()
    assert rows.select(mime.sniffed(F.col("d"), F.col("n"), F.lit(False))).distinct().collect() == [(mime.NOT_REGULAR,)]


def test_links(spark):
    rows = [("/", "/", ""), ("/a", "/", ""), ("/a/f", "/a", ""), ("/l", "/", "a"), ("/m", "/", "/l"), ("/a/up", "/a", "../b"), ("/b", "/", ""), ("/b/g", "/b", ""), ("/x", "/", "y"), ("/y", "/", "x"), ("/to", "/", "a/f")]
    entries = spark.createDataFrame(rows, "path string, parent string, target string")
    want = {"/a/f": ("/a/f", True), "/l/f": ("/a/f", True), "/m/f": ("/a/f", True), "/m/up/g": ("/b/g", True), "/to": ("/a/f", True), "/l/none": ("/a/none", False)}
    got = tree.follow_links(entries, spark.createDataFrame([(p,) for p in want], "path string"))
    assert {r.asked: (r.path, r.found) for r in got.collect()} == want
    assert [r.found for r in tree.follow_links(entries, spark.createDataFrame([("/x/f",)], "path string"), 3).collect()] == [False]


def test_check(spark):
    entries = spark.createDataFrame([("/", "directory", 0, None), ("/a", "regular", 5, "o1"), ("/b", "regular", 7, "o2"), ("/c", "regular", 9, "o3"), ("/s", "symlink", 0, None), ("/k", "regular", 3, "o4")], "path string, kind string, size long, object string")
    objects = spark.createDataFrame([("o1", "ok"), ("o2", "object corrupted")], "object string, status string")
    rows, counters = content.check_tree(entries, objects, "/", spark.createDataFrame([("/k",)], "path string"))
    assert {r.path: r.status for r in rows.collect()} == {"/": "ok", "/a": "ok", "/b": "object corrupted", "/c": "object missing", "/s": "ok", "/k": "skipped"}
    assert counters.first().asDict() == {"files": 3, "directories": 1, "symlinks": 1, "size": 21, "checked_bytes": 5, "errors": 2}
    assert content.check_tree(entries.limit(0), objects)[1].first().asDict() == dict.fromkeys(counters.columns, 0)


def test_file_order(spark):
    rows = spark.createDataFrame([("/b", "b", 1), ("/a", "a", 1), ("/c", "c", 2)], "path string, name string, size long")
    assert [r.path for r in locate.sort_files(rows, "-Size, Name").collect()] == ["/c", "/a", "/b"]
    for bad in ("Colour", "Size,-Size"):
        with pytest.raises(ValueError):
            locate.sort_files(rows, bad)


def test_store_settings_and_locks(spark, tmp_path):
    at, top = datetime(2025, 1, 1), str(tmp_path / "s")
    store = snapshots.Store.create(spark, top, snapshots.Settings(repository_id="r", compression="ZSTD"), "secret")
    assert snapshots.Store.open(spark, top, "secret").key == store.key
    assert snapshots.Store.open(spark, top, "secret").settings.compression == "ZSTD"
    for wrong in (None, "guess"):
        with pytest.raises(ValueError):
            snapshots.Store.open(spark, top, wrong)
    with pytest.raises(ValueError):
        snapshots.Settings.from_bytes(snapshots.Settings().to_bytes(snapshots.VERSION + 1))
    store.lock("one", "h1", at)
    store.lock("two", "h2", at)
    with pytest.raises(RuntimeError):
        store.lock("maintenance", "h3", at, exclusive=True)
    store.unlock("one", at + timedelta(minutes=1))
    store.lock("maintenance", "h3", at + timedelta(minutes=11), exclusive=True)  # the other is stale by now
    with pytest.raises(RuntimeError):
        store.lock("three", "h4", at + timedelta(minutes=12))
    reader = snapshots.Store.open(spark, top, "secret", snapshots.READ)
    assert reader.tables() == ["locks"] and 0 < reader.size("locks") < reader.size() and reader.size("packs") == 0
    with pytest.raises(PermissionError):
        reader.unlock("two", at)
    with pytest.raises(PermissionError):
        snapshots.Store(spark, top, snapshots.WRITE).table("locks")


def test_synchronize(spark, tmp_path):
    at = datetime(2025, 1, 1)
    one, two = (snapshots.Store(spark, str(tmp_path / n)) for n in "ab")
    one.ingest("s1", spark.createDataFrame([("/a", b"hello world"), ("/b", b"hello world"), ("/c", b"x")], "path string, content binary"), at, "p1")
    two.ingest("s0", spark.createDataFrame([("/z", b"hello world")], "path string, content binary"), at, "p0")
    one.synchronize(two, "s1", "p2")
    assert {(r.path, bytes(r.content)) for r in two.files("s1").collect()} == {("/a", b"hello world"), ("/b", b"hello world"), ("/c", b"x")}
    assert two.table("deltas").where("type = 9").count() == 2
    mac = two.table("entries").where("path = '/z'").first().object  # one chunk
    asked = spark.createDataFrame([(mac, 6, 5), ("none", 0, 1)], "mac string, offset long, length long")
    assert {r.mac: r.data and bytes(r.data) for r in two.ranged(asked).collect()} == {mac: b"world", "none": None}
    with pytest.raises(ValueError):
        one.synchronize(two, "nothing", "p3")


def test_tracked_stream(spark, tmp_path):
    schema = "scope string, at_us long, bytes long, dt_ns long"
    source = str(tmp_path / "in")
    for rows in ([("r", 0, 5, 50), ("r", 10, 0, 99), ("w", 5, 1, -4)], [("r", 2_000_000, 5, 50)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    out = events.tracked(events.read(spark, source, schema, 1)).writeStream.format("memory").queryName("tracked").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    last = {r.scope: (r.bytes, r.active_ns, r.wall_us) for r in spark.table("tracked").orderBy("bytes", "wall_us").collect()}
    assert last == {"r": (10, 100, 2_000_000), "w": (1, 0, 0)}


def test_setting_records(spark):
    rows = spark.createDataFrame([("name", b"value", 7), ("", b"", 1 << 40), ("k" * 200, b"v" * 3000, -1)], "key string, value binary, at long")
    raw = rows.select(codecs.setting_record(F.col("key"), F.col("value"), F.col("at")).alias("raw"))
    assert [bytes(r.raw) for r in raw.limit(1).collect()] == [b"\x04name\x05\0value\x07" + bytes(7)]
    assert [(r.key, bytes(r.value), r.created_ns) for r in raw.select(*codecs.setting_fields(F.col("raw"))).collect()] == [tuple(r) for r in rows.collect()]
    cut = raw.select(F.expr("substring(raw, 1, octet_length(raw) - 1)").alias("raw"))
    assert all(set(r) == {None} for r in cut.select(*codecs.setting_fields(F.col("raw"))).collect())


def test_packs(spark):
    from tidepool.operators import packs

    data = [("p", i, 9, 1, f"{i:02x}" * 32, 0, b"x" * i) for i in range(4)] + [("q", 0, 9, 1, "ff" * 32, 0, b"other")]
    built = packs.built(spark.createDataFrame(data, "packfile string, seq int, type int, version int, mac string, flags int, data binary"), 5).persist()
    index = packs.index_of(built)
    assert sorted((r.packfile, r.mac[:2], r.offset, r.length) for r in index.collect()) == [("p", "00", 0, 0), ("p", "01", 0, 1), ("p", "02", 1, 2), ("p", "03", 3, 3), ("q", "ff", 0, 5)]
    raw = {r.packfile: bytes(r.content) for r in built.collect()}
    bad = bytearray(raw["q"])
    bad[6] ^= 1
    broken = spark.createDataFrame([("q", bytes(bad)), ("e", b""), ("s", raw["p"][1:])], "packfile string, content binary")
    assert {r.packfile: r.status for r in packs.opened(broken).collect()} == {"q": "index corrupted", "e": "no footer", "s": "no footer"}
    deltas = index.unionByName(index.where("packfile = 'q'").withColumns({"mac": F.lit("far"), "offset": F.lit(1 << 20)})).unionByName(index.where("packfile = 'q'").withColumns({"mac": F.lit("gone"), "packfile": F.lit("z")}))
    asked = spark.createDataFrame([(9, m) for m in ("03" * 32, "ff" * 32, "far", "gone", "never")], "type long, mac string")
    known, none = spark.createDataFrame([("p",), ("q",), ("z",)], "packfile string"), spark.createDataFrame([], "type int, mac string")
    got = {r.mac: r.error or bytes(r.data) for r in packs.get_blobs(asked, deltas, known, none, built).collect()}
    assert got == {"03" * 32: b"xxx", "ff" * 32: b"other", "far": "out of bounds", "gone": "packfile missing", "never": "blob not found"}


def test_object_ranges(spark):
    from tidepool.operators import packs

    rows = [("a", 0, "p", 0, 10), ("a", 1, "p", 10, 10), ("a", 2, "p", 20, 10), ("a", 3, "p", 40, 5), ("a", 4, "q", 45, 5), ("b", 0, "q", 50, 5)]
    got = packs.object_ranges(spark.createDataFrame(rows, "object string, ordinal int, packfile string, offset long, length long"), 15)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0, "p", 0, 20, 2), ("a", 1, "p", 20, 10, 1), ("a", 2, "p", 40, 5, 1), ("a", 3, "q", 45, 5, 1), ("b", 0, "q", 50, 5, 1)]
