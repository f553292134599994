"""Cases with known results: retention, paths, exclusion, ranges, chunks, envelopes, archives, streams, the store."""

import hashlib
import io
import random
import tarfile
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepool.functions import paths, scalars
from tidepool.operators import catalog, content, locate, snapshots, telemetry, tree
from tidepool.sources import connectors
from tidepool.streaming import events

NOW = datetime(2025, 8, 28, 12)


def decided(spark, rows, rules, now=NOW, group=None):
    items = spark.createDataFrame(rows, "item_id string, ts timestamp_ntz, name string")
    return {r.item_id: (r.action, r.rule, r["rank"], r.cap, r.note) for r in locate.retain(items, rules, now, group).collect()}


def test_keep_last_days(spark):
    got = decided(spark, [("a", datetime(2025, 8, 28, 11), ""), ("b", datetime(2025, 8, 27, 11), ""), ("c", datetime(2025, 8, 26, 11), "")], [("day", 2, 0)])
    assert got == {"a": ("keep", "day", 1, 0, "within bucket"), "b": ("keep", "day", 1, 0, "within bucket"), "c": ("delete", "", 0, 0, "outside retention windows")}


def test_cap_by_group(spark):
    now = datetime(2026, 5, 27, 12)
    rows = [(i, now - timedelta(hours=h), n) for i, h, n in (("11", 1, "alpha"), ("12", 2, "alpha"), ("21", 3, "beta"), ("22", 4, "beta"), ("31", 5, "gamma"))]
    kept = lambda g: {k for k, v in decided(spark, rows, [("day", 1, 1)], now, g).items() if v[0] == "keep"}
    assert kept("name") == {"11", "21", "31"} and kept(None) == {"11"}


@pytest.mark.parametrize(("period", "keys"), [("week", ["2021-W01", "2020-W53"]), ("month", ["2021-01", "2020-12"]), ("year", ["2021", "2020"]), ("day", ["2021-01-05", "2021-01-04"]), ("minute", ["2021-01-05-00:00", "2021-01-04-23:59"]), ("friday", ["2020-W53-friday", "2020-W52-friday"])])
def test_last_keys(period, keys):
    assert locate.last_keys(period, datetime(2021, 1, 5), 2) == keys


def test_week_keys(spark):
    df = spark.createDataFrame([(datetime(2021, 1, 3),), (datetime(2024, 12, 30),)], "ts timestamp_ntz")
    assert [r[0] for r in df.select(locate.bucket_key("week", F.col("ts"))).collect()] == ["2020-W53", "2025-W01"]


def test_filters_and_flags():
    assert locate.Filters(types=["x"], ignore_tags=["y"]).empty and not locate.Filters(name="x").empty
    assert locate.parse_tags(["a, !b", "c"]) == (["a", "c"], ["b"])
    with pytest.raises(ValueError):
        locate.sort_keys("Timestamp,Timestamp")
    with pytest.raises(ValueError):
        locate.sort_keys("Nope")


@pytest.mark.parametrize(("text", "want"), [("2025-08-28T12:34:56+02:00", (2025, 8, 28, 10, 34, 56)), ("2025-08-28 09:10", (2025, 8, 28, 9, 10)), ("2025/08/28", (2025, 8, 28)), ("2025-08-28T12:34:56Z", (2025, 8, 28, 12, 34, 56)), ("2025-08-28T12:34:56.789Z", (2025, 8, 28, 12, 34, 56, 789000)), ("2025-08-28 09:10:11", (2025, 8, 28, 9, 10, 11))])
def test_time_flags(text, want):
    assert scalars.parse_time_flag(text, NOW) == datetime(*want, tzinfo=timezone.utc)


@pytest.mark.parametrize("text", [" 2025-08-28", "not-a-time", "2025-13-01", "2025-02-30", "99wibbly", "2025/99/01 25:61", "2025-8-28", "2025-08-28T1:02:03Z", "2025-08-28T12:34:56"])
def test_bad_time_flags(text):
    with pytest.raises(ValueError):
        scalars.parse_time_flag(text, NOW)


def test_relative_times():
    assert scalars.parse_time_flag("2h", NOW) == NOW - timedelta(hours=2) and scalars.parse_time_flag("1m", NOW) == NOW - timedelta(days=30) and scalars.parse_time_flag("", NOW) is None


def test_paths(spark):
    cases = {"": ".", "/": "/", "/a/../..": "/", "a//b/./c": "a/b/c", "../x/..": "..", "/a/b/": "/a/b"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.c for r in df.select("p", paths.clean(F.col("p")).alias("c")).collect()} == cases
    row = spark.createDataFrame([("/a/b/c",)], "p string").select(paths.ancestors(F.col("p")), paths.depth(F.col("p")), paths.dirname(F.col("p")), paths.basename(F.col("p"))).first()
    assert tuple(row) == (["/", "/a", "/a/b"], 3, "/a/b", "c")


def test_depth_order(spark):
    rows = spark.createDataFrame([(p,) for p in ("/etc/zzz", "/etc/foo/bar", "/etc/foo")], "path string")
    assert [r.path for r in tree.by_depth(rows).collect()] == ["/etc/foo", "/etc/zzz", "/etc/foo/bar"]


@pytest.mark.parametrize(("rules", "path", "is_dir", "want"), [(["*.log"], "/app.log", False, True), (["tmp/"], "/tmp", True, True), (["tmp/"], "/tmp", False, False), (["*.log", "!keep.log"], "/d/keep.log", False, False), (["/a/**/z"], "/a/b/c/z", False, True), (["/a"], "/b/a", False, False), (["*"], "/", True, False), (["build"], "/x/build/y.o", False, True)])
def test_exclusion(spark, rules, path, is_dir, want):
    df = spark.createDataFrame([(path, is_dir)], "p string, d boolean")
    assert df.select(tree.excluded(F.col("p"), F.col("d"), rules)).first()[0] is want


def test_rule_files():
    assert tree.load_rules("# c\r\n\r\n*.log  \r\nkeep\\ \n") == ["*.log", "keep\\ "]


def test_globs(spark):
    df = spark.createDataFrame([("a.txt",), ("b/c.txt",), ("x]",)], "n string")
    fits = lambda p: [r.n for r in df.where(tree.name_matches(F.col("n"), p, regex=False)).collect()]
    assert fits("*.txt") == ["a.txt"] and fits("[a-b].txt") == ["a.txt"] and fits("[") == [] and fits("x\\]") == ["x]"]


@pytest.mark.parametrize(("locations", "most", "want"), [([(1, 200, 100), (1, 0, 100), (1, 100, 100)], 4 << 20, [(1, 0, 300, 3)]), ([(1, 0, 100), (2, 100, 100)], 4 << 20, [(1, 0, 100, 1), (2, 100, 100, 1)]), ([(1, 0, 600), (1, 600, 600), (1, 1200, 2000)], 1000, [(1, 0, 600, 1), (1, 600, 600, 1), (1, 1200, 2000, 1)]), ([(1, 0, 100), (1, 900, 100)], 500, [(1, 0, 100, 1), (1, 900, 100, 1)]), ([(1, 0, 100), (1, 200, 100)], 4 << 20, [(1, 0, 300, 2)])])
def test_read_plans(spark, locations, most, want):
    df = spark.createDataFrame(locations, "packfile int, offset long, length long")
    assert sorted(map(tuple, content.read_plan(df, most).collect())) == want


def test_cut_points_are_local():
    data = random.Random(1).randbytes(200_000)
    cuts = content.cut_points(data, 512, 2048, 8192)
    sizes = [b - a for a, b in zip([0, *cuts], cuts, strict=False)]
    assert cuts[-1] == len(data) and max(sizes) <= 8192 and min(sizes[:-1]) >= 512
    moved = content.cut_points(b"!" + data, 512, 2048, 8192)
    assert len({c + 1 for c in cuts} & set(moved)) > len(cuts) * 0.8


@pytest.mark.parametrize("sizes", [(512, 2048, 8192), (1, 64, 100), (100, 128, 120)])
def test_cut_points_by_bytes(sizes):
    """A place at a time: a hash of the last 64 bytes, a stricter mask up to the normal size, a looser one after it."""
    least, normal, most = sizes
    data = random.Random(3).randbytes(40_000)
    gear, bits = content._GEAR.tolist(), normal.bit_length() - 1
    strict, loose = ((1 << (bits + 1)) - 1) << 20, ((1 << (bits - 1)) - 1) << 20
    hashes, h = [], 0
    for b in data:
        h = (h << 1) + gear[b] & (1 << 64) - 1
        hashes.append(h)
    want, start = [], 0
    while len(data) - start > least:
        end = next((i for i in range(start + least + 1, min(len(data), start + most)) if not hashes[i - 1] & (strict if i - start <= normal else loose)), min(len(data), start + most))
        want.append(end)
        start = end
    want += [len(data)] * (start < len(data))
    assert content.cut_points(data, *sizes) == want and content.cut_points(b"", *sizes) == []


def test_content_chunks(spark, monkeypatch):
    """Chunks of each content and ids as they are; the workers get a few MB of contents at a time."""
    r = random.Random(5)
    rows = [(9007199254740993, r.randbytes(3_000_000)), (None, r.randbytes(30_000)), (2, None), (3, b""), (4, b"ab"), *((10 + i, r.randbytes(20_000)) for i in range(500))]
    want = sorted((str(i), k, a, b - a, hashlib.sha256(x[a:b]).hexdigest(), x[a:b]) for i, x in rows if x for cuts in [[0, *content.cut_points(x, 256, 1024, 4096)]] for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    monkeypatch.setattr(content, "SPAN", 8 << 20)
    assert content.cut_points(rows[0][1], 256, 1024, 4096) == [a + n for i, _, a, n, *_ in want if i == str(rows[0][0])]
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.createDataFrame(rows, "id long, content binary").coalesce(1)
    chunks = content.content_chunks(df, 256, 1024, 4096, with_data=True)
    assert sorted((str(x.id), *x[1:5], bytes(x.data)) for x in chunks.collect()) == want
    assert sorted((str(x.id), *x[1:]) for x in content.content_chunks(df, 256, 1024, 4096).collect()) == [x[:5] for x in want]
    most = df.mapInArrow(lambda found: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in found), "n long").agg(F.max("n")).first()[0]
    assert most < 8_000_000


def test_lookups(spark):
    rows = [("abc1", NOW, ["/src", "/x"]), ("abd2", NOW, []), ("ff00", NOW, ["/"])]
    items = spark.createDataFrame(rows, "item_id string, ts timestamp, roots array<string>")
    assert locate.snapshot_of(items, "abc") == "abc1" and sorted(r.item_id for r in locate.with_prefix(items, "ab").collect()) == ["abc1", "abd2"]
    for bad in ("ab", "zz", ""):
        with pytest.raises(LookupError):
            locate.snapshot_of(items, bad)
    assert locate.opened_path(items, "abc1:/etc/../a") == ("abc1", "/a", "") and locate.opened_path(items, "abc1:d/f") == ("abc1", "/src/d/f", "d/f")
    assert locate.opened_path(items, "ff") == ("ff00", "/", ".") and locate.opened_path(items, "abd2:q") == ("abd2", "/q", "q")
    headers = spark.createDataFrame([("a", [("o", "t", "/r")]), ("b", None)], "item_id string, sources array<struct<origin: string, type: string, root: string>>")
    assert [(r.item_id, r.types, r.origins, r.roots) for r in locate.items_of(headers).orderBy("item_id").collect()] == [("a", ["t"], ["o"], ["/r"]), ("b", [], [], [])]


def test_numbered(spark):
    rows = [(r.k, r.n) for r in locate.numbered(spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")), [F.col("k").desc()]).collect()]
    assert sorted(rows) == [(k, 5000 - k) for k in range(5000)]


def test_summaries_by_folds(spark):
    """All figures of all directories of random trees, children before parents in path order, 0 as unset."""
    r = random.Random(11)
    dirs = ["/"] + [p for p in {f"/{a}" for a in "abc"} | {f"/{a}/{b}" for a in "ab" for b in "xyz"} | {f"/a/x/{c}" for c in "pq"}]
    files = [(f"{d.rstrip('/')}/f{i}", d, r.choice(["regular", "regular", "symlink", "device", "pipe", "socket"]), r.choice([0, 1, 5, 9]), r.choice([0, 3, 8]), float(r.choice([0, 1, 4, 7])), r.choice(["text/plain", "audio/ogg", "video/mp4", "application/pdf", "font/otf", "", None]), r.choice([0, 2]), r.choice([0, scalars.MODE_SETUID, scalars.MODE_SETGID | scalars.MODE_STICKY])) for d in dirs if d != "/b/z" for i in range(r.randint(0, 6))]
    rows = files + [(d, "" if d == "/" else d.rpartition("/")[0] or "/", "directory", 0, None, None, "", 0, 0) for d in dirs]
    entries = spark.createDataFrame(rows, "path string, parent string, kind string, size long, mtime long, entropy double, content_type string, n_chunks int, mode long")
    errors = spark.createDataFrame([(d,) for d in dirs[::2] for _ in range(2)], "parent string")
    fold = lambda a, x: x if a == 0 or x < a else a
    made = {}
    for d in sorted(dirs, reverse=True):
        own = dict.fromkeys((*tree.SUMS, "sum_entropy", *(f"{m}_{c}" for m in ("min", "max") for c in tree.EXTREMES)), 0)
        under = dict.fromkeys((*tree.SUMS, *(f"{m}_{c}" for m in ("min", "max") for c in tree.EXTREMES), "errors"), 0)
        for path, parent, kind, size, mtime, entropy, mime, chunks, mode in sorted(rows, key=lambda x: x[0]):
            if parent != d or path == "/":
                continue
            own["children"] += 1
            own[{"regular": "files", "directory": "directories"}.get(kind, kind + "s")] += 1
            if kind == "directory":
                o, u = made[path]
                for c in (*tree.SUMS, "errors"):
                    under[c] += o.get(c, 0) + u[c]
                for c in tree.EXTREMES:
                    under[f"min_{c}"] = fold(fold(under[f"min_{c}"], u[f"min_{c}"]), o[f"min_{c}"])
                    under[f"max_{c}"] = max(under[f"max_{c}"], u[f"max_{c}"], o[f"max_{c}"])
                continue
            for name, bit in tree.BITS.items():
                own[name] += bool(mode & bit)
            own["objects"] += chunks > 0
            own["chunks"] += chunks
            own["size"] += size
            own["sum_entropy"] += entropy
            own["low_entropy"] += entropy <= 2
            own["high_entropy"] += entropy >= 7
            if mime:
                own["mime_" + (mime.split("/")[0] if mime.split("/")[0] in tree.MIMES else "other")] += 1
            for c, x in (("size", size), ("mtime", mtime), ("entropy", entropy)):
                own[f"min_{c}"], own[f"max_{c}"] = fold(own[f"min_{c}"], x), max(own[f"max_{c}"], x)
        under["errors"] += 2 * (d in dirs[::2])
        made[d] = own, under
    for row in tree.summaries(entries, errors).collect():
        own, under = made.pop(row.path)
        got = row.directory.asDict()
        n = own["files"]
        assert {c: got[c] for c in own} == own and (got["avg_size"], got["avg_entropy"]) == ((own["size"] // n, own["sum_entropy"] / n) if n else (0, 0))
        assert row.below.asDict() == under, row.path
    assert not made


def test_export_of_one_file(spark):
    rows = spark.createDataFrame([("/", "", "directory", ""), ("/d", "/", "directory", ""), ("/d/f", "/d", "regular", ""), ("/d/e/g", "/d/e", "regular", "")], "path string, parent string, kind string, target string")
    paths_of = lambda top: sorted((r.path, r.kind) for r in tree.exported(rows, top).collect())
    assert paths_of("/d/f") == [("/", "directory"), ("/f", "regular")] and paths_of("/d") == [("/", "directory"), ("/e/g", "regular"), ("/f", "regular")]
    assert len(paths_of("/")) == 4
    assert tree.source_root("/d/f", False) == "/d" and tree.source_root("/f", False) == "/" and tree.source_root("/d", True) == "/d"
    local = lambda kind: sorted(r.path for r in tree.without_store(rows, "/d/e", kind).collect())
    assert local("fs") == ["/", "/d", "/d/f"] and len(local("s3")) == 4


def test_entry_lists(spark):
    rows = spark.createDataFrame([("/b", "m1", ["z", "a"], None), ("/a", None, None, ["t"]), ("/c", "m1", [], [])], "path string, mac string, xattrs array<string>, tags array<string>")
    assert [r.xattrs for r in tree.with_sorted_xattrs(rows).collect()] == [["a", "z"], [], []]
    assert [r.tags for r in tree.normalised(rows, ("tags",)).collect()] == [[], ["t"], []]
    assert [r.path for r in tree.pathnames(rows).collect()] == ["/a", "/b", "/c"] and [r.mac for r in tree.file_macs(rows).collect()] == ["m1"]
    assert [r.path for r in tree.listing(rows, descending=True).collect()] == ["/c", "/b", "/a"]
    errors = spark.createDataFrame([("/d/x", "e"), ("/dd", "e"), ("/d", "e")], "path string, error string")
    assert [r.path for r in tree.errors_beneath(errors, "/d").collect()] == ["/d", "/d/x"]


def test_addresses(spark):
    row = spark.range(1).select(scalars.mac_format(scalars.mac_parse(F.lit("AB" * 32))).alias("a"), scalars.mac_parse(F.lit("ab")).alias("b"), scalars.is_mac(scalars.random_mac()).alias("c"), scalars.hashed(F.lit(b"x"), "MD5").alias("d"), scalars.hashed(F.lit(b"x"), "SHA256").alias("e")).first()
    import hashlib

    assert tuple(row) == ("ab" * 32, None, True, None, hashlib.sha256(b"x").hexdigest())


def test_colours_and_states(spark):
    rows = spark.createDataFrame([(4, "p", 1, False), (4, "p", 2, True), (4, "q", 1, False), (5, "s", 1, None)], "type int, mac string, when_ts long, removed boolean")
    assert [r.mac for r in catalog.coloured_of(rows, 4).collect()] == ["q"] and [r.mac for r in catalog.coloured_of(rows.drop("removed"), 5).collect()] == ["s"]
    states = spark.createDataFrame([("a", 5), ("b", 9), ("c", 9)], "state_id string, ts long")
    assert catalog.latest_state(states).first()[0] == "c"
    tree_of = spark.createDataFrame([("s1", None), ("s2", "s1")], "state_id string, parent string")
    local = spark.createDataFrame([("k", "s1", 1), ("gone", "old", 1)], "key string, state_id string, v int")
    remote = spark.createDataFrame([("k", "s2", 2), ("new", "s2", 3), ("k", "s1", 9)], "key string, state_id string, v int")
    assert sorted(map(tuple, catalog.rebuilt(local, remote, tree_of, ["key"]).collect())) == [("k", "s1", 1), ("new", "s2", 3)]
    objects = spark.createDataFrame([("o", ["m1", "m2", "m1"])], "object string, chunks array<string>")
    deltas = spark.createDataFrame([(9, "m1", "p", 0, 5)], "type int, mac string, packfile string, offset long, length long")
    got = catalog.object_locations(objects, deltas, spark.createDataFrame([("p",)], "packfile string"), rows.where("mac = 'q'")).orderBy("ordinal").collect()
    assert [(r.ordinal, r.mac, r.packfile, r.length) for r in got] == [(0, "m1", "p", 5), (1, "m2", None, None), (2, "m1", "p", 5)]


def test_envelopes():
    raw = connectors.seal(3, 65536, b"data")
    assert connectors.unseal(3, raw) == (65536, b"data")
    for bad in (raw[:-1] + bytes([raw[-1] ^ 1]), b"x" * 60, raw[:20]):
        with pytest.raises(ValueError):
            connectors.unseal(3, bad)
    with pytest.raises(ValueError):
        connectors.unseal(4, raw)


def test_registry():
    r = connectors.Registry("store")
    assert r.register("single", lambda rest: ("single", rest)) and not r.register("single", print) and r.names() == ["single"]
    r.endings[".one"] = "single"
    assert r.open("fs:///x.one") == ("single", "/x.one") and r.unregister("single") and not r.unregister("single")
    assert connectors.parse_location("s3://b/k") == ("s3", "b/k") and connectors.parse_location("C:\\x") == ("fs", "C:\\x")


def test_mock_source_and_archive(spark):
    spark.dataSource.register(connectors.GeneratedRecords)
    rows = spark.read.format("mockrecords").option("files", 12).load()
    out = io.BytesIO()
    assert connectors.archive(rows.select(F.col("pathname").alias("path"), "content"), out, "tar.gz", "/mock") == 12
    out.seek(0)
    with tarfile.open(fileobj=out) as t:
        assert sorted(t.getnames())[0] == "0/0.txt" and len(t.getnames()) == 12


def test_hmac(spark):
    import hashlib
    import hmac

    row = spark.createDataFrame([(bytearray(b"data"),)], "d binary").select(scalars.hmac_sha256_hex(b"key", F.col("d"))).first()
    assert row[0] == hmac.new(b"key", b"data", hashlib.sha256).hexdigest()


def test_store(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path))
    files = lambda *xs: spark.createDataFrame([(p, bytearray(c)) for p, c in xs], "path string, content binary")
    store.ingest("s1", files(("/d/f", b"stable"), ("/d/g", b"stable")), NOW, "p1")
    store.ingest("s2", files(("/d/f", b"stable"), ("/d/h", b"new"), ("/d/e", b"")), NOW, "p2")
    assert store.table("deltas").where("type = 9").count() == 2
    assert {r.path: bytes(r.content) for r in store.files("s2").collect()} == {"/d/f": b"stable", "/d/h": b"new", "/d/e": b""}
    assert {r.item_id for r in store.snapshots().collect()} == {"s1", "s2"}
    store.delete("s1", NOW)
    assert [r.item_id for r in store.snapshots().collect()] == ["s2"] and store.is_coloured(5, "s1") and not store.is_coloured(5, "s2")
    store.colour(5, "s1", NOW + timedelta(seconds=1), removed=True)
    assert store.snapshots().count() == 2
    with pytest.raises(ValueError):
        store.append("nope", files())


def test_incremental_ingest(spark, tmp_path):
    """Large contents in chunks and packs; a second snapshot takes unchanged files as they are, and stores what is new only."""
    store = snapshots.Store(spark, str(tmp_path))
    store.settings = snapshots.Settings(pack_size=20_000, chunk_least=512, chunk_normal=2048, chunk_most=8192)
    r = random.Random(5)
    data = [r.randbytes(60_000), r.randbytes(9_000), b"small"]
    rows = lambda *xs: spark.createDataFrame([(p, bytearray(c), m) for p, c, m in xs], "path string, content binary, mtime long")
    store.ingest("s1", rows(("/a", data[0], 1), ("/b", data[1], 1), ("/c", data[2], 1)), NOW, "p1", errors=spark.createDataFrame([("/d/x", "denied")], "path string, error string"), xattrs=spark.createDataFrame([("/a", "user.k", bytearray(b"v"))], "path string, name string, content binary"))
    first = store.deltas().where("type = 9").count()
    sizes = [len(x.content) for x in store.table("packs").collect()]
    assert first > 15 and len(sizes) >= 3 and max(sizes) < 2 * 20_000 and {x.path: bytes(x.content) for x in store.files("s1").collect()} == dict(zip(("/a", "/b", "/c"), data, strict=True))
    store.ingest("s2", rows(("/a", b"not read", 1), ("/b", data[1], 1), ("/c", data[2], 1)), NOW, "p2", previous="s1")
    assert [x.cached for x in store.table("entries").where("snapshot_id = 's2'").orderBy("path").collect()] == [False, True, True]  # /a has another size
    store.ingest("s3", rows(("/a", data[0][:30_000] + b"!" + data[0][30_000:], 2), ("/b", data[1], 1)), NOW, "p3", previous="s1")
    more = store.deltas().where("type = 9").count()
    assert first < more <= first + 5 and {x.path: bytes(x.content) for x in store.files("s3").collect()}["/a"] == data[0][:30_000] + b"!" + data[0][30_000:]
    other = snapshots.Store(spark, str(tmp_path / "other"))
    store.synchronize(other, "s1", "q1")
    assert {(x.path, bytes(x.content)) for x in other.files("s1").collect()} == set(zip(("/a", "/b", "/c"), data, strict=True))
    assert [(x.path, x.error, x.parent) for x in other.table("errors").collect()] == [("/d/x", "denied", "/d")] and other.table("xattrs").first().name == "user.k"


def test_transactions(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("p", NOW)], "packfile string, ts timestamp")
    store.append("packfiles", rows)
    with pytest.raises(RuntimeError), store.transaction() as tx:
        store.append("packfiles", rows, tx)
        raise RuntimeError("lost on the way")
    assert store.table("packfiles").count() == 1 and store.sweep() == 1 and store.sweep() == 0 and store.table("packfiles").count() == 1
    store.append("deltas", spark.createDataFrame([(9, "m", "p", 0, 1), (9, "n", "q", 0, 1)], snapshots.SCHEMAS["deltas"]))
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    store.bury("packfile", names("p"))
    assert [r.mac for r in store.deltas().collect()] == ["n"] and store.packfiles().count() == 0
    store.bury("delta", names("n"))
    assert store.deltas().count() == 0
    store.put_state("s1", NOW)
    store.put_state("s2", NOW + timedelta(seconds=1))
    held = {r.state_id: (r.parent, r.serial) for r in store.states().collect()}
    assert held["s1"][0] is None and held["s2"] == ("s1", held["s1"][1])
    store.bury("state", names("s1"))
    assert [r.state_id for r in store.states().collect()] == ["s2"]
    with pytest.raises(ValueError):
        store.bury("lock", names("x"))


def test_typed_events(spark):
    at = lambda n: NOW + timedelta(minutes=n)
    base = lambda n: spark.createDataFrame([(at(n), "r", "s", "j", "backup")], "ts timestamp_ntz, repository string, snapshot string, job string, workflow string")
    rows = [("file", 0), ("file.ok", 1), ("file.ok", 2), ("file.error", 3), ("chunk.cached", 4), ("file", 70)]
    typed = None
    for kind, n in rows:
        more = events.emitted(base(n), kind, path=F.lit("/p"), size=F.lit(7))
        typed = more if typed is None else typed.unionByName(more)
    assert len(events.TYPES) == 28 and {r.type: r.level for r in typed.collect()}["file.error"] == "error"
    got = {(r.start.hour, r.subject): (r.begun, r.ok, r.cached, r.error) for r in events.outcomes(typed).collect()}
    assert sorted(got.values()) == sorted([(1, 2, 0, 1), (0, 0, 1, 0), (1, 0, 0, 0)])
    result = events.result_of(typed).first()
    assert (result.type, result.level, dict(result.data)) == ("result", "quiet", {"target": "r", "size": "14", "errors": "1", "duration": str(70 * 60 * 10**6)})
    with pytest.raises(ValueError):
        events.emitted(base(0), "file.lost")


def test_wall_and_active_time(spark):
    rows = [("s", 0, 5 << 20, 50_000_000, NOW), ("s", 1, 5 << 20, 50_000_000, NOW + timedelta(seconds=2)), ("s", 2, 0, 1, NOW + timedelta(seconds=9))]
    df = spark.createDataFrame(rows, "scope string, seq long, bytes long, dt_ns long, at timestamp")
    row = telemetry.totals(df).first()
    assert (row.bytes, row.active_ns, row.wall_us) == (10 << 20, 100_000_000, 2_000_000)
    assert telemetry.samples(df).count() == 2


def test_stream_counts(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    batch.write.parquet(str(tmp_path / "in"))
    stream = events.read(spark, str(tmp_path / "in"), batch.schema)
    q = events.counts(stream, "1 hour", "1000 days").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = {(r.start, r.event_type): r.n for r in events.counts(batch).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.sql("SELECT * FROM counted").collect()} == want


def test_publish(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    seen = []
    q = events.publish(events.read(spark, str(tmp_path / "in"), batch.schema), [lambda df, n: seen.append(df.count())], str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sum(seen) == batch.count()


def test_classifiers(spark):
    snapshots.CLASSIFIERS["size"] = lambda df: df.withColumn("_classes", F.when(F.col("size") > 1, F.array(F.lit("big"))).otherwise(F.array().cast("array<string>")))
    rows = snapshots.classify(spark.createDataFrame([("a", 1), ("b", 2)], "path string, size int"), ["size"]).collect()
    assert [[c.classes for c in r.classifications] for r in rows] == [[], [["big"]]]
