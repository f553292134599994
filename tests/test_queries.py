"""Every query that has SQL gives what DuckDB gives, types included; the others are held to brute force."""

import duckdb
import pytest

from tidepool.plans import registry

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_duckdb(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rel = duck.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    assert {c: TYPES[k] for c, k in df.dtypes} == dict(zip(rel.columns, map(str, rel.types), strict=True))
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall()), key=repr)
    assert ours == theirs


def groups(rows, key):
    out = {}
    for r in rows:
        out.setdefault(key(r), []).append(r)
    return out


def test_read_plan_brute_force(spark):
    from tidepool.operators import content

    rows = [r.asDict() for r in content.pack_offsets(registry.blobs(spark, SF)).where("seq % 3 <> 0").collect()]
    want = []
    for p, g in groups(rows, lambda r: r["packfile"]).items():
        cur = None
        for r in sorted(g, key=lambda r: (r["offset"], r["length"])):
            if cur and r["offset"] + r["length"] - cur[1] <= 200:
                cur[2], cur[3] = r["offset"] + r["length"] - cur[1], cur[3] + 1
            else:
                cur = [p, r["offset"], r["length"], 1]
                want.append(cur)
    assert sorted(map(tuple, registry.queries()["read_plan"](spark, SF).collect())) == sorted(map(tuple, want))


def test_pack_bins_brute_force(spark):
    got = groups([r.asDict() for r in registry.queries()["pack_bins"](spark, SF).collect()], lambda r: r["channel"])
    for g in got.values():
        n = size = 0
        for r in sorted(g, key=lambda r: (r["seq"], r["bin"])):
            assert r["bin"] == n
            size += r["length"]
            if size > 1000:
                n, size = n + 1, 0


def test_samples_brute_force(spark):
    spans = groups([r.asDict() for r in registry.spans(spark, SF).collect()], lambda r: r["scope"])
    want = []
    for scope, g in spans.items():
        n = size = time = 0
        for r in sorted(g, key=lambda r: r["seq"]):
            if not r["bytes"] or r["dt_ns"] <= 0:
                continue
            size, time = size + r["bytes"], time + r["dt_ns"]
            if time >= 50_000_000:
                want.append((scope, n, size / (time / 1e9)))
                n, size, time = n + 1, 0, 0
        if time:
            want.append((scope, n, size / (time / 1e9)))
    assert sorted(map(tuple, registry.queries()["io_sample_buckets"](spark, SF).collect())) == sorted(want)


def test_token_bucket_brute_force(spark):
    got = groups([r.asDict() for r in registry.queries()["token_bucket_delay"](spark, SF).collect()], lambda r: r["scope"])
    for g in got.values():
        tokens, last = 100.0, None
        for r in sorted(g, key=lambda r: r["seq"]):
            tokens = min(100.0, tokens + (0 if last is None else (r["at_s"] - last) * 0.5)) - r["n"]
            last = r["at_s"]
            assert r["wait_s"] == max(0.0, -tokens / 0.5)
    assert max(r["wait_s"] for g in got.values() for r in g) > 0
