"""The ten queries and the pipeline on whole small tables, against SQL or brute force."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tidepool.llm import common, decontaminate, order_minhash, pu_quality, queries

SF = "/root/testdata/sf0.001"
TABLES = "documents pages labels benchmark embeddings".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(rel, columns):
    return sorted((tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_duckdb(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rel = duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    assert {c: TYPES[k] for c, k in df.dtypes} == dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == rows_of(rel, columns)


def test_verdicts_of_the_contract(spark, duck, tmp_path):
    """Rules as the contract of op1 lists them: on a whole table, and on a page or two of each rule."""
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    rules = {rule: verdict for verdict, rule in (x.split() for x in contract.split(", "))}

    def judged(url):
        host, _, path = url.partition("://")[2].partition("/")
        fits = [r for r in rules if f".{host}".endswith(f".{r.partition('/')[0]}") and f"/{path}".startswith(f"/{r.partition('/')[2]}")]
        return max(fits, key=len, default=None)

    urls = dict(duck.sql("SELECT page_id, url FROM pages").fetchall())
    some = ["a.com/en/1", "a.example.com/en/71", "example.com/en/81", "a.net/de/8", "example.net/de/7", "a.example.net/de/81", "example.net/de/8", "xexample.net/de/8", "a.org/es/", "a.org/de/"]
    made = {i: f"http://{u}" for i, u in enumerate(some)}
    spark.createDataFrame(list(made.items()), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for at, of in ((SF, urls), (str(tmp_path), made)):
        rows = queries.QUERIES["op1_url_reputation"](spark, at).collect()
        want = {i: judged(u) for i, u in of.items()}
        assert {r.page_id: r.rule for r in rows} == want
        assert {r.page_id: r.verdict for r in rows if r.rule} == {i: rules[x] for i, x in want.items() if x}


@pytest.fixture(scope="module")
def docs(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


def test_shards(spark, docs):
    """Near equal bytes, gapless slots, and no group of equal texts in two shards unless it is large."""
    rows = queries.QUERIES["op4_sampled_splitters"](spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    held, at = collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        held[r.shard].append(r)
        at[docs[r.doc_id]].add(r.shard)
    total = sum(r.size for r in rows)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in held.values())
    most = max(r.size for r in rows)
    assert all(abs(sum(r.size for r in held[s]) - total / 16) <= most + 0.02 * total / 16 for s in range(16))


def test_token_ids(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in queries.QUERIES["op7_repair_ids"](spark, SF).collect()}
    at = 0
    for i in sorted(docs):
        ids = np.array([*t.encode(docs[i], add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_sentencepiece(spark, docs):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = queries.QUERIES["op10_sentencepiece"](spark, SF).collect()
    assert len(rows) == len(docs) and all(r.parity and r.decoded_ok for r in rows)
    for r in rows:
        ids = np.array(sp.encode(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_pages(spark, duck, docs):
    import re

    for r in queries.QUERIES["op5_host_suffixes"](spark, SF).collect():
        text = docs[int(re.search(r"/\w\w/(\d+)", r.url)[1])]
        want = [" ".join(x.split()) for x in text.split("\n") if x.split()]
        assert r.text.split("\n")[1:] == want and r.n_chars == len(r.text)


def leaks(docs, items):
    out = {}
    for i, text in docs.items():
        for j, item in items.items():
            a, b = common.words_of(item or ""), common.words_of(text or "")
            known = {w: k for k, w in enumerate(dict.fromkeys(a))}
            score, _, _ = decontaminate.align(np.array([known[w] for w in a]), np.array([known.get(w, -1) for w in b], np.int64))
            if score / (2 * len(a)) >= decontaminate.LEAST_SCORE:
                out[i, j] = round(score / (2 * len(a)), 6)
    return out


def test_leaks(spark, duck, docs):
    items = dict(duck.sql("SELECT item_id, text FROM benchmark").fetchall())
    got = {(r.doc_id, r.item_id): r.score for r in queries.QUERIES["op2_decontaminate"](spark, SF).collect()}
    assert got == leaks(docs, items)


def classes(docs, least=order_minhash.SIMILAR):
    """Components of all pairs with equal texts or similar words."""
    words = {i: np.array([hash(w) for w in common.words_of(t or "")]) for i, t in docs.items()}
    label = {i: i for i in docs}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n, m = len(words[a]), len(words[b])
            if docs[a] == docs[b] or min(n, m) >= least * max(n, m) > 0 and order_minhash.similar(words[a], words[b]):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {i: top(i) for i in docs}


def test_near_duplicates(spark, docs):
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op8_order_minhash"](spark, SF).collect()}
    assert got == classes(docs)


def test_quality(spark, duck):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.QUERIES["op9_pu_quality"](spark, d).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{d}/labels.parquet'").fetchall()
    held = [(rows[i].predicted, q) for i, q in labels if rows[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    assert len(held) > 60 and sum(p == q for p, q in held) / len(held) >= 0.95


def test_held_out_labels_are_not_read(spark, duck):
    labels, docs = common.table(spark, SF, "labels"), common.table(spark, SF, "documents")
    from pyspark.sql import functions as F

    changed = labels.withColumn("quality", F.when(pu_quality.remainder(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = pu_quality.train(docs, labels), pu_quality.train(docs, changed)
    assert all(np.array_equal(x, y) for x, y in zip(a["w"], b["w"], strict=True)) and a["prior"] == b["prior"]
    bad = labels.withColumn("quality", F.when(F.col("quality") == 1, 1))  # negative labels aren't read either
    assert np.array_equal(pu_quality.train(docs, bad)["w"][0], a["w"][0])


def test_pipeline(spark, duck, docs):
    items = dict(duck.sql("SELECT item_id, text FROM benchmark").fetchall())
    model = pu_quality.train(common.table(spark, SF, "documents"), common.table(spark, SF, "labels"))
    import pyarrow as pa

    ids = sorted(docs)
    score = pu_quality.score_texts(model, pa.array([docs[i] for i in ids]))
    kept = {i: docs[i] for i, s in zip(ids, score, strict=True) if s >= 0.7}
    of = classes(kept)
    kept = {i: t for i, t in kept.items() if of[i] == i}
    leaked = {i for i, _ in leaks(kept, items)}
    got = corpus_pipeline.run(spark, SF)
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(set(kept) - leaked)
    assert all(r.parity and r.decoded_ok and len(r.ids) == r.n_tokens for r in rows)
    first = corpus_pipeline.STAGES[0][1](spark, common.table(spark, SF, "documents"), SF)
    assert first.columns == common.table(spark, SF, "documents").columns


def test_topk_brute_force_ties(spark):
    """One vector that a third of all rows share."""
    from pyspark.sql import functions as F

    from tidepool.llm import norm_topk

    r = np.random.default_rng(5)
    v = r.integers(-9, 10, (600, 8)) * r.integers(1, 6, (600, 1))
    v[::3] = v[0]
    df = spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, v array<double>")
    got = collections.defaultdict(list)
    for row in norm_topk.top_products(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    for q in range(0, 600, 20):
        s = v @ v[q]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:20]
        assert got[q] == [(i, int(s[i])) for i in want]


def test_digest_of_revisits(spark, tmp_path):
    from tidepool.llm import warc

    warc.register(spark)
    big, small = "x" * 100, "y" * 99
    pages = spark.createDataFrame([(1, "u1", big), (2, "u2", big), (3, None, small), (4, "u4", small), (5, "u5", None), (6, "u6", "é" * 70), (7, "u7", "é" * 70), (2, "u2", big)], "page_id long, url string, html string")
    warc.records_of(pages).write.format("warc").mode("append").save(str(tmp_path / "w"))
    back = spark.read.format("warc").load(str(tmp_path / "w"))
    rows = {(r.page_id, r.record_type): r for r in back.where("record_type IN ('response', 'revisit')").collect()}
    assert sorted(rows) == [(1, "response"), (2, "revisit"), (3, "response"), (4, "response"), (5, "response"), (6, "response"), (7, "revisit")]
    assert rows[2, "revisit"].refers_to == rows[1, "response"].record_id and bytes(rows[1, "response"].payload) == big.encode() and rows[2, "revisit"].payload in (None, b"")
    assert rows[6, "response"].payload_digest == "sha256:" + hashlib.sha256(("é" * 70).encode()).hexdigest()
    assert back.where("target_uri = 'u4' AND record_type = 'response'").count() == 1 and back.where("target_uri LIKE 'u%'").count() == 7
    got = sorted(map(tuple, warc.read_back(spark, str(tmp_path / "w")).select("page_id", "payload_bytes", "record_type", "refers_to").collect()))
    assert got == [(1, 100, "response", None), (2, 100, "revisit", 1), (2, 100, "revisit", 1), (3, 99, "response", None), (4, 99, "response", None), (5, 0, "response", None), (6, 140, "response", None), (7, 140, "revisit", 6)]
    warc.records_of(pages.limit(0)).write.format("warc").mode("append").save(str(tmp_path / "none"))
    assert warc.read_back(spark, str(tmp_path / "none")).count() == 0


def test_archives_are_plain_warc(spark, tmp_path):
    """Read by nothing but gzip and the format's rules: version, mandatory headers, lengths, an HTTP message in each response."""
    import glob
    import gzip

    from tidepool.llm import warc

    warc.register(spark)
    pages = spark.createDataFrame([(1, "http://h/1", "a" * 200), (2, "http://h/2", "a" * 200), (None, None, "b")], "page_id long, url string, html string")
    warc.records_of(pages, date="2024-01-02T03:04:05Z").write.format("warc").mode("append").save(str(tmp_path / "w"))
    seen, ids = [], set()
    for path in glob.glob(f"{tmp_path}/w/*.warc.gz"):
        with gzip.open(path) as f:
            raw = f.read()
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            h = dict(x.split(": ", 1) for x in lines)
            n = int(h["Content-Length"])
            block, end, raw = rest[:n], rest[n : n + 4], rest[n + 4 :]
            assert version == "WARC/1.1" and end == b"\r\n\r\n" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Type"} <= set(h)
            ids.add(h["WARC-Record-ID"])
            if h["WARC-Type"] == "response":
                message, _, body = block.partition(b"\r\n\r\n")
                assert message.startswith(b"HTTP/1.1 200 OK") and h["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest() and h["WARC-Date"] == "2024-01-02T03:04:05Z"
            seen.append(h["WARC-Type"])
    assert sorted(x for x in seen if x != "warcinfo") == ["response", "response", "revisit"] and len(ids) == len(seen)


def test_damaged_payloads_show(spark, tmp_path):
    """Lengths and digests come from the payloads, not from the headers."""
    from tidepool.llm import warc

    warc.register(spark)
    pages = spark.createDataFrame([(1, "u", "a" * 200), (2, "u", "a" * 200)], "page_id long, url string, html string")
    records = warc.records_of(pages)
    from pyspark.sql import functions as F

    records.withColumn("payload", F.when(F.col("payload").isNotNull(), F.lit(b"cut"))).write.format("warc").mode("append").save(str(tmp_path / "w"))
    assert {(r.payload_bytes, r.payload_digest) for r in warc.read_back(spark, str(tmp_path / "w")).collect()} == {(3, hashlib.sha256(b"cut").hexdigest())}
