"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; grammars, alignments, extraction."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidepool.llm import components, decontaminate, host_suffixes, norm_topk, order_minhash, pu_quality, repair, sentencepieces, splitters, url_reputation, warc

LONG = " ".join(random.Random(2).choice(["the", "of", "anon", "thist"]) + str(i % 900) for i in range(30_000))
WORDS = [f"w{i}" for i in range(300)]
DOCS = [(1, None), (2, ""), (3, ""), (4, "  \n "), (5, "one"), (6, "one"), (7, LONG), (8, LONG + " end"), (9, "!!! ???"), (10, " ".join(WORDS)), (10, " ".join(WORDS)), (11, " ".join(WORDS[:150] + ["x"] + WORDS[150:])), (None, "one"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y", 0.5) for i, t in DOCS], "doc_id long, text string, lang string, score string, _hits double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_near_duplicate_cases(docs, none):
    got = {}
    for r in order_minhash.near_duplicates(docs.select("doc_id", "text", "score")).collect():
        got.setdefault(r.doc_id, []).append(r.class_id)
    assert got == {1: [1], 2: [2], 3: [2], 4: [4], 5: [5], 6: [5], 7: [7], 8: [7], 9: [9], 10: [10, 10], 11: [10], None: got[None]}
    assert sorted(got[None], key=str) == [5, None]
    assert order_minhash.near_duplicates(none).count() == 0


def test_many_near_copies(spark):
    """Large buckets: copies of one text with a word changed each, among texts that share one passage only."""
    r = random.Random(7)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:k], f"c{i}", *base[k + 1 :]])) for i in range(700) for k in [r.randrange(200)]]
    shared = [f"s{i}" for i in range(60)]
    rows += [(1000 + i, " ".join([*shared, *(f"u{i}x{j}" for j in range(80))])) for i in range(400)]
    got = {x.doc_id: x.class_id for x in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(700)} == {0} and all(got[1000 + i] == 1000 + i for i in range(400))


def test_pairs_within_a_shared_passage(spark, monkeypatch):
    """Near copies of texts that are mostly one passage: every pair is found, all pairs of large buckets compared or not."""
    r = random.Random(8)
    passage, rows = [f"s{i}" for i in range(75)], []
    for i in range(75):
        own = [f"u{i}x{j}" for j in range(25)]
        copy = [f"v{i}x{j}" if j in r.sample(range(25), 10) else w for j, w in enumerate(own)]
        rows += [(i, " ".join([*passage, *own])), (1000 + r.randrange(10**6) * 100 + i, " ".join([*passage, *copy]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    for direct in (order_minhash.DIRECT, 10**6):
        monkeypatch.setattr(order_minhash, "DIRECT", direct)
        got = {x.doc_id: x.class_id for x in order_minhash.near_duplicates(docs).collect()}
        assert all(got[d] == (d if d < 1000 else d % 100) for d, _ in rows)


def crowd_of_units():
    """Texts of a passage and five units of a code in which two agree in two at most, so that each word pair is in over 100 texts
    and no two are similar; and 20 copies in which each third of the own words is replaced, so that they meet in the passage only."""
    r, rows = random.Random(5), []
    for i in range(11**3):
        a, b, c = i % 11, i // 11 % 11, i // 121
        rows.append((i, [f"s{j}" for j in range(50)] + [w for x in range(5) for w in (*(f"u{x}y{(a + b * x + c * x * x) % 11}z{j}" for j in range(9)), f"t{x}")]))
    for i in r.sample(range(11**3), 20):
        rows.append(((1 + r.randrange(10**6)) * 10_000 + i, [f"n{i}x{j}" if j >= 50 and j % 3 == 1 else w for j, w in enumerate(rows[i][1])]))
    return [(i, " ".join(w)) for i, w in rows]


def test_pairs_of_large_buckets_without_rare_words(spark):
    rows = crowd_of_units()
    got = {x.doc_id: x.class_id for x in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 10_000 for i, _ in rows}


def test_pipeline_drops_copies_of_large_buckets(spark, tmp_path):
    rows = crowd_of_units()
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, _ in rows if i < 10_000)


@pytest.mark.parametrize("part", [1 << 20, 1 << 12])
def test_crowds_by_brute_force(spark, monkeypatch, part):
    """Every pair of a crowd that is similar passes the bounds, in one part or many; the largest class isn't compared with itself."""
    monkeypatch.setattr(order_minhash, "PART", part)
    r, texts = random.Random(6), []
    for n in (1, 3, 7, 25, 64, 120, 130):
        base = [f"b{r.randrange(n)}" for _ in range(n)]
        for _ in range(14):
            words = [w if r.random() < 0.92 else f"x{r.randrange(30)}" for w in base if r.random() < 0.97] or base
            texts.append(words + [f"y{j}" for j in range(r.randrange(1 + n // 9))])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").cache()
    crowded = docs.select(F.lit(1).alias("crowd"), F.col("doc_id").alias("node"))
    found = docs.where("doc_id >= 30 AND doc_id % 3 = 0").select(F.col("doc_id").alias("node"), F.lit(30).cast("long").alias("label"))
    signs = order_minhash.signed(docs, docs.select("doc_id"))
    pairs = {every: {(x.a, x.b) for x in order_minhash.crowd_pairs(crowded, signs, found, every).collect()} for every in (False, True)}
    label = lambda i: 30 if i >= 30 and i % 3 == 0 else i
    codes = [np.array([hash(x) for x in w]) for w in texts]
    want = {(a, b) for b in range(len(texts)) for a in range(b) if label(a) != label(b) and order_minhash.similar(codes[a], codes[b])}
    assert len(want) > 100 and want <= pairs[True] and all(label(a) != label(b) for a, b in pairs[True])
    assert pairs[False] <= pairs[True] and len(pairs[True]) < 3 * len(want)


def test_distance():
    r = random.Random(3)
    for _ in range(500):
        a = [r.randint(0, 4) for _ in range(r.randint(0, 14))]
        b = [r.randint(0, 4) for _ in range(r.randint(0, 14))] if r.random() < 0.5 else [x for x in a if r.random() < 0.9]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        most = r.randint(0, 9)
        assert order_minhash.distance(a, b, most) == min(row[-1], most + 1)


def test_order_counts():
    """Moved blocks keep the set of k-mers nearly, but not their order."""
    a = np.random.default_rng(1).integers(0, 1 << 62, 400, np.uint64)
    same = lambda x: (order_minhash.sketch(a) == order_minhash.sketch(x)).mean()
    assert same(a) == 1 and same(np.concatenate([a[200:], a[:200]])) < 0.8


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(500, 500), (601, 600), (600, 601)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 400)} | {600: 600, 601: 600}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    first, more = edges[:200], [*edges[200:], (399, 5), (700, 600), (800, 801)]
    make = lambda e: spark.createDataFrame(e, "a long, b long")
    got = {r.node: r.label for r in components.extended(components.components(make(first)), make(more)).collect()}
    assert got == {r.node: r.label for r in components.components(make(first + more)).collect()} and got[399] == 0 and got[700] == 600


def test_leak_cases(spark, docs, none):
    item = " ".join(WORDS[100:140])
    edited = " ".join(w if i % 9 else "zz" for i, w in enumerate(item.split()))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one"), (5, item), (6, edited)], "item_id long, text string")
    got = sorted((r.doc_id or 0, h.item_id) for r in decontaminate.with_hits(docs, bench).collect() for h in r.hits)
    assert got == [(0, 4), (5, 4), (6, 4), *[(10, i) for i in (1, 1, 5, 5, 6, 6)], (11, 1), (11, 5), (11, 6)]
    assert decontaminate.with_hits(none, bench).count() == 0
    assert {len(r.hits or []) for r in decontaminate.with_hits(docs, bench.limit(0)).collect()} == {0}


@pytest.mark.parametrize("every", [5, 6, 7, 8])
@pytest.mark.parametrize("exact", [False, True])
def test_regularly_edited_leaks(spark, every, exact):
    """Copies whose broken n-grams are the rarest of the item's."""
    item = [f"q{i}" for i in range(40)]
    copy = [f"z{i}" if i % every == every - 1 else w for i, w in enumerate(item)]
    rows = [(1, " ".join([*WORDS[:50], *copy, *WORDS[50:90]])), (2, " ".join(WORDS))] + [(3, " ".join(item))] * exact
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, h.item_id): h.score for r in decontaminate.with_hits(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect() for h in r.hits}
    assert set(got) == {(1, 9)} | ({(3, 9)} if exact else set()) and got[1, 9] >= decontaminate.LEAST_SCORE


def test_blocks_of_items(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(WORDS[i * 10 : i * 10 + 30])) for i in range(20)], "item_id long, text string")
    whole = sorted((r.doc_id or 0, h.item_id) for r in decontaminate.with_hits(docs, bench).collect() for h in r.hits)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
    assert sorted((r.doc_id or 0, h.item_id) for r in decontaminate.with_hits(docs, bench).collect() for h in r.hits) == whole and whole


def test_shard_cases(spark, docs, none):
    rows = splitters.shard_by_bytes(docs).collect()
    assert len(rows) == len(DOCS)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert [r["size"] for r in rows if r.doc_id == 1] == [1] and splitters.shard_by_bytes(none).count() == 0
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.col("id").cast("string")).alias("text"))
    sizes = [r[0] for r in splitters.shard_by_bytes(hot).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.05 * max(sizes)
    for i in (F.lit(7), F.lit(None), F.col("id")):  # rows that can't be told apart, and small groups at every border
        same = spark.range(6000).select(i.cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise((F.col("id") % 200).cast("string")).alias("text"))
        rows = splitters.shard_by_bytes(same)
        got = rows.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
        assert len(got) == 16 and all(r.n == r.slots == r["last"] + 1 for r in got) and max(r.bytes for r in got) < 1.05 * min(r.bytes for r in got)
        cut = rows.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).where("n > 1").collect()
        assert len(cut) <= 15


def test_ranges_are_subdivided(spark, monkeypatch):
    """One row in a thousand has most of the bytes, and a text has a third of the rows."""
    monkeypatch.setattr(splitters, "LEAST_RANGES", 16)
    monkeypatch.setattr(splitters, "SAMPLES", 1)
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 77, F.lit("x" * 100_000)).when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    shards = [r["sum(size)"] for r in splitters.shard_by_bytes(rows, 4).groupBy("shard").agg(F.sum("size")).orderBy("shard").collect()]
    assert sum(shards) == rows.select(F.sum(F.length("text") + 1)).first()[0]


def test_token_file_cases(spark, docs, none, tmp_path):
    sizes = repair.write_shards(docs, f"file://{tmp_path}/r", words())
    rows = repair.read_shards(spark, f"file://{tmp_path}/r", sizes).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((i for i, _ in DOCS), key=str)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3, 4)} == {1}
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows[:2]] == [None, None] and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    big = spark.createDataFrame([((1 << 53) + 1, "a b"), (None, "a"), (-(1 << 63), None), (None, None)], "doc_id long, text string").coalesce(1)
    sizes = repair.write_shards(big, f"file://{tmp_path}/b", words())
    got = [(r.doc_id, r.n_tokens) for r in repair.read_shards(spark, f"file://{tmp_path}/b", sizes).orderBy("start").collect()]
    assert sorted(got[:2], key=lambda x: x[1]) == [(None, 1), (None, 2)] and got[2:] == [(-(1 << 63), 1), ((1 << 53) + 1, 3)]
    empty = repair.write_shards(none, f"file://{tmp_path}/e", words())
    assert repair.read_shards(spark, f"file://{tmp_path}/e", empty).count() == 0


def test_blocks_have_no_more_tokens_than_stated(spark, tmp_path):
    """A slice of text has more tokens than a block; a longer document is a block of its own."""
    words_of = [1_500_000, 400_000, 600_000, 1_200_000, 2_400_000, 5]
    docs = spark.createDataFrame(list(enumerate(words_of)), "doc_id long, n int").selectExpr("doc_id", "repeat('a ', n) AS text").coalesce(1)
    sizes = repair.write_shards(docs, f"file://{tmp_path}/r", words())
    total = sum(words_of) + len(words_of)
    assert sizes == [(0, total)]
    raw = (tmp_path / "r" / "shard-00000000.rp").read_bytes()
    entries = repair.Shard(io.BytesIO(raw), len(raw)).entries
    starts = [tokens for _, _, tokens in entries] + [total]
    assert [documents for _, documents, _ in entries] == [0, 2, 4, 5]
    assert all(b - a <= repair.BLOCK_TOKENS for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)) if i != 2)
    one = repair.tokenizer(words()).direct(["a"])[0]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in repair.read_shards(spark, f"file://{tmp_path}/r", sizes).collect()}
    assert got == {i: (sum(words_of[:i]) + i, n + 1, zlib.crc32(np.array(one * n + [2], "<u4").tobytes())) for i, n in enumerate(words_of)}


def test_odd_space_sends_no_whole_texts(monkeypatch):
    """A text with such a character is cut into words too, and the others are as without it."""
    coder, seen = repair.WordTokenizer(words()), []
    texts = [f"Plain words, number {i}." for i in range(3000)] + ["one\x1ctwo three \x1f  four\u00a0five\x0bsix\x0cseven " + "plain words " * 2000]
    wanted = coder.direct(texts)
    direct = coder.direct
    monkeypatch.setattr(coder, "direct", lambda x: seen.extend(x) or direct(x))
    ids, bounds = coder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == wanted
    assert max(map(len, seen)) < 40 and not any(" " in x for x in seen)


def test_grammar():
    r = np.random.default_rng(0)
    ids = r.choice([1, 2, 3, 3, 7, 9], 20_000)
    bounds = np.array([0, 0, 5, 9_000, 9_001, 20_000])
    known = np.array([True, True, False, True, True])
    raw = repair.block_bytes(np.arange(5), known, ids, bounds, 50)
    entries = [(8, 0, 0), (8 + len(raw), 5, 20_000)]
    content = repair.MAGIC + raw + raw + repair.footer(entries)
    shard = repair.Shard(io.BytesIO(content), len(content))
    block = shard.block(1)
    assert shard.entries == entries and block.doc_ids.to_pylist() == [0, 1, None, 3, 4]
    assert np.array_equal(shard.document(7), ids[5:9_000]) and shard.token(9, 500) == ids[9_501]
    assert len(block.rules) > 20 and len(block.seq) < 10_000 and np.array_equal(block.ids(), ids)
    for i in range(5):
        assert np.array_equal(block.document(i), ids[bounds[i] : bounds[i + 1]])
    assert [block.token(4, j) for j in (0, 500, 10_998)] == ids[[9_001, 9_501, 19_999]].tolist()
    for bad in (b"other file", content[:-1], b""):
        with pytest.raises(ValueError):
            repair.Shard(io.BytesIO(bad), len(bad))


def test_frequent_pairs_are_not_shut_out():
    """Many rare pairs after the frequent ones."""
    ids = np.concatenate([np.tile(np.stack([np.arange(300), np.arange(300) + 300, np.arange(300) + 1000], axis=1).reshape(-1), 40), 2000 + np.random.default_rng(5).permutation(400_000)])
    ids[2:36_000:3] = 500_000 + np.arange(12_000)
    seq, start, rules = repair.compress(ids, np.array([0, len(ids)]), 1_000_000)
    assert sorted(map(tuple, rules.tolist())) == [(i, i + 300) for i in range(300)] and len(seq) == len(ids) - 12_000
    assert np.array_equal(repair.expand(seq, rules, 1_000_000)[0], ids)


def test_no_frequent_pair_is_left():
    r = np.random.default_rng(6)
    passage = r.integers(0, 900, 300)
    parts = [x for i in range(40) for x in (passage, np.minimum(r.zipf(1.2, 700), 899), np.full(r.integers(0, 50), 7))]
    ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    seq, start, rules = repair.compress(ids, bounds, 1000)
    assert np.array_equal(repair.expand(seq, rules, 1000)[0], ids)
    assert all(start[i + 1] - start[i] <= 2 for i in range(0, 120, 3))
    count = {}
    for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        free = {}
        for i, pair in enumerate(zip(seq[a : b - 1].tolist(), seq[a + 1 : b].tolist(), strict=True)):
            if i >= free.get(pair, 0):
                count[pair], free[pair] = count.get(pair, 0) + 1, i + 2
    assert max(count.values()) < repair.LEAST_COUNT


def test_word_encoding_is_exact():
    coder = repair.WordTokenizer(words())
    r = random.Random(4)
    parts = ["don't", "The", "É", "i̇", "İ", "ß", "１", "12", "\x1c", "\u00a0", "日本", "e\u0301", "'s", "''s", "<|endoftext|>", "!!", "ﬁ", "x.y", "\u2028", "ĸŉ", "Σς"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", "\n", "  "]) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    texts += ["", None, "Word, word. WORD!! -- ok"]
    for some in (texts, [t for t in texts if t is None or "\x1c" not in t]):
        ids, bounds = coder.encode(pa.array(some, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == coder.direct([t or "" for t in some])


def test_sentencepiece_cases(docs, none):
    rows = sentencepieces.encode(docs, model()).collect()
    assert len(rows) == len(DOCS) and all(r.parity for r in rows) and all(r.decoded_ok for r in rows)
    assert {None if r.ids is None else len(r.ids) for r in rows if r.doc_id in (1, 2)} == {None, 0}
    back = sentencepieces.decode(sentencepieces.encode(docs, model()), model()).select("text", "decoded").collect()
    assert all(r.text == r.decoded for r in back) and sentencepieces.encode(none, model()).count() == 0


def test_sentencepiece_odd_texts():
    codec = sentencepieces.Codec(model(), 1)
    r = random.Random(1)
    texts = ["".join(r.choice([" ", "  ", "a", "the", "\n", "é", "日", "𝄞", "▁", "\t", " of", "0", "12"]) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    ids, bounds, same = codec.encode(pa.array(texts))
    assert same.all() and [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == codec.reference.encode(texts)


def test_new_words_go_to_the_library_together(monkeypatch):
    codec, r, given = sentencepieces.Codec(model(), 1), random.Random(9), []
    words = ["", *{"".join(r.choice(["th", "e", "ing", "é", "日", "𝄞", "\n", "0", "\u200b", "\x00", "<0x41>", "<unk>"]) for _ in range(r.randint(1, 9))) for _ in range(3000)}, "x" * 3000, ""]
    want, direct = codec.direct(words), codec.direct
    monkeypatch.setattr(codec, "direct", lambda texts: given.extend(texts) or direct(texts))
    ids, size = codec.checked(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == want and not codec.differ
    assert len(given) <= len(words) // 100
    monkeypatch.setattr(codec, "begins", np.zeros_like(codec.begins))  # as if no piece were found: each word by itself
    ids, size = codec.checked(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == want and given[-len(words) :] == words


def test_words_that_differ_are_named(monkeypatch):
    codec = sentencepieces.Codec(model(), 1)
    theirs = codec.reference.encode
    monkeypatch.setattr(codec, "reference", type("Other", (), {"encode": lambda self, texts, **k: [[5] if t == "of" else x for t, x in zip(texts, theirs(texts), strict=True)]})())
    assert codec.encode(pa.array(["the end", "end of it", None, "of"]))[2].tolist() == [True, False, True, False] and codec.differ == {"of"}


def test_round_trip_by_brute_force(monkeypatch):
    """What each id shows decides where that gives the text; all else is what the library says."""
    codec, r, asked = sentencepieces.Codec(model(), 1), random.Random(3), []
    texts = ["".join(r.choice([" ", "  ", "a", "the", "\n", "é", "日", "𝄞", "▁", "\ufffd", " of", "0", "<0x41>", "<unk>"]) for _ in range(r.randint(0, 12))) for _ in range(2000)] + [None, "", " "]
    ids, bounds, _ = codec.encode(pa.array(texts))
    cut = np.minimum(bounds + 1, bounds[-1])  # ids of bytes without the first or last one of a character
    for at, some in ((bounds, texts), (bounds, [*texts[1:], "x"]), (cut, texts), (cut, codec.decode(ids, cut))):
        got = codec.restores(ids, at, some)
        assert got == [x == (t or "") for x, t in zip(codec.decode(ids, at), some, strict=True)] and (at is cut or some is not texts or sum(got) > 1000)
    plain = pa.array(["The end of it.", "日 𝄞 é", "", None])
    ids, bounds, _ = codec.encode(plain)
    monkeypatch.setattr(codec, "decode", asked.append)
    assert codec.restores(ids, bounds, plain.to_pylist()) == [True] * 4 and not asked


def test_unigram_models():
    """A unigram model, written field by field, splits by its scores and falls back to bytes."""
    import struct

    def field(n, kind, value):
        return bytes([n << 3 | kind]) + (bytes([len(value)]) + value if kind == 2 else value)

    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -2.5, 1), ("▁", -3.0, 1), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256))]
    raw = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    spec = field(3, 0, b"\x01") + b"\x98\x02\x01"
    parsed = sentencepieces.parse_model(raw + field(2, 2, spec) + field(3, 2, field(4, 0, b"\x00")))
    assert parsed["model_type"] == sentencepieces.UNIGRAM and parsed["byte_fallback"] and not parsed["strip_spaces"]
    t = sentencepieces.build(parsed)
    assert t.encode("ab a").ids == [3, 1] and t.decode(t.encode("ab é").ids) == "ab é"


def test_quality_cases(docs, none, spark):
    labels = spark.createDataFrame([(7, 1), (8, 1), (9, 0), (5, 0), (None, 1), (3, None)], "doc_id long, quality int")
    m = pu_quality.train(docs.select("doc_id", "text"), labels)
    rows = pu_quality.with_scores(docs, m).collect()
    assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 for r in rows)
    assert pu_quality.train(none, labels) is None and pu_quality.train(docs, labels.limit(0)) is None and pu_quality.train(docs, labels.where("quality = 0")) is None
    assert pu_quality.with_scores(none, m).count() == 0
    assert {r.score for r in pu_quality.with_scores(docs, None).collect()} == {0.5}


def test_risk_is_not_negative():
    r = np.random.default_rng(2)
    good, bad = r.normal(1.5, 1, (300, 4)), r.normal(-1.5, 1, (300, 4))
    net = pu_quality.fit_nnpu(good[:150], np.concatenate([good[150:], bad[:150]]), 0.5)
    assert (net.forward(bad[150:])[0] < 0).mean() > 0.9 and (net.forward(good)[0] > 0).mean() > 0.9


def test_risk_and_slopes():
    """Slopes of the risk and of the network by differences."""
    r = np.random.default_rng(4)
    op, ou, h = r.normal(0, 1, 7), r.normal(1, 1, 9), 1e-6
    value, gp, gu = pu_quality.risk(op, ou, 0.4)
    want = 0.4 * np.log1p(np.exp(-op)).mean() + max(0, np.log1p(np.exp(ou)).mean() - 0.4 * np.log1p(np.exp(op)).mean())
    assert abs(value - want) < 1e-12
    for i in range(7):
        assert abs((pu_quality.risk(op + h * (np.arange(7) == i), ou, 0.4)[0] - value) / h - gp[i]) < 1e-5
    for i in range(9):
        assert abs((pu_quality.risk(op, ou + h * (np.arange(9) == i), 0.4)[0] - value) / h - gu[i]) < 1e-5
    value, gp, gu = pu_quality.risk(op + 5, ou - 9, 0.9)  # the bracket is negative: it counts as 0 and is pushed up
    assert value == 0.9 * np.logaddexp(0, -op - 5).mean() and (gp > 0).all() and (gu < 0).all()
    x, net = r.normal(0, 1, (5, 3)), pu_quality.Net(3)
    out, hidden = net.forward(x)
    g = net.grad(x, hidden, np.ones(5))
    for i, w in enumerate(net.w):
        w.flat[0] += h
        assert abs((net.forward(x)[0].sum() - out.sum()) / h - g[i].flat[0]) < 1e-4
        w.flat[0] -= h


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9])
def test_prior_from_unlabelled(share):
    r = np.random.default_rng(5)
    good, n = r.normal(1.5, 1, (3000, 4)), int(3000 * share)
    unlabelled = np.concatenate([r.normal(1.5, 1, (n, 4)), r.normal(-1.5, 1, (3000 - n, 4))])
    assert abs(pu_quality.estimated_prior(good, unlabelled[r.permutation(3000)]) - share) < 0.05


def test_sample_of_one_hot_row(spark, monkeypatch):
    """An id, or no id, with most of the rows: what is drawn stays bounded and has its share of them."""
    monkeypatch.setattr(pu_quality, "UNLABELLED", 500)
    monkeypatch.setattr(pu_quality, "POSITIVES", 100)
    seen = []
    monkeypatch.setattr(pu_quality, "fit_nnpu", lambda p, u, *a: (seen.append((len(p), len(u))), pu_quality.Net(p.shape[1]))[1])
    hot = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("text"))
    labels = spark.createDataFrame([(1, 1), (4, 1), (7, 0)], "doc_id long, quality int")
    assert pu_quality.train(hot, labels) is not None
    assert 100 <= seen[-1][0] <= 300 and 400 <= seen[-1][1] <= 600


def test_url_cases(spark):
    urls = {None: ("", ""), "x.com/a": ("", ""), "http://A.Com": ("a.com", ""), "s://h.org?q=://z/y": ("h.org", ""), "http://É.NET/de/8#x": ("É.net", "/de/8"), "://h/p?": ("h", "/p"), "http://m.example.com/en/71": ("m.example.com", "/en/71")}
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages = df.select("page_id", url_reputation.host_of(F.col("url")).alias("host"), url_reputation.path_of(F.col("url")).alias("path"))
    assert [(r.host, r.path) for r in pages.orderBy("page_id").collect()] == list(urls.values())
    outcomes = pages.select("host", F.lit(None).cast("int").alias("bad"))
    got = {r.page_id: (r.rule, r.verdict) for r in url_reputation.judge(pages, url_reputation.host_reputation(outcomes), url_reputation.RULES).collect()}
    assert got[6] == ("example.com/en/7", "allow") and got[4] == ("net/de/", "block") and got[0] == (None, "allow")
    assert url_reputation.host_reputation(outcomes.limit(0)).count() == 0


def test_reputation_shrinks(spark):
    rows = [("big.bad.com", 1)] * 90 + [("big.bad.com", 0)] * 10 + [("new.bad.com", 0)] + [("www.good.com", 0)] * 200 + [("one.org", 1)] + [("x.co.uk", 0)] * 50
    got = {r.host: r for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["big.bad.com"].low > 0.7 and got["one.org"].low < 0.5 < 1 > got["one.org"].rate and got["www.good.com"].high < 0.05
    assert got["new.bad.com"].rate > got["x.co.uk"].rate and got["x.co.uk"].domain == "x.co.uk"
    assert url_reputation.host_reputation(spark.createDataFrame(rows, "host string, bad int"), suffixes=["bad.com"]).where("host = 'new.bad.com'").first().domain == "new.bad.com"


def test_bad_hosts_are_blocked(spark, tmp_path):
    """The query on tables with one bad host, a good one, one with few labels, pages of no document, and SQL that says the same."""
    import duckdb

    pages, labels, i = [], [], 0
    for host, n, bad in (("bad.example.org", 60, 50), ("good.example.org", 200, 2), ("few.example.info", 1, 1), ("www.plain.info", 90, 9)):
        for k in range(n):
            pages.append((i, f"http://{host}/fr/{i}", ""))
            labels.append((i, 0 if k < bad else 1, 0))
            i += 1
    pages += [(i + k, u, None) for k, u in enumerate(["http://bad.example.org/about", "http://new.example.org/fr/999999", None, "x", "http://good.example.org/es/1", "http://bad.example.org/es/1"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    rows = url_reputation.op1_url_reputation(spark, str(tmp_path)).collect()
    verdict = {(r.host, r.rule): r.verdict for r in rows}
    assert verdict == {("bad.example.org", None): "block", ("good.example.org", None): "allow", ("few.example.info", None): "allow", ("www.plain.info", None): "allow", ("new.example.org", None): verdict["new.example.org", None], ("", None): "allow", ("good.example.org", "org/es/"): "block", ("bad.example.org", "org/es/"): "block"}
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rel = con.sql(url_reputation.OP1_SQL)
    assert sorted(map(repr, rel.fetchall())) == sorted(repr(tuple(r[c] for c in rel.columns)) for r in rows)


def test_topk_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [0.0, 0.0]), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, None), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [1.0]), (6, [3.0, 1.0]), (6, [3.0, 1.0]), (7, []), (20, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = sorted(map(tuple, norm_topk.top_products(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 6, 5), (0, 2, 6, 5), (0, 3, 20, 0), (0, 4, 20, 0), (20, 1, 0, 0), (20, 2, 6, 0), (20, 3, 6, 0)]
    assert norm_topk.top_products(df.limit(0), F.lit(True)).count() == 0
    mixed = spark.createDataFrame([(-1, [5.0]), (0, [1.0, 2.0]), (20, [1.0, 1.0]), (21, [4.0, 0.0]), (40, [2.0]), (41, [9.0])], "vec_id long, v array<double>")
    got = sorted(map(tuple, norm_topk.top_products(mixed, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 21, 4), (0, 2, 20, 3), (20, 1, 21, 4), (20, 2, 0, 3), (40, 1, 41, 18), (40, 2, -1, 10)]


def test_topk_of_large_components(spark):
    """Products that a double doesn't have, some of which differ in the last bit only."""
    a = float(1 << 31)
    rows = [(0, [a, 1.0]), (1, [a, 1.0]), (2, [a, 2.0]), (3, [a - 1, 3.0]), (20, [1.0, 1.0]), (4, [-a, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = sorted(map(tuple, norm_topk.top_products(df, F.col("vec_id") % 20 == 0, 3).collect()))
    n = 1 << 31
    assert got == [(0, 1, 2, n * n + 2), (0, 2, 1, n * n + 1), (0, 3, 3, n * (n - 1) + 3), (20, 1, 2, n + 2), (20, 2, 3, n + 2), (20, 3, 0, n + 1)]
    with pytest.raises(Exception, match="64 bits"):
        norm_topk.top_products(spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, v array<double>"), F.col("vec_id") == 0).collect()


def test_extraction_cases(spark):
    nav = "<nav>menu words</nav><div class='ad'>buy</div>"
    host = "all rights of this site are reserved by its owners forever"
    pages = [
        (1, "http://h/1", None), (2, None, ""), (3, "http://h/3", f"{nav}<article><h1>T &amp; U</h1><p><b>x<br>y<p>z &lt;<!-- no --><script>bad</script></article><footer>f</footer>"), (4, "http://h/4", f"<p>{host}</p><p>only here</p>"), (5, "http://h/5", f"<div><p>{host}</p>another one</div>"),
        (6, "http://other/5", f"<p>{host}</p>"), (3, "http://h/3", "<main>again<section id=comments>c</section><aside>a</aside> and</main>"), (7, "http://h/7", "<article>cut &am"),
    ]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, text string, host int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in host_suffixes.extract(df).collect())
    want = [(1, ""), (2, ""), (3, "T & U\nx y\nz <"), (3, "again\nand"), (4, "only here"), (5, "another one"), (6, host), (7, "cut &am")]
    assert got == [(i, t, len(t)) for i, t in want] and host_suffixes.extract(df.limit(0)).count() == 0


def test_menus_inside_articles(spark):
    """Menus with no telling name, inside of the article: links that pages of a host share go, links of one page and running
    text that pages share stay."""
    menu = "<div class=x1><ul>" + "".join(f"<li><a href='/{w}'>section {w} of site</a></li>" for w in ("alpha", "beta", "gamma", "delta")) + "</ul></div>"
    menu = menu.replace("</li><li>", " ").replace("<ul><li>", "").replace("</li></ul>", "")
    shared = "a passage of more than eight words that two articles of this host have in common"
    html = lambda i, more="": f"<body><article><h1>Title {i}</h1>{menu}<p>{shared}</p><p>own text {i}</p>{more}</article></body>"
    own = "<p>" + "".join(f"<a href=#>reference number {i} of this page alone</a> " for i in range(3)) + "</p>"
    rows = [(1, "http://h/1", html(1)), (2, "http://h/2", html(2, own)), (3, "http://other/3", html(3))]
    got = {r.page_id: r.text for r in host_suffixes.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    links = "section alpha of site section beta of site section gamma of site section delta of site"
    assert got[1] == f"Title 1\n{shared}\nown text 1"
    assert got[2] == f"Title 2\n{shared}\nown text 2\n" + " ".join(f"reference number {i} of this page alone" for i in range(3))
    assert got[3] == f"Title 3\n{links}\n{shared}\nown text 3"


def test_repeats_decide_beside_articles(spark):
    """Beside an article: what pages of a host share goes, what one page alone has stays, unless it is mostly links."""
    shared = "we are a small site that writes of many things each day"
    html = lambda i: f"<body><div>{shared}</div><div>{i} is where it leads</div><article><p>{shared}</p><p>text {i}</p></article><div><a href=#>page {i + 1}</a></div></body>"
    rows = [(i, f"http://{'h' if i < 3 else 'other'}/{i}", html(i)) for i in (1, 2, 3)]
    got = {r.page_id: r.text for r in host_suffixes.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = {i: f"{i} is where it leads\n{shared}\ntext {i}" for i in (1, 2, 3)}
    assert got == {1: own[1], 2: own[2], 3: f"{shared}\n{own[3]}"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_extraction_by_brute_force(spark, seed):
    """Pages of few words on few hosts, many without an article, against all windows of all pages of a host."""
    r, n = random.Random(seed), 3
    some = lambda a, b: " ".join(r.choice("abcdefg") for _ in range(r.randint(a, b)))
    pages = []
    for i in range(60):
        parts = [r.choice([f"<p>{some(0, 6)}</p>", f"<div>{some(1, 9)}<br>{some(0, 3)}</div>", f"<nav>{some(1, 5)}</nav>", f"<p><a href=x>{some(2, 6)}</a></p>"]) for _ in range(r.randint(0, 5))]
        body = "".join(parts)
        pages.append((i % 55, f"http://{r.choice('xyz')}/{i % 50}", r.choice([f"<body>{body}</body>", f"<main>{body}</main>{some(2, 6)}"])))
    pages += pages[:4]
    blocks = {p: host_suffixes.blocks_of(p[2]) for p in pages}
    seen = {}
    for p, x in blocks.items():
        w = host_suffixes.stream(x)
        for i in range(len(w) - n + 1):
            seen.setdefault((p[1].split("/")[2], *w[i : i + n]), set()).add(p)
    want = []
    for p in pages:
        w = host_suffixes.stream(blocks[p])
        starts = {i for i in range(len(w) - n + 1) if len(seen[p[1].split("/")[2], *w[i : i + n]]) > 1}
        want.append((p[0], p[1], host_suffixes.main_text(blocks[p], starts, n)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    got = [(x.page_id, x.url, x.text) for x in host_suffixes.extract(df, n).collect()]
    assert sorted(got) == sorted(want)


def test_prefix_ranks():
    r = np.random.default_rng(2)
    for depth in (1, 2, 3, 5, 8):
        codes = r.integers(0, 3, 200)
        rank = host_suffixes.prefix_ranks(codes, depth)
        prefix = [tuple(codes[i : i + depth].tolist()) for i in range(200)]
        assert rank.tolist() == [sorted(set(prefix)).index(x) for x in prefix]


def test_long_pages(spark):
    html = "<article>" + "".join(f"<p>{w} &amp; {w}</p>" for w in LONG.split()) + "</article>"
    rows = host_suffixes.extract(spark.createDataFrame([(1, None, html)], "page_id long, url string, html string")).collect()
    assert rows[0].text == "\n".join(f"{w} & {w}" for w in LONG.split())


def test_warc_reads_split_files(spark, tmp_path):
    warc.register(spark)
    r = random.Random(9)
    rows = [(i, f"http://h/{i}", "".join(r.choice("abcdefgh\r\n") for _ in range(r.choice([0, 50, 4000, 200_000])))) for i in range(60)]
    warc.records_of(spark.createDataFrame(rows, "page_id long, url string, html string")).coalesce(1).write.format("warc").mode("append").save(str(tmp_path))
    back = spark.read.format("warc").option("splitbytes", 70_000).load(str(tmp_path))
    got = {x.page_id: x for x in back.where("record_type <> 'warcinfo'").collect()}
    for i, url, html in rows:
        want = html if got[i].record_type == "response" else ""
        assert bytes(got[i].payload or b"").decode() == want and got[i].payload_bytes == len(html) and got[i].target_uri == url


def test_pipeline_cases(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(WORDS[100:140]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == [(False, i) for i in (1, 2, 4, 5, 7, 9)] + [(True, 0), (True, 0)]


def test_one_id_with_different_texts(spark, tmp_path):
    """The text with the smallest digest stays, whatever the order of rows; clashing columns come through each stage."""
    a, b = " ".join(WORDS[:60]), " ".join(WORDS[200:260])
    rows = [(1, a, "en", 7), (1, b, "en", 8), (1, a, "en", 7), (2, " ".join(WORDS[100:160]), "en", 9), (3, b + " more", "en", 9)]
    got = set()
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, _score long").withColumn("_hits", F.lit(1))
        classes = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
        assert classes == {1: 1, 2: 2, 3: 1}
        kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        got.add(tuple(sorted((r.doc_id, r.text) for r in kept.collect())))
    assert len(got) == 1 and {i for i, _ in got.pop()} == {1, 2}
    spark.createDataFrame([(1, a)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).columns == docs.columns
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and sorted(r._score for r in clean.collect()) == [8, 9, 9]


@pytest.mark.parametrize("edits", [0.05, 0.1, 0.15, 0.2])
def test_recall_of_sketches(edits):
    """Nine of ten pairs that are similar enough share a sketch, at any rate of edits that similarity allows."""
    r = np.random.default_rng(9)
    met = 0
    for _ in range(200):
        a = r.integers(0, 1 << 62, 250, np.uint64)
        b = a.copy()
        b[r.choice(250, int(250 * edits), replace=False)] = r.integers(0, 1 << 62, int(250 * edits), np.uint64)
        assert order_minhash.similar(a, b)
        met += (order_minhash.sketch(a) == order_minhash.sketch(b)).any()
    assert met >= 180


def test_topk_in_many_blocks(spark, monkeypatch):
    from tidepool.llm import norm_topk

    monkeypatch.setattr(norm_topk, "QUERIES", 7)
    v = np.random.default_rng(3).integers(-9, 10, (120, 6))
    df = spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, v array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in norm_topk.top_products(df, F.col("vec_id") % 4 == 0, 3).collect())
    want = [(q, n, i, int(v[i] @ v[q])) for q in range(0, 120, 4) for n, i in enumerate(sorted((i for i in range(120) if i != q), key=lambda i: (-int(v[i] @ v[q]), i))[:3], 1)]
    assert got == want
    assert norm_topk.top_products(df, F.lit(False), 3).count() == 0
