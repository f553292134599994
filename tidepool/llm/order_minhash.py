"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Equal texts are one node. A node's k-mers are its runs of five words, each labelled with how often it occurred before. Of
each of SKETCHES random orders, the two smallest k-mers are kept in the order in which the text has them; nodes that share
such a pair are candidates. Few words are moved or changed between them if the pair and its order survive, which makes
the sketch follow edit similarity. A candidate is verified by the edit distance of the two word sequences in a band that
is as wide as a similarity of 0.8 allows.

First each node meets the smallest node of each of its buckets, which links most near-duplicates. Then all pairs of a bucket
whose nodes are still in different classes are compared, if they are DIRECT or fewer for each node. Larger buckets, which a
passage that thousands of texts share makes, are put together to crowds, and all pairs of a crowd whose nodes are in different
classes go through bounds that no similar pair fails: the numbers of words, and the bits in which parity signatures of the
two bags of words differ. What passes is verified, each node's closest first, and then, with the classes that these make, all.
So every pair that meets in a bucket is in one class, compared, or ruled out by a bound.

Words are lower case; punctuation doesn't count. Texts under five words have one k-mer, texts without words match equal
texts only, and a null text is a class of its own. Rows that share an id are one document, which is similar to what any of its texts is similar to. Rows with a null id get the
class of an equal text, else null. Texts may be of any length: sketches are made some orders at a time, and the band is
widened step by step, so near copies cost their length times their distance. An empty table gives no rows; only doc_id and
text are looked at, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import common
from tidepool.llm.components import components, extended

K, SKETCHES, SIMILAR = 5, 80, 0.8
#: Pairs for each node of a bucket up to which all of them are compared.
DIRECT = 16
#: Logarithms of the least and the largest number of bits of a parity signature.
NARROW, WIDE = 6, 16
#: Bytes of signatures in a part of a crowd; each two parts are compared in one group.
PART = 1 << 20
#: Words whose hashes a worker remembers.
MOST_WORDS = 200_000
#: Ids (16 bytes each) that are sent to all executors at most; more are joined by a shuffle.
MOST_SENT = 2_000_000

_R = np.random.default_rng(20190701)
FLIP, FACTOR = _R.integers(0, 1 << 63, (2, SKETCHES), np.uint64)
FLIP32, FACTOR32 = FLIP.astype(np.uint32), FACTOR.astype(np.uint32) | np.uint32(1)
STEP = _R.integers(0, 1 << 63, K, np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; begins anew when it is large."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= MOST_WORDS:
            self.clear()
        value = self[word] = xxh64_intdigest(word.encode("utf-8", "replace"))
        return value


def word_hashes() -> WordHashes:
    return common.worker_slot("word hashes", WordHashes)


def occurrences(code: np.ndarray) -> np.ndarray:
    """How often each code came before."""
    seen = np.zeros(len(code), np.uint64)
    ordered = np.sort(code)
    if not (ordered[1:] == ordered[:-1]).any():
        return seen
    order = np.argsort(code, kind="stable")
    run = np.ones(len(code), bool)
    run[1:] = code[order[1:]] != code[order[:-1]]
    start = np.maximum.accumulate(np.where(run, np.arange(len(code)), 0))
    seen[order] = (np.arange(len(code)) - start).astype(np.uint64)
    return seen


def kmers(words: np.ndarray) -> np.ndarray:
    """Occurrence-labelled k-mers in text order."""
    n = max(1, len(words) - K + 1)
    code = np.zeros(n, np.uint64)
    for j in range(min(K, len(words))):
        code += mix(words[j : j + n] + np.uint64(j)) * STEP[j]
    code = mix(code)
    return mix(code + occurrences(code) * np.uint64(0xD6E8FEB86659FD93))


def sketch(words: np.ndarray) -> np.ndarray:
    """SKETCHES keys; none for a text without words."""
    if not len(words):
        return np.zeros(0, np.int64)
    code = kmers(words)
    if len(code) == 1:
        return mix(code[0] + FLIP).astype(np.int64)
    out, high = np.empty(SKETCHES, np.uint64), (code >> np.uint64(32)).astype(np.uint32)
    step = max(1, 1_000_000 // len(code))
    for a in range(0, SKETCHES, step):
        x = (high[None, :] ^ FLIP32[a : a + step, None]) * FACTOR32[a : a + step, None]
        one = x.argmin(1)
        x[np.arange(len(x)), one] = np.iinfo(np.uint32).max
        two = x.argmin(1)
        first, last = np.minimum(one, two), np.maximum(one, two)  # text order
        out[a : a + step] = mix(mix(code[first] + FLIP[a : a + step]) * np.uint64(3) + code[last])
    return out.astype(np.int64)


def distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences, or most + 1 if it is larger; bit-parallel, on a diagonal band of 2 most + 1 places."""
    if len(a) < len(b):
        a, b = b, a
    first = 0
    while first < len(b) and a[first] == b[first]:
        first += 1
    last = 0
    while last < len(b) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if len(a) - len(b) > most:
        return most + 1
    if not b:
        return len(a)
    most_here = min(most, len(a))
    if not most_here:
        return most + 1
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    width = 2 * most_here + 1
    full = (1 << width) - 1
    up = full & ~((1 << (width - most_here - 1)) - 1)
    down, score = 0, most_here
    diagonal, across, start = 1 << (width - 1), 1 << (width - 2), most_here + 1 - width
    limit = most_here + len(b) - (len(a) - most_here)
    for j, w in enumerate(b):
        m = at.get(w, 0)
        m = (m >> start if start >= 0 else m << -start) & full
        d = ((((m & up) + up) ^ up) | m | down) & full
        hp = (down | ~(d | up)) & full
        hn = d & up
        if j < len(a) - most_here:
            score += not d & diagonal
        else:
            score += bool(hp & across) - bool(hn & across)
            across >>= 1
        if score > limit:
            return most + 1
        up = (hn | ~((d >> 1) | hp)) & full
        down = (d >> 1) & hp
        start += 1
    return score if score <= most_here else most + 1


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    n = max(len(a), len(b))
    most = int(n * (1 - least) + 1e-9)
    a, b = a.tolist(), b.tolist()
    band = min(most, 256)
    while (far := distance(a, b, band)) > band and band < most:
        band = min(most, 8 * band)
    return far <= band


def bag(words: np.ndarray) -> np.ndarray:
    """Words and how often each came before, as numbers of which none occurs twice."""
    w = words.astype(np.uint64)
    return mix(w + occurrences(w) * STEP[0])


def may_be_similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether two bags have as many words in common as similar texts do."""
    return len(np.intersect1d(a, b, assume_unique=True)) >= least * max(len(a), len(b)) - 1e-9


def width(level: int) -> int:
    """Logarithm of the bits of signatures of texts of 2^level to 2^(level + 1) words: 8 or more for each word, up to a limit."""
    return min(WIDE, max(NARROW, level + 4))


def parity(codes: np.ndarray, bits: int) -> bytes:
    """2^bits bits: whether an odd number of codes falls on each. Two signatures differ in no more bits than the bags do in codes."""
    return np.packbits(np.bincount((codes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).tobytes()


def signatures(words: np.ndarray) -> list[tuple[int, bool, bytes]]:
    """(level, guest, signature): of the text's own level, and as a guest of the next where similar texts may be."""
    level, codes = len(words).bit_length() - 1, bag(words)
    out = [(level, False, parity(codes, width(level)))]
    if len(words) >= SIMILAR * (2 << level) - 1e-9:
        out.append((level + 1, True, parity(codes, width(level + 1))))
    return out


class Crowd:
    """Entries of one level, in order of their numbers of words, with signatures as columns: whole and folded to an eighth."""

    def __init__(self, node, n_words, label, guest, bits):
        order = np.argsort(n_words, kind="stable")
        self.node, self.n, self.label, self.guest = node[order], n_words[order].astype(np.int64), label[order], guest[order]
        self.whole = bits[order]
        coarse = self.whole
        while coarse.shape[1] > max(4, self.whole.shape[1] // 8):
            half = coarse.shape[1] // 2
            coarse = coarse[:, :half] ^ coarse[:, half:]
        self.coarse = np.ascontiguousarray(coarse.T)

    def of(self, some: np.ndarray) -> Crowd:
        out = object.__new__(Crowd)
        out.node, out.n, out.label, out.guest, out.whole, out.coarse = self.node[some], self.n[some], self.label[some], self.guest[some], self.whole[some], np.ascontiguousarray(self.coarse[:, some])
        return out

    def meets(self, other: Crowd, every: bool):
        """For each entry, the nodes of those of `other` (of itself: the later ones) in different classes that may be similar to
        it; all, or the closest only."""
        low, high = np.searchsorted(other.n, self.n * SIMILAR - 1e-6), np.searchsorted(other.n, self.n / SIMILAR + 1e-6, "right")
        most = (self.n * (1 - SIMILAR) + 1e-9).astype(np.int64)
        if other is self:
            low = np.maximum(low, np.arange(1, len(self.n) + 1))
        for i in np.flatnonzero(low < high).tolist():
            a, b = low[i], high[i]
            far = np.zeros(b - a, np.uint16)
            for x, row in zip(self.coarse[:, i], other.coarse, strict=True):
                far += np.bitwise_count(row[a:b] ^ x)
            j = np.flatnonzero(far <= 2 * most[i] + 2) + a
            j = j[(other.label[j] != self.label[i]) & (other.node[j] != self.node[i]) & ~(other.guest[j] & self.guest[i])]
            if not len(j):
                continue
            larger = np.maximum(other.n[j], self.n[i])
            bound = 2 * (larger * (1 - SIMILAR) + 1e-9).astype(np.int64) - np.abs(other.n[j] - self.n[i])
            far = np.concatenate([np.bitwise_count(other.whole[j[k : k + 1024]] ^ self.whole[i]).sum(1, dtype=np.int64) for k in range(0, len(j), 1024)])
            j, far = j[far <= bound], far[far <= bound]
            if len(j):
                yield self.node[i], other.node[j if every else j[[far.argmin()]]]


# -- on tables -------------------------------------------------------------------------------------------------------


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_words, keys of every row."""

    def run(batches):
        known = word_hashes()
        for batch in common.text_slices(batches):
            words = [np.fromiter(map(known.__getitem__, x), np.uint64, len(x)) for x in (common.words_of(t or "") for t in batch.column("text").to_pylist())]
            keys = [sketch(w) for w in words]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "n_words": pa.array([len(w) for w in words], pa.int32()), "keys": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))})

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.md5(F.encode(text, "UTF-8")), F.concat(F.lit("null "), F.col("doc_id").cast("string")), F.lit("null")).alias("digest"))
    return common.map_arrow(rows, run, "doc_id long, digest string, n_words int, keys array<long>", keeps=True)


def buckets(nodes: DataFrame) -> DataFrame:
    """k, node, n_words, first, first_words: a row for each node and key that another node shares, with the smallest such node."""
    rows = nodes.where("size(keys) > 0").select("node", "n_words", F.explode("keys").alias("k"))
    shared = rows.groupBy("k").agg(F.count("*").alias("c"), F.min(F.struct("node", "n_words")).alias("x")).where("c > 1").select("k", "c", F.col("x.node").alias("first"), F.col("x.n_words").alias("first_words"))
    shared = common.stash(shared, "buckets")
    out = common.stash(rows.join(shared, "k"), "bucket-rows")
    common.discard(shared)
    return out


def near(n_words: str = "n_words", other: str = "other_words"):
    return F.least(n_words, other) >= SIMILAR * F.greatest(n_words, other)


def star_pairs(rows: DataFrame) -> DataFrame:
    return rows.where("node <> first").where(near("n_words", "first_words")).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()


def classed(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, "node", "left").withColumn("class", F.coalesce("label", "node")).drop("label")


def sized(rows: DataFrame) -> DataFrame:
    """rows (k, node, n_words, class) of those k that have several classes, with how many rows a k has, c, and whether it is large:
    it has over DIRECT pairs of different classes for each row."""
    sizes = rows.groupBy("k", "class").agg(F.count("*").alias("n")).groupBy("k").agg(F.sum("n").alias("c"), F.sum(F.col("n") * F.col("n")).alias("same"), F.count("*").alias("classes"))
    sizes = sizes.where("classes > 1").select("k", "c", (F.col("c") * F.col("c") - F.col("same") > DIRECT * F.col("c")).alias("large"))
    return rows.join(sizes, "k")


def mixed_buckets(rows: DataFrame, found: DataFrame) -> DataFrame:
    """k, node, n_words, class, c, large of the buckets that have several classes; a written table."""
    rows = common.stash(classed(rows.where("c > 2").select("k", "node", "n_words"), found), "bucket-classes")
    out = common.stash(sized(rows), "mixed-buckets")
    common.discard(rows)
    return out


def cross_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket that isn't large, and aren't in one class."""
    small = mixed.where("NOT large").select("k", "node", "n_words", "class")
    other = small.select("k", F.col("node").alias("other"), F.col("n_words").alias("other_words"), F.col("class").alias("other_class"))
    pairs = small.join(other, "k").where((F.col("class") < F.col("other_class")) & near())
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).where("a <> b").distinct()


def crowds(mixed: DataFrame) -> DataFrame:
    """crowd, node: all nodes of each large bucket are together in a crowd. Buckets with much the same nodes make one: a bucket
    goes to that which is the largest for most of its nodes."""
    large = mixed.where("large").select("k", "c", "node")
    own = large.groupBy("node").agg(F.max(F.struct("c", "k")).alias("x")).select("node", F.col("x.k").alias("crowd"))
    votes = large.join(own, "node").groupBy("k", "crowd").agg(F.count("*").alias("n"))
    of = votes.groupBy("k").agg(F.max(F.struct("n", "crowd")).alias("x")).select("k", F.col("x.crowd").alias("crowd"))
    return large.join(of, "k").select("crowd", "node").distinct()


def signed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node, n_words, level, guest, bits of the ids asked; of each different text of an id."""

    def run(batches):
        for batch in batches:
            words = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column("words")]
            rows = [(node, len(w), *x) for node, w in zip(batch.column("node").to_pylist(), words, strict=True) if len(w) for x in signatures(w)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()))], ["node", "n_words", "level", "guest", "bits"])

    words = common.stash(sequences(docs, ids), "words")  # two Python steps in one task would take two workers
    out = common.stash(common.map_arrow(words, run, "node long, n_words int, level int, guest boolean, bits binary"), "signatures")
    common.discard(words)
    return out


def crowd_pairs(crowded: DataFrame, signs: DataFrame, found: DataFrame, every: bool) -> DataFrame:
    """Pairs (a, b) of nodes of a crowd in different classes that the bounds don't rule out: every one, or each node's closest. Parts of a crowd's level meet two by two, in a group for each two."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = key[2].as_py() == key[3].as_py()
        table = pa.Table.from_batches(batches).combine_chunks()
        node, n_words, label, part = (table.column(c).to_numpy() for c in ("node", "n_words", "class", "part"))
        guest = table.column("guest").to_numpy(zero_copy_only=False)
        held = table.column("bits").to_pylist()
        del table
        bits = np.frombuffer(b"".join(held), np.uint64).reshape(len(held), -1)
        del held
        names, which, times = np.unique(label, return_inverse=True, return_counts=True)
        main = which == times.argmax()  # pairs within the largest class aren't even looked at
        make = lambda x: Crowd(node[x], n_words[x], label[x], guest[x], bits[x])
        if one:
            few = make(~main)
            sides = [(few, make(main)), (few, few)]
        else:
            p, q = part == key[2].as_py(), part == key[3].as_py()
            few, others = make(p & ~main), make(q & ~main)
            sides = [(few, make(q & main)), (others, make(p & main)), (few, others)]
        a, b, size = [], [], 0
        for x, y in sides:
            for i, j in x.meets(y, every) if len(x.n) and len(y.n) else ():
                a.append(np.minimum(i, j))
                b.append(np.maximum(i, j))
                size += len(j)
                if size >= 100_000:
                    yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})
                    a, b, size = [], [], 0
        none = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_pydict({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    held = classed(crowded, found).join(signs, "node")
    sizes = held.groupBy("crowd", "level").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.ceil(F.sum(F.length("bits")) / PART).cast("int").alias("parts")).where("low < high")
    sizes = common.stash(sizes.select("crowd", "level", "parts"), "crowd-levels")
    dealt = held.join(sizes, ["crowd", "level"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.select("crowd", "level", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "n_words", "class", "guest", "bits")
    out = common.stash(dealt.groupBy("crowd", "level", "p", "q").applyInArrow(run, "a long, b long").distinct(), "crowd-pairs")
    common.discard(sizes)
    return out


def only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """docs whose doc_id is (left_semi) or isn't (left_anti) in ids, a written table. Few ids are sent to all executors, many are shuffled."""
    small = ids.count() <= MOST_SENT
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", how)


def sequences(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node and its words as 32-bit hashes, for the ids asked; a row for each different text of an id."""

    def run(batches):
        known = word_hashes()
        for batch in common.text_slices(batches):
            words = [np.fromiter(map(known.__getitem__, x), np.uint64, len(x)) for x in (common.words_of(t or "") for t in batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_pydict({"node": batch.column("doc_id"), "words": pa.array([mix(w).astype(np.uint32).tobytes() for w in words], pa.binary())})

    return common.map_arrow(only(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ids), run, "node long, words binary", keeps=True).distinct()


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) whose word sequences are similar. words is a written table: an id of many pairs is split between tasks."""

    def run(batches):
        bags: dict[bytes, np.ndarray] = {}
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                if (key := x.tobytes()) not in bags:
                    bags = {key: bag(x)}
                keep.append(may_be_similar(bags[key], bag(y)) and similar(x, y))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)})

    side = lambda c, name: words.select(F.col("node").alias(c), F.col("words").alias(name))
    joined = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a")
    return common.map_arrow(joined.select("a", "b", "x", "y"), run, "a long, b long")  # twice if two texts of an id are


def compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b), a written table, whose documents are similar; a written table."""
    ids = common.stash(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")
    words = common.stash(sequences(docs, ids), "words")
    out = common.stash(verified(pairs, words), "edges")
    common.discard(ids, words)
    return out


def joined(found: DataFrame, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The classes `found`, put together by those of the pairs (a, b), a written table, whose documents are similar."""
    if pairs.isEmpty() or (more := compared(pairs, docs)).isEmpty():
        return found
    return extended(found, more)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id, the smallest id of its class, for every row of docs (doc_id, text)."""
    rows = common.stash(sketched(docs), "sketches")
    nodes = rows.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_words").alias("n_words"), F.first("keys").alias("keys"))
    nodes = common.stash(nodes, "nodes")
    ids, of = common.stash(rows.select("doc_id", "digest"), "digests"), common.stash(nodes.select("digest", "node"), "nodes")
    common.discard(rows)
    shared = buckets(nodes.where("node IS NOT NULL"))
    common.discard(nodes)
    common.release(docs.sparkSession)
    star = common.stash(star_pairs(shared), "star-pairs")
    found = components(compared(star, docs))
    mixed = mixed_buckets(shared, found)
    common.discard(shared)
    done = [star, common.stash(cross_pairs(mixed).join(star, ["a", "b"], "left_anti"), "cross-pairs")]
    crowded = common.stash(crowds(mixed), "crowds")
    common.discard(mixed)
    common.release(docs.sparkSession)
    found = joined(found, done[-1], docs)
    if not crowded.isEmpty():
        members = common.stash(crowded.select(F.col("node").alias("doc_id")).distinct(), "crowded-nodes")
        signs = signed(docs, members)
        for every in (False, True):
            pairs = crowd_pairs(crowded, signs, found, every)
            if pairs.isEmpty():  # where no node has a closest one, none has any
                break
            for x in done:
                pairs = pairs.join(x, ["a", "b"], "left_anti")
            done.append(common.stash(pairs, "crowd-pairs"))
            found = joined(found, done[-1], docs)
        common.discard(members, signs)
    label = of.join(found, "node", "left").select("digest", F.coalesce("label", "node").alias("class_id"))
    return ids.join(common.stash(label, "classes"), "digest").select("doc_id", "class_id")


def op8_order_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
