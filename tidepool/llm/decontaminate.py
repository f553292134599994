"""Test items in training text, found by shared n-grams and scored by local alignment.

Every n-gram of a test item is a seed, common ones too: edits leave the common ones as likely as the rare ones. Where a
document has a seed, Smith-Waterman aligns the item's words with the words around, so that edited and paraphrased copies
score too; the score is the share of a perfect match's. Places where too few of the item's words are near the seed for
LEAST_SCORE are not aligned. A copy in which no n-gram is left whole (each third word replaced, say) isn't found.

Test items are taken in blocks of BLOCK_WORDS words. A block's index is all that travels to the workers, which hold one at
a time; what a block finds is written before the next is sent. An alignment as good as LEAST_SCORE covers at most two words
of the document for each of the item's, so long stretches of seeds are aligned in overlapping windows of four, in memory
that grows with the window alone: items and texts may be of any length.

Items of fewer words than a seed match documents that have just these words. Null texts, and texts or items without words,
match nothing. Repeated documents and items are all reported, by id; null ids too. Empty tables of documents give no rows,
those of items give documents without hits. A column of the documents with the name of the hits' column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import common

N, BLOCK_WORDS = 3, 1_000_000
MATCH, MISMATCH, GAP = 2, -1, 1
LEAST_SCORE = 0.5
BASE = np.uint64(0x9E3779B97F4A7C15)
HIT = "struct<item_id: long, score: double, start: int, stop: int>"


def grams(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, codes) of the n-grams all of whose words are known."""
    if len(ids) < N:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids >= 0
    ok = known[: len(ids) - N + 1].copy()
    for j in range(1, N):
        ok &= known[j : len(ids) - N + 1 + j]
    at = np.flatnonzero(ok)
    code = np.zeros(len(at), np.uint64)
    for j in range(N):
        code = code * BASE + (ids[at + j].astype(np.uint64) + np.uint64(1))
    return at, code ^ (code >> np.uint64(29))


def best_end(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """(score, past-the-last place in the item, and in the window) of the best local alignment; linear gaps. Holds two rows."""
    place = GAP * np.arange(len(window) + 1, dtype=np.int32)
    last, best = np.zeros(len(window) + 1, np.int32), (0, 0, 0)
    for i, word in enumerate(item.tolist(), 1):
        row = np.zeros(len(window) + 1, np.int32)
        np.maximum(last[:-1] + np.where(window == word, np.int32(MATCH), np.int32(MISMATCH)), last[1:] - GAP, out=row[1:])
        np.maximum(row, 0, out=row)
        last = np.maximum.accumulate(row + place) - place
        j = int(last.argmax())
        if last[j] > best[0]:
            best = int(last[j]), i, j
    return best


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """(score, start, stop) of the best local alignment, as places in the window: its end, and from there back its start."""
    score, i, j = best_end(item, window)
    back = best_end(item[:i][::-1], window[:j][::-1])[2] if score else 0
    return score, j - back, j


class Index:
    """Words, n-grams and where they are in the items of a block."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item_ids, self.items, self.word = [], [], {}
        self.short: dict[tuple[int, ...], list[int]] = {}
        at, codes, owner = [], [], []
        for item_id, text in items:
            ids = np.array([self.word.setdefault(w, len(self.word)) for w in common.words_of(text or "")], np.int64)
            if not len(ids):
                continue
            if len(ids) < N:
                self.short.setdefault(tuple(ids.tolist()), []).append(item_id)
                continue
            p, c = grams(ids)
            at.append(p)
            codes.append(c)
            owner.append(np.full(len(p), len(self.items)))
            self.item_ids.append(item_id)
            self.items.append(ids)
        self.at, self.owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, owner))
        self.codes, self.gram = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.uint64), return_inverse=True)
        order = np.argsort(self.gram, kind="stable")
        self.seed_at, self.seed_owner = self.at[order], self.owner[order]
        self.begin = np.searchsorted(self.gram[order], np.arange(len(self.codes) + 1))
        self.size = np.fromiter(map(len, self.items), np.int64, len(self.items))
        del self.at, self.owner, self.gram

    @classmethod
    def of(cls, state: dict) -> Index:
        """An index from its attributes, which is how it travels."""
        index = cls.__new__(cls)
        index.__dict__.update(state)
        return index

    def ids(self, text: str) -> np.ndarray:
        words = common.words_of(text)
        get = self.word.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, n-grams) that the block knows."""
        at, code = grams(ids)
        if not len(at) or not len(self.codes):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        same = self.codes[k] == code
        return at[same], k[same]

    def may_score(self, item: np.ndarray, window: np.ndarray) -> bool:
        """Whether so many of the item's words are in the window that LEAST_SCORE can be reached."""
        near = self.__dict__.setdefault("near", np.zeros(len(self.word) + 1, bool))  # the last place is that of unknown words
        near[window] = True
        near[-1] = False
        n = np.count_nonzero(near[item])
        near[window] = False
        return n >= LEAST_SCORE * len(item)

    def hits(self, text: str) -> list[dict]:
        """item_id, score, and first and past-the-last word of each item that the text has, best place only."""
        ids = self.ids(text)
        if len(ids) < N:
            return [{"item_id": i, "score": 1.0, "start": 0, "stop": len(ids)} for i in self.short.get(tuple(ids.tolist()), ())]
        at, k = self.found(ids)
        n = self.begin[k + 1] - self.begin[k]
        if not n.sum():
            return []
        at = np.repeat(at, n)
        seed = np.repeat(self.begin[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        owner, place = self.seed_owner[seed], self.seed_at[seed]
        order = np.lexsort((at, owner))
        at, owner, place = at[order], owner[order], place[order]
        size = self.size[owner]
        cut = np.flatnonzero((owner[1:] != owner[:-1]) | (at[1:] - at[:-1] > 2 * size[1:])) + 1
        best: dict[int, dict] = {}
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
            o = int(owner[a])
            item = self.items[o]
            margin = len(item) // 2 + 2
            first = max(0, int((at[a:b] - place[a:b]).min()) - margin)
            end = min(len(ids), int((at[a:b] - place[a:b]).max()) + len(item) + margin)
            for low in range(first, max(first + 1, end - 2 * len(item)), 2 * len(item)):
                high = min(end, low + 4 * len(item))
                if not self.may_score(item, ids[low:high]):
                    continue
                score, start, stop = align(item, ids[low:high])
                share = score / (MATCH * len(item))
                if share >= LEAST_SCORE and (o not in best or share > best[o]["score"]):
                    best[o] = {"item_id": self.item_ids[o], "score": share, "start": low + start, "stop": low + stop}
        return list(best.values())


def blocks(benchmark: DataFrame):
    """The test items in blocks of about BLOCK_WORDS words, one in memory at a time."""
    held, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        held.append((row.item_id, row.text))
        n += len(row.text or "") // 4
        if n >= BLOCK_WORDS:
            yield held
            held, n = [], 0
    if held:
        yield held


def with_hits(docs: DataFrame, benchmark: DataFrame, column: str = "hits") -> DataFrame:
    """docs with the test items found in the text: an array of item_id, score, start, stop (words)."""
    rows = docs.drop(column)
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    context = docs.sparkSession.sparkContext
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("stop", pa.int32())]))
    out, sent = rows.withColumn(column, F.array().cast(f"array<{HIT}>")), None

    def step(asked):
        def run(batches):
            index = Index.of(asked.value)
            for batch in common.text_slices(batches):
                got = [(index.hits(t) if t else []) + h for t, h in zip(batch.column("text").to_pylist(), batch.column(column).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in names} | {column: pa.array(got, kind)})

        return run

    held = None
    for items in blocks(benchmark):
        if sent is not None:
            out = common.stash(out, "block-hits")
            sent.destroy()
            if held is not None:
                common.discard(held)
            held = out
        sent = context.broadcast(vars(Index(items)))
        out = common.map_arrow(out, step(sent), f"{schema}, `{column}` array<{HIT}>")
    return out


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_hits(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", F.round("h.score", 6).alias("score"), "h.start", "h.stop")
