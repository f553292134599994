"""Token ids in Re-Pair compressed shard files.

Documents are dealt into shards by ranges of their id. Each shard file is a run of blocks of whole documents; in a block,
frequent pairs of ids are replaced by nonterminals, round after round, until no pair is frequent. A block stores its
rules, the length that each rule expands to, and where each document's symbols start; a footer says where the blocks are.
So one document, or one token of one, is decoded without its neighbours, and no reader holds more than a block.

Null texts count as empty; an empty document has its end id only. Null ids come first and stay null; ids are 64-bit whole
numbers throughout. Documents with the same id keep one place each, in no set order. A document longer than a block is a
block of its own. Columns other than the id and the text are not looked at. An empty table gives no file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import common
from tidepool.llm.fastencode import PieceEncoder, flat

MAGIC, END = b"TPRP0002", b"TPRPEND2"
#: Tokens of a block, a longer document aside.
BLOCK_TOKENS = 2_000_000
#: A pair that occurs so often in a block, occurrences that overlap aside, is replaced.
LEAST_COUNT = 16
#: Texts with these are split at BLANKS only: these are white space to Arrow, but not to the tokenizer.
ODD_SPACE = "[\x1c-\x1f]"
#: Letters, then ASCII marks; of Latin letters those that lower case and NFC leave one character each.
PLAIN = "^(?P<letters>[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u0148\u014a-\u017e]+)(?P<marks>[!-/:-@\\[-`{-~]*)$"
#: White space of ASCII that both split at.
BLANKS = "[\t\n\r ]+"
#: Parts that the tokenizer gets at a time; bytes of text that words are gathered from; bytes of an Arrow batch, of which a
#: worker and its executor hold two or more, so that most batches are one such slice.
TOGETHER, SLICE, BATCH = 256, 12_000_000, "11m"
#: New parts whose ids the library returns at a time; words whose ids are gathered at a time.
AT_ONCE, RUN = 32_768, 500_000
#: Different parts, and other words, that a worker remembers.
MOST_PARTS, MOST_OTHERS = 1_000_000, 200_000


# -- grammar ---------------------------------------------------------------------------------------------------------


def compress(ids: np.ndarray, bounds: np.ndarray, first_symbol: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, where each document begins (n + 1 numbers) -> (symbols, where each document's begin, rules as rows of two).

    No rule spans two documents. Rule i makes symbol first_symbol + i of two earlier symbols or ids. All pairs are counted
    exactly; in a round, the places of frequent pairs are replaced where neither neighbouring place has a commoner pair, so
    the commonest pair is replaced everywhere and rounds come to an end when no pair has LEAST_COUNT places. A pair's count
    only falls while its symbols stay, so a round looks at places of frequent pairs and beside new symbols only.
    """
    seq, start, rules, made = ids.astype(np.uint32), bounds.astype(np.int64), [], first_symbol
    live = np.ones(len(seq), bool)
    while len(seq) > 1:
        live[start[1:][start[1:] > start[:-1]] - 1] = False  # a document's last symbol and the next one's first
        live[-1] = False
        at, count, pair = frequent_pairs(seq, np.flatnonzero(live))
        if not len(count):
            break
        # by falling rank, the commonest pair last
        rank = np.empty(len(count), np.int32)
        rank[np.argsort(count, kind="stable")] = np.arange(1, len(count) + 1)
        held = np.zeros(len(seq) + 1, np.int32)
        held[at] = np.repeat(rank, count)
        mine = held[at]
        chosen = (mine > held[at + 1]) & (mine > held[at - 1])
        of = np.repeat(np.arange(len(count)), count)
        uses = np.bincount(of[chosen], minlength=len(count))
        new = np.flatnonzero(uses >= LEAST_COUNT)  # others wait: commoner pairs took their places
        symbol = np.zeros(len(count), np.uint32)
        symbol[new] = made + np.arange(len(new))
        sign = symbol[of]
        chosen &= sign > 0
        same = seq[:-1] == seq[1:]  # which places of a run count depends on where it begins
        live[:] = False
        live[at] = True
        live[:-1] |= same
        at, sign = at[chosen], sign[chosen]
        live[at - (at > 0)] = True
        seq[at] = sign
        start = start - np.searchsorted(np.sort(at) + 1, start)  # what has gone before it
        alive = np.ones(len(seq), bool)
        alive[at + 1] = False
        seq, live = seq[alive], live[alive]
        rules.append(pair[new])
        made += len(new)
    return seq.astype(np.int64), start, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def frequent_pairs(seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, how many of each pair, pairs as rows of two) of pairs that begin LEAST_COUNT times at the places `at`, in
    order of pairs; of places in a run of one symbol every second one counts."""
    a, b = seq[at], seq[at + 1]
    twin = np.flatnonzero(a == b)
    if len(twin):
        run = np.ones(len(twin), bool)
        run[1:] = at[twin[1:]] != at[twin[:-1]] + 1
        firsts = np.flatnonzero(run)
        odd = (at[twin] - np.repeat(at[twin[firsts]], np.diff(firsts, append=len(twin)))) & 1 == 1
        keep = np.ones(len(at), bool)
        keep[twin[odd]] = False
        at, a, b = at[keep], a[keep], b[keep]
    # places whose pair falls into a slot with too few can't be frequent; the others are counted by the whole pair
    slot = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B))) >> np.uint32(32 - max(8, min(22, len(at).bit_length())))
    slot = slot.astype(np.int32)
    enough = np.bincount(slot, minlength=1)[slot] >= LEAST_COUNT
    at, a, b = at[enough], a[enough].astype(np.uint64), b[enough].astype(np.uint64)
    if not len(at):
        return at, at, np.zeros((0, 2), np.int64)
    half, low = int(max(a.max(), b.max())).bit_length(), len(seq).bit_length()
    if 2 * half + low <= 64:  # pair and place in one number
        a = ((a << np.uint64(half) | b) << np.uint64(low)) | at.astype(np.uint64)
        a.sort()
        at, pair = (a & np.uint64((1 << low) - 1)).astype(np.int64), a >> np.uint64(low)
    else:
        pair = a << np.uint64(half) | b
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    count = np.diff(first, append=len(pair))
    often = count >= LEAST_COUNT
    pair = pair[first[often]]
    return at[np.repeat(often, count)], count[often], np.stack([pair >> np.uint64(half), pair & np.uint64((1 << half) - 1)], axis=1).astype(np.int64)


def rule_sizes(rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """How many ids each rule stands for."""
    size: list[int] = []
    for a, b in (rules - first_symbol).tolist():
        size.append((size[a] if a >= 0 else 1) + (size[b] if b >= 0 else 1))
    return np.array(size, np.int64)


def expand(seq: np.ndarray, rules: np.ndarray, first_symbol: int, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, where each symbol's ids begin in them, n + 1 numbers). size: what rule_sizes() says, if known.

    Symbols are put where their ids begin, then split into two until none is a rule: as many steps as rules are deep.
    """
    size = rule_sizes(rules, first_symbol) if size is None else size
    n, is_rule = np.ones(len(seq), np.int64), seq >= first_symbol
    n[is_rule] = size[seq[is_rule] - first_symbol]
    ends = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(ends[-1], np.int64)
    out[ends[:-1]] = seq
    at, rule = ends[:-1][is_rule], seq[is_rule] - first_symbol
    while len(at):
        left, right = rules[rule, 0], rules[rule, 1]
        left_rule, right_rule = left >= first_symbol, right >= first_symbol
        step = np.ones(len(at), np.int64)
        step[left_rule] = size[left[left_rule] - first_symbol]
        out[at], out[at + step] = left, right
        at = np.concatenate([at[left_rule], (at + step)[right_rule]])
        rule = np.concatenate([left[left_rule], right[right_rule]]) - first_symbol
    return out, ends


# -- file format -----------------------------------------------------------------------------------------------------


def planes(x: np.ndarray) -> bytes:
    """Three bytes each: the low two, then the high one; the high plane is mostly zeros and deflates well."""
    low, high = (x & 0xFFFF).astype("<u2").tobytes(), (x >> 16).astype("u1").tobytes()
    packed = zlib.compress(high, 1)
    return struct.pack("<QQ", len(x), len(packed)) + low + packed


def unplanes(raw: memoryview, at: int) -> tuple[np.ndarray, int]:
    n, packed = struct.unpack_from("<QQ", raw, at)
    at += 16
    low = np.frombuffer(raw, "<u2", n, at).astype(np.int64)
    high = np.frombuffer(zlib.decompress(raw[at + 2 * n : at + 2 * n + packed]), "u1").astype(np.int64)
    return low | high << 16, at + 2 * n + packed


def block_bytes(doc_ids: np.ndarray, known: np.ndarray, ids: np.ndarray, bounds: np.ndarray, first_symbol: int) -> bytes:
    """A block's length and its body. known: which of doc_ids aren't null."""
    seq, start, rules = compress(ids, bounds, first_symbol)
    size = rule_sizes(rules, first_symbol)
    body = struct.pack("<QQQ", len(doc_ids), len(rules), first_symbol) + doc_ids.astype("<i8").tobytes() + np.packbits(known).tobytes() + bounds.astype("<u8").tobytes() + start.astype("<u8").tobytes() + rules.astype("<u4").tobytes() + size.astype("<u4").tobytes() + planes(seq)
    return struct.pack("<Q", len(body)) + body


class Block:
    """One block of a shard file, with random access to its documents."""

    def __init__(self, raw: memoryview):
        n, n_rules, self.first_symbol = struct.unpack_from("<QQQ", raw, 0)
        at, bits = 24, -(-n // 8)
        known = np.unpackbits(np.frombuffer(raw, "u1", bits, at + 8 * n), count=n).astype(bool)
        self.doc_ids = pa.array(np.frombuffer(raw, "<i8", n, at), pa.int64(), mask=~known)
        self.bounds = np.frombuffer(raw, "<u8", n + 1, at := at + 8 * n + bits).astype(np.int64)
        self.start = np.frombuffer(raw, "<u8", n + 1, at := at + 8 * (n + 1)).astype(np.int64)
        self.rules = np.frombuffer(raw, "<u4", 2 * n_rules, at := at + 8 * (n + 1)).reshape(-1, 2).astype(np.int64)
        self.rule_size = np.frombuffer(raw, "<u4", n_rules, at := at + 8 * n_rules).astype(np.int64)
        self.seq, _ = unplanes(raw, at + 4 * n_rules)

    def ids(self) -> np.ndarray:
        return expand(self.seq, self.rules, self.first_symbol, self.rule_size)[0]

    def document(self, i: int) -> np.ndarray:
        return expand(self.seq[self.start[i] : self.start[i + 1]], self.rules, self.first_symbol, self.rule_size)[0]

    def token(self, i: int, j: int) -> int:
        """Token j of document i: the symbol's place by lengths, then down the rules; nothing else is expanded."""
        seq = self.seq[self.start[i] : self.start[i + 1]]
        is_rule = seq >= self.first_symbol
        size = np.where(is_rule, self.rule_size[np.where(is_rule, seq - self.first_symbol, 0)] if len(self.rule_size) else 1, 1)
        ends = np.cumsum(size)
        k = int(np.searchsorted(ends, j, "right"))
        s, j = int(seq[k]), j - int(ends[k] - size[k])
        while s >= self.first_symbol:
            a, b = self.rules[s - self.first_symbol].tolist()
            n = int(self.rule_size[a - self.first_symbol]) if a >= self.first_symbol else 1
            s, j = (a, j) if j < n else (b, j - n)
        return s


#: A footer's entry for each block: where it begins in the file, and how many documents and tokens are before it.
ENTRY = "<QQQ"


def footer(entries: list[tuple[int, int, int]]) -> bytes:
    return b"".join(struct.pack(ENTRY, *x) for x in entries) + struct.pack("<Q", len(entries)) + END


class Shard:
    """A shard file, open for reading: its blocks one at a time, and any document or token of it."""

    def __init__(self, file, size: int):
        self.file, tail = file, len(END) + 8
        if size < len(MAGIC) + tail or self.get(0, len(MAGIC)) != MAGIC or self.get(size - len(END), len(END)) != END:
            raise ValueError("not a shard file")
        (n,) = struct.unpack("<Q", self.get(size - tail, 8))
        width = struct.calcsize(ENTRY) * n
        self.entries = list(struct.iter_unpack(ENTRY, self.get(size - tail - width, width)))

    def get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> Block:
        at = self.entries[k][0]
        (n,) = struct.unpack("<Q", self.get(at, 8))
        return Block(memoryview(self.get(at + 8, n)))

    def place(self, i: int) -> tuple[Block, int]:
        """The block that has the shard's document i, and its number there."""
        k = bisect_right([x[1] for x in self.entries], i) - 1
        return self.block(k), i - self.entries[k][1]

    def document(self, i: int) -> np.ndarray:
        block, i = self.place(i)
        return block.document(i)

    def token(self, i: int, j: int) -> int:
        block, i = self.place(i)
        return block.token(i, j)


# -- tokenizer -------------------------------------------------------------------------------------------------------


class WordStore(PieceEncoder):
    """Keeps its words in an Arrow array, with a tenth of the memory that a dictionary of Python strings takes. A look-up hashes
    all of them anew, which is no more work than as many Python strings for the words that are looked up."""

    def reset(self) -> None:
        super().reset()
        self.words = pa.array([], pa.large_string())
        self.start, self.size, self.flat = (np.zeros(0, x) for x in (np.int64, np.int32, np.int32))

    def _add(self, words: pa.Array) -> None:
        # by AT_ONCE words: what the library returns takes far more memory than the ids in it
        found = [self.encode_many(words.slice(i, AT_ONCE).to_pylist()) for i in range(0, len(words), AT_ONCE)]
        ids, sizes = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        self.start = np.concatenate([self.start, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes.astype(np.int32)])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.words = pa.concat_arrays([self.words, words])
        self.used += len(ids)

    def places(self, distinct: pa.Array) -> np.ndarray:
        if len(self.words) + len(distinct) > self.most and len(self.words):
            self.reset()
        place = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy(zero_copy_only=False).copy()
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = np.arange(len(self.words), len(self.words) + len(new))
            self._add(distinct.take(pa.array(new)))
        return place

    def encode(self, pieces: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        coded = pieces.cast(pa.large_string()).dictionary_encode()
        ids, ends = self.gather(self.places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)])
        return ids, ends[bounds]


class WordTokenizer:
    """Encodes by white-space separated words. The tokenizer makes white space one blank, splits at it and drops it, so a
    word's ids don't depend on its neighbours. It also splits letters from punctuation, so plain words are cut into their
    letters, in lower case, and the marks after them; these parts are encoded many at a time, and a part ends where an id
    stands for a word's end."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.n_ids = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(self.n_ids, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        # letters of PLAIN in lower case are as the normaliser leaves them, and blanks are all that splits them
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.letters = WordStore(self.encode_letters, MOST_PARTS)
        self.others = WordStore(lambda words: flat(self.direct(words)), MOST_OTHERS)

    def direct(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_letters(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        together = [" ".join(parts[i : i + TOGETHER]) for i in range(0, len(parts), TOGETHER)]
        ids, _ = flat([x.ids for x in self.bare.encode_batch_fast(together, add_special_tokens=False)])
        stop = np.flatnonzero(self.ends[ids]) + 1
        if "" in parts or len(stop) != len(parts) or len(ids) and stop[-1] != len(ids):
            return flat(self.direct(parts))
        return ids, np.diff(stop, prepend=0)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each word's begin and the end)."""
        cut = pc.extract_regex(words, PLAIN)
        plain = pc.is_valid(cut)
        is_plain = plain.to_numpy(zero_copy_only=False)
        cut = cut.filter(plain)
        each = lambda store, x: store.encode(x, np.arange(len(x) + 1))
        size, found = np.zeros((2, len(words)), np.int64), []
        for k, (store, part, rows) in enumerate(((self.letters, pc.utf8_lower(pc.struct_field(cut, "letters")), is_plain), (self.others, pc.struct_field(cut, "marks"), is_plain), (self.others, words.filter(pc.invert(plain)), ~is_plain))):
            ids, ends = each(store, part)
            size[k % 2, rows] = np.diff(ends)
            found.append((ids, rows))
        ends = np.concatenate([[0], np.cumsum(size.sum(0))])
        out = np.empty(ends[-1], np.int32)
        for k, (ids, rows) in enumerate(found):
            n = size[k % 2, rows]
            start = ends[:-1][rows] + (size[0, rows] if k == 1 else 0)
            out[np.repeat(start - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return out, ends

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's begin)."""
        text = pc.fill_null(text.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(text, ODD_SPACE)
        words = pc.utf8_split_whitespace(text)
        if pc.any(odd).as_py():
            words = pc.if_else(odd, pc.split_pattern_regex(text, BLANKS), words)
        pieces, offsets = words.flatten(), words.offsets.to_numpy().astype(np.int64)
        real = pc.binary_length(pieces).to_numpy(zero_copy_only=False) > 0
        if not real.all():
            offsets, pieces = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]], pieces.filter(pa.array(real))
        else:
            offsets = offsets - offsets[0]
        coded = pieces.dictionary_encode()
        del text, odd, words, pieces, real
        ids, begin = self.encode_words(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False)
        size = np.diff(begin).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(size[code], dtype=np.int64)])
        out = np.empty(ends[-1], np.int32)
        for i in range(0, len(code), RUN):
            some, to = code[i : i + RUN], ends[i : i + RUN + 1]
            out[to[0] : to[-1]] = ids[np.repeat(begin[some] - (to[:-1] - to[0]), size[some]) + np.arange(to[-1] - to[0])]
        return out, ends[offsets]


def tokenizer(path: str) -> WordTokenizer:
    return common.worker_slot(("words", path), lambda: WordTokenizer(path))


# -- operator --------------------------------------------------------------------------------------------------------


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int]]:
    """Writes a file for each shard, shards and documents in ascending id; returns (shard, its tokens), one row per shard.

    A task that runs again writes the same bytes to the same name. The list holds two numbers for each shard.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = common.n_scan_partitions(rows)
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")

    def write(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        coder, out, total = tokenizer(tokenizer_path), None, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        entries: list[tuple[int, int, int]] = []
        at, documents, tokens = len(MAGIC), 0, 0  # of what is written
        fs, top = common.filesystem(folder)
        name, temporary = f"{top}/shard-{shard:08d}.rp", f"{top}/.tmp-{shard}-{uuid.uuid4().hex}"

        def encoded(batch):
            """(ids of the documents, which aren't null, all tokens, where each document's begin)"""
            ids, bounds = coder.encode(batch.column("text"))
            bounds = bounds + np.arange(len(bounds))
            whole = np.full(bounds[-1], end_id, np.uint16 if max(coder.n_ids, end_id + 1) <= 65536 else np.int32)
            inner = np.ones(len(whole), bool)
            inner[bounds[1:] - 1] = False
            whole[inner] = ids
            doc_id = batch.column("doc_id")  # through whole numbers only: a float has 53 bits, and a null would make floats of all
            return pc.fill_null(doc_id, 0).to_numpy(zero_copy_only=False).copy(), pc.is_valid(doc_id).to_numpy(zero_copy_only=False), whole, bounds

        def flush():
            nonlocal at, documents, tokens
            doc_ids, known, ids, size = (np.concatenate([x[i] for x in held]) for i in range(4))
            held.clear()
            raw = block_bytes(doc_ids, known, ids, np.concatenate([[0], np.cumsum(size)]), max(coder.n_ids, end_id + 1))
            out.write(raw)
            entries.append((at, documents, tokens))
            at, documents, tokens = at + len(raw), documents + len(size), tokens + len(ids)

        for batch in common.text_slices(batches, most=SLICE):
            if out is None:
                fs.create_dir(top, recursive=True)
                out = fs.open_output_stream(temporary, compression=None)
                out.write(MAGIC)
            doc_ids, known, whole, bounds = encoded(batch)
            del batch
            common.trim()  # what encoding took, before a block takes its own
            total += len(whole)
            first = 0
            while first < len(doc_ids):
                room = BLOCK_TOKENS - sum(len(x[2]) for x in held)
                last = max(int(np.searchsorted(bounds, bounds[first] + room, "right")) - 1, first if held else first + 1)
                if last > first:
                    held.append((doc_ids[first:last], known[first:last], whole[bounds[first] : bounds[last]], np.diff(bounds[first : last + 1])))
                first = last
                if first < len(doc_ids):
                    flush()
        if out is not None:
            if held:
                flush()
            out.write(footer(entries))
            out.close()
            fs.move(temporary, name)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": pa.array([total], pa.int64())})

    return [(r.shard, r.n) for r in common.map_arrow(rows, write, "shard int, n long", keeps=True, batch=BATCH).collect()]


def read_shards(spark, folder: str, sizes: list[tuple[int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; starts run over all shards. A block is read at a time."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not sizes:
        return spark.createDataFrame([], schema)
    before, total = [], 0
    for shard, n in sorted(sizes):
        before.append((shard, total))
        total += n

    def read(batches):
        fs, top = common.filesystem(folder)
        for batch in batches:
            for shard, at in zip(batch.column("shard").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with fs.open_input_file(f"{top}/shard-{shard:08d}.rp") as file:
                    held = Shard(file, file.size())
                    for k, (_, _, tokens) in enumerate(held.entries):
                        block = held.block(k)
                        raw = block.ids().astype("<u4").tobytes()
                        b = block.bounds
                        crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(b[:-1].tolist(), b[1:].tolist(), strict=True)]
                        yield pa.RecordBatch.from_pydict({"doc_id": block.doc_ids, "start": pa.array(at + tokens + b[:-1]), "n_tokens": pa.array(np.diff(b)), "ids_crc32": pa.array(crc, pa.int64())})

    shards = spark.createDataFrame(before, "shard int, before long").repartition(len(before))
    return common.map_arrow(shards, read, schema)


def op7_repair_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.shared_dir(spark, "repair")
    sizes = write_shards(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(spark, folder, sizes)
