"""SentencePiece models run by the tokenizers library.

The model file is read as protobuf wire format; normaliser, white-space marker, piece scores and byte fallback are built
anew for the tokenizers library. Unigram models keep their scores; BPE models get merges ranked by the score of the piece
they make. Each distinct word is encoded once, in multithreaded batches, and compared with the sentencepiece library; with
BPE, where merges of one word don't depend on those of others, the tokenizers library gets many new words as one text, which
is cut where words begin. The ids of each text are decoded again: by the bytes that the library shows for each id and, where
these aren't the text, by the library.

Null texts give no ids (null arrays); empty texts give none (empty arrays). Repeated rows and ids stay as they are.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import common
from tidepool.llm.fastencode import PieceEncoder, flat

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
THREADS = 2
#: Different pieces that a worker remembers, and bytes of text that it encodes at a time.
MOST_PIECES, SLICE = 250_000, 500_000
#: New words that the tokenizers library gets as one text.
JOINED = 128


# -- model file ------------------------------------------------------------------------------------------------------


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: int, bytes, or the 4 or 8 bytes of a fixed-width number."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = raw[at]
            value |= (b & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if not b & 0x80:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = raw[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = raw[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def parse_model(raw: bytes) -> dict:
    """pieces as (text, score, kind), model_type, and the normaliser's settings."""
    model = {"pieces": [], "model_type": UNIGRAM, "byte_fallback": False, "unk_id": 0, "charsmap": b"", "dummy_prefix": True, "strip_spaces": True, "escape_spaces": True, "mark_as_suffix": False}
    for number, value in fields(raw):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(fields(value))
            model["pieces"].append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(fields(value))
            model |= {"model_type": spec.get(3, UNIGRAM), "mark_as_suffix": bool(spec.get(24, 0)), "byte_fallback": bool(spec.get(35, 0)), "unk_id": spec.get(40, 0)}
        elif number == 3:
            spec = dict(fields(value))
            model |= {"charsmap": spec.get(2, b""), "dummy_prefix": bool(spec.get(3, 1)), "strip_spaces": bool(spec.get(4, 1)), "escape_spaces": bool(spec.get(5, 1))}
    return model


def ranked_merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All ways to make a piece of two, the best scored piece first."""
    known = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, i in known.items():
        for k in range(1, len(piece)):
            if piece[:k] in known and piece[k:] in known:
                found.append((-pieces[i][1], i, known[piece[:k]], known[piece[k:]], piece[:k], piece[k:]))
    return [x[4:] for x in sorted(found)]


def unjoined() -> list:
    """The steps of decoding that come before the pieces are joined."""
    from tokenizers import decoders

    return [decoders.Replace(MARK, " "), decoders.ByteFallback()]


def shown(pieces: list[tuple[str, float, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that each piece is decoded to, and where each piece's begin and the end."""
    from tokenizers import decoders

    decoder = decoders.Sequence(unjoined())
    out = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", p) else decoder.decode([p]).encode() for p, _, _ in pieces]
    return np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in out])])


def build(model: dict):
    """A tokenizer of the tokenizers library for a parsed model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    pieces = model["pieces"]
    if model["mark_as_suffix"]:
        raise ValueError("models with the white-space marker as a suffix aren't supported")
    if model["model_type"] == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=model["unk_id"], byte_fallback=model["byte_fallback"])
    elif model["model_type"] == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(pieces)}, ranked_merges(pieces), unk_token=pieces[model["unk_id"]][0], fuse_unk=True, byte_fallback=model["byte_fallback"])
    else:
        raise ValueError(f"model type {model['model_type']}")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["strip_spaces"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model["dummy_prefix"] else []
    steps += [normalizers.Replace(" ", MARK)] if model["escape_spaces"] else []
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([*unjoined(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else [])])
    if user := [p for p, _, kind in pieces if kind == USER_DEFINED]:
        tokenizer.add_tokens([AddedToken(p, normalized=False) for p in user])
    return tokenizer


class Codec:
    """Encodes and decodes texts; `parity` counts pieces compared with the sentencepiece library, `differ` has those that differ."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        with open(path, "rb") as f:
            self.model = parse_model(f.read())
        self.tokenizer, self.threads = build(self.model), threads
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        #: Words are independent if no piece goes on past a marker, a single blank separates them and each begins with a marker.
        self.by_word = self.model["dummy_prefix"] and self.model["escape_spaces"] and not self.model["strip_spaces"] and not self.model["charsmap"] and not any(MARK in p.lstrip(MARK) or kind == USER_DEFINED for p, _, kind in self.model["pieces"])
        self.joins = self.by_word and self.model["model_type"] == BPE
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.model["pieces"]])
        self.shown, self.shown_at = shown(self.model["pieces"])
        self.differ: set[str] = set()
        self.compared = 0
        self.pieces = PieceEncoder(self.checked, MOST_PIECES)

    def direct(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """flat(direct(words)) for words without white-space markers and blanks: JOINED of them are one text to the library."""
        full = [w for w in words if w]
        ids, _ = flat(self.direct([" ".join(full[i : i + JOINED]) for i in range(0, len(full), JOINED)]))
        at = np.flatnonzero(self.begins[ids])
        if len(at) != len(full) or len(at) and at[0]:  # a model without a piece for the marker
            return flat(self.direct(words))
        size = np.zeros(len(words), np.int64)
        size[[i for i, w in enumerate(words) if w]] = np.diff(at, append=len(ids))
        return ids, size

    def checked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, size = self.joined(words) if self.joins else flat(self.direct(words))
        theirs = self.reference.encode(words, num_threads=self.threads)
        their_ids, their_size = flat(theirs)
        self.compared += len(words)
        if not (np.array_equal(ids, their_ids) and np.array_equal(size, their_size)):
            ours = np.split(ids, np.cumsum(size)[:-1])
            self.differ.update(w for w, a, b in zip(words, ours, theirs, strict=True) if a.tolist() != b)
        return ids, size

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each text's begin, whether each text's ids are those of the sentencepiece library)."""
        text = pc.fill_null(text.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(text, f"  |^ | $|{MARK}").to_numpy(zero_copy_only=False) if self.by_word else np.ones(len(text), bool)
        words = pc.split_pattern(pc.if_else(pa.array(whole), "", text), " ")
        before = len(self.differ)
        ids, bounds = self.pieces.encode(words.flatten(), words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py())
        same = np.ones(len(text), bool)
        if before or self.differ:
            same &= np.array([not self.differ.intersection(w) for w in words.to_pylist()], bool)
        if whole.any():
            at = np.flatnonzero(whole)
            texts = text.take(pa.array(at)).to_pylist()
            ours, theirs = self.direct(texts), self.reference.encode(texts, num_threads=self.threads)
            self.compared += len(texts)
            same[at] = [a == b for a, b in zip(ours, theirs, strict=True)]
            parts = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            for i, x in zip(at.tolist(), ours, strict=True):
                parts[i] = np.array(x, np.int32)
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bounds, same

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        ids, b = ids.tolist(), bounds.tolist()
        return self.tokenizer.decode_batch([ids[x:y] for x, y in zip(b[:-1], b[1:], strict=True)], skip_special_tokens=False)


    def restores(self, ids: np.ndarray, bounds: np.ndarray, texts: list[str | None]) -> list[bool]:
        """Whether decode() gives these texts; a null one is like an empty one.

        What ids show, one after another and without a first blank that the prefix made, is what the library decodes if it is
        UTF-8 throughout, as a text is. So where it is the text, so is what the library decodes; elsewhere the library is asked.
        """
        size = np.diff(self.shown_at)[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        raw = self.shown[np.repeat(self.shown_at[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        out, at, blank = [], ends[bounds].tolist(), self.model["dummy_prefix"]
        for a, b, text in zip(at[:-1], at[1:], texts, strict=True):
            out.append(raw[a + (a < b and blank and raw[a] == 32) : b] == (text or "").encode())
        if odd := [i for i, x in enumerate(out) if not x]:
            parts = [ids[bounds[i] : bounds[i + 1]] for i in odd]
            for i, text in zip(odd, self.decode(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])), strict=True):
                out[i] = text == (texts[i] or "")
        return out


def codec(path: str, threads: int) -> Codec:
    return common.worker_slot(("codec", path, threads), lambda: Codec(path, threads))


def encode(docs: DataFrame, model_path: str, threads: int = THREADS, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """docs with ids (array<int>; if asked), n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), decoded_ok
    (decoding gives the text back) and parity (same ids as the sentencepiece library). These names replace columns of docs.
    """
    made = ("ids", "n_tokens", "ids_crc32", "decoded_ok", "parity")
    rows = docs.drop(*made)
    more = ("ids array<int>, " if with_ids else "") + "n_tokens int, ids_crc32 long, decoded_ok boolean, parity boolean"
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", " + more

    def run(batches):
        coder = codec(model_path, threads)
        for batch in common.text_slices(batches, text_col, SLICE):
            text = batch.column(text_col)
            null = text.is_null()
            ids, bounds, same = coder.encode(text)
            raw = ids.astype("<u4").tobytes()
            b = bounds.tolist()
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(b[:-1], b[1:], strict=True)]
            ok = coder.restores(ids, bounds, text.to_pylist())
            out = {c: batch.column(c) for c in names}
            if with_ids:
                out["ids"] = pc.if_else(null, pa.scalar(None, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
            out |= {"n_tokens": pa.array(np.diff(bounds), pa.int32()), "ids_crc32": pa.array(crc, pa.int64()), "decoded_ok": pa.array(ok), "parity": pa.array(same)}
            yield pa.RecordBatch.from_pydict(out)

    return common.map_arrow(rows, run, schema, keeps=True, batch="4m")


def decode(docs: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded", threads: int = THREADS) -> DataFrame:
    """docs with the text that the ids stand for; null where the ids are null."""
    rows = docs.drop(out_col)
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{out_col}` string"

    def run(batches):
        coder = codec(model_path, threads)
        for batch in batches:
            ids = batch.column(ids_col).to_pylist()
            text = coder.tokenizer.decode_batch([x or [] for x in ids], skip_special_tokens=False)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in names} | {out_col: pa.array([None if x is None else t for x, t in zip(ids, text, strict=True)], pa.string())})

    return common.map_arrow(rows, run, schema, keeps=True)


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False).select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), "n_tokens", "ids_crc32", "decoded_ok", "parity")
