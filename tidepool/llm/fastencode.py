"""Encodes whole texts by encoding each distinct piece once with the tokenizers library.

Right where a tokenizer never looks across the pieces' borders; callers state why that holds for theirs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Distinct pieces kept in a worker; beyond it the store starts anew, so memory is bounded.
MOST_PIECES = 600_000


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as (all ids, how many each)."""
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((y for x in ids for y in x), np.int32, int(size.sum())), size


class PieceEncoder:
    """encode_many: pieces -> (all their ids, how many each)."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = MOST_PIECES):
        self.encode_many, self.most = encode_many, most
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.flat, self.used = np.zeros(4096, np.int32), 0

    def _add(self, pieces: list[str]) -> None:
        ids, sizes = self.encode_many(pieces)
        a, b, total = len(self.index), len(self.index) + len(pieces), len(ids)
        while b > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), total), np.int32)])
        self.size[a:b] = sizes
        self.start[a:b] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = ids
        self.used += total
        self.index.update(zip(pieces, range(a, b), strict=True))

    def places(self, distinct: list[str]) -> np.ndarray:
        """Where in the store these different pieces are; new ones are encoded."""
        if len(self.index) + len(distinct) > self.most and len(self.index):
            self.reset()
        get = self.index.get
        place = np.array([get(x, -1) for x in distinct], np.int32)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = np.arange(len(self.index), len(self.index) + len(new))
            self._add([distinct[i] for i in new.tolist()])
        return place

    def gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces at these places, where each piece's begin and the end)."""
        size = self.size[place].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        kind = np.int32 if max(ends[-1], self.used) < 1 << 31 else np.int64
        return self.flat[np.repeat((self.start[place] - ends[:-1]).astype(kind), size) + np.arange(ends[-1], dtype=kind)], ends

    def encode(self, pieces: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """pieces of all texts, and where each text's pieces begin (n + 1 numbers) -> (ids, where each text's ids begin)."""
        coded = pieces.dictionary_encode()
        place = self.places(coded.dictionary.to_pylist())
        ids, ends = self.gather(place[coded.indices.to_numpy(zero_copy_only=False)] if len(place) else np.zeros(0, np.int32))
        return ids, ends[bounds]

    def encode_list(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each piece's begin and the end)."""
        return self.encode(pa.array(pieces, pa.large_string()), np.arange(len(pieces) + 1))
