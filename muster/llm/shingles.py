"""Word shingles of texts as hashed sets, many texts at a time."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
WIDTH = 5
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """Word -> 64-bit hash, kept for the words of one worker up to a bound."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


_HASH = _Words()


def shingle_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document numbers, hashes): the hash of each run of WIDTH words, in the order of the texts."""
    words = [WORD.findall(t.lower()) for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    total = int(counts.sum())
    if total < WIDTH:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    flat = np.fromiter(map(_HASH.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=total)
    sh = np.zeros(total - WIDTH + 1, dtype=np.uint64)
    for k in range(WIDTH):
        sh += flat[k : k + len(sh)] * _MULT[k]
    doc = np.repeat(np.arange(len(texts)), counts)
    inside = doc[: len(sh)] == doc[WIDTH - 1 :]
    return doc[: len(inside)][inside], mix(sh[inside])


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct 32-bit hashes of each text's runs of WIDTH words; none for fewer words."""
    doc, sh = shingle_runs(texts)
    both = np.sort((doc.astype(np.uint64) << np.uint64(32)) | (sh >> np.uint64(32)))
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    ends = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    low = both.astype(np.uint32)
    return [low[a:b] for a, b in zip(ends[:-1], ends[1:])]
