"""Whole texts as byte arrays: words, word hashes and n-grams of a batch at once, in numpy.

UTF-8 bytes of other than ASCII characters are all 0x80 or more, so classes that
treat every such character alike can be read off the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; temporary arrays take some 100 times as much at most.
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text, so capitals are in the class.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: Words [^\x20\x09-\x0D]+.
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        for at, base in enumerate((int(_ODD), pow(int(_ODD), -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            p = np.cumprod(p, dtype=np.uint64)
            if len(_powers) > at:
                _powers[at] = p
            else:
                _powers.append(p)
    return _powers[0], _powers[1]


class Texts(NamedTuple):
    """Texts laid end to end: bytes, and n+1 offsets."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Places of words in the bytes; words of text i are first[i]:first[i+1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text(self) -> np.ndarray:
        """For each word, its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, Texts]]:
    """(from, to, bytes) of runs of whole texts, about ``limit`` bytes each; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    n = len(texts)
    if n == 0:
        return
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind, (_, offs, body) = (np.int64 if wide else np.int32), texts.buffers()
    offsets = np.frombuffer(offs, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def words(t: Texts, kind: np.ndarray) -> Words:
    """Runs of bytes of a class; a run ends where its text ends."""
    inside = kind[t.data]
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(t.offsets), np.int64))
    edge = np.zeros(n + 1, bool)
    edge[t.offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, t.offsets))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[: len(data)], dtype=np.uint64, out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def grams(h: np.ndarray, first: np.ndarray, k: int, gap: int = 1, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words, each ``gap`` after the one before, within a text; and the places of their first words."""
    reach = (k - 1) * gap
    n = len(h) - reach
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * _ODD + h[j * gap : j * gap + n]
    good = np.ones(n, bool)
    for j in range(1, reach + 1):  # places whose reach passes into the next text
        at = first[1:-1] - j
        good[at[(at >= 0) & (at < n)]] = False
    place = np.flatnonzero(good)
    return mix(total[place] + np.uint64(salt)), place
