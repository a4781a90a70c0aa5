"""Vectorised word kernels over Arrow text: splitting, 64-bit word hashes and shingles.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. All separators are ASCII, so working on UTF-8 bytes gives
the same words as working on code points. Nothing here makes a Python object per word: a chunk of documents is one byte
array with offsets, and every step is a numpy pass over it. Callers feed chunks of a few MB, so memory is bounded by
the chunk and the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_RADIX = _U(0x9E3779B97F4A7C15 | 1)
_RADIX_INV = _U(pow(int(_RADIX), -1, 1 << 64))
CHUNK_BYTES = 2 << 20
#: Bytes whose words are hashed at once, the longest word at least: eight bytes of each, several times over.
HASHED_BYTES = 1 << 18


def _table(fold: bool) -> np.ndarray:
    """A random odd 64-bit value for each byte; with fold, A-Z share the values of a-z."""
    t = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) | _U(1)
    if fold:
        t[65:91] = t[97:123]
    return t


_TABLES = {True: _table(True), False: _table(False)}
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64, for n positions; kept and extended as needed."""
    if (have := len(_POWERS.get("up", ()))) < n:
        size = max(n, 2 * have, HASHED_BYTES + 1)
        for name, base in (("up", _RADIX), ("down", _RADIX_INV)):
            p = np.full(size, base, dtype=_U)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@dataclass
class Words:
    """Words of a chunk of documents: byte ranges in buf, and for document d the words bounds[d] to bounds[d + 1]."""

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def hashes(self, fold: bool = True) -> np.ndarray:
        out = np.empty(len(self.starts), _U)
        first = 0
        while first < len(out):  # blocks of whole words, so that memory follows HASHED_BYTES and the longest word
            begin = self.starts[first]
            last = max(first + 1, int(np.searchsorted(self.ends, begin + min(HASHED_BYTES, CHUNK_BYTES), side="right")))
            starts, ends = self.starts[first:last] - begin, self.ends[first:last] - begin
            part = self.buf[begin : begin + ends[-1]]
            up, down = _powers(len(part) + 1)
            total = np.empty(len(part) + 1, _U)
            total[0] = 0
            np.cumsum(_TABLES[fold][part] * up[:-1], out=total[1:])
            h = (total[ends] - total[starts]) * down[starts]
            out[first:last] = mix(h + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
            first = last
        return out


def split(buf: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(buf)
    word = ~SEPARATOR[buf]
    begins, finishes = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    finishes[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins[inner] |= word[inner]
    finishes[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return Words(buf, offsets, starts, ends, np.searchsorted(starts, offsets))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Documents first to last (exclusive) with their bytes and offsets from 0; nulls count as empty.

    A chunk holds whole documents: as many as fit into limit bytes, one at least.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words; for fewer words, of the whole run; none for no words."""
    if not len(h):
        return h
    size_here = min(size, len(h))
    n = len(h) - size_here + 1
    out = np.full(n, size_here * 0xA24BAED4963EE407 & (1 << 64) - 1, _U)
    for k in range(size_here):
        out = (out ^ h[k : k + n]) * _U(0x9FB21C651E98DF25)
        out ^= out >> _U(29)
    return mix(out)


def shingle_sets(words: Words, h: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each document, its distinct shingle hashes in ascending order."""
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        yield np.unique(shingles(h[a:b], size))


def text_shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    buf = np.frombuffer(text or b"", np.uint8)
    w = split(buf, np.array([0, len(buf)]))
    return np.unique(shingles(w.hashes(), size))
