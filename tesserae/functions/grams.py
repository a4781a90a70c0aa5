"""Word pairs of folded texts, counted in numpy: for tables whose texts are too long to fold and explode row by row.

Folding gives what text.normalize_text gives. A chunk of documents is one byte array with offsets and every step is a pass
over it, so memory is bounded by the chunk and the longest document.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from tesserae.functions.text import _FROM, _TO

_U = np.uint64
SPACE = 32
#: Bytes of texts that are folded at once, one document at least; bytes of pairs that are counted before they go on.
CHUNK_BYTES, HELD_BYTES = 1 << 20, 32 << 20
_RADIX = 0x9E3779B97F4A7C15
_ASCII = np.zeros(256, np.uint8)
_ASCII[:128] = SPACE
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _ASCII[_c] = _c
    _ASCII[ord(chr(_c).upper())] = _c
#: A random odd value for each byte, from which words are hashed.
_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) | _U(1)


def marks(spark: SparkSession) -> str:
    """All combining marks, as the JVM's version of Unicode has them (Python's may differ)."""
    points = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return spark._jvm.java.util.regex.Pattern.compile(r"\P{M}+").matcher(points).replaceAll("")


@functools.cache
def _points(marks: str) -> np.ndarray:
    """What each code point becomes: a letter or digit, SPACE, or 0 for a mark, which goes."""
    out = np.full(sys.maxunicode + 1, SPACE, np.uint8)
    out[[ord(c) for c in marks]] = 0
    for a, b in zip(_FROM, _TO, strict=True):
        out[ord(a)] = _ASCII[ord(b)] if b < "\x80" else SPACE
    out[[ord(c) for c in "đĐ"]] = ord("d")
    out[0x212A] = ord("k")  # its lower case is k
    return out


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64, for n positions."""
    up, down = np.full(n, _RADIX, _U), np.full(n, pow(_RADIX, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def folded(buf: np.ndarray, offsets: np.ndarray, marks: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 texts (the bytes from each offset to the next) as words of a-z and 0-9, one space for each run of others."""
    out = _ASCII[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        wide = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.uint32)
        a, b, c, d = (wide[lead + k] & m for k, m in enumerate((0xFF, 0x3F, 0x3F, 0x3F)))
        point = np.where(a < 0xE0, (a & 0x1F) << 6 | b, np.where(a < 0xF0, (a & 0xF) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d))
        out[lead] = _points(marks)[np.minimum(point, sys.maxunicode)]
        keep = out != 0
        out, offsets = out[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != SPACE) | (out[:-1] != SPACE)
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def pairs(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct pairs of neighbouring words of these folded texts, and in how many of the texts each is."""
    word = buf != SPACE
    begins, finishes = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    finishes[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    begins[inner] |= word[inner]
    finishes[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    doc = np.searchsorted(offsets, starts, side="right")
    first = np.flatnonzero(doc[1:] == doc[:-1])
    if not len(first):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    up, down = _powers(1 << int(len(buf)).bit_length())
    total = np.concatenate([np.zeros(1, _U), np.cumsum(_VALUES[buf] * up[: len(buf)])])
    h = _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))
    gram = _mix(h[first] * _U(0xD6E8FEB86659FD93) + h[first + 1])
    order = np.argsort(gram, kind="stable")  # of equal pairs, texts ascend
    gram, of = gram[order], doc[first[order]]
    new = np.append(True, gram[1:] != gram[:-1])
    head = np.flatnonzero(new)
    count = np.add.reduceat((new | np.append(True, of[1:] != of[:-1])).astype(np.int64), head)
    at = first[order[head]]
    size = ends[at + 1] - starts[at]
    edge = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.repeat(starts[at] - edge[:-1], size) + np.arange(edge[-1])]
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(data)), count


def counted(marks: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over one column of texts (binary): gram and n, in how many texts each pair of neighbouring words is; counts of a pair are still to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            texts = b.column(0).cast(pa.large_binary()).fill_null(b"")
            if not len(texts):
                continue
            _, offs, data = texts.buffers()
            offsets = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8)
            whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
            first = 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1)
                gram, n = pairs(*folded(whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], marks))
                held.append(pa.table({"gram": gram, "n": n}))
                size += held[-1].nbytes
                if size > HELD_BYTES:
                    held = [_summed(held)]
                    size = held[0].nbytes
                    if size > HELD_BYTES // 2:
                        yield from held[0].to_batches(1 << 16)
                        held, size = [], 0
                first = last
        if held:
            yield from _summed(held).to_batches(1 << 16)

    return run


def _summed(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).combine_chunks().group_by("gram", use_threads=False).aggregate([("n", "sum")])
    return out.rename_columns({"n_sum": "n"}).select(["gram", "n"]).combine_chunks()
