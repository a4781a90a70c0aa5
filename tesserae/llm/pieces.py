"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The pass keeps, for each boundary of the text, the piece that ends the best segmentation up to there. Later pieces reach
back MAX piece characters at most, so only that many boundaries are alive; once all paths back from them share a
boundary, the pieces before it are final: they are emitted, and the window starts there.

Unigram models: the best path has the largest sum of scores. BPE models: a segmentation is what merging gives if and only
if merging each two neighbours by themselves gives back these two (merges inside final pieces never depend on what
stands outside), so exactly one piece can end each boundary's path, and the same pass gives SentencePiece's own ids.

Where no piece has a space mark after another character, paths always converge at a mark that follows a word, and the
ids of a word depend on the word alone. Texts still go through the pass part by part; at such a boundary, where one path is
left, it looks the next word up in a bounded table of words whose ids it has found before, and runs its window if there is
none.

Defined results: null and empty texts have no ids; equal texts have equal ids; a character outside the vocabulary gives
its byte pieces, or the unknown id where there are none. Decoding gives the text back, except that U+2581 and white
space that the model's own normalisation changes come back as spaces.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import table, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words, and neighbouring pieces (and beginnings of texts), whose answers a worker keeps; the longest such word and beginning.
#: Words met again since half of KEPT_WORDS others came stay.
KEPT_WORDS, KEPT_PAIRS, KEPT_LENGTH, KEPT_START = 120_000, 120_000, 64, 5
#: Characters of a text that are normalised at once.
PART = 1 << 16


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + n]
        at += n


class Model:
    """A SentencePiece model read from its file's bytes."""

    def __init__(self, data: bytes) -> None:
        self.kind, self.prefix, self.squeeze, self.escape = UNIGRAM, True, True, True
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        for n, value in _fields(data):
            if n == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", f.get(2, bytes(4)))[0])
                self.types.append(f.get(3, NORMAL))
            elif n == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif n == 3:
                f = dict(_fields(value))
                if f.get(2):
                    raise ValueError("models with a character map are not supported: normalise the text first")
                self.prefix, self.squeeze, self.escape = (bool(f.get(k, 1)) for k in (3, 4, 5))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} is not supported")
        self._prepare()

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], kind: int, prefix: bool = True, squeeze: bool = False) -> Model:
        """A model of the given (piece, score, type) rows, as tests need."""
        self = cls.__new__(cls)
        self.kind, self.prefix, self.squeeze, self.escape = kind, prefix, squeeze, True
        self.pieces, self.scores, self.types = (list(x) for x in zip(*pieces, strict=True))
        self._prepare()
        return self

    def _prepare(self) -> None:
        usable = (NORMAL, USER)
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in usable}
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        # By its last three characters, the lengths of the pieces that can end a text, longest first.
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                lengths.setdefault(p[-3:], {2, 1}).add(len(p))
        self._sizes = {end: tuple(sorted(of, reverse=True)) for end, of in lengths.items()}
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        self._fits: dict[int, bool] = {}
        self._starts: dict[str, tuple[str, int]] = {}
        self._kept: dict[str, bytes] = {}
        self._kept_before: dict[str, bytes] = {}
        self._merges: dict[str, tuple[list[float], list[str], list[str]] | None] = {}
        self._find = self._finder()
        self._text = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]
        if self.types:
            self._text[self.unknown] = " ⁇ ".encode()

    # -- segmentation -------------------------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """What merging gives for a short text: the best-scored joined pair first, the leftmost of equals."""
        ids, scores, parts = self.ids, self.scores, list(text)
        joined = [ids.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for k, i in enumerate(joined):
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = ids.get(parts[at - 1] + parts[at])
            if at < len(joined):
                joined[at] = ids.get(parts[at] + parts[at + 1])

    def merges(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """Scores of the merges that make a piece, in their order and with an end of -inf, and the first and last part before each; null if merging does not make it."""
        if piece in self._merges:
            return self._merges[piece]
        ids, scores, parts = self.ids, self.scores, list(piece)
        joined = [ids.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        steps, firsts, lasts = [], [parts[0]], [parts[-1]]
        while True:
            best, at = -np.inf, -1
            for k, i in enumerate(joined):
                if i is not None and scores[i] > best:
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = ids.get(parts[at - 1] + parts[at])
            if at < len(joined):
                joined[at] = ids.get(parts[at] + parts[at + 1])
            steps.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        out = ([*steps, -np.inf], firsts, lasts) if len(parts) == 1 else None
        if piece in ids:
            self._merges[piece] = out
        return out

    def fits(self, left: str, right: str) -> bool:
        """Whether merging leaves right as one piece after left, or by itself where left is empty.

        Both merge as if alone unless, at some step, what joins the parts at their border scores best (the leftmost of equals).
        """
        known = self._merges.get(right) or self.merges(right)
        if known is None or not left:
            return known is not None
        after, firsts, _ = known
        known = self._merges.get(left) or self.merges(left)
        if known is None:
            return False
        before, _, lasts = known
        ids, scores, i, j = self.ids.get, self.scores, 0, 0
        while True:
            a, b = before[i], after[j]
            across = ids(lasts[i] + firsts[j])
            if across is not None and b <= scores[across] > a:
                return False
            if a >= b:
                if a == -np.inf:
                    return True
                i += 1
            else:
                j += 1

    def window(self, parts: Iterable[str]) -> Iterator[str]:
        """Pieces of the text whose consecutive parts are given, each emitted as soon as it is final."""
        if self.kind != BPE:
            return self._unigram_window(parts)
        outside = len(self.pieces) + 1
        return (self.pieces[n] if n < outside else chr(n - outside) for n in self._bpe_window(parts))

    def _bpe_window(self, parts: Iterable[str]) -> Iterator[int]:
        """Numbers of the pieces; a character outside the vocabulary has one beyond it."""
        longest, find = self.longest, self._find
        # Of the window: characters, the piece that ends at each boundary (null where nothing has asked for it) and its number;
        # low: the first live boundary.
        text, back, code, low = "", [""], [len(self.pieces)], 0
        opening = KEPT_START  # until the first cut, the back pointers of the text's first boundaries may be known
        for part in parts:
            for at in range(0, len(part), 4 * longest):
                more = part[at : at + 4 * longest]
                text += more
                back += [None] * len(more)
                code += [0] * len(more)
                if len(text) <= 6 * longest:
                    continue
                for end in range(len(text) - longest + 1, len(text) + 1):
                    if back[end] is None:
                        find(text, back, code, low, opening, end)
                common = self._common(back, longest)
                if common:
                    yield from self._numbers(back, code, common)[:-1]
                    # The last final piece stays before the window, as the next is held against it.
                    last = back[common]
                    low = len(last)
                    cut, opening = common - low, 0
                    text, code = text[cut:], code[cut:]
                    back[:] = [None] * low + back[common:]
                    back[low] = last
        if back[len(text)] is None:
            find(text, back, code, low, opening, len(text))
        yield from self._numbers(back, code, len(text))

    def _finder(self) -> Callable[[str, list[str | None], list[int], int, int, int], None]:
        """What finds the back pointer of a boundary of a window, and those it asks for."""
        ids, fits, sizes, few, starts, outside, agree = self.ids.get, self._fits, self._sizes.get, (2, 1), self._starts, len(self.pieces) + 1, self.fits

        def find(text: str, back: list[str | None], code: list[int], low: int, opening: int, end: int) -> None:
            if end <= opening:
                key = text[:end]
                if known := starts.get(key):
                    back[end], code[end] = known
                    if back[end - len(known[0])] is None:
                        find(text, back, code, low, opening, end - len(known[0]))
                    return
            for size in sizes(text[end - 3 if end > 3 else 0 : end], few):
                begin = end - size
                if begin < low:
                    continue
                piece = text[begin:end]
                number = ids(piece)
                if number is None:
                    if size > 1:
                        continue
                    number = outside + ord(piece)
                if back[begin] is None:
                    find(text, back, code, low, opening, begin)
                pair = code[begin] << 24 | number
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) >= KEPT_PAIRS:
                        fits.clear()
                    ok = fits[pair] = agree(back[begin], piece)
                if ok:
                    back[end], code[end] = piece, number
                    break
            if end <= opening:
                if len(starts) >= KEPT_PAIRS:
                    starts.clear()
                starts[key] = back[end], code[end]

        return find

    def _unigram_window(self, parts: Iterable[str]) -> Iterator[str]:
        ids, scores, sizes, few, longest = self.ids, self.scores, self._sizes.get, (2, 1), self.longest
        # Of the window: characters, the piece that ends at each boundary, and its path's score.
        text, back, total = "", [""], [0.0]
        for part in parts:
            for at in range(0, len(part), 4 * longest):
                text += part[at : at + 4 * longest]
                for end in range(len(back), len(text) + 1):
                    best, score = None, -np.inf
                    for size in sizes(text[max(0, end - 3) : end], few):
                        begin = end - size
                        if begin < 0 or back[begin] is None:
                            continue
                        piece = text[begin:end]
                        known = ids.get(piece)
                        if known is None and size > 1:
                            continue
                        s = total[begin] + (self.worst if known is None else scores[known])
                        if s > score:
                            best, score = piece, s
                    back.append(best)
                    total.append(score)
                if len(text) > 2 * longest:
                    common = self._common(back, longest)
                    if common:
                        yield from self._path(back, common)
                        text, back, total = text[common:], back[common:], [t - total[common] for t in total[common:]]
                        back[0] = ""
        yield from self._path(back, len(text))

    def stream(self, parts: Iterable[str]) -> Iterator[bytes]:
        """Ids (as 32-bit numbers) of the normalised text whose consecutive parts are given, each as soon as it is final."""
        if not self.by_word or not self.bytes:
            yield np.array(self._ids_of(self.window(parts)), np.int32).tobytes()
            return
        kept, settled, words, rest = self._kept.get, self._settled, re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall, ""
        for part in parts:
            found = words(rest + part)
            rest = found.pop()  # goes on, unless a mark follows
            yield b"".join([kept(word) or settled(word) for word in found])
        if rest:
            yield kept(rest) or settled(rest)

    def _settled(self, word: str) -> bytes:
        """Ids of a text between two boundaries on which all paths converge."""
        if ids := self._kept_before.get(word):
            pass
        elif self.kind == BPE:
            outside, found = len(self.pieces) + 1, array("i")
            if len(word) <= 6 * self.longest:  # the window holds all of it
                n = len(word)
                back, code = ["", *[None] * n], [outside - 1, *[0] * n]
                self._find(word, back, code, 0, KEPT_START, n)
                numbers = self._numbers(back, code, n)
            else:
                numbers = self._bpe_window([word])
            for n in numbers:
                if n < outside:
                    found.append(n)
                else:
                    found.extend(self.bytes[b] for b in chr(n - outside).encode())
            ids = found.tobytes()
        else:
            ids = array("i", self._ids_of(self.window([word]))).tobytes()
        if len(word) <= KEPT_LENGTH:
            if len(self._kept) >= KEPT_WORDS // 2:
                # Those that streams look up in are these two tables for good.
                self._kept_before.clear()
                self._kept_before.update(self._kept)
                self._kept.clear()
            self._kept[word] = ids
        return ids

    @staticmethod
    def _numbers(back: list[str | None], code: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(code[end])
            end -= len(back[end])
        return out[::-1]

    @staticmethod
    def _path(back: list[str | None], end: int) -> list[str]:
        out = []
        while end:
            out.append(back[end])
            end -= len(back[end])
        return out[::-1]

    @staticmethod
    def _common(back: list[str | None], longest: int) -> int:
        """The last boundary on every path from the boundaries that later pieces can start at; 0 if there is none."""
        ends = {e for e in range(max(1, len(back) - longest), len(back)) if back[e] is not None}
        while len(ends) > 1:
            last = max(ends)
            ends.discard(last)
            ends.add(last - len(back[last]))
        return ends.pop() if ends else 0

    # -- encoding -----------------------------------------------------------------------------------------------------

    def normalised(self, text: str) -> Iterator[str]:
        """Parts, none empty, of the normalised text."""
        begun = gap = False
        for at in range(0, len(text), PART):
            part = text[at : at + PART]
            if self.squeeze:
                lead, tail = part[0] == " ", part[-1] == " "
                part = re.sub(" +", " ", part).strip(" ")
                if not part:
                    gap = True
                    continue
                if begun and (gap or lead):
                    part = " " + part
                gap = tail
            if self.prefix and not begun:
                part = " " + part
            begun = True
            yield part.replace(" ", MARK) if self.escape else part

    def _ids_of(self, pieces: Iterable[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.stream(self.normalised(text))), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        out = b"".join(map(self._text.__getitem__, ids))
        return (out[1:] if self.prefix and out[:1] == b" " else out).decode("utf-8", "replace")


_MODELS: dict[bytes, Model] = {}


def _model(data: bytes) -> Model:
    if data not in _MODELS:
        _MODELS.clear()
        _MODELS[data] = Model(data)
    return _MODELS[data]


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", model: str = MODEL) -> DataFrame:
    """key, ids, n_ids, and whether decoding the ids gives the text back."""
    spark = df.sparkSession
    with open(model, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())  # a vocabulary file, under a MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(data.value)
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                texts = [x.decode("utf-8", "replace") for x in part.column(1).to_pylist()]
                ids = [m.encode(t) for t in texts]
                same = [m.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)]
                sizes = np.array([len(i) for i in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes), pa.array(same)], ["key", "ids", "n_ids", "round_trip"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), text_bytes(F.col(text)).alias("raw")).mapInArrow(run, f"key {kind}, ids array<int>, n_ids long, round_trip boolean")
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, ids: str = "ids", key: str = "doc_id", model: str = MODEL) -> DataFrame:
    """key and text for each list of ids; null ids give an empty text."""
    with open(model, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(data.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
