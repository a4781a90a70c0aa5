"""Substring deduplication: paragraphs by MinHash banding, and passages inside paragraphs.

Paragraphs (lines, and blocks of lines between blank lines) of MIN_WORDS words or more are compared by MinHash: BANDS bands
of ROWS min-hashes over their word shingles (a pair at similarity 0.8 shares no band in 7 of 1000 cases; paragraphs of
three shingles or fewer, which only link where their sets are equal, need one band). Each paragraph is held against
the smallest of one of its bands; then ROUNDS times (but only while large bands have more than PAIRS pairs a paragraph, and the round before spared more), in large
bands whose members this left in different components, against one of each band's largest component; then, in all bands that are still so, against the others, unless parity signatures tell
that two differ too much. Exact Jaccard of 0.8 or more links; connected components are clusters. Because
shared passages also start and end inside lines, texts are cut at content-defined anchors too (the smallest k-word hash of
each window of WINDOW words), so that a passage of more than 50 words is cut alike wherever it stands. From each anchor, the
least run of whole pieces with RUN words or more is hashed as one: equal runs are clusters. Runs of one keeper that follow
each other are joined by word numbers, held against the keeper's text, and extended word by word to the ends of the match.

One scan of the texts makes both, as narrow rows (runs, and paragraphs with their bands); a second one reads what the
verification needs: shingles of paragraphs that collide, and the words around repeated runs.

A cluster keeps its copy in the smallest document id; copies in other documents are removed. Repetition within one
document is left alone. Paragraphs of fewer than MIN_WORDS words are removed only as part of a passage or block.

Defined results: null and empty texts have no paragraphs; of equal texts the one with the smallest id keeps its passages;
rows that share an id are one document whose repeated passages stand at the places found in any of them; rows with a null
id are left alone; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import words as W
from tesserae.llm.common import bucketed, fresh, stored, table, text_bytes
from tesserae.operators.graph import components

MIN_WORDS, RUN = 5, 18
#: A passage's first common anchor lies less than BEFORE words behind its start, its last run ends at most AFTER words before its end.
BEFORE, AFTER = 18, 36
#: Two numbers of a document's words or bytes in one long: the first before the lowest BITS bits, the second in them.
BITS = 31
LOW = (1 << BITS) - 1
WINDOW, GRAM = 16, 3
SHINGLE, BANDS, ROWS = 5, 7, 3
NUM, DEN = 80, 100
#: Rounds of leaders for bands of LARGE paragraphs or more, before what is left is held against each other.
ROUNDS, LARGE = 3, 16
#: No round is worth its joins where large bands have at most so many pairs for each paragraph of a band, nor another
#: one after a round that spared no more.
PAIRS = 2
_U = np.uint64
#: What spot holds of runs: the first of equal ones in a text, or a later one.
FIRST, AGAIN = -1, -2
#: Parity signatures have 64 bits for each of these columns.
_SIGNS = [f"s{j}" for j in range(4)]
_KEYS = [f"b{j}" for j in range(BANDS)]
_SEEDS = W.mix(np.arange(1, BANDS * ROWS + 1, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)


def anchors(h: np.ndarray) -> np.ndarray:
    """Word positions at which a document with these word hashes is cut, 0 first."""
    n = len(h) - GRAM + 1
    if n < 1:
        return np.zeros(1, np.int64)
    g = W.shingles(h, GRAM)
    if n <= WINDOW:
        return np.unique([0, int(np.argmin(g))])
    view = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
    return np.unique(np.concatenate([[0], np.arange(len(view)) + view.argmin(axis=1)]))


def _range_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the words from each first to each last (exclusive): sums of word hashes times powers of an odd base, counted from the range's start."""
    up, down = W._powers(len(h) + 1)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(h * up[: len(h)])])
    return W.mix((total[last] - total[first]) * down[first] + (last - first).astype(_U))


def _runs(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash, first word and number of words of each least run of whole pieces with RUN words or more. Texts are the words from each at to the next.

    All texts of a chunk are cut at once, as anchors() cuts each: those of RUN words have a window at least.
    """
    lo, hi = at[:-1], at[1:]
    long = np.flatnonzero(hi - lo >= RUN)
    if not len(long):
        return (np.zeros(0, np.int64),) * 4
    least = np.lib.stride_tricks.sliding_window_view(W.shingles(hashes, GRAM), WINDOW).argmin(axis=1)
    windows = hi[long] - lo[long] - GRAM - WINDOW + 2
    window = np.arange(windows.sum()) + np.repeat(lo[long] - np.cumsum(windows) + windows, windows)
    anchor = np.zeros(len(hashes) + 1, bool)
    anchor[window + least[window]] = anchor[lo[long]] = True
    start = np.flatnonzero(anchor)
    anchor[hi] = True
    cut = np.flatnonzero(anchor)
    doc = np.searchsorted(at, start, side="right") - 1
    end = cut[np.minimum(np.searchsorted(cut, start + RUN), len(cut) - 1)]
    held = np.flatnonzero((end >= start + RUN) & (end <= hi[doc]))
    doc, start, end = doc[held], start[held], end[held]
    return doc, _range_hashes(hashes, start, end).view(np.int64), start - lo[doc], end - start


def _paragraphs(w: W.Words, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and last word (exclusive) of lines, and of blocks of two or more lines; w is split at line breaks too."""
    full = np.flatnonzero(np.diff(w.bounds))
    doc = np.searchsorted(offsets, w.offsets[full], side="right") - 1
    head = np.flatnonzero(np.append(True, (np.diff(full) > 1) | (np.diff(doc) > 0)))[: len(full)]
    tail = np.append(head[1:], len(full)) - 1
    head, tail = head[tail > head], tail[tail > head]
    lo = np.concatenate([w.bounds[full], w.bounds[full[head]]])
    hi = np.concatenate([w.bounds[full + 1], w.bounds[full[tail] + 1]])
    doc = np.concatenate([doc, doc[head]])
    long = hi - lo >= MIN_WORDS
    return doc[long], lo[long], hi[long]


def _bands(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """BANDS keys of each paragraph of SHINGLE words or more (a row each)."""
    count = hi - lo - SHINGLE + 1
    edge = np.cumsum(count) - count
    s = W.shingles(hashes, SHINGLE)[np.repeat(lo - edge, count) + np.arange(count.sum())]
    keys = np.empty((len(count), BANDS), _U)
    for j in range(BANDS):
        key = np.full(len(count), j + 1, _U)
        for seed in _SEEDS[j * ROWS : (j + 1) * ROWS]:
            key = W.mix((key ^ np.minimum.reduceat(s * seed, edge)) * _U(0x9FB21C651E98DF25))
        keys[:, j] = key
    return keys


def scan(docs: DataFrame) -> DataFrame:
    """(h, id, place, spot, b0, ...) of runs and paragraphs. docs: id, raw.

    h is the hash of their words, place the number of their first word and their words. spot is the first byte and the bytes
    of a paragraph, and FIRST or AGAIN for a run. Keys of bands: null for runs; of the shortest paragraphs only the first.
    """
    names = ["h", "id", "place", "spot", *_KEYS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for first, _, buf, offsets in W.chunks(b.column(1)):
                w = W.split(buf, np.unique(np.concatenate([offsets, np.flatnonzero(buf == 10) + 1])))
                hashes, at = w.hashes(), np.searchsorted(w.starts, offsets)
                doc, h, start, size = _runs(hashes, at)
                if len(h):
                    order = np.argsort(h, kind="stable")  # of equal ones, texts and words ascend
                    new = np.append(True, (np.diff(h[order]) != 0) | (np.diff(doc[order]) != 0))
                    spot = np.full(len(h), AGAIN)
                    spot[order[new]] = FIRST
                    cols = [h, ids[first + doc], (start << BITS) + size, spot]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), *[pa.nulls(len(h), pa.int64())] * BANDS], names)
                doc, lo, hi = _paragraphs(w, offsets)
                if not len(doc):
                    continue
                begin, end = w.starts[lo], w.ends[hi - 1]
                cols = [_range_hashes(hashes, lo, hi).view(np.int64), ids[first + doc], (lo - at[doc] << BITS) + hi - lo, (begin - offsets[doc] << BITS) + end - begin]
                keys, few = _bands(hashes, lo, hi).view(np.int64), hi - lo < SHINGLE + 3
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), *(pa.array(keys[:, j], mask=few if j else None) for j in range(BANDS))], names)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def places(runs: DataFrame) -> DataFrame:
    """(id, word, words, keeper, there): runs of words that a document of a smaller id has too, from its word there on. runs: rows of scan()."""
    equal = Window.partitionBy("h")  # one shuffle and sort of all runs, most of which are alone
    there = F.min_by("place", F.when(F.col("spot") == FIRST, F.col("id"))).over(equal)
    found = runs.select("h", "id", "place", "spot").select("id", "place", F.min("id").over(equal).alias("keeper"), there.alias("there")).filter("id <> keeper")
    # Bounded by the document's own length. Begin and keeper's distance tell which runs are one.
    per_doc = found.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("place", "keeper", "there"))).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs that overlap or touch, in one keeper at the same distance, become one."""
        for b in batches:
            marks = b.column(1)
            ident = np.repeat(b.column(0).to_numpy(), pa.compute.list_value_length(marks).to_numpy())
            place, keeper, there = (marks.flatten().field(k).to_numpy() for k in range(3))
            begin, end, by = place >> BITS, (place >> BITS) + (place & LOW), (there >> BITS) - (place >> BITS)
            order = np.lexsort((begin, by, keeper, ident))
            ident, keeper, by, begin, end = (v[order] for v in (ident, keeper, by, begin, end))
            # Of equal key, runs ascend by begin; ends ascend with them, as each is the least run from its anchor.
            new = np.ones(len(ident), bool)
            new[1:] = (ident[1:] != ident[:-1]) | (keeper[1:] != keeper[:-1]) | (by[1:] != by[:-1]) | (begin[1:] > end[:-1])
            head = np.flatnonzero(new)
            if len(head):
                last = np.maximum.reduceat(end, head)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ident[head], begin[head], last - begin[head], keeper[head], begin[head] + by[head])], ["id", "word", "words", "keeper", "there"])

    return per_doc.mapInArrow(run, "id long, word long, words long, keeper long, there long")


def looked_up(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """What the verification needs of the texts. asked: (id, word, words, keeper, there) of runs, or (id, digest, spot) of paragraphs.

    For paragraphs: digest, shingles (ascending), and a signature, the parities of the shingles that fall on each bit. For runs:
    their asked columns, hash h, byte range, and the texts of BEFORE words before and AFTER words after.
    """
    numbers = ["word", "words", "keeper", "there", "digest", "spot"]
    grouped = asked.groupBy("id").agg(F.collect_list(F.struct(*numbers)).alias("asked"))
    names = ["digest", "shingles", *_SIGNS, "id", "word", "words", "keeper", "there", "h", "begin", "end", "left", "right"]
    of_set = 2 + len(_SIGNS)
    kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * (len(_SIGNS) + 8), pa.binary(), pa.binary()]

    def of_paragraphs(texts: list[bytes], digest: np.ndarray) -> pa.RecordBatch:
        sizes = np.cumsum([0, *map(len, texts)])
        w = W.split(np.frombuffer(b"".join(texts), np.uint8), sizes)
        count = np.diff(w.bounds) - SHINGLE + 1
        if count.min() < 1:  # rows that share an id may have other texts
            sets = [W.text_shingle_set(t, SHINGLE) for t in texts]
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        else:
            owner = np.repeat(np.arange(len(count)), count)
            flat = W.shingles(w.hashes(), SHINGLE)[np.arange(len(owner)) + np.repeat(w.bounds[:-1] - np.cumsum(count) + count, count)]
            order = np.lexsort((flat, owner))
            flat, owner = flat[order], owner[order]
            new = np.append(True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1]))
            flat, owner = flat[new], owner[new]
        bits = 64 * len(_SIGNS)
        odd = np.bincount(owner * bits + (flat & _U(bits - 1)).astype(np.int64), minlength=bits * len(texts)) & 1
        signs = np.packbits(odd.astype(bool)).view(np.int64).reshape(-1, len(_SIGNS))
        edges = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
        cols = [pa.array(digest), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.view(np.int64))), *(pa.array(x) for x in signs.T.copy())]
        return pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(texts), k) for k in kinds[of_set:])], names)

    def of_runs(raws: list[bytes], ids: list[int], asked: list[pa.Array]) -> pa.RecordBatch:
        buf, offsets = b"".join(raws), np.cumsum([0, *map(len, raws)])
        w = W.split(np.frombuffer(buf, np.uint8), offsets)
        doc = np.repeat(np.arange(len(raws)), [len(r) for r in asked])
        word, words, keeper, there = pa.concat_arrays(asked).flatten()[:4]
        low, high = w.bounds[doc], w.bounds[doc + 1]
        first = low + word.to_numpy()
        last = first + words.to_numpy()
        held = np.flatnonzero(last <= high)  # rows that share an id may have other texts
        low, high, first, last, doc = low[held], high[held], first[held], last[held], doc[held]
        h = _range_hashes(w.hashes(), first, last).view(np.int64)
        begin, end = w.starts[first], w.ends[last - 1]
        lead, trail = w.starts[np.maximum(first - BEFORE, low)], w.ends[np.minimum(last + AFTER, high) - 1]
        left, right = (pa.array([buf[x:y] for x, y in zip(a.tolist(), z.tolist(), strict=True)], pa.binary()) for a, z in ((lead, begin), (end, trail)))
        cols = [np.array(ids, np.int64)[doc], *(r.take(held) for r in (word, words, keeper, there)), h, begin - offsets[doc], end - offsets[doc]]
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(held), k) for k in kinds[:of_set]), *(pa.array(c, pa.int64()) for c in cols), left, right], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of some documents at once, as steps on few words cost more than the words.
        texts, digests, held = [], [], 0
        raws, ids, runs, size = [], [], [], 0
        for b in batches:
            for k in range(b.num_rows):
                raw, ident = b.column(1)[k].as_py(), b.column(0)[k].as_py()
                rows = b.column(2)[k].values
                told = rows.flatten()[4].is_valid()
                if told.true_count:
                    found = [raw[p >> BITS : (p >> BITS) + (p & LOW)] for p in rows.flatten()[5].filter(told).to_pylist()]
                    texts += found
                    digests.append(rows.flatten()[4].filter(told).to_numpy())
                    held += sum(map(len, found))
                    if held > 1 << 18:
                        yield of_paragraphs(texts, np.concatenate(digests))
                        texts, digests, held = [], [], 0
                if told.false_count:
                    raws.append(raw)
                    ids.append(ident)
                    runs.append(rows.filter(pa.compute.invert(told)) if told.true_count else rows)
                    size += len(raw)
                    if size > 1 << 18:
                        yield of_runs(raws, ids, runs)
                        raws, ids, runs, size = [], [], [], 0
        if texts:
            yield of_paragraphs(texts, np.concatenate(digests))
        if raws:
            yield of_runs(raws, ids, runs)

    schema = ", ".join(f"{n} {'array<long>' if n == 'shingles' else 'binary' if n in ('left', 'right') else 'long'}" for n in names)
    return docs.join(grouped, "id").select("id", "raw", "asked").mapInArrow(_merged(run), schema)


def _merged(run):
    """run with its small batches put together to a few MB each."""

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.nbytes
            if size > 4 << 20:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return several


def colliding(paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct paragraphs (digest, id and spot of one place, last id, keys), and (band, digest, x) of those that share a band, x its smallest.

    paragraphs: rows of scan().
    """
    texts = paragraphs.groupBy(F.col("h").alias("digest")).agg(F.min("id").alias("id"), F.min_by("spot", "id").alias("spot"), F.max("id").alias("last"), *(F.min(k).alias(k) for k in _KEYS))
    texts = stored(texts, "texts")
    banded = texts.select("digest", F.explode(F.array(*_KEYS)).alias("band")).filter("band is not null")
    band = Window.partitionBy("band")
    members = banded.select("band", "digest", F.min("digest").over(band).alias("x"), F.max("digest").over(band).alias("top")).filter("x < top").drop("top")
    return texts, stored(members, "members")


def clusters(texts: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(digest, keeper): paragraphs of clusters that span documents, and the smallest document of their cluster. sets: digest, shingles, signature."""
    # Dealt by digest once for all the joins below.
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    size = F.size("shingles").cast("long").alias("n")  # a column of its own, so that what asks for sizes reads no shingles
    sets, drop_sets = bucketed(sets.select("digest", "shingles", *_SIGNS, size).repartition(buckets, "digest").dropDuplicates(["digest"]), "sets", "digest", buckets)
    brief = lambda c: sets.select(F.col("digest").alias(c), *(F.col(s).alias(f"{s}_{c}") for s in _SIGNS), F.col("n").alias(f"n_{c}"))
    side = lambda c: sets.select(F.col("digest").alias(c), F.col("shingles").alias(f"of_{c}"))
    apart = " + ".join(f"bit_count({s}_x ^ {s}_y)" for s in _SIGNS)  # sets differ in as many shingles as parities at least
    needed = F.expr(f"{DEN + NUM} * ((n_x + n_y - ({apart})) div 2) >= {NUM} * (n_x + n_y)")
    common = F.size(F.array_intersect("of_x", "of_y"))
    alike = (DEN + NUM) * common >= NUM * (F.size("of_x") + F.size("of_y"))  # common once, as a join evaluates it wherever it stands
    linked = lambda pairs: pairs.join(side("x"), "x").join(side("y"), "y").filter(alike).select("x", "y")
    # Each paragraph against one leader first: that of most of its bands.
    led = members.filter("x <> digest").groupBy("x", "digest").agg(F.count("*").alias("bands")).groupBy(F.col("digest").alias("y")).agg(F.max_by("x", "bands").alias("x"))
    links = linked(led.join(brief("x"), "x").join(brief("y"), "y").filter(needed).select("x", "y"))
    found = components(links, "x", "y")

    def joined_by(more: DataFrame) -> DataFrame:
        """Components with more links: those found so far stand for the links before."""
        return components(found.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(more), "x", "y")

    def apart_in_bands() -> tuple[DataFrame, DataFrame]:
        """Members of bands whose members are in different components, with those, and of each such band its size and these ends."""
        own = members.join(found.withColumnRenamed("node", "digest"), "digest", "left").select("band", "digest", F.coalesce("component", "digest").alias("component"))
        own = stored(own, "own")
        return own, own.groupBy("band").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")

    own, bands = apart_in_bands()
    # A group whose smallest paragraph is like few of it: one of the largest component in each band leads the others of the band.
    most, before = PAIRS * members.count(), None
    for k in range(ROUNDS):
        big = bands.filter(F.col("size") >= LARGE)
        if (big.agg(F.sum(F.expr("size * (size - 1) div 2"))).first()[0] or 0) <= most:
            break
        large = stored(own.join(big.select("band"), "band", "left_semi"), "large")
        counts = large.groupBy("band", "component").agg(F.count("*").alias("size"), F.min_by("digest", F.xxhash64("digest", "band", F.lit(k))).alias("x"))
        # Pairs of different components only: those are held against each other.
        pairs = counts.groupBy("band").agg(F.expr("(sum(size) * sum(size) - sum(size * size)) div 2").alias("pairs")).agg(F.sum("pairs")).first()[0]
        if before is not None and before - pairs <= most:
            break
        before = pairs
        lead = counts.groupBy("band").agg(F.max(F.struct("size", "component", "x")).alias("lead")).select("band", "lead.x", F.col("lead.component").alias("led"))
        asked = large.join(lead, "band").filter("component <> led").select("x", F.col("digest").alias("y")).distinct()
        more = stored(linked(asked.join(brief("x"), "x").join(brief("y"), "y").filter(needed).select("x", "y")), "led")
        if more.isEmpty():
            break
        found = joined_by(more)
        own, bands = apart_in_bands()
    # Members that no leader brought into one component are held against each other, each pair once.
    held = stored(own.join(bands.select("band"), "band", "left_semi").join(sets.select("digest", *_SIGNS, "n"), "digest"), "held")
    a, b = (held.select("band", F.col("digest").alias(c), *(F.col(v).alias(f"{v}_{c}") for v in ("component", *_SIGNS, "n"))) for c in "xy")
    rest = a.join(b, "band").filter("x < y and component_x <> component_y").filter(needed).select("x", "y").distinct()
    found = joined_by(linked(rest))
    drop_sets()  # the rest reads stored tables only
    of = texts.select("digest", "id", "last").join(found.withColumnRenamed("node", "digest"), "digest", "left").filter("component is not null or id < last")
    of = of.withColumn("component", F.coalesce("component", "digest"))
    return of.join(of.groupBy("component").agg(F.min("id").alias("keeper")), "component").select("digest", "keeper")


def near_lines(paragraphs: DataFrame, texts: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, begin, end, word, words, keeper): paragraphs to remove, as another document has a near-equal one."""
    removed = clusters(texts, members, sets)
    marks = paragraphs.withColumnRenamed("h", "digest").join(removed, "digest").filter("id <> keeper")
    begin, size = F.shiftright("spot", BITS), F.col("spot").bitwiseAND(LOW)
    return marks.select("id", begin.alias("begin"), (begin + size).alias("end"), F.shiftright("place", BITS).alias("word"), F.col("place").bitwiseAND(LOW).alias("words"), "keeper")


def _common(own: pa.Array, there: pa.Array, most: int, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Words that the texts of each row have in common, of most from the start (back: from the end), and the bytes that they span in own, from its start (end)."""
    sides = []
    for column in (own, there):
        _, _, buf, offsets = next(W.chunks(column, 1 << 62), (0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        w = W.split(buf, offsets)
        steps = np.arange(most)
        at = w.bounds[1:, None] - 1 - steps if back else w.bounds[:-1, None] + steps
        held = (at >= w.bounds[:-1, None]) & (at < w.bounds[1:, None])
        sides.append((w, np.append(w.hashes(), _U(0))[np.where(held, at, -1)], held))
    (w, a, has), (_, b, have) = sides
    n = np.logical_and.accumulate((a == b) & has & have, axis=1).sum(axis=1)
    some, span = np.flatnonzero(n), np.zeros(len(n), np.int64)
    if back:
        span[some] = w.offsets[some + 1] - w.starts[w.bounds[some + 1] - n[some]]
    else:
        span[some] = w.ends[w.bounds[some] + n[some] - 1] - w.offsets[some]
    return n, span


def extended(seen: DataFrame) -> DataFrame:
    """(id, begin, end, word, words, keeper) of the runs that their keeper holds word by word, to the true ends of the match. seen: rows of looked_up()."""
    other = seen.filter("keeper is null").select(F.col("id").alias("keeper"), F.col("word").alias("there"), "words", "h", F.col("left").alias("left_there"), F.col("right").alias("right_there"))
    pairs = seen.filter("keeper is not null").join(other, ["keeper", "there", "words", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ident, begin, end, word, words, keeper = (c.to_numpy() for c in b.columns[:6])
            before, lead = _common(b.column(6), b.column(8), BEFORE, back=True)
            after, trail = _common(b.column(7), b.column(9), AFTER, back=False)
            cols = [ident, begin - lead, end + trail, word - before, words + before + after, keeper]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "begin", "end", "word", "words", "keeper"])

    return pairs.select("id", "begin", "end", "word", "words", "keeper", "left", "right", "left_there", "right_there").mapInArrow(run, "id long, begin long, end long, word long, words long, keeper long")


def removals(docs: DataFrame) -> DataFrame:
    """(id, begin, end, words, keeper): disjoint byte ranges of each document to remove. docs: id, raw.

    A range is a repeated passage that keeper holds word by word, or a near-equal paragraph of keeper's; where two of them
    overlap, the later one starts at the end of the earlier.
    """
    docs = docs.filter("id is not null")
    rows = stored(scan(docs), "scan")
    runs, paragraphs = rows.filter("spot < 0"), rows.filter("spot >= 0")
    found = stored(places(runs), "runs")
    texts, members = colliding(paragraphs)
    none = lambda *names: [F.lit(None).cast("long").alias(n) for n in names]
    kept = found.select(F.col("keeper").alias("id"), F.col("there").alias("word"), "words", *none("keeper", "there")).distinct()
    wanted = texts.join(members.select("digest").distinct(), "digest", "left_semi")
    asked = found.unionByName(kept).select("*", *none("digest", "spot")).unionByName(wanted.select("id", *none("word", "words", "keeper", "there"), "digest", "spot"))
    seen = stored(looked_up(docs, asked), "seen")
    sets, around = seen.filter("digest is not null").select("digest", "shingles", *_SIGNS), seen.filter("digest is null").drop("digest", "shingles", *_SIGNS)
    marks = extended(around).unionByName(near_lines(paragraphs, texts, members, sets))
    per_doc = marks.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("begin", (-F.col("end")).alias("end"), "keeper", "word", "words"))).alias("marks"))  # bounded by the document's own length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = b.column(1)
            doc = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(marks).to_numpy())
            begin, end, keeper, word, words = (marks.flatten().field(k).to_numpy() for k in range(5))
            end, last = -end, word + words
            top = np.maximum.accumulate((doc << BITS) + end)  # of a document's marks, those until here
            at = np.maximum(np.append(0, top)[:-1] - (doc << BITS), 0)
            taken = np.flatnonzero(end > at)
            doc, begin, end, word, last = doc[taken], np.maximum(at, begin)[taken], end[taken], word[taken], last[taken]
            told = np.where(np.append(True, doc[1:] != doc[:-1])[: len(doc)], 0, np.append(0, last)[:-1])  # words until the mark before
            cols = [b.column(0).to_numpy()[doc], begin, end, last - np.maximum(told, word), keeper[taken]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "begin", "end", "words", "keeper"])

    return per_doc.mapInArrow(run, "id long, begin long, end long, words long, keeper long")


def without(docs: DataFrame, ranges: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the ranges cut out of the text, each with the white space after it, and the ends trimmed; texts without a range stay as they are."""
    cuts, of = fresh(docs, "cuts", "cut_id")
    grouped = ranges.groupBy(F.col("id").alias(of)).agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias(cuts))
    joined = docs.join(grouped, F.col(key).cast("long") == F.col(of), "left").drop(of)

    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        def one(t: str | None, c: list[dict]) -> str:
            raw, out, at = (t or "").encode(), [], 0
            for r in c:
                out.append(raw[at : r["begin"]])
                at = r["end"]
                while at < len(raw) and raw[at] in b" \t\n\x0b\x0c\r":
                    at += 1
            out.append(raw[at:])
            return b"".join(out).decode("utf-8", "replace").strip()

        return pa.array([one(t.as_py(), c.as_py()) for t, c in zip(texts, ranges, strict=True)], pa.string())

    # Else filters on the text would be pushed below it, and each text cut twice, by twice the workers.
    cut = F.arrow_udf(cut, "string").asNondeterministic()
    touched = joined.filter(F.col(cuts).isNotNull()).withColumn(text, cut(F.col(text), F.col(cuts))).drop(cuts)
    return joined.filter(F.col(cuts).isNull()).drop(cuts).unionByName(touched)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return removals(docs.select(F.col(key).cast("long").alias("id"), text_bytes(F.col(text)).alias("raw")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each removed range: doc_id, its bytes in the UTF-8 text, its words, and the document that keeps a copy."""
    found = find(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "begin", "end", "words", F.col("keeper").alias("keep_doc_id"))
