"""Sets that are similar by Jaccard, exactly: rows meet on their rarest shared members, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.sources.scratch import stored

#: A member's sets are held against each other in tiles of so many; columns of a tile's matrices.
BLOCK, COLUMNS = 1024, 4096
#: A list is dealt as up to SPREAD blocks of one tile, then of more tiles, up to MOST sets, so that each set is copied SPREAD times at most.
SPREAD, MOST = 8, 16384
#: Groups of up to so many sets are compared set by set.
SMALL = 24

Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def every(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> Pairs:
    return a, b, sim


def forest(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> Pairs:
    """Pairs that link the same nodes as those given, at most one a node; sim is that of no pair."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (x, y):
            np.minimum.at(new, end, low)
            np.minimum.at(new, root[end], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[linked]], nodes[linked], np.zeros(len(linked))


def senior(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> Pairs:
    """The pair of each b with the greatest sim, of those with the smallest a."""
    order = np.lexsort((a, -sim, b))
    first = order[np.flatnonzero(np.r_[True, b[order][1:] != b[order][:-1]])] if len(order) else order
    return a[first], b[first], sim[first]


def similar(sets: DataFrame, least: float, keep: Callable[..., Pairs] = every) -> DataFrame:
    """(a, b, sim): pairs a < b of rows (rep, sh) whose Jaccard, rounded to six digits, is least or more; reps differ, as do members of a set.

    Members of several sets get numbers, rare ones first. A set of n is listed under those of its first n - ceil(least n) + 1
    members that it shares with any set; two sets that reach least meet in the list of their rarest shared member, and are told
    only there. Lists are dealt as pairs of blocks, so that no task depends on the length of one, and a pair leaves its block
    only if it reaches least. Up to SPREAD x MOST sets in a list, what is dealt grows as the sets do. keep is what remains of
    the pairs of two blocks: every one, or fewer where the caller needs fewer.
    """
    least -= 5e-7  # what rounds to it
    members = sets.select("rep", F.size("sh").alias("n"), F.explode("sh").alias("s"))
    shared = members.groupBy("s").agg(F.count("*").alias("c")).filter("c > 1")
    shared = stored(shared.select("s", (F.least("c", F.lit(1023)) * F.lit(1 << 53) + F.monotonically_increasing_id()).alias("code")), "shared")
    numbered = members.join(shared, "s").groupBy("rep", "n").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    first = (F.size("codes") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int")  # the n - size(codes) members of one set alone come before
    listed = stored(numbered.filter(first > 0).select("rep", "n", "codes", F.explode(F.slice("codes", F.lit(1), first)).alias("h")), "listed")
    met = listed.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h", _blocks(F.col("c")).alias("blocks"))
    own = listed.join(met, "h").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("h", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "n", "codes")

    tile = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, sim in _found(batches, least, keep, tile):
            for k in range(0, len(a), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(a[part], pa.int64()), pa.array(b[part], pa.int64()), pa.array(sim[part], pa.float64())], ["a", "b", "sim"])

    found = dealt.repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi").mapInArrow(run, "a long, b long, sim double")
    kind = sets.schema["rep"].dataType
    return found.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "sim")


def _blocks(c: Column) -> Column:
    """The blocks of a list of c sets."""
    return F.greatest(F.least(F.ceil(c / BLOCK), F.lit(SPREAD)), F.ceil(c / MOST)).cast("int")


def _found(batches: Iterator[pa.RecordBatch], least: float, keep: Callable[..., Pairs], tile: int) -> Iterator[Pairs]:
    """What keep leaves of the pairs of each unit (h, lo, hi), whose rows follow each other."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rest.append(batch)
        table = pa.Table.from_batches(rest).combine_chunks()
        ends = _ends(table)
        if len(ends):  # the last unit may go on in the next batch
            yield from _units(table.slice(0, ends[-1]), least, keep, tile)
        rest = table.slice(ends[-1] if len(ends) else 0).to_batches()
    if rest:
        yield from _units(pa.Table.from_batches(rest).combine_chunks(), least, keep, tile)


def _ends(table: pa.Table) -> np.ndarray:
    """Rows at which another unit begins."""
    keys = [table[c].to_numpy() for c in ("h", "lo", "hi")]
    return np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1


def _units(table: pa.Table, least: float, keep: Callable[..., Pairs], tile: int) -> Iterator[Pairs]:
    h, lo, hi, block, rep, n = (table[c].to_numpy() for c in ("h", "lo", "hi", "block", "rep", "n"))
    codes = table["codes"].combine_chunks()
    codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
    at, values = codes.offsets.to_numpy(), codes.values.to_numpy()
    few: list[tuple] = []
    cuts = np.r_[0, _ends(table), len(table)]
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if j - i < 2:
            continue
        if j - i > SMALL or lo[i] != hi[i]:
            found = (keep(*_pairs(rep[x], rep[y], both, n[x], n[y])) for x, y, both in _tiles(h[i], i + np.flatnonzero(block[i:j] == lo[i]), i + np.flatnonzero(block[i:j] == hi[i]), n, at, values, least, tile))
            if keep is every:
                yield from found
            elif kept := list(found):  # at most a pair or two a set of each tile
                yield keep(*(np.concatenate(c) for c in zip(*kept, strict=True)))
            continue
        sets = [(set(values[at[k] : at[k + 1]].tolist()), int(n[k]), rep[k]) for k in range(i, j)]
        for k, (one, size, r) in enumerate(sets):
            for two, size2, r2 in sets[k + 1 :]:
                common = one & two
                if len(common) >= least * (size + size2 - len(common)) and min(common) == h[i]:
                    few.append((r, r2, len(common), size, size2))
    if few:
        yield keep(*_pairs(*(np.array(c) for c in zip(*few, strict=True))))


def _pairs(x: np.ndarray, y: np.ndarray, both: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> Pairs:
    sim = both / (nx.astype(np.int64) + ny - both)
    return np.minimum(x, y), np.maximum(x, y), np.floor(sim * 1e6 + 0.5) / 1e6


def _tiles(h: int, left: np.ndarray, right: np.ndarray, n: np.ndarray, at: np.ndarray, values: np.ndarray, least: float, tile: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What _large() finds between rows left and right of a unit, which are other ones or the same, for tile of both at a time."""
    same = np.array_equal(left, right)
    for p in range(0, len(left), tile):
        for q in range(p if same else 0, len(right), tile):
            own = same and p == q
            rows = left[p : p + tile] if own else np.concatenate([left[p : p + tile], right[q : q + tile]])
            side = np.zeros(len(rows), np.int64)
            if not own:
                side[len(left[p : p + tile]) :] = 1
            count = at[rows + 1] - at[rows]
            edge = np.concatenate([[0], np.cumsum(count)])
            taken = values[np.arange(edge[-1]) + np.repeat(at[rows] - edge[:-1], count)]
            x, y, both = _large(h, side, 0, 0 if own else 1, n[rows], edge, taken, least)
            if len(x):
                yield rows[x], rows[y], both


def _large(h: int, block: np.ndarray, lo: int, hi: int, n: np.ndarray, at: np.ndarray, values: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers x and y and shared members of a unit's pairs that reach least and share nothing rarer than h, by products of 0/1 matrices."""
    own = values[at[0] : at[-1]]
    row = np.repeat(np.arange(len(n)), np.diff(at))
    known, column, count = np.unique(own, return_inverse=True, return_counts=True)
    useful = count > 1  # others are shared by no pair of the unit
    column, row = (np.cumsum(useful) - 1)[column[useful[column]]], row[useful[column]]
    known = known[useful]
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]

    def product(begin: int, end: int) -> np.ndarray:
        total = np.zeros((len(left), len(right)), np.float32)  # whole numbers far below 2 ** 24
        for k in range(begin, end, COLUMNS):
            part = slice(*np.searchsorted(column, [k, min(k + COLUMNS, end)]))
            m = np.zeros((len(n), min(COLUMNS, end - k)), np.float32)
            m[row[part], column[part] - k] = 1
            total += m[left] @ m[right].T
        return total

    place = int(np.searchsorted(known, h))
    told = product(0, place) > 0  # at a rarer member
    if lo == hi:
        told |= np.tri(len(left), dtype=bool)
    if told.all():
        return left[:0], left[:0], left[:0]
    both = product(place, len(known))
    union = n[left][:, None] + n[right][None, :] - both.astype(np.int64)
    x, y = np.nonzero(~told & (both >= least * union))
    return left[x], right[y], both[x, y].astype(np.int64)
