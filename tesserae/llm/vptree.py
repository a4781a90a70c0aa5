"""Nearest neighbours by vantage-point trees, one for each shard.

A vantage-point tree of at most REGIONS leaves over a bounded sample (about SAMPLE rows, drawn by a hash) parts the space
into regions; every row is dealt to the region that it falls into, and regions of many rows are split by a hash of their
content into shards of about SHARD_ROWS. Each task takes its shard's vectors, builds a tree, and lets queries pass through
it in blocks. A query goes to its own region first; its kth distance there tells which other regions it can't leave out, and
only these see it. k rows for a query and shard leave a task, and a partial top-k joins them.

The triangle inequality lets a search skip the inside of a node when d(query, point) - radius exceeds the kth distance
found so far (and the outside likewise), within a tree and between regions. relax scales the skipped bound: skip if relax *
gap > kth distance. relax = 1 is exact; larger values skip more and may miss neighbours.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components take
no part; equal distances go to the smaller id; repeated rows are candidates of their own (the query's id is not); an id whose
rows are repeated is asked for once, with the smallest of its vectors; fewer than k candidates are all returned; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.common import stored, table

K = 10
QUERY_EVERY = 100
SHARD_ROWS = 8192
SAMPLE, REGIONS = 8192, 512
LEAF = 128
RELAX = 1.0


class Tree:
    """A vantage-point tree over the rows of x (float64). Nodes are (point, radius, inside, outside) or leaves of rows."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 7) -> None:
        self.x, self.leaf = x, leaf
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # Of a few candidates, the point whose distances spread most.
        some = self.x[self.rng.choice(rows, min(64, len(rows)), replace=False)]
        points = self.rng.choice(rows, 8, replace=False)
        spread = [np.var(_distances(self.x[p], some)) for p in points]
        point = int(points[int(np.argmax(spread))])
        rows = rows[rows != point]
        d = _distances(self.x[point], self.x[rows])
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all():  # many equal rows: halves of any kind keep the bounds right with the largest distance inside
            order = np.argsort(d, kind="stable")
            inside = np.zeros(len(rows), bool)
            inside[order[: len(rows) // 2]] = True
        lo, hi = d[inside], d[~inside]
        return point, float(lo.max()), float(hi.min()), self._build(rows[inside]), self._build(rows[~inside])

    def search(self, q: np.ndarray, k: int, ids: np.ndarray, own: np.ndarray, relax: float = RELAX, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and distances of the k nearest to each row of q, nearest first, ties to smaller ids; -1 where missing. Rows beyond a limit may be left out."""
        self.q, self.k, self.ids, self.own, self.relax = q, k, ids, own, relax
        self.limit = np.full(len(q), np.inf) if limit is None else limit
        self.best = np.full((len(q), k), np.inf)
        self.rows = np.full((len(q), k), -1)
        if len(self.x):
            self._visit(self.root, np.arange(len(q)))
        return self.rows, self.best

    def _offer(self, active: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
        """d: (active x rows) distances."""
        d = np.where(self.ids[rows][None, :] == self.own[active][:, None], np.inf, d)
        useful = (d <= self.best[active, -1][:, None]).any(axis=1) & np.isfinite(d).any(axis=1)
        if not useful.any():
            return
        active, d = active[useful], d[useful]
        every = np.concatenate([self.best[active], d], axis=1)
        which = np.concatenate([self.rows[active], np.where(np.isfinite(d), rows[None, :], -1)], axis=1)
        order = np.lexsort((np.where(which >= 0, self.ids[which], np.iinfo(np.int64).max), every), axis=1)[:, : self.k]
        self.best[active] = np.take_along_axis(every, order, 1)
        self.rows[active] = np.take_along_axis(which, order, 1)

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            if len(node):
                self._offer(active, node, _pairs(self.q[active], self.x[node]))
            return
        point, inner, outer, inside, outside = node
        d = _distances(self.x[point], self.q[active])
        self._offer(active, np.array([point]), d[:, None])
        near = d <= (inner + outer) / 2
        # The nearer side first; then the other for whom its bound does not exceed the kth distance found meanwhile.
        self._visit(inside, active[near & self._open(d - inner, active)])
        self._visit(outside, active[~near & self._open(outer - d, active)])
        self._visit(outside, active[near & self._open(outer - d, active)])
        self._visit(inside, active[~near & self._open(d - inner, active)])

    def _open(self, gap: np.ndarray, active: np.ndarray) -> np.ndarray:
        slack = 1e-9 * (1 + np.abs(gap))  # rounding never skips
        return self.relax * gap - slack <= np.minimum(self.best[active, -1], self.limit[active])


class Regions:
    """A vantage-point tree over a sample, whose leaves are numbered from 0: nodes are (vector, radius, inside, outside), leaves numbers."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7) -> None:
        self.leaves, self.rng = 0, np.random.default_rng(seed)
        self.root = self._build(sample, leaves)

    def _build(self, x: np.ndarray, leaves: int):
        if leaves > 1 and len(x) > 1:
            spread = [(np.var(d), k) for k in self.rng.choice(len(x), min(8, len(x)), replace=False) for d in (_distances(x[k], x),)]
            point = x[max(spread)[1]]
            d = _distances(point, x)
            radius = float(np.median(d))
            inside = d <= radius
            if not inside.all():
                return point, radius, self._build(x[inside], leaves // 2), self._build(x[~inside], leaves - leaves // 2)
        self.leaves += 1
        return self.leaves - 1

    def of(self, x: np.ndarray) -> np.ndarray:
        """The region of each row."""
        out = np.zeros(len(x), np.int64)

        def visit(node, rows: np.ndarray) -> None:
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                inside = _distances(node[0], x[rows]) <= node[1]
                visit(node[2], rows[inside])
                visit(node[3], rows[~inside])

        visit(self.root, np.arange(len(x)))
        return out

    def reached(self, q: np.ndarray, limit: np.ndarray, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, region) of all regions that may hold something within each row's limit."""
        found: list[tuple[np.ndarray, int]] = []

        def visit(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, int):
                found.append((rows, node))
                return
            gap = _distances(node[0], q[rows]) - node[1]
            slack = 1e-9 * (1 + np.abs(gap))
            visit(node[2], rows[relax * gap - slack <= limit[rows]])
            visit(node[3], rows[-relax * gap - slack <= limit[rows]])

        visit(self.root, np.arange(len(q)))
        return np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int64), np.concatenate([np.full(len(r), n) for r, n in found]) if found else np.zeros(0, np.int64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = b - a
    return np.sqrt((d * d).sum(axis=1))


def _pairs(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of all rows of q to all of x, from differences, so that equal vectors give equal values; in blocks."""
    out = np.empty((len(q), len(x)))
    step = max(1, (1 << 21) // max(1, x.size))
    for at in range(0, len(q), step):
        d = q[at : at + step, None, :] - x[None, :, :]
        out[at : at + step] = np.sqrt((d * d).sum(axis=2))
    return out


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    v = vector.cast("array<double>")
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = QUERY_EVERY, relax: float = RELAX, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest other rows of each row whose key is divisible by every: query_id, rank, key, score."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()  # one row: the usual length
    width, total = (sizes[0]["n"], sizes[0]["count"]) if sizes else (0, 0)
    rows = rows.filter(F.size("v") == width)
    # The smallest of an id's vectors asks for all its rows.
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    leaves = min(REGIONS, max(1, -(-total // shard_rows)))
    drawn = rows.filter(F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(1 << 20)) < min(1.0, SAMPLE / max(1, total)) * (1 << 20)) if leaves > 1 else rows.limit(0)
    regions = Regions(np.array([r["v"] for r in drawn.select("v").collect()]).reshape(-1, max(1, width)), leaves)  # about SAMPLE rows, whatever the input
    shared = vectors.sparkSession.sparkContext.broadcast(regions)  # at most REGIONS vectors

    def vectors_of(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.of(vectors_of(b.column(1))), pa.int64())], ["id", "v", "region"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other regions that each query has to see."""
        for b in batches:
            row, region = shared.value.reached(vectors_of(b.column(1)), b.column(3).to_numpy(), relax)
            other = region != b.column(2).to_numpy()[row]
            row, region = row[other], region[other]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(region, pa.int64()), b.column(3).take(pa.array(row))], ["id", "v", "region", "reach"])

    placed = stored(rows.mapInArrow(place, "id long, v array<double>, region long"), "placed")
    counts = {r["region"]: r["count"] for r in placed.groupBy("region").count().collect()}  # at most REGIONS rows
    parts = [max(1, -(-counts.get(n, 0) // shard_rows)) for n in range(regions.leaves)]
    numbers = lambda values: F.get(F.array(*(F.lit(int(x)) for x in values)), F.col("region").cast("int"))
    first, many = numbers(np.cumsum([0, *parts[:-1]])), numbers(parts)
    points = placed.select((first + F.pmod(F.xxhash64("id", "v"), many.cast("long"))).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", F.lit(0.0).alias("reach"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by shard and kind: a shard's points, then its queries, which stream through in batches."""
        shard, ids, held, tree = None, [], [], None
        for b in batches:
            shard_of, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(shard_of) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, b.num_rows], strict=True):
                if lo == hi:
                    continue
                if shard_of[lo] != shard:
                    shard, ids, held, tree = shard_of[lo], [], [], None
                own, limit, x = b.column(2).slice(lo, hi - lo).to_numpy(), b.column(3).slice(lo, hi - lo).to_numpy(), vectors_of(b.column(4).slice(lo, hi - lo))
                if kind[lo] == 0:
                    ids.append(own)
                    held.append(x)
                    continue
                if tree is None and held:
                    tree, all_ids, held = Tree(np.concatenate(held)), np.concatenate(ids), []
                if tree is None:
                    continue
                for at in range(0, len(own), 1024):
                    some = slice(at, at + 1024)
                    rows_found, d = tree.search(x[some], k, all_ids, own[some], relax, limit[some])
                    q, r = np.nonzero(rows_found >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(own[some][q]), pa.array(all_ids[rows_found[q, r]]), pa.array(d[q, r])], ["query_id", "id", "score"])

    def through(queries: DataFrame) -> DataFrame:
        """(query_id, id, score): the k nearest of each shard that queries (id, v, region, reach) are sent to."""
        sent = queries.select(F.explode(F.sequence(first.cast("int"), (first + many - 1).cast("int"))).alias("shard"), F.lit(1).alias("kind"), "id", "reach", "v")
        dealt = points.unionByName(sent).repartition(sum(parts), "shard").sortWithinPartitions("shard", "kind")
        return dealt.mapInArrow(run, "query_id long, id long, score double")

    best = Window.partitionBy("query_id").orderBy("score", "id")
    nearest = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    asked = stored(asked.mapInArrow(place, "id long, v array<double>, region long"), "asked")
    found = nearest(through(asked.withColumn("reach", F.lit(float("inf")))))
    if regions.leaves > 1:
        found = stored(found.drop("rank"), "found")
        reached = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.max("score")).otherwise(F.lit(float("inf"))).alias("reach"))
        farther = asked.join(reached, "id", "left").select("id", "v", "region", F.coalesce("reach", F.lit(float("inf"))).alias("reach")).mapInArrow(reach, "id long, v array<double>, region long, reach double")
        found = nearest(found.unionByName(through(farther)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
