"""Graph operators: connected components, bounded root walks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.similar import forest
from tesserae.sources.scratch import stored

#: So many links between whole numbers are finished in one task.
FEW = 1 << 20


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) of every node that has an edge to another one.

    Alternating large-star and small-star: each pass hangs a node's neighbours on its smallest one, so that paths halve.
    Neighbours are never gathered: a pass is a minimum per node (partial aggregates) and a join back, and it ends with a
    table in the shared folder. Passes end once all are stars, which takes none if edges are. FEW links need no passes, as
    one task can hold them. Null ends and loops are ignored.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    links = ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = stored(links, "links")
    kinds = {f.dataType.typeName() for f in links.schema.fields}
    if kinds <= {"byte", "short", "integer", "long"} and links.count() <= FEW:
        return _in_a_task(links)
    while not _stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        links = stored(small, "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _in_a_task(links: DataFrame) -> DataFrame:
    """node and component, from FEW links at most."""
    kind = links.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not ends:
            return
        root, node, _ = forest(*(np.concatenate(e).astype(np.int64) for e in zip(*ends, strict=True)), np.zeros(0))
        own = np.unique(root)
        node, root = np.concatenate([node, own]), np.concatenate([root, own])
        for k in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)], pa.int64()) for x in (node, root)], ["node", "component"])

    found = stored(links.coalesce(1).mapInArrow(run, "node long, component long"), "components")
    return found.select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))


def _stars(links: DataFrame) -> bool:
    """Whether each node u has one edge, to a node v that has none of its own."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()[0]


def roots(edges: DataFrame, max_hops: int = 8) -> DataFrame:
    """child, root and hops of each child. edges: one row (child, parent) a child, parent null at an origin.

    Pointer jumping: each join doubles the hops that a pointer spans, so that max_hops (a power of two) takes its
    logarithm of joins; a parent that has no row of its own is as far as a walk goes, and cycles end at max_hops.
    """
    up = edges.select("child", F.coalesce("parent", "child").alias("root"), F.col("parent").isNotNull().cast("int").alias("hops"))
    span = 1
    while span < max_hops:
        nxt = up.select(F.col("child").alias("_c"), F.col("root").alias("_r"), F.col("hops").alias("_h"))
        up = up.join(nxt, F.col("root") == F.col("_c"), "left").select("child", F.coalesce("_r", "root").alias("root"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"))
        span *= 2
    return up


def ancestors(edges: DataFrame, max_hops: int = 8) -> DataFrame:
    """child, ancestor and depth of all ancestors within max_hops. edges: one row (child, parent) a child, parent null at an origin.

    Each pass follows the farthest ancestors one edge up, as a frontier that shrinks; a child has max_hops rows at most.
    """
    up = edges.filter("parent is not null").select(F.col("child").alias("ancestor"), F.col("parent").alias("_next"))
    frontier = edges.filter("parent is not null").select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    out = frontier
    for depth in range(2, max_hops + 1):
        frontier = frontier.join(up, "ancestor").select("child", F.col("_next").alias("ancestor"), F.lit(depth).alias("depth"))
        out = out.unionByName(frontier)
    return out
