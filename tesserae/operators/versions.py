"""Append-only versions: current and as-of states, diffs, numbering, revision trails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changed(pairs: list[tuple[Column, Column]]) -> Column:
    """Whether any pair differs; null equals null."""
    out = F.lit(False)
    for a, b in pairs:
        out = out | ~a.eqNullSafe(b)
    return out


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest order columns, by one aggregate of structs."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def as_of(df: DataFrame, keys: list[str], vintage: str, version: str, when: Column) -> DataFrame:
    """The state known at when: the latest vintage by then, its highest version."""
    return latest(df.filter(F.col(vintage) <= when), keys, [vintage, version])


def numbered(df: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Rows that change a field of their key, with version_no from 1 and the version before; re-observations are dropped."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(F.struct(*fields)).over(w)
    is_new = F.col("_before").isNull() | changed([(F.col(f), F.col(f"_before.{f}")) for f in fields])
    kept = df.withColumn("_before", before).filter(is_new).drop("_before")
    no = F.row_number().over(w)
    return kept.withColumn("version_no", no).withColumn("previous_version_no", F.when(F.col("version_no") > 1, F.col("version_no") - 1))


def backward_as_of(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str], tie: str) -> DataFrame:
    """left with the values of right's last row strictly before left_at, per by; ties of right_at by the largest tie.

    Both sides go through one sort per key: right's rows carry their values forward, left's take them. Linear in both
    sizes, where a range join would pair each left row with its whole history.
    """
    seen = F.struct(F.col(right_at), F.col(tie), *(F.col(v) for v in values))
    r = right.select(*by, F.col(right_at).alias("_at"), F.lit(1).alias("_side"), seen.alias("_v"))
    lt = left.select(*by, F.col(left_at).alias("_at"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_l"))
    # At equal times left rows come first, so that only what lies strictly before is seen.
    w = Window.partitionBy(*by).orderBy("_at", "_side", F.col(f"_v.{tie}")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = r.unionByName(lt, allowMissingColumns=True).withColumn("_seen", F.last("_v", ignorenulls=True).over(w)).filter("_side = 0")
    return both.select("_l.*", F.col(f"_seen.{right_at}").alias(right_at), *(F.col(f"_seen.{v}").alias(v) for v in values))
