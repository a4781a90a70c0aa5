"""Intermediate tables in the folder that driver and executors share, to cut lineage so that lost executors lose nothing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset (tests), a local one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-"))
        named = sc.getCheckpointDir()
    return named


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Paths made within each call of settled() that runs.
_passing: list[list[str]] = []


def _at_exit(action) -> None:
    def clean() -> None:
        try:
            action()
        except Exception:  # noqa: BLE001  the session is gone; its owner clears the folder
            return

    atexit.register(clean)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tesserae-{label}-{uuid.uuid4().hex}"
    _at_exit(lambda: remove(spark, path))
    for paths in _passing:
        paths.append(path)
    return path


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go as soon as it has ended: for writes of plans that run once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again."""
    return _written(df, scratch(df.sparkSession, label))


def _written(df: DataFrame, path: str) -> DataFrame:
    with brief_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What make returns, stored; tables stored meanwhile go, as nothing reads them any more."""
    path, paths = scratch(spark, label), []
    _passing.append(paths)
    try:
        return _written(make(), path)
    finally:
        _passing.pop()
        for p in paths:
            remove(spark, p)


def bucketed(df: DataFrame, label: str, key: str, buckets: int) -> tuple[DataFrame, Callable[[], None]]:
    """df as a table of the warehouse, dealt by key, so that later joins on key don't shuffle it; and what drops it.

    Call that once nothing reads the table any more; at the latest, it goes when the driver's Python ends.
    """
    spark, name = df.sparkSession, f"tesserae_{label}_{uuid.uuid4().hex}"
    with brief_shuffles(spark):
        df.write.option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")

    _at_exit(drop)
    return spark.table(name), drop
