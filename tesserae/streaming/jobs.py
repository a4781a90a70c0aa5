"""Structured Streaming: file streams of events, windowed counts, deduplication, incremental versions with exactly-once merges.

High-water marks are the streams' checkpoints; late rows within the watermark count, later ones are dropped by the state
store; effects are keyed by deterministic ids, so that a batch that runs twice changes nothing.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.sources.scratch import scratch

#: As a pattern, since a stream's path that is no pattern has to be a folder, and the table may be one file.
TABLE = "event[s].parquet"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet files of a folder as a stream, with event time in `at`."""
    r = spark.readStream.schema(EVENTS)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "3 days") -> DataFrame:
    """Count and sum of each type and window."""
    w = events.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def unique(events: DataFrame, key: str = "event_id", late: str = "3 days") -> DataFrame:
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def fresh_only(events: DataFrame, now, days: int = 3) -> DataFrame:
    """The signals' lateness gate against a given clock."""
    return events.filter(F.col("at") >= now - F.expr(f"INTERVAL {days} DAYS"))


def to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Keeps the latest row of each key: every batch writes generation n from n - 1 and itself; a repeated batch rewrites the same n."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        old = f"{path}/generation={n - 1}"
        rows = batch
        if n > 0 and _exists(spark, old):
            rows = spark.read.parquet(old).unionByName(batch)
        rest = [c for c in batch.columns if c not in keys]
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))
        best.write.mode("overwrite").parquet(f"{path}/generation={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def newest_generation(spark: SparkSession, path: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("generation=")]
    return spark.read.parquet(f"{path}/generation={max(int(n.split('=')[1]) for n in names)}")


def run_available(spark: SparkSession, sf_dir: str, build, mode: str = "append", label: str = "stream") -> DataFrame:
    """All of a stream's input now, through build(events), to Parquet in the shared folder."""
    path = scratch(spark, label)
    query = to_parquet(build(event_stream(spark, f"{sf_dir}/{TABLE}")), f"{path}/out", f"{path}/checkpoint", mode)
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_available(spark, sf_dir, unique, label="dedupe")
    return out.select("event_id", "event_type", "value")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event, kept by merges of micro-batches."""
    path = scratch(spark, "latest")
    stream = event_stream(spark, f"{sf_dir}/{TABLE}", 1).select("user_id", "ts", "event_id", "event_type", "value")
    upsert_latest(stream, f"{path}/state", f"{path}/checkpoint", ["user_id"], ["ts", "event_id"]).awaitTermination()
    return newest_generation(spark, f"{path}/state").select("user_id", "event_id", "event_type", "value")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of a finished stream, open windows included (complete mode: one row a type and day)."""
    path = scratch(spark, "tumbling")
    stream = tumbling(event_stream(spark, f"{sf_dir}/{TABLE}"))
    name = f"tumbling_{os.path.basename(path).rsplit('-', 1)[-1]}"
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/checkpoint").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


QUERIES = {"stream_dedupe": stream_dedupe, "stream_latest": stream_latest, "stream_tumbling": stream_tumbling}
ORACLE_SQL = {
    "stream_dedupe": "SELECT event_id, event_type, value FROM events",
    "stream_latest": "SELECT DISTINCT ON (user_id) user_id, event_id, event_type, value FROM events ORDER BY user_id, ts DESC, event_id DESC",
    "stream_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}
