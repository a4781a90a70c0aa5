"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.scratch import bucketed, scratch, settled, shared_dir, stored
from tesserae.sources.tables import table

__all__ = ["bucketed", "fresh", "scratch", "settled", "shared_dir", "stored", "table", "text_bytes", "trained_in_a_task"]


def text_bytes(col):
    """UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.encode(col, "UTF-8"), F.lit(b""))


def fresh(df, *names: str) -> list[str]:
    """The given names, each with underscores put before it until no column of df has it."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def trained_in_a_task(rows: DataFrame, train: Callable):
    """train(texts, labels) of a bounded table (raw, label), run in one task, so that neither texts nor training are in the driver.

    Rows go to train in one order, whatever the partitions. A lost executor's training is done again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sorted(pair for b in batches for pair in zip(*(c.to_pylist() for c in b.columns), strict=True))
        model = train([raw for raw, _ in known], [label for _, label in known])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = rows.repartition(1).mapInArrow(run, "model binary").collect()  # one row, of a model's size; none if no row is labelled
    return pickle.loads(made[0]["model"]) if made else train([], [])
