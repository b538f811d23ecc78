"""Sums of fixed-length vectors over partitions: partial sums travel as blocks and meet in a tree of shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, FAN_IN = 1 << 15, 32
PART = "part long, block int, payload binary"
PART_ARROW = pa.schema([("part", pa.int64()), ("block", pa.int32()), ("payload", pa.binary())])


def blocks(vector: np.ndarray, part: int) -> pa.RecordBatch:
    """A partition's partial sum (float64) as rows."""
    cuts = range(0, len(vector), BLOCK)
    rows = [vector[c : c + BLOCK].astype("<f8").tobytes() for c in cuts]
    return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], schema=PART_ARROW)


def meet(table: pa.Table) -> pa.Table:
    total = None
    for raw in table.column("payload"):
        v = np.frombuffer(raw.as_py(), "<f8")
        total = v.copy() if total is None else total + v
    return pa.table({"part": [table.column("part")[0].as_py()], "block": pa.array([table.column("block")[0].as_py()], pa.int32()), "payload": [total.tobytes()]}, schema=PART_ARROW)


def summed(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int) -> np.ndarray:
    """The sum over partitions of `partial`, whose length is fixed whatever the input."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield blocks(partial(batches), TaskContext.get().partitionId())

    parts = df.mapInArrow(emit, PART)
    many = df.rdd.getNumPartitions()
    while True:
        many = -(-many // FAN_IN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("block", "part").applyInArrow(meet, PART)
        if many <= 1:
            break
    out = np.zeros(length)
    for r in parts.collect():  # one row for each block
        v = np.frombuffer(r["payload"], "<f8")
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(v)] += v
    return out
