"""Minimax contiguous sharding of atomic groups.

Groups of equal texts, ordered by a 64-bit hash of the text, are cut into `shards` contiguous runs so that the
largest run is as small as it can be. The smallest feasible capacity is found by binary search with a greedy
check. Sizes are summed into cells (ranges of the hash); the search runs on cells, and only cells in which some
cut can fall are opened, level by level, so the driver holds a bounded table however many groups there are.

Law: `bytes`. Size is the text's UTF-8 bytes plus 16. Slots are gapless within a shard: documents are counted by
(shard, hash of doc_id), which no group of copies can make uneven, and numbered inside those small parts.

Defined results: a null text has no bytes and is grouped with empty texts; repeated rows each take a slot; all bytes of a text of any length count; fewer
groups than shards leave shards empty; empty input, empty output.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import scratch_table, text_rows

FIRST_BITS, STEP_BITS, PART_ROWS = 12, 6, 20_000


@dataclass
class Cells:
    """Ordered ranges of the hash: first value, width in bits (0: one group, atomic), bytes."""

    low: np.ndarray
    bits: np.ndarray
    size: np.ndarray


def greedy(sizes: list[int], ends: list[int], shards: int, capacity: int) -> list[int] | None:
    """Cut positions when every shard takes as many whole items as `capacity` holds; None if `shards` don't do."""
    cuts, at, n = [], 0, len(sizes)
    for _ in range(shards):
        if at == n:
            break
        done = ends[at - 1] if at else 0
        to = bisect.bisect_right(ends, done + capacity, at)
        if to == at:
            return None
        at = to
        cuts.append(at)
    return cuts if at == n else None


def smallest_capacity(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The least capacity with which the greedy check succeeds, and its cuts."""
    ends = np.cumsum(np.asarray(sizes, np.int64)).tolist()
    low, high = max([-(-ends[-1] // shards), *sizes]), ends[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy(sizes, ends, shards, mid) is None:
            low = mid + 1
        else:
            high = mid
    return low, greedy(sizes, ends, shards, low)


def reachable(cells: Cells, shards: int, low: int, high: int) -> np.ndarray:
    """Cells that some greedy cut can fall into, for any capacity from low to high and any inner order of sizes.

    If a run starts in (a, b] bytes, it ends after at least a + capacity - (the cell it stops in) bytes.
    """
    ends = np.cumsum(cells.size)
    open_cells = np.zeros(len(ends), bool)
    a = b = 0
    for _ in range(shards):
        first = int(np.searchsorted(ends, a + low, "right"))
        last = int(np.searchsorted(ends, b + high, "right"))
        open_cells[first : min(last + 1, len(ends))] = True
        if first >= len(ends):
            break
        a = int(ends[first - 1]) if first else 0
        a = max(a, 0)
        b = min(b + high, int(ends[-1]))
    return open_cells & (cells.bits > 0)


def plan_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Hash values at which shards 1, 2, ... begin. groups: h (bigint), size (bigint) of each atomic group."""
    ranged = lambda bits: F.expr(f"shiftleft(shiftright(h, {bits}), {bits})")
    bits = 64 - FIRST_BITS
    first = groups.groupBy(ranged(bits).alias("low")).agg(F.sum("size").alias("size"), F.min("h").alias("a"), F.max("h").alias("b")).collect()
    first.sort(key=lambda r: r["low"])
    if not first:
        return []
    cells = Cells(np.array([r["a"] if r["a"] == r["b"] else r["low"] for r in first], np.int64), np.array([0 if r["a"] == r["b"] else bits for r in first]), np.array([r["size"] for r in first], np.int64))
    while True:
        sizes = cells.size.tolist()
        whole, _ = smallest_capacity(sizes, shards)
        atoms = [s for s, k in zip(sizes, cells.bits.tolist(), strict=True) if k == 0]
        floor = max([-(-sum(sizes) // shards), *atoms])
        opened = reachable(cells, shards, floor, whole)
        if not opened.any():
            cuts = smallest_capacity(sizes, shards)[1]
            return [int(cells.low[c]) for c in cuts[:-1]]
        bits = max(0, int(cells.bits[opened].max()) - STEP_BITS)
        wanted = groups.sparkSession.createDataFrame([(int(x), int(k)) for x, k in zip(cells.low[opened], cells.bits[opened], strict=True)], "cell long, width int")
        widths = sorted({int(k) for k in cells.bits[opened]})
        parts = None
        for k in widths:
            part = groups.withColumn("cell", ranged(k)).join(F.broadcast(wanted.where(F.col("width") == k)), "cell")  # bounded: one row per open cell
            part = part.groupBy(ranged(min(bits, k)).alias("low")).agg(F.sum("size").alias("size"), F.min("h").alias("a"), F.max("h").alias("b")).withColumn("width", F.lit(min(bits, k)))
            parts = part if parts is None else parts.unionByName(part)
        found = parts.collect()
        keep = ~opened
        low = [*cells.low[keep].tolist(), *(r["a"] if r["a"] == r["b"] else r["low"] for r in found)]
        wide = [*cells.bits[keep].tolist(), *(0 if r["a"] == r["b"] else r["width"] for r in found)]
        size = [*cells.size[keep].tolist(), *(r["size"] for r in found)]
        order = np.argsort(np.array(low, np.int64), kind="stable")
        cells = Cells(np.array(low, np.int64)[order], np.array(wide)[order], np.array(size, np.int64)[order])


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col("text")
    rows = text_rows(docs, id_col, text_col).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = scratch_table(rows, "shard-rows")
    groups = scratch_table(rows.groupBy("h").agg(F.sum("size").alias("size")), "shard-groups")
    cuts = plan_cuts(groups, shards)
    n = rows.count()
    parts = max(1, -(-n // (PART_ROWS * max(1, shards))))
    starts = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    placed = rows.withColumn("shard", F.aggregate(starts, F.lit(0), lambda a, c: a + (F.col("h") >= c).cast("int"))).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "h")
    return placed.withColumn("k", F.row_number().over(within)).join(bases, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("k") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
