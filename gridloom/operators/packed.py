"""The table of feedback codes with one row of bytes a guess, and statistics of sets of answers over it.

A guess's row has a byte for each answer, so a list of 12,972 guesses and 2,315 answers takes 30 MB, and no cell is a row.
Rows are partitioned by guess. Sets of answers are sent to them in blocks of bounded bytes; a set's statistics for a guess
are counts over the bytes at the set's places, many sets of one size at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALL_RIGHT, CODES, MOST_WORDS = 242, 243, 50_000
#: Guesses scored at a time, cells held at a time, bytes of sets sent at a time, and the size up to which members of a set
#: are compared with each other instead of counted by code.
ROWS, CELLS, BLOCK_BYTES, SMALL = 512, 1 << 22, 16 << 20, 16


def letters_of(words: list[str]) -> np.ndarray:
    return np.array([w.encode() for w in words], "S5").view(np.uint8).reshape(-1, 5)


def codes(guesses: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """[guesses, answers] feedback codes of letters: places that are right, then letters that the answer has elsewhere as
    often as it has them outside the right places."""
    right = guesses[:, None, :] == answers[None, :, :]
    out = np.zeros(right.shape[:2], np.uint8)
    for i in range(5):
        before = np.zeros_like(out)
        for j in range(i):
            before += (guesses[:, j] == guesses[:, i])[:, None] & ~right[:, :, j]
        stock = np.zeros_like(out)
        for j in range(5):
            stock += (answers[None, :, j] == guesses[:, None, i]) & ~right[:, :, j]
        out += 3**i * np.where(right[:, :, i], 2, before < stock).astype(np.uint8)
    return out


def packed_matrix(words: DataFrame, answers: list[str]) -> DataFrame:
    """words: gid, guess -> gid, guess, cells (a byte an answer, in the order given)."""
    if len(answers) > MOST_WORDS:
        raise ValueError(f"{len(answers)} answers are over {MOST_WORDS}, too many to send to every task")
    targets = letters_of(answers)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = codes(letters_of(part.column(1).to_pylist()), targets)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], names=["gid", "guess", "cells"])

    return words.select("gid", "guess").mapInArrow(pack, "gid int, guess string, cells binary")


def set_statistics(table: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """table: [guesses, answers] codes; members: [sets, size]. Of each guess and set: the sum of squared sizes of the groups
    of equal codes, the largest size, the sum of size * log2(size), and whether the guess is a member."""
    m, (q, s) = len(table), members.shape
    if s <= SMALL:
        cells = table[:, members.ravel()].reshape(m, q, s)
        size = np.zeros((m, q, s), np.uint8)  # of each member's group
        for j in range(s):
            size += cells == cells[:, :, j : j + 1]
        log = np.log2(np.arange(SMALL + 1).clip(1))
        return size.sum(axis=2, dtype=np.int64), size.max(axis=2).astype(np.int64), log[size].sum(axis=2), (cells == ALL_RIGHT).any(axis=2)
    out = [np.zeros((m, q), t) for t in (np.int64, np.int64, float, bool)]
    lift = (np.arange(m) * CODES)[:, None]
    log = np.arange(s + 1) * np.log2(np.arange(s + 1).clip(1))
    for k in range(q):
        counts = np.bincount((table[:, members[k]] + lift).ravel(), minlength=m * CODES).reshape(m, CODES)
        out[0][:, k], out[1][:, k], out[2][:, k], out[3][:, k] = (counts * counts).sum(axis=1), counts.max(axis=1), log[counts].sum(axis=1), counts[:, ALL_RIGHT] > 0
    return tuple(out)


def cells_of(batch: pa.RecordBatch) -> np.ndarray:
    """[guesses, answers] of a batch of gid, guess, cells."""
    return np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def by_size(sets: list[np.ndarray], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which sets, their members) of one size each, as many as fit beside so many rows."""
    sizes = np.array([len(x) for x in sets])
    for s in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == s)
        step = max(1, CELLS // (rows * s))
        for at in range(0, len(which), step):
            some = which[at : at + step]
            yield some, np.stack([sets[k] for k in some.tolist()])


def in_blocks(rows: Iterator, size) -> Iterator[list]:
    """Rows in lists of about BLOCK_BYTES."""
    block, held = [], 0
    for r in rows:
        block.append(r)
        held += size(r)
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def partition_statistics(packed: DataFrame, sets: DataFrame) -> DataFrame:
    """sets: cset, members (array of places) -> cset, guess, sumsq, worst, n, h, isc; a block of sets at a time."""
    out = None
    for block in in_blocks(sets.select("cset", "members").coalesce(1).toLocalIterator(), lambda r: 4 * len(r["members"]) + len(r["cset"])):
        names, members = [r["cset"] for r in block], [np.array(r["members"], np.int64) for r in block]

        def score(batches: Iterator[pa.RecordBatch], names=names, members=members) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    table, guesses = cells_of(part), part.column(1).to_pylist()
                    for which, own in by_size(members, len(table)):
                        sumsq, worst, kl, isc = set_statistics(table, own)
                        n = own.shape[1]
                        columns = [sumsq, worst, np.full(sumsq.shape, n), np.log2(n) - kl / n, isc.astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in which.tolist()] * len(table)), pa.array(np.repeat(np.array(guesses, object), len(which))), *(pa.array(c.ravel()) for c in columns)], names=["cset", "guess", "sumsq", "worst", "n", "h", "isc"])

        own = packed.mapInArrow(score, "cset string, guess string, sumsq long, worst long, n long, h double, isc int")
        out = own if out is None else out.unionByName(own)
    if out is None:
        return packed.sparkSession.createDataFrame([], "cset string, guess string, sumsq long, worst long, n long, h double, isc int")
    return out


def best_splitters(packed: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """sets: cset, members -> cset, guess, sumsq, isc of the members and of the `most` others that leave least (ties by the
    alphabet); guesses that tell nothing are left out. Each partition gives its own best first."""
    rows, out = "cset string, gid int, guess string, sumsq long, isc int, splits boolean", None
    for block in in_blocks(sets.select("cset", "members").coalesce(1).toLocalIterator(), lambda r: 4 * len(r["members"]) + len(r["cset"])):
        names, members = [r["cset"] for r in block], [np.array(r["members"], np.int64) for r in block]

        def score(batches: Iterator[pa.RecordBatch], names=names, members=members) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    table, gid = cells_of(part), part.column(0).to_numpy()
                    for which, own in by_size(members, len(table)):
                        sumsq, worst, _, isc = set_statistics(table, own)
                        first = np.argsort(np.argsort(sumsq + gid[:, None] / (MOST_WORDS + 1), axis=0), axis=0) < most
                        g, k = np.nonzero(first | isc)
                        columns = [gid[g], part.column(1).take(pa.array(g)), sumsq[g, k], isc[g, k].astype(np.int32), worst[g, k] < own.shape[1]]
                        yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in which[k].tolist()], pa.string()), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], names=["cset", "gid", "guess", "sumsq", "isc", "splits"])

        own = packed.mapInArrow(score, rows)
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = packed.sparkSession.createDataFrame([], rows)
    place = F.row_number().over(Window.partitionBy("cset").orderBy("sumsq", "gid"))
    return out.withColumn("place", place).where(((F.col("place") <= most) & F.col("splits")) | (F.col("isc") == 1)).select("cset", "guess", "sumsq", "isc")
