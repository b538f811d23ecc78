"""Substring dedup by relative Lempel-Ziv parsing against an index of every document's blocks.

A window is 13 consecutive words. Its anchor is the least hash among its 5-word grams, so equal windows have equal
anchors, and the windows of a document that follow each other under one anchor form a block. The index holds every
block of every document, dealt out by anchor; looking a block up gives, for each of its windows, the smallest
doc_id it starts in. The parse goes through a document from left to right and extends a factor while the next window
is found in a smaller document; windows that straddle the boundary of two factors are looked up like all others,
so a repeat that spans two reference blocks is not missed. All words of factors are removed.

Exchange: one row for each slice of the input and bucket, with hashes and positions as packed arrays. Before it, a
slice settles its own repeats: of equal windows only those of the slice's smallest document are asked about, so a
passage that a third of all documents hold arrives once a slice. A window is known by a 64-bit hash of all its words; equal
anchors don't weaken it, so two different windows among n are taken for equal with probability n^2 / 2^65.

Around a line that many documents hold, many different windows share an anchor. Anchors are counted first, over all
documents (those that occur `LOCAL` times in a slice at least); those of `HOT` windows and more, or of a 65,536th of all
if that is more, are dealt out window by window, by the window's own hash. So no bucket follows one line.

Defined results: null and empty texts have no words; rows with equal doc_id never remove each other's words; a
repeated row gets the same result each time; a null doc_id is neither judged nor a reference; texts of any length
are read whole; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import kernels as K
from gridloom.llm.common import drop_scratch, scratch_table, shuffle_width, text_rows

WINDOW, GRAM = 13, 5
SLICE, LOCAL, HOT, MOST_HOT = 4 << 20, 16, 100_000, 1 << 16
U64 = np.uint64
PACK = "bucket long, own boolean, docs binary, tags binary, row binary, start binary, size binary, window binary"
PACK_ARROW = pa.schema([("bucket", pa.int64()), ("own", pa.bool_()), *((k, pa.binary()) for k in ("docs", "tags", "row", "start", "size", "window"))])
FOUND = "doc_id long, tag long, run long"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("run", pa.int64())])


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: row, first word in its row, anchor, hash."""
    starts, ends, first = K.spans(data, offs)
    words = K.word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    whole = np.arange(len(words)) + WINDOW <= first[1:][row]
    if not whole.any():
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U64),) * 2
    anchor = K.sliding_min(K.grams(words, GRAM), WINDOW - GRAM + 1)
    at = np.flatnonzero(whole)
    return row[at], at - first[row[at]], anchor[at], K.grams(words, WINDOW)[at]


def least_by_key(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each entry the least value among entries of the same key."""
    order = np.argsort(key, kind="stable")
    heads = K.group_starts(key[order])
    out = np.empty_like(value)
    out[order] = np.repeat(np.minimum.reduceat(value[order], heads), np.diff(np.append(heads, len(key)))) if len(heads) else value
    return out


def anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows by anchor in each slice, of anchors that occur often in it; an anchor of null counts all windows."""
    for batch in batches:
        for part in K.slices(batch, "text", SLICE):
            starts, ends, first = K.spans(*(x := K.buffers(part.column(1))))
            words = K.word_hashes(x[0], starts, ends)
            row = np.repeat(np.arange(part.num_rows), np.diff(first))
            whole = np.flatnonzero(np.arange(len(words)) + WINDOW <= first[1:][row])
            anchor, n = np.unique(K.sliding_min(K.grams(words, GRAM), WINDOW - GRAM + 1)[whole], return_counts=True) if len(whole) else (np.zeros(0, U64), np.zeros(0, np.int64))
            often = n >= LOCAL
            yield pa.RecordBatch.from_arrays([pa.array([None, *anchor[often].view(np.int64).tolist()], pa.int64()), pa.array([len(whole), *n[often].tolist()], pa.int64())], names=["anchor", "n"])


def hot_anchors(rows: DataFrame) -> np.ndarray:
    """Sorted; MOST_HOT at most, as each holds so large a share of all windows."""
    counts = scratch_table(rows.mapInArrow(anchor_counts, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")), "anchors", 4)
    total = counts.where("anchor is null").first()
    least = max(HOT, (total["n"] if total else 0) // MOST_HOT)
    hot = np.array([r["anchor"] for r in counts.where(F.col("anchor").isNotNull() & (F.col("n") >= least)).collect()], np.int64).view(U64)
    drop_scratch(counts)
    return np.sort(hot)


def packs(batch: pa.RecordBatch, buckets: int, hot: np.ndarray) -> Iterator[dict]:
    """The blocks of a slice: what it can settle itself (own) by document, what the index must answer by anchor."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    tags = batch.column(2).to_numpy(zero_copy_only=False)
    row, start, anchor, window = windows(*K.buffers(batch.column(1)))
    if not len(row):
        return
    doc = ids[row]
    settled = doc > least_by_key(window, doc)
    spread = np.zeros(len(row), bool)
    if len(hot):
        spread = (hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor) & ~settled
    edge = np.ones(len(row), bool)
    edge[1:] = spread[1:] | spread[:-1] | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (settled[1:] != settled[:-1]) | ((anchor[1:] != anchor[:-1]) & ~settled[1:])
    head = np.flatnonzero(edge)
    size = np.diff(np.append(head, len(row)))
    own = settled[head]
    by = np.where(spread[head], window[head] >> U64(8), anchor[head])
    bucket = np.where(own, row[head], (by & U64(0xFFFFFF)).astype(np.int64)) % buckets
    order = np.lexsort((head, own, bucket))
    cuts = K.group_starts(bucket[order] * 2 + own[order])
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        pick = order[a:b]
        h, n = head[pick], size[pick]
        used, place = np.unique(row[h], return_inverse=True)
        mine = bool(own[pick[0]])
        within = np.repeat(h, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield {
            "bucket": int(bucket[pick[0]]), "own": mine, "docs": K.narrow(ids[used]), "tags": K.narrow(tags[used]), "row": K.narrow(place), "start": K.narrow(start[h]), "size": K.narrow(n),
            "window": b"" if mine else window[within].tobytes(),
        }


def pack_rows(batches: Iterator[pa.RecordBatch], buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch, "text", SLICE):
            rows = list(packs(part, buckets, hot))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=PACK_ARROW)


def look_up(table: pa.Table) -> pa.Table:
    """Answers one bucket: the runs of windows (first and how many, in one number) found in a smaller document."""
    docs, tags, starts, sizes, owner = [], [], [], [], []
    keys, asked, base = [], [], 0
    own_runs = []
    for r in table.to_pylist():
        d, t = K.widen(r["docs"]), K.widen(r["tags"])
        at, s, n = K.widen(r["row"]) + base, K.widen(r["start"]), K.widen(r["size"])
        docs.append(d)
        tags.append(t)
        base += len(d)
        if r["own"]:
            own_runs.append(np.stack([at, s, n]))
            continue
        keys.append(np.frombuffer(r["window"], U64))
        owner.append(np.repeat(at, n))
        starts.append(np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    docs, tags = np.concatenate(docs), np.concatenate(tags)
    runs = own_runs
    if keys:
        key, who, where = np.concatenate(keys), np.concatenate(owner), np.concatenate(starts)
        del keys, owner, starts
        hit = np.flatnonzero(docs[who] > least_by_key(key, docs[who]))
        del key
        who, where = who[hit], where[hit]
        if len(who):
            new = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (where[1:] != where[:-1] + 1))))
            runs = [*runs, np.stack([who[new], where[new], np.diff(np.append(new, len(who)))])]
    if not runs:
        return FOUND_ARROW.empty_table()
    who, first, size = np.concatenate(runs, axis=1)
    return pa.table({"doc_id": docs[who], "tag": tags[who], "run": first << 32 | size}, schema=FOUND_ARROW)


def parse(text: str, found: np.ndarray) -> tuple[int, int, int, int, str]:
    """Words, removed words, factors, longest factor, and the digest of what is kept."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not len(found):
        return len(words), 0, 0, 0, hashlib.sha256(b" ".join(words)).hexdigest()
    runs = np.sort(found)
    first = runs >> 32
    last = np.maximum.accumulate(first + (runs & 0xFFFFFFFF) + WINDOW - 1)
    fresh = np.flatnonzero(np.concatenate(([True], first[1:] > last[:-1])))
    begin, end = first[fresh], last[np.append(fresh[1:] - 1, len(last) - 1)]
    kept, at = [], 0
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        kept += words[at:b]
        at = e
    kept += words[at:]
    return len(words), len(words) - len(kept), len(begin), int((end - begin).max()), hashlib.sha256(b" ".join(kept)).hexdigest()


def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column(2)
        values, offs = found.values.to_numpy(zero_copy_only=False), found.offsets.to_numpy(zero_copy_only=False)
        none = found.is_null().to_numpy(zero_copy_only=False)
        done = [parse(t, values[:0] if none[k] else values[offs[k] : offs[k + 1]]) for k, t in enumerate(batch.column(1).to_pylist())]
        cols = list(zip(*done, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, [*[pa.int64()] * 4, pa.string()], strict=True))], names=["doc_id", "n_words", "n_removed", "n_factors", "longest_factor", "kept_sha256"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, n_factors, longest_factor, kept_sha256."""
    tag = (F.xxhash64("text").bitwiseAND(0x7FFFFFFF)).alias("tag")
    rows = text_rows(docs, id_col, text_col).select("doc_id", "text", tag)
    buckets = shuffle_width(docs)
    named = rows.where("doc_id is not null")
    hot = hot_anchors(named)
    index = named.mapInArrow(lambda it: pack_rows(it, buckets, hot), PACK)
    found = index.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(look_up, FOUND)
    found = found.groupBy("doc_id", "tag").agg(F.collect_list("run").alias("found"))
    joined = rows.join(found, ["doc_id", "tag"], "left").select("doc_id", "text", "found")
    return joined.mapInArrow(rewrite, "doc_id long, n_words long, n_removed long, n_factors long, longest_factor long, kept_sha256 string")
