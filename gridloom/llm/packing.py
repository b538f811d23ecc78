"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token ids plus an end id; longer ones are cut into full pieces, the first may be shorter. The
histogram of piece lengths (at most `CAPACITY` numbers) goes to the driver. There the covering program "use as few
configurations as possible so that each length is covered as often as it occurs" is solved by multiplicative
weights: prices of lengths rise while they lag behind, an unbounded-knapsack dynamic program finds the configuration
of the highest price, and configurations are used a fixed fraction at a time. The solution is rounded down; what is
left over is packed by best fit decreasing, on counts, not on pieces. If best fit decreasing alone needs fewer
sequences, that is taken. The plan's size depends on the number of lengths only.

Pieces find their place by their rank within their length: counted by (length, hash of doc_id and piece), numbered
inside those small parts, then looked up in the plan.

Defined results: a null or empty text is one piece of one id; repeated rows are packed each; pieces of one length are
interchangeable, their order is that of a hash of doc_id and piece, then of these and the ids' checksum; no input, no pieces.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import kernels as K
from gridloom.llm.common import scratch_table, text_rows
from gridloom.llm.token_counts import CUT, SPECIAL, vocabulary_path

CAPACITY, END_ID, SPECIAL_ID = 1024, 2, 50256
ROUNDS, STEP, PART_ROWS = 300, 0.1, 100_000
MEMO, SLICE = 250_000, 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class Encoder:
    """Ids of byte-level BPE. Words that a space begins are encoded once and remembered as packed ids."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.width[i] = len(t)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, bytes] = {"": b""}

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode_ordinary(text), "<u4")

    def learn(self, words: list[str]) -> None:
        """Encodes words in one text: each begins with a space before a non-space, where a token always begins."""
        for at in range(0, len(words), 2000):
            part = [" " + w for w in words[at : at + 2000]]
            ids = self.plain("".join(part))
            ends = np.cumsum(self.width[ids])
            cuts = np.searchsorted(ends, np.cumsum([len(p.encode("utf-8")) for p in part]), "left") + 1
            raw, a = ids.tobytes(), 0
            for w, b in zip(words[at : at + 2000], (cuts * 4).tolist(), strict=True):
                self.memo[w] = raw[a:b]
                a = b

    def ids(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian ids of each text; the special token's string is its id, as the library does."""
        flat = [p for t in texts for p in t.split(SPECIAL)]
        split = []
        for t in flat:
            words = t.split(" ")
            if not all(words) or any(w[0].isspace() for w in words):
                words = CUT.split(t)
            split.append(words)
        if len(self.memo) > MEMO:
            self.memo = {"": b""}
        self.learn(list(set(chain.from_iterable(w[1:] for w in split)).difference(self.memo)))
        get = self.memo.__getitem__
        parts = iter([self.plain(w[0]).tobytes() + b"".join(map(get, w[1:])) for w in split])
        mark = np.array([SPECIAL_ID], "<u4").tobytes()
        return [mark.join(next(parts) for _ in range(t.count(SPECIAL) + 1)) for t in texts]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc, end = encoder(path), np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        for part in K.slices(batch, "text", SLICE):
            rows: list[tuple] = []
            for doc, raw in zip(part.column(0).to_pylist(), enc.ids(part.column(1).to_pylist()), strict=True):
                raw += end
                n, start, k = len(raw) // 4, 0, 0
                while start < n:
                    size = ((n - 1) % CAPACITY + 1) if not k else CAPACITY
                    rows.append((doc, k, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)])))
                    start, k = start + size, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES_ARROW, strict=True)], schema=PIECES_ARROW)


def token_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    return text_rows(docs, id_col, text_col).mapInArrow(lambda it: cut(it, vocabulary_path(vocabulary)), PIECES)


# -- the plan -----------------------------------------------------------------------------------------------------


def dearest(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, Counter]:
    """The configuration of the highest price: an unbounded knapsack by dynamic programming."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(lengths, c, "right"))
        best[c] = best[c - 1]
        if n:
            value = best[c - lengths[:n]] + prices[:n]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], took[c] = value[k], k
    out, c = Counter(), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            out[int(lengths[took[c]])] += 1
            c -= int(lengths[took[c]])
    return float(best[capacity]), out


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on counts: (lengths of a sequence, how many such sequences)."""
    room: dict[int, Counter] = defaultdict(Counter)
    for size in sorted((k for k in counts if counts[k]), reverse=True):
        left = counts[size]
        while left:
            fit = min((r for r in room if r >= size and room[r]), default=None)
            if fit is None:
                each = min(capacity // size, left)
                n = left // each
                room[capacity - size * each][(size,) * each] += n
                left -= n * each
                continue
            content, have = next(iter(room[fit].items()))
            n = min(have, left)
            room[fit][content] -= n
            if not room[fit][content]:
                del room[fit][content]
            room[fit - size][content + (size,)] += n
            left -= n
    return [(content, n) for r in room.values() for content, n in r.items() if n]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], float]:
    """Sequences (lengths, how many), and the best lower bound that the prices prove."""
    full = counts.get(capacity, 0)
    counts = {k: v for k, v in counts.items() if v and k < capacity}
    out: list[tuple[tuple[int, ...], int]] = [((capacity,), full)] if full else []
    if not counts:
        return out, float(full)
    lengths = np.array(sorted(counts))
    need = np.array([counts[k] for k in lengths.tolist()], float)
    left, weight = need.copy(), np.ones(len(need))
    bound = float(lengths @ need) / capacity
    used: Counter = Counter()
    for _ in range(ROUNDS):
        prices = np.where(left >= 1, lengths * weight, 0.0)
        value, config = dearest(lengths, prices, capacity)
        if not config:
            break
        bound = max(bound, float(prices @ need) / value)
        at = np.searchsorted(lengths, sorted(config))
        per = np.array([config[k] for k in sorted(config)], float)
        times = int(min(left[at] / per) * (1.0 if left.sum() < 0.05 * need.sum() else 0.5))
        if times:
            used[tuple(sorted(config.elements(), reverse=True))] += times
            left[at] -= per * times
        else:
            weight[at] *= 1 - STEP
        behind = left / need
        weight *= np.exp(STEP * (behind - behind.mean()))
        weight /= weight.max()
    rest = best_fit({int(k): int(v) for k, v in zip(lengths, left, strict=True)}, capacity)
    solved = [*used.items(), *rest]
    plain = best_fit(counts, capacity)
    return out + min(solved, plain, key=lambda p: sum(n for _, n in p)), full + bound


def places(sequences: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, sequence of that rank, offset): later ranks take the following sequences."""
    rank: Counter = Counter()
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    base = 0
    for content, n in sequences:
        offset = 0
        for size in content:
            found[size].append((rank[size], base, offset))
            rank[size] += n
            offset += size
        base += n
    return {k: np.array(v, np.int64) for k, v in found.items()}


def place(batches: Iterator[pa.RecordBatch], where: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for size in np.unique(length).tolist():
            rows, table = np.flatnonzero(length == size), where[size]
            k = np.searchsorted(table[:, 0], rank[rows], "right") - 1
            sequence[rows], offset[rows] = table[k, 1] + rank[rows] - table[k, 0], table[k, 2]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*PIECES_ARROW.names, "sequence_id", "offset"])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = scratch_table(token_pieces(docs, id_col=id_col, text_col=text_col), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(plan(counts)[0])
    # a length that a hot group of copies has is dealt out over as many parts as an exchange has partitions
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(counts.values()) // PART_ROWS)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("k", F.row_number().over(within)).join(bases, ["length", "part"]).select(*PIECES_ARROW.names, (F.col("base") + F.col("k") - 1).alias("rank"))
    return ranked.mapInArrow(lambda it: place(it, where), PIECES + ", sequence_id long, offset long")
