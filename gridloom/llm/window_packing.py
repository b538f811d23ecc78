"""Packing into windows by non-negative least squares over the histogram of lengths; documents may be cut.

Documents become token ids plus an end id. Of longer ones whole windows are cut off the front; what is left has 1 to
`CAPACITY` - 1 ids, and the histogram of these lengths goes to the driver (at most `CAPACITY` numbers). There

1. combinations of lengths that fill a window exactly are enumerated, shallow ones: up to two different lengths and
   `DEEPEST` pieces, or three different lengths once each;
2. repeat counts x >= 0 are solved so that the lengths they use come as near to the histogram as they can (least squares,
   by accelerated projected gradients with a diagonal majoriser; first over all combinations, then over the `SUPPORT`
   largest, which bounds the plan);
3. counts are rounded with the error carried on to the next combination, and never beyond what the histogram has;
4. residuals are packed greedily, plentiful sizes before rare ones, largest first, the largest that fits next, and where
   nothing fits a piece is cut to fill the window. What is less than a window at the very end is cut into powers of two.

So no sequence is padded: all have `CAPACITY` ids but the last few, whose sizes are powers of two. Everything works on
counts of equal lengths, so the plan's size follows the window's size, not the corpus.

Pieces find their place by their rank within their length: numbered within the task that encodes them, then lifted by
what other tasks have (a table by length and task, joined back). A piece that the plan cuts carries its ids there.

Defined results: a null or empty text is the end id alone; repeated rows, also of equal ids, are packed each; texts are
never cut short; equal lengths are interchangeable, their order is that of tasks; no input, no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import kernels as K
from gridloom.llm.common import scratch_table, text_rows
from gridloom.llm.token_counts import vocabulary_path
from gridloom.llm.word_ids import word_ids

CAPACITY, END_ID, VOCABULARY = 2048, 1, "byte_bpe_50k.json"
DEEPEST, SUPPORT, COARSE, FINE = 16, 8192, 60, 400
SLICE = 1 << 20
ITEMS = "part int, k long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary"
ITEMS_ARROW = pa.schema([("part", pa.int32()), ("k", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encoded(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Whole windows, and what is left of each document with its ids; k numbers the task's items of a length."""
    library, part = word_ids(path), TaskContext.get().partitionId()
    end, seen = np.array([end_id], library.kind).tobytes(), np.zeros(capacity + 1, np.int64)
    for batch in batches:
        for some in K.slices(batch, "text", SLICE):
            rows: list[tuple] = []
            for doc, raw in zip(some.column(0).to_pylist(), library.ids(some.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(raw + end, library.kind)
                left = len(ids) % capacity
                rows += [(doc, k, capacity, crc(ids[k : k + capacity]), len(ids), None) for k in range(0, len(ids) - left, capacity)]
                if left:
                    tail = ids[-left:]
                    rows.append((doc, len(ids) - left, left, crc(tail), len(ids), tail.tobytes()))
            length = np.array([r[2] for r in rows], np.int64)
            order = np.argsort(length, kind="stable")
            begins = K.group_starts(length[order])
            within = np.empty(len(rows), np.int64)
            within[order] = np.arange(len(rows)) - np.repeat(begins, np.diff([*begins, len(rows)]))
            number = seen[length] + within
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part), pa.int32()), pa.array(number), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(ITEMS_ARROW)[2:], strict=True))], schema=ITEMS_ARROW)


# -- the plan -----------------------------------------------------------------------------------------------------


def combinations(lengths: np.ndarray, capacity: int, deepest: int = DEEPEST) -> tuple[np.ndarray, np.ndarray]:
    """[m, 3] places in `lengths` (sorted) and how often each is used; unused places are 0 times the first length."""
    place = np.full(capacity + 1, -1)
    place[lengths] = np.arange(len(lengths))
    who, often = [], []

    def add(uses: list[tuple[np.ndarray, int]]) -> None:
        zero = np.zeros(len(uses[0][0]), np.int64)
        who.append(np.stack([*(place[i] for i, _ in uses), *[zero] * (3 - len(uses))], axis=1))
        often.append(np.stack([*(zero + n for _, n in uses), *[zero] * (3 - len(uses))], axis=1))

    for a in range(1, deepest + 1):
        alone = lengths[lengths * a == capacity]
        add([(alone, a)])
        for b in range(1, deepest + 1 - a):
            i = lengths[lengths * a < capacity]
            j, rest = np.divmod(capacity - a * i, b)
            good = (rest == 0) & (j > i) & (place[j] >= 0)
            add([(i[good], a), (j[good], b)])
    for i in lengths[lengths * 3 < capacity].tolist():
        j = lengths[(lengths > i) & (2 * lengths < capacity - i)]
        j = j[place[capacity - i - j] >= 0]
        add([(np.full(len(j), i), 1), (j, 1), (capacity - i - j, 1)])
    return np.concatenate(who), np.concatenate(often)


def least_squares(who: np.ndarray, often: np.ndarray, goal: np.ndarray, steps: int, x: np.ndarray | None = None) -> np.ndarray:
    """x >= 0 that makes the uses of lengths nearest to the goal: accelerated projected gradients, each combination's step
    bounded by the sums of its rows (a diagonal matrix above A'A)."""
    weight = often.astype(float)
    used = lambda x: np.bincount(who.ravel(), (weight * x[:, None]).ravel(), len(goal))
    steep = (weight * used(np.ones(len(who)))[who]).sum(axis=1)
    x = np.zeros(len(who)) if x is None else x
    y, pace = x, 1.0
    for _ in range(steps):
        slope = (weight * (used(y) - goal)[who]).sum(axis=1)
        new = np.maximum(y - slope / steep, 0)
        if slope @ (new - x) > 0:  # the momentum points uphill
            pace = 1.0
        after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        x, y, pace = new, new + (pace - 1) / after * (new - x), after
    return x


def rounded(x: np.ndarray, who: np.ndarray, often: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Whole repeats of combinations (places and uses, how many), and what the histogram has left."""
    total = np.floor(np.cumsum(x) + 0.5).astype(np.int64)
    times, left, out = np.diff(total, prepend=0), counts.copy(), []
    for c in np.argsort(-times, kind="stable")[: int((times > 0).sum())].tolist():
        uses = {int(p): int(n) for p, n in zip(who[c], often[c], strict=True) if n}
        n = min(int(times[c]), *(int(left[p]) // k for p, k in uses.items()))
        if n:
            out.append((uses, n))
            for p, k in uses.items():
                left[p] -= n * k
    return out, left


@dataclass
class Plan:
    """Where items go: by length and number of cuts before, rows (first rank, rank behind the last, start within the item,
    size, sequence of the first rank, offset); later ranks go to the sequences that follow."""

    capacity: int
    sequences: int = 0
    #: Sequences that the combinations fill.
    combined: int = 0
    cuts: int = 0
    rows: dict[tuple[int, int], list[tuple[int, ...]]] = field(default_factory=lambda: defaultdict(list))
    #: By size: groups (length, first rank, items, start, cuts before) that have no place yet.
    stock: dict[int, list[tuple[int, int, int, int, int]]] = field(default_factory=lambda: defaultdict(list))
    have: Counter = field(default_factory=Counter)

    def put(self, size: int, n: int, sequence: int, offset: int, upto: int | None = None) -> None:
        """n items of a size into n sequences from one on; upto: only so many of their ids, the rest goes back."""
        self.have[size] -= n
        while n:
            length, rank, items, start, cuts = self.stock[size].pop()
            take = min(n, items)
            if take < items:
                self.stock[size].append((length, rank + take, items - take, start, cuts))
            self.rows[length, cuts].append((rank, rank + take, start, upto or size, sequence, offset))
            if upto:
                self.stock[size - upto].append((length, rank, take, start + upto, cuts + 1))
                self.have[size - upto] += take
                self.cuts += take
            n, sequence = n - take, sequence + take

    def fill(self, uses: dict[int, int], n: int, cut: tuple[int, int] | None = None) -> None:
        """n equal sequences: uses of sizes, and a size cut after so many ids."""
        offset = 0
        for size, k in uses.items():
            for _ in range(k):
                self.put(size, n, self.sequences, offset)
                offset += size
        if cut:
            self.put(cut[0], n, self.sequences, offset, cut[1])
        self.sequences += n

    def fit(self, least: int) -> tuple[dict[int, int], tuple[int, int] | None] | None:
        """What fills `least` windows or more: the largest that fits, again and again; then a cut of the smallest that is too
        large. None: sizes of which there are so many can't."""
        sizes = sorted(s for s, n in self.have.items() if n >= least)
        uses: dict[int, int] = {}
        room, at = self.capacity, len(sizes)
        while room:
            at = bisect_right(sizes, room, hi=at) - 1
            if at < 0:
                cut = next((s for s in sizes if s > room and self.have[s] // least > uses.get(s, 0)), None)
                return None if cut is None else (uses, (cut, room))
            k = min(room // sizes[at], self.have[sizes[at]] // least)
            uses[sizes[at]] = k
            room -= k * sizes[at]
        return uses, None

    def pack_rest(self) -> None:
        """Windows from sizes of which there are many first, then from those of half as many, and so on: a step fills that
        many windows at least, so steps follow the number of sizes and the logarithm of counts."""
        least = 1 << max(self.have.values(), default=0).bit_length() >> 1
        left = sum(s * n for s, n in self.have.items())
        while least:
            while left >= self.capacity and (found := self.fit(least)):
                uses, cut = found
                need = Counter(uses)
                if cut:
                    need[cut[0]] += 1
                n = min(self.have[s] // k for s, k in need.items())
                self.fill(uses, n, cut)
                left -= n * self.capacity
            least //= 2

    def finish(self) -> None:
        """Fewer ids than a window has: one after the other, cut at powers of two."""
        left = sum(s * n for s, n in self.have.items())
        room, offset = (1 << left.bit_length() - 1, 0) if left else (0, 0)
        for size in sorted((s for s, n in self.have.items() if n), reverse=True):
            for _ in range(self.have[size]):
                rest = size
                while rest:
                    part = min(rest, room - offset)
                    self.put(rest, 1, self.sequences, offset, part if part < rest else None)
                    rest, offset, left = rest - part, offset + part, left - part
                    if offset == room:
                        self.sequences, room, offset = self.sequences + 1, 1 << left.bit_length() - 1 if left else 0, 0


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """counts: items by length, of at most `capacity` ids."""
    plan = Plan(capacity)
    for length, n in counts.items():
        if n:
            plan.stock[length].append((length, 0, n, 0, 0))
            plan.have[length] = n
    if plan.have[capacity]:
        plan.fill({capacity: 1}, plan.have[capacity])
    lengths = np.array(sorted(s for s, n in plan.have.items() if n), np.int64)
    if len(lengths):
        who, often = combinations(lengths, capacity)
        goal = np.array([plan.have[s] for s in lengths.tolist()], np.int64)
        if len(who):
            x = least_squares(who, often, goal.astype(float), COARSE)
            best = np.sort(np.argsort(-x, kind="stable")[:SUPPORT])
            who, often = who[best], often[best]
            repeats, _ = rounded(least_squares(who, often, goal.astype(float), FINE, x[best]), who, often, goal)
            for uses, n in repeats:
                plan.fill({int(lengths[p]): k for p, k in uses.items()}, n)
                plan.combined += n
    plan.pack_rest()
    plan.finish()
    return plan


# -- pieces to their places ---------------------------------------------------------------------------------------


def placed(batches: Iterator[pa.RecordBatch], rows: dict[int, list[np.ndarray]], kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """length, rank, doc_id, start, ids_crc32, doc_tokens, ids -> the pieces."""
    for batch in batches:
        length, rank, start, whole, tokens = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 3, 4, 5))
        found = []
        for size in np.unique(length).tolist():
            mine = np.flatnonzero(length == size)
            for table in rows[size]:
                t = table[np.searchsorted(table[:, 0], rank[mine], "right") - 1]
                found.append(np.stack((mine, t[:, 2], t[:, 3], t[:, 4] + rank[mine] - t[:, 0], t[:, 5])))
                mine = mine[t[:, 2] + t[:, 3] < size]  # cut there: the rest has a row of one more cut
                if not len(mine):
                    break
        row, inside, size, sequence, offset = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
        sums = whole[row]
        for k in np.flatnonzero(size < length[row]).tolist():
            ids = np.frombuffer(batch.column(6)[int(row[k])].as_buffer(), kind)
            sums[k] = crc(ids[inside[k] : inside[k] + size[k]])
        yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(row)), *map(pa.array, (start[row] + inside, size, sums, tokens[row], sequence, offset))], schema=PIECES_ARROW)


def pack_windows(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    items = scratch_table(text_rows(docs, id_col, text_col).mapInArrow(lambda it: encoded(it, vocabulary_path(vocabulary), capacity, end_id), ITEMS), "window-items")
    cells = items.groupBy("length", "part").agg(F.count("*").alias("n"))
    plan = make_plan({r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    rows: dict[int, list[np.ndarray]] = defaultdict(list)
    for (length, _), found in sorted(plan.rows.items()):
        rows[length].append(np.array(sorted(found), np.int64))
    rows = dict(rows)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).hint("shuffle_hash")
    ranked = items.join(bases, ["length", "part"]).select("length", (F.col("base") + F.col("k")).alias("rank"), "doc_id", "start", "ids_crc32", "doc_tokens", "ids")
    return ranked.mapInArrow(lambda it: placed(it, rows, word_ids(vocabulary_path(vocabulary)).kind), PIECES)
