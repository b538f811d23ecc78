"""Benchmark decontamination by latent semantic retrieval, then subsequence and answer checks.

Passages are the benchmark's items and all runs of `PASSAGE` words of all documents, as TF-IDF vectors over `terms`: all
words of the benchmark and the `OTHERS` words that most documents hold, two at least. Document frequencies of all words are
counted over all documents; words meet in buckets of their hashes. One pass over all passages multiplies their Gram matrix
(terms by terms, never made) with a random matrix: only sums of terms times rank meet, and they give a low-rank factor of
the documents' share (Nystroem). The SVD of that factor and the items' passages is found by a range finder with one power
iteration; its leading right singular vectors are the latent space. The rank is `RANK` at most and below the number of
items, so words that occur together share directions: a window that says an item in the words of the documents' other
passages lies near it.

Every window of every document is searched. Windows are half as long again as the item. A window is a candidate for an
item if the cosine of their latent vectors reaches the item's bound: the cosine that leaks reach, all but those further
than `DEVIATIONS` below their mean, less a margin. A leak is the item, `1 - PARAPHRASED` of its words gone, amid
surroundings by the mean and the covariance that the passages of all documents have in the latent space (the covariance
as far as the low-rank factor holds it). The bound follows from both moments over all choices of words and all passages;
none are drawn, so items that read alike have one bound, wherever they stand in the benchmark. Windows that no
accepted leak can lie in are not projected: an accepted leak holds `PARAPHRASED` of the item in order, so it holds some
of the item's rarest words (`need` of the rarest `1 - PARAPHRASED` and `need` more), whichever are missing.
Candidates are checked on words: the longest common subsequence of the item and the surroundings of the window must
cover `COPIED` of the item, or `PARAPHRASED` of it and `ANSWERED` of its answer (its last sentence). Items of fewer than
`LEAST` words have no latent vector worth a name; they are leaks where they stand verbatim.

No part of the index comes from a sample, of documents or of leaks. Every task reads the whole index; its bytes are checked
(`MAX_INDEX_BYTES`), and so is the benchmark before it is collected (`MAX_BENCHMARK_BYTES`).

Defined results: null and empty texts and items match nothing; repeated rows get the same result each; of items that are
matched equally well the least item_id is named, items without one last; an empty benchmark rejects nothing; texts of any length
are searched whole; an empty table of documents has no rows. Bounds choose what is compared, and every comparison is of whole
words of whole texts.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import kernels as K
from gridloom.llm.common import drop_scratch, keep_rows, plan_bytes, scratch_table, shuffle_width, text_rows
from gridloom.llm.vectors import summed

CELL, RANK, OVERSAMPLE, OTHERS, PASSAGE = 8, 96, 16, 8192, 48
DEVIATIONS, MARGIN = 4, 0.9
COPIED, PARAPHRASED, ANSWERED, LEAST = 0.75, 0.6, 0.6, 6
MAX_BENCHMARK_BYTES, MAX_INDEX_BYTES = 16 << 20, 256 << 20
HEAD, SLICE, MERGED, PAIR_WORDS, PART_BYTES = 512, 1 << 18, 1 << 20, 1 << 18, 16 << 20
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
SENTENCE = re.compile(r"(?<=[.!?])\s+")
U64 = np.uint64


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and each row's first word; words are runs of letters and digits, lower-cased A-Z."""
    data = K.LOWER[data]
    starts, ends, first = K.spans(data, offs, ~WORD[data])
    return K.word_hashes(data, starts, ends), first


def hashed(texts: list[str]) -> list[np.ndarray]:
    words, first = words_of(*K.buffers(pa.array(texts, pa.string())))
    return [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def positions(a: list[int]) -> dict[int, int]:
    """Of each word of a, the bits of its places."""
    where: dict[int, int] = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    return where


def common_length(where: dict[int, int], size: int, b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over a text of `size` words at `where`."""
    full = (1 << size) - 1
    row = full
    for w in b:
        if w in where:
            hit = row & where[w]
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


class Terms:
    """Numbers of words by their hashes: two tables of slots, the second for those that share a slot of the first."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.append(hashes, U64(0))
        self.n, self.bits = len(hashes), max(10, int(len(hashes)).bit_length() + 3)
        self.mask = U64((1 << self.bits) - 1)
        number = np.arange(self.n, dtype=np.int32)
        self.tables: list[np.ndarray] = []
        while len(number) and (len(self.tables) + 1) * 16 <= 64:
            slot = self.slots(hashes[number], len(self.tables))
            table = np.full(1 << self.bits, -1, np.int32)
            table[slot] = number
            self.tables.append(table)
            number = number[table[slot] != number]
        if len(number):
            raise ValueError("two words of the vocabulary have one hash")

    def slots(self, hashes: np.ndarray, k: int) -> np.ndarray:
        return ((hashes >> U64(16 * k)) & self.mask).astype(np.int64)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for others."""
        out = np.full(len(words), -1, np.int32)
        open_ = None
        for k, table in enumerate(self.tables):
            some = words if open_ is None else words[open_]
            at = table[self.slots(some, k)]
            at[self.hashes[at] != some] = -1
            if open_ is None:
                out, open_ = at, np.flatnonzero(at < 0)
            else:
                out[open_], open_ = at, open_[at < 0]
            if k + 1 < len(self.tables):
                # only slots that the next table fills need another look
                nxt = self.tables[k + 1][self.slots(words[open_], k + 1)] >= 0
                open_ = open_[nxt]
        return out


@dataclass
class Index:
    """Items by window length: ids, hashes of words and answers (one after another, and where each begins), numbers by
    ids (place); terms; weight (idf of each term, last 0); basis [terms + 1, rank]; weighted: basis times weight; latent [items, rank] of length one;
    bound (least cosine); cells (of a window); keys [lengths, terms + 1]: rarest words of the items of a length;
    need: how many of them a window holds; short: by number of words, sorted hashes of runs and their items; word_keys and
    word_bits: of items of at most 64 words, item * (terms + 1) + term, ascending, and the bits of the term's places; named: which
    terms (terms + 1) are words of items."""

    ids: list[int | None]
    place: np.ndarray
    words: np.ndarray
    first: np.ndarray
    answers: np.ndarray
    answer_first: np.ndarray
    terms: Terms
    weight: np.ndarray
    basis: np.ndarray
    weighted: np.ndarray
    latent: np.ndarray
    bound: np.ndarray
    cells: np.ndarray
    keys: np.ndarray
    need: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]
    word_keys: np.ndarray
    word_bits: np.ndarray
    named: np.ndarray

    def bytes(self) -> int:
        return sum(x.nbytes for x in (self.words, self.answers, self.weight, self.basis, self.weighted, self.latent, self.keys, self.word_keys, self.word_bits, *self.terms.tables))

    def item(self, k: int) -> list[int]:
        return self.words[self.first[k] : self.first[k + 1]].tolist()

    def answer(self, k: int) -> list[int]:
        return self.answers[self.answer_first[k] : self.answer_first[k + 1]].tolist()


def window_cells(size: int) -> int:
    """Cells of an item's windows: wherever half as many words again as the item has begin, a window holds them. Large
    numbers are rounded up to three binary digits, so there are few lengths."""
    n = -(-(size + size // 2 + CELL - 1) // CELL)
    unit = 1 << max(0, n.bit_length() - 4)
    return -(-n // unit) * unit


def grid(first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each word, and each row's first cell; rows with words have `least` cells at least, some of them empty."""
    count = np.diff(first)
    base = np.concatenate(([0], np.cumsum(np.where(count > 0, np.maximum(-(-count // CELL), least), 0))))
    row = np.repeat(np.arange(len(count)), count)
    return base[row] + (np.arange(first[-1]) - first[row]) // CELL, base


def run_sums(t: np.ndarray, run: np.ndarray, step: np.ndarray, n: int, size: int, matrix: np.ndarray) -> np.ndarray:
    """Of each of n runs of at most `size` words the sum of their rows of the matrix, whose last row is zero; step: place in
    the run. A few runs at a time, so that sums stay in the cache."""
    at = np.full((-(-n // 256), size, 256), len(matrix) - 1, np.int64)
    at[run >> 8, step, run & 255] = t
    out = np.empty((n, matrix.shape[1]), matrix.dtype)
    for k, places in enumerate(at):
        total = matrix[places[0]]
        for some in places[1:]:
            total += matrix[some]
        out[k << 8 : (k + 1) << 8] = total[: n - (k << 8)]
    return out


def merged(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, ascending, and the sums of their counts."""
    order = np.argsort(words)
    heads = K.group_starts(words[order])
    return words[order][heads], np.add.reduceat(counts[order], heads) if len(heads) else counts[:0]


def frequencies(rows: DataFrame, wanted: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of the wanted words and of the words that most documents hold (two at least), and how many
    documents hold each. All words of all documents are counted: partial counts meet in buckets of hashes."""
    wanted, buckets = np.unique(wanted), shuffle_width(rows)

    def packed(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        bucket = (words >> U64(32)) * U64(buckets) >> U64(32)  # ascends with the words
        heads = K.group_starts(bucket)
        cuts = list(itertools.pairwise([*heads.tolist(), len(words)]))
        cells = [[x[a:b].tobytes() for a, b in cuts] for x in (words, counts)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[heads].astype(np.int64)), *(pa.array(c, pa.binary()) for c in cells)], names=["bucket", "words", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [(np.zeros(0, U64), np.zeros(0, np.int64))], 0
        for batch in batches:
            for part in K.slices(batch, "text", SLICE):
                words, first = words_of(*K.buffers(part.column(1)))
                order = np.argsort(words, kind="stable")  # of equal words the rows ascend
                row = np.repeat(np.arange(part.num_rows), np.diff(first))[order]
                words = words[order]
                new = np.ones(len(words), bool)
                new[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
                words = words[new]
                heads = K.group_starts(words)
                held.append((words[heads], np.diff(np.append(heads, len(words)))))
                size += len(heads)
                if size > MERGED:
                    held = [merged(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > MERGED // 2:
                        yield packed(*held[0])
                        held, size = [(np.zeros(0, U64), np.zeros(0, np.int64))], 0
        yield packed(*merged(*map(np.concatenate, zip(*held, strict=True))))

    def meet(table: pa.Table) -> pa.Table:
        words, counts = merged(*(np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("words", U64), ("counts", np.int64))))
        own = wanted[np.minimum(np.searchsorted(wanted, words), len(wanted) - 1)] == words
        many = np.flatnonzero((counts > 1) & ~own)
        many = many[np.lexsort((words[many].view(np.int64), -counts[many]))[:most]]
        some = np.concatenate((np.flatnonzero(own), many))
        return pa.table({"word": pa.array(words[some].view(np.int64)), "n": pa.array(counts[some]), "own": pa.array(own[some])})

    found = rows.mapInArrow(count, "bucket long, words binary, counts binary").groupBy("bucket").applyInArrow(meet, "word long, n long, own boolean")
    found = scratch_table(found, "word-counts")
    seen = [*found.where("own").collect(), *found.where("not own").orderBy(F.desc("n"), "word").limit(most).collect()]
    drop_scratch(found)
    words, counts = np.array([r["word"] for r in seen], np.int64).view(U64), np.array([r["n"] for r in seen], np.int64)
    return merged(np.concatenate((words, wanted)), np.concatenate((counts, np.zeros(len(wanted), np.int64))))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Passages:
    """Sparse rows of length one: terms and values one after another, and where each row begins."""

    t: np.ndarray
    value: np.ndarray
    heads: np.ndarray

    @staticmethod
    def of(t: np.ndarray, row: np.ndarray, weight: np.ndarray, scale: float = 1.0) -> Passages:
        """t: terms of words, row: of each, ascending."""
        heads = K.group_starts(row)
        ends = np.append(heads[1:], len(row))
        # a term that stands twice in a row counts twice in its products, its length is taken of the sums
        order = np.lexsort((t, row))
        st, sr = t[order], row[order]
        edge = np.flatnonzero(np.concatenate(([True], (st[1:] != st[:-1]) | (sr[1:] != sr[:-1])))) if len(t) else heads
        sums = np.diff(np.append(edge, len(t))) * weight[st[edge]]
        own = K.group_starts(sr[edge])
        length = np.sqrt(np.add.reduceat(sums**2, own)) if len(own) else np.zeros(0)
        return Passages(t, weight[t] * scale / np.repeat(np.maximum(length, 1e-12), ends - heads), heads)

    def times(self, matrix: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.value[:, None] * matrix[self.t], self.heads) if len(self.t) else np.zeros((0, matrix.shape[1]))

    def back(self, y: np.ndarray, n: int) -> np.ndarray:
        """The transpose times y, [n terms, columns]."""
        out = np.zeros((n, y.shape[1]))
        owner = np.repeat(np.arange(len(self.heads)), np.diff(np.append(self.heads, len(self.t))))
        order = np.argsort(self.t, kind="stable")
        for a in range(0, len(order), 1 << 14):
            some = order[a : a + (1 << 14)]
            heads = K.group_starts(self.t[some])
            out[self.t[some[heads]]] += np.add.reduceat(self.value[some, None] * y[owner[some]], heads)
        return out


def document_factor(rows: DataFrame, terms: Terms, weight: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Of all passages of all documents, as rows of length one: F with F F' the low-rank part of their Gram matrix of
    terms, their sum, how many have terms, and the sum of their lengths before they were made one."""
    n = terms.n
    start = lambda: np.random.Generator(np.random.PCG64(5)).standard_normal((n, wide), np.float32)

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        omega, total, rest = np.vstack((start() * weight[:, None], np.zeros((1, wide)))).astype(np.float32), np.zeros((n, wide + 1)), np.zeros(2)
        # the commonest terms are multiplied as a dense matrix
        head, place = np.argsort(weight, kind="stable")[:HEAD], np.full(n, -1)
        place[head] = np.arange(len(head))
        for batch in batches:
            for part in K.slices(batch, "text", 4 * SLICE):
                words, first = words_of(*K.buffers(part.column(1)))
                t = terms.numbers(words)
                count = np.diff(first)
                base = np.cumsum(-(-count // PASSAGE)) + (-count // PASSAGE)
                row = np.repeat(np.arange(part.num_rows), count)
                step = np.arange(len(t)) - first[row]
                hit = t >= 0
                run, step, t = (base[row] + step // PASSAGE)[hit], step[hit] % PASSAGE, t[hit]
                if not len(t):
                    continue
                own = K.group_starts(run)
                run = np.repeat(np.arange(len(own)), np.diff(np.append(own, len(run))))
                y = np.ones((len(own), wide + 1), np.float32)  # the last column sums the passages
                y[:, :-1] = run_sums(t, run, step, len(own), PASSAGE, omega)
                key = np.sort(run * n + t)
                heads = K.group_starts(key)
                run, t = np.divmod(key[heads], n)
                value = np.diff(np.append(heads, len(key))) * weight[t]
                length = np.sqrt(np.bincount(run, value**2))
                y[:, :-1] /= length[:, None]
                value = (value / length[run]).astype(np.float32)
                rest += len(own), length.sum()
                common = place[t] >= 0
                dense = np.zeros((len(own), len(head)), np.float32)
                dense[run[common], place[t[common]]] = value[common]
                total[head] += dense.T @ y
                run, t, value = run[~common], t[~common], value[~common]
                order = np.argsort(t, kind="stable")
                for a in range(0, len(order), 2048):
                    some = order[a : a + 2048]
                    heads = K.group_starts(t[some])
                    total[t[some[heads]]] += np.add.reduceat(y[run[some]] * value[some, None], heads)
        return np.concatenate((total.ravel(), rest))

    # each part sends one dense sum, so small files go together
    parts = rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, plan_bytes(rows) // PART_BYTES))
    total = summed(parts, partial, n * (wide + 1) + 2)
    product = total[:-2].reshape(n, wide + 1)
    values, vectors = np.linalg.eigh(start().astype(float).T @ product[:, :-1])
    good = values > 1e-6 * max(values[-1], 1e-12)
    return product[:, :-1] @ (vectors[:, good] / np.sqrt(values[good])), product[:, -1], float(total[-2]), float(total[-1])


def singular_vectors(factor: np.ndarray, items: Passages, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors [terms, rank] and singular values of the items' passages and those of the factor."""
    n, wide = len(factor), min(len(factor), rank + OVERSAMPLE)
    q = np.random.Generator(np.random.PCG64(5)).normal(size=(n, wide))
    for _ in range(2):  # the range finder and one power iteration
        q, _ = np.linalg.qr(factor @ (factor.T @ q) + items.back(items.times(q), n))
    x, y = factor.T @ q, items.times(q)
    values, vectors = np.linalg.eigh(x.T @ x + y.T @ y)
    order = np.argsort(-values)[:rank]
    return q @ vectors[:, order], np.sqrt(np.maximum(values[order], 0))


def leak_bound(item: np.ndarray, words: int, mean: np.ndarray, spread: np.ndarray, latent: np.ndarray) -> float:
    """The cosine with the item (latent, of length one) that leaks in windows of `words` keep, all but those further than
    `DEVIATIONS` below their mean. item: latent vectors of its words; a leak keeps `PARAPHRASED` of them, each choice alike,
    amid surroundings by the mean and the covariance of passages, which counts as if the words of a passage, and passages
    that follow each other, went together or apart, whichever spreads more. Nothing is drawn: along the item and across it
    the first two moments of the sum are those of all choices and all passages; lengths across it are taken as of normal
    sums, and their root mean square as their mean, which is never less, so the bound errs low."""
    item, n, kept = item.astype(float), len(item), int(np.ceil(PARAPHRASED * len(item) - 1e-9))
    part = max(0, words - kept) / PASSAGE
    off = item - item.mean(0)
    mu = kept * item.mean(0) + part * mean
    cov = kept * (n - kept) / (n * (n - 1)) * off.T @ off + max(part, part * part) * spread
    along, turn = float(mu @ latent), cov @ latent
    var = float(turn @ latent)
    across = mu - along * latent
    turn = turn - var * latent  # the covariance of what is along and what is across
    rest = cov - np.outer(latent, turn) - np.outer(turn, latent) - var * np.outer(latent, latent)
    square = float(across @ across + np.trace(rest))
    if along <= DEVIATIONS * np.sqrt(max(var, 0.0)):
        return 0.0
    if square <= 1e-12 * along**2:
        return 1.0
    # of the length across: its root mean square, its variance and its covariance with what is along, to first order
    length = np.sqrt(square)
    var_across, both = float(np.sum(rest**2) / 2 + across @ rest @ across) / square, float(turn @ across) / length
    # the least tangent t with along - t * length = DEVIATIONS standard deviations of it
    z = DEVIATIONS**2
    a, b, c = square - z * var_across, along * length - z * both, along**2 - z * var
    t = c / (b + np.sqrt(max(0.0, b * b - a * c)))
    return float(1 / np.sqrt(1 + t**-2))


def cosines(t: np.ndarray, weight: np.ndarray, basis: np.ndarray, latent: np.ndarray) -> np.ndarray:
    """Of windows (terms, -1 for none) with one item's latent vector."""
    x = np.einsum("kw,kwr->kr", weight[t], basis[t])
    return unit(x) @ latent


def build_index(rows: DataFrame, benchmark: list[tuple[int | None, str]]) -> Index | None:
    """benchmark: in the order in which ties are settled."""
    hashes = hashed([t for _, t in benchmark])
    good = sorted((k for k, h in enumerate(hashes) if len(h) >= LEAST), key=lambda k: (window_cells(len(hashes[k])), k))
    brief = [k for k, h in enumerate(hashes) if 0 < len(h) < LEAST]
    if not good and not brief:
        return None
    order = good + brief
    answers = [h if len(h) >= 3 else hashes[k][-5:] for h, k in zip(hashed([SENTENCE.split(benchmark[k][1].strip())[-1] for k in order]), order, strict=True)]
    flat = lambda parts: (np.concatenate([np.zeros(0, U64), *parts]), np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))))
    words, first = flat([hashes[k] for k in order])
    short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(hashes[k]) for k in brief}:
        own = np.array([len(good) + j for j, k in enumerate(brief) if len(hashes[k]) == size])
        runs = np.array([K.grams(hashes[order[j]], size)[0] for j in own.tolist()], U64)
        by = np.lexsort((own, runs))
        short[size] = runs[by], own[by]
    hashes_of, df = frequencies(rows, words, OTHERS)
    terms, n = Terms(hashes_of), rows.count()
    weight = np.log((n + 1) / (df + 1)) + 1
    own = terms.numbers(words)[: first[len(good)]]
    owner = np.repeat(np.arange(len(good)), np.diff(first[: len(good) + 1]))
    rank = max(1, min(RANK, len(good) * 3 // 4, terms.n))
    mean, spread = np.zeros(rank), np.zeros((rank, rank))
    if good:
        factor, total, passages, lengths = document_factor(rows, terms, weight, min(terms.n, rank + OVERSAMPLE))
        # items weigh as much as the documents, or their passages would leave them no directions
        basis, _ = singular_vectors(factor, Passages.of(own, owner, weight, float(np.sqrt(max(1.0, passages / len(good))))), rank)
        if passages:
            mean, x = total @ basis / passages, factor.T @ basis
            values, turn = np.linalg.eigh(x.T @ x / passages - np.outer(mean, mean))
            spread = (turn * np.maximum(values, 0)) @ turn.T * (lengths / passages) ** 2
            mean = mean * lengths / passages
    else:
        basis = np.zeros((terms.n, rank))
    basis = np.vstack((basis, np.zeros((1, rank)))).astype(np.float32)
    weight = np.append(weight, 0.0).astype(np.float32)
    cells = np.array([window_cells(len(hashes[k])) for k in good], np.int64)
    items = [own[first[k] : first[k + 1]] for k in range(len(good))]
    latent = unit(np.array([(weight[i][:, None] * basis[i]).sum(0) for i in items]).reshape(len(good), rank)).astype(np.float32)
    bound = np.array([MARGIN * leak_bound(weight[i][:, None] * basis[i], int(c) * CELL, mean, spread, latent[k]) for k, (i, c) in enumerate(zip(items, cells.tolist(), strict=True))], np.float32)
    sizes = [int(c) for c in cells[K.group_starts(cells)]]
    keys, need = np.zeros((len(sizes), terms.n + 1), bool), np.full(len(sizes), 1 << 30)
    for k, i in enumerate(items):
        c = sizes.index(int(cells[k]))
        least = max(1, min(4, len(i) // 5))
        rare = i[np.argsort(-weight[i], kind="stable")][: len(i) - int(np.ceil(PARAPHRASED * len(i) - 1e-9)) + least]
        keys[c, rare] = True
        need[c] = min(need[c], least)
    small = np.diff(first[: len(good) + 1])[owner] <= 64
    word = owner[small] * (terms.n + 1) + own[small]
    by = np.argsort(word, kind="stable")
    heads = K.group_starts(word[by])
    bits = np.left_shift(U64(1), (np.arange(len(own)) - first[owner])[small][by].astype(U64))
    bits = np.bitwise_or.reduceat(bits, heads) if len(heads) else bits
    named = np.zeros(terms.n + 1, bool)
    named[own] = True
    index = Index([benchmark[k][0] for k in order], np.array(order), words, first, *flat(answers), terms, weight, basis, weight[:, None] * basis, latent, bound, cells, keys, need, short, word[by][heads], bits, named)
    if index.bytes() > MAX_INDEX_BYTES:
        raise ValueError(f"an index of {index.bytes()} bytes is over {MAX_INDEX_BYTES}; search the benchmark in parts")
    return index


def candidates(t: np.ndarray, first: np.ndarray, index: Index) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Words a window, and of each window whose cosine with an item reaches its bound row, item and first word; t: terms."""
    if not len(index.cells):
        return
    cuts = [*K.group_starts(index.cells).tolist(), len(index.cells)]
    sizes = [int(index.cells[c]) for c in cuts[:-1]]
    cell, base = grid(first, sizes[-1])
    n = int(base[-1])
    begins, mark = [], np.zeros(n + 1, np.int64)
    for c, size in enumerate(sizes):
        held = np.concatenate(([0], np.cumsum(np.bincount(cell[index.keys[c][t]], minlength=n))))
        may = np.flatnonzero(held[size:] - held[:-size] >= index.need[c])
        may = may[may + size <= base[np.searchsorted(base, may, "right")]]  # others begin in one row and end in another
        begins.append(may)
        mark += np.bincount(may, minlength=n + 1) - np.bincount(may + size, minlength=n + 1)
    used = np.cumsum(mark[:-1]) > 0
    if not used.any():
        return
    number = np.cumsum(used) - 1
    use = np.flatnonzero(used[cell] & (t >= 0))
    step = (np.arange(len(t)) - np.repeat(first[:-1], np.diff(first))) % CELL
    y = run_sums(t[use], number[cell[use]], step[use], int(number[-1]) + 1, CELL, index.weighted)
    sums = np.zeros((len(y) + 1, y.shape[1]))
    np.cumsum(y, axis=0, out=sums[1:])
    for c, (lo, hi, size) in enumerate(zip(cuts[:-1], cuts[1:], sizes, strict=True)):
        for a in range(0, len(begins[c]), 4096):
            begin = begins[c][a : a + 4096]
            at = number[begin]
            x = (sums[at + size] - sums[at]).astype(np.float32)
            near = x @ index.latent[lo:hi].T
            w, k = np.nonzero(near >= index.bound[lo:hi] * np.maximum(np.sqrt(np.einsum("wr,wr->w", x, x)), 1e-9)[:, None])
            row = np.searchsorted(base, begin[w], "right") - 1
            yield size * CELL, row, lo + k, np.minimum(first[row] + CELL * (begin[w] - base[row]), first[row + 1] - 1)


def places(t: np.ndarray, first: np.ndarray, index: Index) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, item, and the first and the last word of what is compared: windows of a row and an item that begin within the
    item's length of one are one place; the first place of a pair is marked."""
    length = np.diff(index.first)
    for reach, found in itertools.groupby(candidates(t, first, index), lambda x: x[0]):
        row, item, at = (np.concatenate(x) for x in list(zip(*found, strict=True))[1:])
        pair = row * len(length) + item
        order = np.lexsort((at, pair))
        row, item, at, pair = row[order], item[order], at[order], pair[order]
        heads = K.group_starts(pair)
        number = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(pair)))) * (len(t) + int(length.max()) + 1)
        after = np.searchsorted(number + at, number + at + length[item], "right")
        some, mark = heads, np.zeros(len(pair), bool)
        while len(some):
            mark[some] = True
            nxt = after[some]
            some = nxt[(nxt < len(pair)) & (pair[np.minimum(nxt, len(pair) - 1)] == pair[some])]
        head = np.zeros(len(pair), bool)
        head[heads] = True
        row, item, at, long = row[mark], item[mark], at[mark], length[item[mark]]
        yield row, item, np.maximum(first[row], at - long), np.minimum(first[row + 1], at + 2 * long + reach), head[mark]


def common_lengths(item: np.ndarray, lo: np.ndarray, hi: np.ndarray, t: np.ndarray, words: np.ndarray, index: Index) -> np.ndarray:
    """Longest common subsequence of each item with the words from lo to hi: bit-parallel, all pairs at once."""
    out, length = np.zeros(len(item), np.int64), np.diff(index.first)[item]
    short = np.flatnonzero(length <= 64)
    some = np.cumsum((hi - lo)[short]) // PAIR_WORDS
    for a, b in itertools.pairwise([*K.group_starts(some).tolist(), len(short)]):
        own = short[a:b]
        width = (hi - lo)[own]
        pair = np.repeat(np.arange(len(own)), width)
        near = t[np.arange(len(pair)) + np.repeat(lo[own] - np.cumsum(width) + width, width)]
        hit = np.flatnonzero(index.named[near])
        pair = pair[hit]
        key = item[own][pair] * (index.terms.n + 1) + near[hit]
        at = np.minimum(np.searchsorted(index.word_keys, key), len(index.word_keys) - 1)
        hit = np.flatnonzero(index.word_keys[at] == key)
        count = np.bincount(pair[hit], minlength=len(own))
        step = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
        bits = np.zeros((int(count.max(initial=0)), len(own)), U64)
        bits[step, pair[hit]] = index.word_bits[at[hit]]
        full = np.full(len(own), ~U64(0)) >> (64 - length[own]).astype(U64)
        row = full.copy()
        for mask in bits:
            both = row & mask
            row = (row + both) | (row - both)
        out[own] = length[own] - np.bitwise_count(row & full)
    for k in np.flatnonzero(length > 64).tolist():
        out[k] = common_length(positions(index.item(int(item[k]))), int(length[k]), words[lo[k] : hi[k]].tolist())
    return out


def search(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    replies = lru_cache(4096)(lambda k: positions(index.answer(k)))
    length = np.diff(index.first)
    for batch in batches:
        for part in K.slices(batch, "text", SLICE):
            words, first = words_of(*K.buffers(part.column(1)))
            t, n = index.terms.numbers(words), part.num_rows
            tried, best, item, answered, bad = np.zeros(n, np.int64), np.zeros(n), np.full(n, -1, np.int64), np.zeros(n), np.zeros(n, bool)

            def better(r: int, k: int, ratio: float) -> bool:
                return ratio > best[r] or ratio == best[r] > 0 and index.place[k] < index.place[item[r]]  # noqa: B023

            for row, k, lo, hi, head in places(t, first, index):
                tried += np.bincount(row[head], minlength=n)
                ratio = common_lengths(k, lo, hi, t, words, index) / length[k]
                order = np.lexsort((index.place[k], -ratio, row))
                for j in order[K.group_starts(row[order])].tolist():
                    if better(int(row[j]), int(k[j]), ratio[j]):
                        best[row[j]], item[row[j]] = ratio[j], k[j]
                for j in np.flatnonzero(ratio >= PARAPHRASED).tolist():
                    r, reply = int(row[j]), index.answer(int(k[j]))
                    hit = common_length(replies(int(k[j])), len(reply), words[lo[j] : hi[j]].tolist()) / len(reply)
                    answered[r] = max(answered[r], hit)
                    bad[r] |= ratio[j] >= COPIED or hit >= ANSWERED
            for size, (runs, items) in index.short.items():
                if len(words) < size:
                    continue
                row = np.searchsorted(first, np.arange(len(words) - size + 1), "right") - 1
                gram = K.grams(words, size)
                at = np.minimum(np.searchsorted(runs, gram), len(runs) - 1)
                for p in np.flatnonzero((runs[at] == gram) & (np.arange(len(gram)) + size <= first[row + 1])).tolist():
                    r, k = int(row[p]), int(items[at[p]])
                    if better(r, k, 1.0):
                        best[r], item[r] = 1.0, k
                    tried[r], answered[r], bad[r] = tried[r] + 1, 1.0, True
            ids = [index.ids[k] if k >= 0 else None for k in item.tolist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tried), pa.array(ids, pa.int64()), pa.array(best), pa.array(answered), pa.array(bad)], names=["doc_id", "n_candidates", "item_id", "subsequence", "answer", "contaminated"])


FOUND = "doc_id long, n_candidates long, item_id long, subsequence double, answer double, contaminated boolean"


def indexed(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> Index | None:
    wanted = text_rows(benchmark, "item_id", "text")
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"a benchmark of {size} bytes is over {MAX_BENCHMARK_BYTES}; search it in parts")
    items = sorted(((r["doc_id"], r["text"]) for r in wanted.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    return build_index(text_rows(docs, id_col, text_col), items)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_candidates, item_id, subsequence, answer, contaminated: one row per document."""
    index, rows = indexed(docs, benchmark, id_col, text_col), text_rows(docs, id_col, text_col)
    if index is None:
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_candidates"), F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("subsequence"), F.lit(0.0).alias("answer"), F.lit(False).alias("contaminated"))
    return rows.mapInArrow(lambda it: search(it, index), FOUND)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    index = indexed(docs, benchmark, id_col, text_col)
    if index is None:
        return docs
    return keep_rows(docs, lambda b: np.concatenate([~np.asarray(x.column(5).to_numpy(zero_copy_only=False), bool) for x in search(iter([b]), index)]), SLICE, id_col, text_col)
