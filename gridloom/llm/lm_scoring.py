"""Masked pseudo-likelihood with a bidirectional window network.

Every token is predicted from the two tokens on either side. Words are slots of a hash (`SLOTS`); neighbours are folded
into `INPUTS`. The network sums one vector for each neighbouring position and applies tanh; a hierarchical softmax over
all slots follows: slots are leaves of a Huffman tree over the whole corpus's counts, with a wide root (`ROOT` branches,
one dense product for all tokens) and inner nodes of `ARITY` branches; every node has a softmax of its own over its
branches, begun at their shares of the counts. So context decides at every step down to the slot. A document's score is
the sum of log-probabilities over all its tokens, each masked in turn.

Texts are tokenised once, into a table of slots (two bytes a token). Corpus counts come from all documents. Training
takes every run of tokens: parts of about `PART_TOKENS` tokens take gradient steps in numpy from the same start, and
parameters are averaged by tokens in a tree of shuffles, `PASSES` times, so what is gathered grows with the corpus. The
passes share out the runs, counted on through a part, so each token gives a gradient in one of them. Runs begin short,
for many early steps, and grow with the tokens a part has seen, up to `RUN`. Parameters have a fixed size.

Defined results: null and empty texts have no tokens, score 0 and a null mean; a missing neighbour has the vector of
an edge; a long text is one row of slots, so nothing is cut; repeated rows score alike (and count as often in the corpus
as they occur); an empty table has no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import kernels as K
from gridloom.llm.common import scratch_table, text_rows
from gridloom.llm.vectors import summed

SLOTS, INPUTS, ROOT, ARITY, DIM = 1 << 16, 1 << 12, 64, 4, 8
NODES = (SLOTS - ROOT) // (ARITY - 1)
OFFSETS = (-2, -1, 1, 2)
RUN, LEAST_RUN, RATE, PASSES, FLOOR = 4096, 256, 1.0, 2, 1e-5
SLICE, PART_TOKENS, HIGHEST = 1 << 19, 4 << 20, 60.0
EDGE = INPUTS
#: Vectors of neighbours, weights of inner nodes and of the root; a bias is the weight of a hidden unit that is always 1.
SHAPES = ((len(OFFSETS) * (INPUTS + 1), DIM), (NODES, ARITY, DIM + 1), (DIM + 1, ROOT))
SIZE = sum(int(np.prod(s)) for s in SHAPES)
TOKENS = "doc_id long, n_tokens long, slots binary"


def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words of a slice (lower-cased A-Z), and where each row's begin."""
    data, offs = K.buffers(part.column(1))
    data = K.LOWER[data]
    starts, ends, first = K.spans(data, offs)
    return (K.word_hashes(data, starts, ends) & np.uint64(SLOTS - 1)).astype(np.uint16), first


def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch, "text", SLICE):
            slots, first = tokens(part)
            rows = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((2 * first).astype(np.int32)), pa.py_buffer(slots.tobytes())])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), rows], names=["doc_id", "n_tokens", "slots"])


def runs_of(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """doc_id, slots of several rows and where each row's begin."""
    for batch in batches:
        for part in K.slices(batch, "slots", 2 * most):
            data, offs = K.buffers(part.column(2))
            yield part.column(0), np.frombuffer(data.tobytes(), "<u2").astype(np.int32), offs // 2


def corpus_counts(rows: DataFrame) -> np.ndarray:
    """How often each slot occurs, over all documents."""

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(SLOTS)
        for _, slots, _ in runs_of(batches):
            total += np.bincount(slots, minlength=SLOTS)
        return total

    return summed(rows, partial, SLOTS)


class Paths:
    """Of each slot its branch of the root, and the nodes below the root with the branches taken, one slot after another."""

    def __init__(self, path: np.ndarray, taken: np.ndarray) -> None:
        inside = path >= 0
        self.root = taken[:, 0].astype(np.int64)
        self.node = path[inside].astype(np.uint16)
        self.kid = taken[:, 1:][inside].astype(np.int64)
        self.size = inside.sum(1)
        self.at = np.cumsum(self.size) - self.size

    def of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The choices below the root that lead to tokens: token, node, branch, and where each token's begin (tokens with none left out)."""
        size = self.size[slots]
        ends = np.cumsum(size)
        token = np.repeat(np.arange(len(slots)), size)
        place = np.arange(len(token)) + np.repeat(self.at[slots] - ends + size, size)
        return token, self.node[place], self.kid[place], (ends - size)[size > 0]


def tree(counts: np.ndarray) -> tuple[Paths, np.ndarray, np.ndarray]:
    """Huffman tree of slots by count (add-one), log shares of branches [nodes, branches] and of the root's."""
    mass = np.concatenate((counts + 1, np.zeros(NODES)))
    parent, branch, prior = np.full(SLOTS + NODES, -1), np.zeros(SLOTS + NODES, np.int8), np.zeros((NODES, ARITY))
    heap = [(m, k) for k, m in enumerate(mass[:SLOTS].tolist())]
    heapq.heapify(heap)
    for node in range(NODES):
        taken = [heapq.heappop(heap) for _ in range(ARITY)]
        masses, ids = (list(x) for x in zip(*taken, strict=True))
        total = sum(masses)
        parent[ids], branch[ids], prior[node], mass[SLOTS + node] = node, np.arange(ARITY), np.log(masses) - np.log(total), total
        heapq.heappush(heap, (total, SLOTS + node))
    tops = sorted(heap, reverse=True)
    of_root = np.array([k for _, k in tops])
    branch[of_root] = np.arange(ROOT)
    shares = np.log([m for m, _ in tops]) - np.log(mass[:SLOTS].sum())
    at, nodes, kids = np.arange(SLOTS), [], []
    while (at >= 0).any():
        up = np.where(at >= 0, parent[at], -1)
        nodes.append(up)
        kids.append(np.where(at >= 0, branch[at], 0))
        at = np.where(up >= 0, SLOTS + up, -1)
    # from leaves up: paths are turned round, so that all begin at the root
    depth = sum((n >= 0).astype(np.int64) for n in nodes)
    path, taken_ = np.full((SLOTS, len(nodes)), -1, np.int32), np.zeros((SLOTS, len(nodes)), np.int8)
    rows = np.arange(SLOTS)
    for k, (n, b) in enumerate(zip(nodes, kids, strict=True)):
        live = k <= depth
        taken_[rows[live], depth[live] - k] = b[live]
        below = n >= 0
        path[rows[below], depth[below] - 1 - k] = n[below]
    return Paths(path[:, : taken_.shape[1] - 1], taken_), prior, shares


def unpack(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in SHAPES:
        n = int(np.prod(s))
        out.append(np.array(flat[at : at + n], np.float32).reshape(s))
        at += n
    return out


def start(prior: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Small random numbers, and the shares of branches as their biases."""
    rng = np.random.Generator(np.random.PCG64(3))
    parts = [rng.normal(0, 0.05, s) for s in SHAPES]
    parts[1][:, :, DIM], parts[2][DIM] = prior, shares
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def neighbours(slots: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[positions, tokens] rows of the vectors of what stands around each token, within its row."""
    n, folded = len(slots), slots & (INPUTS - 1)
    shift = np.arange(len(OFFSETS)) * (INPUTS + 1)
    out = np.repeat((shift + EDGE).astype(np.uint16)[:, None], n, axis=1)
    count = np.diff(first)
    place = np.arange(n) - np.repeat(first[:-1], count)
    rest = np.repeat(count, count) - place
    for k, o in enumerate(OFFSETS):
        inside = np.flatnonzero(place >= -o if o < 0 else rest > o)
        out[k, inside] = folded[inside + o] + shift[k]
    return out


def hidden(inputs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """[tokens, DIM + 1]; the last unit is 1."""
    out = np.ones((inputs.shape[1], DIM + 1), np.float32)
    h = vectors.take(inputs[0], axis=0)
    for k in range(1, len(OFFSETS)):
        h += vectors.take(inputs[k], axis=0)
    np.tanh(h, out=out[:, :DIM])
    return out


def normalised(p: np.ndarray) -> np.ndarray:
    np.minimum(p, HIGHEST, out=p)
    np.exp(p, out=p)
    p /= np.einsum("nk->n", p)[:, None]
    return p


def log_share(p: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log of the normalised value at `own` of each row."""
    np.minimum(p, HIGHEST, out=p)
    mine = p[np.arange(len(p)), own]
    return (mine - np.log(np.einsum("nk->n", np.exp(p, out=p)))).astype(float)


def products(h: np.ndarray, token: np.ndarray, node: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each choice: hidden state, the node's weights, and their products."""
    state, weights = h.take(token, axis=0), top.take(node, axis=0)
    return state, weights, np.einsum("nkd,nd->nk", weights, state)


def descend(value: np.ndarray, past: np.ndarray, used: np.ndarray, grad: np.ndarray) -> None:
    """A step of rows against their gradient, shorter where gradients were large; both in two dimensions."""
    seen = past[used] + np.einsum("nd,nd->n", grad, grad) / grad.shape[1]
    past[used] = seen
    grad *= (0.1 * RATE / np.sqrt(seen))[:, None]
    value[used] -= grad


def train(batches: Iterator[pa.RecordBatch], flat: np.ndarray, paths: Paths, turn: int) -> np.ndarray:
    """Gradient steps over the runs of the part that are this turn's; parameters and, last, tokens: both weighted by tokens."""
    vectors, top, root = unpack(flat)
    seen, seen_top, seen_root = np.full(len(vectors), FLOOR, np.float32), np.full(NODES, FLOOR, np.float32), np.full(root.shape, FLOOR, np.float32)
    flat_top = top.reshape(NODES, -1)
    n, done, runs = 0, 0, 0
    for _, slots, first in runs_of(batches):
        if not len(slots):
            continue
        inputs = neighbours(slots, first)
        end = 0
        while end < len(slots):
            at, end = end, end + min(RUN, max(LEAST_RUN, done // 32))
            x, y = inputs[:, at:end], slots[at:end]
            m = len(y)
            done, runs = done + m, runs + 1
            if runs % PASSES != turn:
                continue
            h = hidden(x, vectors)
            p = normalised(h @ root)
            p[np.arange(m), paths.root[y]] -= 1
            p /= m
            back = p @ root.T
            grad = h.T @ p
            seen_root += grad * grad
            token, node, kid, heads = paths.of(y)
            if len(token):
                state, weights, p = products(h, token, node, top)
                p = normalised(p)
                p[np.arange(len(p)), kid] -= 1
                p /= m
                back[token[heads]] += np.add.reduceat(np.einsum("nk,nkd->nd", p, weights), heads)
                order = np.argsort(node, kind="stable")
                heads = K.group_starts(node[order])
                outer = np.einsum("nk,nd->nkd", p.take(order, axis=0), state.take(order, axis=0)).reshape(len(p), -1)
                descend(flat_top, seen_top, node[order[heads]], np.add.reduceat(outer, heads))
            root -= 0.1 * RATE * grad / np.sqrt(seen_root)
            back = back[:, :DIM] * (1 - h[:, :DIM] ** 2)
            rows = x.ravel()
            order = np.argsort(rows, kind="stable")
            heads = K.group_starts(rows[order])
            descend(vectors, seen, rows[order[heads]], np.add.reduceat(back.take(order % m, axis=0), heads))
            n += m
    return np.concatenate([*(v.ravel().astype(float) * n for v in (vectors, top, root)), [n]])


def log_probabilities(slots: np.ndarray, first: np.ndarray, model: list[np.ndarray], paths: Paths) -> np.ndarray:
    vectors, top, root = model
    inputs, out = neighbours(slots, first), np.empty(len(slots))
    for at in range(0, len(slots), 4096):
        y = slots[at : at + 4096]
        h = hidden(inputs[:, at : at + 4096], vectors)
        part = log_share(h @ root, paths.root[y])
        token, node, kid, heads = paths.of(y)
        if len(token):
            part[token[heads]] += np.add.reduceat(log_share(products(h, token, node, top)[2], kid), heads)
        out[at : at + 4096] = part
    return out


def fitted(rows: DataFrame) -> tuple[list[np.ndarray], Paths]:
    """rows: doc_id, n_tokens, slots. Parameters, and the tree's paths."""
    counts = corpus_counts(rows)
    paths, prior, shares = tree(counts)
    flat = start(prior, shares)
    parts = rows.coalesce(max(4, int(counts.sum()) // PART_TOKENS))
    for turn in range(PASSES):
        total = summed(parts, lambda it, flat=flat, turn=turn: train(it, flat, paths, turn), SIZE + 1)
        flat = (total[:-1] / total[-1]).astype(np.float32) if total[-1] else flat
    return unpack(flat), paths


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood."""
    rows = scratch_table(text_rows(docs, id_col, text_col).mapInArrow(tokenised, TOKENS), "tokens")
    model = fitted(rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, slots, first in runs_of(batches):
            sums = np.concatenate(([0.0], np.cumsum(log_probabilities(slots, first, *model))))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first)), pa.array(sums[first[1:]] - sums[first[:-1]])], names=["doc_id", "n_tokens", "log_likelihood"])

    out = rows.mapInArrow(score, "doc_id long, n_tokens long, log_likelihood double")
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
