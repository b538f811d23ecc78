"""Toxicity by subword bags: character n-gram embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a bag of the hashes of its grams of 3 to 5 characters (code points, lower-cased), its borders included, so
misspellings share most of their grams with what was seen, in any script. A window of `WORDS` words is the average of
its grams' vectors; a text's logit is that of its most toxic window, so a long text isn't diluted. Both layers are
trained together, with Adagrad, on a bounded sample of labelled rows; a part of it calibrates the logit, its clean rows
weighing as much more as they were drawn more thinly. For scoring, vectors and softmax fold into one number for each gram.

Bounds: `FIT_ROWS` ids of each label, in the order of a hash of doc_id, whole texts of any length; of an id that stands
on several rows the least text is taken. Scoring reads every whole text. Defined results: null and empty texts have no
window and get the score of an empty bag; rows without labels are scored alike; without labels of both kinds every score
is next to 0 (1e-13); a score equal to the threshold counts as toxic; repeated rows score alike; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import kernels as K
from gridloom.llm.common import keep_rows, scratch_table, text_rows

FIT_ROWS = 1500
SIZES, BUCKETS, DIM, WORDS = (3, 4, 5), 1 << 16, 6, 3
STEPS, WHOLE, RATE, BATCH, THRESHOLD = 800, 60, 0.3, 64, 0.7
SLICE = 1 << 18
U32 = np.uint32


#: Lower case of each code point of the basic plane, where that is one code point.
LOWER = np.array([ord(x) if len(x := chr(k).lower()) == 1 else k for k in range(1 << 16)], U32)


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one lower-case buffer of code points with a blank before, between and after them; where each begins."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le", "surrogatepass"), U32)
    data = np.where(data < len(LOWER), LOWER[np.minimum(data, len(LOWER) - 1)], data)
    return data, np.concatenate(([1], 1 + np.cumsum(sizes + 1)))


def bags(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window of each character, first window of each text, and blanks before each character."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    word = np.cumsum(~blank[1:] & blank[:-1])
    word = np.concatenate(([0], word))  # words begun up to and with each character
    first = word[begins - 1]  # words before each text
    count = np.diff(first)
    windows = np.concatenate(([0], np.cumsum(-(-count // WORDS))))
    row = np.repeat(np.arange(len(count)), np.diff(begins))
    window = np.zeros(len(data), np.int64)
    within = np.maximum(word[begins[0] : begins[-1]] - first[row] - 1, 0) // WORDS
    window[begins[0] : begins[-1]] = windows[row] + np.minimum(within, np.maximum(-(-count // WORDS) - 1, 0)[row])
    return window, windows, np.cumsum(blank)


def grams(data: np.ndarray, blanks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: bucket of the gram at each character, and where one stands (no blank inside it)."""
    wide = data.copy()
    wide[(data >= 9) & (data <= 13)] = 32
    for n in SIZES:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = np.full(m, U32(n * 0x9E3779B1 & 0xFFFFFFFF))
        for k in range(n):
            h = (h ^ wide[k : k + m]) * U32(16777619)
        h ^= h >> U32(15)
        inside = np.flatnonzero(blanks[n - 2 : n - 2 + m] == blanks[:m])
        yield h & U32(BUCKETS - 1), inside


def fit(texts: list[str], toxic: list[int], clean_weight: float = 1.0) -> tuple[np.ndarray, float, float, float]:
    """Value of each bucket, bias, and the calibration's slope and shift; clean_weight: rows that a clean one stands for, against a toxic one."""
    rng = np.random.Generator(np.random.PCG64(11))
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS, np.float32), -30.0, 1.0, 0.0
    bag = []
    for t in texts:
        data, begins = stream([t])
        window, windows, blanks = bags(data, begins)
        ids, where = [], []
        for h, inside in grams(data, blanks):
            ids.append(h[inside].astype(np.uint16))
            where.append(window[np.minimum(inside + 1, len(data) - 1)])
        w = np.concatenate(where)
        order = np.argsort(w, kind="stable")
        bag.append((np.concatenate(ids)[order].astype(np.uint16), np.searchsorted(w[order], np.arange(int(windows[-1]) + 1))))
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM))
    top, bias = rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    seen, seen_top, seen_bias = np.full(BUCKETS, 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    parts = [rng.permutation(np.flatnonzero(y == t)) for t in (0, 1)]
    held, train = (np.concatenate([p[k] for p in parts]) for k in (slice(0, None, 5), slice(0, None)))
    train = np.setdiff1d(train, held) if min(map(len, parts)) >= 5 else train

    def worst(k: int, whole: bool, value: np.ndarray) -> np.ndarray:
        ids, cuts = bag[k]
        if whole or len(cuts) <= 2:
            return ids
        sums = np.concatenate(([0.0], np.cumsum(value[ids])))
        mean = (sums[cuts[1:]] - sums[cuts[:-1]]) / np.maximum(np.diff(cuts), 1)
        w = int(mean.argmax())
        return ids[cuts[w] : cuts[w + 1]]

    sides = [train[y[train] == t] for t in (0, 1)]
    for step in range(STEPS):
        rows = np.concatenate([rng.choice(side, BATCH // 2) for side in sides])
        value = vectors @ (top[:, 1] - top[:, 0])
        chosen = [worst(k, step < WHOLE, value) for k in rows.tolist()]
        sizes = np.array([max(len(c), 1) for c in chosen])
        mean = np.array([vectors[c].sum(0) for c in chosen]) / sizes[:, None]
        logits = mean @ top + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), y[rows].astype(int)] -= 1
        p /= len(rows)
        back = p @ top.T / sizes[:, None]
        ids = np.concatenate(chosen)
        owner = np.repeat(np.arange(len(rows)), [len(c) for c in chosen])
        used, place = np.unique(ids, return_inverse=True)
        grad = np.stack([np.bincount(place, back[owner, d], len(used)) for d in range(DIM)], 1)
        seen[used] += (grad**2).mean(1)
        vectors[used] -= RATE * grad / np.sqrt(seen[used])[:, None]
        g = mean.T @ p
        seen_top += g**2
        top -= RATE * g / np.sqrt(seen_top)
        g = p.sum(0)
        seen_bias += g**2
        bias -= RATE * g / np.sqrt(seen_bias)
    value = (vectors @ (top[:, 1] - top[:, 0])).astype(np.float32)
    shift = float(bias[1] - bias[0])
    few = y[held].sum() < 20
    rows = np.arange(len(y)) if few else held
    z = np.array([(value[c].mean() if len(c := worst(k, False, value)) else 0.0) + shift for k in rows.tolist()])
    return value, shift, *calibrated(z, y[rows], clean_weight)


def calibrated(z: np.ndarray, y: np.ndarray, weight: float) -> tuple[float, float]:
    """Slope and shift that put the threshold where F1 is best, a clean row counting `weight` times."""
    order = np.argsort(-z, kind="stable")
    hits, false = np.cumsum(y[order]), weight * np.cumsum(1 - y[order])
    f1 = 2 * hits / (y.sum() + hits + false)
    k = int(f1.argmax())
    cut = (z[order[k]] + z[order[min(k + 1, len(z) - 1)]]) / 2
    spread = abs(float(z[y == 1].mean() - z[y == 0].mean())) or 1.0
    a = 6.0 / spread
    return a, float(np.log(THRESHOLD / (1 - THRESHOLD)) - a * cut)


def score(texts: list[str], model: tuple[np.ndarray, float, float, float]) -> np.ndarray:
    value, shift, a, b = model
    data, begins = stream(texts)
    window, windows, blanks = bags(data, begins)
    n = int(windows[-1])
    total, count = np.zeros(n), np.zeros(n)
    for h, inside in grams(data, blanks):
        w = window[np.minimum(inside + 1, len(data) - 1)]  # a gram may begin with the blank before its word
        total += np.bincount(w, value[h[inside]], n)[:n] if n else 0
        count += np.bincount(w, minlength=n)[:n] if n else 0
    mean = total / np.maximum(count, 1)
    most = np.zeros(len(texts))
    full = np.flatnonzero(np.diff(windows))
    if len(full):
        most[full] = np.maximum.reduceat(mean, windows[:-1][full])
    return 1 / (1 + np.exp(-np.clip(a * (most + shift) + b, -30, 30)))


def scored(batches: Iterator[pa.RecordBatch], model: tuple[np.ndarray, float, float, float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch, "text", SLICE):
            s = score(part.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], names=["doc_id", "score"])


def held_out(doc_id: object) -> object:
    """crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float, float, float]:
    """Fits on at most `fit_rows` rows of each label that are not held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(~held_out("doc_id")).distinct()
    rows = text_rows(docs, id_col, text_col).where(F.length("text") > 0)
    # ids are chosen first, so that only the chosen texts move
    found = scratch_table(marks.join(rows.select("doc_id"), "doc_id", "left_semi").select("doc_id", "toxic", F.xxhash64("doc_id").alias("place")), "labelled", 8)
    sides = [found.where(F.col("toxic") == t).orderBy("place", "doc_id").limit(fit_rows) for t in (0, 1)]
    chosen = sorted(sides[0].unionByName(sides[1]).collect(), key=lambda r: (r["toxic"], r["place"], r["doc_id"]))
    ids = F.broadcast(docs.sparkSession.createDataFrame([(r["doc_id"],) for r in chosen], "doc_id long").distinct())  # at most 2 * fit_rows ids
    texts = {r["doc_id"]: r["text"] for r in rows.join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    there = {r["toxic"]: r["n"] for r in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = [sum(r["toxic"] == t for r in chosen) for t in (0, 1)]
    weight = (there[0] / drawn[0]) / (there[1] / drawn[1]) if all(drawn) else 1.0
    return fit([texts[r["doc_id"]] for r in chosen], [r["toxic"] for r in chosen], weight)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    out = text_rows(docs, id_col, text_col).mapInArrow(lambda it: scored(it, model), "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    return keep_rows(docs, lambda b: score(b.column(1).to_pylist(), model) < THRESHOLD, SLICE, id_col, text_col)
