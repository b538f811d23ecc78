"""Vectorised text kernels on Arrow buffers: word boundaries, word hashes, n-gram hashes.

All of them work on the UTF-8 bytes of many documents at once; nothing loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240517))
#: A random 64-bit value for each byte; words are hashed as a polynomial over these.
BYTE_VALUE = _rng.integers(0, 2**64, 256, dtype=U64)
BASE = U64(0x9E3779B97F4A7C15 | 1)
INVERSE = U64(pow(int(BASE), -1, 2**64))
LENGTH_SALT = U64(0xD6E8FEB86659FD93)
GRAM = _rng.integers(0, 2**64, 64, dtype=U64) | U64(1)
WORD_BLOCK = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        m = max(n, WORD_BLOCK + 4096)
        for k, b in (("p", BASE), ("i", INVERSE)):
            a = np.full(m, b, U64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["i"][:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the offsets of its rows; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, off, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about `most` bytes of text, so that memory doesn't follow the batch's size."""
    _, offs = buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def spans(data: np.ndarray, offs: np.ndarray, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes other than space and 9 to 13, or not `blank`) and each row's first word."""
    blank = (data == 32) | ((data >= 9) & (data <= 13)) if blank is None else blank
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.ones(len(data) + 1, bool)
    before[1:] = blank
    start = ~blank & (before[:-1] | edge[:-1])
    after = np.ones(len(data) + 1, bool)
    after[:-1] = blank
    end = ~blank & (after[1:] | edge[1:])
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, by prefix sums over blocks that end between words."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + WORD_BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        p, inv = powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum(BYTE_VALUE[data[lo:hi]] * p[:-1], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(U64) * LENGTH_SALT)
        i = j
    return out


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, by position of its first word."""
    if len(words) < n:
        return np.zeros(0, U64)
    m = len(words) - n + 1
    total = words[:m] * GRAM[0]
    for k in range(1, n):
        total += words[k : k + m] * GRAM[k]
    return mix(total)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """min(x[i:i+n]) for each i, by doubling."""
    if len(x) < n:
        return x[:0]
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def narrow(x: np.ndarray) -> bytes:
    """Integers as their least and offsets from it in as few bytes as they need; `widen` reads them."""
    x = np.asarray(x, np.int64)
    if not len(x):
        return b""
    low = int(x.min())
    span = int(x.max()) - low
    width = 1 if span < 1 << 8 else 2 if span < 1 << 16 else 4 if span < 1 << 32 else 8
    rest = x.view(U64) - np.int64(low).view(U64) if width == 8 else x - low
    return bytes([width]) + np.int64(low).tobytes() + rest.astype(f"<u{width}").tobytes()


def widen(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    rest = np.frombuffer(raw, f"<u{raw[0]}", offset=9)
    low = np.frombuffer(raw, np.int64, 1, 1)[0]
    return (rest.astype(U64) + low.view(U64)).view(np.int64)


def group_starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
