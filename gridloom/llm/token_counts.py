"""Token counts by a compiled finite-state transducer.

Byte-pair encoding of one pre-token is unique: it is the only way to cut the pre-token into vocabulary items of
which each two neighbours are compatible (their merge order keeps them apart). A nondeterministic machine therefore
has the states (last whole token, place in the vocabulary trie), reads a byte, and emits 1 when a token ends.
Its subsets are determinised on demand: a deterministic state is the set of live (token, trie place) pairs with
their counts less the least of them, a transition carries that least count as its output, and the state's final
output is the remaining count of the one path that ends with the pre-token. Compiled transitions are shared by all
texts a worker reads.

Texts are cut into chunks of `CHUNK` characters, anywhere, and each chunk is mapped by itself. The pre-tokeniser is
regular; a space before a non-space always starts a pre-token, whatever comes before, so from a chunk's first such space
to its last one the count is the same in any state, and the machine starts anew. What is before the first one continues
the state that comes in, and what is after the last one is the state that goes out: a `ChunkMap` holds these two open
texts and the count between them. Two maps compose into one, associatively; the maps of all texts of a slice are reduced
by a parallel scan, level by level, all neighbouring pairs of a level at once, and a text's count is read from its last map.

Defined results: null and empty texts have no tokens; the special token's string counts as one token, as the
library does by default; texts are never truncated; repeated rows count each; an empty table has no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import text_rows
from gridloom.llm.kernels import slices

SPECIAL = "<|endoftext|>"
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CUT = regex.compile(r" (?=\S)")
#: Words remembered and states kept by a worker; beyond, it starts anew.
MEMO, STATES = 150_000, 200_000
LIMIT, SLICE, CHUNK = 512, 1 << 20, 4096


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes as: printable Latin-1 as itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """The deterministic machine over bytes for one vocabulary (a .json of the tokenizers library)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        self.tokens = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        raw = lambda t: bytes(letters[c] for c in t)
        self.rank: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(pairs):
            a, b = raw(a), raw(b)
            self.rank[self.tokens[a], self.tokens[b]] = k
        self.spelt = {i: t for t, i in self.tokens.items()}
        self.joins = {p: self.tokens[self.spelt[p[0]] + self.spelt[p[1]]] for p in self.rank}
        self.trie: list[dict[int, int] | None] = [{}]
        self.ends: list[int] = [-1]
        for t, i in self.tokens.items():
            if t and self.encode(t) == [i]:
                at = 0
                for b in t:
                    if self.trie[at] is None:
                        self.trie[at] = {}
                    if b not in self.trie[at]:
                        self.trie[at][b] = len(self.trie)
                        self.trie.append(None)
                        self.ends.append(-1)
                    at = self.trie[at][b]
                self.ends[at] = i
        self.reset()

    def reset(self) -> None:
        """Forgets what has been compiled, so that memory stays bounded; it compiles again as texts need it."""
        self.allowed: dict[int, bool] = {}
        self.states: dict[tuple[int, ...], int] = {}
        self.sets: list[tuple[int, ...]] = []
        self.kinds = np.full(256, -1, np.int64)
        self.table = np.full((1 << 12, 64), -1, np.int32)
        self.final = np.zeros(1 << 12, np.int32)
        self.memo: dict[str, int] = {"": 0}
        self.start = self.state((0,))

    def encode(self, piece: bytes) -> list[int]:
        """Merges by rank, the definition; used to compile, not to count."""
        ids = [self.tokens[bytes([b])] for b in piece]
        while len(ids) > 1:
            ranks = [self.rank.get(p, 1 << 30) for p in zip(ids, ids[1:], strict=False)]
            least = min(ranks)
            if least == 1 << 30:
                break
            k = ranks.index(least)
            ids[k : k + 2] = [self.joins[ids[k], ids[k + 1]]]
        return ids

    def compatible(self, a: int, b: int) -> bool:
        """Whether a then b stay two tokens: no merge across their border comes before those that make them."""
        known = self.allowed.get(a << 20 | b)
        if known is None:
            known = self.allowed[a << 20 | b] = self.encode(self.spelt[a] + self.spelt[b]) == [a, b]
        return known

    def state(self, members: tuple[int, ...]) -> int:
        """The number of a deterministic state: sorted members, each (last token + 1, trie place, count) in one integer.

        A path whose token has just ended waits at the root of the trie; at most one does, as encodings are unique.
        """
        number = self.states.get(members)
        if number is None:
            number = self.states[members] = len(self.sets)
            self.sets.append(members)
            if number == len(self.table):
                more = number // 4
                self.table = np.concatenate((self.table, np.full((more, self.table.shape[1]), -1, np.int32)))
                self.final = np.concatenate((self.final, np.zeros(more, np.int32)))
            self.final[number] = next((m & 255 for m in members if not m >> 8 & 0xFFFFF), -1)
        return number

    def compile(self, state: int, byte: int) -> None:
        """Adds a transition: the next state and, in the low 8 bits, the tokens emitted on it."""
        live = []
        for m in self.sets[state]:
            last, at, n = m >> 28, m >> 8 & 0xFFFFF, m & 255
            arcs = self.trie[at]
            to = arcs.get(byte) if arcs else None
            if to is None:
                continue
            if self.trie[to]:
                live.append(last << 28 | to << 8 | n)
            token = self.ends[to]
            if token >= 0 and (not last or self.compatible(last - 1, token)):
                live.append((token + 1) << 28 | n + 1)
        low = min(m & 255 for m in live)
        made = self.state(tuple(sorted(m - low for m in live))) << 8 | low
        self.table[state, self.kinds[byte]] = made

    def columns(self, data: np.ndarray) -> np.ndarray:
        """The table's columns of bytes; bytes not met before get one."""
        for b in np.unique(data[self.kinds[data] < 0]).tolist():
            k = int(self.kinds.max()) + 1
            if k == self.table.shape[1]:
                self.table = np.concatenate((self.table, np.full((len(self.table), 16), -1, np.int32)), axis=1)
            self.kinds[b] = k
        return self.kinds[data]

    def run(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token: all of them take a step at once, longest first."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(pieces), np.uint8)
        column = self.columns(data)
        first = (np.cumsum(sizes) - sizes)[order]
        active = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")
        at, count = np.full(len(pieces), self.start), np.zeros(len(pieces), np.int64)
        for k, n in enumerate(active.tolist()):
            here, place = at[:n], first[:n] + k
            go = self.table[here, column[place]]
            new = np.flatnonzero(go < 0)
            if len(new):
                for s, b in set(zip(here[new].tolist(), data[place[new]].tolist(), strict=True)):
                    self.compile(s, b)
                go[new] = self.table[here[new], column[place[new]]]
            at[:n] = go >> 8
            count[:n] += go & 255
        out = np.empty(len(pieces), np.int64)
        out[order] = count + self.final[at]
        return out

    def pieces(self, texts: list[str]) -> np.ndarray:
        """Tokens of texts that each begin where a pre-token begins."""
        parts: list[bytes] = []
        owner: list[int] = []
        for k, t in enumerate(texts):
            if t.isascii() and t[1:].isalpha() and t[0] == " ":
                parts.append(t.encode())
                owner.append(k)
            else:
                for p in PRE_TOKEN.findall(t):
                    parts.append(p.encode("utf-8", "surrogatepass"))
                    owner.append(k)
        return np.bincount(np.array(owner, np.int64), self.run(parts), len(texts)).astype(np.int64) if parts else np.zeros(len(texts), np.int64)

    def learn(self, words: Iterable[str]) -> None:
        """Counts words that follow a cut, so that the memo has them."""
        new = list(set(words).difference(self.memo))
        self.memo.update(zip(new, self.pieces([" " + w for w in new]).tolist(), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts, special strings as one each."""
        specials = [t.count(SPECIAL) for t in texts]
        flat = [p for t in texts for p in t.split(SPECIAL)] if any(specials) else texts
        if len(self.sets) > STATES:
            self.reset()
        if len(self.memo) > MEMO:
            self.memo = {"": 0}
        size = [max(1, -(-len(t) // CHUNK)) for t in flat]
        maps = chunk_maps(self, [t[k * CHUNK : (k + 1) * CHUNK] for t, n in zip(flat, size, strict=True) for k in range(n)])
        sums = totals(self, scan(self, maps, size))
        if flat is texts:
            return sums
        it = iter(sums)
        return [n + sum(next(it) for _ in range(n + 1)) for n in specials]

    def count(self, text: str) -> int:
        return self.counts([text])[0]


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


class ChunkMap(NamedTuple):
    """What a chunk does to the count: `head` and `tail` are open texts, `inner` is fixed; tail is None if no cut is inside."""

    head: str
    inner: int
    tail: str | None


def words_at_cuts(text: str) -> list[str]:
    """The text before its first cut, then the words that cuts begin, without their space."""
    words = text.split(" ")
    return CUT.split(text) if not all(words) or any(w[0].isspace() for w in words) else words


def chunk_maps(machine: Transducer, chunks: list[str]) -> list[ChunkMap]:
    split = [words_at_cuts(c) for c in chunks]
    machine.learn(chain.from_iterable(w[1:-1] for w in split))
    get = machine.memo.__getitem__
    return [ChunkMap(w[0], sum(map(get, w[1:-1])), " " + w[-1]) if len(w) > 1 else ChunkMap(w[0], 0, None) for w in split]


def composed(machine: Transducer, pairs: list[tuple[ChunkMap, ChunkMap]]) -> list[ChunkMap]:
    """The maps of neighbouring chunks, of many pairs at once; composition is associative."""
    open_ = [(a.head if a.tail is None else a.tail) + b.head for a, b in pairs]
    split = [words_at_cuts(t) for t in open_]
    # a text that begins with a cut's space has nothing before it
    fixed = [w[1:-1] if a.tail is None or b.tail is None else w[1:] for (a, b), w in zip(pairs, split, strict=True)]
    machine.learn(chain.from_iterable(fixed))
    get, out = machine.memo.__getitem__, []
    for (a, b), joint, words, inner in zip(pairs, open_, split, fixed, strict=True):
        if a.tail is None and len(words) == 1:
            out.append(ChunkMap(joint, b.inner, b.tail))
            continue
        n = a.inner + b.inner + sum(map(get, inner))
        if b.tail is None:
            out.append(ChunkMap(words[0] if a.tail is None else a.head, n, " " + words[-1]))
        elif a.tail is None:
            machine.learn(words[-1:])
            out.append(ChunkMap(words[0], n + get(words[-1]), b.tail))
        else:
            out.append(ChunkMap(a.head, n, b.tail))
    return out


def scan(machine: Transducer, maps: list[ChunkMap], size: list[int]) -> list[ChunkMap]:
    """The maps of texts from those of their chunks (so many each, in order): a balanced reduction, a level at a time."""
    rows, at = [], 0
    for n in size:
        rows.append(maps[at : at + n])
        at += n
    while any(len(r) > 1 for r in rows):
        pairs = [(r[k], r[k + 1]) for r in rows for k in range(0, len(r) - 1, 2)]
        done = iter(composed(machine, pairs))
        rows = [[next(done) if k + 1 < len(r) else r[k] for k in range(0, len(r), 2)] for r in rows]
    return [r[0] for r in rows]


def totals(machine: Transducer, maps: list[ChunkMap]) -> list[int]:
    """Tokens of texts: what was open at both ends ends there."""
    tails = [words_at_cuts(m.tail)[1:] if m.tail else [] for m in maps]
    machine.learn(chain.from_iterable(tails))
    get = machine.memo.__getitem__
    return [h + m.inner + sum(map(get, t)) for h, m, t in zip(machine.pieces([m.head for m in maps]).tolist(), maps, tails, strict=True)]


def counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    machine = transducer(path)
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            n = machine.counts(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. No shuffle: one pass over the texts."""
    rows = text_rows(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    out = rows.mapInArrow(lambda it: counted(it, vocabulary_path(vocabulary)), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
