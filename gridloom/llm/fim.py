"""Fill-in-middle: a text is cut at two of its units (a run of ASCII letters, or any other character) and its parts reordered.

One Aho-Corasick automaton over eight byte classes holds all that matters in a text: the class changes "other, letter"
and "letter, other" and the three sentinels. Its patterns have at most `DEPTH` symbols, so its state after a character
is a function of the last `DEPTH` symbols; the automaton is compiled into a table by these, and all texts of a slice are
scanned at once. What comes out is sparse: the places where runs of letters begin and end, and the sentinels. Between
two such events the count of units is arithmetic (a gap of k other characters has k units, a run of letters has one), so
the number of units and the place of the n-th unit are read off the events by binary search; units are never listed.

Where a text is cut is drawn from the SHA-256 of "1:" and its id, so a text's form doesn't depend on where it is read.

Defined results: a null or empty text is plain, as are texts with a sentinel; a null id draws as the empty string does;
repeated rows get equal results; texts are never cut short; an empty table has no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import kernels as K
from gridloom.llm.common import text_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Percentages: texts left plain, and rearranged texts that begin with the suffix.
KEPT, SUFFIX_FIRST = 10, 20
#: Symbols: what stands before a text, P, S, M, other letters, <, >, anything else. Characters beyond ASCII are else.
EDGE, LETTER, ELSE = 0, 4, 7
LETTERS, OTHERS, SYMBOLS, DEPTH = (1, 2, 3, LETTER), (5, 6, ELSE), 8, 3
ENTERS, LEAVES, SENTINEL = 1, 2, 4
SLICE = 4 << 20
CUTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
CUTS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])


def byte_symbols() -> np.ndarray:
    """The symbol of each first byte of a character."""
    out = np.full(256, ELSE, np.uint8)
    for c in range(128):
        if chr(c).isalpha():
            out[c] = LETTER
    for k, c in enumerate("PSM", 1):
        out[ord(c)] = k
    out[ord("<")], out[ord(">")] = 5, 6
    return out


SYMBOL = byte_symbols()


class Automaton:
    """Aho-Corasick over symbols: a trie of the patterns, failure links, and what each state has found."""

    def __init__(self, patterns: dict[tuple[int, ...], int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.found = [0]
        for pattern, event in patterns.items():
            at = 0
            for s in pattern:
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    self.next.append({})
                    self.found.append(0)
                at = self.next[at][s]
            self.found[at] |= event
        self.fail = [0] * len(self.next)
        level = list(self.next[0].values())
        while level:
            for at in level:
                for s, to in self.next[at].items():
                    self.fail[to] = self.step(self.fail[at], s)
                    self.found[to] |= self.found[self.fail[to]]
            level = [to for at in level for to in self.next[at].values()]

    def step(self, at: int, symbol: int) -> int:
        while symbol not in self.next[at]:
            if not at:
                return 0
            at = self.fail[at]
        return self.next[at][symbol]


@cache
def events_by_symbols() -> np.ndarray:
    """What the automaton has found after each run of DEPTH symbols, the last of them in the lowest digit."""
    changes = {(a, b): ENTERS for a in (EDGE, *OTHERS) for b in LETTERS} | {(a, b): LEAVES for a in LETTERS for b in OTHERS}
    machine = Automaton(changes | {(5, k, 6): SENTINEL for k in (1, 2, 3)})
    out = np.zeros(SYMBOLS**DEPTH, np.uint8)
    for code in range(len(out)):
        at = 0
        for k in reversed(range(DEPTH)):
            at = machine.step(at, code // SYMBOLS**k % SYMBOLS)
        out[code] = machine.found[at]
    return out


class Scan:
    """Events of texts that lie one after the other, and the counts of units between them."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        lead = (data & 0xC0) != 0x80
        self.bytes_at = np.flatnonzero(lead) if not lead.all() else None
        self.data_end = len(data)
        symbols = SYMBOL[data if self.bytes_at is None else data[self.bytes_at]]
        self.offs = offs if self.bytes_at is None else np.searchsorted(self.bytes_at, offs)
        # the symbols before a text's first and second character are its edge
        code = symbols.astype(np.uint16)
        first, ends = self.offs[:-1][np.diff(self.offs) > 0], self.offs[1:][np.diff(self.offs) > 0]
        second = first[ends - first > 1] + 1
        code[1:] += np.multiply(symbols[:-1], SYMBOLS, dtype=np.uint16)
        code[2:] += np.multiply(symbols[:-2], SYMBOLS**2, dtype=np.uint16)
        code[first] = symbols[first]
        code[second] = symbols[second] + np.multiply(symbols[second - 1], SYMBOLS, dtype=np.uint16)
        found = events_by_symbols()[code]
        self.enters = np.flatnonzero(found & ENTERS)
        last = symbols[ends - 1]
        open_ends = ends[(last >= LETTERS[0]) & (last <= LETTER)]  # a run of letters that its text's end closes
        left = np.flatnonzero(found & LEAVES)
        self.leaves = np.sort(np.concatenate((left, open_ends))) if len(open_ends) else left
        #: Characters beyond the first of the runs of letters before each run, and of all.
        self.beyond = np.concatenate(([0], np.cumsum(self.leaves - self.enters - 1)))
        #: Units before each run of letters, counted over all texts.
        self.rank = self.enters - self.beyond[:-1]
        marks = np.flatnonzero(found & SENTINEL)
        self.marked = np.searchsorted(marks, self.offs[1:]) > np.searchsorted(marks, self.offs[:-1])

    def units_before(self, place: np.ndarray) -> np.ndarray:
        """Units before a text's edge, over all texts."""
        return place - self.beyond[np.searchsorted(self.enters, place)]

    def places(self, rows: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Characters, over all texts, before the place where so many units of a row's text end."""
        target = self.units_before(self.offs[rows]) + units
        return target + self.beyond[np.searchsorted(self.rank, target)]

    def byte_places(self, place: np.ndarray) -> np.ndarray:
        if self.bytes_at is None:
            return place
        return np.where(place < len(self.bytes_at), self.bytes_at[np.minimum(place, len(self.bytes_at) - 1)], self.data_end)


def cut(batches: Iterator[pa.RecordBatch], sentinels: tuple[bytes, bytes, bytes]) -> Iterator[pa.RecordBatch]:
    p, s, m = sentinels
    for batch in batches:
        for part in K.slices(batch, "text", SLICE):
            data, offs = K.buffers(part.column(1))
            scan = Scan(data, offs)
            draw = [part.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)]
            rows = np.arange(part.num_rows)
            n = scan.units_before(scan.offs[1:]) - scan.units_before(scan.offs[:-1])
            one, two = draw[0] % (n + 1), draw[1] % (n + 1)
            a, b = scan.places(rows, np.minimum(one, two)), scan.places(rows, np.maximum(one, two))
            plain = (n == 0) | scan.marked | (draw[2] % 100 >= 100 - KEPT)
            spm = ~plain & (draw[3] % 100 < SUFFIX_FIRST)
            raw = data.tobytes()
            out = []
            for kind, lo, i, j, hi in zip((plain + 2 * spm).tolist(), offs[:-1].tolist(), scan.byte_places(a).tolist(), scan.byte_places(b).tolist(), offs[1:].tolist(), strict=True):
                if kind == 1:
                    out.append(raw[lo:hi])
                elif kind:
                    out.append(b"".join((s, raw[j:hi], p, raw[lo:i], m, raw[i:j])))
                else:
                    out.append(b"".join((p, raw[lo:i], s, raw[j:hi], m, raw[i:j])))
            form = np.where(plain, PLAIN, np.where(spm, SPM, PSM))
            chars = [pa.array(x, pa.int64(), mask=plain) for x in (a - scan.offs[:-1], b - a)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), *chars, pa.array(out, pa.large_binary()).cast(pa.large_string())], schema=CUTS_ARROW)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output (the rearranged text). One pass, nothing is shuffled."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = text_rows(docs, id_col, text_col).select("doc_id", "text", *draws)
    marks = tuple(x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    return rows.mapInArrow(lambda it: cut(it, marks), CUTS)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone; parts hold no sentinel."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda k: F.element_at(parts, k)
    return F.when(form == PLAIN, output).when(form == PSM, F.concat(part(2), part(4), part(3))).otherwise(F.concat(part(3), part(4), part(2)))


def fim_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`fill_in_middle` with digests of the output and of the text restored from it."""
    out = fill_in_middle(docs, id_col, text_col)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
