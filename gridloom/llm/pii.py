"""Personal data by candidate gradient boosting.

Base spans come from four patterns with their checks and always stay. Beyond them, high-recall generators propose
overlapping spans (spelt-out e-mail addresses, phone and card numbers in looser groupings, national and bank
account numbers, secrets). Boosted trees score each candidate by its format and its context, a threshold that was
calibrated for each kind on held-out examples selects, and of overlapping selected spans the likeliest stays.

The data have no labels for this, so trees are trained in numpy on examples written by `examples`: each kind in its
formats and contexts, and look-alikes (dates, times, versions, prices, order numbers, hashes of code, hardware addresses,
UUIDs, slugs, file names) as counterexamples, each of them in neutral and in misleading contexts.

Spans are code points, end exclusive. Defined results: null and empty texts have no spans; texts of any length are
read whole; repeated rows get the same result each; spans that begin at one place stand in the order of kinds; an empty table
has no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import text_rows

KINDS = ("email", "ip", "card", "phone")
#: The local part is found leftwards from each @, see `emails`.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
DIGIT = re.compile(r"[0-9]")
SPELT_DOT = re.compile(r"dot\b|DOT\b|\[at\]|\(at\)")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches. A local part has no @, so it is the run before an @, from the last match on."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_SET:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# -- candidates ---------------------------------------------------------------------------------------------------

GENERATORS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\bat\b|\bAT\b) ?[A-Za-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]|\bdot\b|\bDOT\b) ?|\.)[A-Za-z0-9-]{2,63}){1,4}"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::|:?[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,3}[0-9]{3,6}){2,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)|00[0-9]{1,3}|[0-9]{2,4})(?:[\x20./-]{1,2}[0-9]{2,4}){2,5}(?![0-9])"),
    "id": re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?)(?![0-9A-Za-z])"),
    "secret": re.compile(r"(?<![0-9A-Za-z_-])(?=[A-Za-z_-]{0,40}[0-9])[0-9A-Za-z_-]{20,128}(?![0-9A-Za-z_-])"),
}
ALL_KINDS = (*KINDS, "id", "secret")
CUES = {
    "email": ("mail", "contact", "write", "reach"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "payment", "pay"), "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "id": ("ssn", "social", "security", "iban", "account", "bank", "passport", "id"), "secret": ("token", "key", "secret", "password", "api", "auth", "bearer"),
}
AGAINST = ("version", "order", "invoice", "date", "page", "isbn", "commit", "sha", "price", "part", "build", "release")
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
LETTERS = re.compile(r"[a-z]+")


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Proposals of all generators; each needs a digit, spelt-out addresses need a spelt-out dot or bracketed at."""
    wanted = [k for k in GENERATORS if k != "email"] if DIGIT.search(text) else []
    wanted += ["email"] if SPELT_DOT.search(text) else []
    return [(m.start(), m.end(), kind) for kind in wanted for m in GENERATORS[kind].finditer(text)]


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    digits = NOT_DIGIT.sub("", span)
    letters = sum(c.isalpha() for c in span)
    words = re.findall(r"[a-z]+", before)
    groups = re.findall(r"[0-9]+", span)
    cues = [any(c == w or (len(c) > 3 and c in w) for w in words for c in CUES[k]) for k in ALL_KINDS]
    runs = [len(r) for r in LETTERS.findall(span.lower())]
    kinds = [c.isdigit() + 2 * c.isupper() + 4 * c.islower() for c in span]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    spread = -sum(n / len(span) * math.log2(n / len(span)) for n in (span.count(c) for c in set(span)))
    return [
        ALL_KINDS.index(kind), len(span), len(digits), letters, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), luhn(digits) if digits else 0, spread, *cues[:6],
        any(w in AGAINST for w in words), before[-1:] in "=:\"'", after[:1] in "\"'", len({c for c in span if not c.isalnum()}), sum(c in "0123456789abcdefABCDEF" for c in span) / len(span),
        bool(UUID.search(span)), "::" in span, span.count(":"), span.count("-") + span.count("_"), max(runs, default=0), turns / len(span), max((len(p) for p in span.split(":")), default=0),
    ]


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Feature rows, labels and kinds of candidates in `n` written sentences, half of them with something personal."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    mark = lambda k, chars: "".join(pick(chars) for _ in range(k))
    word = lambda: mark(int(rng.integers(2, 9)), "abcdefghijklmnoprstuvw")
    hexa, mixed = "0123456789abcdef", "ABCDEFGHJKLMNPQRSTabcdefghjkmnpqrst23456789"

    def card() -> str:
        body = num(15)
        return body + next(str(d) for d in range(10) if luhn(body + str(d)))

    def real(kind: str) -> str:
        if kind == "email":
            at, dot = pick([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" AT ", " DOT ")])
            return f"{word()}{pick(['', '.', '_'])}{word()}{at}{word()}{dot}{pick(['com', 'org', 'net', 'de'])}"
        if kind == "ip":
            groups = [mark(int(rng.integers(1, 5)), hexa) for _ in range(8)]
            cut = int(rng.integers(1, 6))
            return pick([":".join(mark(4, hexa) for _ in range(8)), ":".join(groups), ":".join(groups[:cut]) + "::" + ":".join(groups[cut : cut + int(rng.integers(1, 3))]), f"2001:db8::{mark(int(rng.integers(1, 4)), hexa)}", f"fe80::{':'.join(groups[:4])}"])
        if kind == "card":
            c, s = card(), pick([".", " - ", "  ", "_"])
            return s.join(c[k : k + 4] for k in range(0, 16, 4))
        if kind == "phone":
            return pick([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"00{num(2)} {num(3)} {num(4)} {num(3)}"])
        if kind == "id":
            country = pick(["DE", "FR", "ES", "GB", "NL", "IT"])
            return pick([f"{num(3)}-{num(2)}-{num(4)}", f"{country}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}", f"{country}{num(20)}", f"{country}{num(2)}{mark(4, 'ABCDEFGHKLM')}{num(14)}"])
        return pick([mark(40, hexa), mark(40, hexa).upper(), mark(32, mixed), "sk-" + mark(32, mixed), mark(64, hexa), f"ghp_{mark(36, mixed)}", f"AKIA{mark(16, 'ABCDEFGHJKLMNPQRST234567')}", f"xoxb-{num(11)}-{mark(24, mixed)}", f"glpat-{mark(20, mixed)}"])

    def uuid() -> str:
        return "-".join(mark(k, hexa) for k in (8, 4, 4, 4, 12))

    def fake() -> tuple[str, bool]:
        """A look-alike, and whether it is one in any context."""
        return pick([
            (f"{num(4)}-{num(2)}-{num(2)}", True), (f"{num(2)}.{num(2)}.{num(4)}", True), (f"{num(4)} {num(4)} {num(4)}", False), (f"{num(2)}-{num(3)}-{num(4)}-{num(2)}", False), (f"{word()} at {word()}. {word()}", True), (mark(40, hexa), False),
            (f"{word()}_{word()}_{word()}_{word()}{num(2)}", True), (f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", True), (f"{num(2)}:{num(2)}:{num(2)}", True), (f"{num(2)}:{num(2)}", True), (f"{num(3)}.{num(3)} {num(3)}", False), (f"{word()}-{word()}-{word()}-{word()}-{num(4)}", True),
            (f"{num(4)}/{num(4)}/{num(4)}", False), (":".join(mark(2, hexa) for _ in range(6)), True), (":".join(mark(2, hexa).upper() for _ in range(6)), True), (uuid(), True), (uuid().upper(), True),
            (f"{word()}_{word()}_{word()}_{num(4)}_{num(2)}_{num(2)}_{word()}", True), (f"{word()}-{word()}-{num(4)}-{num(2)}-{num(2)}-{word()}", True), (f"IMG_{num(8)}_{num(6)}_{word()}", True), (f"{word()}{num(1)}_{word()}_{word()}_{word()}_v{num(2)}", True),
            (f"{num(1)}:{num(1)}", True), (f"{num(3)}:{num(3)}", True), (f"ch{num(2)}-{word()}-{word()}-{word()}-{word()}", True),
        ])

    rows, labels, kinds = [], [], []
    for _ in range(n):
        good = rng.random() < 0.5
        kind = pick(ALL_KINDS)
        if good:
            cue = pick([*CUES[kind], pick(CUES[kind]), "" if kind in ("email", "card", "phone") else pick(CUES[kind])])
            value = real(kind)
        else:
            value, always = fake()
            cue = pick([*AGAINST, "", "", "", *(pick(CUES[k]) for k in ALL_KINDS if always)])
        joint = pick([" ", ": ", ' = "', " is "])
        lead = " ".join(word() for _ in range(int(rng.integers(1, 6)))) + " " + cue + joint
        text = lead + value + ('"' if joint.endswith('"') else "") + " " + word()
        for a, b, k in candidates(text):
            rows.append(features(text, a, b, k))
            labels.append(float(good and k == kind and a >= len(lead) - 2 and b <= len(lead) + len(value) + 1))
            kinds.append(k)
    return np.array(rows, float), np.array(labels), kinds


# -- boosting -----------------------------------------------------------------------------------------------------

TREES, DEPTH, SHRINK, BINS = 60, 3, 0.3, 24


class Boosted:
    """Gradient boosting of log-loss with complete trees of fixed depth on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = self.bin(x)
        self.base = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        margin = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p) + 1e-6
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS)
            for depth in range(DEPTH):
                for k in range(2**depth - 1, 2 ** (depth + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    feature[k], cut[k] = self.split(binned[rows], grad[rows], hess[rows])
                    node[rows] = 2 * k + 1 + (binned[rows, feature[k]] > cut[k])
            leaf = node - (2**DEPTH - 1)
            value = SHRINK * np.bincount(leaf, grad, 2**DEPTH) / (np.bincount(leaf, hess, 2**DEPTH) + 1.0)
            margin = margin + value[leaf]
            self.trees.append((feature, cut, value))

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1)

    @staticmethod
    def split(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, int]:
        best, at = 1e-9, (0, BINS)
        whole = grad.sum() ** 2 / (hess.sum() + 1.0)
        for f in range(binned.shape[1]):
            g, h = np.cumsum(np.bincount(binned[:, f], grad, BINS + 1)), np.cumsum(np.bincount(binned[:, f], hess, BINS + 1))
            gain = g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - whole
            k = int(gain.argmax())
            if gain[k] > best:
                best, at = float(gain[k]), (f, k)
        return at

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned, margin = self.bin(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            margin += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-margin))


@cache
def detector(n: int = 9000, precision: float = 0.97) -> tuple[Boosted, dict[str, float]]:
    """The trees, and for each kind the least threshold that keeps the precision on held-out examples, 0.5 at least."""
    x, y, _ = examples(n, 1)
    model = Boosted(x, y)
    x, y, kinds = examples(n // 2, 2)
    p = model.probability(x)
    cuts = {}
    for kind in ALL_KINDS:
        rows = np.array([k == kind for k in kinds])
        order = np.argsort(-p[rows], kind="stable")
        exact = np.cumsum(y[rows][order]) / np.arange(1, rows.sum() + 1)
        good = np.flatnonzero(exact >= precision)
        cuts[kind] = max(0.5, float(p[rows][order][good[-1]])) if len(good) else 2.0
    return model, cuts


def added_spans(text: str, base: list[tuple[int, int, str]], model: Boosted, cuts: dict[str, float]) -> list[tuple[int, int, str]]:
    """Selected candidates that touch no base span; of overlapping ones the likeliest."""
    taken = sorted((a, b) for a, b, _ in base)
    found = [c for c in candidates(text) if not any(a < c[1] and c[0] < b for a, b in taken)]
    if not found:
        return []
    p = model.probability(np.array([features(text, *c) for c in found], float))
    out: list[tuple[int, int, str]] = []
    for k in np.argsort(-p, kind="stable").tolist():
        a, b, kind = found[k]
        if p[k] >= cuts[kind] and not any(x < b and a < y for x, y, _ in out):
            out.append((a, b, kind))
    return out


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def detect(batches: Iterator[pa.RecordBatch], model: Boosted, cuts: dict[str, float]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        counts, shas, spans, more, total = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            if not ("@" in text or DIGIT.search(text) or SPELT_DOT.search(text)):
                counts.append((0, 0, 0, 0))
                shas.append(nothing)
                spans.append("")
                more.append(0)
                total.append(0)
                continue
            base = base_spans(text)
            extra = added_spans(text, base, model, cuts)
            named = [s[2] for s in base]
            counts.append(tuple(named.count(k) for k in KINDS))
            shas.append(hashlib.sha256(digest(base).encode()).hexdigest() if base else nothing)
            spans.append(digest(sorted(base + extra, key=lambda s: (s[0], ALL_KINDS.index(s[2])))))
            more.append(len(extra))
            total.append(len(base) + len(extra))
        n = np.array(counts, np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n[:, k]) for k in range(4)), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64()), pa.array(total, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans (all of them)."""
    model, cuts = detector()
    return text_rows(docs, id_col, text_col).mapInArrow(lambda it: detect(it, model, cuts), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with every span replaced by its kind in brackets."""
    model, cuts = detector()

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                at, parts = 0, []
                for a, b, kind in sorted(base + added_spans(text, base, model, cuts)):
                    if b > at:
                        parts += [text[at : max(at, a)], f"[{kind}]"]
                        at = b
                out.append("".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return text_rows(docs, id_col, text_col).mapInArrow(rewrite, "doc_id long, text string")
