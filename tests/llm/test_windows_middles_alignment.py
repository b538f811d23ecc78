"""Fill-in-middle, packing into windows and alignment of tokenizers against plain Python and the libraries."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import alignment as A
from gridloom.llm import fim
from gridloom.llm import window_packing as W
from gridloom.llm.token_counts import byte_letters
from gridloom.llm.word_ids import WordIds

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
ODD = [
    (1, ""), (2, None), (3, " "), (4, "  x"), (5, "a  b"), (6, "x▁y"), (7, "a\n b\t c\x1c d \x1ce"), (8, "<|endoftext|> <s> x<|endoftext|><|endoftext|>"), (9, "日本語 テキスト 🙂🙂"), (9, "other text, same id"), (9, "other text, same id"),
    (10, " \n\n  q  "), (11, "\x00 \x85 ​ a"), (12, "é é   　x"), (13, "x "), (14, "\n"), (15, "'s 's  's"), (16, "don't  don't 12 345  6"), (17, "word " * 3000), (18, "<|endoftext|>"), (19, " <|endoftext|> a"), (20, "a<P>b"), (21, "<P"), (22, "<<S>>"),
    (23, "P><S <M"), (24, "<M>"), (25, "abc"), (26, "…—…" * 50), (27, "abcDEF" * 40), (28, "A<b>C<S d"), (None, "no id"),
]


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def clashing(spark, data):
    """Extra columns whose names the operators use themselves."""
    extra = ("part", "k", "length", "pairs", "row", "b", "h1", "n", "output", "rank")
    return spark.createDataFrame(data, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in extra])


# -- fill-in-middle -----------------------------------------------------------------------------------------------


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fim_equals_the_plain_rule_and_restores_every_text(spark):
    # the odd texts under many ids, so that each is seen in all forms
    data = ODD + [(100 + 40 * k + j, t) for j, (_, t) in enumerate(ODD) for k in range(40)] + documents(spark)
    out = fim.fill_in_middle(clashing(spark, data))
    assert rows(out) == sorted((plain_fim(*d) for d in data), key=str)
    back = rows(out.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t")))
    assert back == sorted(((d, t or "") for d, t in data), key=str)
    assert {r[2] for r in rows(out)} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_automaton_finds_class_changes_and_sentinels_across_text_borders():
    texts = ["ab", "", "Z", "<", "P>", "é", "x<P>y", "M><M>", "a" * 5000 + "." * 3]
    data = "".join(texts).encode()
    scan = fim.Scan(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
    units = scan.units_before(scan.offs[1:]) - scan.units_before(scan.offs[:-1])
    assert units.tolist() == [len(re.findall("[A-Za-z]+|[^A-Za-z]", t)) for t in texts]
    assert scan.marked.tolist() == [any(s in t for s in ("<P>", "<S>", "<M>")) for t in texts]
    # events are as many as runs of letters begin and end, whatever the texts' length
    assert len(scan.enters) == len(scan.leaves) == sum(len(re.findall("[A-Za-z]+", t)) for t in texts)


# -- packing into windows -----------------------------------------------------------------------------------------


LIBRARY = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def ids_of(text, end):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, end]


def check_windows(data, got, capacity):
    """Every id of every document lies in one piece; sequences are gapless and full, or of a power of two."""
    want, pieces, sequences = Counter((d, tuple(ids_of(t, 1))) for d, t in data), defaultdict(list), defaultdict(list)
    for doc, start, length, crc, tokens, sequence, offset in got:
        pieces[doc, tokens].append((start, length, crc))
        sequences[sequence].append((offset, length))
    for (doc, ids), n in want.items():
        covered = Counter()
        if sum(c for (d, i), c in want.items() if d == doc and len(i) == len(ids)) != n:
            continue  # other ids of the same id and length: told apart by nothing
        for start, length, crc in pieces[doc, len(ids)]:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            covered.update(range(start, start + length))
        assert covered == Counter({k: n for k in range(len(ids))})
    assert sum(len(i) * n for (_, i), n in want.items()) == sum(g[2] for g in got)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0


@pytest.mark.parametrize("capacity", [16, 256, 2048])
def test_windows_hold_each_id_once_without_padding(spark, capacity):
    data = ODD + documents(spark)
    check_windows(data, [tuple(r) for r in W.pack_windows(clashing(spark, data).repartition(3), capacity).collect()], capacity)


def test_windows_of_no_rows_and_of_equal_rows(spark):
    assert W.pack_windows(spark.createDataFrame([], SCHEMA)).count() == 0
    data = [(k % 3, "the same words again") for k in range(500)]
    got = [tuple(r) for r in W.pack_windows(spark.createDataFrame(data, SCHEMA), 64).collect()]
    check_windows(data, got, 64)


def places(counts, capacity):
    plan = W.make_plan(counts, capacity)
    covered, sequences = defaultdict(list), defaultdict(list)
    for (length, _), found in plan.rows.items():
        for first, last, start, size, sequence, offset in found:
            for rank in range(first, last):
                covered[length, rank].append((start, size))
                sequences[sequence + rank - first].append((offset, size))
    return plan, covered, sequences


def test_plans_place_every_item_once(spark):
    rng = np.random.default_rng(3)
    for _ in range(40):
        capacity = int(rng.choice([8, 16, 64]))
        counts = Counter(rng.integers(1, capacity + 1, int(rng.integers(0, 80))).tolist())
        plan, covered, sequences = places(counts, capacity)
        assert set(covered) == {(s, r) for s, n in counts.items() for r in range(n)} and len(sequences) == plan.sequences
        for (length, _), parts in covered.items():
            assert sum(n for _, n in parts) == length and sorted(parts)[0][0] == 0
        assert all(sum(n for _, n in p) in {capacity, *(1 << k for k in range(12))} for p in sequences.values())


def test_plans_follow_the_window_and_not_the_corpus():
    """A million times as many items: the same kind of plan, most windows filled by whole documents, none padded."""
    rng = np.random.default_rng(4)
    counts = Counter(np.minimum(2048, rng.lognormal(5.5, 1, 20_000).astype(int) + 1).tolist())
    for times in (1, 10**6):
        plan = W.make_plan({s: n * times for s, n in counts.items()})
        tokens = sum(s * n for s, n in counts.items()) * times
        assert tokens / 2048 <= plan.sequences <= tokens / 2048 + 12
        assert plan.combined > 0.5 * plan.sequences and sum(map(len, plan.rows.values())) < 150_000


def test_least_squares_meets_a_histogram_that_combinations_can_make():
    lengths = np.arange(1, 64)
    who, often = W.combinations(lengths, 64)
    assert all((lengths[w] * o).sum() == 64 for w, o in zip(who, often, strict=True))
    x = np.zeros(len(who))
    x[::7] = 5
    goal = np.bincount(who.ravel(), (often * x[:, None]).ravel(), len(lengths))
    made = W.least_squares(who, often, goal, 2000)
    assert (made >= 0).all() and np.abs(np.bincount(who.ravel(), (often * made[:, None]).ravel(), len(lengths)) - goal).max() < 0.05 * goal.max()


def test_word_ids_equal_the_library(spark):
    texts = [t or "" for _, t in ODD + documents(spark)]
    ours = WordIds(P.path("byte_bpe_50k.json"))
    assert [np.frombuffer(x, ours.kind).tolist() for x in ours.ids(texts)] == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


# -- alignment ----------------------------------------------------------------------------------------------------


def plain_alignment(data):
    a, b = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    letters, spelt = byte_letters(), {i: t for t, i in a.get_vocab().items()}
    found, counts = [], Counter()
    for doc, text in data:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_a = [bytes(letters[c] for c in spelt[i]) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            found.append((doc, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        links = [(x, y) for x, e, n in zip(ids_a, ends_a, map(len, raw_a), strict=True) for y, f, m in zip(ids_b, ends_b, map(len, raw_b), strict=True) if e - n < f and f - m < e]
        groups, i, j = [], 0, 0
        for c in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(c) + 1, ends_b.index(c) + 1
            groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            i, j = x, y
        counts.update(links)
        found.append((doc, ids_a, ids_b, groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(((d, len(x), len(y), len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, x, y, g, k in found), key=str)


@pytest.mark.parametrize("partitions", ["3", "61"])
def test_alignment_equals_brute_force_with_and_without_sides_over_a_share(spark, partitions):
    """With 61 partitions frequent sides hold more than an even share and are spread over cells."""
    short = [(d, t[:600] if t else t) for d, t in documents(spark)]
    data = [d if d[0] != 17 else (17, "word " * 90) for d in ODD] + short + [(1000 + k, "the the of") for k in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = rows(A.align_tokenizers(clashing(spark, data)), "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        postings = spark.createDataFrame([(k, 5, 7, 1) for k in range(90)] + [(k, 6, k, 1) for k in range(5)], "row long, b int, a int, m int")
        uneven = A.uneven_sides(postings)
        assert (uneven is not None) and {r.b for r in uneven.collect()} == {5, 6} if partitions == "61" else {r.b for r in uneven.collect()} == {5}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain_alignment(data)


def test_alignment_of_no_rows(spark):
    assert A.align_tokenizers(spark.createDataFrame([], SCHEMA)).count() == 0
