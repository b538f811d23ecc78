"""Brute-force versions, and the cases every operator defines: nulls, empty and long texts, repeats, no rows, odd columns."""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm.decontamination import decontaminate
from gridloom.llm.exact_dedup import drop_copies, exact_dedup
from gridloom.llm.lm_scoring import lm_scores
from gridloom.llm import near_dedup as near
from gridloom.llm.near_dedup import drop_near_copies, near_duplicates
from gridloom.llm.packing import END_ID, best_fit, dearest, pack_documents, plan
from gridloom.llm.pii import KINDS, added_spans, base_spans, detector, examples, find_pii, redact
from gridloom.llm.sharding import plan_cuts, shard_documents
from gridloom.llm.substring_dedup import substring_dedup
from gridloom.llm.token_counts import SPECIAL, chunk_maps, composed, scan, token_counts, totals, transducer, vocabulary_path
from gridloom.llm.toxicity import toxicity

DDL = "doc_id long, text string, lang string, source string, n_chars long, size int, h string, bucket string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(900)]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def texts() -> list[str | None]:
    shared, base = prose(60), prose(120).split()
    out: list[str | None] = [None, "", "  \n\t ", "One", "one two", "One", "a" * 5000, prose(9000)]
    out += [f"{prose(20)} {shared} {prose(25)}" for _ in range(12)]
    for _ in range(70):  # near copies, more than a small bucket holds
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        out.append(" ".join(words))
    out += ["same TEXT again and again " + shared] * 40 + [prose(30) for _ in range(20)]
    return out


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 2, "x", "y") for i, t in enumerate(TEXTS)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(1, "repeated row of text", "en", "s", 1, 2, "x", "y")] * 3 + [(None, None, None, None, None, None, None, None), (2, "x", None, None, None, None, None, None)], DDL)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_no_rows(spark, none):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (find_pii(none), substring_dedup(none), decontaminate(none, items), toxicity(none, marks), exact_dedup(none), token_counts(none), near_duplicates(none), shard_documents(none), pack_documents(none), lm_scores(none)):
        assert df.collect() == []


def test_odd_rows(spark, odd):
    marks = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(None, None), (1, None), (2, "")], "item_id long, text string")
    for df in (find_pii(odd), substring_dedup(odd), decontaminate(odd, items), toxicity(odd, marks), exact_dedup(odd), token_counts(odd), near_duplicates(odd), shard_documents(odd), lm_scores(odd), pack_documents(odd)):
        assert Counter(r.doc_id for r in df.collect()) == {1: 3, 2: 1, None: 1}


def test_pii_base_and_trees(docs):
    t = "a@b.c_d@e.f 1.2.3.4.5 999.1.1.1 no 4111 1111 1111 1111 or +1 (234) 567-8901 x@y"
    assert [(k, t[a:b]) for a, b, k in base_spans(t)] == [("email", "a@b.c"), ("email", "_d@e.f"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (234) 567-8901")]
    model, cuts = detector()
    x, y, kinds = examples(800, 9)
    chosen = np.array([p >= cuts[k] for p, k in zip(model.probability(x), kinds, strict=True)])
    assert y[chosen].mean() > 0.9 and chosen[y == 1].mean() > 0.9
    got = by_id(find_pii(docs))
    assert len(got) == len(TEXTS) and all(sum(r[f"n_{k}"] for k in KINDS) == 0 for r in got.values())
    assert by_id(redact(docs))[3].text == "One"


def plain_spans(t: str) -> list[tuple[int, int, str]]:
    """The contract's patterns one by one, with nothing clever."""
    found = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            found.append((m.start(), m.end(), "card"))
    found += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def test_pii_base_against_plain_patterns(spark):
    pieces = ["1", "23", "255", "256", ".", " ", "-", "@", "a", "b.c", "+1", "(", ")", "4111 1111 1111 1111", "é", "x@y.z", "+49 30 123456-78", "\n", "10.0.0.1", "_", "%"]
    texts_ = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    texts_ += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert [t for t in texts_ if base_spans(t) != plain_spans(t)] == []
    found = by_id(find_pii(spark.createDataFrame([*enumerate(texts_[:2000])], "doc_id long, text string")))
    for i, t in enumerate(texts_[:2000]):
        own = ",".join(f"{k}:{a}:{b}" for a, b, k in plain_spans(t))
        assert found[i].base_sha256 == hashlib.sha256(own.encode()).hexdigest() and set(own.split(",")) - {""} <= set(found[i].spans.split(","))
        assert found[i].n_spans == found[i].n_added + len(plain_spans(t))


def test_pii_look_alikes():
    """What trees add and leave alone, in texts that examples didn't write."""
    model, cuts = detector()
    added = lambda t: [(k, t[a:b]) for a, b, k in added_spans(t, base_spans(t), model, cuts)]
    bad = ["card 00:1A:2B:3C:4D:5E of the host", "at 12:34:56:12 in the recording", "the id 123e4567-e89b-12d3-a456-426614174000 of the row", "see report_final_version_2024_01_15_draft there", "on 2024-01-15 at 10:30", "version 10.2 build 20240115"]
    assert [added(t) for t in bad] == [[]] * len(bad)
    good = {"secret": 'use the token ghp_a1B2c3D4e5F6g7H8j9K2m3N4p5Q6r7S8t9 here', "id": "my iban DE89370400440532013000 please", "ip": "the server at 2001:db8::1 answers", "phone": "call (415) 555-0133 now"}
    assert {k: [x for x, _ in added(t)] for k, t in good.items()} == {k: [k] for k in good}
    assert added('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end') == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]


def test_substring_dedup(docs):
    first, got = {}, by_id(substring_dedup(docs))
    for i, t in enumerate(TEXTS):
        w = (t or "").encode().split()
        covered = [False] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                covered[k : k + 13] = [True] * 13
        kept = [x for x, c in zip(w, covered, strict=True) if not c]
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(covered), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_decontamination(spark, docs):
    item = prose(30)
    words = item.split()
    spoilt = " ".join(w for k, w in enumerate(words) if k % 9)
    extra = spark.createDataFrame([(1000, f"{prose(40)} {item} {prose(300)}"), (1001, f"{prose(70)} {spoilt} {prose(10)}"), (1002, prose(400))], "doc_id long, text string")
    got = by_id(decontaminate(docs.select("doc_id", "text").unionByName(extra), spark.createDataFrame([(7, item), (8, prose(25))], "item_id long, text string")))
    assert {i for i, r in got.items() if r.contaminated} == {1000, 1001} and got[1000].item_id == 7


def test_toxicity_catches_misspellings(spark):
    rows = [(i, f"{prose(15)} {rng.choice(['idiot', 'moron', 'worthless']) if i % 4 == 0 else prose(1)} {prose(15)}") for i in range(1200)]
    marks = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(1200)], "doc_id long, quality int, toxic int")
    new = [(5000, f"{prose(20)} idiotic {prose(5)}"), (5001, prose(25))]
    got = by_id(toxicity(spark.createDataFrame(rows + new, "doc_id long, text string"), marks))
    held = [r for r in got.values() if r.held_out and r.doc_id < 1200]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95 and got[5000].score > got[5001].score


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[(t or "").translate(LOWER)].append(i)
    got = by_id(exact_dedup(docs))
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_token_counts(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    alphabet = " \n\t'stvedlr<|endoftext|>aé1.　\xa0 x"
    samples = [(t or "") for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(800)] + [SPECIAL, f"a{SPECIAL} b"]
    machine = transducer(vocabulary_path("byte_bpe_50k.json"))
    assert machine.counts(samples) == [len(e.ids) for e in library.encode_batch(samples, add_special_tokens=False)]
    # chunks of any size, in one reduction or composed from the right, give the count of the whole
    for t in (s[:300] for s in samples[::7] if SPECIAL not in s and s):
        k = rng.randint(1, 9)
        chunks = [t[i : i + k] for i in range(0, len(t), k)]
        whole = [len(library.encode(t, add_special_tokens=False).ids)]
        maps = chunk_maps(machine, chunks)
        assert totals(machine, scan(machine, maps, [len(maps)])) == whole
        one = maps[-1]
        for m in reversed(maps[:-1]):
            one = composed(machine, [(m, one)])[0]
        assert totals(machine, [one]) == whole
    got = by_id(token_counts(docs))
    assert got[0].n_tokens == 0 and got[3].n_bytes == 3 and got[7].over_limit


def test_near_duplicates(docs):
    sets = []
    for t in TEXTS:
        w = (t or "").translate(LOWER).encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = by_id(near_duplicates(docs))
    assert all((got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i) for i in range(len(sets)))


def test_sharding(spark, docs):
    got = shard_documents(docs, 7).toPandas()
    assert (got.groupby("shard").slot.max() + 1 == got.groupby("shard").size()).all() and len(got) == len(TEXTS)
    text = dict(enumerate(TEXTS))
    assert got.groupby(got.doc_id.map(lambda i: text[i] or "")).shard.nunique().max() == 1
    sizes = [rng.randint(16, 4000) for _ in range(400)]
    keys = sorted(rng.randrange(-(2**63), 2**63) for _ in sizes)
    cuts = plan_cuts(spark.createDataFrame(list(zip(keys, sizes, strict=True)), "h long, size long"), 9)
    at = [0, *(keys.index(c) for c in cuts), len(keys)]
    most = max(sum(sizes[a:b]) for a, b in zip(at, at[1:], strict=False))

    def feasible(capacity):
        shards, now = 1, 0
        for s in sizes:
            if now + s > capacity:
                shards, now = shards + 1, 0
            now += s
        return shards <= 9

    assert feasible(most) and not feasible(most - 1)


def test_packing(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    got = pack_documents(docs).toPandas()
    for i, pieces in got.sort_values("piece").groupby("doc_id"):
        ids = np.array([*library.encode(TEXTS[i] or "", add_special_tokens=False).ids, END_ID], "<u4")
        assert pieces.length.sum() == len(ids) and (pieces.length.iloc[1:] == 1024).all()
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(pieces.start, pieces.length, pieces.ids_crc32, strict=True))
    ends = got.assign(end=got.offset + got.length).sort_values(["sequence_id", "offset"])
    assert (ends.groupby("sequence_id").end.shift(1).fillna(0) == ends.offset).all() and ends.end.max() <= 1024
    counts = {k: rng.randint(1, 40) for k in rng.sample(range(1, 1024), 200)}
    sequences, bound = plan(counts)
    used = Counter()
    for content, n in sequences:
        assert sum(content) <= 1024
        for k in content:
            used[k] += n
    assert used == counts and bound <= sum(n for _, n in sequences) <= sum(n for _, n in best_fit(counts, 1024))
    assert dearest(np.array([3, 5]), np.array([4.0, 7.0]), 11)[0] == 15.0


def test_lm_scoring(docs):
    got = by_id(lm_scores(docs))
    assert got[0].n_tokens == 0 and got[0].log_likelihood == 0 and got[0].mean_log_likelihood is None
    assert all(r.log_likelihood < 0 and r.n_tokens == len(TEXTS[i].split()) for i, r in got.items() if (TEXTS[i] or "").split())


def test_near_dedup_links_components_inside_large_buckets(spark, monkeypatch):
    """A line that many documents share puts unlike documents into the same large buckets; tiles must lose no link."""
    own, line = random.Random(11), prose(30)
    rows = []
    for _ in range(90):
        tail = [own.choice(VOCABULARY) for _ in range(8)]
        for _ in range(own.randint(1, 5)):
            new = list(tail)
            new[own.randrange(8)] = own.choice(VOCABULARY)
            rows.append((len(rows), f"{line} {' '.join(new)} {own.choice(VOCABULARY)}"))
    monkeypatch.setattr(near, "BLOCK", 40)  # several tiles a bucket
    docs = near.text_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = by_id(near_duplicates(docs))
    # every band counts as a large bucket here, and nothing is linked yet
    own = docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(near.sketch, near.SKETCH_DDL).select("doc_id", "n_bytes", "signature")
    signs = np.frombuffer(b"".join(bytes(r.signature) for r in own.collect()), np.uint32).reshape(len(rows), -1)
    large = spark.createDataFrame([(k,) for k in np.unique(near.band_keys(signs).view(np.int64)).tolist()], "key long")
    links = near.residual_links(large, spark.createDataFrame([], "doc_id long, component long"), own, lambda nodes: docs.join(nodes.select("doc_id").distinct(), "doc_id", "left_semi")).collect()
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]

    def components(joined):
        least, changed = list(range(len(rows))), True
        while changed:
            changed = False
            for i, j in joined:
                low = min(least[i], least[j])
                changed |= least[i] != low or least[j] != low
                least[i] = least[j] = low
        return least

    least = components(pairs)
    assert {(x.b, x.a) for x in links} <= set(pairs)
    assert components([(x.a, x.b) for x in links]) == least
    assert [got[i].component_id for i in range(len(rows))] == least
    assert [got[i].n_shingles for i in range(len(rows))] == [len(x) for x in sets]
    assert len(set(least)) > 20


def test_rows_that_share_ids_and_repeated_rows(spark):
    """Decisions are taken for rows, not for ids."""
    text, other = prose(30), prose(30)
    rows = spark.createDataFrame([(5, text), (5, other), (6, text + " q"), (None, other + " z"), (None, prose(20))], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(rows).collect()}
    assert {(5, 26, 5), (6, 27, 5), (None, 27, 5), (None, 16, None)} == got
    assert sorted(t for _, t in map(tuple, drop_near_copies(rows).collect()))[:0] == [] and drop_near_copies(rows).count() == 3
    rows = spark.createDataFrame([(7, "same"), (7, "other"), (9, "Same"), (3, "x y z"), (3, "x y z"), (None, None), (None, "")], "doc_id long, text string")
    assert Counter(map(tuple, drop_copies(rows).collect())) in [Counter([(7, "other"), (9, "Same"), (3, "x y z"), (None, t)]) for t in (None, "")]
    assert Counter(map(tuple, drop_near_copies(rows).collect()))[(3, "x y z")] == 1 and drop_near_copies(rows).count() == 5
