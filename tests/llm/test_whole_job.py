"""Cases that need the whole job: results that a cap, a sample or a shortened hash would change."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.llm import decontamination as leaks
from gridloom.llm import kernels as K
from gridloom.llm import lm_scoring as lm
from gridloom.llm import substring_dedup as sub
from gridloom.llm.decontamination import decontaminate
from gridloom.llm.substring_dedup import substring_dedup, windows

own = random.Random(23)
WORDS = ["".join(own.choice("abcdefghij") for _ in range(own.randint(3, 7))) for _ in range(5000)]


def prose(n: int, words: list[str] = WORDS) -> str:
    return " ".join(own.choice(words) for _ in range(n))


def subsequence(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
        row = new
    return row[-1]


def test_decontamination_finds_leaks_of_any_benchmark_size(spark):
    items = [prose(own.randint(15, 59)) for _ in range(1200)]
    rows = [(k, f"{prose(40)} {t} {prose(40)}") for k, t in enumerate(items)] + [(2000 + k, prose(100)) for k in range(100)]
    got = {r.doc_id: r for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()}
    assert [k for k in range(1200) if not (got[k].contaminated and got[k].item_id == k and got[k].subsequence == 1)] == []
    assert not any(got[k].contaminated for k in got if k >= 2000)


def test_decontamination_finds_short_items_of_common_words_like_brute_force(spark):
    """The texts around short items hold rare words only, and other items are long."""
    common, other = WORDS[:40], WORDS[40:4000]
    items = [prose(own.randint(6, 12), common) for _ in range(20)] + [prose(50, other) for _ in range(30)]
    rows = []
    for k in range(300):
        words = items[k % 20].split()
        if k >= 100:  # a spoilt copy: a fifth of its words is replaced
            for at in own.sample(range(len(words)), len(words) // 5):
                words[at] = f"new{k}x{at}"
        rows.append((k, " ".join([f"u{k}a{j}" for j in range(60)] + words + [f"u{k}b{j}" for j in range(60)])))
    got = {r.doc_id: r for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*enumerate(items)], "item_id long, text string")).collect()}
    for k, text in rows:
        share = max(subsequence(i.split(), text.split()[50:80]) / len(i.split()) for i in items)
        assert got[k].contaminated == (share >= leaks.COPIED) or leaks.PARAPHRASED <= share < leaks.COPIED, k
        assert k >= 100 or got[k].contaminated


def test_substring_dedup_tells_windows_of_one_anchor_apart_by_64_bits(spark):
    """Different windows under one anchor whose hashes agree in their upper 32 bits are no copies."""
    draw = np.random.Generator(np.random.PCG64(4))
    grams = [" ".join(g) for g in draw.choice(WORDS, (100_000, 5))]
    data, offs = K.buffers(pa.array(grams))
    starts, ends, _ = K.spans(data, offs)
    least = grams[int(K.grams(K.word_hashes(data, starts, ends), 5)[::5].argmin())]
    texts = [f"{' '.join(w[:4])} {least} {' '.join(w[4:])}" for w in draw.choice(WORDS, (300_000, 8)).tolist()]
    row, _, anchor, window = windows(*K.buffers(pa.array(texts)))
    values, count = np.unique(anchor, return_counts=True)
    same = row[anchor == values[count.argmax()]]
    high = window[same] >> np.uint64(32)
    order = np.argsort(high, kind="stable")
    twice = np.flatnonzero(np.diff(high[order].astype(np.int64)) == 0)
    pairs = [(texts[same[order[k]]], texts[same[order[k + 1]]]) for k in twice]
    pairs = [p for p in pairs if p[0] != p[1]]
    assert pairs
    # one slice settles its own repeats with all bits, so a pair is cut into two partitions
    rows = spark.createDataFrame([(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    got = substring_dedup(rows.repartitionByRange(2 * len(pairs), "doc_id")).collect()
    assert len(got) == 2 * len(pairs) and all(r.n_removed == 0 for r in got)


def test_lm_scoring_predicts_rare_words_from_context(spark):
    """Every first word has its own second word; all second words are equally frequent and of one former class."""
    slots = lambda t: lm.tokens(pa.RecordBatch.from_arrays([pa.array([0]), pa.array([t])], names=["doc_id", "text"]))
    second = [w for w in dict.fromkeys(WORDS) if int(slots(w)[0][0]) * 2654435761 % (1 << 32) % 24 == 7][:80]
    first, common = [f"first{k}" for k in range(80)], WORDS[:60]
    own.shuffle(second)
    texts = []
    for _ in range(120):
        for k in own.sample(range(80), 80):
            texts.append(f"{prose(2, common)} {first[k]} {second[k]} {prose(2, common)}")
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(2)
    model = lm.fitted(rows.mapInArrow(lm.tokenised, lm.TOKENS))
    score = lambda a, b: lm.log_probabilities(*slots(f"{common[0]} {common[1]} {a} {b} {common[2]} {common[3]}"), *model)[3]
    gain = [score(first[k], second[k]) - score(first[k], second[(k + 1) % 80]) for k in range(80)]
    assert np.mean(gain) > 0.2 and np.mean(np.array(gain) > 0) > 0.6


def test_lm_scoring_sums_to_one_over_all_slots():
    """The probabilities of all slots after any context, by products along the tree's paths."""
    paths, prior, shares = lm.tree(np.arange(lm.SLOTS) % 1000)
    model = lm.unpack(lm.start(prior, shares))
    inputs = np.array([[5, 9], [4100, 4200], [8300, 8400], [12400, 12500]])
    h = lm.hidden(inputs, model[0])
    for state in h:
        top = lm.normalised(state[None] @ model[2])[0]
        inner = lm.normalised(np.einsum("nkd,d->nk", model[1], state))
        token, node, kid, _ = paths.of(np.arange(lm.SLOTS))
        logs = np.log(top[paths.root]) + np.bincount(token, np.log(inner[node, kid]), lm.SLOTS)
        assert abs(np.exp(logs).sum() - 1) < 1e-3


def test_lm_scoring_against_plain_loops():
    """Scores of whole documents, token by token, from the same parameters."""
    paths, prior, shares = lm.tree(np.random.Generator(np.random.PCG64(1)).integers(0, 50, lm.SLOTS))
    model = lm.unpack(lm.start(prior, shares) + 0.1)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([prose(7), "", prose(3)])], names=["doc_id", "text"])
    for ids, slots, first in lm.runs_of(lm.tokenised(iter([batch]))):
        got = lm.log_probabilities(slots, first, model, paths)
        assert ids.to_pylist() == [1, 2, 3] and np.diff(first).tolist() == [7, 0, 3]
        for a, b in zip(first[:-1], first[1:], strict=True):
            own = slots[a:b]
            for i in range(len(own)):
                x = sum(model[0][k * (lm.INPUTS + 1) + (own[i + o] & (lm.INPUTS - 1) if 0 <= i + o < len(own) else lm.EDGE)] for k, o in enumerate(lm.OFFSETS))
                state = np.append(np.tanh(x), 1.0)
                shares_ = np.exp(state @ model[2])
                want = np.log(shares_[paths.root[own[i]]] / shares_.sum())
                token, node, kid, _ = paths.of(own[i : i + 1])
                for n, k in zip(node.tolist(), kid.tolist(), strict=True):
                    w = np.exp(model[1][n] @ state)
                    want += np.log(w[k] / w.sum())
                assert abs(got[a + i] - want) < 1e-3


def test_lm_scoring_trains_on_every_token():
    paths, prior, shares = lm.tree(np.zeros(lm.SLOTS))
    for texts in ([prose(20) for _ in range(30)], [prose(9000), prose(700), ""]):
        batches = [pa.RecordBatch.from_arrays([pa.array([0]), pa.array([t])], names=["doc_id", "text"]) for t in texts]
        seen = [lm.train(lm.tokenised(iter(batches)), lm.start(prior, shares), paths, turn)[-1] for turn in range(lm.PASSES)]
        assert sum(seen) == sum(len(t.split()) for t in texts)


def test_decontamination_retrieves_synonyms_in_a_space_below_the_items_rank(spark):
    """Words that keep the same company share directions: a paraphrase lies nearer to its item than by words alone."""
    draw = random.Random(8)
    topics = [[f"t{k}w{j}" for j in range(14)] for k in range(40)]
    twin = {w: w.replace("w", "s") for t in topics for w in t}
    items = [[draw.choice(topics[k]) for _ in range(24)] for k in range(40)]
    said = [[w if draw.random() < 0.66 or j >= 20 else twin[w] for j, w in enumerate(i)] for i in items]
    texts = [" ".join(draw.choice([w, twin[w]]) for w in (draw.choice(topics[n % 40]) for _ in range(48))) for n in range(800)]
    far = [[draw.choice(WORDS) for _ in range(30)] for _ in items]
    rows = [*enumerate(texts), *((2000 + k, " ".join(far[k] + s + far[-k])) for k, s in enumerate(said))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = [(k, " ".join(i[:20]) + ". " + " ".join(i[20:])) for k, i in enumerate(items)]
    index = leaks.build_index(docs, bench)
    assert index.basis.shape[1] == 30 < len(items)
    gram = index.basis[:-1].T @ index.basis[:-1]
    assert np.abs(gram - np.eye(30)).max() < 1e-3
    nearer = 0
    for k, (i, s) in enumerate(zip(items, said, strict=True)):
        a, b = (index.terms.numbers(leaks.hashed([" ".join(x)])[0]) for x in (i, s))
        assert (b >= 0).all()
        x, y = (np.bincount(t, index.weight[t], index.terms.n) for t in (a, b))
        plain = x @ y / np.linalg.norm(x) / np.linalg.norm(y)
        place = index.ids.index(k)
        near = leaks.cosines(b[None].astype(np.int64), index.weight, index.basis, index.latent[place])[0]
        nearer += near > plain + 0.05
    assert nearer >= 36
    got = {r.doc_id: r for r in leaks.decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    for k, s in enumerate(said):
        share = subsequence(items[k], s) / 24
        assert got[2000 + k].contaminated or share < leaks.PARAPHRASED


def test_decontamination_recall_against_brute_force(spark):
    """Spoilt copies among words of the same vocabulary: the index finds what a full comparison finds."""
    draw = random.Random(3)
    words = WORDS[:1500]
    items = [[draw.choice(words) for _ in range(draw.randint(15, 50))] for _ in range(150)]
    rows = []
    for k in range(600):
        own = list(items[k % 150])
        for at in draw.sample(range(len(own)), int(len(own) * draw.choice([0, 0.1, 0.2, 0.3, 0.38]))):
            own[at] = draw.choice(words)
        rows.append((k, " ".join([draw.choice(words) for _ in range(80)] + own + [draw.choice(words) for _ in range(80)])))
    got = {r.doc_id: r for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")).collect()}
    true = {k: subsequence(items[k % 150], t.split()[80:-80]) / len(items[k % 150]) for k, t in rows}
    found = [k for k in true if got[k].subsequence >= true[k] - 1e-9]
    assert len(found) >= 0.98 * len(rows)
    assert all(got[k].contaminated for k in found if true[k] >= leaks.COPIED)


def test_decontamination_fits_on_all_documents(spark, monkeypatch):
    """Words that only the 400 rows of greatest id hashes and rows without an id hold count like all others, in vocabulary,
    weights and passages."""
    draw = random.Random(31)
    ids = [r.id for r in spark.range(2400).orderBy(F.xxhash64("id")).collect()]
    late = {k: [f"late{draw.randrange(20)}" for _ in range(60)] for k in ids[2000:]}
    rows = [(k, " ".join([draw.choice(WORDS[:300]) for _ in range(30)] + late.get(k, []))) for k in range(2400)] + [(None, "unnamed " * 50)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(leaks, "MERGED", 1 << 8)  # partial counts leave a task more than once
    index = leaks.build_index(docs, [(k, prose(20)) for k in range(12)])
    counts = Counter(w for _, t in rows for w in set(t.split()))
    assert {f"late{j}" for j in range(20)} | {"unnamed"} <= {w for w, n in counts.items() if n > 1}
    for w, n in counts.items():
        number = index.terms.numbers(leaks.hashed([w])[0])[0]
        assert (number >= 0) or n == 1
        assert number < 0 or abs(index.weight[number] - (np.log(2431 / (n + 1)) + 1)) < 1e-5
    passages = [np.bincount(t[a : a + 48], index.weight[t[a : a + 48]], index.terms.n) for t in (index.terms.numbers(leaks.hashed([x])[0]) for _, x in rows) for a in range(0, len(t), 48)]
    unit = leaks.unit(np.array(passages))
    total = unit.T @ unit
    factor, sums, n, lengths = leaks.document_factor(docs, index.terms, index.weight[:-1].astype(float), index.terms.n)
    assert n == len(passages) and np.allclose(sums, unit.sum(0), atol=1e-2) and abs(lengths / np.linalg.norm(passages, axis=1).sum() - 1) < 1e-5
    assert np.abs(factor @ factor.T - total).max() < 1e-3 * total.max()


def test_decontamination_bounds_are_not_drawn(spark):
    """Items that read alike have one bound, whatever their place, and the bound is that of all choices of words."""
    draw = random.Random(33)
    items = [prose(n) for n in (8, 20, 31, 44) for _ in range(4)]
    docs = spark.createDataFrame([(k, prose(120)) for k in range(200)] + [(1000 + k, t) for k, t in enumerate(items)], "doc_id long, text string")
    index = leaks.build_index(docs, [*enumerate(items), *((100 + k, t) for k, t in enumerate(items))])
    bounds = dict(zip(index.ids, index.bound.tolist(), strict=True))
    assert all(abs(bounds[k] - bounds[100 + k]) < 1e-5 for k in range(len(items))), [(bounds[k], bounds[100 + k]) for k in range(len(items))]
    # without surroundings: all choices of 6 of 9 words, written out
    item = np.array([[draw.gauss(1, 0.3), *(draw.gauss(0, 0.3) for _ in range(4))] for _ in range(9)])
    latent = leaks.unit(item.sum(0))
    bound = leaks.leak_bound(item, 6, np.zeros(5), np.zeros((5, 5)), latent)
    leak = np.array([item[list(c)].sum(0) for c in itertools.combinations(range(9), 6)])
    along = leak @ latent
    across = np.linalg.norm(leak - along[:, None] * latent, axis=1)
    short = along - bound / np.sqrt(1 - bound**2) * across
    # the root mean square of the length across is over its mean, so the bound errs low
    assert (short > 0).all() and leaks.DEVIATIONS < short.mean() / short.std() < leaks.DEVIATIONS + 1.5
    # with surroundings: hardly any of many leaks lies below
    root = np.array([[draw.gauss(0, 0.5) for _ in range(5)] for _ in range(5)])
    mean = np.array([draw.gauss(0, 0.3) for _ in range(5)])
    bound = leaks.leak_bound(item, 30, mean, root.T @ root, latent)
    rng = np.random.Generator(np.random.PCG64(7))
    part = 24 / leaks.PASSAGE
    leak = leak[rng.integers(0, len(leak), 20000)] + part * mean + np.sqrt(part) * rng.standard_normal((20000, 5)) @ root
    assert bound > 0.2 and (leaks.unit(leak) @ latent < bound).mean() < 1e-3


def test_decontamination_compares_pairs_at_once_like_plain_python(spark):
    draw = random.Random(32)
    items = [[draw.choice(WORDS[:60]) for _ in range(n)] for n in (6, 25, 63, 64, 65, 130)]
    index = leaks.build_index(spark.createDataFrame([(1, " ".join(WORDS[:60]))], "doc_id long, text string"), [(k, " ".join(i)) for k, i in enumerate(items)])
    text = [draw.choice(WORDS[:80]) for _ in range(600)]
    words = leaks.hashed([" ".join(text)])[0]
    item = np.array([k for k in range(6) for _ in range(20)])
    lo = np.array([draw.randrange(500) for _ in item])
    hi = lo + np.array([draw.randrange(100) for _ in item])
    got = leaks.common_lengths(item, lo, hi, index.terms.numbers(words), words, index)
    assert got.tolist() == [subsequence(items[index.ids[k]], text[a:b]) for k, a, b in zip(item.tolist(), lo.tolist(), hi.tolist(), strict=True)]


def test_decontamination_short_and_unnamed_items_and_ties(spark):
    docs = spark.createDataFrame([(1, "we say yes indeed here"), (2, "nothing at all"), (3, prose(30)), (4, None)], "doc_id long, text string")
    item = docs.where("doc_id = 3").first().text
    bench = spark.createDataFrame([(9, item), (5, item), (None, item), (None, "yes indeed"), (8, "Yes, indeed!"), (7, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate(docs, bench).collect()}
    assert (got[1].contaminated, got[1].item_id) == (True, 8) and (got[3].contaminated, got[3].item_id) == (True, 5)
    assert not got[2].contaminated and not got[4].contaminated and got[4].item_id is None


def test_substring_dedup_deals_a_hot_anchor_by_windows(spark, monkeypatch):
    """500,000 different windows around one line that 62,500 documents hold: nothing is removed, and no bucket gets them all."""
    draw = np.random.Generator(np.random.PCG64(12))
    grams = [" ".join(g) for g in draw.choice(WORDS, (200_000, 5))]
    data, offs = K.buffers(pa.array(grams))
    starts, ends, _ = K.spans(data, offs)
    line = grams[int(K.grams(K.word_hashes(data, starts, ends), 5)[::5].argmin())]
    # 7 own words on either side: 7 windows a document hold the line, all of them different
    around = draw.choice(WORDS, (72_000, 14)).tolist()
    texts = [f"{k}a {' '.join(w[:7])} {line} {' '.join(w[7:])} {k}z" for k, w in enumerate(around)]
    rows = spark.createDataFrame(pa.table({"doc_id": list(range(len(texts))), "text": texts}).to_pandas()).repartition(4)
    named = rows.select("doc_id", "text")
    hot = sub.hot_anchors(named)
    assert len(hot) >= 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts[:2000]), pa.array([0] * 2000)], names=["doc_id", "text", "tag"])
    sizes = np.zeros(16)
    for r in sub.packs(batch, 16, hot):
        sizes[r["bucket"]] += len(r["window"])
    assert sizes.max() < 1.3 * sizes.mean()
    got = substring_dedup(rows)
    assert got.where("n_removed > 0").count() == 0
    copies = rows.where("doc_id < 50").selectExpr("doc_id + 100000 AS doc_id", "text")
    got = substring_dedup(rows.unionByName(copies))
    assert got.where("n_removed > 0").select("doc_id").distinct().count() == 50 and got.where("n_removed > 0 AND n_removed < n_words").count() == 0
