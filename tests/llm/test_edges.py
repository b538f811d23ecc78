"""Long texts, ids on several texts, giant groups, ties at thresholds: what each docstring states."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import toxicity as tox
from gridloom.llm.common import keep_rows
from gridloom.llm.exact_dedup import exact_dedup, recipes
from gridloom.llm.lm_scoring import lm_scores
from gridloom.llm.packing import pack_documents
from gridloom.llm.pii import base_spans, find_pii
from gridloom.llm.sharding import shard_documents
from gridloom.llm.substring_dedup import substring_dedup
from gridloom.llm.token_counts import token_counts, vocabulary_path

rng = random.Random(77)
WORDS = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(3000)]


def prose(n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def shared_ids(spark):
    """One id on two texts, a repeated row, a row without id."""
    rows = [(1, prose(20)), (1, prose(30)), (2, "x y z"), (2, "x y z"), (None, prose(10)), (3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def long_text(spark):
    """A text over every slice and batch, between short ones."""
    text = prose(900_000) + " write to a.b@c.de or 10.1.2.3 " + prose(1000)
    return spark.createDataFrame([(1, "short one"), (2, text), (3, "")], "doc_id long, text string"), text


def test_rows_keep_their_own_results(shared_ids):
    rows = [(r.doc_id, r.text or "") for r in shared_ids.collect()]
    shards = shard_documents(shared_ids, 3).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in shards) == Counter((i, len(t) + 16, zlib.crc32(t.encode())) for i, t in rows)
    for s in {r.shard for r in shards}:
        assert sorted(r.slot for r in shards if r.shard == s) == list(range(sum(r.shard == s for r in shards)))
    pieces = pack_documents(shared_ids).collect()
    assert Counter(r.doc_id for r in pieces) == Counter(i for i, _ in rows) and all(r.piece == 0 for r in pieces)
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    assert Counter((r.doc_id, r.group_size) for r in exact_dedup(shared_ids).collect()) == Counter([(1, 1), (1, 1), (2, 2), (2, 2), (None, 1), (3, 1)])
    assert Counter((r.doc_id, r.n_words) for r in substring_dedup(shared_ids).collect()) == Counter((i, len(t.split())) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in lm_scores(shared_ids).collect()) == Counter((i, len(t.split())) for i, t in rows)


def test_long_texts_are_read_whole(spark, long_text):
    from tokenizers import Tokenizer

    docs, text = long_text
    got = {r.doc_id: r for r in find_pii(docs).collect()}
    assert (got[2].n_email, got[2].n_ip, got[3].n_spans) == (1, 1, 0)
    assert [text[a:b] for a, b, _ in base_spans(text)] == ["a.b@c.de", "10.1.2.3"]
    own = {r.doc_id: r for r in token_counts(docs).collect()}
    assert own[2].n_tokens == len(Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids) and own[2].n_bytes == len(text)
    scores = {r.doc_id: r for r in lm_scores(docs).collect()}
    assert scores[2].n_tokens == len(text.split()) and scores[3].mean_log_likelihood is None and scores[3].log_likelihood == 0
    twice = {r.doc_id: r for r in substring_dedup(docs.unionByName(docs.where("doc_id = 2").selectExpr("doc_id + 2 AS doc_id", "text"))).collect()}
    assert twice[4].n_removed == twice[4].n_words == len(text.split()) and twice[2].n_removed < 1000


def test_sharding_with_one_giant_group(spark):
    rows = spark.createDataFrame([(i, "the same text again") for i in range(500)] + [(1000 + i, prose(3)) for i in range(50)], "doc_id long, text string")
    got = shard_documents(rows, 5).toPandas()
    giant = got[got.doc_id < 500]
    assert giant.shard.nunique() == 1 and len(got) == 550 and set(giant["size"]) == {19 + 16}
    # no cut can do better than the giant alone with what must lie beside it
    assert got.groupby("shard")["size"].sum().max() <= giant["size"].sum() + got[got.doc_id >= 1000]["size"].sum()
    alone = shard_documents(rows.where("doc_id < 500"), 5).toPandas()
    assert alone.shard.nunique() == 1 and sorted(alone.slot) == list(range(500))


def test_toxicity_at_the_threshold_and_without_both_labels(spark):
    model = (np.zeros(tox.BUCKETS, np.float32), 0.0, 1.0, float(np.log(tox.THRESHOLD / (1 - tox.THRESHOLD))))
    assert tox.score(["any text", "", "x"], model) == pytest.approx(tox.THRESHOLD)
    docs = spark.createDataFrame([(i, prose(5)) for i in range(20)] + [(50, ""), (51, None)], "doc_id long, text string")
    one_sided = spark.createDataFrame([(i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = tox.toxicity(docs, one_sided).collect()
    assert len(got) == 22 and all(r.score < 1e-9 and r.predicted == 0 for r in got)


def test_toxic_misspellings_in_other_scripts_share_grams():
    words = [("schlecht", "schléchter"), ("дурак", "дураки"), ("idiot", "IDIOTS")]
    for a, b in words:
        grams = []
        for t in (a, b):
            data, begins = tox.stream([t])
            window, windows, blanks = tox.bags(data, begins)
            grams.append({int(x) for h, inside in tox.grams(data, blanks) for x in h[inside]})
        assert len(grams[0] & grams[1]) >= 5


def test_kept_rows_have_all_their_columns(spark):
    docs = spark.createDataFrame([(1, "a", "p", 1.5, [1, 2]), (2, None, None, None, None)], "doc_id long, text string, name string, judge double, names array<int>")
    assert keep_rows(docs, lambda b: np.array([True] * b.num_rows), 1 << 10).collect() == docs.collect()


def test_chunks_fall_in_again_after_a_difference(spark):
    """With and without sentence ends: two texts that differ near their start share most of their chunks."""
    for end in (". ", " "):
        text = end.join(prose(9) for _ in range(900))
        docs = spark.createDataFrame([(1, text), (2, "something else before it " + text)], "doc_id long, text string")
        a, b = (r.recipe for r in recipes(docs).orderBy("doc_id").collect())
        assert len(a) > 8 and len(set(a) & set(b)) >= 0.8 * len(a)
    one = spark.createDataFrame([(1, "x" * 30_000)], "doc_id long, text string")
    assert recipes(one).first().n_bytes == 30_000 and len(recipes(one).first().recipe) == 4


def test_toxicity_scores_against_plain_loops():
    """The same folded model, text by text, window by window, gram by gram."""
    draw = np.random.Generator(np.random.PCG64(2))
    value, shift, a, b = draw.normal(0, 1, tox.BUCKETS).astype(np.float32), 0.2, 1.5, -0.3

    def bucket(gram: str) -> int:
        h = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
        for c in gram:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return (h ^ h >> 15) & (tox.BUCKETS - 1)

    def plain(text: str) -> float:
        words = text.lower().split()
        most = 0.0 if not words else -np.inf
        for k in range(0, len(words), tox.WORDS):
            held = [value[bucket(f" {w} "[i : i + n])] for w in words[k : k + tox.WORDS] for n in tox.SIZES for i in range(len(w) + 3 - n)]
            most = max(most, float(np.mean(held)) if held else 0.0)
        return 1 / (1 + np.exp(-(a * (most + shift) + b)))

    texts = ["", "One two", "ÉCOLE d'été", prose(40), f"a {prose(25)} i", "x " * 30, "\n\t ", prose(13), "Дурак и др."]
    assert tox.score(texts, (value, shift, a, b)) == pytest.approx([plain(t) for t in texts], abs=1e-5)
