"""The pipeline, stage by stage and row by row, against plain Python; odd rows and clashing columns."""

from __future__ import annotations

import random
import re
import string
from collections import Counter

import pytest

import corpus_pipeline as C
from gridloom.llm import decontamination as leaks
from gridloom.llm.toxicity import THRESHOLD, toxicity

rng = random.Random(41)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(1500)]
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents() -> list[tuple]:
    item = [prose(30) for _ in range(6)]
    texts: list[tuple[int | None, str | None]] = [(i, prose(rng.randint(20, 60))) for i in range(300)]
    texts += [(300 + i, f"{prose(12)} {rng.choice(['idiot', 'moron', 'worthless'])} {prose(12)}") for i in range(150)]
    texts += [(500 + i, texts[i][1].upper() if i % 2 else texts[i][1]) for i in range(25)]  # copies but for capitals
    for i in range(25):  # near copies
        words = texts[40 + i][1].split()
        words[0] = "changed"
        texts.append((600 + i, " ".join(words)))
    texts += [(700 + i, f"{prose(20)} {item[i % 6]} {prose(20)}") for i in range(12)]
    texts += [(3, texts[3][1]), (3, texts[3][1]), (5, prose(30)), (None, prose(25)), (None, None), (800, ""), (801, None), (802, prose(3000))]
    rows = [(i, t, "en" if k % 3 else None, None if k % 7 == 0 else f"s{k % 4}", k) for k, (i, t) in enumerate(texts)]
    rng.shuffle(rows)
    return rows, [(k, t) for k, t in enumerate(item)]


ROWS, ITEMS = documents()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(ROWS, DDL).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 0, int(300 <= i < 450)) for i in range(450)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def shingles(t: str | None) -> frozenset:
    w = (t or "").translate(LOWER).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)]) if w else frozenset()


def components(sets: list[frozenset]) -> list[int]:
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(x) for x in range(len(sets))]


def subsequence(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
        row = new
    return row[-1]


def kept_rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_against_plain_python(spark, folder):
    stages = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = C.read_table(spark, folder, "documents")
    # toxicity: a row goes if its score says so
    low = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").distinct().join(toxicity(docs, C.read_table(spark, folder, "labels")).where(f"score < {THRESHOLD}").select("doc_id").distinct(), "doc_id", "left_semi").collect()}
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    got = kept_rows(clean)
    assert all(got[r] == ROWS.count(r) for r in set(ROWS) if (r[0], r[1]) in low and r[0] not in (None, 3, 5))
    gone = {r[0] for r in ROWS if r not in got}
    assert len([i for i in range(300, 450) if i in gone]) >= 140 and len([i for i in gone if i is not None and i < 300]) <= 12
    rows = list(got.elements())
    # exact dedup: of equal texts one row of the largest doc_id
    clean = C.scratch_table(clean, "test")
    deduped = stages["exact_dedup"](spark, clean, folder)
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault((r[1] or "").translate(LOWER), []).append(r)
    got = kept_rows(deduped)
    assert deduped.columns == docs.columns and sum(got.values()) == len(groups)
    for same in groups.values():
        stays = [r for r in got if (r[1] or "").translate(LOWER) == (same[0][1] or "").translate(LOWER)]
        assert len(stays) == 1 and stays[0] in same and stays[0][0] == max((r[0] for r in same if r[0] is not None), default=None)
    # near dedup: one row of each component, the least doc_id
    rows = list(got.elements())
    deduped = C.scratch_table(deduped, "test")
    thinned = stages["near_dedup"](spark, deduped, folder)
    got = kept_rows(thinned)
    parts: dict[int, list] = {}
    sets = [shingles(r[1]) for r in rows]
    for c, r, s in zip(components(sets), rows, sets, strict=True):
        parts.setdefault(c if s else -1 - len(parts), []).append(r)
    assert thinned.columns == docs.columns and sum(got.values()) == len(parts)
    for part in parts.values():
        assert sum(got[r] for r in part) == 1 and got[min(part, key=lambda r: (r[0] is None, r[0]))] == 1
    # decontamination: rows that hold an item go, others stay
    rows = list(got.elements())
    thinned = C.scratch_table(thinned, "test")
    left = stages["decontamination"](spark, thinned, folder)
    got = kept_rows(left)
    words = lambda t: re.findall(r"[0-9a-z]+", (t or "").translate(LOWER))
    for r in rows:
        share = max(subsequence(words(t), words(r[1])) / 30 for _, t in ITEMS) if len(words(r[1])) < 200 else 0
        assert got[r] == (share < 0.75) or 0.6 <= share < 0.75
    assert left.columns == docs.columns and not [r for r in got if r[0] is not None and 700 <= r[0] < 712]
    # packing: every row that is left, whole
    pieces = stages["packing"](spark, C.scratch_table(left, "test"), folder).toPandas()
    assert Counter(pieces[pieces.piece == 0].doc_id.fillna(-1).astype(int)) == Counter(-1 if r[0] is None else r[0] for r in got.elements())
    assert pieces.groupby("sequence_id").length.sum().max() <= 1024


def test_run_is_the_stages_one_after_another(spark, folder):
    whole = C.run(spark, folder).toPandas()
    docs = C.read_table(spark, folder, "documents")
    for _, stage in C.STAGES:
        docs = C.scratch_table(stage(spark, docs, folder), "test")
    again = docs.toPandas()
    assert Counter(zip(whole.doc_id.fillna(-1), whole.piece, whole.length, whole.ids_crc32, strict=True)) == Counter(zip(again.doc_id.fillna(-1), again.piece, again.length, again.ids_crc32, strict=True))


def test_stages_with_no_rows_and_with_clashing_columns(spark, folder):
    docs = C.read_table(spark, folder, "documents")
    extra = docs.limit(40).selectExpr("*", "1 AS row", "'a' AS row_id", "2 AS row_key", "'k' AS key", "true AS kept", "3 AS once", "4 AS text_hash", "5 AS component", "6 AS slot")
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, docs.limit(0), folder).collect() == []
        out = stage(spark, extra, folder)
        assert out.columns == extra.columns and {(r.row, r.row_id, r.row_key, r.key, r.kept, r.once) for r in out.collect()} <= {(1, "a", 2, "k", True, 3)}, name
    assert C.STAGES[-1][1](spark, docs.limit(0), folder).collect() == []


def test_decontamination_stage_fits_on_rows_without_ids_too(spark, monkeypatch, tmp_path):
    """The stage's index holds the words of all its rows, and a leak in any of them goes."""
    item = " ".join(f"item{k}" for k in range(20))
    spark.createDataFrame([(1, item), (2, " ".join(f"other{k}" for k in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.createDataFrame([(None, f"common{k % 4} plain words {item if k == 7 else ''}") for k in range(40)], "doc_id long, text string")
    build, seen = leaks.build_index, []
    monkeypatch.setattr(leaks, "build_index", lambda *a: seen.append(build(*a)) or seen[-1])
    left = dict(C.STAGES)["decontamination"](spark, rows, str(tmp_path))
    assert left.count() == 39 and left.where("text like '%item%'").count() == 0
    assert (seen[0].terms.numbers(leaks.hashed(["common0 common1 common2 common3 plain words"])[0]) >= 0).all()
