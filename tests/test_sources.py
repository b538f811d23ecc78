"""Word lists and their statistics, discovery of files, bundles, journals and tables of text."""

from __future__ import annotations

import json

import pytest

from gridloom.sources import files as S
from gridloom.sources import jsonl as J
from gridloom.sources.words import load_vocabulary, normalize_stats, normalize_words


def words(df):
    return [r.word for r in df.collect()]


def test_normalize_words_and_stats(spark):
    raw = spark.createDataFrame([('Crane, "slate" élite café',), ("crane toolong abc STARE '' ab1de ,,",), ("ﬁghts",)], "value string")
    assert words(normalize_words(raw)) == ["crane", "slate", "elite", "stare"]
    s = normalize_stats(raw).first().asDict()
    assert s == {"raw_tokens": 11, "empty": 1, "uppercased": 2, "accented": 3, "bad_length": 4, "non_alpha": 1, "duplicates": 1, "kept": 4}
    with pytest.raises(ValueError):
        normalize_words(raw, strict=True)
    assert words(normalize_words(spark.createDataFrame([("crane slate",)], "value string"), strict=True)) == ["crane", "slate"]


def test_load_vocabulary_reads_extras_or_the_complete_list(spark, tmp_path):
    (tmp_path / "answers.txt").write_text("slate\ncrane\n")
    (tmp_path / "extra.txt").write_text("aahed\nzymic\n")
    (tmp_path / "all.txt").write_text("slate\naahed\n")
    load = lambda *a: {r.word: r.is_answer for r in load_vocabulary(spark, *a).collect()}
    at = lambda n: str(tmp_path / n)
    assert load(at("answers.txt")) == {"crane": True, "slate": True}
    assert load(at("answers.txt"), at("extra.txt")) == {"crane": True, "slate": True, "aahed": False, "zymic": False}
    assert load(at("answers.txt"), at("all.txt")) == {"crane": True, "slate": True, "aahed": False}
    assert load(at("answers.txt"), at("all.txt"), True) == {"crane": True, "slate": True, "aahed": False}


def test_discovery_and_classification(spark, tmp_path):
    alphabet = "abcdefghijkl"
    many = [f"{a}{b}{c}de" for a in alphabet for b in alphabet for c in "xyz"]
    (tmp_path / "my_answers.txt").write_text("\n".join(many[:120]))
    (tmp_path / "allowed.csv").write_text("word,second\n" + "\n".join(f"{w},no" for w in many))
    (tmp_path / "nested.json").write_text(json.dumps({"abcde": [{"k": w.upper()} for w in many[:110]], "n": 3}))
    (tmp_path / "few.txt").write_text("crane slate")
    (tmp_path / "skipped").mkdir()
    (tmp_path / "skipped" / "list.txt").write_text("\n".join(many))
    spark.createDataFrame([(w, 1) for w in many[:130]], "w string, n int").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    found = S.discover(spark, str(tmp_path), skip=("skipped",))
    sizes = {r.path.rpartition("/")[2].rpartition(".")[2]: r.n_unique for r in found.collect()}
    assert sizes == {"txt": 120, "csv": len(many), "json": 110, "parquet": 130}
    words = S.extract_words(spark, [r.path for r in found.collect()])
    a, g = S.classify(words)  # all lie in the longest list: the longest of them
    assert "t.parquet" in a and g.endswith("allowed.csv")
    a, g = S.classify(words.where("path like '%json' or path like '%txt'"))
    assert a.endswith("nested.json") and g.endswith("my_answers.txt")
    half = spark.createDataFrame([("mixed", w) for w in (*many[:60], *(w[::-1] for w in many[:70]))] + [("apart", w.replace("de", "fg")) for w in many[:40]], "path string, word string")
    a, g = S.classify(words.where("path like '%csv'").unionByName(half))  # extras share no word with the answers
    assert a == "apart" and g.endswith("allowed.csv")
    one = words.where("path like '%json'")
    assert len(set(S.classify(one))) == 1
    with pytest.raises(FileNotFoundError):
        S.classify(words.limit(0))
    assert S.find_first(spark, str(tmp_path), ("no.txt", "few.txt")).endswith("few.txt")
    with pytest.raises(FileNotFoundError):
        S.find_first(spark, str(tmp_path), ("no.txt",))
    assert S.locate(spark, [str(tmp_path / "skipped"), str(tmp_path)], ["few.txt", "allowed.csv"]) == str(tmp_path)
    assert S.locate(spark, [str(tmp_path)], ["none"]) is None


def test_bundles_are_written_once_and_checked(spark, tmp_path):
    vocab = spark.createDataFrame([("crane", True), ("slate", False)], "word string, is_answer boolean")
    fb = spark.createDataFrame([("crane", "crane", 242)], "guess string, answer string, code int")
    at = str(tmp_path / "bundle")
    S.save_bundle(at, {"built": 1}, vocab=vocab, fb=fb)
    assert not S.save_table(vocab.orderBy("word", ascending=False), f"{at}/vocab")
    assert S.save_table(vocab.limit(1), f"{at}/vocab") and not S.save_table(vocab.limit(1), f"{at}/vocab")
    tables, meta = S.load_bundle(spark, at)
    assert set(tables) == {"vocab", "fb"} and meta == {"built": 1} and tables["fb"].count() == 1
    with pytest.raises(FileNotFoundError):
        S.load_bundle(spark, str(tmp_path))


def test_records_journals_and_tables(spark, tmp_path):
    assert S.portable_path("/a/b/c/d.txt", "/a/b") == "c/d.txt" and S.portable_path("/x/d.txt", "/a/b") == "d.txt" and S.portable_path(None, "/") is None
    at = str(tmp_path / "journal")
    assert S.journal_read(spark, at) == []
    S.journal_append(spark, at, {"run": 1})
    S.journal_append(spark, at, {"run": 2})
    assert [e["run"] for e in S.journal_read(spark, at)] == [1, 2]
    df = spark.createDataFrame([("entropy", 3.5), ("random", None)], "strategy string, mean double").coalesce(1)
    S.write_summary(df, str(tmp_path / "s.json"), seed=7)
    assert json.loads((tmp_path / "s.json").read_text())["summaries"][0] == {"strategy": "entropy", "mean": 3.5}
    assert [r.line for r in S.text_table(df, {"strategy": 9, "mean": 6}).collect()] == [" strategy    mean", "---------  ------", "  entropy     3.5", "   random       -"]
    assert S.text_table(df, {"strategy": 9, "mean": 6}, markdown=True).first().line == "|  strategy |   mean |"


def test_json_lines_csv_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, text string, _holdout string").coalesce(1)
    J.write_jsonl(df, str(tmp_path / "j"), strip_holdout=True)
    assert [r.asDict() for r in J.read_jsonl(spark, str(tmp_path / "j"), "id int, text string, _holdout string").orderBy("id").collect()][0] == {"id": 1, "text": "a", "_holdout": None}
    J.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id", "text", "_holdout"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "f").write_text("abc")
    row = J.manifest(spark, str(tmp_path / "m")).first()
    assert row.bytes == 3 and row.sha256.startswith("ba7816bf")
