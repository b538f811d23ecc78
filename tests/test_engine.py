"""Golden feedback vectors, codec, splits, and queries against their oracles."""

from __future__ import annotations

import itertools
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.functions.feedback import checked_code, code_to_pattern, feedback_code, letters, pattern_to_code
from gridloom.functions.hashing import split_of
from gridloom.plans import audits, datasets, lists, packages, records, replays, rerender, sampling, sweeps  # noqa: F401  (register their queries)
from gridloom.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
GOLDEN = [("crane", "crane", "GGGGG"), ("slate", "crane", "BBGBG"), ("plumb", "crane", "BBBBB"), ("crane", "nacre", "YYYYG"), ("speed", "abide", "BBYBY"), ("abide", "speed", "BBBYY"), ("eerie", "eaten", "GYBBB"), ("llama", "lucid", "GBBBB"), ("added", "dread", "YYBYG"), ("array", "rural", "BYGGB"), ("geese", "sheep", "BYGYB"), ("mummy", "mamma", "GBGGB"), ("aaaaa", "ababa", "GBGBG"), ("eecee", "ceeee", "YGYGG")]


def plain(g: str, a: str) -> int:
    marks, rest = [0] * 5, []
    for i in range(5):
        if g[i] == a[i]:
            marks[i] = 2
        else:
            rest.append(a[i])
    for i in range(5):
        if not marks[i] and g[i] in rest:
            marks[i] = 1
            rest.remove(g[i])
    return sum(m * 3**i for i, m in enumerate(marks))


def coded(spark, pairs):
    spark.createDataFrame(pairs, "g string, a string").createOrReplaceTempView("pairs")
    return spark.sql(f"SELECT g, a, {feedback_code()} AS code FROM (SELECT g, a, {letters('g', 'g')}, {letters('a', 'a')} FROM pairs)").collect()


def test_golden_vectors(spark):
    assert all("".join("BYG"[r.code // 3**i % 3] for i in range(5)) == p for r, p in zip(coded(spark, [x[:2] for x in GOLDEN]), [x[2] for x in GOLDEN], strict=True))


def test_feedback_equals_the_two_pass_rule(spark):
    words = ["".join(w) for w in itertools.product("abc", repeat=5)][::5]
    assert all(r.code == plain(r.g, r.a) for r in coded(spark, [(g, a) for g in words for a in words[::2]]))


def test_codec(spark):
    spark.range(243).selectExpr("CAST(id AS INT) AS code").createOrReplaceTempView("codes")
    rows = spark.sql(f"SELECT code, {code_to_pattern('code')} AS p FROM codes").collect()
    assert all(sum("BYG".index(c) * 3**i for i, c in enumerate(r.p)) == r.code for r in rows)
    spark.createDataFrame([(" gybb_ ",), ("21000",), ("GYBBB",)], "p string").createOrReplaceTempView("patterns")
    assert {r.c for r in spark.sql(f"SELECT {pattern_to_code('p')} AS c FROM patterns").collect()} == {5}


def test_patterns_that_are_none_raise(spark):
    one = lambda p: spark.createDataFrame([(p,)], "p string").select(checked_code(F.col("p")).alias("c")).first().c
    assert [one(p) for p in (" gybb_ ", "21000", "GYBBB", None)] == [5, 5, 5, None]
    for p in ("99999", "GYBBBB", "GYB", "", "GYBBX"):
        with pytest.raises(Exception, match="no feedback pattern"):
            one(p)


def test_split_share(spark):
    n = spark.range(5000).select(split_of(__import__("pyspark").sql.functions.col("id").cast("string")).alias("s")).where("s = 'val'").count()
    assert 400 < n < 600


FAST = [n for n in ORACLES if not n.startswith(("solver_games", "tiebreak", "policy_adaptive", "policy_expert", "policy_rollout", "threshold_control", "list_games"))] + ["solver_games_expected", "solver_games_frequency", "list_games_full", "list_games_rollout"]


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    plain_value = lambda v: round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    a = sorted((tuple(plain_value(r[c]) for c in cols) for r in ours.collect()), key=str)
    at = [theirs.columns.index(c) for c in cols]
    b = sorted((tuple(plain_value(r[k]) for k in at) for r in theirs.fetchall()), key=str)
    assert a == b


def test_audits_find_planted_faults_and_nothing_else(spark):
    """On the records as they are every check counts 0; on the copies with faults each kind of fault is found."""
    rows = {r.tab: r.asDict() for r in QUERIES["record_audit"](spark, DATA).collect()}
    checks = ("wrong_count", "leaks", "wrong_turn", "illegal", "repeated_ids", "contradictory")
    assert all(rows["clean"][c] == 0 for c in (*checks, "wrong_history", "other_preamble", "negative_gain"))
    assert all(rows["planted"][c] > 0 for c in checks)
    rows = {r.tab: r.asDict() for r in QUERIES["prompt_recount"](spark, DATA).collect()}
    assert rows["clean"]["wrong"] == 0 < rows["planted"]["wrong"]
    rows = {r.tab: r.asDict() for r in QUERIES["pair_deep_audit"](spark, DATA).collect()}
    checks = ("backwards", "same_word", "chosen_not_best", "wrong_gap", "wrong_rank")
    assert all(rows["clean"][c] == 0 for c in (*checks, "wrong_actions", "not_next_tier")) and all(rows["planted"][c] > 0 for c in checks)
    rows = {r.tab: r.asDict() for r in QUERIES["task_table_audit"](spark, DATA).collect()}
    assert rows["clean"]["wrong_cost"] == rows["clean"]["unknown"] == rows["clean"]["illegal"] == 0 < rows["planted"]["wrong_cost"]
    assert all(r.unparsed == r.wrong_turn == r.not_round == 0 for r in QUERIES["prompt_round_trip"](spark, DATA).collect())


@pytest.mark.parametrize("name", ["legal_pair_audit", "endgame_audit"])
def test_each_compiled_rule_finds_its_own_fault_and_nothing_in_the_rows_as_they_are(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    assert len(rows) == {"legal_pair_audit": 41, "endgame_audit": 12}[name]
    assert all(r.audited > 0 and r.broken == 0 for r in rows)
    assert [r.rule for r in rows if not r.caught] == []


def test_prompts_of_all_variants_come_back_byte_for_byte(spark):
    rows = {(r.tab, r.variant): r for r in QUERIES["prompt_rerender"](spark, DATA).collect()}
    assert len(rows) == 24 and all(r.unread == 0 for r in rows.values())
    assert all(r.different == r.changed == 0 for (tab, _), r in rows.items() if tab == "clean")
    assert sum(r.different for r in rows.values()) > 0 and sum(r.changed for r in rows.values()) > 0


def test_the_decision_cache_counts_less_than_histories_do(spark):
    rows = QUERIES["decision_cache"](spark, DATA).collect()
    assert all(r.sets <= r.histories <= r.games and r.cells_by_set <= r.cells_by_history for r in rows)
    assert sum(r.cells_by_set for r in rows) < 0.5 * sum(r.cells_by_history for r in rows)
