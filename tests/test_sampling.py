"""Rollouts and quotas against a reader that takes visits one by one, and pairs against plain rules."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from gridloom.operators.rollouts import Rollout, accepted, rollouts
from test_rules import WORDS, code, word_lists


def reader(visits, quotas, cap):
    """Visits in order; one is kept if everything still has room."""
    kept, buckets, answers, states, used = [], Counter(), Counter(), set(), set()
    for v in sorted(visits):
        _, _, rollout, answer, bucket, state = v
        if bucket in quotas and buckets[bucket] < quotas[bucket] and answers[answer] < cap and state not in states and rollout not in used:
            kept.append(v)
            buckets[bucket] += 1
            answers[answer] += 1
            states.add(state)
            used.add(rollout)
    return kept


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds_keep_what_a_reader_keeps(spark, seed):
    own = random.Random(seed)
    visits = []
    for k in range(120):
        place, answer = f"{own.randrange(16**6):06x}", f"a{own.randrange(12)}"
        visits += [(place, turn, f"r{k}", answer, own.choice("xyzw"), f"s{own.randrange(40)}") for turn in range(2, 2 + own.randint(1, 4))]
    quotas = {"x": 9, "y": 4, "z": 25}
    df = spark.createDataFrame(visits, "place string, turn int, rollout string, answer string, bucket string, state string")
    got = sorted(tuple(r) for r in accepted(df, quotas, 3).collect())
    assert got == reader(visits, quotas, 3)


def test_no_visits_and_equal_places(spark):
    schema = "place string, turn int, rollout string, answer string, bucket string, state string"
    assert accepted(spark.createDataFrame([], schema), {"x": 3}, 1).count() == 0
    same = [("00", 2, f"r{k}", f"a{k}", "x", "one state") for k in range(9)]
    assert [tuple(r) for r in accepted(spark.createDataFrame(same, schema), {"x": 3}, 1).collect()] == [same[0]]


def test_rollouts_are_games_that_follow_their_policy(spark):
    answers = WORDS[::3]
    lists = word_lists(spark, WORDS, answers)
    played = spark.createDataFrame([(a,) for a in answers], "answer string")
    rows = rollouts(lists, played, 3, WORDS[0], Rollout("t", expert=0.0, candidate=0.0, admissible=1.0)).collect()
    again = rollouts(lists, played, 3, WORDS[0], Rollout("t", expert=0.0, candidate=0.0, admissible=1.0)).collect()
    assert sorted(rows) == sorted(again) and {(r.answer, r.draw) for r in rows if r.turn == 2} == {(a, d) for a in answers if a != WORDS[0] for d in range(3)}
    for r in rows:
        turns = [(t.split(":")[0], int(t.split(":")[1])) for t in r.state.strip("|").split("|")]
        assert len(turns) == r.turn - 1 and turns[0][0] == WORDS[0] and all(code(g, r.answer) == c for g, c in turns)
        assert r.n == sum(all(code(g, a) == c for g, c in turns) for a in answers) and r.n_adm == sum(all(code(g, w) == c for g, c in turns) for w in WORDS)
        for k, (g, _) in enumerate(turns[1:], 1):  # only admissible words were played
            assert all(code(h, g) == c for h, c in turns[:k])
