"""Every rule, tie-break, pool and the game loop against plain Python on 150 words; searches against plain recursion."""

from __future__ import annotations

import hashlib
import math
import random
from functools import cache

import numpy as np
import pytest

from gridloom.operators import loop
from gridloom.operators import tree as T
from gridloom.operators.loop import Lists, Setting, settings_table
from gridloom.operators.loop import play as play_settings
from gridloom.operators.packed import MOST_WORDS, codes, letters_of, packed_matrix, set_statistics
from gridloom.plans import games as G
from gridloom.plans import lists as L
from gridloom.plans import replays as R

rng = random.Random(23)
WORDS = sorted({"".join(rng.choice("aeilnorst") for _ in range(5)) for _ in range(170)})[:150]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("words"))
    rows = [(k, f"{w} {WORDS[(k * 7) % len(WORDS)]}", "en", "s", 11) for k, w in enumerate(WORDS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


@cache
def code(g: str, a: str) -> int:
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


def stats(g: str, alive: list[str]) -> dict:
    sizes: dict[int, int] = {}
    for a in alive:
        sizes[code(g, a)] = sizes.get(code(g, a), 0) + 1
    n = len(alive)
    return {"n": n, "sumsq": sum(k * k for k in sizes.values()), "worst": max(sizes.values()), "h": math.log2(n) - sum(k * math.log2(k) for k in sizes.values()) / n, "isc": int(g in alive)}


def frequency() -> dict[str, float]:
    presence = {c: sum(c in w for w in WORDS) / len(WORDS) for c in set("".join(WORDS))}
    place = {(i, c): sum(w[i] == c for w in WORDS) / len(WORDS) for i in range(5) for c in presence}
    return {w: round(sum(presence[c] for c in set(w)) + 0.5 * sum(place[i, c] for i, c in enumerate(w)), 9) for w in WORDS}


SCORE = frequency()
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def bits(s: dict) -> float:
    return s["h"] - 0.25 * math.log2(s["worst"]) - 0.25 * math.log2(s["sumsq"] / s["n"]) + (math.log2(1 + 1 / s["n"]) if s["isc"] else 0)


class Down(str):
    """Text that sorts from z to a."""

    def __lt__(self, other):
        return str(self) > str(other)


KEYS = {
    "entropy": lambda s, g, st: (-round(s["h"], 9), -s["isc"], g),
    "expected": lambda s, g, st: (s["sumsq"], -s["isc"], g),
    "minimax": lambda s, g, st: (s["worst"], -s["isc"], g),
    "hybrid": lambda s, g, st: (-round(bits(s), 9), g),
    "frequency": lambda s, g, st: (-SCORE[g], g),
    "random": lambda s, g, st: (sha(f"20260817|{st}|{g}"), g),
    "adaptive_20": lambda s, g, st: (-s["isc"] if s["n"] <= 20 else 0, -round(s["h"], 9), -s["isc"], g),
    "tieB": lambda s, g, st: (-round(s["h"], 9), g),
    "tieC": lambda s, g, st: (-round(s["h"], 9), -s["isc"], Down(g)),
    "tieD": lambda s, g, st: (-round(s["h"], 9), -s["isc"], s["sumsq"], g),
}


def play(answers, guesses, choose):
    """answer -> [(guess, code, n_before)], all games of a state together."""
    out = {a: [] for a in answers}
    level = [("", sorted(answers), sorted(guesses))]
    for turn in range(1, 7):
        following = []
        for state, alive, adm in level:
            g = choose(state, alive, adm, turn)
            parts: dict[int, list[str]] = {}
            for a in alive:
                out[a].append((g, code(g, a), len(alive)))
                parts.setdefault(code(g, a), []).append(a)
            following += [(f"{state}|{g}:{c}", p, [w for w in adm if code(g, w) == c]) for c, p in parts.items() if c != 242]
        level = following
    return out


def chooser(key, pool):
    def choose(state, alive, adm, turn):
        allowed = [g for g in WORDS if g in alive or (len(alive) > 2 and turn < 6 and pool(g, alive, adm))]
        return min(allowed, key=lambda g: key({**stats(g, alive), "turn": turn}, g, state))

    return choose


def found(df):
    out: dict[str, list] = {}
    for r in sorted(df.collect(), key=lambda r: (r.answer, r.turn)):
        out.setdefault(r.answer, []).append((r.guess, r.code, r.n_before))
    return out


@pytest.mark.parametrize("rule", list(KEYS))
def test_rules_and_loop(spark, folder, rule):
    pool = (lambda g, alive, adm: False) if rule in G.CANDIDATES_ONLY else (lambda g, alive, adm: True)
    assert found(G.games(spark, folder, rule)) == play(WORDS, WORDS, chooser(KEYS[rule], pool))


POOLS = {
    "full": ("entropy", lambda g, alive, adm: True), "adaptive_20": ("entropy", lambda g, alive, adm: len(alive) > 20), "candidates": ("entropy", lambda g, alive, adm: False), "hard": ("entropy", lambda g, alive, adm: g in adm),
    "restricted": ("expected", lambda g, alive, adm: len(adm) > 20 or g in adm), "random_admissible": ("random", lambda g, alive, adm: g in adm), "random_restricted": ("random", lambda g, alive, adm: len(adm) > 20 or g in adm),
}
ANSWERS = [w for w in WORDS if sha(f"answers|{w}")[0] < "6"]


@pytest.mark.parametrize("policy", list(POOLS))
def test_policies_over_two_lists(spark, folder, policy):
    rule, pool = POOLS[policy]
    got = L.list_games(spark, folder, policy)
    assert found(got) == play(ANSWERS, WORDS, chooser(KEYS[rule], pool))
    for r in got.where("turn = 3").collect():
        adm = [w for w in WORDS if all(code(p.split(":")[0], w) == int(p.split(":")[1]) for p in r.state.split("|")[1:])]
        assert (r.n_adm, r.adm) == (len(adm), int(r.guess in adm))


def test_hard_mode_never_breaks_a_clue(spark, folder):
    games = found(L.list_games(spark, folder, "hard"))
    for turns in games.values():
        for k, (g, _, n) in enumerate(turns):
            assert n <= 2 or k == 5 or all(code(h, g) == c for h, c, _ in turns[:k])


def plain_cost(alive, left, pool, failed):
    """Least total cost without memo, bounds or pruning; pool: the guesses of a state."""
    if not alive:
        return 0
    if left == 0:
        return failed * len(alive)
    best = None
    for g in pool(alive):
        parts: dict[int, list[str]] = {}
        for a in alive:
            parts.setdefault(code(g, a), []).append(a)
        if list(parts) == [242] or len(parts) > 1 or left == 1 or len(alive) == 1:
            total = len(alive) + sum(plain_cost(p, left - 1, pool, failed) for c, p in parts.items() if c != 242)
            best = total if best is None else min(best, total)
    return failed * len(alive) if best is None else best


def parts_of(g, alive):
    parts: dict[int, list[str]] = {}
    for a in alive:
        parts.setdefault(code(g, a), []).append(a)
    return parts


def word_lists(spark, legal, answers):
    return Lists(spark.createDataFrame([(w,) for w in legal], "word string"), spark.createDataFrame([(a,) for a in answers], "answer string"))


def test_search_against_plain_recursion(spark):
    """With every guess in the pool and all plies of lookahead, the search is exact."""
    answers = WORDS[::19][:7]
    legal = sorted({*answers, *WORDS[::31]})
    states = spark.createDataFrame([("s", a) for a in answers] + [("few", answers[0]), ("few", answers[3])], "state string, answer string")
    config = T.TreeConfig(depth=9, top_k=len(legal), turns=4)
    found = {r.state: r for r in T.tree_values(word_lists(spark, legal, answers), states, 1, config).collect()}
    assert found["s"].cost == plain_cost(answers, 4, lambda alive: legal, T.INFEASIBLE) and found["s"].n == 7
    assert found["s"].cost == len(answers) + sum(plain_cost(p, 3, lambda alive: legal, T.INFEASIBLE) for c, p in parts_of(found["s"].guess, answers).items() if c != 242)
    assert (found["few"].cost, found["few"].guess) == (3, min(answers[0], answers[3]))
    assert (codes(letters_of(legal), letters_of(answers)) == [[code(x, a) for a in answers] for x in legal]).all()


def test_lookahead_and_greedy_lines(spark):
    """One ply ended by the greedy line: the candidate that leaves least, played on to the end."""
    answers = WORDS[3:40:3]
    lists = word_lists(spark, WORDS, answers)

    def greedy(alive):
        return min(alive, key=lambda g: (stats(g, alive)["sumsq"], g))

    def line(alive):
        """Cost and length of the greedy line."""
        if len(alive) <= 2:
            return 2 * len(alive) - 1, len(alive)
        below = [line(p) for c, p in parts_of(greedy(alive), alive).items() if c != 242]
        return len(alive) + sum(c for c, _ in below), 1 + max(d for _, d in below)

    states = spark.createDataFrame([("s", a) for a in answers], "state string, answer string")
    sets = T.distinct_sets(states, lists)
    row = T.greedy_lines(lists, sets.select("cset", "members")).first()
    assert (row["cost"], row["depth"]) == line(answers)
    others = sorted(WORDS, key=lambda g: (stats(g, answers)["sumsq"], g))[:5]
    values = {}
    for g in {*answers, *others}:
        below = [line(p) for c, p in parts_of(g, answers).items() if c != 242]
        values[g] = len(answers) + sum(c if d <= 4 else T.INFEASIBLE for c, d in below)
    priced = {r.guess: r.cost for r in T.action_values(lists, sets.select("cset", "members"), 5, T.TreeConfig(depth=1, top_k=5)).collect()}
    assert priced == {g: min(v, T.INFEASIBLE) for g, v in values.items()}


def test_tree_games_are_no_worse_than_their_greedy_line(spark, folder):
    states, lists = L.after_opener(spark, folder).select("state", "answer"), L.word_lists(spark, folder)
    games = T.tree_games(lists, states, 2).toPandas()
    greedy = T.tree_games(lists, states, 2, T.TreeConfig(depth=0)).toPandas()
    total = lambda g: sum(x.turn.max() if 242 in set(x.code) else 7 for _, x in g.groupby("answer"))
    assert total(games) <= total(greedy) and set(games.answer) == {r.answer for r in states.collect()}
    assert all(code(r.guess, r.answer) == r.code for r in games.itertuples())


def test_adaptive_values_against_plain_recursion():
    """All later actions agree with the feedback, failures cost 7, some words can't be the answer."""

    def value(words, possible, left):
        n = sum(w in possible for w in words)
        if not n:
            return 0
        if left <= 0:
            return 7 * n
        return 1 if n == 1 else min(action(g, words, possible, left) for g in words)

    def action(g, words, possible, left):
        parts: dict[int, list[str]] = {}
        for w in words:
            parts.setdefault(code(g, w), []).append(w)
        return sum(w in possible for w in words) + sum(value(p, possible, left - 1) for c, p in parts.items() if c != 242)

    own = random.Random(5)
    for _ in range(12):
        words = own.sample(WORDS, 6)
        possible = set(own.sample(words, own.randint(1, 6)))
        for left in (1, 2, 4):
            assert T.action_costs(words, possible, left) == {g: action(g, words, possible, left) for g in words}


def test_too_many_answers_are_refused(spark):
    with pytest.raises(ValueError):
        packed_matrix(spark.createDataFrame([(0, "aaaaa")], "gid int, guess string"), ["aaaaa"] * (MOST_WORDS + 1))


def test_set_statistics_of_small_and_large_sets():
    """Members compared with each other, or counted by code: the same numbers as plain counting."""
    table = codes(letters_of(WORDS), letters_of(WORDS))
    for size in (1, 2, 9, 16, 17, 60):
        members = np.array([random.Random(k).sample(range(len(WORDS)), size) for k in range(3)])
        sumsq, worst, kl, isc = set_statistics(table, members)
        for q, own in enumerate(members.tolist()):
            for g, w in enumerate(WORDS):
                s = stats(w, [WORDS[k] for k in own])
                assert (sumsq[g, q], worst[g, q], isc[g, q]) == (s["sumsq"], s["worst"], bool(s["isc"]))
                assert abs(math.log2(size) - kl[g, q] / size - s["h"]) < 1e-9


def test_settings_are_checked_and_a_small_table_stays_whole(spark):
    with pytest.raises(ValueError):
        settings_table(spark, [Setting("x", metric="unknown")])
    lists = word_lists(spark, WORDS, WORDS[::3])
    games = play_settings(lists, [Setting("few", games=5), Setting("all", "chance", "restricted", 3, seed="z")]).toPandas()
    assert games[games.setting == "few"].answer.nunique() == 5 and set(games[games.setting == "all"].answer) == set(WORDS[::3])
    assert all(code(r.guess, r.answer) == r.code for r in games.itertuples())
    # equal sets get equal moves, whatever the way to them
    for _, x in games[games.setting == "all"].groupby(["cset", "turn", "n_adm"]):
        assert x.guess.nunique() == 1


def test_a_loop_goes_on_from_its_last_completed_turn(spark, tmp_path, monkeypatch):
    """Stopped in turn 4, then run again: turns 1 to 3 are read, the games are those of a run without a stop."""
    lists, settings, at = word_lists(spark, WORDS, WORDS[::3]), [Setting("h", "hybrid", lam=0.5), Setting("r", "expected", "restricted", 4)], str(tmp_path / "run")
    plain, real, turns = sorted(map(tuple, play_settings(lists, settings).collect())), loop.choose, []

    def choose(*args):
        turns.append(args[-1])
        if args[-1] == 4 and len(turns) == 4:
            raise RuntimeError("an executor is lost for good")
        return real(*args)

    monkeypatch.setattr(loop, "choose", choose)
    with pytest.raises(RuntimeError):
        play_settings(lists, settings, at)
    assert turns == [1, 2, 3, 4]
    assert sorted(map(tuple, play_settings(lists, settings, at).collect())) == plain and turns == [1, 2, 3, 4, 4, 5, 6]
    assert sorted(map(tuple, play_settings(lists, settings, at).collect())) == plain and len(turns) == 7
    with pytest.raises(ValueError):
        play_settings(lists, settings[:1], at)


def test_a_policy_with_two_moves_is_refused_and_its_holes_are_named(spark):
    lists = word_lists(spark, WORDS, WORDS[:20])
    with pytest.raises(ValueError):
        R.policy_of(spark.createDataFrame([("", WORDS[0]), ("", WORDS[1])], "state string, guess string"))
    rows = R.replay(lists, spark.createDataFrame([("", WORDS[0])], "state string, guess string")).collect()
    holes = {r.state for r in rows if r.guess is None}
    assert holes == {f"|{WORDS[0]}:{code(WORDS[0], a)}" for a in WORDS[1:20]} and {r.answer for r in rows if r.code == 242} == {WORDS[0]}
    assert all(r.code is None for r in rows if r.guess is None) and len(rows) == 20 + 19


def test_scores_along_the_trie_equal_sums_word_by_word(spark):
    edges = R.trie(spark.createDataFrame([(w,) for w in WORDS], "word string"))
    assert edges.count() == len({w[:2] for w in WORDS}) + len({w[:4] for w in WORDS}) + 2 * len(WORDS)
    states = spark.createDataFrame([("s",), ("t",)], "state string")
    lp = lambda s, n, t: math.log((int(sha(f"lp|{s}|{n}|{t}")[:8], 16) + 1) / 4294967296)
    got = {(r.state, r.word): r.score for r in R.completed(R.first_tokens(states, edges), edges).collect()}
    assert len(got) == 2 * len(WORDS)
    for (s, w), score in got.items():
        assert abs(score - sum(lp(s, n, t) for n, t in (("", w[:2]), (w[:2], w[2:4]), (w[:4], w[4]), (w, "</s>")))) < 1e-9
