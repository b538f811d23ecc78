"""Deductions against a plain reading of the tiles, and whole prompts word for word."""

from __future__ import annotations

import pytest

from gridloom.plans import prompts as P

HISTORIES = [[("geese", "sheep"), ("eerie", "sheep")], [("mamma", "mummy"), ("llama", "mummy")], [("speed", "abide"), ("abide", "abide")], [("crane", "nacre"), ("added", "nacre"), ("array", "nacre")]]


def marks(g: str, a: str) -> list[int]:
    out, rest = [0] * 5, [x for x, y in zip(a, g, strict=True) if x != y]
    for i in range(5):
        if g[i] == a[i]:
            out[i] = 2
        elif g[i] in rest:
            out[i] = 1
            rest.remove(g[i])
    return out


@pytest.fixture(scope="module")
def games(spark):
    rows = []
    for k, h in enumerate(HISTORIES):
        for t, (g, a) in enumerate(h, 1):
            rows.append((f"{a}{k}", t, g, sum(m * 3**i for i, m in enumerate(marks(g, a))), 10 - t))
    spark.createDataFrame(rows, "answer string, turn int, guess string, code int, n_before long").createOrReplaceTempView("some_games")
    return "some_games"


def test_letter_facts(spark, games):
    got = {(r.answer, r.turn, r.letter): (r.least, r.exact, r.greens, r.ruled) for r in spark.sql(P.letter_facts(games)).collect()}
    want = {}
    for k, h in enumerate(HISTORIES):
        for t in range(2, len(h) + 1):
            for letter in sorted({c for g, _ in h[: t - 1] for c in g}):
                least, exact, greens, ruled = 0, None, set(), set()
                for g, a in h[: t - 1]:
                    mine = [(i, m) for i, m in enumerate(marks(g, a)) if g[i] == letter]
                    least = max(least, sum(m > 0 for _, m in mine))
                    if any(m == 0 for _, m in mine):
                        exact = sum(m > 0 for _, m in mine)
                    greens |= {i for i, m in mine if m == 2}
                    ruled |= {i for i, m in mine if m < 2}
                want[h[0][1] + str(k), t, letter] = (least, exact, "".join(map(str, sorted(greens))), "".join(map(str, sorted(ruled))))
    assert got == want


RULES = "You are playing Wordle. Deduce the hidden 5-letter word.\nAfter each guess you receive 5 feedback characters:\n  G = correct letter in the correct position\n  Y = letter is in the word but in a different position\n  B = letter is not in the word (or all its copies are already accounted for)\n"


def test_prompts_word_for_word(spark, games):
    got = {(r.answer, r.turn, r.variant): r.prompt for r in spark.sql(P.prompts(games, True)).collect()}
    assert len({v for _, _, v in got}) == 12
    first = got["sheep0", 1, "raw_history"]
    assert first == RULES + "\n\nHistory: (none - this is the opening guess)\n\nGuess 1 of 6 (6 remaining)\n\nNext guess:"
    block = "Deduced so far:\n  Confirmed letters : p3=E\n  Letters present   : E, S\n  Exact counts      : Ex2\n  Letters absent    : G\n  Ruled-out spots   : E not at [1, 4], S not at [3]"
    assert got["sheep0", 2, "baseline"] == RULES + "\n\nHistory:\n  1. GEESE -> BYGYB\n\n" + block + "\n\nGuess 2 of 6 (5 remaining)\n\nNext guess:"
    assert got["sheep0", 2, "minimal"] == "GEESE BYGYB\n\nNext guess:"
    assert got["sheep0", 1, "minimal"] == "Next guess:"
    assert "\n\nPossible answers remaining: 8\n\nNext guess:" in got["sheep0", 2, "with_count"]
    assert "  1. GEESE ⬛🟨🟩🟨⬛\n" in got["sheep0", 2, "emoji"]
    assert "Guess 1 was GEESE: G is not in the word; E is in the word but not at position 2; E is correct at position 3; S is in the word but not at position 4; E is not in the word.\n" in got["sheep0", 2, "verbose"]
    assert "\n\nYou know position 3 is E. The word contains E, S. It does not contain G. Also, E is not at position [2, 5]; S is not at position [4].\n\n" in got["sheep0", 2, "guided_prose"]
    assert "\n  Q  W  E* R  T  Y  U  I  O  P \n  A  S+ D  F  G- H  J  K  L \n" in got["sheep0", 2, "keyboard"]
    assert "History (most recent first):\n  ADDED -> YBBYB\n  CRANE -> YYYYG\n" in got["nacre3", 3, "reversed"]
    assert "\n\nPlay only words that are consistent with every clue above.\n\nNext guess:" in got["sheep0", 2, "hard_mode_hint"]


def test_worked_examples(spark, games):
    """The examples rotate with the md5 of the history as Python writes it."""
    import hashlib

    got = {(r.answer, r.turn): r.prompt for r in spark.sql(P.prompts(games, True)).where("variant = 'few_shot'").collect()}
    patterns = lambda g, a: "".join("BYG"[m] for m in marks(g, a))
    for k, h in enumerate(HISTORIES):
        for t in range(1, len(h) + 1):
            past = tuple((g, patterns(g, a)) for g, a in h[: t - 1])
            first = int(hashlib.md5(repr(past).encode()).hexdigest()[:8], 16) % 8
            text = got[h[0][1] + str(k), t]
            assert [line[12:] for line in text.split("\n") if line.startswith("Next guess: ")] == [P.SHOTS[(first + i) % 8][2].upper() for i in range(2)]
            assert text.startswith(RULES + "\n\nExample 1\nHistory:\n  1. SALET -> ") and "\n\nNow your game.\nHistory" in text
    assert P.shot_lines(1, P.SHOTS[1]) == ("Example 1", "History:", "  1. SALET -> BBBBB", "  2. CRONY -> BBYBG", "Deduced so far:", "  Confirmed letters : p5=Y", "  Letters present   : O, Y", "  Letters absent    : A, C, E, L, N, R, S, T", "  Ruled-out spots   : O not at [2]", "Next guess: HOWDY", "")
    assert all(P.tiles_of(g, a) == marks(g, a) for h in HISTORIES for g, a in h)
