"""Deductions from a history, and the prompts that show them, as SQL text that Spark and DuckDB both run.

A history is the earlier rows of a game: games(answer, turn, guess, code). Deductions are one aggregate over the tiles
(one row a place of each guess), so all states of all games are rendered together.
"""

from __future__ import annotations

from gridloom.functions.feedback import code_to_pattern

TURNS = 6
NL = "chr(10)"

# The prompts' wording must come out as published.
RULES = (
    "You are playing Wordle. Deduce the hidden 5-letter word.",
    "After each guess you receive 5 feedback characters:",
    "  G = correct letter in the correct position",
    "  Y = letter is in the word but in a different position",
    "  B = letter is not in the word (or all its copies are already accounted for)",
    "",
)
EMOJI_RULES = (
    "You are playing Wordle. Deduce the hidden 5-letter word.",
    "After each guess you receive 5 tiles:",
    "  🟩 = correct letter in the correct position",
    "  🟨 = letter is in the word but in a different position",
    "  ⬛ = letter is not in the word",
    "",
)
NO_HISTORY = "History: (none - this is the opening guess)"
NEXT = "Next guess:"
HINT = "Play only words that are consistent with every clue above."
# Worked examples as (answer, guesses so far, next guess); two of them stand in a prompt.
SHOTS = (
    ("chart", ("salet",), "audit"),
    ("hobby", ("salet", "crony"), "howdy"),
    ("plumb", ("salet", "chord"), "imply"),
    ("wince", ("salet", "dingo"), "mince"),
    ("proxy", ("salet", "chirp"), "proud"),
    ("thumb", ("salet", "conic"), "truth"),
    ("berth", ("salet", "brine"), "berth"),
    ("glaze", ("salet",), "blame"),
)
SHOTS_SHOWN = 2
KEYBOARD = ("QWERTYUIOP", "ASDFGHJKL", "ZXCVBNM")
KEYBOARD_TITLE = "Letter status  (* = right spot, + = in word, - = not in word):"


def tiles_of(guess: str, answer: str) -> list[int]:
    """Marks of a guess: 2 right place, 1 elsewhere, 0 absent."""
    open_ = [a for g, a in zip(guess, answer, strict=True) if g != a]
    out = []
    for i, g in enumerate(guess):
        earlier = sum(1 for j in range(i) if guess[j] == g and guess[j] != answer[j])
        out.append(2 if g == answer[i] else int(earlier < open_.count(g)))
    return out


def shot_lines(number: int, shot: tuple[str, tuple[str, ...], str]) -> tuple[str, ...]:
    """A worked example: its history, what follows from it, and the next guess."""
    answer, guesses, following = shot
    past = [(g, tiles_of(g, answer)) for g in guesses]
    shown = [f"  {i}. {g.upper()} -> {''.join('BYG'[m] for m in marks)}" for i, (g, marks) in enumerate(past, 1)]
    letters = sorted({c for g, _ in past for c in g})
    own = {c: [[(i, m) for i, m in enumerate(marks) if g[i] == c] for g, marks in past] for c in letters}
    least = {c: max(sum(m > 0 for _, m in each) for each in own[c]) for c in letters}
    exact = {c: [sum(m > 0 for _, m in each) for each in own[c] if any(m == 0 for _, m in each)][-1:] for c in letters}
    greens = {i: c for c in letters for each in own[c] for i, m in each if m == 2}
    ruled = {c: sorted({i for each in own[c] for i, m in each if m < 2}) for c in letters if least[c]}
    known_ = [
        f"  Confirmed letters : {' '.join(f'p{i + 1}={greens[i].upper()}' for i in sorted(greens)) or '(none)'}",
        f"  Letters present   : {', '.join(c.upper() for c in letters if least[c]) or '(none)'}",
    ]
    counts = ", ".join(f"{c.upper()}x{exact[c][0]}" for c in letters if exact[c] and exact[c][0])
    spots = ", ".join(f"{c.upper()} not at {ruled[c]}" for c in letters if ruled.get(c))
    known_ += [f"  Exact counts      : {counts}"] if counts else []
    known_ += [f"  Letters absent    : {', '.join(c.upper() for c in letters if exact[c] == [0]) or '(none)'}"]
    known_ += [f"  Ruled-out spots   : {spots}"] if spots else []
    return (f"Example {number}", "History:", *shown, "Deduced so far:", *known_, f"{NEXT} {following.upper()}", "")


def shot_choice(state: str, spark: bool) -> str:
    """SQL: which example comes first, by the first eight digits of the history's md5."""
    digits = f"substr(md5({state}), 1, 8)"
    return (f"CAST(conv({digits}, 16, 10) AS BIGINT)" if spark else f"CAST(('0x' || {digits}) AS BIGINT)") + f" % {len(SHOTS)}"


def quoted(lines: tuple[str, ...]) -> str:
    return f" || {NL} || ".join(f"'{x}'" for x in lines)


def tiles(games: str) -> str:
    """answer, turn, place (from 0), letter, mark (0 to 2)."""
    return " UNION ALL ".join(f"SELECT answer, turn, {i} AS place, substr(guess, {i + 1}, 1) AS letter, CAST(floor(code / {3.0**i}) AS INT) % 3 AS mark FROM {games}" for i in range(5))


def past(games: str) -> str:
    """answer, turn (of the state), letter, place, mark, seen (the turn of the guess), of all earlier guesses."""
    return f"SELECT s.answer, s.turn, t.letter, t.place, t.mark, t.turn AS seen FROM {games} s JOIN ({tiles(games)}) t ON t.answer = s.answer AND t.turn < s.turn"


def letter_facts(games: str) -> str:
    """answer, turn, letter, least, exact (null: open), greens and ruled (digits of places from 0, in order), status.

    least is the most marked copies in one guess; exact the marked copies of the last guess that greyed the letter.
    """
    spots = " || ".join(f"CASE WHEN max(CASE WHEN place = {i} AND mark = 2 THEN 1 ELSE 0 END) = 1 THEN '{i}' ELSE '' END" for i in range(5))
    ruled = " || ".join(f"CASE WHEN max(CASE WHEN place = {i} AND mark < 2 THEN 1 ELSE 0 END) = 1 THEN '{i}' ELSE '' END" for i in range(5))
    each = f"SELECT answer, turn, letter, seen, sum(CASE WHEN mark > 0 THEN 1 ELSE 0 END) AS marked, max(CASE WHEN mark = 0 THEN 1 ELSE 0 END) AS grey FROM ({past(games)}) p GROUP BY answer, turn, letter, seen"
    counts = f"SELECT answer, turn, letter, CAST(max(marked) AS BIGINT) AS least, CAST(max(CASE WHEN grey = 1 THEN seen * 10 + marked END) % 10 AS BIGINT) AS exact FROM ({each}) e GROUP BY answer, turn, letter"
    places = f"SELECT answer, turn, letter, {spots} AS greens, {ruled} AS ruled, max(mark) AS status FROM ({past(games)}) p GROUP BY answer, turn, letter"
    return f"SELECT c.answer, c.turn, c.letter, c.least, c.exact, p.greens, p.ruled, p.status FROM ({counts}) c JOIN ({places}) p ON p.answer = c.answer AND p.turn = c.turn AND p.letter = c.letter"


def listed(kind: str, each: str, order: str, by: str, spark: bool) -> str:
    """Aggregate: `each` of the rows where `kind`, in the order given, joined by `by`; an empty text for none."""
    if spark:
        return f"array_join(transform(array_sort(collect_list(CASE WHEN {kind} THEN struct({order} AS o, {each} AS v) END)), x -> x.v), '{by}')"
    return f"coalesce(string_agg({each}, '{by}' ORDER BY {order}) FILTER (WHERE {kind}), '')"


def deductions(games: str, spark: bool) -> str:
    """answer, turn and texts: fixed (p1=A p3=B), pattern, prose_fixed, present, exact, absent, ruled, prose_ruled."""
    f = f"SELECT *, upper(letter) AS big FROM ({letter_facts(games)}) l"
    green = [f"max(CASE WHEN greens LIKE '%{i}%' THEN big END)" for i in range(5)]
    fixed = "trim(" + " || ".join(f"coalesce(' p{i + 1}=' || {g}, '')" for i, g in enumerate(green)) + ")"
    prose = "substr(" + " || ".join(f"coalesce(', position {i + 1} is ' || {g}, '')" for i, g in enumerate(green)) + ", 3)"
    pattern = " || ".join(f"coalesce(lower({g}), '.')" for g in green)
    zero = "'[' || substr(" + " || ".join(f"CASE WHEN ruled LIKE '%{i}%' THEN ', {i}' ELSE '' END" for i in range(5)) + ", 3) || ']'"
    one = "'[' || substr(" + " || ".join(f"CASE WHEN ruled LIKE '%{i}%' THEN ', {i + 1}' ELSE '' END" for i in range(5)) + ", 3) || ']'"
    kept = "least > 0 AND ruled <> ''"
    columns = {
        "present": listed("least > 0", "big", "letter", ", ", spark),
        "exact": listed("exact > 0", "big || 'x' || CAST(exact AS VARCHAR(3))", "letter", ", ", spark),
        "absent": listed("exact = 0", "big", "letter", ", ", spark),
        "ruled": listed(kept, f"big || ' not at ' || {zero}", "letter", ", ", spark),
        "prose_ruled": listed(kept, f"big || ' is not at position ' || {one}", "letter", "; ", spark),
    }
    return f"SELECT answer, turn, {fixed} AS fixed, {pattern} AS pattern, {prose} AS prose_fixed, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM ({f}) f GROUP BY answer, turn"


def keyboards(games: str) -> str:
    """answer, turn, keys: three lines of letters, each with the best mark seen."""
    state = lambda c: f"CASE max(CASE WHEN letter = '{c.lower()}' THEN status END) WHEN 2 THEN '{c}*' WHEN 1 THEN '{c}+' WHEN 0 THEN '{c}-' ELSE '{c} ' END"
    rows = f" || {NL} || ".join("'  ' || " + " || ' ' || ".join(map(state, row)) for row in KEYBOARD)
    return f"SELECT answer, turn, {rows} AS keys FROM ({letter_facts(games)}) l GROUP BY answer, turn"


def histories(games: str, spark: bool) -> str:
    """answer, turn, n, and the earlier guesses in six notations."""
    pattern = code_to_pattern("h.code")
    emoji = f"replace(replace(replace({pattern}, 'G', '🟩'), 'Y', '🟨'), 'B', '⬛')"
    tile = lambda i: f"upper(substr(h.guess, {i + 1}, 1)) || CASE CAST(floor(h.code / {3.0**i}) AS INT) % 3 WHEN 2 THEN ' is correct at position {i + 1}' WHEN 1 THEN ' is in the word but not at position {i + 1}' ELSE ' is not in the word' END"
    told = "'Guess ' || CAST(h.turn AS VARCHAR(3)) || ' was ' || upper(h.guess) || ': ' || " + " || '; ' || ".join(map(tile, range(5))) + " || '.'"
    number = "'  ' || CAST(h.turn AS VARCHAR(3)) || '. ' || upper(h.guess)"
    notations = {
        "lines": (f"{number} || ' -> ' || {pattern}", "h.turn"),
        "bare": (f"upper(h.guess) || ' ' || {pattern}", "h.turn"),
        "emoji": (f"{number} || ' ' || {emoji}", "h.turn"),
        "told": (told, "h.turn"),
        "backwards": (f"'  ' || upper(h.guess) || ' -> ' || {pattern}", "-h.turn"),
        "repr": (f"'(' || chr(39) || h.guess || chr(39) || ', ' || chr(39) || {pattern} || chr(39) || ')'", "h.turn"),
    }
    joined = ", ".join(f"{listed('h.turn IS NOT NULL', e, o, '@@', spark)} AS {k}_" for k, (e, o) in notations.items())
    inner = f"SELECT s.answer, s.turn, max(s.n_before) AS n, {joined} FROM {games} s LEFT JOIN {games} h ON h.answer = s.answer AND h.turn < s.turn GROUP BY s.answer, s.turn"
    return "SELECT answer, turn, n, " + ", ".join(f"replace({k}_, '@@', {NL if k != 'repr' else chr(39) + ', ' + chr(39)}) AS {k}" for k in notations) + f" FROM ({inner}) i"


def known(name: str, none: str) -> str:
    return f"CASE WHEN coalesce({name}, '') = '' THEN '{none}' ELSE {name} END"


#: All renderings of a state.
VARIANTS = ("few_shot", "baseline", "raw_history", "constraints_only", "minimal", "with_count", "emoji", "verbose", "reversed", "keyboard", "guided_prose", "hard_mode_hint")


def prompts(games: str, spark: bool, wanted: tuple[str, ...] = ()) -> str:
    """answer, turn, variant, prompt: twelve renderings of every state, or the wanted ones alone."""
    rules, nl, two = quoted(RULES), NL, f"{NL} || {NL}"
    turn = f"'Guess ' || CAST(turn AS VARCHAR(3)) || ' of {TURNS} (' || CAST({TURNS + 1} - turn AS VARCHAR(3)) || ' remaining)'"
    end = f"{two} || {turn} || {two} || '{NEXT}'"
    history = f"CASE WHEN turn = 1 THEN '{NO_HISTORY}' ELSE 'History:' || {nl} || lines END"
    block = f"""'Deduced so far:' || {nl} || '  Confirmed letters : ' || {known('fixed', '(none)')} || {nl} || '  Letters present   : ' || {known('present', '(none)')}
        || CASE WHEN coalesce(exact, '') = '' THEN '' ELSE {nl} || '  Exact counts      : ' || exact END || {nl} || '  Letters absent    : ' || {known('absent', '(none)')}
        || CASE WHEN coalesce(ruled, '') = '' THEN '' ELSE {nl} || '  Ruled-out spots   : ' || ruled END"""
    base = f"{rules} || {two} || {history} || {two} || {block}"
    prose = "trim(" + " || ".join(f"CASE WHEN coalesce({c}, '') = '' THEN '' ELSE '{a}' || {c} || '. ' END" for c, a in (("prose_fixed", "You know "), ("present", "The word contains "), ("absent", "It does not contain "), ("prose_ruled", "Also, "))) + ")"
    written = "CASE WHEN turn = 1 THEN '()' WHEN turn = 2 THEN '(' || repr || ',)' ELSE '(' || repr || ')' END"
    shown = [tuple(line for i in range(SHOTS_SHOWN) for line in shot_lines(i + 1, SHOTS[(k + i) % len(SHOTS)])) for k in range(len(SHOTS))]
    shots = f"CASE {shot_choice(written, spark)} " + " ".join(f"WHEN {k} THEN {quoted(lines)}" for k, lines in enumerate(shown)) + " END"
    variants = {
        "few_shot": f"{rules} || {two} || {shots} || {nl} || 'Now your game.' || {nl} || {history} || {two} || {block} || {end}",
        "baseline": f"{base} || {end}",
        "raw_history": f"{rules} || {two} || {history} || {end}",
        "constraints_only": f"{rules} || {two} || CASE WHEN turn = 1 THEN 'Nothing is known yet.' ELSE {block} END || {end}",
        "minimal": f"CASE WHEN turn = 1 THEN '' ELSE bare || {two} END || '{NEXT}'",
        "with_count": f"{base} || {two} || {turn} || {two} || 'Possible answers remaining: ' || CAST(n AS VARCHAR(12)) || {two} || '{NEXT}'",
        "emoji": f"{quoted(EMOJI_RULES)} || {two} || CASE WHEN turn = 1 THEN '{NO_HISTORY}' ELSE 'History:' || {nl} || emoji END || {end}",
        "verbose": f"{rules} || {two} || 'What you have learned:' || {nl} || CASE WHEN turn = 1 THEN 'You have not guessed yet.' ELSE told END || {end}",
        "reversed": f"{rules} || {two} || CASE WHEN turn = 1 THEN '{NO_HISTORY}' ELSE 'History (most recent first):' || {nl} || backwards END || {two} || CASE WHEN turn = 1 THEN '' ELSE {block} END || {end}",
        "keyboard": f"{rules} || {two} || {history} || {two} || '{KEYBOARD_TITLE}' || {nl} || coalesce(keys, {EMPTY_KEYS}) || {end}",
        "guided_prose": f"{rules} || {two} || CASE WHEN turn = 1 THEN 'You know nothing yet, so pick a word that tests common letters.' ELSE 'History:' || {nl} || lines || {two} || {prose} END || {end}",
        "hard_mode_hint": f"{base} || {two} || {turn} || {two} || '{HINT}' || {two} || '{NEXT}'",
    }
    variants = {v: text for v, text in variants.items() if v in wanted or not wanted}
    keys, board = ("k.keys", f" LEFT JOIN ({keyboards(games)}) k ON k.answer = h.answer AND k.turn = h.turn") if "keyboard" in variants else ("NULL AS keys", "")
    source = f"SELECT h.*, d.fixed, d.prose_fixed, d.present, d.exact, d.absent, d.ruled, d.prose_ruled, {keys} FROM ({histories(games, spark)}) h LEFT JOIN ({deductions(games, spark)}) d ON d.answer = h.answer AND d.turn = h.turn{board}"
    names = ", ".join(f"'{v}'" for v in variants)
    chosen = "CASE variant " + " ".join(f"WHEN '{v}' THEN {text}" for v, text in variants.items()) + " END"
    listing = f"explode(array({names}))" if spark else f"unnest([{names}])"
    return f"SELECT answer, turn, variant, {chosen} AS prompt FROM (SELECT s.*, v.variant FROM ({source}) s CROSS JOIN (SELECT {listing} AS variant) v) x"


EMPTY_KEYS = "(" + f" || {NL} || ".join("'  " + " ".join(c + " " for c in row) + "'" for row in KEYBOARD) + ")"
