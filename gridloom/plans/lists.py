"""Games with two word lists: answers, and the larger list of legal guesses. Pools, hard mode, suggestions, tree search.

A policy is a rule's ORDER BY and a predicate for the guesses it may make: all legal ones, candidates below a number of
them, or the admissible ones (legal words that agree with all feedback so far). A state's admissible words are a
relation of their own that shrinks by a join a turn, as the candidates do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.feedback import ALL_RIGHT, code_to_pattern
from gridloom.operators.loop import Lists
from gridloom.operators.tree import LARGEST, TreeConfig, adaptive_values, tree_games, tree_values
from gridloom.plans import games as G
from gridloom.plans.queries import ORACLES, QUERIES, query
from gridloom.session import scratch_table

#: Stands for the answers' file: a fixed draw of three words in eight.
ANSWERS_SQL = "SELECT word AS answer FROM vocab WHERE {sha}(concat('answers|', word){bits}) < '6'"
CHANCE = "{sha}(concat('20260817|', state, '|', guess){bits}), guess"
FORCED, ALWAYS = "FALSE", "TRUE"
#: Policy: the rule, and which guesses beside the candidates it may make while more than two candidates and a turn are left.
POLICIES = {
    "full": ("entropy", ALWAYS),
    "adaptive_20": ("entropy", "n > 20"),
    "candidates": ("entropy", FORCED),
    "hard": ("entropy", "adm = 1"),
    "restricted": ("expected", "n_adm > 20 OR adm = 1"),
    "minimax": ("minimax", ALWAYS),
    "hybrid": ("hybrid", ALWAYS),
    # controls: a random admissible word; a random legal word while more than 20 are admissible
    "random_admissible": (CHANCE, "adm = 1"),
    "random_restricted": (CHANCE, "n_adm > 20 OR adm = 1"),
    # rollouts: a fixed opener, the expert in 0.7 of second turns, then admissible words alone, in wide states a candidate
    # in 0.5, an admissible word in 0.4 and any word in the rest
    "rollout": (
        "CASE WHEN turn_no = 1 OR (turn_no = 2 AND {sha}(concat('expert|', state){bits}) < 'b3333333') THEN -round(h, 9) WHEN turn_no = 2 OR n_adm <= 20 THEN -adm"
        " WHEN {sha}(concat('kind|', state){bits}) < '80000000' THEN -isc WHEN {sha}(concat('kind|', state){bits}) < 'e6666666' THEN -adm ELSE 0 END, {sha}(concat('20260821|', state, '|', guess){bits}), guess",
        ALWAYS,
    ),
}


def filled(text: str, spark: bool) -> str:
    return text.replace("{sha}", "sha2" if spark else "sha256").replace("{bits}", ", 256" if spark else "")


def turn_sql(turn: int, policy: str, alive: str, adm: str, spark: bool, fba: str = "fba") -> str:
    """answer, turn, guess, code, n_before, n_adm, adm (the guess was admissible), isc (it was a candidate), state."""
    rule, pool = POLICIES[policy]
    order = filled(G.RULES.get(rule, rule), spark).replace("turn_no", str(turn))
    allowed = f"isc = 1 OR (n > {G.ENDGAME} AND {turn} < {G.TURNS} AND ({pool}))"
    stats = f"""SELECT s.state, s.guess, s.sumsq, s.worst, s.n, s.h, s.isc, CASE WHEN a.guess IS NULL THEN 0 ELSE 1 END AS adm, c.n_adm FROM ({G.scored_stats(turn, alive, fba, pool != FORCED)}) s
        LEFT JOIN {adm} a ON a.state = s.state AND a.guess = s.guess JOIN (SELECT state, count(*) AS n_adm FROM {adm} GROUP BY state) c ON c.state = s.state"""
    choice = f"SELECT state, guess, n, n_adm, adm, isc FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY {order}) AS rn FROM ({stats}) t WHERE {allowed}) u WHERE rn = 1"
    return G.played_sql(turn, alive, choice, "n_adm", "adm", "isc")


def admissible_sql(adm: str, played: str, fb: str = "fb") -> str:
    """Legal words that agree with the turn just played, too."""
    moves = f"SELECT DISTINCT state, guess, code FROM {played} WHERE code <> {ALL_RIGHT}"
    return f"SELECT concat(m.state, '|', m.guess, ':', CAST(m.code AS VARCHAR(9))) AS state, a.guess FROM {adm} a JOIN ({moves}) m ON m.state = a.state JOIN {fb} f ON f.guess = m.guess AND f.answer = a.guess AND f.code = m.code"


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """vocab, fb, answers and fba (feedback of legal guesses against answers), registered under these names."""
    vocab, fb = G.table(spark, sf_dir, "vocab"), G.table(spark, sf_dir, "fb")
    answers = spark.sql(filled(ANSWERS_SQL, True))
    answers.createOrReplaceTempView("answers")
    fba = fb.join(answers, "answer", "left_semi")
    fba.createOrReplaceTempView("fba")
    return vocab, fb, answers, fba


def list_games(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    """All games of a policy: answer, turn, guess, code, n_before, n_adm, adm, isc, state."""

    def play() -> DataFrame:
        tables(spark, sf_dir)
        spark.sql("SELECT answer, '' AS state FROM answers").createOrReplaceTempView("alive2")
        spark.sql("SELECT '' AS state, word AS guess FROM vocab").createOrReplaceTempView("adm2")
        out = None
        for turn in range(1, G.TURNS + 1):
            played = scratch_table(spark.sql(turn_sql(turn, policy, "alive2", "adm2", True)), "turn")
            out = played if out is None else out.unionByName(played)
            played.createOrReplaceTempView("played2")
            if turn < G.TURNS:
                scratch_table(spark.sql(admissible_sql("adm2", "played2")), "admissible").createOrReplaceTempView("adm2")
                spark.sql(G.next_sql("played2")).createOrReplaceTempView("alive2")
        return out

    return G.kept(spark, sf_dir, f"list-{policy}", play)


def lists_oracle() -> str:
    return f"{G.base_oracle()}, answers AS ({filled(ANSWERS_SQL, False)}), fba AS MATERIALIZED (SELECT f.* FROM fb f JOIN answers USING (answer))"


def list_games_oracle(policy: str, name: str = "lg") -> str:
    x, parts = name, [f"{name}_alive1 AS (SELECT answer, '' AS state FROM answers), {name}_adm1 AS (SELECT '' AS state, word AS guess FROM vocab)"]
    for t in range(1, G.TURNS + 1):
        parts.append(f"{x}_t{t} AS MATERIALIZED ({turn_sql(t, policy, f'{x}_alive{t}', f'{x}_adm{t}', False)})")
        parts.append(f"{x}_adm{t + 1} AS MATERIALIZED ({admissible_sql(f'{x}_adm{t}', f'{x}_t{t}')}), {x}_alive{t + 1} AS ({G.next_sql(f'{x}_t{t}')})")
    return ", ".join(parts) + f", {x} AS (" + " UNION ALL ".join(f"SELECT * FROM {x}_t{t}" for t in range(1, G.TURNS + 1)) + ")"


COLUMNS = ("answer", "turn", "guess", "code", "n_before", "n_adm", "adm", "isc")


def _register(policy: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return list_games(spark, sf_dir, policy).select(*COLUMNS)

    QUERIES[f"list_games_{policy}"] = run
    ORACLES[f"list_games_{policy}"] = f"{lists_oracle()}, {list_games_oracle(policy)} SELECT {', '.join(COLUMNS)} FROM lg"


for _policy in POLICIES:
    _register(_policy)


def scores(games: DataFrame) -> DataFrame:
    """answer, score: turns of solved games, 7 for others."""
    return games.groupBy("answer").agg(F.when(F.max(F.when(F.col("code") == ALL_RIGHT, 1)) == 1, F.max("turn")).otherwise(G.FAILED).cast("long").alias("score"))


SCORE = f"SELECT answer, CAST(CASE WHEN bool_or(code = {ALL_RIGHT}) THEN max(turn) ELSE {G.FAILED} END AS BIGINT) AS score FROM {{g}} GROUP BY answer"

# -- vocabularies -------------------------------------------------------------------------------------------------


@query(lists_oracle() + """, e AS (SELECT word FROM vocab EXCEPT SELECT answer FROM answers), c AS (SELECT word FROM vocab), f AS (SELECT 'extras' AS file, word FROM e UNION ALL SELECT 'complete', word FROM c)
    SELECT file, (SELECT count(*) FROM answers) AS answers, count(*) AS listed, count(a.answer) AS overlap, count(a.answer) = 0 AS read_as_extras,
        (SELECT count(*) FROM (SELECT answer FROM answers UNION SELECT word FROM f g WHERE g.file = f.file)) AS legal FROM f LEFT JOIN answers a ON a.answer = f.word GROUP BY file""")
def vocabulary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a guess file is read: as extras if it shares no word with the answers, else as the complete list."""
    vocab, _, answers, _ = tables(spark, sf_dir)
    words, own = vocab.select("word"), answers.select(F.col("answer").alias("word"))

    def of(name: str, listed: DataFrame) -> DataFrame:
        overlap = listed.intersect(own).agg(F.count("*").alias("overlap"))
        legal = own.union(listed).distinct().agg(F.count("*").alias("legal"))
        sizes = own.agg(F.count("*").alias("answers")).crossJoin(listed.agg(F.count("*").alias("listed")))  # one row each
        return sizes.crossJoin(overlap).crossJoin(legal).select(F.lit(name).alias("file"), "answers", "listed", "overlap", (F.col("overlap") == 0).alias("read_as_extras"), "legal")

    return of("extras", words.exceptAll(own)).unionByName(of("complete", words))


@query(lists_oracle() + " SELECT (SELECT count(*) FROM answers WHERE answer NOT IN (SELECT word FROM vocab)) AS missing, (SELECT count(*) FROM answers) AS answers, (SELECT count(*) FROM vocab) - (SELECT count(*) FROM answers) AS extras")
def answers_subset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab, _, answers, _ = tables(spark, sf_dir)
    missing = answers.join(vocab, answers["answer"] == vocab["word"], "left_anti").agg(F.count("*").alias("missing"))
    extras = vocab.join(answers, vocab["word"] == answers["answer"], "left_anti").agg(F.count("*").alias("extras"))
    return missing.crossJoin(answers.agg(F.count("*").alias("answers"))).crossJoin(extras)  # one row each


@query(lists_oracle() + r""", t AS (SELECT word, substr(word, 1, 1) AS letter, row_number() OVER (ORDER BY word) AS place, lag(word) OVER (ORDER BY word) AS before FROM vocab)
    SELECT letter, count(*) AS words, count(answer) AS answers, count(*) FILTER (WHERE before > word) AS unsorted, count(*) FILTER (WHERE word <> lower(word)) AS cased, count(*) FILTER (WHERE strlen(word) <> length(word)) AS wide, count(DISTINCT word) AS distinct_words FROM t LEFT JOIN answers ON answer = word GROUP BY letter""")
def word_list_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By first letter: sizes, and words out of order, with capitals or with characters of several bytes."""
    vocab, _, answers, _ = tables(spark, sf_dir)
    before = F.lag("word").over(Window.partitionBy("letter").orderBy("word"))
    t = vocab.select("word", F.substring("word", 1, 1).alias("letter")).withColumn("before", before).join(answers, F.col("word") == F.col("answer"), "left")
    return t.groupBy("letter").agg(F.count("*").alias("words"), F.count("answer").alias("answers"), F.count_if(F.col("before") > F.col("word")).alias("unsorted"), F.count_if(F.col("word") != F.lower("word")).alias("cased"), F.count_if(F.octet_length("word") != F.length("word")).alias("wide"), F.countDistinct("word").alias("distinct_words"))


# -- states, free histories and suggestions -----------------------------------------------------------------------


@query(lists_oracle() + f""", {list_games_oracle('full')}, h AS (SELECT DISTINCT state FROM lg WHERE turn = 3),
    facts AS (SELECT state, split_part(p, ':', 1) AS guess, CAST(split_part(p, ':', 2) AS INT) AS code FROM (SELECT state, unnest(string_split(substr(state, 2), '|')) AS p FROM h)),
    broken AS (SELECT DISTINCT c.state, c.word FROM (SELECT h.state, v.word FROM h, vocab v) c JOIN facts x ON x.state = c.state JOIN fb f ON f.guess = x.guess AND f.answer = c.word WHERE f.code <> x.code)
    SELECT h.state, v.word, v.word IN (SELECT answer FROM answers) AS candidate FROM h, vocab v WHERE NOT EXISTS (SELECT 1 FROM broken b WHERE b.state = h.state AND b.word = v.word)""")
def admissible_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free histories folded: the legal words that agree with every guess of a history, and which of them are answers."""
    _, _, answers, _ = tables(spark, sf_dir)
    histories = list_games(spark, sf_dir, "full").where("turn = 3").select("state").distinct()
    return consistent_words(spark, sf_dir, parsed(histories)).join(answers.select(F.col("answer").alias("word"), F.lit(True).alias("hit")), "word", "left").select("state", "word", F.coalesce("hit", F.lit(False)).alias("candidate"))


def parsed(histories: DataFrame) -> DataFrame:
    """state (|guess:code|guess:code) -> state, guess, code, n (turns of the history)."""
    turns = F.filter(F.split("state", r"\|"), lambda x: x != "")
    each = histories.select("state", F.size(turns).alias("n"), F.explode(turns).alias("turn"))
    return each.select("state", "n", F.split_part("turn", F.lit(":"), F.lit(1)).alias("guess"), F.split_part("turn", F.lit(":"), F.lit(2)).cast("int").alias("code"))


def consistent_words(spark: SparkSession, sf_dir: str, facts: DataFrame) -> DataFrame:
    """facts: state, n, guess, code -> state, word: words that agree with all n of a state's facts."""
    fb = G.table(spark, sf_dir, "fb").select("guess", F.col("answer").alias("word"), "code")
    return facts.join(fb, ["guess", "code"]).groupBy("state", "word").agg(F.count("*").alias("k"), F.max("n").alias("n")).where("k = n").select("state", "word")


def suggest(spark: SparkSession, sf_dir: str, histories: DataFrame, n: int = 5) -> DataFrame:
    """histories: state -> the n best guesses by entropy: state, place, guess, entropy, expected, candidates, possible."""
    _, _, answers, fba = tables(spark, sf_dir)
    alive = consistent_words(spark, sf_dir, parsed(histories)).withColumnRenamed("word", "answer").join(answers, "answer", "left_semi")
    buckets = alive.join(fba, "answer").groupBy("state", "guess", "code").agg(F.count("*").alias("k"))
    k = F.col("k")
    stats = buckets.groupBy("state", "guess").agg(F.sum("k").alias("candidates"), F.sum(k * k).alias("sumsq"), F.sum(k * F.log2(k)).alias("kl"), F.max((F.col("code") == ALL_RIGHT).cast("int")).alias("possible"))
    h = F.log2("candidates") - F.col("kl") / F.col("candidates")
    place = F.row_number().over(Window.partitionBy("state").orderBy(F.desc(F.round(h, 9)), F.desc("possible"), "guess"))
    best = stats.withColumn("place", place.cast("long")).where(F.col("place") <= n)
    return best.select("state", "place", "guess", F.round(h, 6).alias("entropy"), F.round(F.col("sumsq") / F.col("candidates"), 6).alias("expected"), "candidates", (F.col("possible") == 1).alias("possible"))


@query(lists_oracle() + f""", {list_games_oracle('full')}, al AS (SELECT answer, state FROM lg WHERE turn = 3), s AS ({G.STATS_SQL.format(alive='al', fb='fba')}),
    r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY round(h, 9) DESC, isc DESC, guess) AS place FROM s)
    SELECT state, place, guess, round(h, 6) AS entropy, round(sumsq * 1.0 / n, 6) AS expected, n AS candidates, isc = 1 AS possible FROM r WHERE place <= 5""")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest(spark, sf_dir, list_games(spark, sf_dir, "full").where("turn = 3").select("state").distinct())


@query(lists_oracle() + f""", {list_games_oracle('restricted')} SELECT CASE WHEN n_adm <= 20 THEN 'admissible' ELSE 'legal' END AS space, turn, count(*) AS steps, sum(adm) AS admissible, sum(isc) AS candidates, avg(n_adm) AS mean_admissible,
    count(*) FILTER (WHERE n_adm = 1) AS forced, count(*) FILTER (WHERE code = {ALL_RIGHT} AND n_adm = 1) AS won_forced, count(*) FILTER (WHERE code = {ALL_RIGHT} AND n_adm > 1) AS won_chosen FROM lg GROUP BY ALL""")
def action_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the restricted policy could play and played; forced: one action alone was left."""
    g = list_games(spark, sf_dir, "restricted").withColumn("space", F.when(F.col("n_adm") <= 20, "admissible").otherwise("legal"))
    won = F.col("code") == ALL_RIGHT
    return g.groupBy("space", "turn").agg(F.count("*").alias("steps"), F.sum("adm").alias("admissible"), F.sum("isc").alias("candidates"), F.avg("n_adm").alias("mean_admissible"), F.count_if(F.col("n_adm") == 1).alias("forced"), F.count_if(won & (F.col("n_adm") == 1)).alias("won_forced"), F.count_if(won & (F.col("n_adm") > 1)).alias("won_chosen"))


# -- tree search --------------------------------------------------------------------------------------------------


def after_opener(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state (|guess:code), answer, code of the answers that the entropy opener doesn't hit."""
    first = list_games(spark, sf_dir, "full").where(f"turn = 1 AND code <> {ALL_RIGHT}")
    return first.select(F.concat(F.lit("|"), "guess", F.lit(":"), F.col("code").cast("string")).alias("state"), "answer", "code")


def word_lists(spark: SparkSession, sf_dir: str) -> Lists:
    def make() -> Lists:
        vocab, _, answers, _ = tables(spark, sf_dir)
        return Lists(vocab, answers)

    return G.kept(spark, sf_dir, "lists", make)


def list_sql(values: str, order: str = "") -> str:
    return f"list_sort(list({values}))"


POOL = 10


WORST = 1 << 30


def _value(part: str, left: int, more: str) -> str:
    return f"CASE WHEN len({part}) = 1 THEN 1 WHEN {left} <= 1 THEN {WORST} WHEN len({part}) = 2 THEN 3 ELSE coalesce({more}, {WORST}) END"


def lines_sql(x: str, sets: str, left: int) -> list[str]:
    """Greedy lines of `sets` (words), a set known by its words: {x}(words, cost) within `left` guesses."""
    parts, levels = [], max(left - 1, 0)
    for k in range(levels):
        own = sets if not k else f"{x}s{k}"
        parts += [
            f"{x}p{k} AS MATERIALIZED (SELECT m.words, f.guess, f.code, {list_sql('m.answer')} AS part FROM (SELECT words, unnest(words) AS answer FROM {own}) m JOIN fba f USING (answer) WHERE list_contains(m.words, f.guess) GROUP BY ALL)",
            f"{x}g{k} AS MATERIALIZED (SELECT words, guess FROM (SELECT words, guess, row_number() OVER (PARTITION BY words ORDER BY sum(len(part) * len(part)), guess) AS rn FROM {x}p{k} GROUP BY words, guess) WHERE rn = 1)",
            f"{x}e{k} AS MATERIALIZED (SELECT words, part FROM {x}p{k} JOIN {x}g{k} USING (words, guess) WHERE code <> {ALL_RIGHT}), {x}s{k + 1} AS MATERIALIZED (SELECT DISTINCT part AS words FROM {x}e{k} WHERE len(part) > 2)",
        ]
    parts.append(f"{x}v{levels} AS (SELECT words, {WORST}::BIGINT AS cost FROM {sets if not levels else f'{x}s{levels}'})")
    for k in reversed(range(levels)):
        parts.append(f"{x}v{k} AS MATERIALIZED (SELECT words, least({WORST}, len(words) + sum(c))::BIGINT AS cost FROM (SELECT e.words, {_value('e.part', left - k - 1, 'v.cost')} AS c FROM {x}e{k} e LEFT JOIN {x}v{k + 1} v ON v.words = e.part) GROUP BY words)")
    return [*parts, f"{x} AS (SELECT * FROM {x}v0)"]


def lookahead_sql(x: str, sets: str, left: int, depth: int) -> list[str]:
    """Priced actions of `sets` (words): {x}(words, guess, isc, place, cost), by joins over distinct lists of words."""
    parts = [
        f"{x}p AS MATERIALIZED (SELECT m.words, f.guess, f.code, {list_sql('m.answer')} AS part FROM (SELECT words, unnest(words) AS answer FROM {sets}) m JOIN fba f USING (answer) GROUP BY ALL)",
        f"{x}q AS (SELECT words, guess, sum(len(part) * len(part)) AS sumsq, max(CASE WHEN code = {ALL_RIGHT} THEN 1 ELSE 0 END) AS isc, count(*) AS k FROM {x}p GROUP BY ALL)",
        f"{x}pool AS MATERIALIZED (SELECT words, guess, isc, place FROM (SELECT *, row_number() OVER (PARTITION BY words ORDER BY sumsq, guess) AS place FROM {x}q) WHERE (isc = 1 OR place <= {POOL}) AND NOT (k = 1 AND isc = 0))",
        f"{x}e AS MATERIALIZED (SELECT p.words, p.guess, p.part FROM {x}p p JOIN {x}pool USING (words, guess) WHERE p.code <> {ALL_RIGHT}), {x}s AS MATERIALIZED (SELECT DISTINCT part AS words FROM {x}e WHERE len(part) > 2)",
    ]
    if depth > 1:
        parts += [*lookahead_sql(f"{x}a", f"{x}s", left - 1, depth - 1), f"{x}v AS MATERIALIZED (SELECT words, min(cost) AS cost FROM {x}a GROUP BY words)"]
    else:
        parts += lines_sql(f"{x}v", f"{x}s", left - 1)
    return [*parts, f"{x} AS MATERIALIZED (SELECT p.words, p.guess, p.isc, p.place, least({WORST}, len(p.words) + coalesce(sum(c), 0))::BIGINT AS cost FROM {x}pool p LEFT JOIN (SELECT e.words, e.guess, {_value('e.part', left - 1, 'v.cost')} AS c FROM {x}e e LEFT JOIN {x}v v ON v.words = e.part) y USING (words, guess) GROUP BY p.words, p.guess, p.isc, p.place)"]


BEST_ACTION = f"SELECT words, cost, guess FROM {{x}} WHERE cost < {WORST} QUALIFY row_number() OVER (PARTITION BY words ORDER BY cost, isc DESC, CASE WHEN isc = 1 THEN 0 ELSE place END, guess) = 1"


def tree_oracle() -> str:
    """Values of states after the opener at one ply of lookahead, ended by greedy lines."""
    parts = [f"s0 AS MATERIALIZED (SELECT concat('|', guess, ':', code) AS state, {list_sql('answer')} AS words FROM lg_t1 WHERE code <> {ALL_RIGHT} GROUP BY guess, code), sets0 AS MATERIALIZED (SELECT DISTINCT words FROM s0 WHERE len(words) > 2)", *lookahead_sql("la", "sets0", 5, 1)]
    return f"""{lists_oracle()}, {list_games_oracle('full')}, {', '.join(parts)}
        SELECT s.state, len(s.words)::BIGINT AS n, CASE WHEN len(s.words) = 1 THEN 1 WHEN len(s.words) = 2 THEN 3 ELSE b.cost END AS cost, CASE WHEN len(s.words) <= 2 THEN s.words[1] ELSE b.guess END AS guess FROM s0 s LEFT JOIN ({BEST_ACTION.format(x='la')}) b USING (words)"""


def tree_games_oracle(depth: int = 2) -> str:
    """All games by lookahead after the opener; where no action is sure to end in time, the greedy word."""
    parts = [f"tg2 AS (SELECT concat('|', guess, ':', code) AS state, answer FROM lg_t1 WHERE code <> {ALL_RIGHT})"]
    for t in range(2, G.TURNS + 1):
        parts.append(f"ts{t} AS MATERIALIZED (SELECT state, {list_sql('answer')} AS words FROM tg{t} GROUP BY state), tw{t} AS MATERIALIZED (SELECT DISTINCT words FROM ts{t} WHERE len(words) > 2)")
        parts.append(f"tr{t} AS MATERIALIZED (SELECT m.words, f.guess, f.code, count(*) AS k FROM (SELECT words, unnest(words) AS answer FROM tw{t}) m JOIN fba f USING (answer) WHERE list_contains(m.words, f.guess) GROUP BY ALL), tp{t} AS (SELECT words, guess FROM tr{t} GROUP BY words, guess QUALIFY row_number() OVER (PARTITION BY words ORDER BY sum(k * k), guess) = 1)")
        if t < G.TURNS:
            parts += [*lookahead_sql(f"la{t}x", f"tw{t}", G.TURNS - t + 1, depth), f"tb{t} AS ({BEST_ACTION.format(x=f'la{t}x')})"]
        else:
            parts.append(f"tb{t} AS (SELECT words, NULL AS guess FROM tw{t} WHERE FALSE)")
        parts.append(f"tc{t} AS MATERIALIZED (SELECT s.state, len(s.words)::BIGINT AS n_before, CASE WHEN len(s.words) <= 2 THEN s.words[1] ELSE coalesce(b.guess, p.guess) END AS guess FROM ts{t} s LEFT JOIN tb{t} b USING (words) LEFT JOIN tp{t} p USING (words))")
        parts.append(f"tt{t} AS MATERIALIZED (SELECT g.answer, {t} AS turn, c.guess, f.code, c.n_before, g.state FROM tg{t} g JOIN tc{t} c USING (state) JOIN fba f ON f.guess = c.guess AND f.answer = g.answer), tg{t + 1} AS (SELECT concat(state, '|', guess, ':', code) AS state, answer FROM tt{t} WHERE code <> {ALL_RIGHT})")
    every = " UNION ALL ".join(f"SELECT answer, turn, guess, code, n_before FROM tt{t}" for t in range(2, G.TURNS + 1))
    return f"{lists_oracle()}, {list_games_oracle('full')}, {', '.join(parts)} SELECT answer, turn, guess, code, n_before FROM lg_t1 UNION ALL {every}"


@query(tree_oracle())
def tree_state_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and guess of each state after the opener: one ply of lookahead over candidates and the best others."""
    states = after_opener(spark, sf_dir).select("state", "answer")
    return tree_values(word_lists(spark, sf_dir), states, 2, TreeConfig(depth=1, top_k=POOL))


@query(tree_games_oracle())
def solver_games_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All games with two plies of lookahead after the entropy opener."""
    first = list_games(spark, sf_dir, "full").where("turn = 1").select("answer", "turn", "guess", "code", "n_before", "state")
    rest = tree_games(word_lists(spark, sf_dir), after_opener(spark, sf_dir).select("state", "answer"), 2)
    return first.unionByName(rest).select("answer", "turn", "guess", "code", "n_before")


@query(lists_oracle() + f""", {list_games_oracle('full')}, al AS (SELECT answer, concat('|', guess, ':', code) AS state FROM lg_t1 WHERE code <> {ALL_RIGHT}), s AS ({G.STATS_SQL.format(alive='al', fb='fba')}),
    r AS (SELECT state, guess, sumsq, isc, row_number() OVER (PARTITION BY state ORDER BY sumsq, guess) AS place FROM s) SELECT state, guess, sumsq, isc = 1 AS candidate, place FROM r WHERE isc = 1 OR place <= {POOL}""")
def tree_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guesses a search looks at: candidates, and the others that leave least."""
    _, _, _, fba = tables(spark, sf_dir)
    k = after_opener(spark, sf_dir).select("state", "answer").join(fba, "answer").groupBy("state", "guess", "code").agg(F.count("*").alias("k"))
    s = k.groupBy("state", "guess").agg(F.sum(F.col("k") * F.col("k")).alias("sumsq"), F.max(F.col("code") == ALL_RIGHT).alias("candidate"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("state").orderBy("sumsq", "guess")).cast("long")).where(F.col("candidate") | (F.col("place") <= POOL)).select("state", "guess", "sumsq", "candidate", "place")


def adaptive_oracle(states: str, left: int) -> str:
    """states: a query of state, word, isc. Sets of words are nodes; a node's value is the least of its guesses'."""
    key = lambda w, i: f"list_sort(list({w} || {i}))"
    parts = [f"st AS MATERIALIZED ({states}), n0 AS MATERIALIZED (SELECT state, {key('word', 'isc')} AS node FROM st GROUP BY state), d0 AS MATERIALIZED (SELECT DISTINCT node FROM n0)"]
    count = "len(list_filter({n}, lambda x: x[6] = '1'))"
    for d in range(left):
        parts.append(f"m{d} AS (SELECT node, unnest(node) AS w FROM d{d}), x{d} AS MATERIALIZED (SELECT a.node, a.w[1:5] AS guess, f.code, list_sort(list(b.w)) AS part FROM m{d} a JOIN m{d} b USING (node) JOIN fb f ON f.guess = a.w[1:5] AND f.answer = b.w[1:5] GROUP BY ALL)")
        parts.append(f"d{d + 1} AS MATERIALIZED (SELECT DISTINCT part AS node FROM x{d} WHERE code <> {ALL_RIGHT} AND {count.format(n='part')} > 1)")
    parts.append(f"v{left} AS (SELECT node, 7 * {count.format(n='node')} AS cost FROM d{left})")
    for d in range(left - 1, -1, -1):
        # a node of one candidate costs one guess if any is left
        child = f"CASE WHEN code = {ALL_RIGHT} THEN 0 WHEN {count.format(n='part')} = 0 THEN 0 WHEN {count.format(n='part')} = 1 THEN {1 if left - d - 1 > 0 else 7} ELSE v.cost END"
        parts.append(f"a{d} AS MATERIALIZED (SELECT x.node, guess, {count.format(n='x.node')} + sum({child}) AS cost FROM x{d} x LEFT JOIN v{d + 1} v ON v.node = x.part GROUP BY x.node, guess), v{d} AS MATERIALIZED (SELECT node, min(cost) AS cost FROM a{d} GROUP BY node)")
    return ", ".join(parts) + " SELECT n0.state, a0.guess, a0.cost::BIGINT AS cost, a0.cost = v0.cost AS optimal FROM n0 JOIN a0 USING (node) JOIN v0 USING (node)"


_SMALL = f"""SELECT concat('|', o.guess, ':', o.code) AS state, f.answer AS word, CASE WHEN f.answer IN (SELECT answer FROM answers) THEN 1 ELSE 0 END AS isc FROM (SELECT DISTINCT guess, code FROM lg_t1 WHERE code <> {ALL_RIGHT}) o
    JOIN fb f ON f.guess = o.guess AND f.code = o.code QUALIFY count(*) OVER (PARTITION BY o.code) BETWEEN 2 AND {LARGEST}"""


def small_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state, word, isc of the states after the opener that have 2 to LARGEST admissible words."""
    _, fb, answers, _ = tables(spark, sf_dir)
    moves = after_opener(spark, sf_dir).select("state", "code").distinct().crossJoin(F.broadcast(list_games(spark, sf_dir, "full").where("turn = 1").select("guess").distinct()))  # one opener
    words = moves.join(fb.withColumnRenamed("answer", "word"), ["guess", "code"]).join(answers.withColumnRenamed("answer", "word").withColumn("isc", F.lit(1)), "word", "left")
    n = F.count("*").over(Window.partitionBy("state"))
    return words.select("state", "word", F.coalesce("isc", F.lit(0)).alias("isc")).withColumn("n", n).where(F.col("n").between(2, LARGEST)).drop("n")


@query(f"{lists_oracle()}, {list_games_oracle('full')}, {adaptive_oracle(_SMALL, 5)}")
def exact_adaptive_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cost of every admissible action in states of few admissible words, five guesses left, 7 for a failure."""
    return adaptive_values(small_states(spark, sf_dir), 5)
