"""Decision rules as ORDER BY lists, and all games played at once, turn by turn.

A state is a history; every game in it gets the same guess, so a turn is two aggregates, a ranking and a join over
all states together. The turn's SQL is the same text for Spark and for the DuckDB oracle but for the hash's name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.feedback import ALL_RIGHT, feedback_code, letters
from gridloom.session import read_table, scratch_table
from gridloom.sources.words import vocabulary

TURNS, FAILED, ENDGAME = 6, 7, 2
#: The legal words: those that most documents hold, so many at most. All pairs of them are made, 16 bytes each.
MOST_WORDS = 20_000
#: ORDER BY within a state; isc: the guess can be the answer.
RULES = {
    "entropy": "round(h, 9) DESC, isc DESC, guess",
    "expected": "sumsq, isc DESC, guess",
    "minimax": "worst, isc DESC, guess",
    "hybrid": "round(h - 0.25e0 * log2(worst) - 0.25e0 * log2(1.0e0 * sumsq / n) + CASE WHEN isc = 1 THEN log2(1 + 1.0e0 / n) ELSE 0 END, 9) DESC, guess",
    "frequency": "fscore DESC, guess",
    "random": "{sha}(concat('20260817|', state, '|', guess){bits}), guess",
    # the candidates alone once few are left
    "adaptive_20": "CASE WHEN n <= 20 THEN -isc ELSE 0 END, round(h, 9) DESC, isc DESC, guess",
    "adaptive_100": "CASE WHEN n <= 100 THEN -isc ELSE 0 END, round(h, 9) DESC, isc DESC, guess",
    # an expert acts in wide states, chance among candidates elsewhere
    "expert_above_10": "CASE WHEN n > 10 THEN -round(h, 9) ELSE -isc END, {sha}(concat('20260817|', state, '|', guess){bits}), guess",
    # rollouts: a candidate in 0.55 of states (8c.. of a hash in hex), else any word
    "rollout_endgame": "CASE WHEN {sha}(concat('cand|', state){bits}) < '8ccccccc' THEN -isc ELSE 0 END, {sha}(concat('20260817|', state, '|', guess){bits}), guess",
    # rollouts: the expert in 0.7 of second turns; a candidate where at most 20 are left, and in 0.9 of other states
    "rollout_mixed": "CASE WHEN turn_no = 2 AND {sha}(concat('expert|', state){bits}) < 'b3333333' THEN -round(h, 9) WHEN n <= 20 OR {sha}(concat('cand|', state){bits}) < 'e6666666' THEN -isc ELSE 0 END, {sha}(concat('20260821|', state, '|', guess){bits}), guess",
}
TIEBREAKS = {"A": "round(h, 9) DESC, isc DESC, guess", "B": "round(h, 9) DESC, guess", "C": "round(h, 9) DESC, isc DESC, guess DESC", "D": "round(h, 9) DESC, isc DESC, sumsq, guess"}
CANDIDATES_ONLY = ("frequency", "random")

PAIRS_SQL = f"SELECT w.word AS guess, v.word AS answer, CAST({feedback_code()} AS INT) AS code FROM (SELECT word, {letters('word', 'g')} FROM vocab) w CROSS JOIN (SELECT word, {letters('word', 'a')} FROM vocab) v"
PRESENCE_SQL = "SELECT letter, count(*) * 1.0e0 / (SELECT count(*) FROM vocab) AS p FROM (" + " UNION ".join(f"SELECT word, substr(word, {i}, 1) AS letter FROM vocab" for i in range(1, 6)) + ") GROUP BY letter"
PLACE_SQL = "SELECT place, letter, count(*) * 1.0e0 / (SELECT count(*) FROM vocab) AS p FROM (" + " UNION ALL ".join(f"SELECT {i} AS place, substr(word, {i}, 1) AS letter FROM vocab" for i in range(1, 6)) + ") GROUP BY place, letter"
SCORE_SQL = f"""SELECT l.word AS guess, round(max(s) + 0.5e0 * max(t), 9) AS fscore FROM (
    SELECT x.word, sum(p) AS s FROM ({" UNION ".join(f"SELECT word, substr(word, {i}, 1) AS letter FROM vocab" for i in range(1, 6))}) x JOIN ({PRESENCE_SQL}) q ON q.letter = x.letter GROUP BY x.word) l
    JOIN (SELECT x.word, sum(p) AS t FROM ({" UNION ALL ".join(f"SELECT word, {i} AS place, substr(word, {i}, 1) AS letter FROM vocab" for i in range(1, 6))}) x JOIN ({PLACE_SQL}) q ON q.letter = x.letter AND q.place = x.place GROUP BY x.word) m ON m.word = l.word GROUP BY l.word"""
STATS_SQL = f"""SELECT state, guess, CAST(sum(k * k) AS BIGINT) AS sumsq, max(k) AS worst, CAST(sum(k) AS BIGINT) AS n, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS h, max(CASE WHEN code = {ALL_RIGHT} THEN 1 ELSE 0 END) AS isc
    FROM (SELECT al.state, f.guess, f.code, count(*) AS k FROM {{alive}} al JOIN {{fb}} f ON f.answer = al.answer GROUP BY al.state, f.guess, f.code) b GROUP BY state, guess"""


#: The same over given rows of state, guess and code.
STATS_OF = STATS_SQL.replace("FROM {alive} al JOIN {fb} f ON f.answer = al.answer GROUP BY al.state, f.guess, f.code", "FROM ({pairs}) p GROUP BY state, guess, code").replace("al.state, f.guess, f.code", "state, guess, code")


def scored_stats(turn: int, alive: str, fb: str, wide: bool = True) -> str:
    """Statistics of what a turn has to score: every guess where it may be made, else the candidates alone.

    The two are aggregated apart, so that where the table of pairs is partitioned by guess, nothing of the first moves.
    Only the first reads that table; codes of few pairs are computed.
    """
    sized = f"(SELECT answer, state, count(*) OVER (PARTITION BY state) AS n_alive FROM {alive})"
    own = f"SELECT state, guess, CAST({feedback_code()} AS INT) AS code FROM (SELECT w.state, c.answer AS guess, {letters('c.answer', 'g')}, {letters('w.answer', 'a')} FROM {sized} w JOIN {alive} c ON c.state = w.state{{few}}) o"
    if not wide or turn >= TURNS:
        return STATS_OF.format(pairs=own.format(few=""))
    every = f"SELECT w.state, f.guess, f.code FROM {sized} w JOIN {fb} f ON f.answer = w.answer WHERE w.n_alive > {ENDGAME}"
    return STATS_OF.format(pairs=every) + " UNION ALL " + STATS_OF.format(pairs=own.format(few=f" WHERE w.n_alive <= {ENDGAME}"))


def played_sql(turn: int, alive: str, choice: str, *more: str) -> str:
    """Every running game with its state's choice (state, guess, n and more columns) and the feedback to it."""
    named = "".join(f", {c}" for c in more)
    each = f"SELECT al.answer, c.guess, c.n AS n_before, al.state{''.join(f', c.{c}' for c in more)}, {letters('c.guess', 'g')}, {letters('al.answer', 'a')} FROM {alive} al JOIN ({choice}) c ON c.state = al.state"
    return f"SELECT answer, {turn} AS turn, guess, CAST({feedback_code()} AS INT) AS code, n_before{named}, state FROM ({each}) y"


def turn_sql(turn: int, rule: str, alive: str, fb: str = "fb", scores: str = "fscores", spark: bool = True) -> str:
    """answer, turn, guess, code, n_before, state of every game still running."""
    order = {**RULES, **{f"tie{k}": v for k, v in TIEBREAKS.items()}}[rule].format(sha="sha2" if spark else "sha256", bits=", 256" if spark else "")
    pool = "isc = 1" if rule in CANDIDATES_ONLY else f"isc = 1 OR (n > {ENDGAME} AND {turn} < {TURNS})"
    stats = scored_stats(turn, alive, fb, rule not in CANDIDATES_ONLY)
    if rule == "frequency":
        stats = f"SELECT s.*, fs.fscore FROM ({stats}) s JOIN {scores} fs ON fs.guess = s.guess"
    order = order.replace("turn_no", str(turn))
    choice = f"SELECT state, guess, n FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY {order}) AS rn FROM ({stats}) t WHERE {pool}) u WHERE rn = 1"
    return played_sql(turn, alive, choice)


def next_sql(played: str) -> str:
    return f"SELECT answer, concat(state, '|', guess, ':', CAST(code AS VARCHAR(9))) AS state FROM {played} WHERE code <> {ALL_RIGHT}"


_kept: dict[tuple[str, str, str], DataFrame] = {}


def stamp(spark: SparkSession, path: str) -> str:
    """Sizes and times of a table's files: another state of the data has another stamp."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in fs.listStatus(at)))


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from a folder's documents, made once a session for each state of them."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} {stamp(spark, f'{sf_dir}/documents.parquet')}", name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Drops what `kept` holds, so that a query's time has all of its work in it."""
    _kept.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """vocab, fb or fscores of a folder, registered under its name."""

    def make() -> DataFrame:
        if name == "vocab":
            return scratch_table(vocabulary(read_table(spark, sf_dir, "documents")).orderBy(F.desc("documents"), "word").limit(MOST_WORDS), name)
        table(spark, sf_dir, "vocab")
        return scratch_table(spark.sql(PAIRS_SQL if name == "fb" else SCORE_SQL), name)

    out = kept(spark, sf_dir, name, make)
    out.createOrReplaceTempView(name)
    return out


def all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every five-letter word of the documents, rare ones too, registered as words_all: what needs no pairs needs no bound."""
    out = kept(spark, sf_dir, "words_all", lambda: scratch_table(vocabulary(read_table(spark, sf_dir, "documents")), "words_all"))
    out.createOrReplaceTempView("words_all")
    return out


def games(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    """answer, turn, guess, code, n_before, state: all games under a rule."""

    def make() -> DataFrame:
        for name in ("vocab", "fb", "fscores"):
            table(spark, sf_dir, name)
        spark.sql("SELECT word AS answer, '' AS state FROM vocab").createOrReplaceTempView("alive")
        out = None
        for turn in range(1, TURNS + 1):
            played = scratch_table(spark.sql(turn_sql(turn, rule, "alive")), "turn")
            out = played if out is None else out.unionByName(played)
            played.createOrReplaceTempView("played")
            spark.sql(next_sql("played")).createOrReplaceTempView("alive")
        return out

    return kept(spark, sf_dir, f"games-{rule}", make)


VOCAB_ORACLE = r"vocab AS MATERIALIZED (SELECT word, count(*) AS uses, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS word FROM documents) WHERE regexp_matches(word, '^[a-z]{5}$') GROUP BY word ORDER BY documents DESC, word LIMIT 20000)"

ALL_WORDS_ORACLE = VOCAB_ORACLE.replace(" ORDER BY documents DESC, word LIMIT 20000", "").replace("vocab AS", "words_all AS")


def games_oracle(rule: str, name: str = "games") -> str:
    """WITH items of the same loop for DuckDB, without WITH; `name` holds the games."""
    x = name
    parts = [f"{x}_alive1 AS (SELECT word AS answer, '' AS state FROM vocab)"]
    for t in range(1, TURNS + 1):
        parts.append(f"{x}_t{t} AS MATERIALIZED ({turn_sql(t, rule, f'{x}_alive{t}', spark=False)})")
        parts.append(f"{x}_alive{t + 1} AS ({next_sql(f'{x}_t{t}')})")
    return ", ".join(parts) + f", {x} AS (" + " UNION ALL ".join(f"SELECT * FROM {x}_t{t}" for t in range(1, TURNS + 1)) + ")"


def base_oracle() -> str:
    return f"WITH {VOCAB_ORACLE}, fb AS MATERIALIZED ({PAIRS_SQL}), fscores AS MATERIALIZED ({SCORE_SQL})"
