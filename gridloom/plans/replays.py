"""Stored policies replayed by joins alone, and choices by token scores summed along a trie of the legal words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.feedback import ALL_RIGHT
from gridloom.operators.loop import Lists, hash_number, with_code
from gridloom.plans import games as G
from gridloom.plans.lists import list_games, list_games_oracle, lists_oracle, parsed, word_lists
from gridloom.plans.queries import query
from gridloom.session import scratch_table

# -- policies as relations --------------------------------------------------------------------------------------------


def policy_of(games: DataFrame) -> DataFrame:
    """games: state, guess -> state, guess: what to do where; raises if a state has two moves."""
    policy = games.select("state", "guess").distinct()
    if not policy.groupBy("state").count().where("count > 1").isEmpty():
        raise ValueError("a state has two moves")
    return policy


def replay(lists: Lists, policy: DataFrame, turns: int = G.TURNS) -> DataFrame:
    """All answers played by the policy alone: answer, turn, state, guess, code; a game that meets a state without a move
    stops there, its guess and code null."""
    games, out = lists.targets.select("answer", F.lit("").alias("state")), None
    for turn in range(1, turns + 1):
        moved = games.join(policy, "state", "left")
        played = scratch_table(with_code(moved, "guess", "answer").select("answer", F.lit(turn).alias("turn"), "state", "guess", F.when(F.col("guess").isNotNull(), F.col("code")).alias("code")), "replay")
        out = played if out is None else out.unionByName(played)
        games = played.where(F.col("code") != ALL_RIGHT).select("answer", F.concat("state", F.lit("|"), "guess", F.lit(":"), F.col("code").cast("string")).alias("state"))
    return out


def holed(policy: DataFrame) -> DataFrame:
    """The policy without the moves of later states whose hash begins with 3 or 7."""
    first = F.substring(F.sha2(F.concat(F.lit("hole|"), "state"), 256), 1, 1)
    return policy.where((F.col("state") == "") | ~first.isin("3", "7"))


def replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tab (clean, holed), and the rows of `replay`."""

    def make() -> DataFrame:
        lists, policy = word_lists(spark, sf_dir), scratch_table(policy_of(list_games(spark, sf_dir, "full")), "policy")
        return replay(lists, policy).withColumn("tab", F.lit("clean")).unionByName(replay(lists, holed(policy)).withColumn("tab", F.lit("holed")))

    return G.kept(spark, sf_dir, "replays", make)


_HOLED = f"""{lists_oracle()}, {list_games_oracle('full')}, b AS (SELECT *, state <> '' AND substr(sha256('hole|' || state), 1, 1) IN ('3', '7') AS gap FROM lg), s AS (SELECT answer, min(turn) AS turn FROM b WHERE gap GROUP BY answer),
    g AS (SELECT 'clean' AS tab, answer, turn, state, code FROM lg UNION ALL SELECT 'holed', b.answer, b.turn, b.state, CASE WHEN b.turn = s.turn THEN NULL ELSE code END FROM b LEFT JOIN s USING (answer) WHERE s.turn IS NULL OR b.turn <= s.turn)"""


@query(f"{_HOLED}, e AS (SELECT tab, answer, max(turn) AS turns, bool_or(code = {ALL_RIGHT}) AS won, bool_or(code IS NULL) AS stopped FROM g GROUP BY ALL) SELECT tab, count(*) AS games, count(*) FILTER (WHERE won) AS solved, count(*) FILTER (WHERE stopped) AS stopped, sum(CASE WHEN won THEN turns ELSE 7 END)::BIGINT AS total FROM e GROUP BY tab")
def policy_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stored policy does by itself, whole and with moves taken out of it."""
    e = replays(spark, sf_dir).groupBy("tab", "answer").agg(F.max("turn").alias("turns"), F.coalesce(F.max(F.col("code") == ALL_RIGHT), F.lit(False)).alias("won"), F.max(F.col("guess").isNull()).alias("stopped"))
    return e.groupBy("tab").agg(F.count("*").alias("games"), F.count_if("won").alias("solved"), F.count_if("stopped").alias("stopped"), F.sum(F.when(F.col("won"), F.col("turns")).otherwise(G.FAILED)).alias("total"))


@query(f"{_HOLED} SELECT tab, state, turn, count(*) AS games FROM g WHERE code IS NULL GROUP BY ALL")
def policy_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that a policy has no move for, though its games reach them; none in a whole policy."""
    return replays(spark, sf_dir).where("guess IS NULL").groupBy("tab", "state", "turn").agg(F.count("*").alias("games"))


# -- words as paths of tokens ----------------------------------------------------------------------------------------

#: Where a word is cut into tokens; each path ends with the end token.
CUTS, END = ((1, 2), (3, 2), (5, 1)), "</s>"


def trie(words: DataFrame) -> DataFrame:
    """words: word -> depth, node (the letters so far), token, child: every prefix once, whatever words share it."""
    steps = [F.struct(F.lit(k).alias("depth"), F.substring("word", 1, at - 1).alias("node"), F.substring("word", at, n).alias("token"), F.substring("word", 1, at + n - 1).alias("child")) for k, (at, n) in enumerate(CUTS)]
    end = F.struct(F.lit(len(CUTS)).alias("depth"), F.col("word").alias("node"), F.lit(END).alias("token"), F.concat("word", F.lit(END)).alias("child"))
    return words.select(F.explode(F.array(*steps, end)).alias("x")).select("x.*").distinct()


def log_probability(state: Column, node: Column, token: Column) -> Column:
    """A stand-in for a model's: of a token after a state's prompt and what has been written; never above 0."""
    return F.log((hash_number(F.lit("lp"), state, node, token) + 1) / F.lit(4294967296.0))


_LP = "ln((CAST('0x' || substr(sha256('lp|' || {s} || '|' || {n} || '|' || {t}), 1, 8) AS BIGINT) + 1) / 4294967296.0e0)"


def along(scores: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """scores: state, node, score -> the same of the children: each prefix's token is scored once for all words behind it."""
    step = edges.where(F.col("depth") == depth).select("node", "token", "child")
    return scores.join(step, "node").select("state", F.col("child").alias("node"), (F.col("score") + log_probability(F.col("state"), F.col("node"), F.col("token"))).alias("score"), *[c for c in scores.columns if c not in ("state", "node", "score")])


def first_tokens(states: DataFrame, edges: DataFrame) -> DataFrame:
    """state, node, score, first: the opening tokens of a state; a word's score is never above its first token's."""
    start = states.select("state", F.lit("").alias("node"), F.lit(0.0).alias("score"))
    return along(start, edges, 0).withColumn("first", F.col("node"))


def completed(firsts: DataFrame, edges: DataFrame) -> DataFrame:
    """Words behind first tokens, with their scores: state, word, score, and what else firsts has."""
    level = firsts
    for depth in range(1, len(CUTS) + 1):
        level = along(level, edges, depth)
    return level.withColumn("word", F.substring("node", 1, 5)).drop("node")


def opened(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """States of third turns, the trie of the legal words, and what each state has played already."""
    states = list_games(spark, sf_dir, "full").where("turn = 3").select("state").distinct()
    edges = scratch_table(trie(G.table(spark, sf_dir, "vocab").select("word")), "trie")
    return states, edges, parsed(states).select("state", F.col("guess").alias("word")).distinct()


_TRIE = f"""{lists_oracle()}, {list_games_oracle('full')}, st AS (SELECT DISTINCT state FROM lg WHERE turn = 3), used AS (SELECT DISTINCT state, split_part(p, ':', 1) AS word FROM (SELECT state, unnest(string_split(substr(state, 2), '|')) AS p FROM st)),
    sc AS MATERIALIZED (SELECT s.state, v.word, {" + ".join([*(_LP.format(s='s.state', n=f"substr(v.word, 1, {at - 1})", t=f"substr(v.word, {at}, {n})") for at, n in CUTS), _LP.format(s='s.state', n='v.word', t=f"'{END}'")])} AS score, {_LP.format(s='s.state', n="''", t='substr(v.word, 1, 2)')} AS bound FROM st s, vocab v)"""


@query(f"{_TRIE} SELECT state, count(*) AS words, round(max(score), 6) AS best, round(avg(score), 6) AS mean, count(*) FILTER (WHERE score <= bound) AS bounded, (count(*) * {len(CUTS) + 1})::BIGINT AS tokens, (count(DISTINCT substr(word, 1, 2)) + count(DISTINCT substr(word, 1, 4)) + 2 * count(*))::BIGINT AS scored FROM sc GROUP BY state")
def trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All legal words' scores by state, summed along the trie; tokens scored against those of words one by one."""
    states, edges, _ = opened(spark, sf_dir)
    firsts = first_tokens(states, edges)
    words = completed(firsts.withColumn("bound", F.col("score")), edges)
    by = words.groupBy("state").agg(F.count("*").alias("words"), F.round(F.max("score"), 6).alias("best"), F.round(F.avg("score"), 6).alias("mean"), F.count_if(F.col("score") <= F.col("bound")).alias("bounded"))
    nodes = edges.agg(F.count("*").alias("scored"))
    return by.crossJoin(F.broadcast(nodes)).select("*", (F.col("words") * (len(CUTS) + 1)).alias("tokens"))  # one row beside them


@query(f"""{_TRIE}, al AS (SELECT s.* FROM sc s ANTI JOIN used u ON u.state = s.state AND u.word = s.word), b AS (SELECT state, substr(word, 1, 2) AS first, max(bound) AS bound, max(score) AS top FROM al GROUP BY ALL), p AS (SELECT state, arg_max(top, (round(bound, 9), first)) AS sure FROM b GROUP BY state)
    SELECT c.state, c.word, round(c.score, 6) AS score, o.opened, o.firsts FROM (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY state ORDER BY round(score, 9) DESC, word) = 1) c JOIN (SELECT state, count(*) AS firsts, count(*) FILTER (WHERE round(bound, 9) >= round(sure, 9)) AS opened FROM b JOIN p USING (state) GROUP BY state) o USING (state)""")
def pruned_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best word that a state hasn't played, in two phases: the first token of the highest score is opened, then those
    alone whose own score isn't below the best word found; how many were opened of how many."""
    states, edges, used = opened(spark, sf_dir)
    alive = G.table(spark, sf_dir, "vocab").select("word", F.substring("word", 1, 2).alias("first"))
    gone = used.join(alive, "word").groupBy("state", "first").agg(F.count("*").alias("gone"))
    size = alive.groupBy("first").agg(F.count("*").alias("words"))
    firsts = first_tokens(states, edges).join(size, "first").join(gone, ["state", "first"], "left").where(F.col("words") > F.coalesce("gone", F.lit(0))).select("state", "node", "score", "first")
    firsts = scratch_table(firsts, "firsts")
    top = F.row_number().over(Window.partitionBy("state").orderBy(F.desc(F.round("score", 9)), F.desc("first")))
    ranked = firsts.withColumn("place", top)
    some = completed(ranked.where("place = 1").drop("place"), edges)
    sure = some.join(used, ["state", "word"], "left_anti").groupBy("state").agg(F.max("score").alias("sure"))
    open_ = scratch_table(firsts.join(sure, "state").where(F.round("score", 9) >= F.round("sure", 9)).drop("sure"), "opened")
    words = completed(open_, edges)
    order = Window.partitionBy("state").orderBy(F.desc(F.round("score", 9)), "word")
    best = words.join(used, ["state", "word"], "left_anti").withColumn("rn", F.row_number().over(order)).where("rn = 1")
    counts = firsts.groupBy("state").agg(F.count("*").alias("firsts")).join(open_.groupBy("state").agg(F.count("*").alias("opened")), "state")
    return best.join(counts, "state").select("state", "word", F.round("score", 6).alias("score"), "opened", "firsts")
