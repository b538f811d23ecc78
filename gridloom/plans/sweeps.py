"""Sweeps: all settings of a question played in one loop by candidate sets, and statistics over the packed table.

The oracles play the plain way: a state is a setting and a history, every state's candidates and admissible words are rows,
and nothing is shared between states. Only a chance draw needs the set's name there.
"""

from __future__ import annotations

from dataclasses import astuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.feedback import ALL_RIGHT
from gridloom.operators import packed
from gridloom.operators.loop import FAILED, TRACKED, Setting, play, set_key
from gridloom.plans import games as G
from gridloom.plans.lists import list_games, list_games_oracle, lists_oracle, word_lists
from gridloom.plans.queries import query
from gridloom.session import scratch_table

SEED = "20260817"
# Weights of the worst group, of what is left, and of a candidate's bonus, that the hybrid is swept over.
GRID = ((0.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.25, 0.25, 1.0), (0.5, 0.25, 1.0), (0.25, 0.5, 1.0), (0.1, 0.1, 1.0), (0.5, 0.5, 1.0), (1.0, 1.0, 1.0))
# Numbers of admissible words up to which play keeps to them; numbers of answers played.
THRESHOLDS, SIZES = (0, 2, 5, 10, 20), (100, 500, 1000)
SEEDS = ("s1", "s2", "s3")

COMPARED = [
    Setting("full"), Setting("adaptive_20", pool="adaptive", threshold=20), Setting("candidates", pool="candidates"), Setting("hard", pool="hard"), Setting("restricted", "expected", "restricted", 20),
    Setting("random_admissible", "chance", "hard", seed=SEED), Setting("random_restricted", "chance", "restricted", 20, seed=SEED),
]
HYBRIDS = [Setting(f"hybrid_{k}", "hybrid", lam=lam, nu=nu, mu=mu) for k, (lam, nu, mu) in enumerate(GRID)]
CONTROLS = [Setting(f"swept_{t}", "entropy", "restricted", t) for t in THRESHOLDS] + [Setting(f"chance_{t}_{s}", "chance", "restricted", t, seed=s) for t in THRESHOLDS for s in SEEDS]
SIZED = [Setting(f"{m}_{n}", m, games=n) for m in ("entropy", "expected") for n in SIZES]


def sweep(spark: SparkSession, sf_dir: str, name: str, settings: list[Setting]) -> DataFrame:
    return G.kept(spark, sf_dir, f"sweep-{name}", lambda: play(word_lists(spark, sf_dir), settings))


def sweep_oracle(settings: list[Setting]) -> str:
    """WITH items for DuckDB; `played` holds setting, answer, turn, guess, code, n_before, n_adm, wide, cset, state."""
    value = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else str(v)
    rows = ", ".join("(" + ", ".join(map(value, astuple(s))) + ")" for s in settings)
    parts = [
        f"st AS MATERIALIZED (SELECT * FROM (VALUES {rows}) t(setting, metric, pool, threshold, a, lam, nu, mu, seed, games))",
        "ids AS MATERIALIZED (SELECT answer, row_number() OVER (ORDER BY answer) - 1 AS aid, row_number() OVER (ORDER BY sha256('size|' || answer), answer) AS place FROM answers)",
        "g1 AS (SELECT setting, setting || '#' AS state, answer FROM st, ids WHERE games = 0 OR place <= games), c1 AS (SELECT setting || '#' AS state, answer FROM st, answers)",
        f"a1 AS (SELECT setting || '#' AS state, word AS guess FROM st, vocab WHERE pool IN {TRACKED})",
    ]
    for t in range(1, G.TURNS + 1):
        may = f"n > {G.ENDGAME} AND {t} < {G.TURNS}"
        parts += [
            f"k{t} AS (SELECT state, sha256(string_agg(CAST(aid AS VARCHAR), ',' ORDER BY aid)) AS cset FROM c{t} JOIN ids USING (answer) GROUP BY state), na{t} AS (SELECT state, count(*) AS n_adm FROM a{t} GROUP BY state)",
            f"x{t} AS (SELECT s.*, st.* EXCLUDE (games), w.guess IS NOT NULL AS adm, n_adm, cset FROM ({G.scored_stats(t, f'c{t}', 'fba')}) s JOIN st ON st.setting = split_part(s.state, '#', 1) JOIN k{t} USING (state) LEFT JOIN na{t} USING (state) LEFT JOIN a{t} w ON w.state = s.state AND w.guess = s.guess)",
            f"y{t} AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY guess) - 1 AS spot, count(*) OVER (PARTITION BY state) AS k FROM x{t} WHERE isc = 1 OR ({may} AND CASE pool WHEN 'full' THEN TRUE WHEN 'adaptive' THEN n > threshold WHEN 'hard' THEN adm WHEN 'restricted' THEN adm OR n_adm > threshold ELSE FALSE END))",
            f"""z{t} AS MATERIALIZED (SELECT *, {may} AND (pool = 'full' OR (pool = 'adaptive' AND n > threshold) OR (pool = 'restricted' AND n_adm > threshold)) AS wide FROM y{t} QUALIFY row_number() OVER (PARTITION BY state ORDER BY CASE metric WHEN 'entropy' THEN -round(h, 9) WHEN 'expected' THEN sumsq WHEN 'minimax' THEN worst
                WHEN 'hybrid' THEN -round(a * h - lam * log2(worst) - nu * log2(sumsq * 1.0e0 / n) + CASE WHEN isc = 1 THEN mu * log2(1 + 1.0e0 / n) ELSE 0 END, 9) ELSE CASE WHEN spot = CAST('0x' || substr(sha256(seed || '|' || cset), 1, 8) AS BIGINT) % k THEN 0 ELSE 1 END END, CASE WHEN metric IN ('hybrid', 'chance') THEN 0 ELSE -isc END, guess) = 1)""",
            f"p{t} AS MATERIALIZED (SELECT g.setting, g.answer, {t} AS turn, z.guess, f.code, z.n AS n_before, z.n_adm, coalesce(z.wide, FALSE) AS wide, z.cset, g.state FROM g{t} g JOIN z{t} z USING (state) JOIN fba f ON f.guess = z.guess AND f.answer = g.answer)",
            f"m{t} AS MATERIALIZED (SELECT DISTINCT state, guess, code, state || '|' || guess || ':' || code AS child FROM p{t} WHERE code <> {ALL_RIGHT}), g{t + 1} AS (SELECT setting, state || '|' || guess || ':' || code AS state, answer FROM p{t} WHERE code <> {ALL_RIGHT})",
            f"c{t + 1} AS MATERIALIZED (SELECT m.child AS state, c.answer FROM m{t} m JOIN c{t} c USING (state) JOIN fba f ON f.guess = m.guess AND f.answer = c.answer AND f.code = m.code), a{t + 1} AS MATERIALIZED (SELECT m.child AS state, w.guess FROM m{t} m JOIN a{t} w USING (state) JOIN fb f ON f.guess = m.guess AND f.answer = w.guess AND f.code = m.code)",
        ]
    return f"{lists_oracle()}, {', '.join(parts)}, played AS (" + " UNION ALL ".join(f"SELECT * FROM p{t}" for t in range(1, G.TURNS + 1)) + f"), scored AS (SELECT setting, answer, max(CASE WHEN turn = 1 THEN guess END) AS opener, CASE WHEN bool_or(code = {ALL_RIGHT}) THEN max(turn) ELSE {FAILED} END AS score FROM played GROUP BY ALL)"


def scores(played: DataFrame) -> DataFrame:
    """setting, answer, opener, score: turns of solved games, 7 for others."""
    won = F.max(F.when(F.col("code") == ALL_RIGHT, 1)) == 1
    return played.groupBy("setting", "answer").agg(F.max(F.when(F.col("turn") == 1, F.col("guess"))).alias("opener"), F.when(won, F.max("turn")).otherwise(FAILED).cast("long").alias("score"))


def share(limit: int) -> Column:
    return F.round(F.lit(100.0) * F.count_if(F.col("score") <= limit) / F.count("*"), 6).alias(f"within_{limit}")


# -- policies side by side ------------------------------------------------------------------------------------------


@query(f"""{sweep_oracle(COMPARED)} SELECT setting AS policy, count(*) AS games, round(avg(score), 6) AS mean, median(score) AS median, round(stddev_samp(score), 6) AS std, min(score)::BIGINT AS best, max(score)::BIGINT AS worst, count(*) FILTER (WHERE score = 7) AS failed,
    {", ".join(f"round(100.0 * count(*) FILTER (WHERE score <= {k}) / count(*), 6) AS within_{k}" for k in (3, 4, 5, 6))}, sum(score)::BIGINT AS total FROM scored GROUP BY setting""")
def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, spread and cumulative shares of games won, for each policy over two lists."""
    s = F.col("score")
    return scores(sweep(spark, sf_dir, "compared", COMPARED)).groupBy(F.col("setting").alias("policy")).agg(F.count("*").alias("games"), F.round(F.avg(s), 6).alias("mean"), F.median(s).alias("median"), F.round(F.stddev_samp(s), 6).alias("std"), F.min(s).alias("best"), F.max(s).alias("worst"), F.count_if(s == FAILED).alias("failed"), *map(share, (3, 4, 5, 6)), F.sum(s).alias("total"))


@query(f"{sweep_oracle(COMPARED)}, o AS (SELECT answer, min(score) AS least FROM scored GROUP BY answer) SELECT setting AS policy, sum(score - least)::BIGINT AS over_best, round(avg(score - least), 6) AS gap, count(*) FILTER (WHERE score = least) AS at_best FROM scored JOIN o USING (answer) GROUP BY setting")
def policy_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All policies in one table against the best that any of them did for an answer."""
    gap = F.col("score") - F.min("score").over(Window.partitionBy("answer"))
    return scores(sweep(spark, sf_dir, "compared", COMPARED)).withColumn("gap", gap).groupBy(F.col("setting").alias("policy")).agg(F.sum("gap").alias("over_best"), F.round(F.avg("gap"), 6).alias("gap"), F.count_if(F.col("gap") == 0).alias("at_best"))


# -- weights, thresholds, sizes --------------------------------------------------------------------------------------


@query(f"""{sweep_oracle(HYBRIDS)} SELECT lam, nu, mu, max(opener) AS opener, count(*) AS games, round(avg(score), 6) AS mean, max(score)::BIGINT AS worst, round(100.0 * count(*) FILTER (WHERE score <= 3) / count(*), 6) AS within_3, round(100.0 * count(*) FILTER (WHERE score <= 4) / count(*), 6) AS within_4, count(*) FILTER (WHERE score = 7) AS failed
    FROM scored JOIN (SELECT setting, lam::DOUBLE AS lam, nu::DOUBLE AS nu, mu::DOUBLE AS mu FROM st) w USING (setting) GROUP BY lam, nu, mu""")
def hybrid_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All games under each of eight weightings of the hybrid metric."""
    weights = spark.createDataFrame([(s.setting, s.lam, s.nu, s.mu) for s in HYBRIDS], "setting string, lam double, nu double, mu double")
    each = scores(sweep(spark, sf_dir, "hybrids", HYBRIDS)).join(F.broadcast(weights), "setting")
    return each.groupBy("lam", "nu", "mu").agg(F.max("opener").alias("opener"), F.count("*").alias("games"), F.round(F.avg("score"), 6).alias("mean"), F.max("score").alias("worst"), share(3), share(4), F.count_if(F.col("score") == FAILED).alias("failed"))


@query(f"""{sweep_oracle(CONTROLS)}, m AS (SELECT setting, avg(score) AS mean FROM scored GROUP BY setting), c AS (SELECT CAST(split_part(setting, '_', 2) AS INT) AS threshold, avg(mean) AS control_mean, stddev_samp(mean) AS control_std FROM m WHERE setting LIKE 'chance%' GROUP BY 1)
    SELECT threshold, round(mean, 6) AS mean, round(control_mean, 6) AS control_mean, round(control_std, 6) AS control_std, round(control_mean - mean, 6) AS gain FROM c JOIN m ON setting = 'swept_' || threshold""")
def threshold_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by threshold against random play in the same action space: mean and spread over draws."""
    m = scores(sweep(spark, sf_dir, "controls", CONTROLS)).groupBy("setting").agg(F.avg("score").alias("mean"))
    t = F.split_part("setting", F.lit("_"), F.lit(2)).cast("int").alias("threshold")
    control = m.where("setting LIKE 'chance%'").groupBy(t).agg(F.avg("mean").alias("c"), F.stddev_samp("mean").alias("s"))
    return m.where("setting LIKE 'swept%'").select(t, "mean").join(control, "threshold").select("threshold", F.round("mean", 6).alias("mean"), F.round("c", 6).alias("control_mean"), F.round("s", 6).alias("control_std"), F.round(F.col("c") - F.col("mean"), 6).alias("gain"))


@query(f"{sweep_oracle(SIZED)} SELECT setting, count(*) AS games, round(avg(score), 6) AS mean, max(score)::BIGINT AS worst, count(*) FILTER (WHERE score = 7) AS failed FROM scored GROUP BY setting")
def size_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over drawn answers, more and more of them; all answers stay possible."""
    return scores(sweep(spark, sf_dir, "sized", SIZED)).groupBy("setting").agg(F.count("*").alias("games"), F.round(F.avg("score"), 6).alias("mean"), F.max("score").alias("worst"), F.count_if(F.col("score") == FAILED).alias("failed"))


@query(f"{sweep_oracle(COMPARED + HYBRIDS)}, l AS (SELECT count(*) AS words FROM vocab), h AS (SELECT turn, sum(n) AS apart FROM (SELECT DISTINCT turn, state, n_before AS n FROM played WHERE wide) GROUP BY turn), s AS (SELECT turn, sum(n) AS once FROM (SELECT DISTINCT p.turn, cset, n_before AS n FROM played p JOIN st USING (setting) WHERE wide AND metric <> 'chance') GROUP BY turn)\n    SELECT turn, count(*) AS games, count(DISTINCT state) AS histories, count(DISTINCT cset) AS sets, (coalesce(any_value(apart), 0) * any_value(words))::BIGINT AS cells_by_history, (coalesce(any_value(once), 0) * any_value(words))::BIGINT AS cells_by_set FROM played LEFT JOIN h USING (turn) LEFT JOIN s USING (turn), l GROUP BY turn")
def decision_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By turn: games, states by setting and history, the distinct sets that decisions were taken for, and cells of the
    feedback table counted for them, against those that each history would count by itself."""
    settings = COMPARED + HYBRIDS
    played = sweep(spark, sf_dir, "cache", settings)
    words = len(word_lists(spark, sf_dir).words)
    chance = F.col("setting").isin(*[s.setting for s in settings if s.metric == "chance"])
    by = played.groupBy("turn").agg(F.count("*").alias("games"), F.countDistinct("setting", "history").alias("histories"), F.countDistinct("cset").alias("sets"))
    apart = played.where("wide").select("turn", "setting", "history", "n_before").distinct().groupBy("turn").agg(F.sum("n_before").alias("apart"))
    once = played.where(F.col("wide") & ~chance).select("turn", "cset", "n_before").distinct().groupBy("turn").agg(F.sum("n_before").alias("once"))
    cells = lambda c: (F.coalesce(F.col(c), F.lit(0)) * words).cast("long")
    return by.join(apart, "turn", "left").join(once, "turn", "left").select("turn", "games", "histories", "sets", cells("apart").alias("cells_by_history"), cells("once").alias("cells_by_set"))


# -- the packed table ------------------------------------------------------------------------------------------------


@query(lists_oracle() + " SELECT guess, count(*) AS cells, sha256(string_agg(printf('%02X', code), '' ORDER BY answer)) AS digest FROM fba GROUP BY guess")
def packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of bytes a guess: how many, and their digest."""
    return word_lists(spark, sf_dir).packed.select("guess", F.octet_length("cells").cast("long").alias("cells"), F.sha2(F.hex("cells"), 256).alias("digest"))


@query(f"""{lists_oracle()}, {list_games_oracle('full')}, ids AS (SELECT answer, row_number() OVER (ORDER BY answer) - 1 AS aid FROM answers), al AS (SELECT answer, state FROM lg WHERE turn <= 3), k AS (SELECT state, sha256(string_agg(CAST(aid AS VARCHAR), ',' ORDER BY aid)) AS cset FROM al JOIN ids USING (answer) GROUP BY state)
    SELECT cset, guess, max(sumsq) AS sumsq, max(worst) AS worst, max(n) AS n, round(max(h), 6) AS entropy, max(isc) AS isc FROM ({G.STATS_SQL.format(alive='al', fb='fba')}) s JOIN k USING (state) GROUP BY cset, guess""")
def packed_partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every guess for the sets that games by entropy pass in three turns, off the packed table."""
    lists = word_lists(spark, sf_dir)
    g = list_games(spark, sf_dir, "full").where("turn <= 3").join(F.broadcast(lists.targets), "answer")
    sets = g.groupBy("state").agg(F.array_sort(F.collect_list("aid")).alias("members")).select(set_key(F.col("members")).alias("cset"), "members").distinct()
    stats = packed.partition_statistics(lists.packed, scratch_table(sets, "sets"))
    return stats.select("cset", "guess", "sumsq", "worst", "n", F.round("h", 6).alias("entropy"), "isc")
