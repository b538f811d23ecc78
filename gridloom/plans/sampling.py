"""States sampled by rollouts: what they visit, quotas for each answer, and quotas for buckets with caps and no state twice."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.feedback import ALL_RIGHT
from gridloom.functions.hashing import split_of
from gridloom.operators import packed
from gridloom.operators.loop import hash_number, set_key
from gridloom.operators.rollouts import Rollout, accepted, rollouts
from gridloom.operators.tree import adaptive_values
from gridloom.plans import games as G
from gridloom.plans.lists import adaptive_oracle, consistent_words, list_games, list_games_oracle, lists_oracle, parsed, word_lists
from gridloom.plans.queries import SPLIT, query
from gridloom.plans.records import band, band_sql
from gridloom.session import scratch_table

# Shares of a candidate in sampled endgames, and how many states of one, two and three candidates, and of
# more, an answer gives.
ENDGAMES = Rollout("endgame", expert=0.0, candidate=0.55, admissible=0.0, restricted=0)
PER_ANSWER = {"1": 3, "2": 1, "3": 1, "4-10": 1}
MIXED = Rollout("mixed")
DRAWS, ANSWER_CAP = 12, 3
QUOTAS = {"2-3": 40, "4-10": 60, "11-30": 40, "31-100": 30, "101-300": 20}


def opener(spark: SparkSession, sf_dir: str) -> str:
    """The first move of games by entropy."""
    return list_games(spark, sf_dir, "full").where("turn = 1").select("guess").first()[0]


def sampled(spark: SparkSession, sf_dir: str, name: str, policy: Rollout) -> DataFrame:
    """Rollouts of training answers."""

    def make() -> DataFrame:
        lists = word_lists(spark, sf_dir)
        answers = lists.targets.select("answer").where(split_of(F.col("answer")) == "train")
        return rollouts(lists, answers, DRAWS, opener(spark, sf_dir), policy)

    return G.kept(spark, sf_dir, f"rollouts-{name}", make)


def rollouts_oracle(policy: Rollout) -> str:
    """WITH items for DuckDB: visits (answer, draw, turn, n, n_adm, state), a state known by the way to it."""
    number = lambda kind, t: f"CAST('0x' || substr(sha256('{kind}|{policy.seed}|' || answer || '|' || draw || '|{t}'), 1, 8) AS BIGINT)"
    parts = [
        f"r1 AS (SELECT answer, draw, '' AS state FROM answers, (SELECT unnest(range({DRAWS})) AS draw) WHERE {SPLIT.format(k='answer')} = 'train'), c1 AS (SELECT '' AS state, answer FROM answers), a1 AS (SELECT '' AS state, word AS guess FROM vocab)",
        "legal AS MATERIALIZED (SELECT word, row_number() OVER (ORDER BY word) - 1 AS spot, count(*) OVER () AS k FROM vocab)",
    ]
    for t in range(1, policy.turns + 1):
        if t == 1:
            parts.append("m1 AS (SELECT r.*, o.guess FROM r1 r, (SELECT any_value(guess) AS guess FROM lg_t1) o)")
        else:
            parts += [
                f"nc{t} AS MATERIALIZED (SELECT state, answer, row_number() OVER (PARTITION BY state ORDER BY answer) - 1 AS spot, count(*) OVER (PARTITION BY state) AS n FROM c{t}), na{t} AS MATERIALIZED (SELECT state, guess, row_number() OVER (PARTITION BY state ORDER BY guess) - 1 AS spot, count(*) OVER (PARTITION BY state) AS k FROM a{t})",
                f"u{t} AS MATERIALIZED (SELECT r.*, {number('kind', t)} / 4294967296.0e0 AS kind, {number('pick', t)} AS pick, {number('expert', t)} / 4294967296.0e0 < {policy.expert}e0 AND {t} = 2 AS by_expert, (SELECT count(*) FROM a{t} x WHERE x.state = r.state) <= {policy.restricted} AS few FROM r{t} r WHERE (SELECT count(*) FROM c{t} x WHERE x.state = r.state) > 1)",
            ]
            expert = "(SELECT '' AS state, '' AS guess WHERE FALSE)"
            if t == 2:
                expert = f"(SELECT state, guess FROM ({G.STATS_SQL.format(alive=f'c{t}', fb='fba')}) s QUALIFY row_number() OVER (PARTITION BY state ORDER BY round(h, 9) DESC, isc DESC, guess) = 1)"
            parts.append(f"""m{t} AS MATERIALIZED (SELECT u.answer, u.draw, u.state, CASE WHEN by_expert THEN e.guess WHEN few OR (kind >= {policy.candidate}e0 AND kind < {policy.candidate + policy.admissible}e0) THEN a.guess WHEN kind >= {policy.candidate + policy.admissible}e0 THEN l.word ELSE c.answer END AS guess
                FROM u{t} u JOIN nc{t} c ON c.state = u.state AND c.spot = u.pick % c.n JOIN na{t} a ON a.state = u.state AND a.spot = u.pick % a.k JOIN legal l ON l.spot = u.pick % l.k LEFT JOIN {expert} e ON e.state = u.state)""")
        parts += [
            f"p{t} AS MATERIALIZED (SELECT m.*, f.code, concat(m.state, '|', m.guess, ':', f.code) AS child FROM m{t} m JOIN fba f USING (guess, answer) WHERE f.code <> {ALL_RIGHT}), d{t} AS MATERIALIZED (SELECT DISTINCT state, guess, code, child FROM p{t})",
            f"c{t + 1} AS MATERIALIZED (SELECT d.child AS state, c.answer FROM d{t} d JOIN c{t} c USING (state) JOIN fba f ON f.guess = d.guess AND f.answer = c.answer AND f.code = d.code), a{t + 1} AS MATERIALIZED (SELECT d.child AS state, a.guess FROM d{t} d JOIN a{t} a USING (state) JOIN fb f ON f.guess = d.guess AND f.answer = a.guess AND f.code = d.code)",
            f"r{t + 1} AS MATERIALIZED (SELECT answer, draw, child AS state FROM p{t})",
            f"v{t} AS (SELECT answer, draw, {t + 1} AS turn, (SELECT count(*) FROM c{t + 1} x WHERE x.state = r.state) AS n, (SELECT count(*) FROM a{t + 1} x WHERE x.state = r.state) AS n_adm, state FROM r{t + 1} r)",
        ]
    return f"{lists_oracle()}, {list_games_oracle('full')}, {', '.join(parts)}, visits AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM v{t}" for t in range(1, policy.turns + 1)) + ")"


@query(rollouts_oracle(MIXED) + " SELECT answer, draw, turn, n, n_adm, state FROM visits")
def rollout_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state that rollouts of the mixed policy visit: some draws for each training answer."""
    return sampled(spark, sf_dir, "mixed", MIXED)


_QUOTA = "CASE bucket " + " ".join(f"WHEN '{b}' THEN {k}" for b, k in PER_ANSWER.items()) + " END"


@query(f"""{rollouts_oracle(ENDGAMES)}, b AS (SELECT *, {band_sql('n', 'endgame')} AS bucket FROM visits), f AS (SELECT * FROM b WHERE bucket IS NOT NULL QUALIFY row_number() OVER (PARTITION BY answer, state ORDER BY draw, turn) = 1)
    SELECT answer, bucket, draw, turn, n, state FROM f QUALIFY row_number() OVER (PARTITION BY answer, bucket ORDER BY draw, turn) <= {_QUOTA}""")
def endgame_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each training answer so many different states of each size, in the order of its rollouts."""
    v = sampled(spark, sf_dir, "endgames", ENDGAMES).withColumn("bucket", band(F.col("n"), "endgame")).where("bucket IS NOT NULL")
    first = v.withColumn("again", F.row_number().over(Window.partitionBy("answer", "state").orderBy("draw", "turn"))).where("again = 1")
    place = F.row_number().over(Window.partitionBy("answer", "bucket").orderBy("draw", "turn"))
    return first.withColumn("place", place).where(F.expr(f"place <= {_QUOTA}")).select("answer", "bucket", "draw", "turn", "n", "state")


def visits_in_order(visits: DataFrame) -> DataFrame:
    """place, turn, rollout, answer, bucket, state of visits with two candidates or more."""
    rollout = F.concat_ws("|", "answer", F.col("draw").cast("string"))
    return visits.where("n >= 2").select(F.sha2(F.concat(F.lit("order|"), rollout), 256).alias("place"), "turn", rollout.alias("rollout"), "answer", band(F.col("n_adm"), "pairs").alias("bucket"), "state")


def accepted_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.kept(spark, sf_dir, "accepted", lambda: scratch_table(accepted(visits_in_order(sampled(spark, sf_dir, "mixed", MIXED)), QUOTAS, ANSWER_CAP), "accepted"))


@query()
def quota_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States kept under quotas of buckets, a cap for each answer, no state twice and one of a rollout; tested against a
    reader that takes visits one by one."""
    return accepted_visits(spark, sf_dir).select("bucket", "answer", "rollout", "turn", "state")


# -- pairs over every legal action, at all turns ----------------------------------------------------------------------

# States of at most so many admissible words are valued exactly, over those; wider ones by what each legal
# word is expected to leave. Bands of gaps: of guesses a game in the first, relative to the best in the second.
RESTRICTED, EXACT_FAR, NEAR, FAR = 20, (1.0, 2.5), (0.05, 0.20), (0.30, 1.00)


def legal_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state, turn, n, exact, guess, value, agrees: every action that may be played in a visited state of two candidates or
    more; value is a whole number, guesses or squares summed over the candidates; agrees: with all clues."""

    def make() -> DataFrame:
        lists = word_lists(spark, sf_dir)
        states = scratch_table(sampled(spark, sf_dir, "mixed", MIXED).where("n >= 2").select("state", "turn", "n", "n_adm").distinct(), "visited")
        words = scratch_table(consistent_words(spark, sf_dir, parsed(states)).join(F.broadcast(lists.targets.withColumnRenamed("answer", "word")), "word", "left"), "agreeing")
        few = words.join(states.where(F.col("n_adm") <= RESTRICTED), "state").select("state", "word", F.col("aid").isNotNull().cast("int").alias("isc"), (F.lit(G.TURNS + 1) - F.col("turn")).alias("left"))
        exact = adaptive_values(few).select("state", "guess", F.col("cost").alias("value"), F.lit(True).alias("exact"), F.lit(True).alias("agrees"))
        wide = states.where(F.col("n_adm") > RESTRICTED)
        sets = words.where("aid IS NOT NULL").join(wide.select("state"), "state", "left_semi").groupBy("state").agg(F.array_sort(F.collect_list("aid")).alias("members")).withColumn("cset", set_key(F.col("members")))
        sets = scratch_table(sets, "sets")
        stats = packed.partition_statistics(lists.packed, sets.select("cset", "members").dropDuplicates(["cset"])).select("cset", "guess", F.col("sumsq").alias("value"))
        agree = words.select("state", F.col("word").alias("guess"), F.lit(True).alias("a"))
        each = sets.select("state", "cset").join(stats, "cset").join(agree, ["state", "guess"], "left").select("state", "guess", "value", F.lit(False).alias("exact"), F.coalesce("a", F.lit(False)).alias("agrees"))
        return scratch_table(exact.unionByName(each).join(states.drop("n_adm"), "state"), "actions")

    return G.kept(spark, sf_dir, "legal-actions", make)


def gap_in(low: float, high: float, over: str, base: str) -> str:
    """SQL: low <= over / base <= high, in whole numbers of hundredths."""
    return f"100 * ({over}) >= {round(100 * low)} * ({base}) AND 100 * ({over}) <= {round(100 * high)} * ({base})"


_NEAR = f"CASE WHEN exact THEN tier = 2 ELSE {gap_in(*NEAR, 'value - best', 'best')} END"
_FAR = f"CASE WHEN exact THEN {gap_in(*EXACT_FAR, 'value - best', 'n')} ELSE {gap_in(*FAR, 'value - best', 'best')} END"


def legal_pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of each type a state offers: chosen is spread by a hash over the tied best, rejected is drawn from its band."""

    def make() -> DataFrame:
        own = Window.partitionBy("state")
        t = legal_actions(spark, sf_dir).withColumns({"best": F.min("value").over(own), "n_actions": F.count("*").over(own), "tier": F.dense_rank().over(own.orderBy("value")), "rank": F.rank().over(own.orderBy("value")).cast("long")})
        t = scratch_table(t, "ranked")
        best = t.where("tier = 1").groupBy("state", "turn", "n", "exact", "best", "n_actions").agg(F.array_sort(F.collect_list(F.struct("guess", "agrees"))).alias("tied"))
        chosen = best.withColumn("c", F.get("tied", (hash_number(F.lit("chosen"), F.col("state")) % F.size("tied")).cast("int")))
        draw = F.struct(F.sha2(F.concat_ws("|", F.lit("rejected"), "state", "guess"), 256).alias("h"), "guess", "value", "rank", "agrees")
        sides = [t.where("tier > 1").where(band_).groupBy("state").agg(F.min(draw).alias("r")).withColumn("pair_type", F.lit(kind)) for kind, band_ in (("competitive", _NEAR), ("contrastive", _FAR))]
        both = chosen.join(sides[0].unionByName(sides[1]), "state")
        return scratch_table(both.select("state", "turn", "exact", "pair_type", F.col("c.guess").alias("chosen"), F.col("c.agrees").alias("chosen_agrees"), F.col("r.guess").alias("rejected"), F.col("r.agrees").alias("rejected_agrees"), (F.col("r.value") - F.col("best")).alias("gap"), "n", F.col("r.rank").alias("rejected_rank"), F.size("tied").cast("long").alias("n_optimal"), "n_actions"), "legal-pairs")

    return G.kept(spark, sf_dir, "legal-pairs", make)


def _adaptive(left: int) -> str:
    """The exact values of visited states with so many guesses left, under names of their own."""
    own = f"SELECT w.state, w.word, w.isc FROM agreeing w JOIN visited s USING (state) WHERE s.n_adm <= {RESTRICTED} AND s.turn = {G.TURNS + 1 - left}"
    return re.sub(r"\b([ndmxva]\d|st)\b", rf"l{left}\1", f"(WITH {adaptive_oracle('OWN', left)})").replace("OWN", own)


LEGAL = f"""{rollouts_oracle(MIXED)}, visited AS MATERIALIZED (SELECT DISTINCT state, turn, n, n_adm FROM visits WHERE n >= 2),
    facts AS (SELECT state, split_part(p, ':', 1) AS guess, CAST(split_part(p, ':', 2) AS INT) AS code FROM (SELECT state, unnest(string_split(substr(state, 2), '|')) AS p FROM visited)),
    agreeing AS MATERIALIZED (SELECT f.state, b.answer AS word, CASE WHEN b.answer IN (SELECT answer FROM answers) THEN 1 ELSE 0 END AS isc FROM facts f JOIN fb b USING (guess, code) GROUP BY f.state, b.answer HAVING count(*) = (SELECT any_value(turn) - 1 FROM visited v WHERE v.state = f.state)),
    exact_ AS MATERIALIZED ({" UNION ALL ".join(f"SELECT state, guess, cost FROM {_adaptive(left)}" for left in range(1, G.TURNS))}),
    proxy AS MATERIALIZED (SELECT state, guess, sum(k * k)::BIGINT AS value FROM (SELECT w.state, f.guess, f.code, count(*) AS k FROM agreeing w JOIN visited s USING (state) JOIN fb f ON f.answer = w.word WHERE isc = 1 AND s.n_adm > {RESTRICTED} GROUP BY ALL) GROUP BY ALL),
    acts AS MATERIALIZED (SELECT x.*, s.turn, s.n FROM (SELECT state, guess, cost AS value, TRUE AS exact, TRUE AS agrees FROM exact_ UNION ALL SELECT p.state, p.guess, value, FALSE, w.word IS NOT NULL FROM proxy p LEFT JOIN agreeing w ON w.state = p.state AND w.word = p.guess) x JOIN visited s USING (state)),
    worst_of AS (SELECT state, min(value) AS best, count(*) AS n_actions, list_sort(list(DISTINCT value))[2] AS second FROM acts GROUP BY state), near AS MATERIALIZED (SELECT a.*, best, n_actions, second, (SELECT count(*) FROM acts y WHERE y.state = a.state AND y.value < a.value) + 1 AS rank FROM acts a JOIN worst_of USING (state)),
    tied AS (SELECT state, list_sort(list((guess, agrees))) AS t FROM near WHERE value = best GROUP BY state), pick AS (SELECT state, len(t) AS n_optimal, t[CAST('0x' || substr(sha256('chosen|' || state), 1, 8) AS BIGINT) % len(t) + 1] AS c FROM tied),
    side AS (SELECT 'competitive' AS pair_type, * FROM near WHERE value > best AND CASE WHEN exact THEN value = second ELSE (value - best) / best BETWEEN 0.05 - 1e-12 AND 0.2 + 1e-12 END UNION ALL SELECT 'contrastive', * FROM near WHERE value > best AND CASE WHEN exact THEN (value - best) / n BETWEEN 1 - 1e-12 AND 2.5 + 1e-12 ELSE (value - best) / best BETWEEN 0.3 - 1e-12 AND 1 + 1e-12 END),
    lp AS MATERIALIZED (SELECT state, turn, exact, pair_type, c[1] AS chosen, c[2] AS chosen_agrees, guess AS rejected, agrees AS rejected_agrees, value - best AS gap, n, rank AS rejected_rank, n_optimal, n_actions FROM side JOIN pick USING (state) QUALIFY row_number() OVER (PARTITION BY state, pair_type ORDER BY sha256('rejected|' || state || '|' || guess)) = 1)"""


@query(LEGAL + " SELECT * FROM lp")
def legal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal_pair_table(spark, sf_dir)


@query(LEGAL + """ SELECT exact, pair_type, turn, count(*) AS pairs, round(avg(CASE WHEN chosen_agrees THEN 1.0 ELSE 0.0 END), 6) AS chosen_consistent, round(avg(CASE WHEN rejected_agrees THEN 1.0 ELSE 0.0 END), 6) AS rejected_consistent,
    round(avg(CASE WHEN chosen_agrees THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN rejected_agrees THEN 1.0 ELSE 0.0 END), 6) AS asymmetry, round(avg(n_actions), 4) AS mean_actions, count(*) FILTER (WHERE n_optimal > 1) AS tied FROM lp GROUP BY ALL""")
def pair_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much oftener the chosen word agrees with all clues than the rejected one, by regime, type and turn."""
    a, b = (F.avg(F.col(c).cast("double")) for c in ("chosen_agrees", "rejected_agrees"))
    return legal_pair_table(spark, sf_dir).groupBy("exact", "pair_type", "turn").agg(F.count("*").alias("pairs"), F.round(a, 6).alias("chosen_consistent"), F.round(b, 6).alias("rejected_consistent"), F.round(a - b, 6).alias("asymmetry"), F.round(F.avg("n_actions"), 4).alias("mean_actions"), F.count_if(F.col("n_optimal") > 1).alias("tied"))


@query()
def quota_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the states that quotas accept."""
    return legal_pair_table(spark, sf_dir).join(accepted_visits(spark, sf_dir).select("state", "bucket"), "state")
