"""Prompts, guess extraction, tasks, audits as violation counts, sweeps, verdicts and preference arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.feedback import ALL_RIGHT
from gridloom.functions.hashing import split_of
from gridloom.plans import games as G
from gridloom.plans import prompts as P
from gridloom.plans.queries import BEST, E, NEXT, ONEPLY, ORACLES, QUERIES, SCORED, SCORES, SPLIT, exchanges, query, same, scored
from gridloom.session import read_table


def rendered(name: str, ours: str, theirs: str, rule: str = "expected") -> None:
    """A query whose text differs between the engines only in how lists are joined."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        G.games(spark, sf_dir, rule).createOrReplaceTempView(f"games_{rule}")
        return spark.sql(ours)

    QUERIES[name] = run
    ORACLES[name] = G.base_oracle() + ", " + G.games_oracle(rule, f"games_{rule}") + f" SELECT * FROM ({theirs}) q"


# -- deductions and prompts ---------------------------------------------------------------------------------------

GAMES = "games_expected"
same("letter_constraints", f"SELECT answer, turn, letter, least, coalesce(exact, -1) AS exact, greens, ruled, CAST(status AS INT) AS status FROM ({P.letter_facts(GAMES)}) f", "expected")
rendered("state_constraints", P.deductions(GAMES, True), P.deductions(GAMES, False))
rendered("prompt_variants", P.prompts(GAMES, True), P.prompts(GAMES, False))
LEAKS = "SELECT variant, count(*) AS prompts, CAST(sum(CASE WHEN position(upper(answer) IN prompt) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS leaks FROM ({p}) p GROUP BY variant"
rendered("prompt_answer_leaks", LEAKS.format(p=P.prompts(GAMES, True)), LEAKS.format(p=P.prompts(GAMES, False)))

#: What may surround a word that a reply gives.
EDGES = ".,:;!?\"'()[]*_-"


@query(r"""WITH t AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(split_part(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10), 1), '[ \t\r]+'), lambda w: trim(w, '.,:;!?"''()[]*_-')), lambda w: w <> '') AS w FROM conversations)
    SELECT conv_id, turn, CASE WHEN regexp_matches(w[1], '^[A-Za-z]{5}$') THEN upper(w[1]) END AS word, CASE WHEN len(w) > 0 AND regexp_matches(w[1], '^[A-Za-z]{5}$') THEN 'ok' ELSE 'invalid_format' END AS status,
        CASE WHEN len(w) > 0 AND NOT regexp_matches(w[1], '^[A-Za-z]{5}$') THEN upper(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z]{5}$'))[1]) END AS would_recover FROM t""")
def extracted_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of a reply's first line if it has five letters; else the first later one, for diagnosis only."""
    line = F.split_part(F.trim("text", F.lit(" \t\n\r")), F.lit("\n"), F.lit(1))
    words = F.filter(F.transform(F.split(line, r"[ \t\r]+"), lambda w: F.trim(w, F.lit(EDGES))), lambda w: w != "")
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("w")).withColumn("first", F.get("w", F.lit(0)))
    good = F.coalesce(F.col("first").rlike("^[A-Za-z]{5}$"), F.lit(False))
    later = F.upper(F.get(F.filter("w", lambda x: x.rlike("^[A-Za-z]{5}$")), F.lit(0)))
    return c.select("conv_id", "turn", F.when(good, F.upper("first")).alias("word"), F.when(good, "ok").otherwise("invalid_format").alias("status"), F.when(~good, later).alias("would_recover"))


# -- policies, sweeps and verdicts --------------------------------------------------------------------------------

for _rule in ("adaptive_20", "adaptive_100", "expert_above_10", "rollout_endgame", "rollout_mixed"):
    same(f"policy_{_rule}", f"SELECT answer, turn, guess, code, n_before FROM games_{_rule}", _rule)
MEAN = "SELECT '{r}' AS policy, count(*) AS games, avg(score * 1.0e0) AS mean_score, CAST(sum(CASE WHEN score = 7 THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM ({s}) s"
SWEPT = ("entropy", "adaptive_20", "adaptive_100", "expert_above_10", "random")
TABLE = " UNION ALL ".join(MEAN.format(r=r, s=SCORES.format(r=r)) for r in SWEPT)
same("threshold_sweep", f"SELECT policy, games, round(mean_score, 6) AS mean_score, failed, round(mean_score - min(CASE WHEN policy = 'random' THEN mean_score END) OVER (), 6) AS gain_over_random FROM ({TABLE}) t", *SWEPT)
same("effect_decomposition", "SELECT round(random - expert, 6) AS expert_midgame, round(expert - a20, 6) AS expert_endgame, round(a20 - full_pool, 6) AS free_pool FROM (SELECT " + ", ".join(f"max(CASE WHEN policy = '{p}' THEN mean_score END) AS {n}" for p, n in (("random", "random"), ("expert_above_10", "expert"), ("adaptive_20", "a20"), ("entropy", "full_pool"))) + f" FROM ({TABLE}) t) d", *SWEPT)
# 0.25 better than the control at least, within 0.35 of the expert.
same("policy_verdicts", f"SELECT policy, CASE WHEN mean_score >= control - 0.25e0 THEN 'C' WHEN mean_score <= expert + 0.35e0 THEN 'A' WHEN mean_score < control THEN 'B' ELSE 'D' END AS verdict FROM (SELECT *, min(CASE WHEN policy = 'random' THEN mean_score END) OVER () AS control, min(CASE WHEN policy = 'entropy' THEN mean_score END) OVER () AS expert FROM ({TABLE}) t) v", *SWEPT)
PAIRED = f"SELECT a.answer, a.score AS sa, b.score AS sb FROM ({SCORES.format(r='random')}) a JOIN ({E}) b ON a.answer = b.answer"
same("mcnemar_counts", f"SELECT CAST(sum(CASE WHEN sa < 5 AND sb >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS only_first, CAST(sum(CASE WHEN sa >= 5 AND sb < 5 THEN 1 ELSE 0 END) AS BIGINT) AS only_second, CAST(sum(CASE WHEN sa < 5 AND sb < 5 THEN 1 ELSE 0 END) AS BIGINT) AS both, count(*) AS games FROM ({PAIRED}) p", "random", "expected")
same("stratified_games", "SELECT answer, score, CAST(third AS BIGINT) AS third FROM (SELECT answer, score, third, row_number() OVER (PARTITION BY third ORDER BY score, answer) AS rn FROM (SELECT answer, score, ntile(3) OVER (ORDER BY score, answer) AS third FROM (" + E + ") s) t) u WHERE rn <= 5", "expected")
same("states_of_few", "SELECT DISTINCT state, n_before FROM games_rollout_endgame WHERE n_before BETWEEN 1 AND 10", "rollout_endgame")
same("endgame_quota", "SELECT answer, state, n_before FROM (SELECT answer, state, n_before, row_number() OVER (PARTITION BY answer, CASE WHEN n_before > 3 THEN 4 ELSE n_before END ORDER BY turn, state) AS rn FROM games_rollout_endgame WHERE n_before BETWEEN 1 AND 10) q WHERE rn <= CASE WHEN n_before = 1 THEN 3 ELSE 1 END", "rollout_endgame")
same("opener_share", "SELECT guess, count(*) AS games, round(count(*) * 100.0e0 / sum(count(*)) OVER (), 6) AS pct FROM games_expected WHERE turn = 2 GROUP BY guess", "expected")

# -- tasks and pairs, and their audits ----------------------------------------------------------------------------

TASK = f"SELECT state, guess, sumsq, n, CAST(row_number() OVER (PARTITION BY state ORDER BY sumsq, guess) AS BIGINT) AS place, min(sumsq) OVER (PARTITION BY state) AS best, max(sumsq) OVER (PARTITION BY state) AS worst_value, count(*) OVER (PARTITION BY state) AS n_actions FROM ({ONEPLY}) p"
same("action_tasks", f"SELECT state, place, guess, sumsq, best, worst_value - best AS spread, n_actions FROM ({TASK}) t WHERE place <= 48 AND worst_value > best")
same("task_audit", f"SELECT count(*) AS tasks, CAST(sum(CASE WHEN n_best < 1 THEN 1 ELSE 0 END) AS BIGINT) AS without_best, CAST(sum(CASE WHEN words <> rows_ THEN 1 ELSE 0 END) AS BIGINT) AS repeated_actions, CAST(sum(CASE WHEN low < n THEN 1 ELSE 0 END) AS BIGINT) AS impossible_values FROM (SELECT state, max(n) AS n, min(sumsq) AS low, count(*) AS rows_, count(DISTINCT guess) AS words, sum(CASE WHEN sumsq = best THEN 1 ELSE 0 END) AS n_best FROM ({TASK}) t GROUP BY state) a")
same("pairs_competitive", f"SELECT c.state, c.guess AS chosen, r.guess AS rejected, round((r.sumsq - c.sumsq) * 1.0e0 / c.sumsq, 6) AS relative_gap FROM ({TASK}) c JOIN (SELECT *, row_number() OVER (PARTITION BY state ORDER BY sumsq, guess) AS rn FROM ({TASK}) t WHERE sumsq >= best * 1.05e0 AND sumsq <= best * 1.2e0) r ON r.state = c.state AND r.rn = 1 WHERE c.place = 1")
same("regret_budget", f"SELECT CASE WHEN n <= 10 THEN '2-10' WHEN n <= 100 THEN '11-100' ELSE '100+' END AS band, count(*) AS decisions, round(avg((sumsq - best) * 1.0e0 / n), 6) AS mean_regret, round(max((sumsq - best) * 1.0e0 / n), 6) AS max_regret FROM ({TASK}) t GROUP BY 1")
same("trajectory_audit", f"SELECT count(*) AS steps, CAST(sum(CASE WHEN v.word IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS illegal, CAST(sum(CASE WHEN f.code <> g.code THEN 1 ELSE 0 END) AS BIGINT) AS wrong_feedback, CAST(sum(CASE WHEN g.guess = g.answer AND g.code <> {ALL_RIGHT} THEN 1 ELSE 0 END) AS BIGINT) AS unmarked_wins, CAST(sum(CASE WHEN g.n_before < 1 THEN 1 ELSE 0 END) AS BIGINT) AS empty_states FROM games_expected g LEFT JOIN vocab v ON v.word = g.guess LEFT JOIN fb f ON f.guess = g.guess AND f.answer = g.answer", "expected")
same("recount_audit", "SELECT count(*) AS states, CAST(sum(CASE WHEN n_before <> k THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM (SELECT state, max(n_before) AS n_before, count(*) AS k FROM games_expected GROUP BY state) s", "expected")
same("consistent_guess_rate", f"SELECT turn, count(*) AS steps, round(avg(CASE WHEN ok = 1 THEN 100.0e0 ELSE 0.0e0 END), 6) AS consistent_pct FROM (SELECT b.answer, b.turn, min(CASE WHEN f.code = a.code THEN 1 ELSE 0 END) AS ok FROM games_expected b JOIN games_expected a ON a.answer = b.answer AND a.turn < b.turn JOIN fb f ON f.guess = a.guess AND f.answer = b.guess GROUP BY b.answer, b.turn) c GROUP BY turn", "expected")
same("opener_quality", f"SELECT count(*) AS codes, CAST(max(k) AS BIGINT) AS largest, round(sum(k * k) * 1.0e0 / sum(k), 6) AS expected FROM (SELECT f.code, count(*) AS k FROM fb f JOIN {BEST} o ON o.guess = f.guess GROUP BY f.code) c")


@query(f"WITH e AS (SELECT prompt, completion, {SPLIT.format(k='CAST(conv_id AS VARCHAR)')} AS s FROM ({NEXT}) WHERE role = 'user' AND next_role = 'assistant') SELECT (SELECT count(*) FROM e WHERE s = 'val') AS val_rows, (SELECT count(*) FROM e WHERE s = 'val' AND prompt IN (SELECT prompt FROM e WHERE s = 'train')) AS shared_prompts, (SELECT count(*) FROM e v WHERE s = 'val' AND EXISTS (SELECT 1 FROM e t WHERE t.s = 'train' AND t.prompt = v.prompt AND t.completion = v.completion)) AS shared_pairs")
def exchange_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = exchanges(spark, sf_dir).select("prompt", "completion", split_of(F.col("conv_id").cast("string")).alias("s"))
    val = F.count_if(F.col("s") == "val").alias("v")
    train = F.count_if(F.col("s") == "train").alias("t")
    pairs = e.groupBy("prompt", "completion").agg(val, train)
    both = pairs.groupBy("prompt").agg(F.sum("v").alias("v"), F.sum("t").alias("t"), F.coalesce(F.sum(F.when(F.col("t") > 0, F.col("v"))), F.lit(0)).alias("p"))
    return both.agg(F.sum("v").alias("val_rows"), F.coalesce(F.sum(F.when(F.col("t") > 0, F.col("v"))), F.lit(0)).alias("shared_prompts"), F.sum("p").alias("shared_pairs"))


@query("WITH l AS (SELECT doc_id, toxic FROM labels), d AS (SELECT doc_id, source FROM documents) SELECT coalesce(source, 'none') AS source, count(l.doc_id) AS labelled, count(*) AS documents, round(avg(toxic) * 100, 6) AS toxic_pct FROM d LEFT JOIN l USING (doc_id) GROUP BY 1")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(1).alias("hit"))
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return d.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("hit").alias("labelled"), F.count("*").alias("documents"), F.round(F.avg("toxic") * 100, 6).alias("toxic_pct"))


# -- learning arithmetic ------------------------------------------------------------------------------------------


@query("SELECT vec_id, round(m, 6) AS margin, m > 0 AS right_way, round(-ln(1 / (1 + exp(-0.1e0 * m))), 6) AS loss FROM (SELECT vec_id, (embedding[1]::DOUBLE - embedding[2]::DOUBLE) - (embedding[3]::DOUBLE - embedding[4]::DOUBLE) AS m FROM embeddings)")
def preference_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin and loss of pairs: policy's chosen and rejected log-probabilities, then the reference's."""
    x = [F.get("embedding", F.lit(k)).cast("double") for k in range(4)]
    m = F.col("m")
    return read_table(spark, sf_dir, "embeddings").select("vec_id", ((x[0] - x[1]) - (x[2] - x[3])).alias("m")).select("vec_id", F.round(m, 6).alias("margin"), (m > 0).alias("right_way"), F.round(-F.log(1 / (1 + F.exp(F.lit(-0.1) * m))), 6).alias("loss"))


@query(f"WITH p AS (SELECT state, word, score, score - ln(sum(exp(score)) OVER w) AS lp, score / 2 - ln(sum(exp(score / 2)) OVER w) AS lr FROM {SCORED} WINDOW w AS (PARTITION BY state)) SELECT state, round(avg(exp(lr - lp) - (lr - lp) - 1), 6) AS k3, round(sum(exp(lp) * (lp - lr)), 6) AS kl FROM p GROUP BY state")
def policy_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k3 estimate and the exact divergence of a state's policy from one at twice the temperature."""
    w = Window.partitionBy("state")
    s = F.col("score")
    p = scored(spark, sf_dir).select("state", (s - F.log(F.sum(F.exp(s)).over(w))).alias("lp"), (s / 2 - F.log(F.sum(F.exp(s / 2)).over(w))).alias("lr"))
    gap = F.col("lr") - F.col("lp")
    return p.groupBy("state").agg(F.round(F.avg(F.exp(gap) - gap - 1), 6).alias("k3"), F.round(F.sum(F.exp("lp") * -gap), 6).alias("kl"))


@query(f"WITH r AS (SELECT state, word, allowed AND word % 2 = 0 AS ok, score FROM {SCORED}), n AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY state) AS n_ok FROM r) SELECT state, arg_max(word, (score, -word)) AS word, CASE WHEN max(n_ok) = 1 THEN 'forced' WHEN max(n_ok) = 0 THEN 'fallback' ELSE 'model_chosen' END AS how FROM n WHERE ok OR n_ok = 0 GROUP BY state")
def constrained_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best allowed action; the only one is forced, none allowed opens the whole pool."""
    ok = F.col("allowed") & (F.col("word") % 2 == 0)
    n = scored(spark, sf_dir).withColumn("ok", ok).withColumn("n_ok", F.count_if("ok").over(Window.partitionBy("state")))
    how = F.when(F.max("n_ok") == 1, "forced").when(F.max("n_ok") == 0, "fallback").otherwise("model_chosen")
    return n.where("ok OR n_ok = 0").groupBy("state").agg(F.max_by("word", F.struct("score", -F.col("word"))).alias("word"), how.alias("how"))


@query(r"""WITH t AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(prompt, '[ \t\n\r]+'), lambda w: w <> '')) AS p, len(list_filter(regexp_split_to_array(completion, '[ \t\n\r]+'), lambda w: w <> '')) AS c FROM (""" + NEXT + r""") WHERE role = 'user' AND next_role = 'assistant')
    SELECT conv_id, turn, CAST(least(p + c, 64) AS BIGINT) AS length, CAST(greatest(least(p, 64 - c), 0) AS BIGINT) AS masked, CAST(greatest(p + c - 64, 0) AS BIGINT) AS cut FROM t""")
def collate_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of at most 64 words: the prompt is masked and is cut from its left where both don't fit."""
    count = lambda c: F.size(F.filter(F.split(c, r"[ \t\n\r]+"), lambda w: w != "")).cast("long")
    t = exchanges(spark, sf_dir).select("conv_id", "turn", count("prompt").alias("p"), count("completion").alias("c"))
    return t.selectExpr("conv_id", "turn", "least(p + c, 64L) AS length", "greatest(least(p, 64L - c), 0L) AS masked", "greatest(p + c - 64L, 0L) AS cut")
