"""Game records, endgame rows with quotas, task tables, collated rows, and audits of whole packages with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.feedback import ALL_RIGHT, code_to_pattern
from gridloom.functions.hashing import split_of
from gridloom.plans import games as G
from gridloom.plans.lists import list_games, list_games_oracle, lists_oracle, scores, tables
from gridloom.plans.queries import NEXT, SPLIT, exchanges, query
from gridloom.plans.records import _TABS, EXACT, PAIRS, REC, band, band_sql, pairs, records, with_faults
from gridloom.session import read_table

# -- games --------------------------------------------------------------------------------------------------------


@query(f"""{lists_oracle()}, {list_games_oracle('restricted')} SELECT answer, max(guess) FILTER (WHERE turn = 1) AS opener, count(*) AS n_turns, bool_or(code = {ALL_RIGHT}) AS solved, CASE WHEN bool_or(code = {ALL_RIGHT}) THEN max(turn) ELSE 7 END AS score,
    string_agg(upper(guess), ' ' ORDER BY turn) AS guesses, string_agg({code_to_pattern('code')}, ' ' ORDER BY turn) AS feedback, string_agg(CAST(n_before AS VARCHAR), ' ' ORDER BY turn) AS candidates, {SPLIT.format(k='answer')} AS split FROM lg GROUP BY answer""")
def game_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a game, its turns aligned."""
    g = list_games(spark, sf_dir, "restricted").withColumn("pattern", F.expr(code_to_pattern("code")))
    turns = F.array_sort(F.collect_list(F.struct("turn", "guess", "pattern", "n_before")))
    games = g.groupBy("answer").agg(turns.alias("t"), F.max(F.col("code") == ALL_RIGHT).alias("solved"))
    joined = lambda f: F.array_join(F.transform("t", f), " ")
    return games.select(
        "answer", F.col("t")[0]["guess"].alias("opener"), F.size("t").cast("long").alias("n_turns"), "solved", F.when(F.col("solved"), F.size("t")).otherwise(7).alias("score"),
        joined(lambda x: F.upper(x["guess"])).alias("guesses"), joined(lambda x: x["pattern"]).alias("feedback"), joined(lambda x: x["n_before"].cast("string")).alias("candidates"), split_of(F.col("answer")).alias("split"),
    )


SCORED = ("full", "hard", "candidates", "random_restricted")
_SCORED = ", ".join(list_games_oracle(p, f"lg_{p}") for p in SCORED)


@query(f"""{lists_oracle()}, {_SCORED}, g AS ({" UNION ALL ".join(f"SELECT '{p}' AS policy, answer, turn, guess, code, adm, n_adm FROM lg_{p}" for p in SCORED)}), p AS (SELECT policy, answer, count(DISTINCT guess) AS unique_guesses, count(*) AS turns, bool_or(code = {ALL_RIGHT}) AS won FROM g GROUP BY ALL)
    SELECT policy, count(*) AS games, round(avg(CASE WHEN won THEN turns ELSE 7 END), 6) AS mean, sum(turns - unique_guesses)::BIGINT AS repeats, (SELECT count(DISTINCT guess) FROM g x WHERE x.policy = p.policy) AS distinct_guesses,
        (SELECT round(100.0 * count(*) FILTER (WHERE adm = 0) / count(*), 6) FROM g x WHERE x.policy = p.policy AND turn > 1) AS against_clues_pct, (SELECT count(*) FROM g x WHERE x.policy = p.policy AND n_adm = 1) AS forced FROM p GROUP BY policy""")
def game_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, repeated guesses, and guesses that go against a clue, by policy."""
    g = None
    for p in SCORED:
        own = list_games(spark, sf_dir, p).select(F.lit(p).alias("policy"), "answer", "turn", "guess", "code", "adm", "n_adm")
        g = own if g is None else g.unionByName(own)
    games = g.groupBy("policy", "answer").agg(F.countDistinct("guess").alias("u"), F.count("*").alias("turns"), F.max(F.col("code") == ALL_RIGHT).alias("won"))
    one = games.groupBy("policy").agg(F.count("*").alias("games"), F.round(F.avg(F.when(F.col("won"), F.col("turns")).otherwise(7)), 6).alias("mean"), F.sum(F.col("turns") - F.col("u")).alias("repeats"))
    late = F.col("turn") > 1
    two = g.groupBy("policy").agg(F.countDistinct("guess").alias("distinct_guesses"), F.round(F.lit(100.0) * F.count_if(late & (F.col("adm") == 0)) / F.count_if(late), 6).alias("against_clues_pct"), F.count_if(F.col("n_adm") == 1).alias("forced"))
    return one.join(two, "policy")


@query(f"""{lists_oracle()}, {_SCORED}, s AS ({" UNION ALL ".join(f"SELECT '{p}' AS policy, answer, turn, code, n_before FROM lg_{p}" for p in SCORED)}), v AS (SELECT * FROM s WHERE {SPLIT.format(k='answer')} = 'val'), m AS (SELECT policy, answer, CASE WHEN bool_or(code = {ALL_RIGHT}) THEN max(turn) ELSE 7 END AS score FROM v GROUP BY ALL)
    SELECT policy, count(*) AS games, round(avg(score), 6) AS mean, median(score)::DOUBLE AS median, round(100.0 * count(*) FILTER (WHERE score <= 4) / count(*), 6) AS within_4, (SELECT round(avg(n_before), 6) FROM v x WHERE x.policy = m.policy AND turn = 2) AS candidates_2, (SELECT round(avg(n_before), 6) FROM v x WHERE x.policy = m.policy AND turn = 3) AS candidates_3 FROM m GROUP BY policy""")
def heldout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of held-out answers: scores, and candidates left at the second and third turn."""
    out = None
    for p in SCORED:
        g = list_games(spark, sf_dir, p).where(split_of(F.col("answer")) == "val")
        means = g.agg(*[F.round(F.avg(F.when(F.col("turn") == t, F.col("n_before"))), 6).alias(f"candidates_{t}") for t in (2, 3)])
        own = scores(g).agg(F.count("*").alias("games"), F.round(F.avg("score"), 6).alias("mean"), F.median("score").alias("median"), F.round(F.lit(100.0) * F.count_if(F.col("score") <= 4) / F.count("*"), 6).alias("within_4"))
        own = own.crossJoin(means).select(F.lit(p).alias("policy"), "*")  # one row each
        out = own if out is None else out.unionByName(own)
    return out


# -- rows of packages ---------------------------------------------------------------------------------------------


@query(f"{REC}, e AS (SELECT *, {band_sql('n', 'endgame')} AS bucket, row_number() OVER (PARTITION BY {band_sql('n', 'endgame')}, completion ORDER BY sha256('end|' || id)) AS rn FROM rec WHERE n <= 10) SELECT id, bucket, 'endgame_' || solver AS source, turn, n, completion, isc = 1 AS possible, gain, split FROM e WHERE rn <= CASE bucket WHEN '1' THEN 1 WHEN '2' THEN 2 ELSE 3 END")
def endgame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of few candidates, so many at most for a word in a bucket, drawn by a hash."""
    e = records(spark, sf_dir).where("n <= 10").withColumn("bucket", band(F.col("n"), "endgame"))
    rn = F.row_number().over(Window.partitionBy("bucket", "completion").orderBy(F.sha2(F.concat(F.lit("end|"), "id"), 256)))
    quota = F.when(F.col("bucket") == "1", 1).when(F.col("bucket") == "2", 2).otherwise(3)
    return e.withColumn("rn", rn).where(F.col("rn") <= quota).select("id", "bucket", F.concat(F.lit("endgame_"), "solver").alias("source"), "turn", "n", "completion", (F.col("isc") == 1).alias("possible"), "gain", "split")


@query(f"{REC}, d AS (SELECT prompt, completion, count(*) AS uses, min(id) AS first_id FROM rec WHERE split = 'train' GROUP BY ALL) SELECT sha256(prompt) AS prompt_sha, completion, uses, first_id FROM d WHERE uses > 1")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training pairs that games repeat, and how often."""
    r = records(spark, sf_dir).where("split = 'train'").withColumn("prompt_sha", F.sha2("prompt", 256))
    return r.groupBy("prompt_sha", "completion").agg(F.count("*").alias("uses"), F.min("id").alias("first_id")).where("uses > 1")


@query(f"{REC} SELECT sha256(prompt) AS prompt_sha, count(*) AS uses, count(DISTINCT completion) AS completions, min(completion) AS one, max(completion) AS other FROM rec GROUP BY prompt HAVING count(DISTINCT completion) > 1")
def contradictory_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts to which the teachers give different moves."""
    r = records(spark, sf_dir).withColumn("prompt_sha", F.sha2("prompt", 256))
    return r.groupBy("prompt_sha").agg(F.count("*").alias("uses"), F.countDistinct("completion").alias("completions"), F.min("completion").alias("one"), F.max("completion").alias("other")).where("completions > 1")


@query(f"{REC}, {EXACT} SELECT state, count(*) AS n_actions, string_agg(guess, ' ' ORDER BY cost, guess) AS actions, string_agg(CAST(cost AS VARCHAR), ' ' ORDER BY cost, guess) AS costs, min(cost) AS best, max(cost) - min(cost) AS spread, count(*) FILTER (WHERE optimal) AS n_optimal, {SPLIT.format(k='state')} AS split FROM exact_ GROUP BY state HAVING max(cost) > min(cost)")
def task_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks: a state's actions and their costs, aligned, cheapest first; states where all cost the same are none."""
    from gridloom.plans.lists import exact_adaptive_values

    e = exact_adaptive_values(spark, sf_dir).groupBy("state").agg(F.array_sort(F.collect_list(F.struct("cost", "guess"))).alias("a"), F.count_if("optimal").alias("n_optimal"), F.min("cost").alias("best"), F.max("cost").alias("worst")).where("worst > best")
    return e.select("state", F.size("a").cast("long").alias("n_actions"), F.array_join("a.guess", " ").alias("actions"), F.array_join(F.transform("a.cost", lambda c: c.cast("string")), " ").alias("costs"), "best", (F.col("worst") - F.col("best")).alias("spread"), "n_optimal", split_of(F.col("state")).alias("split"))


@query(f"""{REC}, {EXACT}, t AS (SELECT state, list(guess ORDER BY cost, guess) AS acts, list(cost ORDER BY cost, guess) AS costs FROM exact_ GROUP BY state HAVING max(cost) > min(cost)), p AS (SELECT 'clean' AS tab, * FROM t UNION ALL SELECT 'planted', state, CASE WHEN d < '4' THEN list_reverse(acts) ELSE acts END, CASE WHEN d BETWEEN '4' AND '7' THEN list_transform(costs, lambda c: c + 1) ELSE costs END FROM (SELECT *, substr(sha256('task|' || state), 1, 1) AS d FROM t)),
    e AS (SELECT tab, state, unnest(acts) AS guess, unnest(costs) AS cost FROM p) SELECT tab, count(DISTINCT e.state) AS tasks, count(*) AS rows_, count(*) FILTER (WHERE x.cost IS NULL) AS unknown, count(*) FILTER (WHERE x.cost <> e.cost) AS wrong_cost, count(*) FILTER (WHERE v.word IS NULL) AS illegal FROM e LEFT JOIN exact_ x ON x.state = e.state AND x.guess = e.guess LEFT JOIN vocab v ON v.word = e.guess GROUP BY tab""")
def task_table_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks against costs computed anew, and on a copy with lists turned round or raised."""
    from gridloom.plans.lists import exact_adaptive_values

    t = task_table(spark, sf_dir).select("state", F.split("actions", " ").alias("acts"), F.transform(F.split("costs", " "), lambda c: c.cast("long")).alias("costs"))
    d = F.substring(F.sha2(F.concat(F.lit("task|"), "state"), 256), 1, 1)
    bad = t.select(F.lit("planted").alias("tab"), "state", F.when(d < "4", F.reverse("acts")).otherwise(F.col("acts")).alias("acts"), F.when(d.between("4", "7"), F.transform("costs", lambda c: c + 1)).otherwise(F.col("costs")).alias("costs"))
    e = t.select(F.lit("clean").alias("tab"), "*").unionByName(bad).select("tab", "state", F.explode(F.arrays_zip("acts", "costs")).alias("x")).select("tab", "state", F.col("x.acts").alias("guess"), F.col("x.costs").alias("cost"))
    anew = exact_adaptive_values(spark, sf_dir).select("state", "guess", F.col("cost").alias("anew"))
    legal = G.table(spark, sf_dir, "vocab").select(F.col("word").alias("guess"), F.lit(True).alias("legal"))
    e = e.join(anew, ["state", "guess"], "left").join(legal, "guess", "left")
    return e.groupBy("tab").agg(F.countDistinct("state").alias("tasks"), F.count("*").alias("rows_"), F.count_if(F.col("anew").isNull()).alias("unknown"), F.count_if(F.col("anew") != F.col("cost")).alias("wrong_cost"), F.count_if(F.col("legal").isNull()).alias("illegal"))


MOST = 64
_W = r"list_filter(regexp_split_to_array({c}, '[ \t\n\r]+'), lambda w: w <> '')"


@query(f"""WITH t AS (SELECT conv_id, turn, {_W.format(c='prompt')} AS p, {_W.format(c='completion')} AS c FROM ({NEXT}) WHERE role = 'user' AND next_role = 'assistant'), u AS (SELECT *, list_concat(p, c) AS a, list_concat(list_transform(p, lambda w: '-100'), c) AS l FROM t)
    SELECT conv_id, turn, least(len(a), {MOST})::BIGINT AS length, sha256(array_to_string(a[greatest(len(a) - {MOST}, 0) + 1 :], ' ')) AS input_sha, sha256(array_to_string(l[greatest(len(l) - {MOST}, 0) + 1 :], ' ')) AS label_sha FROM u""")
def collate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows: words of prompt and completion, the prompt's labels masked, cut from the left."""
    words = lambda c: F.filter(F.split(c, r"[ \t\n\r]+"), lambda w: w != "")
    t = exchanges(spark, sf_dir).select("conv_id", "turn", words("prompt").alias("p"), words("completion").alias("c"))
    t = t.select("conv_id", "turn", F.concat("p", "c").alias("a"), F.concat(F.array_repeat(F.lit("-100"), F.size("p")), F.col("c")).alias("l"))
    last = lambda c: F.sha2(F.array_join(F.slice(c, F.greatest(F.size(c) - MOST, F.lit(0)) + 1, MOST), " "), 256)
    return t.select("conv_id", "turn", F.least(F.size("a"), F.lit(MOST)).cast("long").alias("length"), last("a").alias("input_sha"), last("l").alias("label_sha"))


@query("""WITH t AS (SELECT vec_id, generate_subscripts(embedding, 1) AS place, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT vec_id, sum(ln(1 / (1 + exp(-x)))) AS score, count(*) AS tokens, sum(ln(1 / (1 + exp(-x)))) FILTER (WHERE place = 1) AS first FROM t WHERE place <= 8 GROUP BY vec_id)
    SELECT vec_id, tokens, round(score, 6) AS score, round(first, 6) AS bound, score <= first AS bounded FROM s""")
def word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word's score is the sum of its tokens' log-probabilities, the end's among them; its first token bounds it."""
    t = read_table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 8)).alias("place", "x"))
    lp = F.log(1 / (1 + F.exp(-F.col("x").cast("double"))))
    s = t.groupBy("vec_id").agg(F.sum(lp).alias("s"), F.count("*").alias("tokens"), F.sum(F.when(F.col("place") == 0, lp)).alias("f"))
    return s.select("vec_id", "tokens", F.round("s", 6).alias("score"), F.round("f", 6).alias("bound"), (F.col("s") <= F.col("f")).alias("bounded"))


@query("""WITH e AS (SELECT vec_id, list_sum(list_transform(embedding[1:8], lambda x: ln(1 / (1 + exp(-x::DOUBLE))))) AS whole FROM embeddings), p AS (SELECT *, whole + CASE WHEN vec_id % 50 = 0 THEN 0.5 ELSE 0 END AS other FROM e)
    SELECT count(*) AS n, corr(whole, other) > 0.999 AS agrees, round(max(abs(whole - other)), 6) AS largest, count(*) FILTER (WHERE abs(whole - other) > 1e-6) AS off FROM p""")
def scorer_self_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores summed token by token against a copy with planted deviations: how many are off, and by how much."""
    t = read_table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.slice("embedding", 1, 8)).alias("x"))
    s = t.groupBy("vec_id").agg(F.sum(F.log(1 / (1 + F.exp(-F.col("x").cast("double"))))).alias("a"))
    s = s.withColumn("b", F.col("a") + F.when(F.col("vec_id") % 50 == 0, 0.5).otherwise(0.0))
    gap = F.abs(F.col("a") - F.col("b"))
    return s.agg(F.count("*").alias("n"), (F.corr("a", "b") > 0.999).alias("agrees"), F.round(F.max(gap), 6).alias("largest"), F.count_if(gap > 1e-6).alias("off"))


# -- audits of whole packages ---------------------------------------------------------------------------------------


@query(f"""{REC}, {_TABS}, ids AS (SELECT id, answer FROM rec WHERE substr(sha256('lost|' || id), 1, 1) <> '7'), tp AS (SELECT DISTINCT tab, prompt FROM tab WHERE split = 'train'), tq AS (SELECT DISTINCT tab, prompt, completion FROM tab WHERE split = 'train'), held AS (SELECT DISTINCT upper(answer) AS word FROM rec WHERE split = 'val')
    SELECT t.tab, t.split, count(*) AS records, count(*) FILTER (WHERE i.answer IS NULL) AS unresolved, count(*) FILTER (WHERE i.answer <> t.answer) AS misresolved, count(*) FILTER (WHERE t.split = 'val' AND EXISTS (SELECT 1 FROM tp WHERE tp.tab = t.tab AND tp.prompt = t.prompt)) AS shared_prompts,
        count(*) FILTER (WHERE t.split = 'val' AND EXISTS (SELECT 1 FROM tq WHERE tq.tab = t.tab AND tq.prompt = t.prompt AND tq.completion = t.completion)) AS shared_pairs, count(*) FILTER (WHERE t.split = 'train' AND t.completion IN (SELECT word FROM held)) AS held_out_moves, count(*) FILTER (WHERE position(upper(t.answer) IN t.prompt) > 0) AS answer_in_text
    FROM tab t LEFT JOIN ids i ON i.id = t.id GROUP BY ALL""")
def package_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records against the map of ids (a part of it is lost) and across splits, clean and with planted faults."""
    t = with_faults(spark, sf_dir).withColumn("prompt_sha", F.sha2("prompt", 256))
    r = records(spark, sf_dir)
    ids = r.where(F.substring(F.sha2(F.concat(F.lit("lost|"), "id"), 256), 1, 1) != "7").select("id", F.col("answer").alias("known"))
    train = t.where("split = 'train'")
    seen = train.select("tab", "prompt_sha").distinct().withColumn("p", F.lit(True))
    pair = train.select("tab", "prompt_sha", "completion").distinct().withColumn("q", F.lit(True))
    held = r.where("split = 'val'").select(F.upper("answer").alias("completion")).distinct().withColumn("h", F.lit(True))
    x = t.join(ids, "id", "left").join(seen, ["tab", "prompt_sha"], "left").join(pair, ["tab", "prompt_sha", "completion"], "left").join(held, "completion", "left")
    val, hit = F.col("split") == "val", lambda c: F.col(c).isNotNull()
    return x.groupBy("tab", "split").agg(F.count("*").alias("records"), F.count_if(F.col("known").isNull()).alias("unresolved"), F.count_if(F.col("known") != F.col("answer")).alias("misresolved"), F.count_if(val & hit("p")).alias("shared_prompts"), F.count_if(val & hit("q")).alias("shared_pairs"), F.count_if(~val & hit("h")).alias("held_out_moves"), F.count_if(F.col("prompt").contains(F.upper("answer"))).alias("answer_in_text"))


@query(f"""{REC}, {PAIRS}, vs AS (SELECT state FROM (SELECT DISTINCT state FROM pairs) WHERE {SPLIT.format(k='state')} = 'val'), s AS (SELECT p.*, {SPLIT.format(k='state')} AS split FROM pairs p) SELECT split, pair_type, count(*) AS rows_, count(DISTINCT state) AS states, count(DISTINCT chosen) AS chosen_words, count(DISTINCT rejected) AS rejected_words,
    round(avg(n_actions), 4) AS mean_actions, count(*) FILTER (WHERE chosen IN (SELECT answer FROM answers WHERE {SPLIT.format(k='answer')} = 'val')) AS chosen_held_out, max(rejected_rank) AS worst_rank, count(*) FILTER (WHERE rejected_rank = 1 + n_optimal) AS next_best FROM s GROUP BY ALL""")
def pair_set_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by split of their state: sizes, words, how many name a held-out answer, ranks of what they reject."""
    _, _, answers, _ = tables(spark, sf_dir)
    held = answers.where(split_of(F.col("answer")) == "val").select(F.col("answer").alias("chosen"), F.lit(True).alias("h"))
    s = pairs(spark, sf_dir).withColumn("split", split_of(F.col("state"))).join(held, "chosen", "left")
    return s.groupBy("split", "pair_type").agg(F.count("*").alias("rows_"), F.countDistinct("state").alias("states"), F.countDistinct("chosen").alias("chosen_words"), F.countDistinct("rejected").alias("rejected_words"), F.round(F.avg("n_actions"), 4).alias("mean_actions"), F.count_if(F.col("h")).alias("chosen_held_out"), F.max("rejected_rank").alias("worst_rank"), F.count_if(F.col("rejected_rank") == 1 + F.col("n_optimal")).alias("next_best"))
