"""Registered queries of the engine and their DuckDB oracles, bound to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.feedback import ALL_RIGHT, code_to_pattern, pattern_to_code
from gridloom.functions.hashing import opaque_id, split_of
from gridloom.plans import games as G
from gridloom.session import read_table
from gridloom.sources.words import tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SPLIT = "CASE WHEN CAST(('0x' || substr(sha256('wordle-split-v1|' || {k}), 1, 8)) AS BIGINT) / 4294967295.0e0 < 0.1e0 THEN 'val' ELSE 'train' END"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def same(name: str, text: str, *rules: str) -> None:
    """A query whose text both engines run; it reads vocab, fb, fscores and games_<rule>."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in ("vocab", "fb", "fscores"):
            G.table(spark, sf_dir, t)
        for r in rules:
            G.games(spark, sf_dir, r).createOrReplaceTempView(f"games_{r}")
        return spark.sql(text)

    QUERIES[name] = run
    ORACLES[name] = G.base_oracle() + "".join(", " + G.games_oracle(r, f"games_{r}") for r in rules) + f" SELECT * FROM ({text}) q"


# -- vocabulary ---------------------------------------------------------------------------------------------------


def over_all_words(name: str, text: str) -> None:
    """A query whose text both engines run over every word, however rare."""
    text = text.replace("vocab", "words_all")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        G.all_words(spark, sf_dir)
        return spark.sql(text)

    QUERIES[name] = run
    ORACLES[name] = f"WITH {G.ALL_WORDS_ORACLE} SELECT * FROM ({text}) q"


over_all_words("word_freq", "SELECT word, uses, documents FROM vocab")
over_all_words("letter_presence", f"SELECT letter, round(p, 9) AS p FROM ({G.PRESENCE_SQL}) q")
over_all_words("letter_positional", f"SELECT place, letter, round(p, 9) AS p FROM ({G.PLACE_SQL}) q")
over_all_words("frequency_score", f"SELECT guess, round(fscore, 6) AS score FROM ({G.SCORE_SQL}) q")


@query(r"SELECT length(word) AS n_letters, count(*) AS uses, count(DISTINCT word) AS words, count(*) FILTER (WHERE regexp_matches(word, '^[a-z]+$')) AS plain FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def word_length_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(read_table(spark, sf_dir, "documents"))
    return t.groupBy(F.length("word").cast("long").alias("n_letters")).agg(F.count("*").alias("uses"), F.countDistinct("word").alias("words"), F.count_if(F.col("word").rlike("^[a-z]+$")).alias("plain"))


# -- feedback and partitions --------------------------------------------------------------------------------------

ONE = "(SELECT word AS answer, '' AS state FROM vocab)"
STATS = G.STATS_SQL.format(alive=ONE, fb="fb")
same("feedback_code_hist", "SELECT code, count(*) AS n FROM fb GROUP BY code")
same("feedback_patterns", f"SELECT code, {code_to_pattern('code')} AS pattern, {pattern_to_code(code_to_pattern('code'))} AS back FROM (SELECT DISTINCT code FROM fb) d")
same("feedback_diagonal_audit", f"SELECT count(*) AS words, sum(CASE WHEN code <> {ALL_RIGHT} THEN 1 ELSE 0 END) * 1.0e0 AS violations FROM fb WHERE guess = answer")
same("partition_stats", f"SELECT guess, round(h, 6) AS entropy, round(1.0e0 * sumsq / n, 6) AS expected_remaining, worst, isc FROM ({STATS}) s")
for _metric, _order in (("entropy", "round(h, 9) DESC, guess"), ("expected", "sumsq, guess"), ("minimax", "worst, guess")):
    same(f"top_openers_{_metric}", f"SELECT guess, round(h, 6) AS entropy, round(1.0e0 * sumsq / n, 6) AS expected_remaining, worst, CAST(row_number() OVER (ORDER BY {_order}) AS BIGINT) AS place FROM (SELECT * FROM ({STATS}) s ORDER BY {_order} LIMIT 20) t")
same("first_guess_analysis", f"SELECT s.guess, round(h, 6) AS entropy, round(1.0e0 * sumsq / n, 6) AS expected_remaining, worst, round(fscore, 6) AS frequency FROM ({STATS}) s JOIN fscores f ON f.guess = s.guess")
same("hybrid_score", f"SELECT guess, round(h - 0.25e0 * log2(worst) - 0.25e0 * log2(1.0e0 * sumsq / n) + CASE WHEN isc = 1 THEN log2(1 + 1.0e0 / n) ELSE 0 END, 6) AS score FROM ({STATS}) s")
same("hybrid_weight_sweep", f"SELECT lam, guess FROM (SELECT lam, guess, row_number() OVER (PARTITION BY lam ORDER BY round(h - lam * log2(worst), 9) DESC, guess) AS rn FROM ({STATS}) s CROSS JOIN (SELECT 0.0e0 AS lam UNION ALL SELECT 0.25e0 UNION ALL SELECT 0.5e0 UNION ALL SELECT 1.0e0) w) r WHERE rn = 1".replace("lam, guess FROM (SELECT lam", "CAST(lam AS DOUBLE) AS lam, guess FROM (SELECT lam"))
BEST = f"(SELECT guess FROM ({STATS}) s ORDER BY round(h, 9) DESC, guess LIMIT 1)"
same("consistent_after_opener", f"SELECT f.guess, f.code, f.answer, count(*) OVER (PARTITION BY f.code) AS n FROM fb f JOIN {BEST} o ON o.guess = f.guess")
same("admissible_buckets", f"SELECT band, count(*) AS states, CAST(sum(n) AS BIGINT) AS words FROM (SELECT CASE WHEN n < 2 THEN 'none' WHEN n <= 10 THEN '2-10' WHEN n <= 100 THEN '11-100' ELSE '100+' END AS band, n FROM (SELECT f.code, count(*) AS n FROM fb f JOIN {BEST} o ON o.guess = f.guess GROUP BY f.code) c) b GROUP BY band")

#: One-ply values of every candidate action in every state after the best opener.
ONEPLY = f"""SELECT state, guess, sumsq, n, 1.0e0 * sumsq / n AS cost FROM ({G.STATS_SQL.format(alive=f"(SELECT f.answer, CAST(f.code AS VARCHAR(9)) AS state FROM fb f JOIN {BEST} o ON o.guess = f.guess)", fb="fb")}) v WHERE isc = 1 AND n > 1"""
same("oneply_topk", f"SELECT state, guess, sumsq, CAST(rn AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY sumsq, guess) AS rn FROM ({ONEPLY}) p) q WHERE rn <= 3")
same("decision_structure", f"SELECT state, n, CAST(sum(CASE WHEN tier = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_optimal, CAST(coalesce(min(CASE WHEN tier = 2 THEN sumsq END) - min(sumsq), -1) AS BIGINT) AS gap FROM (SELECT *, dense_rank() OVER (PARTITION BY state ORDER BY sumsq) AS tier FROM ({ONEPLY}) p) q GROUP BY state, n")
same("preference_pairs_oneply", f"""SELECT c.state, c.guess AS chosen, r.guess AS rejected, round(r.cost - c.cost, 6) AS gap, CAST(r.rnk AS BIGINT) AS rejected_rank FROM
    (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY sumsq, guess) AS rn FROM ({ONEPLY}) p) a WHERE rn = 1) c
    JOIN (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY state ORDER BY sumsq) AS tier, rank() OVER (PARTITION BY state ORDER BY sumsq) AS rnk, row_number() OVER (PARTITION BY state ORDER BY sumsq DESC, guess) AS worst_first FROM ({ONEPLY}) p) b WHERE tier > 1 AND worst_first = 1) r ON r.state = c.state""")

# -- games --------------------------------------------------------------------------------------------------------

for _rule in ("frequency", "entropy", "expected", "minimax", "hybrid", "random"):
    same(f"solver_games_{_rule}", f"SELECT answer, turn, guess, code, n_before FROM games_{_rule}", _rule)
for _tie in G.TIEBREAKS:
    same(f"tiebreak_{_tie.lower()}", f"SELECT round(avg(1.0e0 * score), 6) AS mean_score, CAST(sum(CASE WHEN score = 7 THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM (SELECT answer, CASE WHEN max(code) = {ALL_RIGHT} THEN max(turn) ELSE 7 END AS score FROM games_tie{_tie} GROUP BY answer) s", f"tie{_tie}")
SCORES = f"SELECT answer, CASE WHEN max(CASE WHEN code = {ALL_RIGHT} THEN 1 ELSE 0 END) = 1 THEN max(turn) ELSE {G.FAILED} END AS score FROM games_{{r}} GROUP BY answer"
E = SCORES.format(r="expected")
same("solver_summary", f"SELECT count(*) AS games, round(avg(CASE WHEN score < 7 THEN score * 1.0e0 END), 6) AS mean_solved, round(avg(score * 1.0e0), 6) AS mean_score, round(stddev_samp(score), 6) AS std, min(score) AS best, max(score) AS worst, CAST(sum(CASE WHEN score = 7 THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM ({E}) s", "expected")
same("guess_distribution", f"SELECT score, count(*) AS games, round(sum(count(*)) OVER (ORDER BY score) * 100.0e0 / sum(count(*)) OVER (), 6) AS cumulative_pct FROM ({E}) s GROUP BY score", "expected")
same("candidate_trajectory", "SELECT turn, count(*) AS games, round(avg(n_before * 1.0e0), 6) AS mean_n, CAST(median(n_before) AS DOUBLE) AS median_n, max(n_before) AS max_n, round(avg(log2(n_before)), 6) AS mean_bits FROM games_expected GROUP BY turn", "expected")
same("trajectory_steps", "SELECT answer, turn, guess, code, n_before, round(log2(n_before), 4) AS bits_remaining, turn + 0 AS step, max(turn) OVER (PARTITION BY answer) - turn AS turns_after FROM games_expected", "expected")
same("determinism_check", "SELECT count(*) AS states, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM (SELECT state, count(DISTINCT guess) AS k FROM games_expected GROUP BY state) s", "expected")
same("hard_mode_violations", "SELECT b.answer, b.turn, count(*) AS dropped FROM games_expected a JOIN games_expected b ON a.answer = b.answer AND a.turn < b.turn WHERE " + " OR ".join(f"(CAST(floor(a.code / {3.0**i}) AS INT) % 3 = 2 AND substr(a.guess, {i + 1}, 1) <> substr(b.guess, {i + 1}, 1))" for i in range(5)) + " GROUP BY b.answer, b.turn", "expected")
P = f"SELECT a.score - b.score AS d FROM ({SCORES.format(r='entropy')}) a JOIN ({E}) b ON a.answer = b.answer"
same("paired_t_solvers", f"SELECT count(*) AS n, round(avg(d * 1.0e0), 6) AS mean_d, round(stddev_samp(d), 6) AS sd, round(avg(d * 1.0e0) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, CAST(sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS BIGINT) AS better, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS worse, round(power(1.96e0 * stddev_samp(d) / 0.05e0, 2), 4) AS needed FROM ({P}) p", "entropy", "expected")
same("policy_disagreement", "SELECT a.state, a.guess AS first_guess, b.guess AS second_guess FROM (SELECT DISTINCT state, guess FROM games_entropy) a JOIN (SELECT DISTINCT state, guess FROM games_expected) b ON a.state = b.state WHERE a.guess <> b.guess", "entropy", "expected")


@query(G.base_oracle() + ", " + G.games_oracle("expected") + f" SELECT state, count(*) FILTER (WHERE s = 'train') AS train, count(*) FILTER (WHERE s = 'val') AS val FROM (SELECT state, {SPLIT.format(k='answer')} AS s FROM games) GROUP BY state")
def state_reach_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.games(spark, sf_dir, "expected").withColumn("s", split_of(F.col("answer")))
    return g.groupBy("state").agg(F.count_if(F.col("s") == "train").alias("train"), F.count_if(F.col("s") == "val").alias("val"))


@query(G.base_oracle() + ", " + G.games_oracle("expected") + f""" SELECT answer, turn, 'Turn ' || turn || ' of 6' || coalesce(string_agg(chr(10) || upper(prev) || ' ' || {code_to_pattern('pcode')}, '' ORDER BY pturn), '') AS prompt
    FROM (SELECT b.answer, b.turn, a.guess AS prev, a.code AS pcode, a.turn AS pturn FROM games b LEFT JOIN games a ON a.answer = b.answer AND a.turn < b.turn) x GROUP BY answer, turn""".replace("upper(prev) || ' ' || concat(", "upper(prev) || ' ' || concat("))
def prompt_raw_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.games(spark, sf_dir, "expected").withColumn("line", F.concat(F.lit("\n"), F.upper("guess"), F.lit(" "), F.expr(code_to_pattern("code"))))
    past = Window.partitionBy("answer").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return g.select("answer", "turn", F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit(" of 6"), F.array_join(F.collect_list("line").over(past), "")).alias("prompt"))


# -- splits, datasets and audits ----------------------------------------------------------------------------------


@query(f"SELECT doc_id, {SPLIT.format(k='CAST(doc_id AS VARCHAR)')} AS split, 'd-' || substr(sha256(source || '|' || CAST(doc_id AS VARCHAR)), 1, 14) AS opaque FROM documents")
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return read_table(spark, sf_dir, "documents").select("doc_id", split_of(key).alias("split"), opaque_id("d-", F.col("source"), key).alias("opaque"))


@query(f"WITH d AS (SELECT text, {SPLIT.format(k='CAST(doc_id AS VARCHAR)')} AS split FROM documents) SELECT count(*) AS val_rows, count(*) FILTER (WHERE text IN (SELECT text FROM d WHERE split = 'train')) AS leaked FROM d WHERE split = 'val'")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select(F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("text"), split_of(F.col("doc_id").cast("string")).alias("split"))
    seen = d.groupBy("h", "text").agg(F.count_if(F.col("split") == "val").alias("v"), F.count_if(F.col("split") == "train").alias("t"))
    return seen.agg(F.sum("v").alias("val_rows"), F.coalesce(F.sum(F.when(F.col("t") > 0, F.col("v"))), F.lit(0)).alias("leaked"))


NEXT = "SELECT conv_id, turn, role, text AS prompt, lead(text) OVER w AS completion, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("prompt"), F.lead("text").over(w).alias("completion"), F.lead("role").over(w).alias("next_role"))
    return c.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", "prompt", "completion")


@query(f"SELECT conv_id, turn, prompt, completion FROM ({NEXT}) WHERE role = 'user' AND next_role = 'assistant'")
def conversation_sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchanges(spark, sf_dir)


@query("WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY sha256('mix|' || CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY toxic) AS n FROM labels) SELECT doc_id, toxic, CAST(k AS BIGINT) AS copy FROM r, (SELECT unnest([1, 2]) AS k) WHERE (toxic = 1) OR (k = 1 AND rn <= round(n * 0.25e0))")
def weighted_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic rows twice and a hash-drawn quarter of the others; ranks are counted per hash prefix, so no label is one task."""
    x = read_table(spark, sf_dir, "labels").select("doc_id", "toxic", F.sha2(F.concat(F.lit("mix|"), F.col("doc_id").cast("string")), 256).alias("h"))
    x = x.withColumn("cell", F.substring("h", 1, 2))
    cells = x.groupBy("toxic", "cell").agg(F.count("*").alias("c"))
    w = Window.partitionBy("toxic")
    cells = cells.select("toxic", "cell", (F.sum("c").over(w.orderBy("cell")) - F.col("c")).alias("before"), F.sum("c").over(w).alias("n"))
    ranked = x.withColumn("rn", F.row_number().over(Window.partitionBy("toxic", "cell").orderBy("h", "doc_id"))).join(cells, ["toxic", "cell"])
    copies = F.when(F.col("toxic") == 1, F.sequence(F.lit(1), F.lit(2))).when(F.col("before") + F.col("rn") <= F.round(F.col("n") * 0.25e0), F.array(F.lit(1)))
    return ranked.select("doc_id", "toxic", F.explode(copies).alias("copy")).withColumn("copy", F.col("copy").cast("long"))


@query(r"""WITH q AS (SELECT item_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}]+'))) AS word FROM benchmark),
    d AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS word FROM documents)
    SELECT item_id, count(*) AS words, count(d.word) AS seen FROM q LEFT JOIN d USING (word) WHERE q.word <> '' GROUP BY item_id""")
def benchmark_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = tokens(read_table(spark, sf_dir, "benchmark"), "item_id").distinct().withColumnRenamed("doc_id", "item_id")
    d = tokens(read_table(spark, sf_dir, "documents")).select("word").distinct().withColumn("hit", F.lit(1))
    return q.join(d, "word", "left").groupBy("item_id").agg(F.count("*").alias("words"), F.count("hit").alias("seen"))


@query("SELECT sha256(text) AS text_sha, doc_id FROM (SELECT text, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def doc_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text; texts are told apart by their digests, so none of them moves."""
    return read_table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_sha")).agg(F.min("doc_id").alias("doc_id"))


@query("SELECT l.doc_id, l.quality, l.toxic, d.doc_id IS NULL AS unresolved FROM labels l LEFT JOIN documents d USING (doc_id)")
def label_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("hit"))
    return read_table(spark, sf_dir, "labels").join(d, "doc_id", "left").select("doc_id", "quality", "toxic", F.col("hit").isNull().alias("unresolved"))


# -- scored selection and learning arithmetic ---------------------------------------------------------------------

STATE = "vec_id // 10"
DOT = "list_sum(list_transform(embedding[1:4], lambda x: x::DOUBLE))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state, word, score, allowed: ten actions a state, scored by a sum of coordinates."""
    e = read_table(spark, sf_dir, "embeddings")
    total = F.aggregate(F.slice("embedding", 1, 4), F.lit(0.0e0), lambda a, x: a + x.cast("double"))
    return e.select(F.floor(F.col("vec_id") / 10).alias("state"), F.col("vec_id").alias("word"), F.round(total, 6).alias("score"), (F.col("vec_id") % 3 != 0).alias("allowed"))


SCORED = f"(SELECT {STATE} AS state, vec_id AS word, round({DOT}, 6) AS score, vec_id % 3 <> 0 AS allowed FROM embeddings)"


@query(f"SELECT state, word, score, round(score - runner_up, 6) AS margin FROM (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS runner_up FROM {SCORED} WHERE allowed WINDOW w AS (PARTITION BY state ORDER BY score DESC, word)) WHERE rn = 1")
def masked_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("state").orderBy(F.desc("score"), "word")
    x = scored(spark, sf_dir).where("allowed").withColumn("rn", F.row_number().over(w)).withColumn("runner_up", F.lead("score").over(w))
    return x.where("rn = 1").select("state", "word", "score", F.round(F.col("score") - F.col("runner_up"), 6).alias("margin"))


@query(f"SELECT state, word, CAST(row_number() OVER (PARTITION BY state ORDER BY score DESC, word) AS BIGINT) AS place, CAST(row_number() OVER (PARTITION BY state, allowed ORDER BY score DESC, word) AS BIGINT) AS place_allowed FROM {SCORED}")
def score_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = (F.desc("score"), "word")
    return scored(spark, sf_dir).select("state", "word", F.row_number().over(Window.partitionBy("state").orderBy(*order)).cast("long").alias("place"), F.row_number().over(Window.partitionBy("state", "allowed").orderBy(*order)).cast("long").alias("place_allowed"))


@query(f"WITH p AS (SELECT *, exp(score - max(score) OVER (PARTITION BY state)) AS x FROM {SCORED}), q AS (SELECT *, x / sum(x) OVER (PARTITION BY state) AS p FROM p) SELECT state, word, round(p, 6) AS p, round(score - sum(p * score) OVER (PARTITION BY state), 6) AS advantage FROM q")
def softmax_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("state")
    x = scored(spark, sf_dir).withColumn("x", F.exp(F.col("score") - F.max("score").over(w)))
    q = x.withColumn("p", F.col("x") / F.sum("x").over(w))
    return q.select("state", "word", F.round("p", 6).alias("p"), F.round(F.col("score") - F.sum(F.col("p") * F.col("score")).over(w), 6).alias("advantage"))


@query("SELECT user_id, event_id, CAST(row_number() OVER w AS BIGINT) AS step, CAST(count(*) OVER (PARTITION BY user_id) - row_number() OVER w AS BIGINT) AS steps_after, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def event_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return e.select("user_id", "event_id", F.row_number().over(w).cast("long").alias("step"), (F.count("*").over(Window.partitionBy("user_id")) - F.row_number().over(w)).cast("long").alias("steps_after"), F.lag("event_type").over(w).alias("before"))
