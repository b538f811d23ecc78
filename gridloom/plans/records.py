"""Training records of played games: packages, contrasts, mixtures, summaries, round trips, audits, decoders and probes.

A record is a state's prompt and the move that a policy made in it. Audits run on the records as they are and on a copy
with faults planted by a hash of the id, so every check is seen to find something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.feedback import ALL_RIGHT, checked_code, code_to_pattern
from gridloom.functions.hashing import opaque_id, split_of
from gridloom.plans import games as G
from gridloom.plans import prompts as P
from gridloom.plans.lists import SCORE, _SMALL, adaptive_oracle, consistent_words, exact_adaptive_values, list_games, list_games_oracle, lists_oracle, scores, tables
from gridloom.plans.queries import SPLIT, query
from gridloom.session import read_table, scratch_table

TEACHERS = ("full", "restricted")
#: Letters of the prompts' own words say nothing about a game; a leak is the answer as a word of the text.
LINE = r"  [0-9]+\. ([A-Z]{5}) -> ([BYG]{5})"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, solver, answer, turn, state, code, prompt, completion, n, n_adm, adm, isc, bits, gain, split."""

    def make() -> DataFrame:
        out = None
        for name in TEACHERS:
            games = list_games(spark, sf_dir, name)
            games.createOrReplaceTempView(f"lg_{name}")
            texts = spark.sql(P.prompts(f"lg_{name}", True, ("baseline",))).select("answer", "turn", "prompt")
            after = F.count("*").over(Window.partitionBy("state", "code"))
            own = games.withColumn("after", after).join(texts, ["answer", "turn"]).withColumn("solver", F.lit(name))
            out = own if out is None else out.unionByName(own)
        bits = F.log2("n_before")
        made = out.select(
            opaque_id("sft-", F.col("solver"), F.col("answer"), F.col("turn").cast("string")).alias("id"), "solver", "answer", "turn", "state", "code", "prompt", F.upper("guess").alias("completion"), F.col("n_before").alias("n"),
            "n_adm", "adm", "isc", F.round(bits, 4).alias("bits"), F.round(bits - F.log2("after"), 4).alias("gain"), split_of(F.col("answer")).alias("split"),
        )
        return scratch_table(made, "records")

    return G.kept(spark, sf_dir, "records", make)


def _records_oracle() -> str:
    each = [
        f"""SELECT 'sft-' || substr(sha256('{t}|' || g.answer || '|' || g.turn), 1, 14) AS id, '{t}' AS solver, g.answer, g.turn, g.state, g.code, p.prompt, upper(g.guess) AS completion, g.n_before AS n, g.n_adm, g.adm, g.isc, round(log2(g.n_before), 4) AS bits,
        round(log2(g.n_before) - log2(count(*) OVER (PARTITION BY g.state, g.code)), 4) AS gain, {SPLIT.format(k='g.answer')} AS split FROM lg_{t} g JOIN (SELECT * FROM ({P.prompts(f'lg_{t}', False)}) WHERE variant = 'baseline') p ON p.answer = g.answer AND p.turn = g.turn"""
        for t in TEACHERS
    ]
    return lists_oracle() + ", " + ", ".join(list_games_oracle(t, f"lg_{t}") for t in TEACHERS) + ", rec AS MATERIALIZED (" + " UNION ALL ".join(each) + ")"


REC = _records_oracle()


@query(REC + ", d AS (SELECT *, count(*) FILTER (WHERE split = 'train') OVER (PARTITION BY prompt, completion) AS duplicates FROM rec) SELECT id, solver, turn, sha256(prompt) AS prompt_sha, completion, n, bits, gain, isc = 1 AS possible, split, duplicates FROM d")
def sft_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.count_if(F.col("split") == "train").over(Window.partitionBy("prompt_sha", "completion"))
    r = records(spark, sf_dir).select("id", "solver", "turn", F.sha2("prompt", 256).alias("prompt_sha"), "completion", "n", "bits", "gain", (F.col("isc") == 1).alias("possible"), "split")
    return r.withColumn("duplicates", same)


@query(REC + " SELECT solver, split, count(*) AS records, count(DISTINCT prompt || '@' || completion) AS pairs, round(count(*) * 1.0 / count(DISTINCT prompt || '@' || completion), 6) AS factor FROM rec GROUP BY ALL")
def record_duplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.countDistinct("prompt", "completion")
    return records(spark, sf_dir).groupBy("solver", "split").agg(F.count("*").alias("records"), pairs.alias("pairs"), F.round(F.count("*") / pairs, 6).alias("factor"))


def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state, full, restricted (their moves where they differ; of a state's records the last by id), and reach by split."""
    r = records(spark, sf_dir)
    last = r.groupBy("state", "solver").agg(F.max_by("completion", "id").alias("completion"))
    sides = [last.where(F.col("solver") == t).select("state", F.col("completion").alias(t)) for t in TEACHERS]
    both = sides[0].join(sides[1], "state").where(F.col(TEACHERS[0]) != F.col(TEACHERS[1]))
    reach = r.groupBy("state").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"))
    return both.join(reach, "state")


CONTRAST = f"""last AS (SELECT state, solver, arg_max(completion, id) AS completion FROM rec GROUP BY ALL), con AS (SELECT a.state, a.completion AS "full", b.completion AS restricted, r.train, r.val FROM last a JOIN last b ON a.state = b.state AND a.solver = 'full' AND b.solver = 'restricted' AND a.completion <> b.completion
    JOIN (SELECT state, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val FROM rec GROUP BY state) r ON r.state = a.state)"""


@query(f"{REC}, {CONTRAST} SELECT * FROM con")
def contrast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrasts(spark, sf_dir)


@query(f"{REC}, {CONTRAST} SELECT r.id, r.solver, r.state, r.completion FROM rec r JOIN con c ON c.state = r.state WHERE c.val = 0 AND r.split = 'train'")
def oversampling_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records of states where the teachers differ and that no validation game reaches."""
    c = contrasts(spark, sf_dir)
    reached = c.where("val > 0").select("state")
    return records(spark, sf_dir).where("split = 'train'").join(c.select("state"), "state", "left_semi").join(reached, "state", "left_anti").select("id", "solver", "state", "completion")


#: A mixture: components as (records of a teacher, or the pool; how often), the seed of draws and of the order.
RECIPE = {"seed": "mix-1", "dedup": True, "shuffle": True, "components": (("full", 1.5), ("restricted", 1.0), ("pool", 2.25))}


def mixture(sources: dict[str, DataFrame], recipe: dict) -> DataFrame:
    """sources: id, prompt_sha, completion. Whole repeats, and the rows of least hash for the fraction; with dedup the first
    of equal pairs stays; the order is one of hashes."""
    out = None
    for place, (name, times) in enumerate(recipe["components"]):
        src, whole = sources[name].select("id", "prompt_sha", "completion"), int(times)
        wanted = src.crossJoin(src.agg(F.round(F.count("*") * (times - whole)).cast("long").alias("more")))  # one row
        h = F.sha2(F.concat(F.lit(f"{recipe['seed']}|{name}|"), "id"), 256)
        cell = wanted.withColumn("h", h).withColumn("cell", F.substring("h", 1, 2))
        sizes = cell.groupBy("cell").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.orderBy("cell")) - F.col("c")).drop("c")  # 256 rows at most
        ranked = cell.withColumn("rn", F.row_number().over(Window.partitionBy("cell").orderBy("h", "id"))).join(F.broadcast(sizes), "cell")
        copies = F.lit(whole) + (F.col("before") + F.col("rn") <= F.col("more")).cast("int")
        own = ranked.withColumn("copies", copies).where("copies > 0").select("id", "prompt_sha", "completion", F.lit(place).alias("part"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        out = own if out is None else out.unionByName(own)
    if recipe["dedup"]:
        out = out.groupBy("prompt_sha", "completion").agg(F.min(F.struct("part", "copy", "id")).alias("x")).select("x.id", "prompt_sha", "completion", "x.part", "x.copy")
    order = F.sha2(F.concat_ws("|", F.lit(recipe["seed"]), "id", F.col("part").cast("string"), F.col("copy").cast("string")), 256) if recipe["shuffle"] else F.format_string("%03d|%s", "part", "id")
    return out.select("id", "part", "copy", order.alias("order_key"))


_MIXED = " UNION ALL ".join(
    f"SELECT id, prompt_sha, completion, {k} AS part, unnest(range(1, {int(t)} + 1 + CASE WHEN rn <= round(n * {t - int(t)}) THEN 1 ELSE 0 END)) AS copy FROM (SELECT *, row_number() OVER (ORDER BY sha256('mix-1|{s}|' || id), id) AS rn, count(*) OVER () AS n FROM {'pool' if s == 'pool' else f'''(SELECT * FROM src WHERE solver = '{s}')'''}) q"
    for k, (s, t) in enumerate(RECIPE["components"])
)


@query(f"""{REC}, {CONTRAST}, src AS (SELECT id, solver, state, sha256(prompt) AS prompt_sha, completion, split FROM rec), pool AS (SELECT s.* FROM src s JOIN con c ON c.state = s.state WHERE c.val = 0 AND split = 'train'), mixed AS ({_MIXED})
    SELECT id, part, CAST(copy AS INT) AS copy, sha256('mix-1|' || id || '|' || part || '|' || copy) AS order_key FROM mixed QUALIFY row_number() OVER (PARTITION BY prompt_sha, completion ORDER BY part, copy, id) = 1""")
def weighted_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("prompt_sha", F.sha2("prompt", 256))
    pool = r.join(oversampling_pool(spark, sf_dir).select("id"), "id", "left_semi")
    return mixture({**{t: r.where(F.col("solver") == t) for t in TEACHERS}, "pool": pool}, RECIPE)


# -- summaries ----------------------------------------------------------------------------------------------------


@query(f"""{REC}, s AS ({" UNION ALL ".join(f"SELECT '{t}' AS solver, answer, score FROM ({SCORE.format(g=f'lg_{t}')})" for t in TEACHERS)}), gs AS (SELECT solver, count(*) AS n_games, round(avg(score), 4) AS mean_guesses, sum(score)::BIGINT AS total_guesses, count(*) FILTER (WHERE score < 7) AS solved, count(*) FILTER (WHERE score = 7) AS failed FROM s GROUP BY solver)
    SELECT solver, n_games, mean_guesses, total_guesses, solved, failed, n_steps, steps_train, steps_val, possible_pct, mean_gain FROM gs JOIN (SELECT solver, count(*) AS n_steps, count(*) FILTER (WHERE split = 'train') AS steps_train, count(*) FILTER (WHERE split = 'val') AS steps_val, round(100.0 * count(*) FILTER (WHERE lower(completion) IN (SELECT answer FROM answers)) / count(*), 2) AS possible_pct, round(avg(gain), 4) AS mean_gain FROM rec GROUP BY solver) USING (solver)""")
def trajectory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, answers, _ = tables(spark, sf_dir)
    r = records(spark, sf_dir).join(answers.select(F.upper("answer").alias("completion"), F.lit(1).alias("possible")), "completion", "left")
    steps = r.groupBy("solver").agg(F.count("*").alias("n_steps"), F.count_if(F.col("split") == "train").alias("steps_train"), F.count_if(F.col("split") == "val").alias("steps_val"), F.round(F.lit(100.0) * F.count("possible") / F.count("*"), 2).alias("possible_pct"), F.round(F.avg("gain"), 4).alias("mean_gain"))
    s = None
    for t in TEACHERS:
        own = scores(list_games(spark, sf_dir, t)).withColumn("solver", F.lit(t))
        s = own if s is None else s.unionByName(own)
    games = s.groupBy("solver").agg(F.count("*").alias("n_games"), F.round(F.avg("score"), 4).alias("mean_guesses"), F.sum("score").alias("total_guesses"), F.count_if(F.col("score") < 7).alias("solved"), F.count_if(F.col("score") == 7).alias("failed"))
    return games.join(steps, "solver")


# The bands that reports use, by the number of words left.
BANDS = {
    "endgame": ((1, 1, "1"), (2, 2, "2"), (3, 3, "3"), (4, 10, "4-10")),
    "pairs": ((2, 3, "2-3"), (4, 10, "4-10"), (11, 30, "11-30"), (31, 100, "31-100"), (101, 300, "101-300"), (301, None, "300+")),
    "headroom": ((2, 10, "2-10"), (11, 100, "11-100"), (101, None, "100+")),
    "budget": ((None, 1, "0-1_forced"), (2, 10, "2-10"), (11, 20, "11-20"), (21, 100, "21-100"), (101, None, "100+")),
    "report": ((1, 1, "1"), (2, 2, "2"), (3, 3, "3"), (4, 10, "4-10"), (11, None, ">10")),
}


def band(n: Column, name: str) -> Column:
    out = F.when(F.lit(False), "")
    for low, high, label in BANDS[name]:
        out = out.when((n >= low if low is not None else F.lit(True)) & (n <= high if high is not None else F.lit(True)), label)
    return out


def band_sql(n: str, name: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} >= {low if low is not None else -1} AND {n} <= {high if high is not None else 1 << 40} THEN '{label}'" for low, high, label in BANDS[name]) + " END"


@query(REC + ", s AS (SELECT DISTINCT solver, state, n_adm FROM rec) " + " UNION ALL ".join(f"SELECT '{b}' AS bands, {band_sql('n_adm', b)} AS band, count(*) AS states, sum(n_adm)::BIGINT AS words FROM s GROUP BY 2" for b in BANDS))
def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States by the number of admissible words, in each set of bands; null: outside all bands."""
    s = records(spark, sf_dir).select("solver", "state", "n_adm").distinct()
    each = s.select("n_adm", F.explode(F.array(*[F.struct(F.lit(b).alias("bands"), band(F.col("n_adm"), b).alias("band")) for b in BANDS])).alias("x"))
    return each.groupBy("x.bands", "x.band").agg(F.count("*").alias("states"), F.sum("n_adm").alias("words"))


@query(f"{REC}, e AS (SELECT DISTINCT {band_sql('n', 'report')} AS band, state, completion, solver FROM rec), c AS (SELECT band, completion, count(*) AS k FROM e GROUP BY ALL) SELECT band, sum(k)::BIGINT AS rows_, count(*) AS words, round(sum(k) * 1.0 / count(*), 6) AS paths_per_word, round(100.0 * max(k) / sum(k), 6) AS top_share FROM c GROUP BY band")
def dataset_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct states by candidates left: words named, paths that lead to a word, share of the commonest."""
    e = records(spark, sf_dir).select(band(F.col("n"), "report").alias("band"), "state", "completion", "solver").distinct()
    c = e.groupBy("band", "completion").agg(F.count("*").alias("k"))
    return c.groupBy("band").agg(F.sum("k").alias("rows_"), F.count("*").alias("words"), F.round(F.sum("k") / F.count("*"), 6).alias("paths_per_word"), F.round(F.lit(100.0) * F.max("k") / F.sum("k"), 6).alias("top_share"))


@query(REC + ", q AS (SELECT answer, max(score) FILTER (WHERE s = 'full') - max(score) FILTER (WHERE s = 'restricted') AS d FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS s, answer, score FROM ({SCORE.format(g=f'lg_{t}')})" for t in TEACHERS) + ") GROUP BY answer) SELECT delta, round(stddev_samp(d), 6) AS sd, ceil(power(1.96 * stddev_samp(d) / delta, 2))::BIGINT AS games FROM q, (SELECT unnest([0.02, 0.05, 0.1]::DOUBLE[]) AS delta) GROUP BY delta")
def required_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games that tell a mean difference of delta from none at 95 %, from the spread of paired differences."""
    a, b = (scores(list_games(spark, sf_dir, t)).withColumnRenamed("score", t) for t in TEACHERS)
    d = a.join(b, "answer").select((F.col("full") - F.col("restricted")).alias("d"), F.explode(F.array(F.lit(0.02), F.lit(0.05), F.lit(0.1))).alias("delta"))
    sd = F.stddev_samp("d")
    return d.groupBy("delta").agg(F.round(sd, 6).alias("sd"), F.ceil(F.pow(F.lit(1.96) * sd / F.col("delta"), F.lit(2.0))).cast("long").alias("games"))


@query(REC + ", s AS (" + " UNION ALL ".join(f"SELECT '{t}' AS s, answer, score <= 4 AS hit FROM ({SCORE.format(g=f'lg_{t}')})" for t in TEACHERS) + """), p AS (SELECT answer, bool_or(hit) FILTER (WHERE s = 'full') AS a, bool_or(hit) FILTER (WHERE s = 'restricted') AS b FROM s GROUP BY answer),
    c AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS only_full, count(*) FILTER (WHERE b AND NOT a) AS only_restricted, count(*) AS games FROM p)
    SELECT *, round(least(1.0, 2 * (SELECT coalesce(sum(exp(lgamma(only_full + only_restricted + 1) - lgamma(k + 1) - lgamma(only_full + only_restricted - k + 1) - (only_full + only_restricted) * ln(2))), 0) FROM (SELECT unnest(range(0, least(only_full, only_restricted) + 1)) AS k))), 6) AS p FROM c""")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games won within four guesses by one policy only, and the exact two-sided p of that split."""
    a, b = (scores(list_games(spark, sf_dir, t)).select("answer", (F.col("score") <= 4).alias(t)) for t in TEACHERS)
    c = a.join(b, "answer").agg(F.count_if(F.col("full") & ~F.col("restricted")).alias("only_full"), F.count_if(F.col("restricted") & ~F.col("full")).alias("only_restricted"), F.count("*").alias("games"))
    n, least = F.col("only_full") + F.col("only_restricted"), F.least("only_full", "only_restricted")
    # terms of the binomial, each from the one before
    start = F.struct(F.pow(F.lit(0.5), n.cast("double")).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda acc, k: F.struct((acc["term"] * (n - k).cast("double") / (k + 1).cast("double")).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), least), start, step)["sum"]
    return c.withColumn("p", F.round(F.least(F.lit(1.0), tail * 2), 6))


@query(f"SELECT coalesce(a.split, 'none') AS before, coalesce(b.split, 'none') AS after, count(*) AS words FROM (WITH {G.VOCAB_ORACLE} SELECT word, {SPLIT.format(k='word')} AS split FROM vocab WHERE documents >= 2) a FULL JOIN (WITH {G.VOCAB_ORACLE} SELECT word, {SPLIT.format(k='word').replace('0.1e0', '0.2e0')} AS split FROM vocab WHERE uses >= 3) b USING (word) GROUP BY ALL")
def split_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two settings' splits beside each other: words of one of them only, and words that change sides."""
    v = G.table(spark, sf_dir, "vocab")
    a = v.where("documents >= 2").select("word", split_of(F.col("word")).alias("before"))
    b = v.where("uses >= 3").select("word", split_of(F.col("word"), 0.2).alias("after"))
    return a.join(b, "word", "full").groupBy(F.coalesce("before", F.lit("none")).alias("before"), F.coalesce("after", F.lit("none")).alias("after")).agg(F.count("*").alias("words"))


@query(REC + ", held AS (SELECT DISTINCT state FROM rec WHERE split = 'val'), t AS (SELECT * FROM rec WHERE split = 'train') SELECT solver, count(*) AS train, count(*) FILTER (WHERE state IN (SELECT state FROM held)) AS in_held_states, count(*) FILTER (WHERE lower(completion) IN (SELECT answer FROM rec WHERE split = 'val')) AS name_held_answers, count(*) FILTER (WHERE state NOT IN (SELECT state FROM held) AND lower(completion) NOT IN (SELECT answer FROM rec WHERE split = 'val')) AS stay FROM t GROUP BY solver")
def holdout_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records that go because a validation game reaches their state or their move is a held-out answer."""
    r = records(spark, sf_dir)
    val = r.where("split = 'val'")
    t = r.where("split = 'train'").join(val.select("state").distinct().withColumn("in_state", F.lit(True)), "state", "left")
    t = t.join(val.select(F.upper("answer").alias("completion")).distinct().withColumn("named", F.lit(True)), "completion", "left")
    a, b = F.coalesce("in_state", F.lit(False)), F.coalesce("named", F.lit(False))
    return t.groupBy("solver").agg(F.count("*").alias("train"), F.count_if(a).alias("in_held_states"), F.count_if(b).alias("name_held_answers"), F.count_if(~a & ~b).alias("stay"))


@query(REC + ", h AS (SELECT answer, row_number() OVER (ORDER BY sha256('subset-7|' || answer), answer) AS rn FROM answers), s AS (SELECT answer, row_number() OVER (ORDER BY answer) AS place FROM h WHERE rn <= 60) SELECT answer, place, (place - 1) % 4 = 0 AS strided, (SELECT count(*) FROM rec r WHERE r.answer = s.answer AND turn >= 2 AND n >= 3) AS wide_steps FROM s")
def fixed_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty answers of the least hashes in order, every fourth marked, and how many of their later steps are wide."""
    _, _, answers, _ = tables(spark, sf_dir)
    drawn = answers.orderBy(F.sha2(F.concat(F.lit("subset-7|"), "answer"), 256), "answer").limit(60)
    placed = drawn.withColumn("place", F.row_number().over(Window.orderBy("answer")).cast("long"))  # sixty rows
    wide = records(spark, sf_dir).where("turn >= 2 AND n >= 3").groupBy("answer").agg(F.count("*").alias("k"))
    return placed.join(wide, "answer", "left").select("answer", "place", ((F.col("place") - 1) % 4 == 0).alias("strided"), F.coalesce("k", F.lit(0)).alias("wide_steps"))


@query(REC + ", c AS (SELECT state FROM (SELECT state, count(DISTINCT completion) AS k FROM rec GROUP BY state) WHERE k > 1) SELECT id, n, turn, completion FROM rec WHERE turn >= 2 AND n >= 4 AND state IN (SELECT state FROM c) ORDER BY n DESC, id LIMIT 25")
def widest_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with most candidates among later ones in states that the teachers treat differently."""
    r = records(spark, sf_dir)
    differ = r.groupBy("state").agg(F.countDistinct("completion").alias("k")).where("k > 1").select("state")
    return r.where("turn >= 2 AND n >= 4").join(differ, "state", "left_semi").orderBy(F.desc("n"), "id").limit(25).select("id", "n", "turn", "completion")


# -- prompts read back --------------------------------------------------------------------------------------------


def history_of(prompt: Column) -> Column:
    """array of (guess, pattern) that a prompt's history lists."""
    return F.arrays_zip(F.regexp_extract_all(prompt, F.lit(LINE), F.lit(1)).alias("guess"), F.regexp_extract_all(prompt, F.lit(LINE), F.lit(2)).alias("pattern"))


SHOWN = ("baseline", "raw_history", "keyboard", "hard_mode_hint")
_VARIANTS = ", ".join(f"'{v}'" for v in SHOWN)


@query(f"""{REC}, p AS (SELECT * FROM ({P.prompts('lg_full', False)}) WHERE variant IN ({_VARIANTS})), x AS (SELECT *, regexp_extract_all(prompt, '{LINE}', 1) AS gs, regexp_extract_all(prompt, '{LINE}', 2) AS ps, CAST(regexp_extract(prompt, 'Guess ([0-9]+) of', 1) AS INT) AS shown, CAST(regexp_extract(prompt, '\\(([0-9]+) remaining\\)', 1) AS INT) AS rest FROM p),
    y AS (SELECT *, CASE WHEN len(gs) = 0 THEN 'History: (none - this is the opening guess)' ELSE 'History:' || chr(10) || array_to_string(list_transform(range(1, len(gs) + 1), lambda i: '  ' || i || '. ' || gs[i] || ' -> ' || ps[i]), chr(10)) || chr(10) END AS again FROM x)
    SELECT variant, count(*) AS prompts, count(*) FILTER (WHERE len(gs) <> turn - 1) AS unparsed, count(*) FILTER (WHERE shown <> turn OR rest <> 7 - turn) AS wrong_turn, count(*) FILTER (WHERE position(again IN prompt) = 0) AS not_round, max(len(gs))::BIGINT AS longest FROM y GROUP BY variant""")
def prompt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories parsed from prompts and rendered again must stand in the prompts as they are."""
    list_games(spark, sf_dir, "full").createOrReplaceTempView("lg_full")
    p = spark.sql(P.prompts("lg_full", True, SHOWN)).withColumn("h", history_of(F.col("prompt")))
    lines = F.array_join(F.transform("h", lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x["guess"], F.lit(" -> "), x["pattern"])), "\n")
    again = F.when(F.size("h") == 0, P.NO_HISTORY).otherwise(F.concat(F.lit("History:\n"), lines, F.lit("\n")))
    shown, rest = (F.regexp_extract("prompt", x, 1).cast("int") for x in (r"Guess ([0-9]+) of", r"\(([0-9]+) remaining\)"))
    return p.groupBy("variant").agg(F.count("*").alias("prompts"), F.count_if(F.size("h") != F.col("turn") - 1).alias("unparsed"), F.count_if((shown != F.col("turn")) | (rest != 7 - F.col("turn"))).alias("wrong_turn"), F.count_if(F.locate("x", F.lit("")) + F.instr(F.col("prompt"), again) == 0).alias("not_round"), F.max(F.size("h")).cast("long").alias("longest"))


#: Faults by the first hex digit of a hash of the id: a wrong count, a leak, a wrong turn, an illegal move, an id twice.
PLANTED_SQL = "SELECT solver, answer, CASE WHEN d = '4' THEN 'same' ELSE id END AS id, CASE WHEN d = '2' THEN turn + 1 ELSE turn END AS turn, CASE WHEN d = '1' THEN prompt || ' ' || upper(answer) ELSE prompt END AS prompt, CASE WHEN d = '3' THEN 'ZZZZZ' ELSE completion END AS completion, CASE WHEN d = '0' THEN n + 1 ELSE n END AS n, state, split, isc, gain FROM (SELECT *, substr({sha}(concat('plant|', id){bits}), 1, 1) AS d FROM {rec}) x"


def with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records twice: as they are (tab clean) and with faults (tab planted)."""
    r = records(spark, sf_dir)
    d = F.substring(F.sha2(F.concat(F.lit("plant|"), "id"), 256), 1, 1)
    x = r.withColumn("d", d)
    on = lambda digit, then, name: F.when(F.col("d") == digit, then).otherwise(F.col(name)).alias(name)
    bad = x.select("solver", "answer", on("4", F.lit("same"), "id"), on("2", F.col("turn") + 1, "turn"), on("1", F.concat("prompt", F.lit(" "), F.upper("answer")), "prompt"), on("3", F.lit("ZZZZZ"), "completion"), on("0", F.col("n") + 1, "n"), "state", "split", "isc", "gain")
    return r.select(*bad.columns).withColumn("tab", F.lit("clean")).unionByName(bad.withColumn("tab", F.lit("planted")))


_TABS = "tab AS (SELECT 'clean' AS tab, * FROM (SELECT solver, answer, id, turn, prompt, completion, n, state, split, isc, gain FROM rec) UNION ALL SELECT 'planted' AS tab, * FROM (" + PLANTED_SQL.replace("{sha}", "sha256").replace("{bits}", "").replace("{rec}", "rec") + "))"


@query(f"""{REC}, {_TABS}, truth AS (SELECT solver, state, count(*) AS k FROM rec GROUP BY ALL), ids AS (SELECT tab, id, count(*) AS k FROM tab GROUP BY ALL), ps AS (SELECT tab, solver, prompt, count(DISTINCT completion) AS k FROM tab GROUP BY ALL)
    SELECT t.tab, count(*) AS records, count(*) FILTER (WHERE t.n <> truth.k) AS wrong_count, count(*) FILTER (WHERE list_contains(regexp_extract_all(t.prompt, '[A-Z]{{5}}'), upper(t.answer))) AS leaks, count(*) FILTER (WHERE CAST(regexp_extract(t.prompt, 'Guess ([0-9]+) of', 1) AS INT) <> t.turn) AS wrong_turn,
        count(*) FILTER (WHERE len(regexp_extract_all(t.prompt, '{LINE}', 1)) <> t.turn - 1) AS wrong_history, count(*) FILTER (WHERE lower(t.completion) NOT IN (SELECT word FROM vocab)) AS illegal, count(*) FILTER (WHERE ids.k > 1) AS repeated_ids, count(*) FILTER (WHERE ps.k > 1) AS contradictory,
        count(*) FILTER (WHERE NOT starts_with(t.prompt, 'You are playing')) AS other_preamble, count(*) FILTER (WHERE t.gain < 0) AS negative_gain
    FROM tab t JOIN truth USING (solver, state) JOIN ids ON ids.tab = t.tab AND ids.id = t.id JOIN ps ON ps.tab = t.tab AND ps.solver = t.solver AND ps.prompt = t.prompt GROUP BY t.tab""")
def record_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations by check, on the records and on the copy with planted faults."""
    t = with_faults(spark, sf_dir).withColumn("prompt_sha", F.sha2("prompt", 256))
    truth = records(spark, sf_dir).groupBy("solver", "state").agg(F.count("*").alias("k"))
    legal = G.table(spark, sf_dir, "vocab").select(F.upper("word").alias("completion"), F.lit(True).alias("legal"))
    t = t.join(truth, ["solver", "state"]).join(legal, "completion", "left")
    t = t.withColumn("same_id", F.count("*").over(Window.partitionBy("tab", "id")))
    told = t.groupBy("tab", "solver", "prompt_sha").agg(F.countDistinct("completion").alias("told"))
    t = t.join(told, ["tab", "solver", "prompt_sha"])
    lines = F.size(F.regexp_extract_all("prompt", F.lit(LINE), F.lit(1)))
    shown = F.regexp_extract("prompt", r"Guess ([0-9]+) of", 1).cast("int")
    leak = F.array_contains(F.regexp_extract_all("prompt", F.lit("([A-Z]{5})"), F.lit(1)), F.upper("answer"))
    checks = {
        "wrong_count": F.col("n") != F.col("k"), "leaks": leak, "wrong_turn": shown != F.col("turn"), "wrong_history": lines != F.col("turn") - 1, "illegal": F.col("legal").isNull(), "repeated_ids": F.col("same_id") > 1,
        "contradictory": F.col("told") > 1, "other_preamble": ~F.col("prompt").startswith("You are playing"), "negative_gain": F.col("gain") < 0,
    }
    return t.groupBy("tab").agg(F.count("*").alias("records"), *[F.count_if(c).alias(k) for k, c in checks.items()])


@query(f"""{REC}, {_TABS}, d AS (SELECT DISTINCT tab, solver, state, turn, prompt, n FROM tab WHERE turn >= 2), x AS (SELECT *, regexp_extract_all(prompt, '{LINE}', 1) AS gs, regexp_extract_all(prompt, '{LINE}', 2) AS ps FROM d),
    facts AS (SELECT tab, solver, state, turn, prompt, n, len(gs) AS k, lower(unnest(gs)) AS guess, unnest(ps) AS pattern FROM x), agree AS (SELECT f.tab, f.solver, f.state, f.turn, f.prompt, f.n, fba.answer FROM facts f JOIN fba ON fba.guess = f.guess AND {code_to_pattern('fba.code')} = f.pattern GROUP BY ALL HAVING count(*) = max(f.k)),
    c AS (SELECT tab, solver, state, turn, prompt, n, count(*) AS found FROM agree GROUP BY ALL) SELECT tab, count(*) AS prompts, count(*) FILTER (WHERE found <> n) AS wrong, sum(found)::BIGINT AS candidates FROM c GROUP BY tab""")
def prompt_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second opinion from the prompts' texts alone: histories parsed, candidates counted anew, against the records' counts."""
    _, _, answers, _ = tables(spark, sf_dir)
    d = with_faults(spark, sf_dir).where("turn >= 2").select("tab", "solver", "state", "turn", "prompt", "n").distinct()
    d = d.withColumn("key", F.concat_ws("|", "tab", "solver", "state", F.col("turn").cast("string"), F.sha2("prompt", 256), F.col("n").cast("string"))).withColumn("h", history_of(F.col("prompt")))
    each = d.select("key", F.size("h").alias("k"), F.explode("h").alias("x")).select("key", "k", F.lower("x.guess").alias("guess"), checked_code(F.col("x.pattern")).alias("code"))
    facts = each.select(F.col("key").alias("state"), F.col("k").alias("n"), "guess", "code")
    words = consistent_words(spark, sf_dir, facts).join(answers.withColumnRenamed("answer", "word"), "word", "left_semi").groupBy(F.col("state").alias("key")).agg(F.count("*").alias("found"))
    return d.join(words, "key").groupBy("tab").agg(F.count("*").alias("prompts"), F.count_if(F.col("found") != F.col("n")).alias("wrong"), F.sum("found").alias("candidates"))


#: Words that stand in the frame of every prompt.
@query(REC + r""", w AS (SELECT solver, answer, split, turn, unnest(list_distinct(regexp_extract_all(upper(regexp_replace(prompt, '\([^)]*\)', '', 'g')), '[A-Z]+'))) AS token FROM rec), frame AS (SELECT token FROM w WHERE turn = 1 GROUP BY token HAVING count(*) = (SELECT count(*) FROM rec WHERE turn = 1)),
    u AS (SELECT w.* FROM w WHERE token NOT IN (SELECT token FROM frame)), seen AS (SELECT DISTINCT token FROM u WHERE split = 'train')
    SELECT solver, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens, count(*) FILTER (WHERE length(token) = 5) AS words, count(*) FILTER (WHERE token = upper(answer)) AS own_answer, count(*) FILTER (WHERE split = 'val' AND token NOT IN (SELECT token FROM seen)) AS unseen_in_train FROM u GROUP BY solver""")
def prompt_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What prompts say beside their frame (the tokens that all opening prompts share), and how much of it training has seen."""
    text = F.upper(F.regexp_replace("prompt", r"\([^)]*\)", ""))
    w = records(spark, sf_dir).select("solver", "answer", "split", "turn", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("([A-Z]+)"), F.lit(1)))).alias("token"))
    openings = records(spark, sf_dir).where("turn = 1").agg(F.count("*").alias("all"))
    frame = w.where("turn = 1").groupBy("token").agg(F.count("*").alias("k")).crossJoin(openings).where("k = all").select("token")  # one row beside them
    u = w.join(F.broadcast(frame), "token", "left_anti")
    seen = u.where("split = 'train'").select("token").distinct().withColumn("seen", F.lit(True))
    u = u.join(seen, "token", "left")
    return u.groupBy("solver").agg(F.count("*").alias("tokens"), F.countDistinct("token").alias("distinct_tokens"), F.count_if(F.length("token") == 5).alias("words"), F.count_if(F.col("token") == F.upper("answer")).alias("own_answer"), F.count_if((F.col("split") == "val") & F.col("seen").isNull()).alias("unseen_in_train"))


# -- preference pairs over exact and one-ply values -----------------------------------------------------------------

EXACT = f"exact_ AS MATERIALIZED (SELECT * FROM (WITH {adaptive_oracle(_SMALL, 5)})), small AS ({_SMALL})".replace("lg_t1", "lg_full_t1")
PAIRS = f"""{EXACT}, size AS (SELECT state, sum(isc) AS k FROM small GROUP BY state), wide AS (SELECT state, f.guess, sum(c.k * c.k) AS sumsq, sum(c.k) AS k, max(CASE WHEN code = {ALL_RIGHT} THEN 1 ELSE 0 END) AS isc FROM (SELECT s.state, f.guess, f.code, count(*) AS k FROM (SELECT concat('|', guess, ':', code) AS state, answer FROM lg_full WHERE turn = 1 AND code <> {ALL_RIGHT}) s JOIN fba f USING (answer) WHERE s.state NOT IN (SELECT state FROM size) GROUP BY ALL) c JOIN (SELECT DISTINCT guess FROM fba) f USING (guess) GROUP BY ALL),
    acts AS MATERIALIZED (SELECT e.state, e.guess, 'exact' AS family, e.cost * 1.0 / s.k AS v FROM exact_ e JOIN size s USING (state) WHERE s.k > 0 UNION ALL SELECT state, guess, 'oneply', sumsq * 1.0 / k FROM wide WHERE isc = 1),
    tiers AS (SELECT *, min(v) OVER (PARTITION BY state) AS best, dense_rank() OVER (PARTITION BY state ORDER BY round(v, 9)) AS tier, rank() OVER (PARTITION BY state ORDER BY round(v, 9)) AS rnk, count(*) OVER (PARTITION BY state) AS n_actions FROM acts),
    cho AS (SELECT state, family, any_value(best) AS best, any_value(n_actions) AS n_actions, list_sort(list(guess)) AS optimal FROM tiers WHERE tier = 1 GROUP BY ALL), pick AS (SELECT *, optimal[CAST(('0x' || substr(sha256('chosen|' || state), 1, 8)) AS BIGINT) % len(optimal) + 1] AS chosen FROM cho),
    rej AS (SELECT state, 'competitive' AS pair_type, guess, v, rnk, row_number() OVER (PARTITION BY state ORDER BY sha256('rejected|' || state || '|' || guess)) AS rn FROM tiers WHERE tier = 2 UNION ALL
        SELECT state, 'contrastive', guess, v, rnk, row_number() OVER (PARTITION BY state ORDER BY sha256('rejected|' || state || '|' || guess)) FROM tiers WHERE CASE WHEN family = 'exact' THEN round(v - best, 9) BETWEEN 0.5 AND 2.0 ELSE round((v - best) / best, 9) BETWEEN 0.2 AND 1.0 END AND tier > 1),
    pairs AS MATERIALIZED (SELECT p.state, p.family, r.pair_type, p.chosen, r.guess AS rejected, round(r.v - p.best, 6) AS gap, round((r.v - p.best) / p.best, 6) AS relative_gap, r.rnk AS rejected_rank, len(p.optimal) AS n_optimal, p.n_actions FROM pick p JOIN rej r USING (state) WHERE r.rn = 1)"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state, guess, family, v: mean further guesses where few words are admissible, else what candidates are expected to leave."""
    from gridloom.plans.lists import after_opener, small_states

    _, _, _, fba = tables(spark, sf_dir)
    size = scratch_table(small_states(spark, sf_dir).groupBy("state").agg(F.sum("isc").alias("k")), "sizes")
    exact = exact_adaptive_values(spark, sf_dir).join(size.where("k > 0"), "state").select("state", "guess", F.lit("exact").alias("family"), (F.col("cost") / F.col("k")).alias("v"))
    wide = after_opener(spark, sf_dir).select("state", "answer").join(size, "state", "left_anti").join(fba, "answer").groupBy("state", "guess", "code").agg(F.count("*").alias("k"))
    one = wide.groupBy("state", "guess").agg((F.sum(F.col("k") * F.col("k")) / F.sum("k")).alias("v"), F.max(F.col("code") == ALL_RIGHT).alias("possible")).where("possible")
    return exact.unionByName(one.select("state", "guess", F.lit("oneply").alias("family"), "v"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen is spread by a hash over tied optima; rejected comes from the next tier, or from a band of larger gaps."""

    def make() -> DataFrame:
        by = Window.partitionBy("state")
        v = F.round("v", 9)
        t = actions(spark, sf_dir).withColumn("best", F.min("v").over(by)).withColumn("tier", F.dense_rank().over(by.orderBy(v))).withColumn("rnk", F.rank().over(by.orderBy(v)).cast("long")).withColumn("n_actions", F.count("*").over(by))
        t = scratch_table(t, "tiers")
        best = t.where("tier = 1").groupBy("state", "family").agg(F.first("best").alias("best"), F.first("n_actions").alias("n_actions"), F.array_sort(F.collect_list("guess")).alias("optimal"))
        place = F.conv(F.substring(F.sha2(F.concat(F.lit("chosen|"), "state"), 256), 1, 8), 16, 10).cast("long") % F.size("optimal")
        pick = best.withColumn("chosen", F.get("optimal", place.cast("int")))
        draw = F.struct(F.sha2(F.concat(F.lit("rejected|"), "state", F.lit("|"), "guess"), 256).alias("h"), "guess", "v", "rnk")
        gap = F.when(F.col("family") == "exact", F.round(F.col("v") - F.col("best"), 9).between(0.5, 2.0)).otherwise(F.round((F.col("v") - F.col("best")) / F.col("best"), 9).between(0.2, 1.0))
        near = t.where("tier = 2").groupBy("state").agg(F.min(draw).alias("r")).withColumn("pair_type", F.lit("competitive"))
        far = t.where(gap & (F.col("tier") > 1)).groupBy("state").agg(F.min(draw).alias("r")).withColumn("pair_type", F.lit("contrastive"))
        both = pick.join(near.unionByName(far), "state")
        gap = F.col("r.v") - F.col("best")
        return scratch_table(both.select("state", "family", "pair_type", "chosen", F.col("r.guess").alias("rejected"), F.round(gap, 6).alias("gap"), F.round(gap / F.col("best"), 6).alias("relative_gap"), F.col("r.rnk").alias("rejected_rank"), F.size("optimal").cast("long").alias("n_optimal"), "n_actions"), "pairs")

    return G.kept(spark, sf_dir, "pairs", make)


@query(f"{REC}, {PAIRS} SELECT * FROM pairs")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


@query(f"{REC}, {PAIRS} SELECT family, pair_type, count(*) AS n, round(median(gap), 4) AS median, round(avg(gap), 4) AS mean, round(quantile_cont(gap, 0.1), 4) AS p10, round(quantile_cont(gap, 0.9), 4) AS p90, round(max(gap), 4) AS largest, round(median(relative_gap), 4) AS relative_median, round(avg(CASE WHEN n_optimal > 1 THEN 1.0 ELSE 0.0 END), 4) AS tied, round(avg(n_actions), 2) AS mean_actions FROM pairs GROUP BY ALL")
def pair_gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps by family, never pooled: their units differ."""
    q = lambda p: F.round(F.percentile("gap", F.lit(p)), 4)
    return pairs(spark, sf_dir).groupBy("family", "pair_type").agg(F.count("*").alias("n"), q(0.5).alias("median"), F.round(F.avg("gap"), 4).alias("mean"), q(0.1).alias("p10"), q(0.9).alias("p90"), F.round(F.max("gap"), 4).alias("largest"), F.round(F.median("relative_gap"), 4).alias("relative_median"), F.round(F.avg((F.col("n_optimal") > 1).cast("double")), 4).alias("tied"), F.round(F.avg("n_actions"), 2).alias("mean_actions"))


_FAULTY = "SELECT 'clean' AS tab, * FROM pairs UNION ALL SELECT 'planted' AS tab, state, family, pair_type, CASE WHEN d < '4' THEN rejected ELSE chosen END AS chosen, CASE WHEN d < '4' THEN chosen WHEN d < '6' THEN chosen ELSE rejected END AS rejected, CASE WHEN d > 'c' THEN gap + 1 ELSE gap END AS gap, relative_gap, rejected_rank, n_optimal, n_actions FROM (SELECT *, substr(sha256('swap|' || state || pair_type), 1, 1) AS d FROM pairs)"


@query(f"""{REC}, {PAIRS}, tab AS ({_FAULTY}) SELECT tab, count(*) AS pairs, count(*) FILTER (WHERE round(r.v, 9) <= round(c.v, 9)) AS backwards, count(*) FILTER (WHERE tab.chosen = tab.rejected) AS same_word, count(*) FILTER (WHERE c.tier <> 1) AS chosen_not_best, count(*) FILTER (WHERE abs(r.v - c.v - gap) > 1e-5) AS wrong_gap, count(*) FILTER (WHERE r.rnk <> rejected_rank) AS wrong_rank,
    count(*) FILTER (WHERE tab.n_actions <> c.n_actions) AS wrong_actions, count(*) FILTER (WHERE pair_type = 'competitive' AND r.tier <> 2) AS not_next_tier FROM tab JOIN tiers c ON c.state = tab.state AND c.guess = tab.chosen JOIN tiers r ON r.state = tab.state AND r.guess = tab.rejected GROUP BY tab""")
def pair_deep_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs against values computed anew, on the pairs and on a copy with pairs turned round, made equal or misvalued."""
    p = pairs(spark, sf_dir)
    d = F.substring(F.sha2(F.concat(F.lit("swap|"), "state", "pair_type"), 256), 1, 1)
    bad = p.withColumn("d", d).withColumn("c", F.when(F.col("d") < "4", F.col("rejected")).otherwise(F.col("chosen"))).withColumn("r", F.when(F.col("d") < "6", F.col("chosen")).otherwise(F.col("rejected")))
    bad = bad.withColumn("gap", F.when(F.col("d") > "c", F.col("gap") + 1).otherwise(F.col("gap"))).withColumn("chosen", F.col("c")).withColumn("rejected", F.col("r")).drop("c", "r", "d").withColumn("tab", F.lit("planted"))
    by = Window.partitionBy("state")
    values = actions(spark, sf_dir).withColumn("v9", F.round("v", 9))
    values = values.select("state", "guess", "v", "v9", F.dense_rank().over(by.orderBy("v9")).alias("tier"), F.rank().over(by.orderBy("v9")).alias("rnk"), F.count("*").over(by).alias("n"))
    side = lambda x, name: values.select("state", F.col("guess").alias(name), *[F.col(k).alias(f"{x}_{k}") for k in ("v", "v9", "tier", "rnk", "n")])
    t = p.withColumn("tab", F.lit("clean")).unionByName(bad).join(side("c", "chosen"), ["state", "chosen"]).join(side("r", "rejected"), ["state", "rejected"])
    checks = {
        "backwards": F.col("r_v9") <= F.col("c_v9"), "same_word": F.col("chosen") == F.col("rejected"), "chosen_not_best": F.col("c_tier") != 1, "wrong_gap": F.abs(F.col("r_v") - F.col("c_v") - F.col("gap")) > 1e-5, "wrong_rank": F.col("r_rnk") != F.col("rejected_rank"),
        "wrong_actions": F.col("n_actions") != F.col("c_n"), "not_next_tier": (F.col("pair_type") == "competitive") & (F.col("r_tier") != 2),
    }
    return t.groupBy("tab").agg(F.count("*").alias("pairs"), *[F.count_if(c).alias(k) for k, c in checks.items()])


@query(f"{REC}, {PAIRS}, adm AS (SELECT state, word FROM small UNION SELECT state, guess FROM acts WHERE family = 'oneply') SELECT family, pair_type, count(*) AS pairs, round(avg(CASE WHEN chosen IN (SELECT answer FROM answers) THEN 1.0 ELSE 0.0 END), 4) AS chosen_possible, round(avg(CASE WHEN rejected IN (SELECT answer FROM answers) THEN 1.0 ELSE 0.0 END), 4) AS rejected_possible, round(avg(CASE WHEN chosen IN (SELECT answer FROM answers) THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN rejected IN (SELECT answer FROM answers) THEN 1.0 ELSE 0.0 END), 4) AS asymmetry FROM pairs GROUP BY ALL")
def pair_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much oftener the chosen word than the rejected one could be the answer: what a model could learn instead."""
    _, _, answers, _ = tables(spark, sf_dir)
    p = pairs(spark, sf_dir)
    for side in ("chosen", "rejected"):
        p = p.join(answers.select(F.col("answer").alias(side), F.lit(1.0).alias(f"{side}_a")), side, "left")
    a, b = (F.avg(F.coalesce(f"{side}_a", F.lit(0.0))) for side in ("chosen", "rejected"))
    return p.groupBy("family", "pair_type").agg(F.count("*").alias("pairs"), F.round(a, 4).alias("chosen_possible"), F.round(b, 4).alias("rejected_possible"), F.round(a - b, 4).alias("asymmetry"))


@query(f"""{REC}, {EXACT}, size AS (SELECT state, sum(isc) AS k FROM small GROUP BY state), d AS (SELECT DISTINCT state, lower(completion) AS guess, n, count(*) OVER (PARTITION BY state) AS games FROM rec WHERE solver = 'restricted' AND turn = 2)
    SELECT {band_sql('d.n', 'budget')} AS band, count(*) AS decisions, sum(games)::BIGINT AS games, count(*) FILTER (WHERE e.cost = b.best) AS optimal, round(avg((e.cost - b.best) * 1.0 / s.k), 6) AS regret, sum(e.cost - b.best)::BIGINT AS recoverable FROM d JOIN exact_ e ON e.state = d.state AND e.guess = d.guess JOIN (SELECT state, min(cost) AS best FROM exact_ GROUP BY state) b ON b.state = d.state JOIN size s ON s.state = d.state GROUP BY 1""")
def decision_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second moves of the restricted policy priced against the exact best: guesses that better decisions would save."""
    from gridloom.plans.lists import small_states

    played = records(spark, sf_dir).where("solver = 'restricted' AND turn = 2").groupBy("state", F.lower("completion").alias("guess"), "n").agg(F.count("*").alias("games"))
    e = exact_adaptive_values(spark, sf_dir)
    size = small_states(spark, sf_dir).groupBy("state").agg(F.sum("isc").alias("k"))
    x = played.join(e, ["state", "guess"]).join(e.groupBy("state").agg(F.min("cost").alias("best")), "state").join(size, "state")
    over = F.col("cost") - F.col("best")
    return x.groupBy(band(F.col("n"), "budget").alias("band")).agg(F.count("*").alias("decisions"), F.sum("games").alias("games"), F.count_if(over == 0).alias("optimal"), F.round(F.avg(over / F.col("k")), 6).alias("regret"), F.sum(over).alias("recoverable"))


@query(f"{REC}, x AS ({G.STATS_SQL.format(alive='(SELECT answer, state FROM lg_full WHERE turn = 2)', fb='fba')}) SELECT state, guess, round(sumsq * 1.0 / n - 0.5 * isc, 6) AS cost FROM x WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY state ORDER BY round(sumsq * 1.0 / n - 0.5 * isc, 9), guess) <= 3")
def bonus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best guesses by what they leave, half a word off for those that can be the answer."""
    _, _, _, fba = tables(spark, sf_dir)
    b = list_games(spark, sf_dir, "full").where("turn = 2").select("state", "answer").join(fba, "answer").groupBy("state", "guess", "code").agg(F.count("*").alias("k"))
    s = b.groupBy("state", "guess").agg(F.sum(F.col("k") * F.col("k")).alias("sumsq"), F.sum("k").alias("n"), F.max((F.col("code") == ALL_RIGHT).cast("int")).alias("isc")).where("n > 1")
    s = s.withColumn("cost", F.col("sumsq") / F.col("n") - F.lit(0.5) * F.col("isc"))
    return s.withColumn("rn", F.row_number().over(Window.partitionBy("state").orderBy(F.round("cost", 9), "guess"))).where("rn <= 3").select("state", "guess", F.round("cost", 6).alias("cost"))


# -- decoders and probes over stand-in scores -----------------------------------------------------------------------


def stand_in(state: str, word: str) -> Column:
    """A number from 0 to 1 in place of a model's score."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit("score|"), F.col(state), F.lit("|"), F.col(word)), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


STAND_IN = "CAST(('0x' || substr(sha256('score|' || {s} || '|' || {w}), 1, 8)) AS BIGINT) / 4294967295.0"
DECODERS = ("unconstrained", "legal", "consistent", "adaptive")
_POOLS = {"unconstrained": "TRUE", "legal": "legal", "consistent": "(adm OR (n_adm = 0 AND legal))", "adaptive": "(CASE WHEN n_adm <= 20 THEN adm OR n_adm = 0 ELSE legal END)"}


@query(f"""{REC}, st AS (SELECT DISTINCT state FROM lg_full WHERE turn = 3), facts AS (SELECT state, split_part(p, ':', 1) AS guess, CAST(split_part(p, ':', 2) AS INT) AS code FROM (SELECT state, unnest(string_split(substr(state, 2), '|')) AS p FROM st)),
    ad AS (SELECT x.state, f.answer AS word FROM facts x JOIN fb f USING (guess, code) GROUP BY ALL HAVING count(*) = 2), pool AS (SELECT word, TRUE AS legal FROM vocab UNION ALL SELECT reverse(word), FALSE FROM vocab WHERE reverse(word) NOT IN (SELECT word FROM vocab)),
    sc AS MATERIALIZED (SELECT s.state, p.word, p.legal, a.word IS NOT NULL AS adm, count(a.word) OVER (PARTITION BY s.state) AS n_adm, EXISTS (SELECT 1 FROM facts x WHERE x.state = s.state AND x.guess = p.word) AS used, {STAND_IN.format(s='s.state', w='p.word')} AS score FROM st s, pool p LEFT JOIN ad a ON a.state = s.state AND a.word = p.word),
    al AS ({" UNION ALL ".join(f"SELECT '{d}' AS decoder, {b} AS ban, state, word, score, legal FROM sc WHERE {_POOLS[d]}" + (" AND NOT used" if b else "") for d in DECODERS for b in (False, True))})
    SELECT decoder, ban, state, word, legal, n_allowed, n_allowed = 1 AS forced, margin FROM (SELECT *, row_number() OVER w AS rn, round(score - lead(score) OVER w, 6) AS margin, count(*) OVER (PARTITION BY decoder, ban, state) AS n_allowed FROM al WINDOW w AS (PARTITION BY decoder, ban, state ORDER BY score DESC, word)) WHERE rn = 1""")
def decoder_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best word of four pools, with and without a ban on words already played; a state with no admissible word opens the legal ones."""
    from gridloom.plans.lists import parsed

    vocab = G.table(spark, sf_dir, "vocab").select("word")
    turned = vocab.select(F.reverse("word").alias("word")).join(vocab, "word", "left_anti")
    pool = vocab.withColumn("legal", F.lit(True)).unionByName(turned.withColumn("legal", F.lit(False)))
    states = list_games(spark, sf_dir, "full").where("turn = 3").select("state").distinct()
    facts = parsed(states)
    adm = consistent_words(spark, sf_dir, facts).withColumn("a", F.lit(True))
    used = facts.select("state", F.col("guess").alias("word")).distinct().withColumn("u", F.lit(True))
    # every state's scores of all words: the rows a model would return
    s = states.crossJoin(F.broadcast(pool)).join(adm, ["state", "word"], "left").join(used, ["state", "word"], "left")
    s = s.select("state", "word", "legal", F.coalesce("a", F.lit(False)).alias("adm"), F.count("a").over(Window.partitionBy("state")).alias("n_adm"), F.coalesce("u", F.lit(False)).alias("used"), stand_in("state", "word").alias("score"))
    each = s.withColumn("x", F.explode(F.filter(F.array(*[F.struct(F.lit(d).alias("decoder"), F.lit(b).alias("ban"), (F.expr(_POOLS[d]) & (F.lit(not b) | ~F.col("used"))).alias("ok")) for d in DECODERS for b in (False, True)]), lambda x: x["ok"])))
    by = Window.partitionBy("x.decoder", "x.ban", "state")
    order = by.orderBy(F.desc("score"), "word")
    best = each.withColumn("rn", F.row_number().over(order)).withColumn("margin", F.round(F.col("score") - F.lead("score").over(order), 6)).withColumn("n_allowed", F.count("*").over(by)).where("rn = 1")
    return best.select("x.decoder", "x.ban", "state", "word", "legal", "n_allowed", (F.col("n_allowed") == 1).alias("forced"), "margin")


@query(f"""{REC}, tg AS (SELECT DISTINCT lower(completion) AS word FROM rec WHERE split = 'train'), st AS (SELECT state, answer, n FROM rec WHERE solver = 'full' AND n <= 4), sc AS (SELECT s.state, s.answer, s.n, v.word, {STAND_IN.format(s='s.state', w='v.word')} AS score, v.word IN (SELECT answer FROM rec r WHERE r.solver = 'full' AND r.state = s.state) AS cand FROM st s, vocab v),
    rk AS (SELECT *, row_number() OVER (PARTITION BY state, answer ORDER BY score DESC, word) AS place, row_number() OVER (PARTITION BY state, answer, cand ORDER BY score DESC, word) AS place_cand, bool_or(cand) FILTER (WHERE top) OVER (PARTITION BY state, answer) AS top_cand FROM (SELECT *, score = max(score) OVER (PARTITION BY state, answer) AS top FROM sc)),
    own AS (SELECT *, answer IN (SELECT word FROM tg) AS seen FROM rk WHERE word = answer) SELECT n AS k, seen, count(*) AS probes, round(100.0 * count(*) FILTER (WHERE place = 1) / count(*), 2) AS top1_pct, round(100.0 * count(*) FILTER (WHERE top_cand) / count(*), 2) AS top1_candidate_pct, median(place) AS median_rank, round(avg(place_cand), 3) AS mean_rank_within FROM own GROUP BY ALL""")
def terminal_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the answer stands among all words' scores in states of few candidates, by whether training ever named it."""
    r = records(spark, sf_dir)
    targets = r.where("split = 'train'").select(F.lower("completion").alias("answer")).distinct().withColumn("t", F.lit(True))
    st = r.where("solver = 'full' AND n <= 4").select("state", "answer", "n")
    words = G.table(spark, sf_dir, "vocab").select("word")
    # a state's scores are shared by its answers
    states = st.groupBy("state", "n").agg(F.collect_set("answer").alias("answers"))
    sc = states.crossJoin(F.broadcast(words)).withColumn("score", stand_in("state", "word")).withColumn("cand", F.array_contains("answers", F.col("word")))
    by = Window.partitionBy("state").orderBy(F.desc("score"), "word")
    rk = sc.withColumn("place", F.row_number().over(by)).withColumn("within", F.row_number().over(Window.partitionBy("state", "cand").orderBy(F.desc("score"), "word")))
    rk = rk.withColumn("top_cand", F.max(F.when(F.col("place") == 1, F.col("cand"))).over(Window.partitionBy("state")))
    own = rk.where("cand").select("n", "place", "within", "top_cand", F.col("word").alias("answer")).join(targets, "answer", "left")
    return own.groupBy(F.col("n").alias("k"), F.coalesce("t", F.lit(False)).alias("seen")).agg(F.count("*").alias("probes"), F.round(F.lit(100.0) * F.count_if(F.col("place") == 1) / F.count("*"), 2).alias("top1_pct"), F.round(F.lit(100.0) * F.count_if("top_cand") / F.count("*"), 2).alias("top1_candidate_pct"), F.median("place").alias("median_rank"), F.round(F.avg("within"), 3).alias("mean_rank_within"))


@query(f"{REC}, {EXACT}, s AS (SELECT *, {STAND_IN.format(s='state', w='guess')} AS score FROM exact_) SELECT count(*) AS states, count(*) FILTER (WHERE hit) AS optimal, round(100.0 * count(*) FILTER (WHERE hit) / count(*), 4) AS rate, round(avg(chance), 6) AS chance FROM (SELECT state, arg_max(optimal, score) AS hit, avg(CASE WHEN optimal THEN 1.0 ELSE 0.0 END) AS chance FROM s GROUP BY state)")
def greedy_optimal_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the best-scored action is an optimal one, and how often chance is."""
    s = exact_adaptive_values(spark, sf_dir).withColumn("score", stand_in("state", "guess"))
    by = s.groupBy("state").agg(F.max_by("optimal", "score").alias("hit"), F.avg(F.col("optimal").cast("double")).alias("chance"))
    return by.agg(F.count("*").alias("states"), F.count_if("hit").alias("optimal"), F.round(F.lit(100.0) * F.count_if("hit") / F.count("*"), 4).alias("rate"), F.round(F.avg("chance"), 6).alias("chance"))


@query(f"""WITH {G.VOCAB_ORACLE}, t AS (SELECT conv_id, turn, role, upper(regexp_extract(text, '^[^A-Za-z]*([A-Za-z]+)', 1)) AS first, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations),
    w AS (SELECT role, first, length(first) = 5 AS parsed, lower(first) IN (SELECT word FROM vocab) AS legal, position(lower(first) IN lower(coalesce(reply, ''))) > 0 AND first <> '' AS copied FROM t)
    SELECT role, count(*) AS texts, round(100.0 * count(*) FILTER (WHERE parsed) / count(*), 4) AS parsed_pct, round(100.0 * count(*) FILTER (WHERE legal) / count(*), 4) AS legal_pct, round(100.0 * count(*) FILTER (WHERE copied) / count(*), 4) AS copied_pct FROM w GROUP BY role""")
def format_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose first word could be a move, is a legal one, and comes back in the reply."""
    c = read_table(spark, sf_dir, "conversations").withColumn("reply", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    w = c.select("role", F.upper(F.coalesce(F.regexp_extract("text", "^[^A-Za-z]*([A-Za-z]+)", 1), F.lit(""))).alias("first"), "reply")
    legal = G.table(spark, sf_dir, "vocab").select(F.upper("word").alias("first"), F.lit(True).alias("legal"))
    w = w.join(F.broadcast(legal), "first", "left")  # MOST_WORDS rows at most
    copied = (F.col("first") != "") & F.lower(F.coalesce("reply", F.lit(""))).contains(F.lower("first"))
    pct = lambda cond, name: F.round(F.lit(100.0) * F.count_if(cond) / F.count("*"), 4).alias(name)
    return w.groupBy("role").agg(F.count("*").alias("texts"), pct(F.length("first") == 5, "parsed_pct"), pct(F.col("legal").isNotNull(), "legal_pct"), pct(copied, "copied_pct"))


@query(f"""{REC}, p AS (SELECT answer, turn, prompt FROM ({P.prompts('lg_full', False)}) WHERE variant = 'few_shot'), x AS (SELECT p.*, upper(g.guess) AS guess, regexp_extract_all(prompt, 'Next guess: ([A-Z]{{5}})', 1) AS shots FROM p JOIN lg_full g USING (answer, turn))
    SELECT shots[1] AS first_shot, count(*) AS prompts, count(DISTINCT prompt) AS states, round(100.0 * count(*) FILTER (WHERE list_contains(shots, guess)) / count(*), 4) AS copy_pct, max(len(shots))::BIGINT AS shown FROM x GROUP BY 1""")
def shot_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worked examples by rotation, and moves that copy one shown."""
    games = list_games(spark, sf_dir, "full")
    games.createOrReplaceTempView("lg_full")
    p = spark.sql(P.prompts("lg_full", True, ("few_shot",))).select("answer", "turn", "prompt").join(games.select("answer", "turn", F.upper("guess").alias("guess")), ["answer", "turn"])
    x = p.withColumn("shots", F.regexp_extract_all("prompt", F.lit("Next guess: ([A-Z]{5})"), F.lit(1)))
    return x.groupBy(F.get("shots", F.lit(0)).alias("first_shot")).agg(F.count("*").alias("prompts"), F.countDistinct("prompt").alias("states"), F.round(F.lit(100.0) * F.count_if(F.array_contains("shots", F.col("guess"))) / F.count("*"), 4).alias("copy_pct"), F.max(F.size("shots")).cast("long").alias("shown"))
