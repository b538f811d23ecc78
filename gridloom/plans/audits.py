"""Audits compiled from tables of rules: every rule is a counter of one pass, and every rule has a fault that must raise it.

Rows are audited as they are (fault `none`) and once for each fault, with the fault's columns rewritten; facts are joined
anew, so a rule never trusts what a row says of itself. The texts of rules are SQL that both engines run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.hashing import split_of
from gridloom.plans import games as G
from gridloom.plans.lists import consistent_words, parsed, word_lists
from gridloom.plans.queries import SPLIT, query
from gridloom.plans.sampling import _QUOTA, ENDGAMES, EXACT_FAR, FAR, LEGAL, MIXED, NEAR, RESTRICTED, endgame_quotas, gap_in, legal_actions, legal_pair_table, rollouts_oracle, sampled
from gridloom.plans.records import band_sql
from gridloom.session import scratch_table


@dataclass(frozen=True)
class Audit:
    """columns of the rows; facts: SQL over {rows} that adds what rules need; rules: by name, the condition that breaks it and
    the columns that its fault rewrites."""

    columns: tuple[str, ...]
    facts: str
    rules: dict[str, tuple[str, dict[str, str]]]

    def counters(self, rows: str) -> str:
        """SQL: fault, rows_, and how often each rule is broken, by fault; rows: a table."""
        names = ", ".join(f"('{f}')" for f in ("none", *self.rules))
        changed = {c: {f: sql[c] for f, (_, sql) in self.rules.items() if c in sql} for c in self.columns}
        pick = lambda c: c if not changed[c] else "CASE fault " + " ".join(f"WHEN '{f}' THEN {sql}" for f, sql in changed[c].items()) + f" ELSE {c} END AS {c}"
        faulty = f"(SELECT fault, {', '.join(map(pick, self.columns))} FROM {rows} CROSS JOIN (SELECT * FROM (VALUES {names}) AS t(fault)) f)"
        counts = ", ".join(f"CAST(sum(CASE WHEN {broken} THEN 1 ELSE 0 END) AS BIGINT) AS {name}" for name, (broken, _) in self.rules.items())
        return f"SELECT fault, count(*) AS rows_, {counts} FROM ({self.facts.format(rows=faulty)}) a GROUP BY fault"

    def report(self, counted: DataFrame) -> DataFrame:
        """rule, audited (rows), broken (in rows as they are), caught (in rows with its fault), raised_by (faults that raise it)."""
        each = counted.select("fault", "rows_", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in self.rules])).alias("x")).select("fault", "rows_", "x.rule", "x.n")
        own = lambda cond: F.max(F.when(cond, F.col("n")))
        none = F.col("fault") == "none"
        return each.groupBy("rule").agg(F.max(F.when(none, F.col("rows_"))).alias("audited"), own(none).alias("broken"), own(F.col("fault") == F.col("rule")).alias("caught"), F.count_if((F.col("n") > 0) & ~none).alias("raised_by"))

    def report_sql(self, rows: str) -> str:
        unpivot = f"(UNPIVOT (SELECT * FROM counted) ON {', '.join(self.rules)} INTO NAME rule VALUE n)"
        return f"counted AS MATERIALIZED ({self.counters(rows)}) SELECT rule, max(rows_) FILTER (WHERE fault = 'none') AS audited, max(n) FILTER (WHERE fault = 'none') AS broken, max(n) FILTER (WHERE fault = rule) AS caught, count(*) FILTER (WHERE n > 0 AND fault <> 'none') AS raised_by FROM {unpivot} GROUP BY rule"


# -- preference pairs ---------------------------------------------------------------------------------------------------

_HISTORY = "upper(replace(state, '|', ' '))"
PAIR_FACTS = """SELECT r.*, c.value AS cv, c.agrees AS ca, x.value AS xv, x.agrees AS xa, s.n AS sn, s.n_adm AS sa, s.turn AS st, t.best, t.second, t.n_acts, o.n_best, k.better, v.word AS chosen_legal, w.word AS rejected_legal,
    count(*) OVER (PARTITION BY fault, r.id) AS ids, count(*) OVER (PARTITION BY fault, r.state, r.pair_type) AS same_pair, min(r.split) OVER (PARTITION BY fault, r.state) AS low_split, max(r.split) OVER (PARTITION BY fault, r.state) AS high_split
    FROM {rows} r LEFT JOIN acts c ON c.state = r.state AND c.guess = r.chosen LEFT JOIN acts x ON x.state = r.state AND x.guess = r.rejected LEFT JOIN visited s ON s.state = r.state
    LEFT JOIN (SELECT a.state, min(a.value) AS best, min(CASE WHEN a.value > b.low THEN a.value END) AS second, count(*) AS n_acts FROM acts a JOIN (SELECT state, min(value) AS low FROM acts GROUP BY state) b ON b.state = a.state GROUP BY a.state) t ON t.state = r.state
    LEFT JOIN (SELECT a.state, count(*) AS n_best FROM acts a JOIN (SELECT state, min(value) AS low FROM acts GROUP BY state) b ON b.state = a.state AND a.value = b.low GROUP BY a.state) o ON o.state = r.state
    LEFT JOIN (SELECT state, guess, rank() OVER (PARTITION BY state ORDER BY value) AS better FROM acts) k ON k.state = r.state AND k.guess = r.rejected
    LEFT JOIN vocab v ON v.word = r.chosen LEFT JOIN vocab w ON w.word = r.rejected"""
_FAMILY = "CASE WHEN exact THEN 'exact' ELSE 'oneply' END"
PAIRS = Audit(
    ("id", "split", "state", "turn", "n", "n_adm", "exact", "family", "pair_type", "chosen", "chosen_agrees", "rejected", "rejected_agrees", "gap", "rejected_rank", "n_optimal", "n_actions", "bucket", "prompt"),
    PAIR_FACTS,
    {
        "unknown_state": ("sn IS NULL", {"state": "concat(state, '|zzzzz:0')"}),
        "wrong_turn": ("turn <> st OR turn <> length(state) - length(replace(state, '|', '')) + 1", {"turn": "turn + 1"}),
        "turn_out_of_range": (f"turn < 2 OR turn > {G.TURNS}", {"turn": "turn + 6"}),
        "wrong_candidates": ("n <> sn", {"n": "n + 1"}),
        "one_candidate": ("n < 2", {"n": "1"}),
        "wrong_admissible": ("n_adm <> sa", {"n_adm": "n_adm + 1"}),
        "fewer_admissible_than_candidates": ("n_adm < n", {"n_adm": "n - 1"}),
        "wrong_regime": (f"exact <> (sa <= {RESTRICTED})", {"exact": "NOT exact"}),
        "wrong_family": (f"family <> {_FAMILY}", {"family": "'depth'"}),
        "wrong_bucket": (f"bucket IS NULL OR bucket <> {band_sql('sa', 'pairs')}", {"bucket": "'0'"}),
        "unknown_type": ("pair_type NOT IN ('competitive', 'contrastive')", {"pair_type": "'other'"}),
        "same_word": ("chosen = rejected", {"rejected": "chosen"}),
        "chosen_not_lower": ("chosen <> lower(chosen)", {"chosen": "upper(chosen)"}),
        "rejected_not_lower": ("rejected <> lower(rejected)", {"rejected": "upper(rejected)"}),
        "chosen_illegal": ("chosen_legal IS NULL", {"chosen": "'zzzzz'"}),
        "rejected_illegal": ("rejected_legal IS NULL", {"rejected": "'zzzzz'"}),
        "chosen_not_offered": ("cv IS NULL", {"chosen": "reverse(chosen)"}),
        "rejected_not_offered": ("xv IS NULL", {"rejected": "reverse(rejected)"}),
        "chosen_not_best": ("cv > best", {"chosen": "rejected"}),
        "rejected_is_best": ("xv = best", {"rejected": "chosen"}),
        "backwards": ("xv <= cv", {"chosen": "rejected", "rejected": "chosen"}),
        "wrong_gap": ("gap <> xv - cv", {"gap": "gap + 1"}),
        "gap_not_positive": ("gap <= 0", {"gap": "-gap"}),
        "wrong_rank": ("rejected_rank <> better", {"rejected_rank": "rejected_rank + 1"}),
        "rank_of_the_best": ("rejected_rank <= n_best", {"rejected_rank": "1"}),
        "wrong_ties": ("n_optimal <> n_best", {"n_optimal": "n_optimal + 1"}),
        "wrong_actions": ("n_actions <> n_acts", {"n_actions": "n_actions - 1"}),
        "not_the_next_tier": ("exact AND pair_type = 'competitive' AND xv <> second", {"pair_type": "'competitive'"}),
        "outside_the_exact_band": (f"exact AND pair_type = 'contrastive' AND NOT ({gap_in(*EXACT_FAR, 'xv - best', 'sn')})", {"pair_type": "'contrastive'"}),
        "outside_the_near_band": (f"NOT exact AND pair_type = 'competitive' AND NOT ({gap_in(*NEAR, 'xv - best', 'best')})", {"pair_type": "'competitive'"}),
        "outside_the_far_band": (f"NOT exact AND pair_type = 'contrastive' AND NOT ({gap_in(*FAR, 'xv - best', 'best')})", {"pair_type": "'contrastive'"}),
        "wrong_chosen_agreement": ("chosen_agrees <> ca", {"chosen_agrees": "NOT chosen_agrees"}),
        "wrong_rejected_agreement": ("rejected_agrees <> xa", {"rejected_agrees": "NOT rejected_agrees"}),
        "exact_against_clues": ("exact AND NOT (chosen_agrees AND rejected_agrees)", {"chosen_agrees": "FALSE"}),
        "repeated_id": ("ids > 1", {"id": "'lp-same'"}),
        "malformed_id": ("length(id) <> 17 OR substr(id, 1, 3) <> 'lp-'", {"id": "substr(id, 2, 20)"}),
        "repeated_pair": ("same_pair > 1", {"pair_type": "'competitive'"}),
        "split_of_both_sides": ("low_split <> high_split", {"split": "CASE WHEN pair_type = 'competitive' THEN 'val' ELSE 'train' END"}),
        "unknown_split": ("split NOT IN ('train', 'val')", {"split": "'test'"}),
        "wrong_prompt": ("prompt <> upper(replace(state, '|', ' '))", {"prompt": "concat(prompt, ' ')"}),
        "chosen_in_prompt_as_win": ("prompt LIKE '%:242%'", {"prompt": "concat(prompt, ' XXXXX:242')"}),
    },
)
_PAIR_ROWS = f"""lprows AS MATERIALIZED (SELECT 'lp-' || substr(sha256('pair|' || p.state || '|' || pair_type), 1, 14) AS id, {SPLIT.format(k='p.state')} AS split, p.state, p.turn, p.n, v.n_adm, exact, {_FAMILY} AS family, pair_type, chosen, chosen_agrees, rejected, rejected_agrees, gap, rejected_rank, n_optimal, n_actions,
    {band_sql('v.n_adm', 'pairs')} AS bucket, upper(replace(p.state, '|', ' ')) AS prompt FROM lp p JOIN visited v ON v.state = p.state)"""


@query(f"{LEGAL}, {_PAIR_ROWS}, {PAIRS.report_sql('lprows')}")
def legal_pair_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs' rules, each with what it finds in the pairs as they are and in a copy with its own fault."""
    p, acts = legal_pair_table(spark, sf_dir), legal_actions(spark, sf_dir)
    visited = sampled(spark, sf_dir, "mixed", MIXED).where("n >= 2").select("state", "turn", "n", "n_adm").distinct()
    rows = p.join(visited.select("state", "n_adm"), "state").withColumns({
        "id": F.concat(F.lit("lp-"), F.substring(F.sha2(F.concat_ws("|", F.lit("pair"), "state", "pair_type"), 256), 1, 14)), "split": split_of(F.col("state")), "family": F.expr(_FAMILY), "bucket": F.expr(band_sql("n_adm", "pairs")), "prompt": F.expr(_HISTORY),
    })
    G.table(spark, sf_dir, "vocab")
    acts.createOrReplaceTempView("acts")
    visited.createOrReplaceTempView("visited")
    scratch_table(rows.select(*PAIRS.columns), "pair-rows").createOrReplaceTempView("lprows")
    return PAIRS.report(scratch_table(spark.sql(PAIRS.counters("lprows")), "counted"))


# -- endgame rows -------------------------------------------------------------------------------------------------------

ENDGAME_FACTS = """SELECT r.*, a.answer AS known, f.n AS fn, f.own, count(*) OVER (PARTITION BY fault, r.answer, r.bucket) AS in_bucket, count(*) OVER (PARTITION BY fault, r.answer, r.state) AS same_state, count(*) OVER (PARTITION BY fault, r.id) AS ids
    FROM {rows} r LEFT JOIN answers a ON a.answer = r.answer LEFT JOIN (SELECT h.state, q.word AS answer, h.n, TRUE AS own FROM held q JOIN (SELECT state, count(*) AS n FROM held GROUP BY state) h ON h.state = q.state) f ON f.state = r.state AND f.answer = r.answer"""
ENDGAME = Audit(
    ("id", "answer", "bucket", "draw", "turn", "n", "state", "split"),
    ENDGAME_FACTS,
    {
        "unknown_answer": ("known IS NULL", {"answer": "'zzzzz'"}),
        "answer_against_clues": ("own IS NULL", {"state": "concat(state, '|zzzzz:0')"}),
        "wrong_candidates": ("fn <> n", {"n": "n + 1"}),
        "wrong_bucket": (f"bucket <> {band_sql('n', 'endgame')} OR {band_sql('n', 'endgame')} IS NULL", {"bucket": "CASE WHEN bucket = '1' THEN '2' ELSE '1' END"}),
        "wrong_turn": ("turn <> length(state) - length(replace(state, '|', '')) + 1", {"turn": "turn - 1"}),
        "turn_out_of_range": (f"turn < 2 OR turn > {G.TURNS}", {"turn": "1"}),
        "over_quota": (f"in_bucket > {_QUOTA}", {"bucket": "'2'"}),
        "repeated_state": ("same_state > 1", {"state": "''"}),
        "repeated_id": ("ids > 1", {"id": "'eg-same'"}),
        "won_already": ("state LIKE '%:242%'", {"state": "concat(state, '|', answer, ':242')"}),
        "held_out_answer": ("split <> 'train'", {"split": "'val'"}),
        "negative_draw": ("draw < 0", {"draw": "-1 - draw"}),
    },
)
_END_ROWS = f"""b AS (SELECT *, {band_sql('n', 'endgame')} AS bucket FROM visits), f AS (SELECT * FROM b WHERE bucket IS NOT NULL QUALIFY row_number() OVER (PARTITION BY answer, state ORDER BY draw, turn) = 1),
    egrows AS MATERIALIZED (SELECT 'eg-' || substr(sha256(answer || '|' || state), 1, 14) AS id, answer, bucket, draw, turn, n, state, {SPLIT.format(k='answer')} AS split FROM f QUALIFY row_number() OVER (PARTITION BY answer, bucket ORDER BY draw, turn) <= {_QUOTA}),
    facts AS (SELECT state, split_part(p, ':', 1) AS guess, CAST(split_part(p, ':', 2) AS INT) AS code FROM (SELECT state, unnest(string_split(substr(state, 2), '|')) AS p FROM (SELECT DISTINCT state FROM egrows))),
    held AS MATERIALIZED (SELECT x.state, b.answer AS word FROM facts x JOIN fba b USING (guess, code) GROUP BY x.state, b.answer HAVING count(*) = any_value(length(x.state) - length(replace(x.state, '|', ''))))"""


@query(f"{rollouts_oracle(ENDGAMES)}, {_END_ROWS}, {ENDGAME.report_sql('egrows')}")
def endgame_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The endgame rows' rules: candidates are counted anew from the histories."""
    word_lists(spark, sf_dir).targets.createOrReplaceTempView("answers")
    rows = endgame_quotas(spark, sf_dir).withColumn("id", F.concat(F.lit("eg-"), F.substring(F.sha2(F.concat_ws("|", "answer", "state"), 256), 1, 14))).withColumn("split", split_of(F.col("answer")))
    rows = scratch_table(rows.select(*ENDGAME.columns), "endgame-rows")
    held = consistent_words(spark, sf_dir, parsed(rows.select("state").distinct())).join(word_lists(spark, sf_dir).targets.select(F.col("answer").alias("word")), "word", "left_semi")
    scratch_table(held, "held").createOrReplaceTempView("held")
    rows.createOrReplaceTempView("egrows")
    return ENDGAME.report(scratch_table(spark.sql(ENDGAME.counters("egrows")), "counted"))
