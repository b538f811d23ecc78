"""Prompts read back: each variant's text is parsed into a history, rendered again, and compared byte for byte.

A variant without a history (deductions alone) is rendered from what its state's plain prompt says. The rewritten rows must
be the old ones in every other column, which digests of the rows prove.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.feedback import checked_code
from gridloom.plans import prompts as P
from gridloom.plans.lists import list_games, list_games_oracle, lists_oracle
from gridloom.plans.queries import query
from gridloom.plans.records import LINE
from gridloom.session import scratch_table

#: What is read of a variant's text: a pattern of a guess and of its marks; variants not named have the plain lines.
PATTERNS = {
    "reversed": r"  ([A-Z]{5}) -> ([BYG]{5})",
    "minimal": r"(?m)^([A-Z]{5}) ([BYG]{5})$",
    "emoji": r"  [0-9]+\. ([A-Z]{5}) ([🟩🟨⬛]{5})",
    "verbose": r"Guess [0-9]+ was ([A-Z]{5}): ([^.]*)\.",
}
#: A sentence's clauses as marks, and tiles as marks.
CLAUSES = ((r"[A-Z] is correct at position [0-9](; )?", "G"), (r"[A-Z] is in the word but not at position [0-9](; )?", "Y"), (r"[A-Z] is not in the word(; )?", "B"), ("🟩", "G"), ("🟨", "Y"), ("⬛", "B"))
UNLISTED = "constraints_only"


def history_in(variant: Column, prompt: Column) -> Column:
    """array of (guess, marks in letters of BYG) in the order of play."""
    own = F.when(variant == "few_shot", F.substring_index(prompt, "Now your game.", -1)).otherwise(prompt)
    plain = lambda marks: reduce(lambda x, rule: F.regexp_replace(x, *rule), CLAUSES, marks)
    read = lambda text, pattern: F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("guess"), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), plain).alias("marks"))
    out = read(own, LINE)
    for name, pattern in PATTERNS.items():
        found = read(prompt, pattern)
        out = F.when(variant == name, F.reverse(found) if name == "reversed" else found).otherwise(out)
    return out


def rendered_again(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows: answer, turn, variant, prompt -> the same with again (rendered from what was read) and n_read (turns read)."""
    h = rows.withColumn("h", history_in(F.col("variant"), F.col("prompt"))).withColumn("n", F.coalesce(F.regexp_extract("prompt", "Possible answers remaining: ([0-9]+)", 1).try_cast("long"), F.lit(0)))
    told = h.where("variant = 'baseline'").select("answer", "turn", F.col("h").alias("told"))
    h = h.join(told, ["answer", "turn"], "left").withColumn("h", F.when(F.col("variant") == UNLISTED, F.col("told")).otherwise(F.col("h"))).drop("told")
    key = F.concat_ws("|", F.array_join(F.transform("h", lambda x: F.concat(x["guess"], F.lit(":"), x["marks"])), "|"), F.col("n").cast("string"))
    h = scratch_table(h.withColumn("key", key).withColumn("n_read", F.size("h")), "read")
    states = h.select("key", "h", "n", "n_read").dropDuplicates(["key"])
    past = states.select("key", F.posexplode("h").alias("at", "x")).select(F.col("key").alias("answer"), (F.col("at") + 1).alias("turn"), F.lower("x.guess").alias("guess"), checked_code(F.col("x.marks")).alias("code"), F.lit(0).cast("long").alias("n_before"))
    now = states.select(F.col("key").alias("answer"), (F.col("n_read") + 1).alias("turn"), F.lit("").alias("guess"), F.lit(0).alias("code"), F.col("n").alias("n_before"))
    scratch_table(past.unionByName(now), "read-games").createOrReplaceTempView("read_games")
    again = spark.sql(P.prompts("read_games", True)).select(F.col("answer").alias("key"), (F.col("turn") - 1).alias("n_read"), "variant", F.col("prompt").alias("again"))
    return h.join(again, ["key", "n_read", "variant"], "left").drop("key", "h", "n")


@query(f"""{lists_oracle()}, {list_games_oracle('full')}, p AS (SELECT variant, substr(sha256(concat('render|', answer, '|', turn, '|', variant)), 1, 1) AS d FROM (SELECT answer, turn, unnest([{", ".join(f"'{v}'" for v in P.VARIANTS)}]) AS variant FROM lg))
    SELECT 'clean' AS tab, variant, count(*) AS prompts, 0::BIGINT AS unread, 0::BIGINT AS different, 0::BIGINT AS changed FROM p GROUP BY variant UNION ALL SELECT 'planted', variant, count(*), 0, count(*) FILTER (WHERE d = '0'), count(*) FILTER (WHERE d = '1') FROM p GROUP BY variant""")
def prompt_rerender(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve variants read back and rendered again: texts that differ, and rows whose other columns changed; on the
    prompts as they are, and on a copy where some texts have a blank more and some rows another turn."""
    list_games(spark, sf_dir, "full").createOrReplaceTempView("lg_full")
    rows = scratch_table(spark.sql(P.prompts("lg_full", True)), "prompts")
    digit = F.substring(F.sha2(F.concat(F.lit("render|"), "answer", F.lit("|"), F.col("turn").cast("string"), F.lit("|"), "variant"), 256), 1, 1)
    others = lambda turn: F.sha2(F.to_json(F.struct("answer", turn.alias("turn"), "variant")), 256)
    out = None
    for tab in ("clean", "planted"):
        told = rows if tab == "clean" else rows.withColumn("prompt", F.when(digit == "0", F.concat("prompt", F.lit(" "))).otherwise(F.col("prompt")))
        own = rendered_again(spark, told.withColumn("before", others(F.col("turn")))).withColumn("after", others(F.col("turn") + F.lit(tab == "planted").cast("int") * (digit == "1").cast("int")))
        own = own.groupBy(F.lit(tab).alias("tab"), "variant").agg(F.count("*").alias("prompts"), F.count_if(F.col("n_read") != F.col("turn") - 1).alias("unread"), F.count_if(~F.col("again").eqNullSafe(F.col("prompt"))).alias("different"), F.count_if(F.col("before") != F.col("after")).alias("changed"))
        out = scratch_table(own, "rendered") if out is None else out.unionByName(scratch_table(own, "rendered"))
    return out
