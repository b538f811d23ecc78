"""Many rollouts of a policy with chance, turn by turn, and the acceptance of their states under quotas.

A rollout is a game of an answer under a numbered draw; what it does in a turn follows from hashes of both. States are known by
their candidates and their admissible words, as in `loop`. Acceptance is that of a reader who takes visits in a total order
and keeps one if its bucket and its answer have room, its state is new and its rollout has given none yet. It runs in rounds:
a visit is sure once it is the first undecided one of its state and of its rollout, and would still fit if all undecided
visits before it in its bucket and its answer were kept. The first undecided visit always is, so rounds end, with the same
visits as the reader's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.feedback import ALL_RIGHT
from gridloom.operators.loop import TURNS, Lists, hash_number, set_key, split_sets, wide_choices, with_code
from gridloom.session import scratch_table


@dataclass(frozen=True)
class Rollout:
    """expert: share of second turns played by entropy. Else, where at most `restricted` words are admissible one of them; in
    wider states a candidate, an admissible word (shares), or any legal word."""

    seed: str
    expert: float = 0.7
    candidate: float = 0.5
    admissible: float = 0.4
    restricted: int = 20
    turns: int = TURNS - 1


def share_of(*parts: Column) -> Column:
    """A number from 0 to 1 of a hash."""
    return hash_number(*parts) / F.lit(4294967296.0)


def rollouts(lists: Lists, answers: DataFrame, draws: int, opener: str, policy: Rollout) -> DataFrame:
    """answers: answer -> answer, draw, turn, n (candidates), n_adm, state (the way there), after every turn but a hit: the
    state in which `turn` is to be played."""
    spark = lists.spark
    root = spark.createDataFrame([(list(range(len(lists.answers))), list(range(len(lists.words))))], "c array<int>, a array<int>").coalesce(1)
    sets, adm = (root.select(set_key(F.col(x)).alias(k), F.col(x).alias("members")) for x, k in (("c", "cset"), ("a", "aset")))
    words = lists.legal.select(F.col("gid").alias("id"), F.col("guess").alias("word"))
    targets = lists.targets.select(F.col("aid").alias("id"), F.col("answer").alias("word"))
    start = root.select(set_key(F.col("c")).alias("cset"), set_key(F.col("a")).alias("aset"))
    games = answers.select("answer", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("draw")).crossJoin(F.broadcast(start)).withColumn("state", F.lit(""))  # one row
    out = None
    for turn in range(1, policy.turns + 1):
        if turn == 1:
            moves = games.withColumn("guess", F.lit(opener))
        else:
            own = games.join(sets.withColumnRenamed("members", "c"), "cset").join(adm.withColumnRenamed("members", "a"), "aset")
            names = [F.lit(policy.seed), F.col("answer"), F.col("draw").cast("string"), F.lit(str(turn))]
            kind, pick = share_of(F.lit("kind"), *names), hash_number(F.lit("pick"), *names)
            few, n, k = F.size("a") <= policy.restricted, F.size("c"), F.size("a")
            expert = (share_of(F.lit("expert"), *names) < policy.expert) if turn == 2 else F.lit(False)
            some_word = F.when(few | ((kind >= policy.candidate) & (kind < policy.candidate + policy.admissible)), F.get("a", (pick % k).cast("int"))).when(kind >= policy.candidate + policy.admissible, (pick % len(lists.words)).cast("int"))
            own = own.select("answer", "draw", "cset", "aset", "state", expert.alias("by_expert"), some_word.alias("gid"), F.get("c", (pick % n).cast("int")).alias("aid"))
            own = own.join(F.broadcast(lists.legal), "gid", "left").join(F.broadcast(lists.targets.withColumnRenamed("answer", "candidate")), "aid")
            own = own.withColumn("guess", F.coalesce("guess", "candidate"))
            if turn == 2 and policy.expert:
                asks = sets.select(F.monotonically_increasing_id().alias("ask"), "cset", "members", F.lit("entropy").alias("metric"), *[F.lit(0.0).alias(c) for c in ("a", "lam", "nu", "mu")])
                asks = scratch_table(asks, "asks")
                best = wide_choices(lists.packed, asks).join(asks.select("ask", "cset"), "ask").join(lists.legal.withColumnRenamed("guess", "best"), "gid").select("cset", "best")
                own = own.join(best, "cset").withColumn("guess", F.when(F.col("by_expert"), F.col("best")).otherwise(F.col("guess")))
            moves = own.select("answer", "draw", "cset", "aset", "state", "guess")
        going = scratch_table(with_code(moves, "guess", "answer").where(F.col("code") != ALL_RIGHT), "moves")
        split = scratch_table(split_sets(sets, going.select("cset", "guess").distinct(), "cset", targets), "sets")
        narrow = scratch_table(split_sets(adm, going.select("aset", "guess").distinct(), "aset", words), "admissible")
        sets, adm = (x.groupBy(F.col("child").alias(key)).agg(F.first("members").alias("members")) for x, key in ((split, "cset"), (narrow, "aset")))
        going = going.join(split.select("cset", "guess", "code", F.col("child").alias("next"), F.size("members").cast("long").alias("n")), ["cset", "guess", "code"])
        going = going.join(narrow.select("aset", "guess", "code", F.col("child").alias("next_adm"), F.size("members").cast("long").alias("n_adm")), ["aset", "guess", "code"])
        going = going.select("answer", "draw", F.lit(turn + 1).alias("turn"), F.col("next").alias("cset"), F.col("next_adm").alias("aset"), "n", "n_adm", F.concat("state", F.lit("|"), "guess", F.lit(":"), F.col("code").cast("string")).alias("state"))
        games = scratch_table(going, "rollouts")
        seen = games.select("answer", "draw", "turn", "n", "n_adm", "state")
        out = seen if out is None else out.unionByName(seen)
        games = games.where("n > 1").drop("n", "n_adm", "turn")
    return out


def accepted(visits: DataFrame, quotas: dict[str, int], per_answer: int) -> DataFrame:
    """visits: place (a hash in hex that orders rollouts), turn, rollout, answer, bucket, state -> the visits that a reader in
    the order of place and turn keeps: so many of a bucket, `per_answer` of an answer, a state once, one of a rollout.

    Ranks within a bucket are counted by the place's first two digits first, so no bucket is one task's work.
    """
    spark = visits.sparkSession
    names = ["place", "turn", "rollout", "answer", "bucket", "state"]
    limits = spark.createDataFrame(list(quotas.items()), "bucket string, quota int")
    left, kept = scratch_table(visits.select(*names).join(F.broadcast(limits), "bucket", "left_semi"), "visits"), None
    order = ["place", "turn", "rollout"]
    while not left.isEmpty():
        taken = F.broadcast(limits) if kept is None else limits.join(kept.groupBy("bucket").agg(F.count("*").alias("k")), "bucket", "left").select("bucket", (F.col("quota") - F.coalesce("k", F.lit(0))).alias("quota"))
        cell = left.withColumn("cell", F.substring("place", 1, 2))
        sizes = cell.groupBy("bucket", "cell").agg(F.count("*").alias("c"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = cell.withColumn("in_cell", F.row_number().over(Window.partitionBy("bucket", "cell").orderBy(*order))).join(sizes.withColumn("before", before), ["bucket", "cell"])
        first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        ranked = ranked.withColumns({"of_state": first("state"), "of_rollout": first("rollout"), "of_answer": first("answer")}).join(F.broadcast(taken), "bucket")
        room = F.lit(per_answer)
        if kept is not None:
            ranked = ranked.join(kept.groupBy("answer").agg(F.count("*").alias("had")), "answer", "left")
            room = F.lit(per_answer) - F.coalesce("had", F.lit(0))
        sure = scratch_table(ranked.where((F.col("of_state") == 1) & (F.col("of_rollout") == 1) & (F.col("before") + F.col("in_cell") <= F.col("quota")) & (F.col("of_answer") <= room)).select(*names), "sure")
        kept = sure if kept is None else scratch_table(kept.unionByName(sure), "kept")
        rest = left
        for key in ("state", "rollout"):
            rest = rest.join(sure.select(key).distinct(), key, "left_anti")
        full = kept.groupBy("bucket").agg(F.count("*").alias("k")).join(limits, "bucket").where("k >= quota").select("bucket")
        done = kept.groupBy("answer").agg(F.count("*").alias("k")).where(F.col("k") >= per_answer).select("answer")
        left = scratch_table(rest.join(F.broadcast(full), "bucket", "left_anti").join(done, "answer", "left_anti").select(*names), "left")
    return kept if kept is not None else left
