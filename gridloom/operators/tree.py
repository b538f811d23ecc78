"""Search of game trees as joins over distinct sets of answers, level by level, all states at once.

A set's value with so many guesses left is the least of its actions': the set's size, and the values of the sets that an
action leaves. Actions are the set's members and the others that leave least. After `depth` plies values are those of greedy
lines, played out by the member that leaves least; a greedy line has a cost and a length, whatever is left, so a set has one
line. A set that is met twice, under whatever state, is one row. Costs are whole numbers: guesses summed over a set.

`adaptive_values` solves the game in which every action must agree with what is known, to its end, for states of few words.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.feedback import ALL_RIGHT
from gridloom.operators.loop import Lists, own_choices, set_key, split_sets, with_code
from gridloom.operators.packed import best_splitters, codes, letters_of
from gridloom.session import scratch_table

LARGEST, FAILED, TURNS = 20, 7, 6
#: Fixed value: the cost of what can't be finished in time.
INFEASIBLE = 1 << 30


@dataclass(frozen=True)
class TreeConfig:
    """depth: plies of lookahead; top_k: actions beside a set's members."""

    depth: int = 2
    top_k: int = 10
    turns: int = TURNS


def distinct_sets(states: DataFrame, lists: Lists) -> DataFrame:
    """states: state, answer -> state, cset, members."""
    placed = states.join(F.broadcast(lists.targets), "answer")  # the answers, a bounded list
    return placed.groupBy("state").agg(F.array_sort(F.collect_list("aid")).alias("members")).withColumn("cset", set_key(F.col("members")))


def wider(sets: DataFrame) -> DataFrame:
    """Sets whose value isn't known by their size."""
    return sets.where(F.size("members") > 2).select("cset", "members").dropDuplicates(["cset"])


def split(lists: Lists, sets: DataFrame, moves: DataFrame) -> DataFrame:
    """sets: cset, members; moves: cset, guess -> cset, guess, child, members: what each move leaves but for the hit."""
    targets = lists.targets.select(F.col("aid").alias("id"), F.col("answer").alias("word"))
    return split_sets(sets, moves, "cset", targets).select("cset", "guess", "child", "members")


def children(edges: DataFrame) -> DataFrame:
    return wider(edges.select(F.col("child").alias("cset"), "members"))


def greedy_moves(lists: Lists, sets: DataFrame) -> DataFrame:
    """cset, guess: the member that leaves least, the first of equals."""
    asks = scratch_table(sets.select("*", F.monotonically_increasing_id().alias("ask")), "greedy")
    plain = [F.lit(0.0).alias(c) for c in ("a", "lam", "nu", "mu")]
    chosen = own_choices(lists, asks.select("ask", "members", F.lit(None).cast("array<int>").alias("allowed"), F.lit(0).cast("long").alias("draw"), F.lit("expected").alias("metric"), *plain))
    return chosen.join(asks.select("ask", "cset"), "ask").join(lists.legal, "gid").select("cset", "guess")


def known(size: Column, left: Column, more: Column) -> Column:
    """Cost of a set with so many guesses left: one, three, or what `more` says."""
    return F.when(size == 1, 1).when(left <= 1, INFEASIBLE).when(size == 2, 3).otherwise(F.coalesce(more, F.lit(INFEASIBLE)))


def total(parts: DataFrame, *by: str) -> DataFrame:
    """parts: by, n (the set's size), cost (of what is left, null: nothing) -> by, cost."""
    return parts.groupBy(*by).agg(F.least(F.lit(INFEASIBLE), F.first("n") + F.coalesce(F.sum("cost"), F.lit(0))).cast("long").alias("cost"))


def greedy_lines(lists: Lists, sets: DataFrame, turns: int = TURNS) -> DataFrame:
    """sets: cset, members of three or more -> cset, cost, depth of the greedy line; none for lines of more than `turns`."""
    levels = []
    while len(levels) < turns and not sets.isEmpty():
        levels.append(scratch_table(split(lists, sets, greedy_moves(lists, sets)), "lines"))
        sets = children(levels[-1])
    found = None
    for edges in reversed(levels):
        size = F.size("members")
        each = edges.select("cset", "child", size.alias("k"))
        if found is None:
            each = each.withColumns({"c": F.lit(None).cast("long"), "d": F.lit(None).cast("int")})
        else:
            each = each.join(found.select(F.col("cset").alias("child"), F.col("cost").alias("c"), F.col("depth").alias("d")), "child", "left")
        cost, depth = F.when(F.col("k") == 1, 1).when(F.col("k") == 2, 3).otherwise(F.col("c")), F.when(F.col("k") <= 2, F.col("k")).otherwise(F.col("d"))
        # the member that is played is hit by itself: the set's size is one more than what is left
        found = each.groupBy("cset").agg((F.sum("k") + 1 + F.sum(cost)).cast("long").alias("cost"), (F.max(depth) + 1).cast("int").alias("depth"), F.count_if(cost.isNull()).alias("open")).where("open = 0").drop("open")
    return found if found is not None else lists.spark.createDataFrame([], "cset string, cost long, depth int")


def action_values(lists: Lists, sets: DataFrame, left: int, config: TreeConfig, depth: int | None = None) -> DataFrame:
    """sets: cset, members of three or more -> cset, guess, isc, sumsq, cost of every action with `left` guesses, two or more."""
    depth = config.depth if depth is None else depth
    pool = scratch_table(best_splitters(lists.packed, sets, config.top_k), "pool")
    edges = scratch_table(split(lists, sets, pool.select("cset", "guess")), "edges")
    below = children(edges)
    if left <= 2 or below.isEmpty():
        values = lists.spark.createDataFrame([], "cset string, v long")
    elif depth > 1:
        values = action_values(lists, below, left - 1, config, depth - 1).groupBy("cset").agg(F.min("cost").alias("v"))
    else:
        values = greedy_lines(lists, below, config.turns).where(F.col("depth") <= left - 1).select("cset", F.col("cost").alias("v"))
    each = edges.select("cset", "guess", "child", F.size("members").alias("k")).join(values.withColumnRenamed("cset", "child"), "child", "left")
    parts = pool.join(each, ["cset", "guess"], "left").join(sets.select("cset", F.size("members").alias("n")), "cset")
    cost = F.when(F.col("k").isNotNull(), known(F.col("k"), F.lit(left - 1), F.col("v")))
    return total(parts.select("cset", "guess", "isc", "sumsq", "n", cost.alias("cost")), "cset", "guess", "isc", "sumsq")


def best_actions(values: DataFrame) -> DataFrame:
    """cset, cost, guess: members before others, those by what they leave, then the alphabet; none where no action ends in time."""
    order = F.struct("cost", -F.col("isc"), F.when(F.col("isc") == 1, 0).otherwise(F.col("sumsq")), "guess")
    return values.where(F.col("cost") < INFEASIBLE).groupBy("cset").agg(F.min_by(F.struct("cost", "guess"), order).alias("b")).select("cset", "b.cost", "b.guess")


def tree_values(lists: Lists, states: DataFrame, turn: int, config: TreeConfig = TreeConfig()) -> DataFrame:
    """states: state, answer -> state, n, cost (null: can't be finished), guess."""
    states = scratch_table(distinct_sets(states, lists), "states")
    found = best_actions(action_values(lists, wider(states), config.turns - turn + 1, config))
    n, first = F.size("members"), lists.targets.select(F.col("aid").alias("first"), "answer")
    each = states.withColumn("first", F.col("members")[0]).join(F.broadcast(first), "first").join(found, "cset", "left")
    return each.select("state", n.cast("long").alias("n"), F.when(n == 1, 1).when(n == 2, 3).otherwise(F.col("cost")).cast("long").alias("cost"), F.when(n <= 2, F.col("answer")).otherwise(F.col("guess")).alias("guess"))


def tree_games(lists: Lists, states: DataFrame, turn: int, config: TreeConfig = TreeConfig()) -> DataFrame:
    """states: state, answer -> the games' turns from `turn` on: answer, turn, guess, code, n_before, state."""
    games, out = states.select("state", "answer"), None
    for now in range(turn, config.turns + 1):
        own = scratch_table(distinct_sets(games, lists), "states")
        wide = scratch_table(wider(own), "wide")
        first = own.withColumn("first", F.col("members")[0]).join(F.broadcast(lists.targets.select(F.col("aid").alias("first"), "answer")), "first").select("state", "cset", F.size("members").cast("long").alias("n_before"), F.col("answer").alias("only"))
        if not wide.isEmpty():
            chosen = greedy_moves(lists, wide)
            if config.depth and now < config.turns:
                found = best_actions(action_values(lists, wide, config.turns - now + 1, config)).select("cset", F.col("guess").alias("found"))
                chosen = chosen.join(found, "cset", "left").select("cset", F.coalesce("found", "guess").alias("guess"))
            first = first.join(chosen, "cset", "left").withColumn("only", F.when(F.col("n_before") <= 2, F.col("only")).otherwise(F.col("guess"))).drop("guess")
        played = with_code(games.join(first.select("state", "n_before", F.col("only").alias("guess")), "state"), "guess", "answer")
        played = scratch_table(played.select("answer", F.lit(now).alias("turn"), "guess", "code", "n_before", "state"), "turn")
        out = played if out is None else out.unionByName(played)
        games = played.where(F.col("code") != ALL_RIGHT).select(F.concat("state", F.lit("|"), "guess", F.lit(":"), F.col("code").cast("string")).alias("state"), "answer")
    return out


def action_costs(actions: Iterable[str], candidates: Iterable[str], left: int) -> dict[str, int]:
    """Total cost of each action, of a game in which all later actions agree with the feedback, too."""
    words = sorted(actions)
    table = codes(letters_of(words), letters_of(words)).tolist()
    possible = [w in set(candidates) for w in words]

    def branch(g: int, alive: tuple[int, ...], left: int) -> int:
        parts: dict[int, list[int]] = {}
        for a in alive:
            parts.setdefault(table[g][a], []).append(a)
        return sum(possible[a] for a in alive) + sum(cost(tuple(p), left - 1) for c, p in parts.items() if c != ALL_RIGHT)

    @lru_cache(maxsize=None)
    def cost(alive: tuple[int, ...], left: int) -> int:
        n = sum(possible[a] for a in alive)
        if not n:
            return 0
        if left <= 0:
            return FAILED * n
        if n == 1:
            return 1
        return min(branch(g, alive, left) for g in alive)

    return {words[g]: branch(g, tuple(range(len(words))), left) for g in range(len(words))}


def adaptive_values(states: DataFrame, left: int | None = None) -> DataFrame:
    """states: state, word, isc (it can be the answer), of at most LARGEST words each, and left (guesses) unless one number is
    given for all -> state, guess, cost, optimal."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        costs = action_costs(pdf["word"], pdf["word"][pdf["isc"] == 1], int(pdf["left"].iloc[0]))
        best = min(costs.values())
        return pd.DataFrame({"state": pdf["state"].iloc[0], "guess": list(costs), "cost": list(costs.values()), "optimal": [c == best for c in costs.values()]})

    rows = states if left is None else states.withColumn("left", F.lit(left))
    return rows.select("state", "word", "isc", "left").groupBy("state").applyInPandas(solve, "state string, guess string, cost long, optimal boolean")
