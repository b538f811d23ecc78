"""All games of all settings in one loop, turn by turn, with decisions taken once for each distinct set of answers.

A setting is a row: a metric and its weights, which guesses it may make, a seed, how many games it plays. A state is known
by its candidates, not by the way to them: by the digest of their sorted places, and, where the setting asks for it, by that
of its admissible words (legal words that agree with all feedback). So settings and histories that meet in a set share its
statistics, and settings whose next move is the same share the sets that come of it.

A turn: states become asks (a set, a setting's metric, the words allowed). Asks that may use every legal word are answered
over the packed table, each partition giving its best guess; others compare their own few words; chance draws a place
among the words allowed by a hash of seed and set. Then distinct moves split sets, and games follow by joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.feedback import ALL_RIGHT, feedback_code
from gridloom.operators import packed as P
from gridloom.session import scratch_table
from gridloom.sources.files import exists, read_record, write_record

TURNS, FAILED, ENDGAME = 6, 7, 2
METRICS = ("entropy", "expected", "minimax", "hybrid", "chance")
#: full: any legal word; adaptive: candidates alone once at most `threshold` are left; hard: admissible words; restricted:
#: admissible words once at most `threshold` are left; candidates: those alone.
POOLS = ("full", "adaptive", "hard", "restricted", "candidates")
TRACKED = ("hard", "restricted")


@dataclass(frozen=True)
class Setting:
    """a, lam, nu, mu: weights of the hybrid metric; games: how many answers are played (0: all), drawn by a hash."""

    setting: str
    metric: str = "entropy"
    pool: str = "full"
    threshold: int = 0
    a: float = 1.0
    lam: float = 0.0
    nu: float = 0.0
    mu: float = 0.0
    seed: str = ""
    games: int = 0


SETTINGS = "setting string, metric string, pool string, threshold int, a double, lam double, nu double, mu double, seed string, games int"
CHOICE = "ask long, score double, tie int, gid int"


def settings_table(spark: SparkSession, settings: list[Setting]) -> DataFrame:
    for s in settings:
        if s.metric not in METRICS or s.pool not in POOLS:
            raise ValueError(f"no such metric or pool: {s}")
    assert [f.name for f in fields(Setting)] == [c.split()[0] for c in SETTINGS.split(", ")]
    return spark.createDataFrame([astuple(s) for s in settings], SETTINGS)


def set_key(members: Column) -> Column:
    """A set's name: the digest of its sorted places."""
    return F.sha2(F.concat_ws(",", members.cast("array<string>")), 256)


def hash_number(*parts: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


# -- answers to asks ----------------------------------------------------------------------------------------------


def scored(metric: str, weights: tuple[float, ...], n: int, sumsq: np.ndarray, worst: np.ndarray, kl: np.ndarray, isc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a metric makes least, and what then decides; equal to nine digits counts as equal."""
    if metric == "expected":
        return sumsq.astype(float), -isc.astype(int)
    if metric == "minimax":
        return worst.astype(float), -isc.astype(int)
    h = np.log2(n) - kl / n
    if metric == "entropy":
        return -np.round(h, 9), -isc.astype(int)
    a, lam, nu, mu = weights
    value = a * h - lam * np.log2(worst) - nu * np.log2(sumsq / n) + mu * np.where(isc, np.log2(1 + 1 / n), 0)
    return -np.round(value, 9), np.zeros(len(isc), int)


def best(score: np.ndarray, tie: np.ndarray, gid: np.ndarray) -> tuple[float, int, int]:
    at = np.flatnonzero(score == score.min())
    at = at[tie[at] == tie[at].min()]
    k = at[gid[at].argmin()]
    return float(score[k]), int(tie[k]), int(gid[k])


def wide_choices(packed: DataFrame, asks: DataFrame) -> DataFrame:
    """asks: ask, cset, members, metric, a, lam, nu, mu -> the best guess of each partition; a set is scored once for all asks."""
    sets = asks.groupBy("cset").agg(F.first("members").alias("members"), F.collect_list(F.struct("ask", "metric", "a", "lam", "nu", "mu")).alias("asked"))
    out = None
    for block in P.in_blocks(sets.coalesce(1).toLocalIterator(), lambda r: 4 * len(r["members"]) + 64 * len(r["asked"])):
        members = [np.array(r["members"], np.int64) for r in block]
        asked = [[(x["ask"], x["metric"], (x["a"], x["lam"], x["nu"], x["mu"])) for x in r["asked"]] for r in block]

        def answer(batches: Iterator[pa.RecordBatch], members=members, asked=asked) -> Iterator[pa.RecordBatch]:
            found: dict[int, tuple[float, int, int]] = {}
            for batch in batches:
                for at in range(0, batch.num_rows, P.ROWS):
                    part = batch.slice(at, P.ROWS)
                    table, gid = P.cells_of(part), part.column(0).to_numpy()
                    for which, own in P.by_size(members, len(table)):
                        stats = P.set_statistics(table, own)
                        for k, row in enumerate(which.tolist()):
                            for ask, metric, weights in asked[row]:
                                new = best(*scored(metric, weights, own.shape[1], *(x[:, k] for x in stats)), gid)
                                found[ask] = min(found.get(ask, new), new)
            rows = [(a, *f) for a, f in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=["ask", "score", "tie", "gid"])

        own = packed.mapInArrow(answer, CHOICE)
        out = own if out is None else out.unionByName(own)
    if out is None:
        return packed.sparkSession.createDataFrame([], "ask long, gid int")
    return out.groupBy("ask").agg(F.min_by("gid", F.struct("score", "tie", "gid")).alias("gid"))


def own_choices(lists: Lists, asks: DataFrame) -> DataFrame:
    """asks: ask, allowed (places of words; null: the candidates), members, draw, metric and weights -> ask, gid. Few words
    against few; chance takes the word at its place."""
    legal, targets, as_word = P.letters_of(lists.words), P.letters_of(lists.answers), np.array(lists.as_word, np.int32)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gids = []
            for r in batch.to_pylist():
                members = np.array(r["members"])
                gid = as_word[members] if r["allowed"] is None else np.array(r["allowed"])
                if r["metric"] == "chance":
                    gids.append(int(gid[r["draw"] % len(gid)]))
                    continue
                table = P.codes(legal[gid], targets[members])
                stats = [x[:, 0] for x in P.set_statistics(table, np.arange(len(members))[None, :])]
                gids.append(best(*scored(r["metric"], (r["a"], r["lam"], r["nu"], r["mu"]), len(members), *stats), gid)[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gids, pa.int32())], names=["ask", "gid"])

    return asks.select("ask", "allowed", "members", "draw", "metric", "a", "lam", "nu", "mu").mapInArrow(answer, "ask long, gid int")


# -- the loop -----------------------------------------------------------------------------------------------------


class Lists:
    """The legal words and the answers among them, known by their places in the alphabet, and the packed table."""

    def __init__(self, vocab: DataFrame, answers: DataFrame) -> None:
        """vocab: word; answers: answer. Both have at most packed.MOST_WORDS rows."""
        self.spark = vocab.sparkSession
        self.words = sorted(r[0] for r in vocab.select("word").take(P.MOST_WORDS + 1))
        if len(self.words) > P.MOST_WORDS:
            raise ValueError(f"over {P.MOST_WORDS} words")
        place = {w: k for k, w in enumerate(self.words)}
        self.answers = sorted(r[0] for r in answers.select("answer").take(P.MOST_WORDS + 1) if r[0] in place)
        self.as_word = [place[a] for a in self.answers]
        self.legal = scratch_table(self.spark.createDataFrame(list(enumerate(self.words)), "gid int, guess string").coalesce(1), "legal")
        self.targets = scratch_table(self.spark.createDataFrame(list(enumerate(self.answers)), "aid int, answer string").coalesce(1), "targets")
        parts = self.spark.sparkContext.defaultParallelism
        self.packed = scratch_table(P.packed_matrix(self.legal.repartition(parts, "gid"), self.answers), "packed")


def with_code(df: DataFrame, guess: str, answer: str) -> DataFrame:
    each = [F.substring(word, i, 1).alias(f"{x}{i}") for x, word in (("g", guess), ("a", answer)) for i in range(1, 6)]
    return df.select("*", *each).withColumn("code", F.expr(f"CAST({feedback_code()} AS INT)")).select(*df.columns, "code")


def split_sets(sets: DataFrame, moves: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """sets: key, members; moves: key, guess; words: id, word -> key, guess, code, child (its name), members (the child's)."""
    each = moves.join(sets, key).select(key, "guess", F.explode("members").alias("id")).join(words, "id")
    found = with_code(each, "guess", "word").where(F.col("code") != ALL_RIGHT)
    return found.groupBy(key, "guess", "code").agg(F.array_sort(F.collect_list("id")).alias("members")).withColumn("child", set_key(F.col("members")))


def choose(lists: Lists, table: DataFrame, states: DataFrame, sets: DataFrame, admissible: DataFrame, turn: int) -> DataFrame:
    """states: setting, cset, aset -> the same with guess, n_before, n_adm, wide (all legal words were scored)."""
    n, adm = F.size("members"), F.col("pool").isin("hard") | ((F.col("pool") == "restricted") & (F.size("adm") <= F.col("threshold")))
    alone = (n <= ENDGAME) | F.lit(turn == TURNS) | (F.col("pool") == "candidates") | ((F.col("pool") == "adaptive") & (n <= F.col("threshold")))
    asks = states.join(F.broadcast(table), "setting").join(sets, "cset").join(admissible.select("aset", F.col("members").alias("adm")), "aset", "left")
    asks = asks.select("*", (~alone & ~F.coalesce(adm, F.lit(False))).alias("wide"), F.when(~alone & adm, F.col("adm")).alias("allowed"), hash_number(F.col("seed"), F.col("cset")).alias("draw"))
    asks = scratch_table(asks.withColumn("ask", F.monotonically_increasing_id()), "asks")
    wide, chance = F.col("wide"), F.col("metric") == "chance"
    found = own_choices(lists, asks.where(~wide)).unionByName(wide_choices(lists.packed, asks.where(wide & ~chance)))
    found = found.unionByName(asks.where(wide & chance).select("ask", (F.col("draw") % len(lists.words)).cast("int").alias("gid")))
    return found.join(lists.legal, "gid").join(asks, "ask").select("setting", "cset", "aset", "guess", n.cast("long").alias("n_before"), F.when(F.col("aset") != "", F.size("adm")).cast("long").alias("n_adm"), "wide")


class Progress:
    """Turns of a loop kept in a folder: a turn's tables are written, then the record says so. A run that finds the record
    goes on behind it; a folder of other settings or lists is refused. Without a folder tables are scratch tables."""

    def __init__(self, lists: Lists, settings: list[Setting], folder: str | None) -> None:
        self.spark, self.folder, self.done = lists.spark, folder, 0
        self.run = hashlib.sha256(repr((settings, lists.words, lists.answers)).encode()).hexdigest()
        if folder and exists(self.spark, f"{folder}/progress.json"):
            found = read_record(self.spark, f"{folder}/progress.json")
            if found["run"] != self.run:
                raise ValueError(f"{folder} holds turns of other settings or lists")
            self.done = found["done"]

    def keep(self, turn: int, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not self.folder:
            return scratch_table(make(), name)
        path = f"{self.folder}/{name}-{turn}"
        if turn > self.done:
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def finished(self, turn: int) -> None:
        if self.folder and turn > self.done:
            write_record(self.spark, f"{self.folder}/progress.json", {"run": self.run, "done": turn})
            self.done = turn


def play(lists: Lists, settings: list[Setting], folder: str | None = None) -> DataFrame:
    """The games' turns: setting, answer, turn, guess, code, n_before, n_adm, wide, cset, history. With a folder, turns that it
    holds are read and not played.

    n_adm is null where the setting doesn't track admissible words; wide: every legal word was scored there.
    """
    spark = lists.spark
    table = settings_table(spark, settings)
    words = lists.legal.select(F.col("gid").alias("id"), F.col("guess").alias("word"))
    targets = lists.targets.select(F.col("aid").alias("id"), F.col("answer").alias("word"))
    root = spark.createDataFrame([(list(range(len(lists.answers))), list(range(len(lists.words))))], "c array<int>, a array<int>").coalesce(1)
    sets, admissible = (root.select(set_key(F.col(x)).alias(key), F.col(x).alias("members")) for x, key in (("c", "cset"), ("a", "aset")))
    place = F.row_number().over(Window.orderBy(F.sha2(F.concat(F.lit("size|"), "answer"), 256), "answer"))  # the answers alone, a bounded list
    games = lists.targets.select("answer", place.alias("place")).join(F.broadcast(table), F.expr("games = 0 OR place <= games"))
    start = root.select(set_key(F.col("c")).alias("cset"), set_key(F.col("a")).alias("aset"))  # one row
    games = games.crossJoin(F.broadcast(start)).select("setting", "answer", "cset", F.when(F.col("pool").isin(*TRACKED), F.col("aset")).otherwise("").alias("aset"), F.lit("").alias("history"))
    tracked, out, progress = any(s.pool in TRACKED for s in settings), None, Progress(lists, settings, folder)
    for turn in range(1, TURNS + 1):

        def move(games=games, sets=sets, admissible=admissible, turn=turn) -> DataFrame:
            chosen = choose(lists, table, games.select("setting", "cset", "aset").distinct(), sets, admissible, turn)
            return with_code(games.join(chosen, ["setting", "cset", "aset"]), "guess", "answer").withColumn("turn", F.lit(turn))

        played = progress.keep(turn, "played", move)
        out = played if out is None else out.unionByName(played)
        if turn < TURNS:
            going = played.where(F.col("code") != ALL_RIGHT)
            split = progress.keep(turn, "sets", lambda going=going, sets=sets: split_sets(sets, going.select("cset", "guess").distinct(), "cset", targets))
            sets = split.groupBy(F.col("child").alias("cset")).agg(F.first("members").alias("members"))
            going = going.join(split.select("cset", "guess", "code", F.col("child").alias("next")), ["cset", "guess", "code"]).withColumn("next_adm", F.lit(""))
            if tracked:
                narrowed = progress.keep(turn, "admissible", lambda going=going, admissible=admissible: split_sets(admissible, going.where("aset <> ''").select("aset", "guess").distinct(), "aset", words))
                admissible = narrowed.groupBy(F.col("child").alias("aset")).agg(F.first("members").alias("members"))
                going = going.drop("next_adm").join(narrowed.select("aset", "guess", "code", F.col("child").alias("next_adm")), ["aset", "guess", "code"], "left")
            games = going.select("setting", "answer", F.col("next").alias("cset"), F.coalesce("next_adm", F.lit("")).alias("aset"), F.concat("history", F.lit("|"), "guess", F.lit(":"), F.col("code").cast("string")).alias("history"))
        progress.finished(turn)
    return out.select("setting", "answer", "turn", "guess", "code", "n_before", "n_adm", "wide", "cset", "history")
