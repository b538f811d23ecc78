"""Vocabularies from raw text and from word lists."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTH = 5


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, word: lower-cased runs of letters."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.split(F.lower(text_col), r"[^\p{L}]+")).alias("word")).where("word <> ''")


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, uses, documents: five-letter words of a to z."""
    return tokens(docs, id_col, text_col).where(F.col("word").rlike("^[a-z]{5}$")).groupBy("word").agg(F.count("*").alias("uses"), F.countDistinct("doc_id").alias("documents"))


@F.pandas_udf(T.StringType())
def without_accents(words: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; batches of words, used on word lists."""
    return words.map(lambda w: w if w is None or w.isascii() else "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)))


def judged_words(raw: DataFrame, column: str = "value", length: int = LENGTH) -> DataFrame:
    """Each token of a word list with its place, its normal form and what became of it.

    Tokens are split at blanks and commas; quotes around them, capitals and accents go. fate: empty, bad_length, non_alpha,
    duplicate (a later place of a kept word) or kept.
    """
    each = raw.select(F.monotonically_increasing_id().alias("line"), F.posexplode(F.split(F.regexp_replace(column, ",", " "), r"\s+")).alias("place", "token")).where("token <> ''")
    bare = F.regexp_replace(F.regexp_replace("token", '^"+|"+$', ""), "^'+|'+$", "")
    each = each.withColumn("bare", bare).withColumn("low", F.lower("bare")).withColumn("word", without_accents("low"))
    sound = F.when(F.col("bare") == "", "empty").when(F.length("word") != length, "bad_length").when(~F.col("word").rlike("^[a-z]+$"), "non_alpha")
    each = each.withColumn("fate", sound)
    first = each.where("fate is null").groupBy("word").agg(F.min(F.struct("line", "place")).alias("first"))
    each = each.join(first, "word", "left")
    kept = F.when(F.struct("line", "place") == F.col("first"), "kept").otherwise("duplicate")
    return each.select("line", "place", "token", "word", (F.col("bare") != F.col("low")).alias("uppercased"), (F.col("low") != F.col("word")).alias("accented"), F.coalesce("fate", kept).alias("fate"))


def normalize_words(raw: DataFrame, column: str = "value", length: int = LENGTH, strict: bool = False) -> DataFrame:
    """Words of a text file in order of first place, deduplicated; strict raises where a token had to be rejected."""
    words = judged_words(raw, column, length)
    if strict:
        stats = normalize_stats(raw, column, length).first()
        if stats["bad_length"] or stats["non_alpha"]:
            raise ValueError(f"rejected words: {stats.asDict()}")
    return words.where("fate = 'kept'").orderBy("line", "place").select("word")


def normalize_stats(raw: DataFrame, column: str = "value", length: int = LENGTH) -> DataFrame:
    """One row: tokens read, empty, with capitals, with accents, rejected by length or by letters, repeated, kept."""
    fate = lambda name: F.count_if(F.col("fate") == name)
    return judged_words(raw, column, length).agg(
        F.count("*").alias("raw_tokens"), fate("empty").alias("empty"), F.count_if((F.col("fate") != "empty") & F.col("uppercased")).alias("uppercased"), F.count_if((F.col("fate") != "empty") & F.col("accented")).alias("accented"),
        fate("bad_length").alias("bad_length"), fate("non_alpha").alias("non_alpha"), fate("duplicate").alias("duplicates"), fate("kept").alias("kept"),
    )


def load_vocabulary(spark: SparkSession, answers: str, guesses: str | None = None, extras: bool | None = None) -> DataFrame:
    """word, is_answer. The second file holds further legal words (extras) or all of them; unless said, it is read as
    extras if it shares no word with the first. Answers are legal in any case."""
    own = normalize_words(spark.read.text(answers)).select("word", F.lit(True).alias("is_answer"))
    if guesses is None:
        return own.orderBy("word")
    listed = normalize_words(spark.read.text(guesses))
    if extras is False or (extras is None and not listed.join(own, "word", "left_semi").isEmpty()):
        return listed.join(own, "word", "full").select("word", F.coalesce("is_answer", F.lit(False)).alias("is_answer")).distinct().orderBy("word")
    return own.unionByName(listed.join(own, "word", "left_anti").select("word", F.lit(False).alias("is_answer"))).orderBy("word")
