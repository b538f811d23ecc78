"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its content says: at a sentence end after `CHUNK_MIN` characters or more; where
`CHUNK_MID` hold none, after a rare ending of a word; and at `CHUNK_MAX` at the latest. So cuts fall in with each other
again after a difference, and a chunk is a short identifier that any document can share. The chunk dictionary verifies
identifiers: one that stands for two different second hashes is ambiguous, and documents that hold it are told
apart by the digest of their whole text. Texts are equal when their ordered identifier lists are. Only recipes
(8 bytes a chunk) are shuffled; a text is read once and never moved.

Groups are written before rows are joined to them, so the rows of a hot group can be split; the dictionary's ambiguous
identifiers are looked up in the recipes only if there are any.

Defined results: a null text is the empty text; a null doc_id ranks below all others; rows that repeat a doc_id
with the same text count each, and are all marked as kept if that id is the one that stays (`drop_copies` leaves one of
them); texts of any length are compared whole, by the identifiers of all their chunks; empty input, empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ascii_lower, keep_one_each, scratch_table, text_rows

CHUNK_MIN, CHUNK_MID, CHUNK_MAX = 512, 4096, 8192
CHUNK = rf"(?s).{{{CHUNK_MIN},{CHUNK_MID}}}?(?:[.!?\n]\s|[。！？])|.{{{CHUNK_MIN},{CHUNK_MAX}}}?[bdglr][aeiou][mnrst]\P{{L}}|.{{1,{CHUNK_MAX}}}"


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256, n_bytes, recipe (ordered chunk identifiers), proof (a second hash of each chunk)."""
    norm = text_rows(docs, id_col, text_col).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    cut = norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").cast("long").alias("n_bytes"), F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)).alias("chunks"))
    return cut.select("doc_id", "text_sha256", "n_bytes", F.transform("chunks", lambda c: F.xxhash64(c)).alias("recipe"), F.transform("chunks", lambda c: F.xxhash64(F.lit(0x5EED), c)).alias("proof"))


def chunk_dictionary(recipe_rows: DataFrame) -> DataFrame:
    """One row per chunk identifier: occurrences, and whether one second hash stands behind all of them."""
    each = recipe_rows.select(F.explode(F.arrays_zip("recipe", "proof")).alias("c")).select("c.recipe", "c.proof")
    return each.groupBy(F.col("recipe").alias("chunk_id")).agg(F.count("*").alias("uses"), (F.min("proof") == F.max("proof")).alias("verified"))


def groups_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, keep_rows (rows of the group that have keep_id)."""
    rows = scratch_table(recipes(docs, id_col, text_col), "recipes")
    ambiguous = scratch_table(chunk_dictionary(rows).where(~F.col("verified")).select("chunk_id"), "ambiguous", 8)
    keyed = rows.drop("proof").withColumn("told_apart", F.lit(""))
    if ambiguous.limit(1).count():
        doubtful = rows.select("text_sha256", F.explode("recipe").alias("chunk_id")).join(ambiguous, "chunk_id", "left_semi").select(F.col("text_sha256").alias("apart")).distinct()
        keyed = keyed.join(doubtful, F.col("text_sha256") == F.col("apart"), "left").withColumn("told_apart", F.coalesce("apart", F.lit(""))).drop("apart")
    key = ["recipe", "n_bytes", "told_apart"]
    each = keyed.groupBy(*key, "doc_id").agg(F.count("*").alias("n"))
    groups = each.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.coalesce(F.max_by("n", "doc_id"), F.max("n")).alias("keep_rows"))
    return keyed.join(scratch_table(groups, "groups"), key).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "keep_rows")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document, dropped ones too."""
    return groups_of(docs, id_col, text_col).drop("keep_rows")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, all columns: of the largest doc_id; of rows that repeat it, the one whose JSON is least."""
    rows = scratch_table(groups_of(docs, id_col, text_col).where("kept").select("doc_id", F.col("text_sha256").alias("key"), "keep_rows", F.lit(True).alias("once")), "kept")
    digest = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    return keep_one_each(docs, rows, digest, id_col, bool(rows.where("keep_rows > 1").limit(1).count()))
