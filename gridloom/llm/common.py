"""Shared plumbing: reading tables, scratch tables in shared storage, packed exchange rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import session
from gridloom.llm.kernels import slices
from gridloom.session import drop_scratch as drop_scratch
from gridloom.session import read_table as read_table

BATCH_BYTES, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most `ARROW_BYTES`, unless the session asks for less: 10,000 long texts at once would take
    hundreds of MB in the JVM's buffers and in the workers."""
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES)) > ARROW_BYTES:
        spark.conf.set(BATCH_BYTES, str(ARROW_BYTES))


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every operator works on; null texts are empty, other columns never get near the operator."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; `lower` would also touch accented letters."""
    return F.translate(text, UPPER, UPPER.lower())


def scratch_table(df: DataFrame, name: str, fold: int = 1) -> DataFrame:
    """Cuts lineage with a table written to shared storage: a lost executor re-reads it, nothing before it runs again.

    fold: rows of a few numbers are written by that share of the shuffle partitions, so that no file holds next to nothing.
    """
    if fold > 1:
        df = df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // fold))
    return session.scratch_table(df, name)


def plan_bytes(df: DataFrame) -> int:
    """Bytes of df as its plan says; 0 if the plan doesn't know (a local table, a join): it then says an absurdly large size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else 0


def shuffle_width(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Buckets of a packed exchange: they grow with the input's bytes, and with the session's shuffle partitions.

    Of plans that don't know their size the partitions decide.
    """
    spark, size = df.sparkSession, plan_bytes(df)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // bytes_each, 1 << 20), 1)


def keep_rows(docs: DataFrame, judge: Callable[[pa.RecordBatch], np.ndarray], slice_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole rows for which `judge` (of a batch of doc_id and text) is true; nothing is shuffled."""
    names = docs.columns
    bound_batches(docs.sparkSession)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, slice_bytes):
                pair = pa.RecordBatch.from_arrays([part.column(names.index(id_col)), part.column(names.index(text_col)).fill_null("")], names=["doc_id", "text"])
                yield part.filter(pa.array(judge(pair)))

    return docs.mapInArrow(chosen, docs.schema)


def keep_one_each(docs: DataFrame, keys: DataFrame, key: Column, id_col: str, repeated: bool) -> DataFrame:
    """Whole rows of docs whose doc_id and `key` stand in keys (doc_id, key, once); rows that repeat both leave one row
    where once is true: the one whose JSON is least. repeated: there may be such rows."""
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("row_id"), key.alias("row_key"))

    def held(keys: DataFrame) -> DataFrame:
        return packed.join(keys, packed["row_id"].eqNullSafe(keys["doc_id"]) & (packed["row_key"] == keys["key"]), "left_semi")

    if not repeated:
        return held(keys.select("doc_id", "key")).select("row.*")
    alone = held(keys.where("once").select("doc_id", "key")).groupBy("row_id", "row_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return held(keys.where("not once").select("doc_id", "key")).select("row.*").unionByName(alone.select("row.*"))
