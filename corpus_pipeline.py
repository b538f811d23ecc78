"""A training corpus from `documents`: toxic texts go, then copies, near copies and benchmark leaks; the rest is packed.

Defined results: null and empty texts score as an empty bag, are copies of each other (the row of the largest doc_id stays),
have no near copies and no leaks, and end as one piece of one id; of rows that repeat doc_id and text one stays; ties in a
group go to the largest doc_id among copies, the smallest among near copies; texts of any length pass whole; extra columns
stay through all stages but the last; no documents, no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import read_table, scratch_table
from gridloom.llm.decontamination import drop_contaminated
from gridloom.llm.exact_dedup import drop_copies
from gridloom.llm.near_dedup import drop_near_copies
from gridloom.llm.packing import pack_documents
from gridloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Trained models and tokens can't be expressed in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
