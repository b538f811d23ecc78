"""JSON lines in and out, CSV tables, and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, strip_holdout: bool = False) -> None:
    """Columns whose names begin with _ are held out and left away on request."""
    df.drop(*[c for c in df.columns if strip_holdout and c.startswith("_")]).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
