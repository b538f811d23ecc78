"""Sessions, tables, and tables written to shared storage to cut lineage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The session's folder under spark.checkpoint.dir; where that is unset and all runs in one process, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "/tmp/gridloom-scratch"
    return f"{root.rstrip('/')}/gridloom/{spark.sparkContext.applicationId}"


_ending: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _end(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session is stopped and its files can't be reached
        _delete(spark, root)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back: a lost executor re-reads it, nothing before it runs again. Gone when the program ends."""
    spark, root = df.sparkSession, scratch_root(df.sparkSession)
    if root not in _ending:
        _ending.add(root)
        atexit.register(_end, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(*tables: DataFrame) -> None:
    """Deletes scratch tables that no table still to be read is made of."""
    for t in tables:
        _delete(t.sparkSession, t._scratch_path)
