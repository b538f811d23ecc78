"""Finding word lists among files of several formats, bundles of tables, and small records beside them.

Paths are Hadoop paths and go through Spark's file systems, so they may lie in any store that the session reads.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH, LEAST_HITS, MOST_BYTES, MOST_SUMMARIES = 5, 100, 64 << 20, 10_000
TEXT, TABLES = ("txt", "csv", "tsv", "json", "jsonl"), ("parquet",)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def find_first(spark: SparkSession, folder: str, names: Sequence[str]) -> str:
    """The first of the names that the folder has."""
    for n in names:
        if exists(spark, f"{folder}/{n}"):
            return f"{folder}/{n}"
    raise FileNotFoundError(f"none of {list(names)} in {folder}")


def locate(spark: SparkSession, folders: Sequence[str], names: Sequence[str]) -> str | None:
    """The first folder that has all the names."""
    return next((f for f in folders if all(exists(spark, f"{f}/{n}") for n in names)), None)


def list_files(spark: SparkSession, folder: str, skip: Sequence[str] = ()) -> list[tuple[str, int]]:
    """Path and bytes of all files below a folder; parts of a path that are skipped leave it out."""
    fs, at = _fs(spark, folder)
    found, it = [], fs.listFiles(at, True)
    while it.hasNext():
        f = it.next()
        path = f.getPath().toString()
        if not set(path.split("/")) & set(skip):
            found.append((path, f.getLen()))
    return sorted(found)


def extract_words(spark: SparkSession, paths: Sequence[str], length: int = LENGTH) -> DataFrame:
    """path, word of all tokens of `length` letters in text files (split at blanks, commas and tabs), in the strings of
    JSON values, and in all columns of parquet tables."""
    out = None
    strings = F.lit(r'"((?:[^"\\]|\\.)*)"\s*(:?)')  # the second group marks keys
    for path in paths:
        kind = path.rpartition(".")[2].lower()
        if kind in TABLES:
            t = spark.read.parquet(path)
            found = t.select(F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in t.columns])).alias("token"))
        elif kind in ("json", "jsonl"):
            text = spark.read.text(path, wholetext=kind == "json")
            both = F.arrays_zip(F.regexp_extract_all("value", strings, F.lit(1)).alias("token"), F.regexp_extract_all("value", strings, F.lit(2)).alias("key"))
            found = text.select(F.explode(both).alias("x")).where("x.key = ''").select("x.token")
        else:
            found = spark.read.text(path).select(F.explode(F.split("value", r"[\s,]+")).alias("token"))
        own = found.select(F.lit(path).alias("path"), F.lower(F.regexp_replace(F.trim("token"), "^[\"']+|[\"']+$", "")).alias("word"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        return spark.createDataFrame([], "path string, word string")
    return out.where(F.col("word").rlike(f"^[a-z]{{{length}}}$"))


def discover(spark: SparkSession, folder: str, skip: Sequence[str] = (), least: int = LEAST_HITS) -> DataFrame:
    """path, n_words, n_unique of the files below a folder that hold `least` words or more."""
    paths = [p for p, n in list_files(spark, folder, skip) if p.rpartition(".")[2].lower() in (*TEXT, *TABLES) and n <= MOST_BYTES]
    return extract_words(spark, paths).groupBy("path").agg(F.count("*").alias("n_words"), F.countDistinct("word").alias("n_unique")).where(F.col("n_words") >= least)


def classify(words: DataFrame) -> tuple[str, str]:
    """words: path, word -> the files of answers and of guesses, by what is in them: guesses are the list of most distinct
    words; answers are the list that lies wholly in it (a complete list of guesses) or wholly outside (extras), or nearest to
    that, the longer of equals. Names of files say nothing."""
    own = words.select("path", "word").distinct()
    sizes = own.groupBy("path").agg(F.count("*").alias("n"))
    largest = sizes.orderBy(F.desc("n"), "path").first()
    if largest is None:
        raise FileNotFoundError("no word list found")
    inside = own.join(own.where(F.col("path") == largest["path"]).select("word"), "word", "left_semi").groupBy("path").agg(F.count("*").alias("shared"))
    apart = F.least(F.coalesce("shared", F.lit(0)), F.col("n") - F.coalesce("shared", F.lit(0))) / F.col("n")
    others = sizes.where(F.col("path") != largest["path"]).join(inside, "path", "left")
    answers = others.orderBy(apart, F.desc("n"), "path").first()
    return (answers or largest)["path"], largest["path"]


# -- bundles ------------------------------------------------------------------------------------------------------

REQUIRED, OPTIONAL = ("vocab", "fb"), ("fscores",)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, by sums over hashes of rows: one pass each, nothing is moved."""
    if a.columns != b.columns or a.dtypes != b.dtypes:
        return False
    sums = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(7), *t.columns))).first()
    return sums(a) == sums(b)


def save_table(df: DataFrame, path: str) -> bool:
    """Writes a table unless the same rows are there; whether it wrote."""
    if exists(df.sparkSession, path) and same_rows(df, df.sparkSession.read.parquet(path)):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def save_bundle(folder: str, metadata: dict, **tables: DataFrame) -> None:
    spark = next(iter(tables.values())).sparkSession
    for name, t in tables.items():
        save_table(t, f"{folder}/{name}")
    write_record(spark, f"{folder}/metadata.json", metadata)


def load_bundle(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    """Tables by name and the metadata; required tables must be there, optional ones and metadata needn't."""
    for name in REQUIRED:
        if not exists(spark, f"{folder}/{name}"):
            raise FileNotFoundError(f"{folder} has no table {name}")
    names = [*REQUIRED, *(n for n in OPTIONAL if exists(spark, f"{folder}/{n}"))]
    found = read_record(spark, f"{folder}/metadata.json") if exists(spark, f"{folder}/metadata.json") else {}
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}, found


# -- small records ------------------------------------------------------------------------------------------------


def _write(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    if at.getParent() is not None:
        fs.mkdirs(at.getParent())
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_record(spark: SparkSession, path: str, record: dict) -> None:
    """A JSON file with sorted keys."""
    _write(spark, path, json.dumps(record, indent=2, sort_keys=True, ensure_ascii=False))


def read_record(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_summary(df: DataFrame, path: str, **more: object) -> None:
    """A small table (rows of summaries) as one JSON record; raises where it has more than MOST_SUMMARIES rows."""
    rows = df.toJSON().take(MOST_SUMMARIES + 1)
    if len(rows) > MOST_SUMMARIES:
        raise ValueError(f"over {MOST_SUMMARIES} rows aren't a summary; write a table")
    write_record(df.sparkSession, path, {"summaries": [json.loads(r) for r in rows], **more})


def portable_path(path: str | None, base: str) -> str | None:
    """A path as others can read it: relative to base, or the bare name if it lies elsewhere."""
    if not path:
        return path
    inside = path.replace("\\", "/").removeprefix(base.rstrip("/") + "/")
    return inside if inside != path.replace("\\", "/") else inside.rpartition("/")[2]


def journal_append(spark: SparkSession, folder: str, entry: dict) -> None:
    """Adds an entry; entries are files of their own, so writers don't meet."""
    df = spark.createDataFrame([(json.dumps(entry, sort_keys=True),)], "value string").withColumn("pushed_at", F.current_timestamp())
    df.coalesce(1).write.mode("append").parquet(folder)


def journal_read(spark: SparkSession, folder: str) -> list[dict]:
    if not exists(spark, folder):
        return []
    rows = spark.read.schema("value string, pushed_at timestamp").parquet(folder).orderBy("pushed_at", "value").collect()
    return [json.loads(r["value"]) | {"pushed_at": str(r["pushed_at"])} for r in rows]


def text_table(df: DataFrame, widths: dict[str, int], markdown: bool = False) -> DataFrame:
    """line, in order: a heading, a rule, and a line for each row, columns padded to their widths."""
    cell = lambda c: F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), widths[c], " ")
    by, edge = (" | ", "| ") if markdown else ("  ", "")
    head = edge + by.join(c.rjust(w)[:w] for c, w in widths.items()) + edge[::-1]
    rule = edge + by.join("-" * w for w in widths.values()) + edge[::-1]
    top = df.sparkSession.createDataFrame([(0, head), (1, rule)], "place long, line string")
    rows = df.select((F.monotonically_increasing_id() + 2).alias("place"), F.concat(F.lit(edge), F.concat_ws(by, *map(cell, widths)), F.lit(edge[::-1])).alias("line"))
    return top.unionByName(rows).orderBy("place").select("line")
