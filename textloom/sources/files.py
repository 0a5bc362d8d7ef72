"""Readers and plain sinks."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.functions import text as T

#: Rows of a report, which is gathered on the driver.
REPORT_ROWS = 10_000


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A row a line; blank lines are skipped, a malformed line raises."""
    lines = spark.read.text(path).where(T.strip(F.col("value")) != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A row for each line that can be parsed."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """id, label, pos of a tab-separated file, gzip included; pos orders repeated ids, the last of which holds."""
    rows = spark.read.csv(path, sep="\t", schema="id string, label string", quote="")
    return rows.withColumn("pos", F.monotonically_increasing_id())


def read_parquet_texts(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """One column of a tree of Parquet files; the scan reads no other."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path).select(F.col(column).alias("text"))


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """bench, text: a row for each line of each *.txt file; the file's stem names the set, names from ._ on are skipped."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return rows.where(~F.col("file").startswith("._")).select(F.regexp_replace("file", r"\.txt$", "").alias("bench"), "text")


def split_to_jsonl(spark: SparkSession, path: str, out: str) -> None:
    """Parquet with a split column to text-only JSON lines, a folder for each split."""
    spark.read.parquet(path).select("split", "text").write.partitionBy("split").json(out)


def stage_once(df: DataFrame, path: str) -> None:
    """Writes Parquet unless the path is there already."""
    df.write.mode("ignore").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_report(spark: SparkSession, df: DataFrame, path: str) -> dict:
    """A table of at most ``REPORT_ROWS`` rows as a JSON file in any store Spark can write to; returns what it holds.

    A longer table raises; ``append_jsonl`` writes those.
    """
    rows = [r.asDict(recursive=True) for r in df.limit(REPORT_ROWS + 1).collect()]
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report of more than {REPORT_ROWS} rows")
    body = rows[0] if len(rows) == 1 else {"rows": rows}
    spark.createDataFrame([(json.dumps(body, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return body


def science_rows(df: DataFrame, source: str, fields: tuple[str, ...]) -> DataFrame:
    """The named fields and ``src``; nulls are left out once rows are written as JSON."""
    return df.select(*fields, F.lit(source).alias("src"))


def capped(df: DataFrame, cap: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """The first ``cap`` rows of a seeded shuffle."""
    from textloom.operators.joins import random_sample

    return random_sample(df, cap, seed, id_col)


def panel(spark: SparkSession, path: str) -> DataFrame:
    """text: the lines that are not blank."""
    return spark.read.text(path).where(T.strip(F.col("value")) != "").select(F.col("value").alias("text"))


def panel_manifest(panels: dict[str, DataFrame], tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """panel, docs, text_bytes, tokens: a row for each panel, empty ones too; tokens are those of words unless ``tokens`` counts them."""
    count = tokens or (lambda text: F.size(T.words(text)).cast("long"))
    each = [
        df.agg(
            F.lit(name).alias("panel"), F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("text_bytes"),
            F.coalesce(F.sum(count(F.col("text"))), F.lit(0)).cast("long").alias("tokens"),
        )
        for name, df in panels.items()
    ]
    return reduce(DataFrame.unionByName, each)
