"""The release sink: a fixed schema, sharded Parquet, a manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.schemas import RELEASE, enforce


class ReleaseError(ValueError):
    """Rows that may not be released."""


def of_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """The rows of all splits with ``expected``, the split whose table they stand in."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("expected", F.lit(name)) for name, df in splits.items()])


def violations(rows: DataFrame, min_len: int = 100) -> DataFrame:
    """id, split, reason of rows with a bad text, a split other than ``expected`` (if there is that column) or a repeated id.

    A repeated id is reported once.
    """
    bad = rows.where(F.col("text").isNull() | (F.char_length("text") < min_len)).select("id", "split", F.lit("bad text").alias("reason"))
    twice = rows.groupBy("id").agg(F.count("*").alias("n"), F.min("split").alias("split")).where("n > 1").select("id", "split", F.lit("duplicate id").alias("reason"))
    found = bad.unionByName(twice)
    if "expected" in rows.columns:
        other = rows.where(~F.col("split").eqNullSafe(F.col("expected")))
        found = found.unionByName(other.select("id", "split", F.lit("split mismatch").alias("reason")))
    return found


def manifest(rows: DataFrame) -> DataFrame:
    """split, rows, text_bytes."""
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("text_bytes"))


def write(rows: DataFrame, path: str, shard_rows: int = 500_000, min_len: int = 100) -> DataFrame:
    """Checks the rows, writes them in zstd Parquet by split, at most ``shard_rows`` a file; returns the manifest."""
    found = violations(rows, min_len).limit(5).collect()
    if found:
        raise ReleaseError("; ".join(f"{r['reason']}: {r['id']} in {r['split']}" for r in found))
    out = enforce(rows, RELEASE)
    out.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", shard_rows).partitionBy("split").parquet(path)
    return manifest(out)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """split, file, rows, sha256 of what was written. Contents are hashed in tasks; rows are counted from the scan."""
    name, split = F.element_at(F.split("path", "/"), -1).alias("file"), F.regexp_extract("path", "/split=([^/]+)/", 1).alias("split")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    hashed = found.select(split, name, F.sha2("content", 256).alias("sha256"))
    rows = spark.read.parquet(path).groupBy("split", F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))
    return rows.join(hashed, ["split", "file"]).select("split", "file", "rows", "sha256")
