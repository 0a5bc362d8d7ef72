"""Leakage gates between splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T


class GateFailure(RuntimeError):
    """A gate did not hold."""


def exact_overlaps(rows: DataFrame, split_col: str = "split", text_col: str = "text") -> DataFrame:
    """a, b, shared: distinct signatures that two splits have in common, for every pair of splits in name order.

    Signatures meet by aggregation: each is reduced to the sorted set of splits that hold it, and pairs come from that
    short set, so no row is joined with another.
    """
    held = (
        rows.select(F.col(split_col).alias("s"), F.sha2(T.signature_view(F.col(text_col)), 256).alias("h"))
        .distinct()
        .groupBy("h")
        .agg(F.array_sort(F.collect_set("s")).alias("splits"))
        .where(F.size("splits") > 1)
    )
    pairs = held.select(F.posexplode("splits").alias("i", "a"), "splits").select("a", F.explode(F.slice("splits", F.col("i") + 2, F.size("splits"))).alias("b"))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
    names = rows.select(F.col(split_col).alias("s")).distinct()
    every = names.select(F.col("s").alias("a")).join(names.select(F.col("s").alias("b")), F.col("a") < F.col("b"))  # a few names
    return every.join(counted, ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0).cast("long")).alias("shared"))


def paragraph_leaks(rows: DataFrame, train: str = "train", sep: str = "\n\n", min_tokens: int = 13, split_col: str = "split", text_col: str = "text") -> DataFrame:
    """split, leaks: paragraphs of train, each occurrence counted, that a small split holds as well."""
    parts = rows.select(F.col(split_col).alias("split"), F.explode(F.split(text_col, sep, -1)).alias("p")).where(F.size(T.words(F.col("p"))) >= min_tokens)
    hashed = parts.select("split", F.sha2(T.signature_view(F.col("p")), 256).alias("h"))
    small = hashed.where(F.col("split") != train).distinct()
    seen = hashed.where(F.col("split") == train).groupBy("h").agg(F.count("*").alias("n"))
    found = small.join(seen, "h").groupBy("split").agg(F.sum("n").alias("leaks"))
    names = rows.where(F.col(split_col) != train).select(F.col(split_col).alias("split")).distinct()
    return names.join(found, "split", "left").select("split", F.coalesce("leaks", F.lit(0).cast("long")).alias("leaks"))


def gate_report(exact: DataFrame, near: DataFrame, limit: float = 0.001) -> DataFrame:
    """exact_ok, near_ok, pass in one row; near has a rate for each split."""
    a = exact.agg(F.coalesce(F.bool_and(F.col("shared") == 0), F.lit(True)).alias("exact_ok"))
    b = near.agg(F.coalesce(F.bool_and(F.col("rate") < limit), F.lit(True)).alias("near_ok"))
    return a.join(b).withColumn("pass", F.col("exact_ok") & F.col("near_ok"))


def require(report: DataFrame) -> None:
    row = report.first()
    if not row["pass"]:
        raise GateFailure(f"leakage gates failed: {row.asDict()}")
