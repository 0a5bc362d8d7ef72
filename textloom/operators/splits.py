"""Temporal tail and stratified random splits over de-duplicated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T


def seeded(seed: int, id_col: str = "id") -> Column:
    """A fixed shuffle order: the hash of seed and id. It depends on neither the order nor the partitions of the input."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def tail_months(rows: DataFrame, k: int = 2) -> DataFrame:
    """The last k months that are known."""
    return rows.where(F.col("month") != "unknown").select("month").distinct().orderBy(F.desc("month")).limit(k)


def _quotas(strata: DataFrame, n: int, left: Column) -> DataFrame:
    """quota for each (source, month): the floor of its share of n, and one more in key order until n is dealt out.

    ``strata`` has a row for each stratum, so its windows are small whatever the corpus.
    """
    everything = Window.partitionBy(F.lit(0))
    share = F.floor(F.lit(n) * F.col("left").cast("double") / F.col("total")).cast("long")
    found = strata.withColumn("left", left).withColumn("total", F.sum("left").over(everything)).where("total > 0").withColumn("share", share)
    spare = F.lit(n) - F.sum("share").over(everything)
    able = (F.col("left") > F.col("share")).cast("int")
    found = found.withColumn("spare", spare).withColumn("turn", F.sum(able).over(everything.orderBy("source", "month")))
    more = ((F.col("left") > F.col("share")) & (F.col("turn") <= F.col("spare"))).cast("long")
    return found.select("source", "month", F.least(F.col("share") + more, F.col("left")).alias("quota"))


def assign(rows: DataFrame, val_n: int = 20_000, test_n: int = 20_000, months: int = 2, cap: int = 20_000, seed: int = 1337) -> DataFrame:
    """id, source, month, split for rows with id, source, post_date.

    Rows of the last months are ``test_tail`` up to the cap in seeded order; what is over goes to train. Of the others,
    val and test_iid take proportional quotas from each (source, month) in seeded order, test_iid from what val left.
    Ids are unique; rows that share one go to the same split. Strata are (source, month) pairs, few enough to broadcast.
    """
    known = rows.select("id", T.source_or_unknown(F.col("source")).alias("source"), T.month_of(F.col("post_date")).alias("month"))
    tail = F.broadcast(tail_months(known, months).withColumn("late", F.lit(True)))
    marked = known.join(tail, "month", "left").withColumn("late", F.coalesce("late", F.lit(False))).withColumn("turn", seeded(seed))
    late = marked.where("late")
    first = late.orderBy("turn", "id").limit(cap).select("id", F.lit("test_tail").alias("split"))
    late = late.join(first, "id", "left").select("id", "source", "month", F.coalesce("split", F.lit("train")).alias("split"))

    pool = marked.where(~F.col("late"))
    strata = pool.groupBy("source", "month").agg(F.count("*").alias("n"))
    val = _quotas(strata, val_n, F.col("n")).withColumnRenamed("quota", "val")
    after = strata.join(val, ["source", "month"], "left").fillna({"val": 0})
    test = _quotas(after, test_n, F.col("n") - F.col("val")).withColumnRenamed("quota", "test")
    quotas = after.join(test, ["source", "month"], "left").fillna({"test": 0}).select("source", "month", "val", "test")
    # No quota exceeds val_n + test_n, so each task hands on that many rows of a stratum at most; the last row within each
    # quota is then an edge that every row is compared with, and what is train is never sorted.
    rank = F.row_number().over(Window.partitionBy("source", "month").orderBy("turn", "id"))
    first = pool.withColumn("rank", rank).where(F.col("rank") <= val_n + test_n).join(F.broadcast(quotas), ["source", "month"])
    at = F.struct("turn", "id")
    edges = first.groupBy("source", "month").agg(
        F.max(F.when(F.col("rank") <= F.col("val"), at)).alias("v"), F.max(F.when(F.col("rank") <= F.col("val") + F.col("test"), at)).alias("t")
    )
    placed = pool.join(F.broadcast(edges), ["source", "month"], "left")
    split = F.when(at <= F.col("v"), "val").when(at <= F.col("t"), "test_iid").otherwise("train")
    return late.unionByName(placed.select("id", "source", "month", split.alias("split")))


def split_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("split").agg(F.count("*").alias("docs"), F.countDistinct("source").alias("sources"), F.countDistinct("month").alias("months"))
