"""Look-ups, verdicts, resumption and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.splits import seeded


def with_labels(docs: DataFrame, labels: DataFrame, order_col: str, id_col: str = "doc_id", label_col: str = "label") -> DataFrame:
    """docs with the label of their id, that with the greatest ``order_col`` where there are several; null if none."""
    last = labels.groupBy(id_col).agg(F.max_by(label_col, order_col).alias(label_col))
    return docs.join(last, id_col, "left")


def route(docs: DataFrame, keep: tuple[str, ...], label_col: str = "lid") -> DataFrame:
    """docs with ``route``: keep or quarantine; one pass feeds both sinks (write partitioned by it)."""
    return docs.withColumn("route", F.when(F.col(label_col).isin(*keep), "keep").otherwise("quarantine"))


def resume(todo: DataFrame, *done: DataFrame, id_col: str = "id") -> DataFrame:
    """What no earlier output holds."""
    for d in done:
        todo = todo.join(d.select(id_col), id_col, "left_anti")
    return todo


def audit_verdicts(sample: DataFrame, survivors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, dup: a sampled row is a duplicate if it did not survive or stands for others."""
    kept = survivors.select(id_col, "cluster_size")
    return sample.select(id_col).join(kept, id_col, "left").select(id_col, (F.col("cluster_size").isNull() | (F.col("cluster_size") > 1)).alias("dup"))


def agreement(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """both, only_a, only_b, neither and the share of equal verdicts of two audits of one sample."""
    met = a.select(id_col, F.col("dup").alias("x")).join(b.select(id_col, F.col("dup").alias("y")), id_col)
    x, y = F.col("x"), F.col("y")
    return met.agg(
        F.count_if(x & y).alias("both"),
        F.count_if(x & ~y).alias("only_a"),
        F.count_if(~x & y).alias("only_b"),
        F.count_if(~x & ~y).alias("neither"),
        F.round(F.count_if(x == y) / F.greatest(F.count("*"), F.lit(1)), 4).alias("agreement"),
    )


def disagreements(a: DataFrame, b: DataFrame, k: int = 20, id_col: str = "doc_id") -> DataFrame:
    met = a.select(id_col, F.col("dup").alias("x")).join(b.select(id_col, F.col("dup").alias("y")), id_col)
    return met.where("x <> y").orderBy(id_col).limit(k)


def hash_sample(rows: DataFrame, rate: float, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Each row with chance ``rate``, decided by a hash of its id."""
    place = F.conv(F.substring(seeded(seed, id_col), 1, 8), 16, 10).cast("long")
    return rows.where(place < int(rate * (1 << 32)))


def random_sample(rows: DataFrame, n: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """n rows in seeded order (a reservoir's distribution); each task sends at most n rows on."""
    return rows.orderBy(seeded(seed, id_col), id_col).limit(n)


def stratified_sample(rows: DataFrame, by: str, n: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """n rows of each stratum in seeded order. The rank filter is pushed below the shuffle, so a hot stratum is cut early."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(seeded(seed, id_col), id_col))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def require_strata(rows: DataFrame, by: str, n: int) -> None:
    short = rows.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") < n).limit(5).collect()
    if short:
        raise ValueError(f"strata with fewer than {n} rows: {[r[0] for r in short]}")


def set_flags(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, in_a, in_b: intersection and differences of two id sets at once."""
    x, y = a.select(id_col).distinct().withColumn("in_a", F.lit(True)), b.select(id_col).distinct().withColumn("in_b", F.lit(True))
    return x.join(y, id_col, "full").select(id_col, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``id`` as name_i, i the place in the given order from 0. Places are found for ranges of the order, not in one task."""
    from textloom.operators.mixture import with_position

    return with_position(rows, *order).withColumn("id", F.concat(F.lit(f"{name}_"), F.col("pos").cast("string"))).drop("pos")


def byte_budget(files: DataFrame, cap: int, path_col: str = "path", size_col: str = "size") -> DataFrame:
    """Files in path order until the cap is reached; the one that crosses it is taken."""
    ahead = Window.partitionBy(F.lit(0)).orderBy(path_col).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("before", F.coalesce(F.sum(size_col).over(ahead), F.lit(0))).where(F.col("before") < cap).drop("before")


def new_pieces(candidates: DataFrame, base: DataFrame, n: int, col: str = "piece") -> DataFrame:
    """The n best-scored vocabulary pieces that are longer than one character, no markup, and not in the base."""
    kept = candidates.where(~F.col(col).startswith("<") & (F.char_length(col) >= 2)).join(base.select(col), col, "left_anti")
    return kept.orderBy(F.desc("score"), F.desc(col)).limit(n)
