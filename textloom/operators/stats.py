"""Corpus statistics: each a small table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T


def funnel(stages: DataFrame) -> DataFrame:
    """Rows stage_no, stage, docs, bytes with percentages of the stage before; null where that has none."""
    before = Window.partitionBy(F.lit(0)).orderBy("stage_no")

    def share(c: str) -> Column:
        prev = F.lag(c).over(before)
        return F.when(prev != 0, F.round(100.0 * F.col(c) / prev, 2)).alias(f"{c}_pct_of_prev")

    return stages.select("stage_no", "stage", "docs", "bytes", share("docs"), share("bytes"))


def cluster_histogram(survivors: DataFrame) -> DataFrame:
    return survivors.groupBy(F.coalesce(F.col("cluster_size"), F.lit(1)).cast("long").alias("cluster_size")).agg(F.count("*").alias("clusters"))


def length_histogram(docs: DataFrame, text_col: str = "text", low: int = 20, high: int = 54) -> DataFrame:
    """Documents in bins with edges 10 ** (i / 10); the last bin holds its upper edge, what lies outside is left out.

    The edges are compared as numbers, not through a logarithm, so a length on an edge falls where it should.
    """
    edges = F.array(*[F.lit(10 ** (i / 10)) for i in range(low, high + 1)])
    top = F.lit(10 ** (high / 10))
    at = T.let(F.char_length(text_col).cast("double"), lambda n: F.when(n == top, F.lit(high - low)).otherwise(F.size(F.filter(edges, lambda e: e <= n))))
    found = docs.select(at.alias("bin")).where((F.col("bin") >= 1) & (F.col("bin") <= high - low))
    return found.groupBy((F.col("bin") - 1 + low).cast("long").alias("bin")).agg(F.count("*").alias("docs"))


def length_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, median_chars, p90_chars, total_chars: the values at places n // 2 and int(0.9 n) of the sorted lengths.

    Places are looked up in running counts of the length histogram: the window sorts distinct lengths, not documents.
    """
    hist = docs.groupBy(F.char_length(text_col).cast("long").alias("len")).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))
    run = hist.select("len", "n", F.sum("n").over(every.orderBy("len")).alias("upto"), F.sum("n").over(every).alias("docs"))
    median, p90 = F.floor(F.col("docs") / 2) + 1, F.floor(F.col("docs") * F.lit(0.9).cast("double")) + 1
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("len")))
    zero = F.lit(0).cast("long")
    return run.agg(
        F.coalesce(F.sum("n"), zero).alias("docs"),
        F.coalesce(at(median), zero).alias("median_chars"),
        F.coalesce(at(p90), zero).alias("p90_chars"),
        F.coalesce(F.sum(F.col("n") * F.col("len")), zero).alias("total_chars"),
    )


def by_source(rows: DataFrame) -> DataFrame:
    return _means(rows, T.source_or_unknown(F.col("source")).alias("source"))


def by_month(rows: DataFrame) -> DataFrame:
    return _means(rows, T.month_of(F.col("post_date")).alias("month"))


def _means(rows: DataFrame, key: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("docs"), F.round(F.avg(F.coalesce(F.col("cluster_size"), F.lit(1)).cast("double")), 3).alias("mean_cluster_size"))


def pii_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    e, p = (F.regexp_count(F.col(text_col), F.lit(x)).cast("long") for x in (T.EMAIL, T.PHONE))
    return docs.select(e.alias("e"), p.alias("p")).agg(
        F.count("*").alias("docs"),
        F.sum("e").alias("emails"),
        F.count_if(F.col("e") > 0).alias("docs_with_email"),
        F.sum("p").alias("phones_matched"),
        F.count_if(F.col("p") > 0).alias("docs_with_phone"),
    )


def fertility(docs: DataFrame, count_tokens: Column, name: str, text_col: str = "text") -> DataFrame:
    """tokenizer, tokens_per_word, tokens_per_byte, bytes_per_token: ratios of sums. count_tokens: tokens of a row."""
    sums = docs.select(count_tokens.cast("long").alias("t"), F.size(T.words(F.col(text_col))).cast("long").alias("w"), F.octet_length(text_col).cast("long").alias("b")).agg(
        F.sum("t").alias("t"), F.sum("w").alias("w"), F.sum("b").alias("b")
    )
    return sums.select(
        F.lit(name).alias("tokenizer"),
        F.round(F.col("t") / F.col("w"), 4).alias("tokens_per_word"),
        F.round(F.col("t") / F.col("b"), 4).alias("tokens_per_byte"),
        F.round(F.col("b") / F.col("t"), 3).alias("bytes_per_token"),
    )


def bits_per_byte(scores: DataFrame) -> DataFrame:
    """panel, bpb of rows panel, nll (nats), bytes; the unweighted mean over panels has the name ``mean``."""
    each = scores.groupBy("panel").agg(F.round(F.sum("nll") / math.log(2) / F.greatest(F.sum("bytes"), F.lit(1)), 4).alias("bpb"))
    return each.unionByName(each.agg(F.round(F.avg("bpb"), 4).alias("bpb")).select(F.lit("mean").alias("panel"), "bpb"))


def bits_per_byte_of_loss(loss: Column, tokens: Column, text_bytes: Column) -> Column:
    return loss * tokens / text_bytes / math.log(2)


def source_volume(docs: DataFrame, source_col: str = "source", text_col: str = "text", min_len: int = 200) -> DataFrame:
    """docs and GiB for each source, over texts of at least ``min_len`` characters."""
    kept = docs.where(F.char_length(text_col) >= min_len)
    return kept.groupBy(source_col).agg(F.count("*").alias("docs"), F.round(F.sum(F.octet_length(text_col)) / float(1 << 30), 6).alias("gib"))


def label_histogram(routed: DataFrame) -> DataFrame:
    return routed.groupBy("lid", "route").agg(F.count("*").alias("docs"))


def removal_rate(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs, to_remove, rate in one row."""
    a = docs.agg(F.count("*").alias("docs"))
    b = removed.agg(F.countDistinct(id_col).alias("to_remove"))
    return a.join(b).select("docs", "to_remove", F.round(F.col("to_remove") / F.greatest(F.col("docs"), F.lit(1)), 6).alias("rate"))
