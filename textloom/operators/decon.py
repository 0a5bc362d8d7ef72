"""n-gram decontamination against benchmark sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

#: Grams of an index up to which it is broadcast (a hash and a name, some 60 bytes each).
BROADCAST_GRAMS = 2_000_000


def grams(df: DataFrame, key: str, text_col: str = "text", n: int = 13) -> DataFrame:
    """key, g: hashes of the n-grams of each row's signature view, repeats included; joins take them as sets."""
    words = T.words(T.signature_view(F.col(text_col)))
    read = df.select(key, words.alias("w")).where(F.size("w") >= n)
    at = read.select(key, "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("i"))
    return at.select(key, F.xxhash64(*[F.get("w", F.col("i") + k) for k in range(n)]).alias("g"))


def index(items: DataFrame, bench_col: str = "bench", text_col: str = "text", n: int = 13) -> DataFrame:
    return grams(items, bench_col, text_col, n).distinct()


def hits(docs: DataFrame, idx: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 13, bench_col: str = "bench") -> DataFrame:
    """Distinct (id, bench) of documents that share a gram with a set. The index is counted before it is broadcast."""
    placed = F.broadcast(idx) if idx.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS else idx
    return grams(docs, id_col, text_col, n).join(placed, "g").select(id_col, bench_col).distinct()


def survivors(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.join(found.select(id_col).distinct(), id_col, "left_anti")


def hits_by_bench(items: DataFrame, found: DataFrame, bench_col: str = "bench", id_col: str = "doc_id") -> DataFrame:
    """Documents hit by each set, sets without a hit included; a document counts once for each set."""
    counted = found.groupBy(bench_col).agg(F.count("*").alias("hits"))
    return items.select(bench_col).distinct().join(counted, bench_col, "left").select(bench_col, F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))


def stats(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    total = docs.agg(F.count("*").alias("total"))
    gone = found.agg(F.countDistinct(id_col).alias("dropped"), F.count("*").alias("bench_hits"))
    return total.join(gone).select("dropped", (F.col("total") - F.col("dropped")).alias("kept"), "bench_hits")
