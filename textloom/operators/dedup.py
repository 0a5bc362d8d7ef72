"""Exact and clustered de-duplication, paragraph de-duplication, and what they report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T


def exact_survivors(docs: DataFrame, sig: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each signature: the longest text, the earliest id on ties; with the group's size and first id.

    Ranks come from aggregates that combine before the shuffle (max_by over a struct), so a signature that a third of
    all rows share is not sorted in one task. ``with_texts`` joins the texts of the winners back.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(sig, 256).alias("sig"), F.char_length(text_col).cast("long").alias("chars"))
    return signed_survivors(rows).withColumnRenamed("id", id_col)


def signed_survivors(rows: DataFrame, *also: str) -> DataFrame:
    """``exact_survivors`` of rows id, sig (hashed), chars; ``also``: columns that depend on the signature alone."""
    return (
        rows.groupBy("sig")
        .agg(F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").alias("id"))).alias("best"), F.count("*").alias("count"), F.min("id").alias("first_seen"), *[F.first(c).alias(c) for c in also])
        .select(F.col("best.id").alias("id"), "sig", (-F.col("best.less")).alias("chars"), "count", "first_seen", *also)
    )


def with_texts(survivors: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The survivors with the columns of docs they lack: ids alone are shuffled until it is known which rows stay."""
    more = [c for c in docs.columns if c == id_col or c not in survivors.columns]
    return docs.select(*more).join(survivors, id_col)


def cluster_survivors(reps: DataFrame, roots: DataFrame) -> DataFrame:
    """The longest representative of each component, earliest first_seen on ties; cluster_size sums the exact counts.

    reps: doc_id, chars, count, first_seen. roots: node (doc_id), root; representatives without a link are alone.
    """
    named = reps.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("cluster", F.coalesce("root", "doc_id"))
    best = F.min(F.struct((-F.col("chars")).alias("less"), "first_seen", "doc_id"))
    return (
        named.groupBy("cluster")
        .agg(best.alias("b"), F.sum("count").alias("cluster_size"), F.count("*").alias("members"))
        .select(F.col("b.doc_id").alias("doc_id"), F.col("cluster").alias("dedup_cluster_id"), "cluster_size", "members")
    )


def dedup_stats(reps: DataFrame, survivors: DataFrame) -> DataFrame:
    """input_docs, exact_removed, fuzzy_removed, survivors in one row."""
    a = reps.agg(F.sum("count").alias("input_docs"), F.count("*").alias("reps"))
    b = survivors.agg(F.count("*").alias("survivors"), F.sum((F.col("cluster_size") > 1).cast("long")).alias("clusters_over_1"))
    return a.join(b).select("input_docs", (F.col("input_docs") - F.col("reps")).alias("exact_removed"), (F.col("reps") - F.col("survivors")).alias("fuzzy_removed"), "survivors", "clusters_over_1")


def top_clusters(survivors: DataFrame, k: int = 50) -> DataFrame:
    return survivors.select("dedup_cluster_id", "cluster_size").orderBy(F.desc("cluster_size"), "dedup_cluster_id").limit(k)


def cluster_sample(docs: DataFrame, roots: DataFrame, k: int = 20, chars: int = 2000) -> DataFrame:
    """Members, with the head of their texts, of the k largest components."""
    sizes = roots.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(k)
    members = roots.join(F.broadcast(sizes), "root").select(F.col("node").alias("doc_id"), F.col("root").alias("dedup_cluster_id"), "n")
    return docs.select("doc_id", F.left("text", F.lit(chars)).alias("head")).join(members, "doc_id").select("dedup_cluster_id", "n", "doc_id", "head")


def cluster_review(sample: DataFrame) -> DataFrame:
    """One line a cluster for a reader: how many sampled members, and the first one's head made safe for CSV."""
    return (
        sample.groupBy("dedup_cluster_id")
        .agg(F.count("*").alias("sampled"), F.min_by("head", "doc_id").alias("head"))
        .select("dedup_cluster_id", "sampled", T.csv_safe(F.col("head")).alias("example"))
    )


def _paragraphs(docs: DataFrame, sep: str, min_tokens: int) -> DataFrame:
    """doc_id, pos, p, key: key is the hash of the paragraph's signature, null if it is too short to count."""
    parts = docs.select("doc_id", F.posexplode(T.paragraphs(F.col("text"), sep)).alias("pos", "p"))
    return parts.withColumn("key", F.when(F.size(T.words(F.col("p"))) >= min_tokens, F.sha2(T.signature_view(F.col("p")), 256)))


def paragraph_frequency(docs: DataFrame, sep: str = "\n\n", min_tokens: int = 13) -> DataFrame:
    """key, df, example: how many documents hold each long enough paragraph."""
    return (
        _paragraphs(docs, sep, min_tokens)
        .where(F.col("key").isNotNull())
        .groupBy("key", "doc_id")
        .agg(F.min("p").alias("p"))
        .groupBy("key")
        .agg(F.count("*").alias("df"), F.min("p").alias("example"))
    )


def strip_boilerplate(docs: DataFrame, sep: str = "\n\n", min_tokens: int = 13, min_docs: int = 10, min_len: int = 100) -> DataFrame:
    """doc_id, text, removed: documents without the paragraphs that min_docs documents hold.

    A document that loses nothing keeps its text as it is; one that falls under ``min_len`` characters goes, untouched
    ones included.
    """
    return _stripped(docs, sep, min_tokens, min_docs).select("doc_id", "text", "removed").where(F.char_length("text") >= min_len)


def _stripped(docs: DataFrame, sep: str, min_tokens: int, min_docs: int) -> DataFrame:
    """doc_id, text, removed of every document.

    Only paragraphs long enough to have a key are joined, with places and no text; the document then drops the places
    found, so its text is never taken apart and shuffled in pieces, and short paragraphs do not meet under a null key.
    """
    common = paragraph_frequency(docs, sep, min_tokens).where(F.col("df") >= min_docs).select("key")
    keyed = _paragraphs(docs, sep, min_tokens).where(F.col("key").isNotNull()).select("doc_id", "pos", "key")
    gone = keyed.join(common, "key", "left_semi").groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))
    joined = docs.select("doc_id", "text").join(gone, "doc_id", "left")
    left = F.filter(F.transform(T.paragraphs(F.col("text"), sep), lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: ~F.array_contains("gone", x["i"]))
    text = F.when(F.col("gone").isNotNull(), F.array_join(F.transform(left, lambda x: x["p"]), sep)).otherwise(F.col("text"))
    return joined.select("doc_id", text.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed"))


def strip_report(docs: DataFrame, sep: str = "\n\n", min_tokens: int = 13, min_docs: int = 10, min_len: int = 100) -> DataFrame:
    """One row: paragraphs_removed, docs_touched, docs_dropped of ``strip_boilerplate``."""
    found = _stripped(docs, sep, min_tokens, min_docs)
    return found.agg(
        F.coalesce(F.sum("removed"), F.lit(0)).cast("long").alias("paragraphs_removed"),
        F.count_if(F.col("removed") > 0).alias("docs_touched"),
        F.count_if(F.coalesce(F.char_length("text"), F.lit(0)) < min_len).alias("docs_dropped"),
    )


def boilerplate_top(docs: DataFrame, sep: str = "\n\n", min_tokens: int = 13, min_docs: int = 10, k: int = 20) -> DataFrame:
    """The k paragraphs that most documents share, by their first 80 characters."""
    found = paragraph_frequency(docs, sep, min_tokens).where(F.col("df") >= min_docs)
    return found.select(F.left("example", F.lit(80)).alias("head"), "df").groupBy("head").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "head").limit(k)
