"""Quality, near-duplicates, benchmark passages, personal data, packing: documents to padded training sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import spread, table, written
from textloom.llm.decontaminate import found_windows
from textloom.llm.neardup import near_duplicates
from textloom.llm.packing import pack_documents
from textloom.llm.pii import detect
from textloom.llm.quality import learn, score_quality
from textloom.llm.queries import tokenizer_paths

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if the chance of label 1 is lower; clean documents score near 1.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects. It learns from all labels, joined with the documents given."""
    docs = spread(docs.select(*COLUMNS))
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep=COLUMNS).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; rows equal in id and text count as one."""
    docs = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    kept = near_duplicates(docs.select("doc_id", "text"), shingle=5, threshold=80).where("kept").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item."""
    docs = docs.select(*COLUMNS)
    found = found_windows(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("d", "t")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("t"))
    return docs.join(found, same, "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in angle brackets in place of each span of personal data; n_chars follows the new text."""
    docs = docs.select(*COLUMNS)
    masked = detect(docs, mask=True, keep=COLUMNS)
    length = F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.char_length("masked").cast(dict(docs.dtypes)["n_chars"]))
    return masked.select("doc_id", F.col("masked").alias("text"), "lang", "source", length.alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 tokens."""
    return pack_documents(docs.select("doc_id", "text"), tokenizer_paths())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL cannot express the classifier, the field or the packing; tests/llm/test_pipeline.py holds a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
