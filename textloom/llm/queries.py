"""The queries of this subpackage: one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import fold, spread, table
from textloom.llm.sql import ORACLE_SQL


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.sharding import shard_groups

    out = shard_groups(table(spark, sf_dir, "documents"), n_shards=24)
    return out.drop("group_bytes").withColumn("grown_shard", F.lit(None).cast("int"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What op10 returns, read back from the formatted texts and the loss mask."""
    import hashlib

    import pyarrow as pa
    from textloom.llm.chat import read_back, unescape

    id_type = dict(formatted.dtypes)["conv_id"]

    def run(batches):
        for batch in batches:
            texts = batch.column("formatted").to_pylist()
            turns = [read_back(x) for x in texts]
            loss = ["".join(unescape(x[s["start"] : s["end"]]) for s in spans) for x, spans in zip(texts, batch.column("loss_spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    pa.array([len(t) for t in turns], pa.int64()),
                    pa.array([hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest() for t in turns], pa.string()),
                    pa.array([len(x) for x in loss], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in loss], pa.string()),
                    pa.array([len(x) for x in texts], pa.int64()),
                    batch.column("rewrites_history"),
                ],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"],
            )

    return formatted.mapInArrow(
        run,
        f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean",
    )


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.chat import format_conversations

    told = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_digests(format_conversations(turns))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.langid import identify, learn

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    held_out = fold(F.col("doc_id"), 4) == 2
    model = learn(docs.where(~held_out), F.col("lang"), F.col("text"), F.col("doc_id"))
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def contamination_digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.decontaminate import contamination

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return contamination_digests(contamination(docs, table(spark, sf_dir, "benchmark"), window=10))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.rules import quality_rules

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    trusted = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")
    return quality_rules(docs, trusted)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.quality import learn, score_quality

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2)
    out = score_quality(docs, learn(docs, labels))
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def tokenizer_paths() -> tuple[str, str, str]:
    """Rank file, JSON file and pre-token pattern of the public byte-level vocabulary, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.packing import pack_documents

    packed = pack_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer_paths())
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.neardup import near_duplicates

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return near_duplicates(docs, shingle=2, threshold=80).select("doc_id", "n_shingles", "component_id", "kept")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.language_model import score_texts

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return score_texts(docs, fold(F.col("doc_id"), 5) == 1)


def pii_digests(found: DataFrame) -> DataFrame:
    """Counts of the fixed kinds and the hash of their list."""

    def count(kind: str):
        return F.size(F.filter(F.split("base", ","), lambda x: x.startswith(f"{kind}:"))).cast("long")

    kinds = {f"n_{k}": count(k) for k in ("email", "ip", "card", "phone")}
    return found.select("doc_id", *[c.alias(n) for n, c in kinds.items()], F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.pii import detect

    return pii_digests(detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_sharding": op6_sharding,
    "op7_language_model": op7_language_model,
    "op8_quality_rules": op8_quality_rules,
    "op9_pii": op9_pii,
    "op10_chat_formatting": op10_chat_formatting,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
