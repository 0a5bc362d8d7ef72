"""Every query over whole small tables; those that SQL can express are compared with it."""

import pytest
from textloom.llm.queries import ORACLE_SQL, QUERIES

from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id", "n_shingles", "component_id", "kept"},
    "op2": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op3": {"doc_id", "held_out", "lang_pred", "score"},
    "op4": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op5": {"doc_id", "held_out", "score", "predicted"},
    "op6": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op7": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op8": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op9": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op10": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    assert COLUMNS[name.split("_")[0]] <= set(df.columns)
    if name in ORACLE_SQL:
        assert differences(df, connect(SF), ORACLE_SQL[name]) == []
    elif name not in ("op2_packing",):
        assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    lang = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").toPandas().merge(docs, on="doc_id")
    assert (lang[lang.held_out].lang_pred == lang[lang.held_out].lang).mean() > 0.98
    quality = QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas().merge(labels, on="doc_id")
    assert (quality[quality.held_out].predicted == quality[quality.held_out].quality).mean() > 0.95
    rules = QUERIES["op8_quality_rules"](spark, "/root/testdata/sf0.01").toPandas().merge(labels, on="doc_id")
    tried = rules[~rules.base_failed]
    assert tried[tried.quality == 1].kept.mean() > 0.99 and tried[tried.quality == 0].kept.mean() < 0.05
    scores = QUERIES["op7_language_model"](spark, "/root/testdata/sf0.01").toPandas()
    assert scores[scores.held_out].score.sum() > scores[scores.held_out].base_score.sum()
