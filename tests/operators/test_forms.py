"""Texts that differ in compatibility or composed forms alone count as the same."""

from pyspark.sql import functions as F
from textloom.functions import text as T
from textloom.operators import decon, dedup, minhash, verify

PLAIN = "the first file of the café says 12 office workers define fine flour for the whole floor"
#: Ligatures, full-width letters, a circled digit, a base letter and a combining mark.
FORMS = PLAIN.replace("fi", "ﬁ").replace("whole", "ｗｈｏｌｅ").replace("é", "e\u0301").replace("12", "①②")


def test_exact_dedup_and_bands(spark):
    df = spark.createDataFrame([(1, PLAIN), (2, FORMS), (3, "other")], "doc_id long, text string")
    sig = T.signature_view(F.col("text"))
    assert {(r.doc_id, r["count"]) for r in dedup.exact_survivors(df, sig).collect()} == {(1, 2), (3, 1)}  # ligatures make the other shorter
    bands = minhash.banded(df.select("doc_id", T.ngrams(T.words(sig), 5, short=True).alias("shingles")))
    assert [tuple(r) for r in minhash.bucket_edges(bands).collect()] == [(1, 2)]


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, f"own text\n{PLAIN}"), (2, f"another\n{FORMS}")], "doc_id long, text string")
    assert [r.df for r in dedup.paragraph_frequency(df, "\n").collect()] == [2]


def test_decontamination_and_gates(spark):
    docs = spark.createDataFrame([(1, f"before {FORMS} after"), (2, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([("b", PLAIN)], "bench string, text string")
    assert [tuple(r) for r in decon.hits(docs, decon.index(items)).collect()] == [(1, "b")]
    rows = spark.createDataFrame([(PLAIN, "train"), (FORMS, "val")], "text string, split string")
    assert verify.exact_overlaps(rows).first().shared == 1 and verify.paragraph_leaks(rows).first().leaks == 1
