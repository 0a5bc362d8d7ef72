"""The second hash family, and shingles of 30 characters, through bands and components."""

import zlib

from pyspark.sql import functions as F
from textloom.functions import text as T
from textloom.operators import minhash
from textloom.operators.components import components

TEXT = " ".join(f"word{i * 7919 % 1000}" for i in range(80))
ROWS = [(1, TEXT), (2, TEXT + " end"), (3, " ".join(f"other{i * 31 % 700}" for i in range(80)))]


def roots(placed):
    return {(r.node, r.root) for r in components(minhash.bucket_edges(placed)).collect()}


def test_second_family_and_characters(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    sig = T.signature_view(F.col("text"))
    words = df.select("doc_id", T.ngrams(T.words(sig), 5, short=True).alias("shingles"))
    other = minhash.banded(words, seed=7, base=lambda s: zlib.crc32(s.encode()))
    assert roots(other) == {(1, 1), (2, 1)}
    first = {r.doc_id: set(r.bands) for r in minhash.banded(words).collect()}
    assert not any(first[r.doc_id] & set(r.bands) for r in other.collect())
    assert roots(minhash.banded(df.select("doc_id", T.char_ngrams(sig, 30).alias("shingles")))) == {(1, 1), (2, 1)}
