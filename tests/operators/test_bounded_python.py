"""What workers in Python hold does not follow the table: normal forms, ids and signatures."""

import random
import time
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from textloom import queries
from textloom.functions import text as T
from textloom.operators import minhash, minhash_plain, mixture

SF = "/root/testdata/sf0.001"


def say(r, n, letters="abcé\U0001f600"):
    return " ".join("".join(r.choices(letters, k=r.randrange(1, 9))) for _ in range(n))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_normal_forms_stay_in_the_jvm(spark):
    r = random.Random(3)
    known = [c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)]) if unicodedata.category(c) != "Cn"]
    formed = [c for c in known if unicodedata.combining(c) or unicodedata.normalize("NFKC", c) != c]
    texts = [*known, *("".join(r.choice(formed if r.random() < 0.6 else known) for _ in range(12)) for _ in range(3000)), "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.nfc(F.col("t")).alias("c"), T.nfkc(F.col("t")).alias("k"))
    assert [x.t for x in df.collect() if x.t is not None and (x.c, x.k) != (unicodedata.normalize("NFC", x.t), unicodedata.normalize("NFKC", x.t))] == []
    assert [(x.c, x.k) for x in df.where("t IS NULL").collect()] == [(None, None)]
    for name in ("release_view", "signature_view", "paragraph_report", "char_shingles_30"):
        assert "Python" not in plan(queries.QUERIES[name](spark, SF)) and "Arrow" not in plan(queries.QUERIES[name](spark, SF))


def test_ids_leave_in_small_pieces(spark):
    texts = ["é" * 2500, None, "", "ab"] * 300 + ["x" * 1_000_000]
    for given in (pa.array(texts), pa.array(["before", *texts]).slice(1)):
        parts = list(mixture.encoded(iter([given])))
        assert [x for p in parts for x in p.to_pylist()] == [list((t or "").encode()) for t in texts]
        assert max(len(p.flatten()) for p in parts if len(p) > 1) <= 1 << 18
    assert [p.to_pylist() for p in mixture.encoded(iter([given]), lambda held: [[len(t)] for t in held])][-1] == [[1_000_000]]
    df = spark.createDataFrame([("aé",), (None,)], "t string")
    assert [x.k for x in df.select(mixture.tokenize(F.col("t")).alias("k")).collect()] == [[97, 195, 169], []]


def test_signatures_of_texts(spark):
    r = random.Random(5)
    texts = ["", "a", "a b c d", "a b c d e", say(r, 9000), *(say(r, r.randrange(1, 60)) for _ in range(200)), None]
    a, b = minhash.coefficients(112, 42)

    def bands(t):
        w = t.split(" ")
        h = np.array([xxhash.xxh64_intdigest(g) for g in ({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {t})], np.uint64)
        sig = ((a[:, None] * h + b[:, None]) % np.uint64(minhash.PRIME)).min(axis=1).astype("<u8")
        return [int(np.uint64(xxhash.xxh64_intdigest(sig[k * 8 : k * 8 + 8].tobytes())).view(np.int64)) for k in range(14)]

    df = spark.createDataFrame(list(enumerate(texts)), "id long, sig string").repartition(3)
    got = {x.id: x.bands for x in minhash.banded_texts(df).collect()}
    assert got == {i: None if t is None else bands(t) for i, t in enumerate(texts)}
    held = minhash.signatures(np.array([7, 7, 5], np.uint64), np.array([0, 2, 0, 1]), a, b, block=2)
    assert (held[[0, 2]] == np.iinfo(np.uint64).max).all() and (held[1] == (a * np.uint64(7) + b) % np.uint64(minhash.PRIME)).all()
    edges = np.array([0, 2**61 - 2, 2**61 - 1, 2**61, 2**62 - 2, 2**64 - 1], np.uint64)  # with a = 1, b = 0: the remainder alone
    one, none = np.ones(1, np.uint64), np.zeros(1, np.uint64)
    assert minhash.signatures(edges, np.ones(6, np.int64), one, none)[:, 0].tolist() == [int(x) % minhash.PRIME for x in edges]


def test_production_survivors_with_a_missing_text(spark, tmp_path):
    spark.createDataFrame([(1, "a b c"), (2, None), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("production_survivors", "fuzzy_survivors"):
        assert {(x.doc_id, x.cluster_size) for x in queries.QUERIES[name](spark, str(tmp_path)).collect()} == {(1, 1), (2, 2)}


def test_plain_bands_make_no_rows_of_shingles(spark):
    r = random.Random(7)
    texts = ["", "a", *(say(r, r.randrange(1, 80)) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, sig string")
    sets = T.word_runs(F.col("sig"), 5)
    placed = minhash_plain.banded(df, sets)
    assert "Generate" not in plan(placed)
    every = df.select("doc_id", F.explode(T.ngrams(T.words(F.col("sig")), 5, short=True)).alias("s")).withColumn("h", F.conv(F.substring(F.md5("s"), 1, 7), 16, 10).cast("long"))
    least = [F.min((F.col("h") * a + b) % minhash_plain.PRIME).cast("string").alias(f"m{k}") for k, (a, b) in enumerate(minhash_plain.coefficients(16))]
    want = {x[0]: ["-".join(x[1 + 4 * k : 5 + 4 * k]) for k in range(4)] for x in every.groupBy("doc_id").agg(*least).collect()}
    assert {x.doc_id: x.bands for x in placed.collect()} == want
    got = {x.sig: (x.r, x.o) for x in df.select("sig", sets.alias("r"), T.ngrams(T.words(F.col("sig")), 5, short=True).alias("o")).collect()}
    assert all(list(dict.fromkeys(runs)) == o for runs, o in got.values())


def test_runs_of_characters(spark):
    r = random.Random(9)
    texts = ["", "a" * 29, "a" * 30, "ab" * 40, "\U0001f600" * 45, *(say(r, r.randrange(1, 60)) for _ in range(60))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 30):
        assert all(x.g == list(dict.fromkeys(x.t[i : i + n] for i in range(max(1, len(x.t) - n + 1)))) for x in df.select("t", T.char_ngrams(F.col("t"), n).alias("g")).collect())

    def slices(text):  # as it was: thirty elements of an array joined for each place
        grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(c) - 29), lambda i: F.array_join(F.slice(c, i, 30), "")))
        return T.let(F.array_remove(F.split(text, ""), ""), grams)

    long = spark.createDataFrame([(say(r, 8000, "abcdef"),) for _ in range(24)], "t string").repartition(4).cache()
    long.count()

    def took(f):
        best = 9e9
        for _ in range(3):
            t = time.time()
            long.select(F.size(f(F.col("t"))).alias("n")).agg(F.sum("n")).collect()
            best = min(best, time.time() - t)
        return best

    assert took(lambda c: T.char_ngrams(c, 30)) < 0.7 * took(slices)
