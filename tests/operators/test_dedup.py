import numpy as np
import xxhash
from pyspark.sql import functions as F
from textloom.functions import text as T
from textloom.operators import decon, dedup, joins, minhash, splits, verify
from textloom.operators.components import components

WORDS = [f"բառ{chr(0x561 + i % 30)}{chr(0x561 + i // 30 % 30)}" for i in range(900)]


def say(i, n=60):
    return " ".join(WORDS[(i * 37 + k * (i % 7 + 1)) % 900] for k in range(n))


def test_coefficients_are_pinned():
    a, b = minhash.coefficients(112, 42)
    assert int(a[0]) == 2297359619001564596 and int(b[0]) == 1008993515362167465


def test_bands_equal_a_plain_version(spark):
    texts = ["a b c d e f", "a", "", "x y z w v u t s"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = minhash.banded(df.select("doc_id", T.ngrams(T.words(F.col("text")), 5, short=True).alias("shingles"))).collect()
    a, b = minhash.coefficients(112, 42)
    for r in got:
        w = texts[r.doc_id].split()
        grams = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)}
        sig = [min(((int(x) * h + int(y)) % 2**64) % minhash.PRIME for h in map(xxhash.xxh64_intdigest, grams)) for x, y in zip(a, b)]
        want = [xxhash.xxh64_intdigest(np.array(sig[k * 8 : k * 8 + 8], "<u8").tobytes()) for k in range(14)]
        assert [v % 2**64 for v in r.bands] == want


def test_pipeline_keeps_the_longest(spark):
    rows = [(0, say(1)), (1, say(1).upper() + "!!"), (2, say(2)), (3, say(2).replace(WORDS[5], "x") + " y"), (4, say(9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    reps = dedup.exact_survivors(df, T.signature_view(F.col("text")))
    assert {(r.doc_id, r["count"], r.first_seen) for r in reps.collect()} == {(1, 2, 0), (2, 1, 2), (3, 1, 3), (4, 1, 4)}
    roots = components(spark.createDataFrame([(2, 3)], "a long, b long"))
    best = {r.doc_id: (r.dedup_cluster_id, r.cluster_size) for r in dedup.cluster_survivors(reps, roots).collect()}
    assert best == {1: (1, 2), 3: (2, 2), 4: (4, 1)}
    assert dedup.dedup_stats(reps, dedup.cluster_survivors(reps, roots)).first().asDict() == {"input_docs": 5, "exact_removed": 1, "fuzzy_removed": 1, "survivors": 3, "clusters_over_1": 2}


def test_footer_goes_content_stays(spark):
    footer = say(500, 20)
    df = spark.createDataFrame([(i, f"{say(i, 40)}\n\n{footer}") for i in range(12)] + [(90, "short"), (91, say(77, 50))], "doc_id int, text string")
    got = {r.doc_id: r for r in dedup.strip_boilerplate(df, min_docs=10).collect()}
    assert sorted(got) == [*range(12), 91] and all(footer not in got[i].text and got[i].removed == 1 for i in range(12))
    assert got[91].text == say(77, 50) and dedup.paragraph_frequency(df).where("df = 12").count() == 1


def test_one_planted_gram(spark):
    phrase = say(300, 13)
    docs = spark.createDataFrame([(i, say(i) + (" " + phrase if i == 7 else "")) for i in range(20)], "doc_id int, text string")
    items = spark.createDataFrame([("flores", phrase), ("other", say(800, 30)), ("tiny", "a b")], "bench string, text string")
    found = decon.hits(docs, decon.index(items))
    assert [tuple(r) for r in found.collect()] == [(7, "flores")]
    assert decon.stats(docs, found).first().asDict() == {"dropped": 1, "kept": 19, "bench_hits": 1}
    assert {r.bench: r.hits for r in decon.hits_by_bench(items, found).collect()} == {"flores": 1, "other": 0, "tiny": 0}
    assert decon.survivors(docs, found).count() == 19


def test_splits(spark):
    rows = [(i, f"s{i % 4}", f"2025-{i % 6 + 1:02d}-03") for i in range(1000)] + [(2000 + i, None, "1900-01-01") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, source string, post_date string")
    got = {r.id: (r.split, r.month) for r in splits.assign(df, 100, 100, 2, 50).collect()}
    counts = {s: sum(x == s for x, _ in got.values()) for s in ("train", "val", "test_iid", "test_tail")}
    assert counts == {"train": 800, "val": 100, "test_iid": 100, "test_tail": 50} and len(got) == 1050
    assert all((s == "test_tail") <= (m in ("2025-05", "2025-06")) for s, m in got.values())
    again = {r.id: (r.split, r.month) for r in splits.assign(df.repartition(7), 100, 100, 2, 50).collect()}
    assert again == got


def test_gates(spark):
    train = [(i, say(i), "train") for i in range(50)]
    bad = spark.createDataFrame([*train, (100, say(3), "val"), (101, say(4) + " q", "val"), (102, say(777), "val")], "doc_id int, text string, split string")
    sets = bad.select("doc_id", "split", T.ngrams(T.words(T.signature_view(F.col("text"))), 5, short=True).alias("shingles"))
    placed = minhash.banded(sets).cache()
    near = minhash.near_rate(placed.where("split = 'train'"), placed.where("split <> 'train'"))
    report = verify.gate_report(verify.exact_overlaps(bad), near)
    assert verify.exact_overlaps(bad).first().shared == 1 and near.first().hits >= 1 and not report.first()["pass"]
    try:
        verify.require(report)
        raise AssertionError
    except verify.GateFailure:
        pass
    good = spark.createDataFrame([*train, (102, say(777), "val")], "doc_id int, text string, split string")
    assert verify.exact_overlaps(good).first().shared == 0
    assert verify.paragraph_leaks(bad).first().leaks == 1


def test_samples(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("s"))
    assert joins.random_sample(df, 10).count() == 10 and joins.stratified_sample(df, "s", 4).count() == 12
    assert 60 < joins.hash_sample(df, 0.1).count() < 140
    assert sorted(r.id for r in joins.numbered(df.limit(300), "w", F.desc("doc_id")).collect()) == sorted(f"w_{i}" for i in range(300))
    try:
        joins.require_strata(df, "s", 400)
        raise AssertionError
    except ValueError:
        pass
