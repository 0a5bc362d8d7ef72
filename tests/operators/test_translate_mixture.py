from pyspark.sql import functions as F
from textloom.operators import joins, lid, mixture, stats, translate


def test_mask_round_trip(spark):
    texts = ["x = $a+b$ and 1,234.5% of $5 or $6", "$$a\nb$$ \\[c\\] \\(d\\) 7", "none", "keep ⟦N1⟧ 3", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", translate.mask(F.col("t")).alias("m"))
    rows = df.select("t", "m.masked", "m.mapping", translate.unmask(F.col("m.masked"), F.col("m.mapping")).alias("back"), translate.integrity(F.col("m.masked"), F.col("m.mapping")).alias("ok")).collect()
    assert rows[0].masked == "x = ⟦EQ1⟧ and ⟦N2⟧ of $⟦N3⟧ or $⟦N4⟧" and rows[1].masked == "⟦EQ1⟧ ⟦EQ2⟧ ⟦EQ3⟧ ⟦N4⟧"
    assert all(r.back == r.t and r.ok == "ok" for r in rows[:3])


def test_gates(spark):
    mapping = F.array(F.struct(F.lit("⟦N1⟧").alias("tok"), F.lit("5").alias("val")))
    df = spark.createDataFrame([("a ⟦N1⟧",), ("a",), ("⟦N1⟧ ⟦N1⟧",), ("⟦N1⟧ 7 8 9 10",)], "t string")
    got = [r.g for r in df.select(translate.integrity(F.col("t"), mapping).alias("g")).collect()]
    assert got == ["ok", "placeholder ⟦N1⟧ count != 1", "placeholder ⟦N1⟧ count != 1", "stray digits introduced: 7,8,9"]
    parts = [r.p for r in spark.createDataFrame([("q \n⟦SEP⟧\n a",), ("q",), ("⟦SEP⟧⟦SEP⟧",)], "t string").select(translate.two_parts(F.col("t")).alias("p")).collect()]
    assert parts == [["q", "a"], None, None]


def test_arbitration_is_null_safe(spark):
    df = spark.createDataFrame([("1", "1", "1"), ("2", "1", "2"), ("2", "1", "1"), (None, None, "1"), ("2", "1", None)], "p string, w string, s string")
    assert [r.x for r in df.select(translate.arbitrate(F.col("p"), F.col("w"), F.col("s")).alias("x")).collect()] == ["PASS", "PASS_solver_limited", "G2_mismatch", "PASS", "PASS_solver_limited"]


def test_attempts(spark):
    items = spark.createDataFrame([("1", "one"), ("2", "two"), ("3", "boom")], "id string, masked string")

    def weak(text, feedback):
        if text == "boom":
            raise ValueError
        return text

    def strong(text, feedback):
        if text == "boom":
            raise KeyError
        return text + "!" if feedback == "again" else text

    def check(item, out):
        return ("PASS", "") if out in ("one", "two!") else ("G0_structure", "again")

    got = {r.id: (r.stage, r.output, r.attempts) for r in translate.translate(items, [weak, weak, strong], check).collect()}
    assert got == {"1": ("PASS", "one", 1), "2": ("PASS", "two!", 3), "3": ("ERR_KeyError", None, 3)}
    done = translate.translate(items, [weak], check)
    assert translate.accepted(done).count() == 1 and translate.rejected(done).count() == 2


def test_judge(spark):
    items = spark.createDataFrame([("a", "rate 4"), ("b", "none")], "id string, prompt string")
    assert {r.id: r.score for r in translate.judge(items, lambda p: p).collect()} == {"a": 4, "b": None}


def test_retries():
    calls = []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise ConnectionError
        return "done"

    assert translate.retrying(flaky, waits=(0, 0, 0))("x") == "done"
    assert translate.retrying(lambda p: 1 / 0, waits=(0, 0), retry_on=(Exception,), give_up="")("x") == ""


def test_mixture(spark):
    rows = spark.createDataFrame([(i, "a" if i < 9 else "b") for i in range(12)], "doc_id long, source string")
    shares = {"a": 0.5, "b": 0.5}
    n = mixture.steps_to_exhaust({"a": 9, "b": 3}, shares)
    out = mixture.interleave(rows, mixture.draws(spark, shares, n)).orderBy("step").collect()
    assert len(out) == n and {r.doc_id for r in out} == set(range(12))
    took_b = [r.doc_id for r in out if r.source == "b"]
    assert took_b == [9 + k % 3 for k in range(len(took_b))]


def test_packing(spark):
    rows = mixture.with_position(spark.createDataFrame([(i, [i] * 5) for i in range(130)], "doc_id int, ids array<int>").repartition(5), "doc_id")
    got = sorted((r.seq_batch, r.seq, r.ids) for r in mixture.pack_sequences(rows, 100, batch=64).collect())
    assert [(b, s) for b, s, _ in got] == [(b, s) for b in (0, 1) for s in range(3)]  # 64 * 6 = 384, 12 in the last batch
    assert got[0][2][:12] == [0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 0]
    assert sorted(r.pos for r in rows.collect()) == list(range(130)) and all(r.pos == r.doc_id for r in rows.collect())


def test_classifier_routes(spark):
    classify = lid.profile({"en": ["the cat and the dog", "this is that"], "fr": ["le chat et la souris", "ceci est cela"]})
    df = spark.createDataFrame([(1, "the dog and the cat"), (2, "la souris et le chat"), (3, None)], "doc_id int, text string")
    kept, rest = lid.run_lid(df, classify, ("en",))
    assert {r.doc_id for r in kept.collect()} >= {1} and 2 in {r.doc_id for r in rest.collect()} and "lid_prob" in rest.columns
    labels = spark.createDataFrame([(1, "x", 0), (1, "y", 5)], "doc_id int, label string, pos int")
    assert {r.doc_id: r.label for r in joins.with_labels(df, labels, "pos").collect()} == {1: "y", 2: None, 3: None}


def test_length_stats(spark):
    df = lambda *n: spark.createDataFrame([("x" * k,) for k in n], "text string")
    assert stats.length_stats(df(1, 2, 3, 4)).first().asDict() == {"docs": 4, "median_chars": 3, "p90_chars": 4, "total_chars": 10}
    assert stats.length_stats(df(1).limit(0)).first().asDict() == {"docs": 0, "median_chars": 0, "p90_chars": 0, "total_chars": 0}
    hist = {r.bin: r.docs for r in stats.length_histogram(df(99, 100, 125, 126, 1000)).collect()}
    assert hist == {20: 2, 21: 1, 30: 1}
