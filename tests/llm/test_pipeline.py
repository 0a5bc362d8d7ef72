import random

import corpus_pipeline as cp
import pytest
from textloom.llm.packing import encoder
from textloom.llm.queries import tokenizer_paths

from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_neardup import brute as groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, masked string, text_hash string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(6)
    d = str(tmp_path_factory.mktemp("sf"))
    vocab = [f"word{i}" for i in range(500)]
    say = lambda n: " ".join(r.choices(vocab, k=n)) + "."
    items = [(i, say(14)) for i in range(5)]
    docs, labels = [], []
    for i in range(300):
        t = say(r.randrange(60, 200))
        if i % 10 == 3:
            t = " | ".join(t.split()) + " ###"
        if i % 10 == 5:
            t += " " + items[i % 5][1]
        if i % 10 == 7:
            t = docs[i - 1][1] + " more"
        if i % 10 == 9:
            t += " write to a.b@mail.example.com now"
        docs.append((i, t))
        if i % 2:
            labels.append((i, int(i % 10 != 3), 0))
    docs += [(900, None), (901, ""), (None, say(80)), docs[0], docs[0]]
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", "y", "z") for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, docs, items


def test_stages_equal_plain_versions(spark, tables):
    d, docs, items = tables
    out = {"": spark.read.parquet(f"{d}/documents.parquet")}
    last = ""
    for name, stage in cp.STAGES:
        out[name] = stage(spark, out[last], d).cache()
        last = name
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    pairs = lambda df: sorted([(r.doc_id, r.text) for r in df.collect()], key=key)
    for name, _ in cp.STAGES[:-1]:
        assert out[name].columns == list(cp.COLUMNS)
    good = pairs(out["quality"])
    assert all(x in good for x in docs if x[0] is not None and x[0] < 300 and x[0] % 10 != 3)
    assert not [i for i, _ in good if i is not None and i < 300 and i % 10 == 3]

    want = sorted({x for x, (_, _, c) in zip(good, groups(good, 5)) if x[0] == c}, key=key)
    assert pairs(out["near_dedup"]) == want
    want = [x for x in want if not hits(x[1], items)[1]]
    assert pairs(out["decontaminate"]) == want
    want = [(i, t and t.replace("a.b@mail.example.com", "<email>")) for i, t in want]
    assert pairs(out["personal_data"]) == sorted(want, key=key)
    assert all(r.n_chars == len(r.text) for r in out["personal_data"].collect() if r.text is not None)
    enc = encoder(*tokenizer_paths())
    got = out["packing"].toPandas()
    assert sorted(got.groupby(got.doc_id.fillna(-1))["length"].sum()) == sorted(len(enc.ids(t or "")) + 1 for _, t in want)
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048


def test_run(spark, tables):
    assert cp.run(spark, tables[0]).count() > 0 and cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES][0] == "quality"


def test_empty(spark, tables, tmp_path):
    d = tables[0]
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, d).count() == 0
