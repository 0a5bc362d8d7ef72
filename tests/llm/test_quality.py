import random

import numpy as np
from textloom.llm.quality import FEATURES, fit, learn, score_quality, statistics

SCHEMA = "doc_id long, text string, score string, y string"


def test_density_equals_plain_formula():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 1, (80, 3)), r.normal(1, 2, (120, 3))])
    y = np.array([0] * 80 + [1] * 120)
    m = fit(x, y, shrink=0.0, pool=0.0)
    logs = []
    for k in (0, 1):
        p = x[y == k]
        c = np.cov(p.T, bias=True)
        d = x - p.mean(axis=0)
        logs.append(np.log(len(p) / len(x)) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))
    assert fit(x, np.zeros(200, int)) is None


def test_constant_columns_do_not_break_the_factor():
    x = np.zeros((20, 4))
    x[:10, 0] = 1
    assert np.isfinite(fit(x, np.array([0] * 10 + [1] * 10)).score(x)).all()


def test_statistics():
    assert statistics(None) == statistics("") and len(FEATURES) == 13
    for t in ["", "a", "A!!", "x " * 9, "é\n\n東京 | | |", "w" * 100000]:
        assert len(statistics(t)) == len(FEATURES) and np.isfinite(statistics(t)).all()


def test_quality(spark):
    r = random.Random(1)
    good, rows, labels = [f"word{i}" for i in range(400)], [], []
    for i in range(240):
        w = r.choices(good, k=r.randrange(30, 200))
        bad = i % 5 == 0
        rows.append((i, " ".join(f"{x} |" if bad else x for x in w) + ".", "x", "y"))
        labels.append((i, int(not bad)))
    rows += [(900, None, "x", "y"), (901, "", "x", "y"), (None, "one", "x", "y"), (5, rows[5][1], "x", "y")]
    labels += [(1, 1), (None, 0), (2, None)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    got = score_quality(docs, learn(docs, marks)).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    assert all((x.score >= 0.7) == (x.doc_id % 5 != 0) for x in got if x.doc_id is not None and x.doc_id < 240)


def test_no_labels_and_no_documents(spark):
    docs, marks = spark.createDataFrame([(1, "a", "x", "y")], SCHEMA), spark.createDataFrame([], "doc_id long, quality int")
    assert learn(docs, marks) is None and score_quality(docs, None).collect()[0].score == 0.5
    assert score_quality(docs.limit(0), None).count() == 0
