"""The queries in production's configuration against brute force on a small table."""

import random

import numpy as np
import pytest
import xxhash
from textloom import queries
from textloom.operators import minhash

A, B = minhash.coefficients(112, 42)


def keys(text):
    w = text.split()
    grams = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)}
    h = np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64)
    sig = ((A[:, None] * h[None] + B[:, None]) % np.uint64(minhash.PRIME)).min(axis=1).astype("<u8")
    return [(k, xxhash.xxh64_intdigest(sig[k * 8 : k * 8 + 8].tobytes())) for k in range(14)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(5)
    say = lambda n: " ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    texts = []
    for _ in range(60):  # two thirds of each group's text is its own: similarity a fifth to a half
        shared = say(60)
        texts += [f"{shared} {say(r.randrange(20, 90))}" for _ in range(2)]
    for i in range(20):
        texts.append(" ".join(w if r.random() > 0.01 else "other" for w in texts[i * 2].split()) + " more")
    d = str(tmp_path_factory.mktemp("lsh"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d, texts


def test_survivors_and_rates_equal_brute_force(spark, table):
    d, texts = table
    placed = [set(keys(t)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if placed[i] & placed[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    want = {min((-len(texts[i]), i) for i in range(len(texts)) if root[i] == c)[1] for c in set(root)}
    got = {x.doc_id for x in queries.QUERIES["production_survivors"](spark, d).collect()}
    assert got == want
    assert {(x.node, x.root) for x in queries.QUERIES["production_components"](spark, d).collect()} == {(i, c) for i, c in enumerate(root) if root.count(c) > 1}
    assert len(queries.QUERIES["fuzzy_survivors"](spark, d).collect()) < len(want)  # 4 bands of 4 rows drop documents that are not near
    near = {x.split: x.hits for x in queries.QUERIES["production_near_rate"](spark, d).collect()}
    train = set().union(*[p for i, p in enumerate(placed) if i % 10 < 8])
    assert near == {s: sum(bool(p & train) for i, p in enumerate(placed) if i % 10 == m) for s, m in (("val", 8), ("test_iid", 9))}
