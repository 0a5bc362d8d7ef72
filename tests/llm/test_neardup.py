import random
import re

import numpy as np
import pyarrow as pa
import pytest
from textloom.llm import neardup
from textloom.operators.components import components
from textloom.llm.hashing import shingle_hashes, text_chunks, word_hashes
from textloom.llm.neardup import minima, near_duplicates, packed

SCHEMA = "doc_id long, text string, key string, sig string, id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(docs, n, threshold=80):
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    docs = []
    for i in range(n):
        if i % 3 and docs:
            w = words(r.choice(docs)[1])
            for _ in range(r.randrange(0, 1 + len(w) // 12)):
                w[r.randrange(len(w))] = r.choice(vocab)
            t = " ".join(w)
        else:
            t = " ".join(r.choices(vocab, k=r.choice([1, 2, 3, 8, 60, 200])))
        docs.append((r.randrange(10**6) * 1000 + i, t.upper() if r.random() < 0.1 else t))
    return [*docs, (5, None), (6, ""), (7, " \n"), (None, docs[0][1]), (None, "q w e r t y"), docs[3], docs[3], (9, "one"), (10, "One"), (11, "two one")]


def order(x):
    return tuple((v is None, v or 0) for v in x)


@pytest.mark.parametrize("seed,n", [(1, 2), (2, 2), (3, 5)])
def test_components_equal_brute_force(spark, seed, n):
    docs = corpus(seed)
    got = near_duplicates(spark.createDataFrame([(*d, "a", "b", "c") for d in docs], SCHEMA), shingle=n).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=order) == sorted(brute(docs, n), key=order)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_chain_within_one_bucket(spark, monkeypatch):
    """Neighbours in a chain are linked, its ends are not: pairing with one row of a bucket alone would lose links."""
    w = [f"w{i}" for i in range(100)]
    docs = []
    for k in range(12):
        docs.append((k * 7 % 12 + 1, " ".join(w)))
        w[8 * k : 8 * k + 4] = [f"x{k}_{i}" for i in range(4)]
    docs += [(100 + k, " ".join(w[:60] + [f"y{k}_{i}" for i in range(20)])) for k in range(5)]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(brute(docs, 2))


def test_large_groups(spark):
    base = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(base)) for i in range(1500)]
    docs += [(5000 + i, " ".join(base[:70] + [f"z{i}", f"t{i}"])) for i in range(600)]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2).groupBy("component_id").count().collect()
    assert [(x.component_id, x["count"]) for x in got] == [(0, 2100)]


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimate_follows_similarity():
    r = np.random.default_rng(0)
    x = r.integers(0, 2**63, 3000, dtype=np.uint64)
    for share in (0.0, 0.5, 0.8, 0.95):
        keep = int(2 * 2000 * share / (1 + share) + 0.5)
        a, b = x[:2000], np.concatenate([x[:keep], x[2000 : 4000 - keep]]) if keep >= 1000 else np.concatenate([x[:keep], r.integers(0, 2**63, 2000 - keep, dtype=np.uint64)])
        p = packed(minima(a)) ^ packed(minima(b))
        u = p.view(np.uint64)
        differ = int(np.bitwise_count((u | (u >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum())
        estimate = ((neardup.PERMUTATIONS - differ) / neardup.PERMUTATIONS - 0.25) / 0.75
        assert abs(estimate - share) < 0.2


def test_hashes_are_those_of_words():
    texts = ["a b", "", None, "  A\tb\x0bc ", "x" * 9000 + " a", "é É", "\n", "end", "b"]
    got, own = {}, []
    for _, _, data, offsets in text_chunks(pa.array(texts), limit=8):
        h, bounds = word_hashes(data, offsets)
        own += [h[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:])]
    assert len(own) == len(texts)
    for t, hs in zip(texts, own):
        assert len(hs) == len(words(t))
        for w, h in zip(words(t), hs):
            assert got.setdefault(w, h) == h
    assert len(set(got.values())) == len(got)
    ab, ba = (list(shingle_hashes(*word_hashes(np.frombuffer(t, np.uint8), np.array([0, len(t)])), 2))[0] for t in (b"a b", b"b a"))
    assert ab[0] != ba[0]


def test_graph(spark):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(40)] + [(1000, 1001 + i) for i in range(200)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(500):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def test_intersections_equal_brute_force():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 400, int(k), dtype=np.uint64)) for k in r.integers(1, 300, 30)]
    got = neardup.common_counts(sets, chunk=64)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(np.intersect1d(a, b))
    assert neardup.common_counts([np.array([1], np.uint64), np.array([2], np.uint64)]).sum() == 0


def test_blocks_lose_no_link(spark):
    docs = corpus(7, 200)
    got = near_duplicates(spark.createDataFrame([(*d, "a", "b", "c") for d in docs], SCHEMA), shingle=2, block=2).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=order) == sorted(brute(docs, 2), key=order)
