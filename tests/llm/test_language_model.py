import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from textloom.llm.language_model import Automaton, decode, decode_sorted, encode, encode_sorted, score_texts

SCHEMA = "doc_id long, text string, score string, block string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def plain(docs, held, masses=(1000.0, 5.0)):
    """Each token's chance by plain recursion over shorter and shorter histories; no states, no failure arcs."""
    train = [tokens(t) for d, t in docs if not held(d)]
    grams = [Counter(), Counter(), Counter()]
    for t in train:
        padded = ["<start>", *t]
        grams[0].update(t)
        grams[1].update(zip(padded, t))
        grams[2].update(zip(padded, t, t[1:]))
    n, v = sum(grams[0].values()), len(grams[0])
    followed = Counter(h for (h, _), c in grams[1].items() for _ in range(c)), Counter((a, b) for (a, b, _), c in grams[2].items() for _ in range(c))

    def chance(history, w):
        if not history:
            return (grams[0][w] + 0.5) / (n + 0.5 * (v + 1))
        k = len(history)
        c = followed[0][history[0]] if k == 1 else followed[1][history]
        m = masses[k - 1]
        return (grams[k][(*history, w)] + m * chance(history[1:], w)) / (c + m)

    out = []
    for d, t in docs:
        padded, ts = ["<start>", *tokens(t)], tokens(t)
        base = sum(math.log10(chance((), w)) for w in ts)
        score = sum(math.log10(chance(tuple(padded[max(0, i - 1) : i + 1]), w)) for i, w in enumerate(ts))
        out.append((d, held(d), len(ts), sum(grams[0][w] > 0 for w in ts), n, round(base, 6), round(score, 6)))
    return out


@pytest.mark.parametrize("block", [100, 10**6])
def test_scores_equal_a_plain_walk(spark, block):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["the", "The", "of", "é", "x1", f"w{r.randrange(60)}"]) for _ in range(r.randrange(0, 60)))) for i in range(90)]
    docs += [(100, None), (101, ""), (None, "the of"), (7, docs[7][1]), (8, "never seen words"), (102, "zz " * 3000)]
    held = lambda d: d is not None and d % 5 == 1
    df = spark.createDataFrame([(*d, "a", "b") for d in docs], SCHEMA)
    got = score_texts(df, F.col("doc_id") % 5 == 1, block_tokens=block).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    mine = sorted(((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6), round(x.score, 6)) for x in got), key=key)
    for a, b in zip(mine, sorted(plain(docs, held), key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-4 and abs(a[6] - b[6]) < 1e-4


def test_weights_of_each_state_sum_to_one():
    """Every state of the real automaton, following failure arcs for tokens without an arc, over all tokens and one unseen."""
    docs = ["a b a c a b", "b c", "a b a", ""]
    ts = [[*t.split(), "</s>"] for t in docs]
    vocab = sorted({w for t in ts for w in t})
    words = np.array([vocab.index(w) for t in ts for w in t])
    first = np.array([i == 0 for t in ts for i, _ in enumerate(t)])
    pairs = [("<s>" if f else words[i - 1], w) for i, (f, w) in enumerate(zip(first, words))]
    triples = [None if f else (pairs[i - 1], words[i]) for i, f in enumerate(first)]
    at = [sorted(set(x for x in xs if x is not None), key=str) for xs in (pairs, triples)]
    places = [np.array([u.index(x) if x is not None else -1 for x in xs]) for u, xs in zip(at, (pairs, triples))]
    counts = [np.bincount(p[p >= 0], minlength=n) for p, n in zip((words, *places), (len(vocab), *map(len, at)))]
    m = Automaton(len(words), len(vocab), len(docs), (3.0, 0.7), words, *places, first, counts, vocab.index("</s>"))
    arcs = {0: {w: m.weight[0][w] for w in range(len(vocab))}}
    unseen = math.log10(0.5 / (len(words) + 0.5 * (len(vocab) + 1)))
    for j, (h, w) in enumerate(at[0]):
        arcs.setdefault(1 if h == "<s>" else 2 + h, {})[w] = m.weight[1][j]
    for j, (h, w) in enumerate(at[1]):
        arcs.setdefault(2 + len(vocab) + at[0].index(h), {})[w] = m.weight[2][j]
    assert len(arcs) > 8

    def weight(state, w):
        if w in arcs[state]:
            return arcs[state][w]
        return m.fail[state] + weight(m.back[state], w) if state else unseen

    for state in arcs:
        assert abs(sum(10 ** weight(state, w) for w in range(len(vocab) + 1)) - 1) < 1e-9


def test_words_seen_in_order_score_better_than_shuffled(spark):
    r = random.Random(1)
    text = [f"w{r.randrange(300)}" for _ in range(400)]
    docs = [(0, " ".join(text)), (1, " ".join(text)), (6, " ".join(r.sample(text, len(text))))]
    got = {x.doc_id: x for x in score_texts(spark.createDataFrame([(*d, "a", "b") for d in docs], SCHEMA), F.col("doc_id") % 5 == 1).collect()}
    assert abs(got[1].base_score - got[6].base_score) < 1e-6 and got[1].score > got[6].score + 50


def test_nothing_to_learn_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y")], SCHEMA)
    got = score_texts(df, F.lit(True)).collect()[0]
    assert got.train_tokens == 0 and got.n_known == 0 and got.score == got.base_score == 3 * math.log10(1.0)
    assert score_texts(df.limit(0), F.lit(False)).count() == 0


def test_codes():
    r = np.random.default_rng(0)
    for x in (np.zeros(0, np.uint64), np.array([0, 2**64 - 1], np.uint64), np.unique(r.integers(0, 2**63, 5000, dtype=np.uint64))):
        assert (decode(encode(x)) == x).all() and (decode_sorted(encode_sorted(x)) == x).all()
