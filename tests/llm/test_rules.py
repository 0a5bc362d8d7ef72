import math
import random
import re
from collections import Counter

import pytest

from textloom.llm.rules import quality_rules

SCHEMA = "doc_id long, text string, llr string, n_words string, bucket string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def rows(seed):
    r = random.Random(seed)
    good, bad = [f"g{i}" for i in range(30)], [f"b{i}|" for i in range(30)]
    docs = []
    for i in range(80):
        vocab = bad if i % 4 == 0 else good
        docs.append((i, r.choice([" ", "\n", "\t", " \n "]).join(r.choice(vocab) for _ in range(r.randrange(0, 140)))))
    docs += [(200, None), (201, ""), (202, " \n"), (None, "a b c a b c"), (203, "a\nb\na\n\n\n a\nb"), (204, "x y z " * 500), (5, docs[5][1]), (5, "é ü 東京 " * 9)]
    return docs


def test_counts_and_verdict(spark):
    docs = rows(1)
    df = spark.createDataFrame([(*x, "a", "b", "c") for x in docs], SCHEMA)
    trusted = spark.createDataFrame([(i,) for i in range(80) if i % 4 and i % 3] + [(None,), (1,)], "doc_id long")
    got = quality_rules(df, trusted).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    mine = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key)
    assert mine == sorted(((i, *brute(t)) for i, t in docs), key=key)
    for r in got:
        assert not (r.kept and r.base_failed)
        if not r.base_failed and r.doc_id is not None and r.doc_id < 80:
            assert r.kept == (r.doc_id % 4 != 0)


def test_ratio_equals_brute_force(spark):
    """With far more buckets than words no two share one, so the ratio follows from plain counts."""
    docs, n = [(1, "a b a"), (2, "a c"), (3, None), (4, "b b")], 1 << 24
    trusted = {1, 4}
    grams = lambda t: (w := (t or "").split()) + list(zip(w, w[1:]))
    raw = [g for _, t in docs for g in grams(t)]
    own = [g for i, t in docs if i in trusted for g in grams(t)]
    weight = lambda g: math.log((own.count(g) + 5) / (raw.count(g) * len(own) / len(raw) + 5))
    got = quality_rules(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1,), (4,)], "doc_id long"), buckets=n)
    for r in got.collect():
        want = [weight(g) for g in grams(dict(docs)[r.doc_id])]
        assert abs(r.llr - (sum(want) / len(want) if want else 0)) < 1e-6


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert quality_rules(df, spark.createDataFrame([], "doc_id long")).count() == 0
    one = quality_rules(spark.createDataFrame([(1, "a " * 60)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long")).collect()
    assert one[0].llr == 0


def test_long_text(spark):
    r = random.Random(9)
    docs = [(1, " ".join(f"w{r.randrange(100000)}" for _ in range(60000)) + " p q r p q r")]
    got = quality_rules(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "doc_id long")).collect()[0]
    assert got.n_words == 60006 and got.n_repeat_words == 6


@pytest.mark.parametrize("options", [{}, {"broadcast_blocks": 0}])
def test_target_is_learnt_from_every_trusted_document(spark, options):
    """More trusted ids than any sample took, ids of many rows, null ids, ids without a row: the ratio is that of plain counts."""
    r = random.Random(4)
    docs = [(i, " ".join(f"w{r.randrange(20) + (i % 2) * 10}" for _ in range(4))) for i in range(50_000)]
    docs += [(7, "w1 w2 w25")] * 300 + [(8, "w3 w26")] * 300 + [(None, "w4 w5 w27")] * 300
    trusted = [(i,) for i in range(0, 60_000, 2)] + [(1,), (7,), (7,), (None,)]
    known = {i for (i,) in trusted if i is not None}
    grams = lambda t: (w := t.split()) + list(zip(w, w[1:]))
    raw, own = Counter(g for _, t in docs for g in grams(t)), Counter(g for i, t in docs if i in known for g in grams(t))
    scale = own.total() / raw.total()
    weight = {g: math.log((own[g] + 5) / (n * scale + 5)) for g, n in raw.items()}
    llr = lambda t: sum(weight[g] for g in grams(t)) / len(grams(t))
    buckets = 1 << 30  # no two grams share one
    got = quality_rules(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(trusted, "doc_id long"), buckets=buckets, **options)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    mine, want = sorted(((x.doc_id, x.llr) for x in got.collect()), key=key), sorted(((i, llr(t)) for i, t in docs), key=key)
    assert [i for i, _ in mine] == [i for i, _ in want]
    assert max(abs(a - b) for (_, a), (_, b) in zip(mine, want, strict=True)) < 1e-6
