import random

import numpy as np
import public_tokenizers as P
import pytest
from textloom.llm.packing import Encoder, fill, karmarkar_karp, pack, pack_documents
from textloom.llm.queries import tokenizer_paths
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, start string, row string, g string"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(plain):
    r, enc = random.Random(3), Encoder(*tokenizer_paths())
    texts = ["", " ", "a", "<|endoftext|> x", "I'll we've 'S é 東京　​\t\n\n  x  ", "a" * 5000, "  " * 3000, "\r\n " * 50, "١٢٣ ½ ²x", "é \U0001f600"]
    texts += ["".join(r.choice("ab é1.,'\n \t#東") for _ in range(r.randrange(1, 300))) for _ in range(200)]
    texts += [" ".join(r.choice(["word", "x1", "é,", "\n", " "]) for _ in range(60000)), "a b" + " " * 30000 + "c" * 100000]
    for t in texts:
        assert enc.ids(t).tolist() == plain(t)
        assert enc.ids(t, chunk=50).tolist() == plain(t)


@pytest.mark.parametrize("seed", range(8))
def test_differencing(seed):
    r = np.random.default_rng(seed)
    sizes, k = r.integers(1, 500, 300), int(r.integers(1, 60))
    window, sums = karmarkar_karp(sizes, k)
    assert sorted(np.bincount(window, sizes, len(sums)).astype(int)) == sorted(sums) and len(sums) == k
    if k > 1:
        assert sums.max() - sums.min() <= sizes.max()


def test_classic_two_way():
    assert sorted(karmarkar_karp(np.array([8, 7, 6, 5, 4]), 2)[1]) == [14, 16]


def test_pack_holds_the_capacity():
    r = np.random.default_rng(1)
    for sizes in (r.integers(1, 385, 2000), np.full(50, 2048), np.full(100, 1100), np.array([1]), np.array([], int)):
        window = pack(sizes, 2048)
        assert (np.bincount(window, sizes) <= 2048).all() if len(sizes) else len(window) == 0
    sizes = r.integers(1, 385, 8192)
    assert sizes.sum() / (2048 * (pack(sizes, 2048).max() + 1)) > 0.98


@pytest.mark.parametrize("seed", range(25))
def test_differencing_equals_plain_lists(seed):
    """Merging partial partitions as lists of k windows, zeros included, gives the same sums."""
    r = np.random.default_rng(seed)
    k, sizes = int(r.integers(2, 9)), r.integers(1, 60, int(r.integers(1, 40)))
    spread = lambda x: x[0] - x[-1]
    parts = [(i, [int(s)] + [0] * (k - 1)) for i, s in enumerate(sizes)]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda x: (-spread(x[1]), x[0]))
        (_, x), (_, y) = parts[:2]
        parts = [*parts[2:], (made, sorted((p + q for p, q in zip(x, reversed(y))), reverse=True))]
        made += 1
    sums = sorted(karmarkar_karp(sizes, k)[1].tolist(), reverse=True)
    assert sums + [0] * (k - len(sums)) == parts[0][1]


def test_fill_cuts_only_where_it_must():
    r = np.random.default_rng(2)
    item, start, length, window = fill(r.integers(1, 700, 4000), 2048)
    assert len(item) == 4000 and not start.any()
    lengths = np.full(300, 1100)  # two do not fit: cut
    item, start, length, window = fill(lengths, 2048)
    sums = np.bincount(window, length)
    assert (np.bincount(item, length) == lengths).all() and sums.max() <= 2048 and length.sum() / (2048 * len(sums)) >= 0.98
    for few in ([], [5], [2047, 2047]):
        item, start, length, window = fill(np.array(few, int), 2048)
        assert len(item) == len(few)


def test_every_blank_of_unicode(plain):
    """Texts that are cut have the ids of the whole, whatever the blank at the cut and around it."""
    import re
    import sys

    enc = Encoder(*tokenizer_paths())
    blanks = [c for c in map(chr, range(sys.maxunicode + 1)) if re.match(r"\s", c)] + ["\u200b", "\u180e", "\ufeff"]
    assert len(blanks) > 25
    for x in blanks:
        for y in blanks[:3] + [x]:
            t = "".join(f"{w}{x}{y}" for w in ("a", "1", "!", "é", "'s", "東", "𝔸b")) * 3 + x
            assert enc.ids(t, chunk=5).tolist() == plain(t), (x, y)


def test_long_texts_have_the_same_ids(plain):
    r, enc = random.Random(9), Encoder(*tokenizer_paths())
    for sep in (" ", "\n", "\u3000", "\u00a0 ", "\u2028"):
        t = sep.join(r.choice(["word", "x1", "é,", "don't", "東京", "--"]) for _ in range(45_000))
        assert len(t) > 100_000 and enc.ids(t).tolist() == plain(t)


def test_documents(spark, plain):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(["the", "of", "ening", "é"]) for _ in range(r.choice([1, 30, 400, 3000])))) for i in range(120)]
    docs += [(500, None), (501, ""), (None, "a b c"), (7, "twice"), (7, "twice"), (502, "the " * 2046 + "the"), (2**60 + 1, "big id")]
    df = spark.createDataFrame([(*d, "a", "b", "c") for d in docs], SCHEMA)
    got = pack_documents(df, tokenizer_paths(), group=100).toPandas()
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 2048
    mine: dict = {}
    rows = pack_documents(df, tokenizer_paths(), group=100).collect()
    for x in sorted(rows, key=lambda x: (x.start, x.sequence_id, x.offset)):
        ids = np.frombuffer(x.ids, "<u4").tolist()
        assert len(ids) == x.length
        mine.setdefault((x.doc_id, x.doc_tokens), []).append((x.start, ids))
    for i, t in docs:
        want = [*plain(t), 1]
        parts = mine[i, len(want)]
        assert {p[0] for p in parts} and [v for s, p in parts for v in p] == want * (2 if i == 7 and t == "twice" else 1) or i == 7
    again = pack_documents(df.repartition(7), tokenizer_paths(), group=100).toPandas()
    key = ["sequence_id", "offset"]
    assert got.sort_values(key).fillna(-1).reset_index(drop=True).equals(again.sort_values(key).fillna(-1).reset_index(drop=True))


def test_real_table_is_packed_whole_and_full(spark, plain):
    """Each document's pieces put together are its ids; sequences are at least 98 % full."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pack_documents(docs, tokenizer_paths()).collect()
    parts: dict = {}
    for x in rows:
        parts.setdefault(x.doc_id, []).append((x.start, np.frombuffer(x.ids, "<u4").tolist()))
    for d in docs.collect():
        assert [v for _, p in sorted(parts[d.doc_id]) for v in p] == [*plain(d.text), 1]
    n = sum(x.length for x in rows)
    assert n / (2048 * len({x.sequence_id for x in rows})) >= 0.98


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), tokenizer_paths()).count() == 0
