import hashlib
import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from textloom.llm import pii
from textloom.llm.pii import KINDS, _TAGS, base_spans, default_field, detect, find_spans, labelled_table, masked
from textloom.llm.queries import pii_digests

SCHEMA = "doc_id long, text string, base string, spans string"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0]), s[2]))


@given(st.text(st.sampled_from("aZ0192.@+-_% ()\n,é"), max_size=60))
@settings(max_examples=1500, deadline=None)
def test_fixed_patterns_equal_the_plain_ones(t):
    assert base_spans(t) == plain(t)


def test_fixed_patterns_on_made_values():
    r = random.Random(1)
    for _ in range(500):
        t = "".join(r.choice(["4111 1111 1111 1111", "4111111111111111", "+1 (068) 555-2222", "1.2.3.4", "256.1.1.1", "a.b@c.d-e.f", "x@y", "@", ".", " ", "-", "é", "7", "+", "%a"]) for _ in range(r.randrange(1, 12)))
        assert base_spans(t) == plain(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 300000, "1" * 300000, "1." * 150000, "+1" + " " * 300000, "a@" * 150000, "@" * 300000, "1 " * 150000, "1" * 100000 + "." + "x"):
        base_spans(t)


def test_viterbi_equals_brute_force():
    f = default_field()
    r = np.random.default_rng(0)
    seqs = [r.integers(0, len(f.emit), (int(n), 12)).astype(np.int32) for n in (0, 1, 2, 3, 4, 3, 1)]
    for ids, got in zip(seqs, f.decode(seqs, batch=3)):
        best = max(
            itertools.product(range(len(_TAGS)), repeat=len(ids)),
            key=lambda tags: sum(f.emit[ids[i]].sum(axis=0)[t] for i, t in enumerate(tags)) + sum(f.move[a, b] for a, b in zip(tags, tags[1:])) + (f.first[tags[0]] if tags else 0),
        )
        assert tuple(got) == best


def test_field_on_rows_it_has_not_seen():
    rows = labelled_table(200, seed=99)
    found = find_spans([t for t, _ in rows], default_field())
    base = [[s for s in b] for b, _ in found]
    want = {(i, *s) for i, (_, spans) in enumerate(rows) for s in spans if not any(x < s[2] and s[1] < y for _, x, y in base[i])}
    got = {(i, *s) for i, (_, every) in enumerate(found) for s in every if s not in base[i]}
    assert len(want & got) / len(want) > 0.95 and len(want & got) / len(got) > 0.95


def test_plain_prose_holds_nothing():
    texts = ["Thereof the 12 men in 1999 saw 3.5% of it, version 2.0.", "a b c", "", "Licensed under the Apache License, Version 2.0.", "9807915762804490 rest"]
    assert all(every == [] for _, every in find_spans(texts, default_field()))


def test_documents(spark):
    secret = "token = \"" + hashlib.sha1(b"x").hexdigest() + '"'
    docs = [(1, f"é {secret} and a@b.cd"), (2, None), (3, ""), (None, "1.2.3.4"), (1, "twice"), (1, "twice"), (4, "w " * 50000 + "+1 (068) 555-2222 " + "w" * 90000)]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA)
    rows = detect(df, mask=True).collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    assert by[1] and any(r.masked == 'é token = "<secret>" and <email>' for r in rows)
    assert by[2].masked is None and by[2].spans == "" and by[4].base.startswith("phone:100000:")
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii_digests(detect(df)).collect()}
    assert (1, 1, 0, 0, 0) in got and (None, 0, 1, 0, 0) in got and (4, 0, 0, 0, 1) in got
    empty = [r.base_sha256 for r in pii_digests(detect(df)).collect() if r.doc_id == 2]
    assert empty == [hashlib.sha256(b"").hexdigest()]


def test_empty(spark):
    assert detect(spark.createDataFrame([], SCHEMA)).count() == 0


def test_masked():
    assert masked("abcdef", [("ip", 1, 3), ("phone", 2, 4), ("card", 5, 6)]) == "a<ip>e<card>"
    assert masked(None, []) is None and KINDS[:4] == ("email", "ip", "card", "phone")


def test_table_is_the_same_each_time():
    assert labelled_table() == labelled_table()
    for t, spans in labelled_table():
        assert all(pii._DIGIT.search(t[a:b]) for _, a, b in spans)
