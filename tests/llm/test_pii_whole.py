"""The field reads whole texts: names, addresses, user names and secrets far from any digit."""

import random

import numpy as np
from textloom.llm.pii import _TOKEN, _gaps, _scorer, default_field, find_spans, open_table

#: First names that are in no list.
OTHERS = ("Gertrude", "Bartholomew", "Ingrid", "Sven", "Kofi", "Amara", "Zoltan", "Mirela", "Takeshi", "Siobhan")


def recall(rows):
    want = got = hit = 0
    for (_, spans), (fixed, every) in zip(rows, find_spans([t for t, _ in rows], default_field())):
        a = {s for s in spans if not any(x < s[2] and s[1] < y for _, x, y in fixed)}
        b = set(every) - set(fixed)
        want, got, hit = want + len(a), got + len(b), hit + len(a & b)
    return hit / want, hit / got


def test_rows_it_has_not_seen():
    found, right = recall(open_table(400, seed=77))
    assert found > 0.9 and right > 0.95
    found, right = recall(open_table(400, seed=78, firsts=OTHERS))  # a name without a cue is not known here
    assert found > 0.75 and right > 0.95


def test_without_a_digit_and_far_from_one():
    far = "the words of it are plain " * 40
    texts = [f"{far}password=correcthorse {far}", f"{far}Dear Maria Kovalan, {far}", f"{far}username: quiet_river {far}", "password=correcthorse", f"7 {far}12 Kovalan Street {far} 3"]
    spans = [[(k, t[a:b]) for k, a, b in every] for t, (_, every) in zip(texts, find_spans(texts, default_field()))]
    assert spans == [[("secret", "correcthorse")], [("name", "Maria Kovalan")], [("username", "quiet_river")], [("secret", "correcthorse")], [("address", "12 Kovalan Street")]]


def test_tables_equal_the_plain_decoder():
    field, r = default_field(), random.Random(0)
    texts = [t for t, _ in open_table(60, seed=5)] + ["", " ", "\n"]
    texts += [" ".join(r.choices(["Mr.", "John", "12", "%", "_", "ABC9", "é", "\n", "DE12", "|", "token", "=", "Oakweg", "\x1c"], k=r.randrange(30))) for _ in range(300)]
    seqs = []
    for t in texts:
        toks = list(_TOKEN.finditer(t))
        seqs.append(field.ids([m[0] for m in toks], _gaps(toks)) if toks else np.zeros((0, 12), np.int32))
    for want, t, (tags, starts, stops) in zip(field.decode(seqs), texts, _scorer(field).tags(texts)):
        assert list(want) == list(tags)
        assert [(m.start(), m.end()) for m in _TOKEN.finditer(t)] == list(zip(starts, stops))
