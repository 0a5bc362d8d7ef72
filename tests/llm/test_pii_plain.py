"""The field's training and the assembly of spans against plain versions; numbers of any length; bounded memory."""

import itertools
import random
import re
import resource

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from textloom.llm import pii
from textloom.llm.pii import _TAGS, _TOKEN, _allowed, _gaps, _laid_out, base_spans, default_field, detect, features, find_spans, gradient, labelled_table, train


def value(digits: str) -> int:
    return min(256, int(digits.lstrip("0")[:4] or "0"))


def plain_base(t):
    """The four patterns as written, each tried at every start."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(value(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        doubled = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and doubled % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["1.2.3.4", "0" * 5000, "9" * 5000, ".1.1.1", "+1 ", "4111 1111 1111 1111", "a@b.c", "@", ".", "-", " ", "é", "٣", "²"]), st.text("0123456789.+-@() ab", max_size=25)), max_size=8).map("".join))
def test_any_digits(t):
    assert base_spans(t) == plain_base(t)


def test_a_text_of_many_numbers_stays_small():
    field = default_field()
    find_spans(["warm 1"], field)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    find_spans(["1234 567 " * 100_000, *["a 1"] * 255], field)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 500


def log_likelihood(rows, names, emit, move, first):
    """By enumeration of every tag sequence."""
    total = 0.0
    for text, spans in rows:
        toks = list(_TOKEN.finditer(text))
        ids = [[names[f] for f in x] for x in features([m[0] for m in toks], _gaps(toks))]
        gold = []
        for m in toks:
            own = [(k, a) for k, a, b in spans if a <= m.start() < b]
            gold.append(_TAGS.index(("B-" if m.start() == own[0][1] else "I-") + own[0][0]) if own else 0)
        weigh = lambda ys: first[ys[0]] + sum(emit[f, y] for x, y in zip(ids, ys) for f in x) + sum(move[a, b] for a, b in zip(ys, ys[1:]))  # noqa: E731, B023
        total += weigh(gold) - np.logaddexp.reduce([weigh(ys) for ys in itertools.product(range(len(_TAGS)), repeat=len(toks))])
    return total


def test_gradient_equals_differences_of_the_likelihood(monkeypatch):
    tags = ("O", "B-name", "I-name", "B-secret", "I-secret")
    for module in (pii, __import__(__name__, fromlist=["x"])):
        monkeypatch.setattr(module, "_TAGS", tags)
    rows = [("Dear Ann B,", [("name", 5, 10)]), ("key=x1", [("secret", 4, 6)]), ("a", [])]
    names: dict[str, int] = {"": 0}
    ids, gold, live = _laid_out(rows, names)
    r = np.random.default_rng(0)
    fixed_move, fixed_first = _allowed()
    emit, move, first = r.normal(size=(len(names), 5)) * 0.3, r.normal(size=(5, 5)) * 0.3 + fixed_move, r.normal(size=5) * 0.3 + fixed_first
    found = gradient(ids, gold, live, emit, move, first)
    for which, (x, d) in enumerate(zip((emit, move, first), found)):
        for at in r.permutation(list(np.ndindex(x.shape)))[:25]:
            at = tuple(at)
            if abs(x[at]) > 1000:  # a move that is never made
                continue
            up, down = [p.copy() for p in (emit, move, first)], [p.copy() for p in (emit, move, first)]
            up[which][at] += 1e-4
            down[which][at] -= 1e-4
            slope = (log_likelihood(rows, names, *up) - log_likelihood(rows, names, *down)) / 2e-4
            assert abs(slope - d[at]) < 1e-4, (which, at)


def test_training_raises_the_likelihood_it_states():
    table = [x for x in labelled_table(40) if x[0]]
    fixed = _allowed()
    names: dict[str, int] = {"": 0}
    ids, gold, live = _laid_out(table, names)
    near = []
    for rounds in (1, 40):
        f = train(table, rounds=rounds)
        assert f.names == names
        near.append(float(np.abs(gradient(ids, gold, live, f.emit, f.move, f.first)[2]).max()))
        assert (f.move[fixed[0] < -1] < -1000).all()
    assert near[1] < near[0]


def plain_spans(text, field):
    """Tags of the plain decoder; a begin and the inside tags of its kind after it are a span, unless it meets a fixed one."""
    fixed, toks = plain_base(text), list(_TOKEN.finditer(text))
    tags = [_TAGS[k] for k in field.decode([field.ids([m[0] for m in toks], _gaps(toks))])[0]] if toks else []
    out, i = list(fixed), 0
    while i < len(tags):
        j = i + 1
        if tags[i].startswith("B-"):
            kind = tags[i][2:]
            while j < len(tags) and tags[j] == f"I-{kind}":
                j += 1
            a, b = toks[i].start(), toks[j - 1].end()
            numeric = kind in ("national_id", "iban", "local_phone")
            if all(b <= x or y <= a for _, x, y in fixed) and (not numeric or re.search("[0-9]", text[a:b])):
                out.append((kind, a, b))
        i = j
    return fixed, sorted(out, key=pii.order)


def test_whole_result_equals_a_plain_version(spark):
    r = random.Random(4)
    texts = [t for t, _ in pii.open_table(80, seed=3) + labelled_table(80, seed=4)]
    texts += ["".join(r.choice(["Dear Ann Bo, ", "a@b.co ", "1.2.3.4 ", "token=abc1 ", "+1 (555) 123-4567 ", "12 Oak Street, ", "é ", "\n"]) for _ in range(9)) for _ in range(40)] + ["", None]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = docs.orderBy("doc_id").limit(60).unionByName(extra)
    given_ = {x.doc_id: x.text for x in rows.collect()}
    field, say = default_field(), lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for x in detect(rows).collect():
        base, every = plain_spans(given_[x.doc_id] or "", field)
        assert (x.base, x.spans) == (say(base), say(every))


def test_names_of_the_result_are_not_kept(spark):
    df = spark.createDataFrame([(1, "t", "x")], "doc_id long, text string, spans string")
    with pytest.raises(ValueError, match="spans"):
        detect(df, keep=("doc_id", "spans"))
    from textloom.llm.quality import score_quality

    with pytest.raises(ValueError, match="score"):
        score_quality(df.withColumnRenamed("spans", "score"), None, keep=("doc_id", "score"))
