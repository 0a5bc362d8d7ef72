import math
import random

import pytest
from textloom.llm.langid import CrossParser, SuffixAutomaton, identify, learn, running
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, score string"


def brute_phrases(train, text):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in train:
            j += 1
        n, i = n + 1, j
    return n


@pytest.mark.parametrize("seed", range(30))
def test_automaton_parses_as_brute_force(seed):
    r = random.Random(seed)
    train = "".join(r.choice("abéц ") for _ in range(r.randrange(1, 200)))
    a = SuffixAutomaton(train)
    for _ in range(60):
        text = "".join(r.choice("abcéцд ") for _ in range(r.randrange(0, 40)))
        assert a.phrases(text.encode()) == brute_phrases(train.encode(), text.encode())


def test_phrases_run_over_the_bounds_of_words():
    a = SuffixAutomaton(running("the cat sat on the mat"))
    assert a.phrases(b" the cat sat ") == 1 and a.phrases(b" sat the cat ") > 1


def test_letters_are_those_of_isalpha():
    r = random.Random(1)
    pool = "aBé½²①Ⅷ١२٤_- \t1ßñ漢𝔸٣ⅷ㊀ªº"
    for _ in range(300):
        t = "".join(r.choice(pool) for _ in range(r.randrange(0, 12)))
        want = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        assert running(t) == (f" {' '.join(want)} " if want else "")
    parser = CrossParser({"x": " ab ba ", "y": " cd dc "})
    assert [parser.predict(t)[0] for t in ("½ ² ①", "Ⅷ", "12", "", None, "ab", "cd 1")] == ["und"] * 5 + ["x", "y"]


def plain_winner(model, text):
    """Phrases found by searching the model's text, weighed as stated, without an automaton."""
    read = running(text).encode()
    if not read or not model:
        return "und", 0.0
    cost = {k: brute_phrases(m.encode(), read) * math.log2(max(2, len(m))) for k, m in model.items()}
    order = sorted(cost, key=lambda k: (cost[k], k))
    other = cost[order[1]] if len(order) > 1 else 2 * cost[order[0]]
    return order[0], other / (cost[order[0]] + other)


def plain_model(rows, docs, chars):
    """The sample by its stated rule over lists: hash order, short ones first, whole rows within both bounds."""
    out = {}
    for lang in {x for _, _, x, _ in rows if x is not None}:
        own = sorted((len(t) > chars // 8, h, t) for _, t, x, h in rows if x == lang and t and any(c.isalpha() for c in t))
        total, parts = 0, []
        for k, (_, _, t) in enumerate(own[:docs]):
            total += len(t)
            if total <= chars or k == 0:
                parts.append(running(t))
        if parts:
            out[lang] = "".join(parts).replace("  ", " ")
    return out


@pytest.mark.parametrize("docs, chars", [(400, 60_000), (15, 60_000), (400, 2_000), (400, 10)])
def test_whole_query_equals_a_plain_version(spark, docs, chars):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = df.where("doc_id % 3 <> 0")
    hashed = train.select("doc_id", "text", "lang", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 40)).alias("h")).collect()
    model = learn(train, F.col("lang"), F.col("text"), F.col("doc_id"), sample_docs=docs, sample_chars=chars)
    assert model == plain_model([tuple(r) for r in hashed], docs, chars)
    some = df.where("doc_id % 3 = 0").orderBy(F.length("text")).limit(25)
    texts = {r.doc_id: r.text for r in some.collect()}
    for r in identify(some, model).collect():
        lang, score = plain_winner(model, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9


def test_languages(spark):
    r = random.Random(2)
    parts = {"aa": ["the", "ing", "th", "er"], "bb": ["ción", "que", "ñ", "as"], "cc": ["sch", "ung", "ei", "er"]}
    rows = []
    for i in range(300):
        lang = sorted(parts)[i % 3]
        rows.append((i, " ".join("".join(r.choices(parts[lang], k=r.randrange(1, 5))) for _ in range(40)), lang if i % 7 else None, "x"))
    rows += [(900, None, "aa", "x"), (901, "12 %% 3", "aa", "x"), (902, "", "bb", "x"), (None, "thing thing", None, "x"), (5, "ciónque", None, "x"), (5, "ciónque", None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    model = learn(df.where("doc_id % 4 <> 2"), F.col("lang"), F.col("text"), F.col("doc_id"), sample_chars=1500)
    assert sorted(model) == ["aa", "bb", "cc"] and all(len(m) <= 1530 for m in model.values())
    got = identify(df, model).collect()
    assert len(got) == len(rows)
    und = {x.doc_id for x in got if x.lang_pred == "und"}
    assert und == {900, 901, 902} and all(0 <= x.score <= 1 for x in got)
    assert sum(x.lang_pred == sorted(parts)[x.doc_id % 3] for x in got if x.doc_id is not None and x.doc_id < 300 and x.doc_id % 4 == 2) >= 74
    assert [x.lang_pred for x in got if x.doc_id == 5][-2:] == ["bb", "bb"]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert learn(df, F.col("lang"), F.col("text"), F.col("doc_id")) == {} and identify(df, {}).count() == 0
