import hashlib
import random
import re

from textloom.llm.decontaminate import contamination
from textloom.llm.queries import contamination_digests

SCHEMA = "doc_id long, text string, item string, n_words string, w string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, size=10):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        for win in [v[k : k + size] for k in range(max(1, len(v) - size + 1))] if v else []:
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def cases(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "Straße", "A1", "東京"]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, say(r.randrange(10, 25))) for i in range(12)] + [(20, say(3)), (21, say(1)), (22, say(7)), (23, []), (9, say(12))]
    items.append((30, items[0][1] + items[1][1]))
    docs = []
    for i in range(60):
        t = say(r.randrange(0, 60))
        for _ in range(r.randrange(0, 3)):
            v = r.choice(items)[1]
            a = r.randrange(0, max(1, len(v) - 9))
            t += v[a : a + r.randrange(8, 14)] + say(r.randrange(0, 4))
        docs.append((i, r.choice([" ", ", ", "\n"]).join(x.upper() if r.random() < 0.2 and x.isascii() else x for x in t)))
    docs += [(100, None), (101, ""), (None, " ".join(items[2][1])), (5, docs[5][1]), (5, " ".join(items[3][1]) * 2), (102, "... !!")]
    return docs, [(i, " ".join(v)) for i, v in items] + [(40, None), (41, "?!")]


def check(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "a", "b", "c") for x in docs], SCHEMA)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in contamination_digests(contamination(d, b, **kw)).collect())
    assert got == sorted((i is None, i or 0, *brute(t, items)) for i, t in docs)


def test_equal_to_brute_force(spark):
    check(spark, *cases(1))
    check(spark, *cases(2), broadcast_windows=0)


def test_empty_tables(spark):
    docs, items = cases(3)
    check(spark, docs[:5], [])
    check(spark, [], items)


def test_long_text_and_hot_passage(spark):
    r = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(30))
    docs = [(i, passage) for i in range(300)] + [(500, " ".join(f"w{r.randrange(50)}" for _ in range(30000)) + " " + passage)]
    check(spark, docs, [(1, passage)])


def test_a_passage_of_many_items_and_of_many_documents(spark):
    """Both join paths; the passage's windows are looked for once, whatever the number of items that hold them."""
    passage = " ".join(f"p{k}" for k in range(14))
    docs = [(i, f"x{i} {passage} y{i}") for i in range(120)] + [(900, "p0 p1 p2"), (901, f"{passage} {passage}")]
    items = [(i, passage if i % 2 else f"{passage} z{i}") for i in range(400)] + [(999, "p1 p2 p3")]
    check(spark, docs, items)
    check(spark, docs, items, broadcast_windows=0)


def test_real_table_equals_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    check(spark, [tuple(r) for r in d.select("doc_id", "text").collect()][:60], items, broadcast_windows=0)
