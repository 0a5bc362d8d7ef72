import pytest
from pyspark.sql import functions as F
from textloom.functions import text as T


def one(spark, column, *values):
    df = spark.createDataFrame([(*values,)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "f,values,want",
    [
        (T.release_view, ("é a  \nb\t\n\n\n\nc ",), "é a\nb\n\nc"),
        (T.signature_view, ("Երևան 2026։ Ի՞նչ կա",), "երեւան 0000 ինչ կա"),
        (T.signature_view, ("ԱԲԳ   աբգ",), "աբգ աբգ"),
        (lambda c: T.signature_view(c, True), ("ﬁne ①２",), "fine 10".replace("10", "00")),
        (T.month_of, ("2025-06-01",), "2025-06"),
        (T.month_of, ("1900-01-01",), "unknown"),
        (T.month_of, ("2025",), "unknown"),
        (T.month_of, (None,), "unknown"),
        (T.source_or_unknown, ("",), "unknown"),
        (T.final_number, ("so 1,234.50% or −7.",), "7"),
        (T.final_number, ("none",), None),
        (T.final_token, ("a\n b \n\n",), "b"),
        (T.choice_letter, ("Answer: (c)",), "C"),
        (T.choice_letter, ("Answer:",), None),
        (T.final_answer, ("the answer is (B)", None), "B"),
        (T.final_answer, ("the answer is (B)", "maybe"), None),
        (T.final_answer, ("\\boxed{D}", ""), "D"),
        (T.final_answer, ("x", "(A)"), "A"),
        (T.post_think, ("a</think> b </think>",), "b </think>"),
        (T.post_think, ("x" * 600,), "x" * 500),
        (T.csv_safe, ('a"b\nc',), "a'b c"),
        (T.last_score, ("7 out of 4 or 9",), 4),
        (T.blank_to_null, (" \t",), None),
        (T.strip, ("  x \x1c\n",), "x"),
    ],
)
def test_functions(spark, f, values, want):
    assert one(spark, f, *values) == want


@pytest.mark.parametrize(
    "title,body,ok", [("T", "b" * 200, True), (None, "b" * 200, False), ("T", None, False), ("  ", "b" * 200, False), ("T", "short", False)]
)
def test_clean_document(spark, title, body, ok):
    got = one(spark, lambda a, b: T.clean_document(a, b), title, body)
    assert got == (f"T\n{body}" if ok else None)


def test_ngrams(spark):
    g = lambda t, n, short: one(spark, lambda c: T.ngrams(T.words(c), n, short), t)
    assert g("a b c a b", 2, False) == ["a b", "b c", "c a"]
    assert g("a b", 3, False) == [] and g("a b", 3, True) == ["a b"] and g("", 5, True) == [""]
    assert one(spark, lambda c: T.char_ngrams(c, 2), "abab") == ["ab", "ba"] and one(spark, lambda c: T.char_ngrams(c, 9), "ab") == ["ab"]


def test_iso(spark):
    df = spark.sql("SELECT timestamp_ntz'2025-01-02 03:04:05' AS a, timestamp_ntz'2025-01-02 03:04:05.000120' AS b")
    r = df.select(T.iso(F.col("a")).alias("a"), T.iso(F.col("b")).alias("b")).first()
    assert (r.a, r.b) == ("2025-01-02T03:04:05", "2025-01-02T03:04:05.000120")


def test_choice_letters_are_single_capitals(spark):
    """One letter whatever its capital form: as SQL's upper, for all letters that have one of several letters and some others."""
    import duckdb

    letters = T.WIDE + "aéßöւᾳⅷ"
    df = spark.createDataFrame([(c,) for c in letters], "c string")
    got = {r.c: r.u for r in df.select("c", T.choice_letter(F.concat(F.lit("Answer: ("), "c", F.lit("x)"))).alias("u")).collect()}
    want = {c: duckdb.execute("SELECT upper(?)", [c]).fetchone()[0] for c in letters}
    assert got == want and got["ß"] == "ẞ" and all(len(u) == 1 for u in got.values())
