"""Quality rules in DataFrame functions alone: plain counts, and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import written
from textloom.plans.skew import hot_cells, skew_join

#: What parts words: white space of ASCII; and what a word is made of.
GAP, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """Splitting at gaps takes a quarter of the time of extracting words."""
    return F.array_remove(F.split(text, GAP), "")


def counted(docs: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the plain counts and ``grams`` of every row: the buckets of its words and pairs of neighbours. One pass over the texts.

    Repeated 3-word windows are found in time n log n: windows' hashes are sorted with their places, so equal windows are
    neighbours, and the places, sorted again, give the words. Texts without equal windows are not sorted. Words and windows
    are told apart by 64-bit hashes, however long a text is. Null and empty texts count as nothing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    first = rows.select(
        "doc_id",
        words_of(text).alias("words"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    plain = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines")
    hashed = first.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    n = F.size("h")
    ahead = lambda c, k: F.slice(c, F.lit(1 + k), F.greatest(n - 2 if k == 2 else n - 1, F.lit(0)))
    two = hashed.select(*plain, "h", F.zip_with(ahead("h", 0), ahead("h", 1), lambda x, y: F.xxhash64(x, y)).alias("p"))
    three = F.zip_with(F.slice("p", F.lit(1), F.greatest(n - 2, F.lit(0))), ahead("h", 2), lambda x, y: F.xxhash64(x, y))
    found = two.select(*plain, F.transform(F.concat("h", "p"), lambda x: F.pmod(x, F.lit(buckets)).cast("int")).alias("grams"), three.alias("windows"))
    places = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = found.select(*plain, "grams", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), places).alias("sorted"))
    same = lambda a, b: F.coalesce(F.get("sorted", a)["h"] == F.get("sorted", b)["h"], F.lit(False))
    twice = F.filter("sorted", lambda x, k: same(k, k - 1) | same(k, k + 1))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"), (p + 3).cast("long").alias("end"))
    words = F.aggregate(F.sort_array(F.transform(twice, lambda x: x["i"].cast("long"))), zero, step)["n"]
    return sorted_.select(*plain, F.coalesce(words, F.lit(0)).cast("long").alias("n_repeat_words"), "grams")


def marked_rows(held: DataFrame, ids: DataFrame) -> DataFrame:
    """``block`` and ``mask`` for the rows of held whose doc_id is in ids: bit ``row % 64`` of the mask of block ``row / 64``.

    Ids alone are shuffled, those of many rows over salts; a document takes a bit, so marking texts moves none of them.
    """
    key = held.select("doc_id").union(ids).schema["doc_id"].dataType  # both sides are hashed, so their types must be one
    rows = held.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast(key).alias("doc_id"), "row")
    few = ids.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast(key).alias("doc_id")).distinct()
    found = skew_join(rows, few, "doc_id", hot_cells(rows, "doc_id"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("row").bitwiseAND(63).cast("int"))
    return found.groupBy(F.shiftright("row", 6).alias("block")).agg(F.bit_or(bit).alias("mask"))


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 1 << 16,
    threshold: float = -0.1,
    prior: float = 5.0,
    min_words: int = 50,
    broadcast_blocks: int = 1 << 20,
) -> DataFrame:
    """Base counts, ``llr`` and ``kept`` for every row of docs.

    Two multinomials over hashed words and word pairs: one of the documents whose id is in ``trusted`` (id column
    ``id_col``), one of all documents. The raw counts are scaled to the target's total and ``prior`` counts are added to
    every bucket of both, so a bucket that the target is too small to judge weighs about 0 and weights do not drift as
    the corpus outgrows the target. A document's ``llr`` is the mean of log(target / raw) over its words and pairs; it is
    kept if that is at least ``threshold`` and it has not failed a base rule (fewer than ``min_words`` words, or more
    than half of them in repeated 3-word windows). No random choice.

    Texts are read once; what is stored for the two passes over grams is a small number for each word and pair.
    The target is learnt from every document with a trusted id, the raw counts from every document; nothing is sampled.
    Which rows are trusted is broadcast as a bit a row, up to ``broadcast_blocks`` blocks of 64 rows, counted first; beyond,
    what is stored is shuffled by block. The table of weights has ``buckets`` rows (16 bytes each), so it is broadcast
    whatever the corpus.
    A row for each input row; null ids and repeated rows included. A null or empty text has no words, llr 0 and fails.
    With no trusted document all weights are 0. Empty tables give an empty result; other columns are ignored.
    """
    held = written(counted(docs, buckets, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "rules-grams")
    masks = written(marked_rows(held, trusted.select(F.col(id_col).alias("doc_id"))), "rules-trusted")
    placed = F.broadcast if masks.count() <= broadcast_blocks else (lambda df: df.hint("merge"))
    own = F.when(F.getbit("mask", F.col("row").bitwiseAND(63).cast("int")) == 1, 1)
    blocks = held.select(F.shiftright("row", 6).alias("block"), "row", "grams")
    marked = blocks.join(placed(masks), "block", "left").select(own.alias("own"), F.explode("grams").alias("bucket"))
    counts = written(marked.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("own").alias("target")), "rules-counts")
    raw, target = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    weight = F.log((F.col("target") + prior) / (F.col("raw") * (target / max(1, raw)) + prior)) if target else F.lit(0.0)
    weights = counts.select("bucket", weight.alias("weight"))
    scores = held.select("row", F.explode("grams").alias("bucket")).join(F.broadcast(weights), "bucket").groupBy("row").agg(F.avg("weight").alias("llr"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = held.drop("grams").join(scores, "row", "left").drop("row")
    return found.withColumns({"llr": F.round(F.coalesce("llr", F.lit(0.0)), 9), "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
