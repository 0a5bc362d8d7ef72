"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ascii_lower, written
from textloom.plans.skew import hot_cells, skew_join

#: What parts words: all of ASCII but letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words in lower case. Splitting at gaps takes a quarter of the time of extracting words."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _shingle(words: Column, at: Column, n: int) -> Column:
    """Hash of n words from the 0-based place on."""
    return F.xxhash64(F.lit(n), *[F.get(words, at + k) for k in range(n)])


def _windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item, w: the distinct windows of each item; an item shorter than a window is one."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - window + 1))
    return words.select("item", "all", F.explode(starts).alias("at")).select("item", F.slice("all", F.col("at"), F.lit(window)).alias("w")).distinct()


def _scanned(rows: DataFrame, wanted: DataFrame, sizes: list[int], window: int, small: bool) -> DataFrame:
    """doc_id, text_hash, n_words, at, base, words, h: a row for each document (at = -1), and one for each place of a shingle in ``wanted``.

    A place comes with the words around it, ``base`` being the first one's place in the document. Each text is split once.
    """
    read = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("all"))
    last = F.greatest(F.size("all") - sizes[0], F.lit(-1))
    at = F.col("at")

    def hashed(df: DataFrame, *more: str) -> DataFrame:
        every = F.array(*[_shingle(F.col("all"), at, n) for n in sizes])
        found = every[0] if len(sizes) == 1 else F.explode(F.when(at < 0, F.array(F.lit(0).cast("long"))).otherwise(every))
        return df.withColumn("h", found)

    base = F.greatest(at - (window - 1), F.lit(0))
    n_words = F.size("all").cast("long").alias("n_words")
    around = F.when(at >= 0, F.slice("all", base + 1, F.lit(2 * window)))
    columns = ("doc_id", "text_hash", n_words, "at", base.alias("base"), around.alias("words"), "h")
    if small:
        # Plain expressions and a broadcast: the join runs inside generated code, and no row that carries all words is built.
        spots = hashed(read.select("*", F.explode(F.sequence(F.lit(-1), last)).alias("at")))
        hit = F.broadcast(wanted.select(F.col("h").alias("w"), F.lit(True).alias("hit")))
        return spots.join(hit, (F.col("h") == F.col("w")) & (at >= 0), "left").where((at < 0) | F.col("hit")).select(*columns)
    # Too many shingles to broadcast: places and hashes alone are shuffled, then found places join their documents.
    spots = hashed(read.where(last >= 0).select("*", F.explode(F.sequence(F.lit(0), last)).alias("at"))).select("doc_id", "text_hash", "at", "h")
    found = skew_join(spots, wanted, "h", hot_cells(spots, "h"))
    places = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "h")).alias("places"))
    places = places.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "places")
    joined = read.join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    none = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).cast("long").alias("h")))
    each = joined.select("doc_id", "text_hash", "all", F.explode(F.concat(none, F.coalesce("places", F.array().cast("array<struct<at:int,h:bigint>>")))).alias("p"))
    return each.select("doc_id", "text_hash", "all", "p.at", "p.h").select(*columns)


def found_windows(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    shingle: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_windows: int = 200_000,
) -> DataFrame:
    """d, t, n_hit, items of the documents that hold a window: id, xxhash64 of the text, words hit, sorted ids as text."""
    return _found(docs, items, window, shingle, id_col, text_col, item_col, item_text_col, broadcast_windows)[1]


def _found(
    docs: DataFrame, items: DataFrame, window: int, shingle: int, id_col: str, text_col: str, item_col: str, item_text_col: str, broadcast_windows: int
) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash, n_words of every row of docs; and what ``found_windows`` returns.

    A window is a set of word shingles. A document holds the window only if it holds every one of them, so one shingle
    is the necessary prefix: the rarest, by its count over all documents, ties by hash and place. Documents are scanned
    once for the shingles of all windows; the places found give the counts, and those of prefix shingles the candidates. A
    candidate's place in the document gives the only place where the window can stand (positional bound), windows that
    would stick out are dropped (length bound), and the words there are compared. Words inside any occurrence count once.

    Windows are distinct: those that many items share are looked for once, and their items are joined to what was found.
    The shingles are broadcast up to ``broadcast_windows`` distinct windows (about 200 bytes each), counted first; beyond,
    they are joined by a shuffle that deals hot shingles over salts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    named = _windows(items, item_col, item_text_col, window).withColumn("w_id", F.sha2(F.array_join("w", " "), 256))
    windows = named.groupBy("w_id").agg(F.min("w").alias("w")).withColumn("g", F.least(F.size("w"), F.lit(shingle)))
    sized = F.lit(None).cast("long")
    for n in range(1, shingle + 1):
        sized = F.when(F.col("g") == n, _shingle(F.col("w"), F.col("off"), n)).otherwise(sized)
    tokens = written(windows.select("w_id", "w", "g", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("g"))).alias("off")).withColumn("h", sized), "decon-tokens")
    sizes = sorted(r["g"] for r in tokens.select("g").distinct().collect()) or [shingle]  # at most ``shingle`` numbers
    small = tokens.count() <= broadcast_windows * shingle
    placed = F.broadcast if small else (lambda df: df)

    scan = written(_scanned(rows, tokens.select("h").distinct(), sizes, window, small), "decon-places")
    spots = scan.where("at >= 0")
    counts = spots.groupBy("h").agg(F.count("*").alias("n"))
    rarest = (
        tokens.join(counts, "h")
        .groupBy("w_id")
        .agg(F.min(F.struct("n", "h", "off")).alias("p"), F.count("*").alias("found"), F.first("g").alias("g"), F.first("w").alias("w"))
        .where(F.col("found") == F.size("w") - F.col("g") + 1)  # a window with a shingle in no document stands nowhere
    )
    index = rarest.select("p.h", "p.off", "w_id", "w")
    start = F.col("at") - F.col("base") - F.col("off")  # among the words around the place
    there = (start >= 0) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("w")) == F.col("w"))
    begin = F.col("base") + start
    near = spots.drop("n_words")
    near = near.join(F.broadcast(index), "h") if small else skew_join(near, index, "h", hot_cells(near, "h"))
    hits = written(near.where(there).select("doc_id", "text_hash", "w_id", begin.alias("s"), (begin + F.size("w")).alias("e")).distinct(), "decon-hits")

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["e"]).alias("end"))
    spans = hits.groupBy("doc_id", "text_hash").agg(F.aggregate(F.sort_array(F.collect_set(F.struct("s", "e"))), zero, step)["n"].alias("n_hit"))
    whole = hits.select("doc_id", "text_hash", "w_id").distinct()
    owners = named.select("w_id", "item")
    of = whole.join(placed(owners), "w_id") if small and owners.count() <= broadcast_windows else skew_join(whole, owners, "w_id", hot_cells(whole, "w_id"))
    ids = of.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    ids = ids.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "items")
    both = spans.join(ids, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")))
    return scan.where("at < 0").select("doc_id", "text_hash", "n_words"), both.select("d", "t", "n_hit", "items")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """How much of each document stands in a benchmark: doc_id, text_hash, n_words, n_hit, items (sorted ids as text).

    ``options`` are those of ``found_windows``. One row for each input row. Null and empty texts have no words and no
    hits; null or repeated ids are rows like any other; items without words have no window; a null item id reads as an
    empty one; repeated items count once. Empty tables give an empty result or no hits. Other columns are ignored.
    """
    names = dict(window=10, shingle=5, item_col="item_id", item_text_col="text", broadcast_windows=200_000)
    counted, spans = _found(docs, items, id_col=id_col, text_col=text_col, **(names | options))
    return counted.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left").select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
