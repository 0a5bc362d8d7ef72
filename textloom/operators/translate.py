"""Translate-and-verify: masking, gates, arbitration, retries, summaries."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from textloom.functions import text as T

#: Numbers, formula spans and the placeholders that stand for them.
NUMBER = r"\d[\d,]*(?:\.\d+)?%?"
FORMULA = r"(\$\$.*?\$\$|\$(?![\d\s])[^$\n]+?(?<!\s)\$|\\\[.*?\\\]|\\\(.*?\\\))"
PLACEHOLDER = r"⟦(?:N|EQ)\d+⟧"
#: The mark between question and solution, the languages a translation may be in, seconds between retries.
SEPARATOR = "⟦SEP⟧"
TARGET_LANGS = ("hye_Armn", "hyw_Armn")
WAITS = (0, 0, 0, 0, 15, 30, 60, 90, 120, 120, 120, 120)

_FORMULA, _NUMBER, _PLACEHOLDER = re.compile(FORMULA, re.DOTALL), re.compile(NUMBER), re.compile(f"({PLACEHOLDER})")
MASKED = StructType().add("masked", StringType()).add("mapping", ArrayType(StructType().add("tok", StringType()).add("val", StringType())))


def mask_text(text: str) -> tuple[str, list[dict[str, str]]]:
    """Formulas, then numbers outside placeholders, are replaced by numbered placeholders that share one counter."""
    mapping: list[dict[str, str]] = []

    def placeholder(kind: str) -> Callable[[re.Match], str]:
        def put(m: re.Match) -> str:
            mapping.append({"tok": f"⟦{kind}{len(mapping) + 1}⟧", "val": m[0]})
            return mapping[-1]["tok"]

        return put

    pieces = _PLACEHOLDER.split(_FORMULA.sub(placeholder("EQ"), text))  # odd places are placeholders
    return "".join(p if k % 2 else _NUMBER.sub(placeholder("N"), p) for k, p in enumerate(pieces)), mapping


@F.pandas_udf(MASKED)
def _mask(texts: pd.Series) -> pd.DataFrame:
    found = [mask_text(t) if t is not None else (None, None) for t in texts]
    return pd.DataFrame({"masked": [m for m, _ in found], "mapping": [p for _, p in found]})


def mask(text: Column) -> Column:
    """struct<masked, mapping>, mapping in order of replacement. Look-around in the formula pattern asks for Python."""
    return _mask(text)


def mask_numbers(text: Column) -> Column:
    """The masked text where there are no formulas, as built-in expressions: texts between numbers joined by placeholders."""
    parts = F.split(text, NUMBER, -1)
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda p, i: F.concat(F.lit("⟦N"), (i + 1).cast("string"), F.lit("⟧"), p))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def unmask(text: Column, mapping: Column) -> Column:
    return F.aggregate(mapping, text, lambda t, m: F.replace(t, m["tok"], m["val"]))


def stray_numbers(masked: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(masked, PLACEHOLDER, ""), F.lit(f"({NUMBER})"), F.lit(1))


def integrity(masked: Column, mapping: Column) -> Column:
    """'ok', or what is wrong: the first placeholder not found exactly once, else up to three stray numbers."""
    times = lambda tok: (F.char_length(masked) - F.char_length(F.replace(masked, tok, F.lit("")))) / F.char_length(tok)
    wrong = F.filter(mapping, lambda m: times(m["tok"]) != 1)
    stray = stray_numbers(masked)
    return (
        F.when(F.size(wrong) > 0, F.concat(F.lit("placeholder "), F.try_element_at(wrong, F.lit(1))["tok"], F.lit(" count != 1")))
        .when(F.size(stray) > 0, F.concat(F.lit("stray digits introduced: "), F.array_join(F.slice(stray, 1, 3), ",")))
        .otherwise("ok")
    )


def language_ok(label: Column, prob: Column, langs: Sequence[str] = TARGET_LANGS, least: float = 0.6) -> Column:
    return label.isin(*langs) & (prob >= least)


def language_view(text: Column, n: int = 800) -> Column:
    """What the language gate looks at: placeholders out, white space collapsed, the first n characters."""
    return T.snippet(F.regexp_replace(text, PLACEHOLDER, " "), n)


def item_text(question: Column, cot: Column, gold: Column) -> Column:
    return F.concat(question, F.lit(f"\n{SEPARATOR}\n"), F.coalesce(F.nullif(cot, F.lit("")), gold.cast("string")))


def two_parts(output: Column) -> Column:
    """array of question and solution; null unless the separator stands exactly once."""
    parts = F.split(output, SEPARATOR, -1)
    return F.when(F.size(parts) == 2, F.transform(parts, T.strip))


def arbitrate(pred: Column, want: Column, source_pred: Column) -> Column:
    """PASS if the translated item is solved as wanted; if not, a solver that also fails on the source is to blame."""
    return F.when(pred.eqNullSafe(want), "PASS").when(~source_pred.eqNullSafe(want), "PASS_solver_limited").otherwise("G2_mismatch")


def panel(votes: DataFrame, id_col: str = "id", vote_col: str = "vote", need: int = 2) -> DataFrame:
    """id, votes, stage: an item passes with ``need`` votes that start with yes; a missing vote is none."""
    yes = F.upper(T.strip(F.coalesce(F.col(vote_col), F.lit("")))).startswith("YES")
    return votes.groupBy(id_col).agg(F.count_if(yes).alias("votes")).withColumn("stage", F.when(F.col("votes") >= need, "PASS").otherwise("G2_panel_reject"))


def stage_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("stage").agg(F.count("*").alias("items"))


def audit_summary(scores: DataFrame) -> DataFrame:
    """stage, n, mean, share of scores from 4 up, and counts of each score; rows without a score do not count."""
    s = F.col("score")
    each = [F.count_if(s == k).alias(f"score_{k}") for k in range(1, 6)]
    return scores.where(s.isNotNull()).groupBy("stage").agg(
        F.count("*").alias("n"), F.round(F.avg(s.cast("double")), 2).alias("mean"), F.round(F.count_if(s >= 4) / F.count("*"), 3).alias("adequate_ge4"), *each
    )


def retrying(call: Callable[[str], str], waits: Sequence[float] = WAITS, retry_on: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), give_up: str | None = None) -> Callable[[str], str]:
    """call with waits between tries. Only errors in ``retry_on`` are tried again; ``give_up`` is returned at the end, if given."""

    def run(prompt: str) -> str:
        for k, wait in enumerate(waits):
            try:
                return call(prompt)
            except retry_on:
                if k + 1 == len(waits):
                    if give_up is not None:
                        return give_up
                    raise
                time.sleep(wait)
        return give_up or ""

    return run


def rotating(calls: Sequence[Callable[[str], str]], waits: Sequence[float] = WAITS, retry_on: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), give_up: str | None = None) -> Callable[[str], str]:
    """One call over several keys: each prompt starts with the next of ``calls``, and each retry goes on to the one after it.

    As many first waits as there are zeros in ``waits`` are tried without pause, so every key has had a turn before any wait.
    """
    turn = count()

    def run(prompt: str) -> str:
        tries = count(next(turn))
        return retrying(lambda p: calls[next(tries) % len(calls)](p), waits, retry_on, give_up)(prompt)

    return run


def translate(items: DataFrame, translators: Sequence[Callable[[str, str], str]], check: Callable[[dict, str], tuple[str, str]]) -> DataFrame:
    """id, stage, output, attempts: each item goes through the translators in turn until a check says PASS.

    translators take the masked text and the feedback of the last failure; ``check`` takes the item and the output and
    returns (stage, feedback). The last failure's stage is the reason of a rejection. Calls run in the tasks' workers.
    """
    schema = "id string, stage string, output string, attempts int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                stage, feedback, text, tries = "T", "", None, 0
                for tries, call in enumerate(translators, 1):
                    try:
                        text = call(row["masked"], feedback)
                    except Exception as e:  # a failed call is a stage, as any other failure
                        stage, text = f"ERR_{type(e).__name__}", None
                        continue
                    stage, feedback = check(row, text)
                    if stage.startswith("PASS"):
                        break
                out.append((row["id"], stage, text if stage.startswith("PASS") else None, tries))
            yield pd.DataFrame(out, columns=["id", "stage", "output", "attempts"])

    return items.mapInPandas(run, schema)


def accepted(results: DataFrame) -> DataFrame:
    return results.where(F.col("stage").startswith("PASS"))


def rejected(results: DataFrame) -> DataFrame:
    return results.where(~F.col("stage").startswith("PASS"))


def judge(items: DataFrame, call: Callable[[str], str], prompt_col: str = "prompt", id_col: str = "id") -> DataFrame:
    """id, score: the last of the digits 1 to 5 in the judge's answer; null if there is none. Calls run in the workers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"id": pdf[id_col].astype(str), "answer": [call(p) for p in pdf[prompt_col]]})

    said = items.select(id_col, prompt_col).mapInPandas(run, "id string, answer string")
    return said.select("id", T.last_score(F.col("answer")).alias("score"))
