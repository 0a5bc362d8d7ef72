"""Language labels by a pluggable classifier, and the character-profile classifier used where none is given."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.workspace import written

Classifier = Callable[[list[str]], list[tuple[str, float]]]


def profile(samples: dict[str, list[str]], n: int = 2, keep: int = 400) -> Classifier:
    """A classifier from sample texts: mean log frequency of character n-grams; labels' chances by a softmax."""
    grams = lambda t: [t[i : i + n] for i in range(len(t) - n + 1)]
    logs = {}
    for label, texts in samples.items():
        counts = Counter(g for t in texts for g in grams(t.lower())).most_common(keep)
        total = sum(c for _, c in counts) + keep
        logs[label] = ({g: math.log((c + 1) / total) for g, c in counts}, math.log(1 / total))

    def classify(texts: list[str]) -> list[tuple[str, float]]:
        out = []
        for t in texts:
            own = grams(t.lower())
            score = {k: sum(w.get(g, rest) for g in own) / max(1, len(own)) for k, (w, rest) in logs.items()}
            top = max(score, key=lambda k: (score[k], k))
            out.append((top, 1 / sum(math.exp(5 * (v - score[top])) for v in score.values())))
        return out

    return classify


def label(text: Column, classify: Classifier, chars: int = 1000) -> Column:
    """struct<label, prob> of the head of the text with white space collapsed; texts go to the classifier in batches."""

    @F.pandas_udf("struct<label:string, prob:double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(classify(texts.fillna("").tolist()), columns=["label", "prob"])

    return run(T.snippet(text, chars))


def run_lid(docs: DataFrame, classify: Classifier, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Kept documents with ``lid``, the others with ``lid`` and ``lid_prob``. Labels are stored, so each text is classified once."""
    found = written(docs.withColumn("__l", label(F.col("text"), classify)), "lid")
    kept = found.where(F.col("__l.label").isin(*keep)).withColumn("lid", F.col("__l.label")).drop("__l")
    rest = found.where(~F.col("__l.label").isin(*keep)).withColumns({"lid": F.col("__l.label"), "lid_prob": F.col("__l.prob")}).drop("__l")
    return kept, rest
