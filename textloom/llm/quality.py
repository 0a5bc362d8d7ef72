"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("words", "word_length", "spread", "distinct", "neighbours", "symbols", "capitals", "stops", "marks", "digits", "lines", "short", "pairs")
_SYMBOLS = re.compile(r"[#*$%&|<>{}\\^~=_@/\[\]]")
_MARKS = re.compile(r"[!?]")
_DIGITS = re.compile(r"[0-9]")


#: Words of an average text that every text is thought to hold besides its own, so that short texts do not stand out.
PRIOR_WORDS = 20.0


def _share(part: float, whole: float) -> float:
    """A share on a scale that spreads its low end: log of parts in a thousand."""
    return math.log1p(1000.0 * part / (whole + PRIOR_WORDS))


def statistics(text: str | None) -> list[float]:
    """The values named in FEATURES, of the whole text; null is like an empty text."""
    t = text or ""
    words = t.split()
    n = len(words)
    chars = sum(map(len, words))
    mean = (chars + 6.0 * PRIOR_WORDS) / (n + PRIOR_WORDS)
    upper = 0 if t.upper() == t.lower() else sum(1 for x in words if x.isupper() and len(x) > 1)
    ends = t.count(". ") + t.count(".\n") + t.endswith(".")
    return [
        math.log1p(n),
        math.log(mean),
        math.log(max(map(len, words), default=1) / mean),
        math.log((len(set(words)) + PRIOR_WORDS) / (n + PRIOR_WORDS)) / math.log(n + PRIOR_WORDS),
        _share(sum(map(eq, words, words[1:])), n),
        _share(len(_SYMBOLS.findall(t)), n),
        _share(upper, n),
        _share(ends + 0.1 * PRIOR_WORDS, n),
        _share(len(_MARKS.findall(t)), n),
        _share(len(_DIGITS.findall(t)), n),
        _share(t.count("\n"), n),
        _share(sum(1 for x in words if len(x) < 4) + 0.4 * PRIOR_WORDS, n),
        math.log((len(set(zip(words, words[1:]))) + PRIOR_WORDS) / (max(0, n - 1) + PRIOR_WORDS)),
    ]


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log densities' constants of class 0 and class 1."""

    means: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    constants: tuple[float, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of class 1, from the difference of the Mahalanobis log densities."""
        if not len(x):
            return np.zeros(0)
        density = [c - 0.5 * np.square((x - m) @ w.T).sum(axis=1) for m, w, c in zip(self.means, self.whiten, self.constants, strict=True)]
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.1, pool: float = 0.3) -> Model | None:
    """None if a class has no row. Each class's covariance is drawn to the pooled one, then to its own mean variance."""
    parts = [x[y == k] for k in (0, 1)]
    if not all(map(len, parts)):
        return None
    d = x.shape[1]
    means = tuple(p.mean(axis=0) for p in parts)
    own = [(p - m).T @ (p - m) / len(p) for p, m in zip(parts, means, strict=True)]
    pooled = sum(len(p) * c for p, c in zip(parts, own, strict=True)) / len(x)
    whiten, constants = [], []
    for p, c in zip(parts, own, strict=True):
        s = (1 - pool) * c + pool * pooled
        s = (1 - shrink) * s + shrink * (np.diag(np.diag(s)) + np.eye(d) * max(1e-6, np.trace(s) / d * 0.1))
        low = np.linalg.cholesky(s)
        whiten.append(np.linalg.inv(low))
        constants.append(math.log(len(p) / len(x)) - float(np.log(np.diag(low)).sum()))
    return Model(means, tuple(whiten), tuple(constants))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> Model | None:
    """Fits on at most about ``sample`` labelled ids, chosen by hash. Ids labelled both ways count as the lower label."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    marks = marks.groupBy("doc_id").agg(F.min("y").alias("y"))
    share = min(1.0, sample / max(1, marks.count()))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    got = rows.mapInArrow(run, "y int, x array<double>").toPandas()
    return fit(np.array(got["x"].tolist(), float).reshape(len(got), -1), got["y"].to_numpy()) if len(got) else None


def score_quality(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in ``keep``, and ``score`` of every row of docs, from its whole text alone.

    A null text scores as an empty one. Without a model (no labelled row of one class) every score is 0.5. Null ids and
    repeated rows each give a row; an empty table gives an empty result; columns not named are ignored. A column in
    ``keep`` that has a name of the result raises.
    """
    if clash := {"score", "__text"} & set(keep):
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    kept = docs.select(*([F.col(id_col).alias("doc_id")] if not keep else keep), F.col(text_col).alias("__text"))
    schema = kept.drop("__text").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text")
            if model is None:
                found = np.full(len(texts), 0.5)
            else:
                found = model.score(np.array([statistics(t.as_py()) for t in texts], float).reshape(len(texts), len(FEATURES)))
            rest = batch.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found, pa.float64())], [*rest.schema.names, "score"])

    return kept.mapInArrow(run, schema)
