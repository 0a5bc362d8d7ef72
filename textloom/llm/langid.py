"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Runs of letters and of signs of numbers; ``running`` takes the latter out.
_WORDS = re.compile(r"[^\W\d_]+")
#: Turns that a hash deals rows to.
_TURNS = 1 << 40


class SuffixAutomaton:
    """Every substring of a text as a path of transitions from the first state.

    Texts are read as UTF-8 bytes, so the alphabet is small in every script. Transitions lie in one list with a row for
    each state: the number of a state is the place of its row, 0 is the first state and, as a target, no transition.
    """

    def __init__(self, text: str) -> None:
        data = text.encode()
        letters = sorted(set(data))
        self.codes = bytes(letters.index(c) + 1 if c in letters else 0 for c in range(256))
        following: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in data.translate(self.codes):
            now = len(length)
            following.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in following[p]:
                following[p][c] = now
                p = link[p]
            if p >= 0:
                q = following[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    clone = len(length)
                    following.append(dict(following[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and following[p].get(c) == q:
                        following[p][c] = clone
                        p = link[p]
                    link[q] = link[now] = clone
            last = now
        width = len(letters) + 1
        self.next = [0] * (width * len(following))
        for state, to in enumerate(following):
            for c, q in to.items():
                self.next[state * width + c] = q * width

    def phrases(self, text: bytes) -> int:
        """Longest matches it takes to cover the text; a byte never seen is a phrase of its own."""
        n, here, states = 0, 0, self.next
        for c in text.translate(self.codes):
            to = states[here + c]
            if to:
                here = to
            elif here:
                n += 1
                here = states[c]
                n += not here
            else:
                n += 1
        return n + (here > 0)


class CrossParser:
    """Phrase counts of whole texts under each language's automaton. Phrases run over the bounds of words."""

    def __init__(self, model: dict[str, str]) -> None:
        self.langs = sorted(model)
        self.automata = [SuffixAutomaton(model[x]) for x in self.langs]
        self.bits = np.array([math.log2(max(2, len(model[x]))) for x in self.langs])

    def predict(self, text: str | None) -> tuple[str, float]:
        read = running(text).encode()
        if not read or not self.langs:
            return "und", 0.0
        cost = np.array([a.phrases(read) for a in self.automata]) * self.bits / len(read)
        best = int(cost.argmin())
        rest = np.delete(cost, best)
        other = float(rest.min()) if len(rest) else 2 * float(cost[best])
        return self.langs[best], other / (float(cost[best]) + other)


def running(text: str | None) -> str:
    """The letters of a text in lower case, with one space around each run of them; empty if there is no letter.

    A letter is what ``str.isalpha`` says: signs of numbers such as ½ or Ⅷ are none.
    """
    words = _WORDS.findall(text.lower()) if text else []
    if not all(map(str.isalpha, words)):
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return f" {' '.join(words)} " if words else ""


def learn(docs: DataFrame, lang: Column, text: Column, order: Column, sample_docs: int = 400, sample_chars: int = 20_000) -> dict[str, str]:
    """The running text of each language's automaton: whole labelled documents, one after the other.

    Each language's rows are taken in an order given by a hash of ``order``, those longer than an eighth of
    ``sample_chars`` after all others, as long as there are no more than ``sample_docs`` of them and their lengths sum up
    to no more than ``sample_chars``; the first is taken whatever its length. Each row taken is read whole. The bounds
    hold however large the table is; they bound the automata that each Python worker holds. Rows far down that order are
    left out before sorting, so that about three times ``sample_docs`` rows of a language meet.
    """
    own = F.struct((F.char_length(text) > sample_chars // 8).alias("long"), F.pmod(F.xxhash64(order, F.lit(3)), F.lit(_TURNS)).alias("h"))
    marked = docs.where(lang.isNotNull() & text.rlike(r"\p{L}")).select(lang.alias("lang"), text.alias("t"), own.alias("o"))
    share = marked.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(3.0 * sample_docs) / F.greatest(F.count_if(~F.col("o.long")), F.lit(1))).alias("share"))
    limits = F.broadcast(share)
    few = marked.join(limits, "lang").where(F.col("o.h") < F.col("share") * _TURNS)
    ahead = Window.partitionBy("lang").orderBy("o", "t")
    first = few.withColumn("k", F.row_number().over(ahead)).where(F.col("k") <= sample_docs)
    taken = first.withColumn("chars", F.sum(F.char_length("t")).over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    model: dict[str, list[tuple[int, str]]] = {}
    for r in taken.where((F.col("chars") <= sample_chars) | (F.col("k") == 1)).select("lang", "k", "t").collect():
        model.setdefault(r["lang"], []).append((r["k"], r["t"]))
    read = {k: "".join(running(t) for _, t in sorted(v)).replace("  ", " ") for k, v in model.items()}
    return {k: v for k, v in read.items() if v}


_parsers: dict[int, CrossParser] = {}


def _parser(model: dict[str, str]) -> CrossParser:
    key = hash(tuple(sorted(model.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(model)
    return _parsers[key]


def identify(docs: DataFrame, model: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row, from its whole text.

    The language whose automaton covers the text's letters with the fewest phrases, each weighed by the bits that name a
    place in that automaton's text, wins; equal costs go to the language first in the alphabet. ``score`` is the
    runner-up's cost over both costs. A null text, a text without a letter and an empty model give ``und`` and 0.
    Repeated rows and null ids each give a row; other columns are ignored.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = dict(kept.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(model)
        for batch in batches:
            found = [parser.predict(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return kept.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
