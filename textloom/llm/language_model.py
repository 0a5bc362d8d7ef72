"""Language-model scores from a weighted backoff automaton over words, pairs and triples of words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import written
from textloom.llm.hashing import mix, text_chunks, word_hashes

_END, _START, _PAIR, _TRIPLE = (mix(np.array([k], np.uint64))[0] for k in ((1 << 60) + j for j in range(4)))
#: Prior masses of the states of one word and of two.
MASSES = (1000.0, 5.0)
#: Kinds of keys: words, pairs, triples.
_KINDS = (0, 1, 2)


def encode(values: np.ndarray) -> bytes:
    """Unsigned integers by planes of bytes, compressed: what is small or repeats takes little room."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def decode(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def encode_sorted(keys: np.ndarray) -> bytes:
    return encode(np.diff(keys, prepend=np.uint64(0)))


def decode_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(decode(blob), dtype=np.uint64)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end after each text, and where each text begins (one entry more)."""
    parts, sizes = [], []
    for _, _, data, offsets in text_chunks(column):
        words, bounds = word_hashes(data, offsets)
        parts.append(np.insert(words, bounds[1:], _END))
        sizes.append(np.diff(bounds) + 1)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def keys_of(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the pair and of the triple of words that end at each place; a text's first token ends no triple (0).

    The pair at the first token is that of the start and the token.
    """
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = _START
    pairs = mix(mix(before ^ _PAIR) + tokens)
    triples = np.zeros_like(pairs)
    triples[1:] = mix(mix(pairs[:-1] ^ _TRIPLE) + tokens[1:])
    triples[bounds[:-1]] = 0
    return pairs, triples


class Automaton:
    """A weighted backoff automaton over the n-grams that a block of texts can meet, with their counts in the whole training corpus.

    States are histories: the root, the start of a text, words and pairs seen in training. A state h has an arc for each
    token w that followed it there, of weight log10 p(w|h), where p(w|h) = (c(hw) + m p(w|h')) / (c(h) + m) is the count
    smoothed by the shorter history h' (a Dirichlet prior of mass m, one for words and one for pairs), and a failure arc to
    h' of weight log10(m / (c(h) + m)), which is what is left for all other tokens. The root has an arc for every token, of
    weight (c + 0.5) / (N + 0.5 (V + 1)), unseen tokens included. So the weights of each state sum to 1. An arc leads to
    the longest history that is a state.

    words: places of each token among the block's distinct ones; pairs and triples: of the n-gram ending there (-1: none).
    counts: of distinct words, pairs and triples. end: the place of the end token, or -1.
    """

    def __init__(self, total: int, kinds: int, texts: int, masses: tuple[float, float], words, pairs, triples, first, counts, end: int) -> None:
        one, two, three = (np.asarray(c, np.float64) for c in counts)
        n = len(one)
        word_state, pair_state = 2 + np.arange(n), 2 + n + np.arange(len(two))
        history = np.concatenate([[0.0, texts], one, two])  # by state: root, start, words, pairs
        # What each distinct n-gram is made of, read off one place where it stands.
        at2, at3 = _somewhere(pairs, len(two)), _somewhere(triples, len(three))
        before = np.where(first[at2], 1, word_state[words[at2 - 1]]) if len(two) else at2
        token2, token3 = words[at2], words[at3]
        p1 = (one + 0.5) / (total + 0.5 * (kinds + 1))
        p2 = (two + masses[0] * p1[token2]) / (history[before] + masses[0])
        p3 = (three + masses[1] * p2[pairs[at3]]) / (two[pairs[at3 - 1]] + masses[1]) if len(three) else three
        goes_on = np.arange(n) != end
        view = lambda x: memoryview(np.ascontiguousarray(x))
        #: Weight and target of each arc, by the length of the history it leaves.
        self.weight = [view(np.log10(p)) for p in (p1, p2, p3)]
        self.to = [view(np.where((one > 0) & goes_on, word_state, 0)), view(np.where(goes_on[token2], pair_state, 0)), view(np.where(goes_on[token3], pair_state[pairs[at3]] if len(three) else 0, 0))]
        #: Weight and target of each state's failure arc; a state with a count alone is ever entered.
        with np.errstate(divide="ignore"):
            mass = np.concatenate([[1.0], np.full(1 + n, masses[0]), np.full(len(two), masses[1])])
            self.fail = view(np.log10(mass / (history + mass)))
        self.back = view(np.concatenate([[0], np.zeros(1 + n, np.int64), word_state[token2]]))
        self.first_pair = 2 + n
        #: Arcs that may be taken at each place, by the length of the history; -1 where training has none.
        self.arcs = [words, np.where((pairs >= 0) & (two[pairs] > 0), pairs, -1), np.where((triples >= 0) & (three[triples] > 0), triples, -1) if len(three) else triples]
        self.start = 1 if texts else 0
        self.root_weight = np.log10(p1)

    def walk(self, begin: int, end: int) -> float:
        """log10 probability of the tokens from begin to end, a text, in one pass from left to right."""
        (w1, w2, w3), (to1, to2, to3), fail, back, pairs = self.weight, self.to, self.fail, self.back, self.first_pair
        state, total = self.start, 0.0
        for one, two, three in zip(*(a[begin:end].tolist() for a in self.arcs), strict=True):
            if state >= pairs:
                if three >= 0:
                    total += w3[three]
                    state = to3[three]
                    continue
                total += fail[state]
                state = back[state]
            if state:
                if two >= 0:
                    total += w2[two]
                    state = to2[two]
                    continue
                total += fail[state]
            total += w1[one]
            state = to1[one]
        return total


def _somewhere(places: np.ndarray, n: int) -> np.ndarray:
    """A position at which each of the n n-grams stands."""
    at = np.zeros(n, np.int64)
    there = np.flatnonzero(places >= 0)
    at[places[there]] = there
    return at


def _distinct(keys: np.ndarray, there: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and each position's place among them; -1 where ``there`` is false."""
    if there is None:
        u, at = np.unique(keys, return_inverse=True)
        return u, at.astype(np.int64)
    u, at = np.unique(keys[there], return_inverse=True)
    places = np.full(len(keys), -1, np.int64)
    places[there] = at
    return u, places


class _Block:
    """The tokens of a block's texts; distinct keys of each kind, and each position's place among them."""

    def __init__(self, row: dict, width: int) -> None:
        vocabulary, words = decode_sorted(row["vocabulary"]), decode(row["places"]).astype(np.int64)
        sizes = decode(row["sizes"]).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.held = decode(row["held"]).astype(bool)
        pairs, triples = (k >> np.uint64(64 - width) for k in keys_of(vocabulary[words], self.bounds))
        self.first = np.zeros(len(words), bool)
        self.first[self.bounds[:-1]] = True
        found = ((vocabulary, words), _distinct(pairs), _distinct(triples, ~self.first))
        self.keys, self.places = [u for u, _ in found], [at for _, at in found]
        at = int(np.searchsorted(vocabulary, _END))
        self.end = at if at < len(vocabulary) and vocabulary[at] == _END else -1

    def counts(self, kind: int) -> np.ndarray:
        """How often the block's own training texts hold each distinct key."""
        at = self.places[kind]
        used = np.repeat(~self.held, np.diff(self.bounds)) & (at >= 0)
        return np.bincount(at[used], minlength=len(self.keys[kind])).astype(np.uint64)


def _split(keys: np.ndarray, width: int, bits: int) -> list[tuple[int, int, int]]:
    """(range, begin, end) of sorted keys of ``width`` bits by their highest ``bits``; ranges without a key are not there."""
    if not len(keys):
        return []
    found, begins = np.unique((keys >> np.uint64(width - bits)).astype(np.int64), return_index=True)
    return list(zip(found.tolist(), begins.tolist(), [*begins[1:].tolist(), len(keys)], strict=True))


def _blocks(rows: DataFrame, block_tokens: int) -> DataFrame:
    """A row for each run of rows of about ``block_tokens`` tokens, or of one longer text: ids, tokens and counts, compressed."""
    id_type = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, id_arrow, held = TaskContext.get().partitionId() << 32, None, []

        def packed() -> pa.RecordBatch:
            nonlocal number
            ids, out, tokens, sizes = (list(x) for x in zip(*held, strict=True))
            ids, out, tokens, sizes = pa.concat_arrays(ids), np.concatenate(out), np.concatenate(tokens), np.concatenate(sizes)
            vocabulary, places = np.unique(tokens, return_inverse=True)
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            blobs = [encode_sorted(vocabulary), encode(places), encode(sizes), encode(out)]
            numbers = [len(tokens), int(sizes[~out].sum()), int((~out).sum())]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1]), ids, *[pa.array([b], pa.binary()) for b in blobs], *[pa.array([x], pa.int64()) for x in numbers]], names)

        n = 0
        for batch in batches:
            out = np.asarray(batch.column("held_out").to_numpy(zero_copy_only=False), bool)
            for at, end, data, offsets in text_chunks(batch.column("text")):
                words, bounds = word_hashes(data, offsets)
                held.append((batch.column("doc_id").slice(at, end - at), out[at:end], np.insert(words, bounds[1:], _END), np.diff(bounds) + 1))
                n += len(held[-1][2])
                if n >= block_tokens:
                    yield packed()
                    held, n = [], 0
        if held:
            yield packed()

    names = ["block", "ids", "vocabulary", "places", "sizes", "held", "n_tokens", "n_train", "n_texts"]
    schema = f"block long, ids array<{id_type}>, vocabulary binary, places binary, sizes binary, held binary, n_tokens long, n_train long, n_texts long"
    return rows.mapInArrow(run, schema)


def score_texts(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    masses: tuple[float, float] = MASSES,
    block_tokens: int = 1_000_000,
    range_keys: int = 2_000_000,
) -> DataFrame:
    """Scores every row under an automaton of order 3 learnt from the rows where ``held_out`` is not true.

    Texts are read once, into blocks of about ``block_tokens`` tokens, which are stored. A block sends the sorted distinct
    keys of its words, pairs and triples with its own training counts; keys meet by their highest bits, in ranges of about
    ``range_keys``, are summed over all blocks, and each block gets back the totals of its keys in the order it sent them.
    So counts cover all documents, are never pruned, and no task holds more than one block or one range. A block sends a
    message to a range only if it has a key there, so what is sent never exceeds a message for each distinct key of each
    block: it grows with the corpus, in proportion. Nothing is broadcast but four totals. Words are 64-bit hashes; keys
    of pairs and triples have 20 bits more than it takes to number them (64 at most), so an n-gram never seen meets
    another's key once in a million times.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (root arcs alone) and score, both log10. Words:
    ASCII white space parts them, A-Z read as a-z; an end follows each text and counts as a token. A null text is an
    empty one. A null ``held_out`` is false. Repeated rows and null ids are rows like any other; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    id_type = dict(rows.dtypes)["doc_id"]
    blocks = written(_blocks(rows, block_tokens), "lm-blocks")
    n_all, total, texts = blocks.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("n_tokens", "n_train", "n_texts")]).first()
    numbered = math.ceil(math.log2(max(2, 2 * n_all)))
    width = min(64, numbered + 20)
    bits = max(5, math.ceil(math.log2(max(1, n_all / range_keys))))
    widths = (64, width, width)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, width)
                for kind in _KINDS:
                    keys, counts = block.keys[kind], block.counts(kind)
                    out = [(kind, r, row["block"], encode_sorted(keys[x:y]), encode(counts[x:y])) for r, x, y in _split(keys, widths[kind], bits)]
                    for at in range(0, len(out), 1000):
                        cols = zip(*out[at : at + 1000], strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["kind", "part", "block", "keys", "counts"])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [decode_sorted(x) for x in pdf["keys"]]
        u, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(at, np.concatenate([decode(x) for x in pdf["counts"]]).astype(np.float64), len(u)).astype(np.uint64)
        ends = np.cumsum([0, *map(len, keys)])
        pdf["totals"] = [encode(sums[at[x:y]]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
        pdf["kinds"] = 0
        pdf.loc[pdf.index[0], "kinds"] = int((sums > 0).sum()) if pdf["kind"].iloc[0] == 0 else 0
        return pdf[["kind", "part", "block", "totals", "kinds"]]

    columns = ("block", "vocabulary", "places", "sizes", "held")
    asked = blocks.select(*columns).mapInArrow(sent, "kind int, part long, block long, keys binary, counts binary")
    answers = written(asked.groupBy("kind", "part").applyInPandas(summed, "kind int, part long, block long, totals binary, kinds long"), "lm-totals")
    kinds = answers.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]

    def scored(held: pa.Table, back: pa.Table) -> pa.Table:
        row = held.select(list(columns)).to_pylist()[0]
        block = _Block(row, width)
        got = sorted(zip(*(back.column(c).to_pylist() for c in ("kind", "part", "totals")), strict=True), key=lambda x: x[:2])
        counts = [np.concatenate([np.zeros(0, np.uint64), *[decode(t) for k, _, t in got if k == kind]]) for kind in _KINDS]
        if [len(c) for c in counts] != [len(k) for k in block.keys]:
            raise RuntimeError("a block and the totals sent back to it differ")
        model = Automaton(total, kinds, texts, masses, *block.places, block.first, counts, block.end)
        b, words = block.bounds, block.places[0]
        base, known = (np.add.reduceat(x[words], b[:-1]) for x in (model.root_weight, (counts[0] > 0).astype(np.int64)))
        scores = [model.walk(x, y) for x, y in zip(b[:-1].tolist(), b[1:].tolist(), strict=True)]
        ids = held.column("ids").combine_chunks().flatten()
        n = len(ids)
        return pa.table(
            [ids, pa.array(block.held), pa.array(np.diff(b), pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(n, total), pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64())],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.select("ids", *columns).groupBy("block").cogroup(answers.select("kind", "part", "block", "totals").groupBy("block")).applyInArrow(scored, schema)
