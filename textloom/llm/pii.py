"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int]

#: Order of kinds that start at one place; the first four are those of the fixed patterns.
KINDS = ("email", "ip", "card", "phone", "secret", "national_id", "iban", "local_phone", "name", "address", "username")
#: Kinds that are numbers: without a digit there is none.
_NUMBERS = frozenset(("national_id", "iban", "local_phone"))

# ---- fixed patterns -------------------------------------------------------------------------------------------------
# Each is equal to the plain pattern matched left to right, written so that no start is tried in vain along a long run.
_DIGIT = re.compile(r"[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(t: str) -> Iterator[Span]:
    at, free = t.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and t[begin - 1] in _LOCAL_SET:
            begin -= 1
        m = _DOMAIN.match(t, at) if begin < at else None
        if m:
            yield "email", begin, m.end()
            free = m.end()
        at = t.find("@", max(at + 1, free))


def base_spans(t: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind."""
    found = list(_emails(t)) if "@" in t else []
    if _DIGIT.search(t):
        found += [("ip", *m.span()) for m in _IP.finditer(t) if all(len(n := x.lstrip("0")) <= 3 and int(n or "0") <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in t:
            found += [("phone", *m.span()) for m in _PHONE.finditer(t) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found, key=order)


def order(s: Span) -> tuple[int, int, int]:
    return s[1], KINDS.index(s[0]), s[2]


# ---- the labelled table ---------------------------------------------------------------------------------------------
def labelled_table(n: int = 360, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Short texts with marked spans, made by a rule: the same rows each time. About a third hold nothing personal."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choices("0123456789", k=k))
    syllables = ("the", "er", "on", "ti", "que", "ción", "en", "sch", "ung", "éa", "re", "ha", "st", "ble")
    word = lambda: "".join(r.choices(syllables, k=r.randrange(1, 4)))
    words = lambda: " ".join(word() + r.choice(["", "", "", ",", "."]) for _ in range(r.randrange(0, 6)))
    hexes = lambda k: "".join(r.choices("0123456789abcdef", k=k))
    mixed = lambda k: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=k))
    lead = {
        "secret": ["token = ", "api_key = ", "secret: ", "password=", "key: ", "token ", "access_token = ", ""],
        "national_id": ["SSN ", "ssn: ", "social security number ", ""],
        "iban": ["IBAN ", "iban: ", "account ", ""],
        "local_phone": ["call ", "phone: ", "Tel. ", "fax ", ""],
    }
    make = {
        "secret": lambda: r.choice([hexes(40), hexes(32), hexes(64), "AKIA" + mixed(16).upper(), "ghp_" + mixed(36), "sk-" + mixed(40)]),
        "national_id": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "iban": lambda: r.choice("DE FR ES GB".split()) + digits(2) + r.choice([f" {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", digits(18)]),
        "local_phone": lambda: r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]),
    }
    plain = [
        lambda: f"version {digits(1)}.{digits(1)}", lambda: f"in {r.choice(['19', '20'])}{digits(2)}", lambda: f"${digits(3)}", lambda: f"{digits(2)}%", lambda: f"page {digits(3)}",
        lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: digits(16), lambda: f"{digits(2)}:{digits(2)}", lambda: f"{word()}{digits(2)}",
        lambda: f"{word()}.{digits(2)}@mail{digits(1)}.example.com", lambda: f"{digits(3)}.{digits(2)}.{digits(3)}.{digits(2)}", lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(1)})",
        lambda: f"the token {word()}", lambda: f"{digits(2)}-{digits(2)}", lambda: f"{digits(5)}", lambda: "Licensed under the Apache License, Version 2.0.", lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}",
    ]
    rows = []
    for i in range(n):
        parts, spans = words(), []
        for _ in range(r.choice([1, 1, 2])):
            parts += " " if parts else ""
            if i % 3 == 0:
                parts += r.choice(plain)()
            else:
                kind = r.choice(sorted(make))
                quote = r.choice(["", '"', "'"]) if kind == "secret" else ""
                parts += r.choice(lead[kind]) + quote
                value = make[kind]()
                spans.append((kind, len(parts), len(parts) + len(value)))
                parts += value + quote + r.choice(["", ".", ",", ""])
            parts += " " + words()
        rows.append((parts, spans))
    return rows


FIRST_NAMES = tuple(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Karen Daniel Lisa Matthew Nancy Anthony Betty Sandra Margaret Steven "
    "Ashley Andrew Kimberly Emily Donna Joshua Michelle Kevin Carol Brian Amanda George Melissa Edward Deborah Ronald Stephanie Timothy Rebecca Jason Laura Anna Maria Hans Peter Klaus Jürgen Ursula "
    "Monika Pierre Jean Marie François Claire Sophie Luis José Carmen Ana Javier Pablo Lucía Giulia Marco Paolo Ivan Olga Dmitri Natalia Ahmed Fatima Omar Aisha Wei Yuki Hiroshi Priya Raj Anita "
    "Armen Ani Narek Lilit".split()
)
_STREETS = tuple("Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Court Way".split())


def open_table(n: int = 1400, seed: int = 23, firsts: tuple[str, ...] = FIRST_NAMES) -> list[tuple[str, list[Span]]]:
    """Short texts with names, addresses, user names and secrets of letters alone, made by a rule. Two fifths hold none."""
    r = random.Random(seed)
    syllables = ("the", "er", "on", "ti", "que", "ción", "en", "sch", "ung", "éa", "re", "ha", "st", "ble", "an", "mo", "li", "ka")
    word = lambda: "".join(r.choices(syllables, k=r.choice([1, 1, 2, 2, 3, 3, 4, 6, 9])))
    short = lambda: "".join(r.choices(syllables, k=r.randrange(1, 4)))
    cap = lambda: "".join(r.choices(syllables, k=r.randrange(2, 4))).capitalize()
    number = lambda k: str(r.randrange(1, 10 ** r.randint(1, k)))
    letters = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=r.randrange(8, 30)))

    def words() -> str:
        out = [word() + r.choice(["", "", "", ",", "."]) for _ in range(r.randrange(0, 6))]
        return " ".join(w.capitalize() if i == 0 or out[i - 1].endswith(".") or r.random() < 0.05 else w for i, w in enumerate(out))

    name = lambda first: first + r.choice([f" {cap()}", f" {cap()}", f" {r.choice('ABCDEFGHIJ')}. {cap()}", f" {cap()}-{cap()}", f" {cap()} {cap()}"])
    cues = ["Mr. ", "Mrs. ", "Ms ", "Dr. ", "Dear ", "my name is ", "Name: ", "name: ", "contact ", "Contact: ", "signed by ", "Regards, "]
    town = lambda: r.choice(["", "", f", {cap()}", f", {cap()} {r.randrange(10000, 99999)}", f", {r.randrange(10000, 99999)} {cap()}"])
    street = lambda: r.choice([f"{cap()} {r.choice(_STREETS)}", f"{cap()} {cap()} {r.choice(_STREETS)}", f"rue de {cap()}"])
    handle = lambda: r.choice([short() + "_" + short(), short() + "." + short(), short(), short() + number(3), cap() + cap(), short() + "-" + short()])
    secret = lambda: r.choice([short() + short() + short(), letters(), short() + "-" + short() + "-" + short(), short() + short(), short()])
    assign = lambda keys: r.choice(keys) + r.choice(["=", " = ", ": ", ":"])
    make = {
        "name": lambda: ("", name(r.choice(firsts))) if r.random() < 0.5 else (r.choice(cues), r.choice([name(cap()), name(r.choice(firsts)), cap(), cap()])),
        "address": lambda: r.choice([*[("", f"{number(4)} {street()}{town()}")] * 3, ("", f"{cap()}{r.choice(['straße', 'strasse', 'weg'])} {number(3)}{town()}"), ("", f"Calle {cap()} {number(3)}{town()}"), (r.choice(["address: ", "Address: ", "lives at "]), f"{street()}, {cap()}")]),
        "username": lambda: r.choice([(assign(["username", "user", "login", "Username", "user name"]), handle()), ("@", handle())]),
        "secret": lambda: (assign(["password", "passwd", "pwd", "secret", "api_key", "access_token", "token", "Password", "PASSWORD"]), secret()),
    }
    plain = [
        lambda: f"The {cap()} {cap()} {word()}", lambda: f"{cap()} {cap()}", lambda: f"{cap()} {cap()} {cap()}.", lambda: f"the password {word()} {word()}", lambda: f"a secret {word()}", lambda: f"user {word()} {word()}",
        lambda: f"the name {word()} {word()}", lambda: f"{word()} street {word()}", lambda: f"In {r.choice(['19', '20'])}{r.randrange(10, 99)} {cap()} {word()}", lambda: f"{number(3)} {word()} {word()}", lambda: f"address {word()} {word()}",
        lambda: f"contact {word()} {word()}", lambda: "Licensed under the Apache License, Version 2.0.", lambda: f"{word()}: {word()} {word()}", lambda: f"{word()} = {word()}", lambda: f"{word()}.{word()}@{word()}.example.com",
        lambda: f"{number(2)} {cap()} {word()}", lambda: f"the token {word()}", lambda: f"{(w := cap())} {w}", lambda: f"Chapter {number(2)} {cap()}", lambda: f"{word()}_{word()}", lambda: f"{word()} | {word()} | {word()}",
        lambda: f"login {word()}", lambda: f"by {word()} road {word()}", lambda: f"{cap()}, {cap()} and {cap()}", lambda: f"{cap()}-{cap()}",
        lambda: " ".join([cap() + r.choice(["", "", ",", "."])] * r.randrange(3, 16)), lambda: " ".join([word() + r.choice(["", ".", ":"])] * r.randrange(3, 9)), lambda: "-".join([word(), word(), word()]), letters, lambda: " ".join(word() + r.choice(["", ",", "."]) + r.choice("&$#*%@|") * 3 for _ in range(r.randrange(2, 7))),
    ]
    rows = []
    for i in range(n):
        parts, spans = words(), []
        for _ in range(r.choice([1, 1, 2])):
            parts += " " if parts else ""
            if i % 5 < 2:
                parts += r.choice(plain)()
            else:
                kind = r.choice(["address", "address", "name", "name", "secret", "secret", "username"])
                lead, value = make[kind]()
                quote = r.choice(["", "", '"', "'"]) if kind == "secret" else ""
                parts += lead + quote
                spans.append((kind, len(parts), len(parts) + len(value)))
                parts += value + quote + r.choice(["", ",", ""])
            parts += r.choice(["", " " + word() + " " + words()])
        rows.append((parts, spans))
    return rows


# ---- the field ------------------------------------------------------------------------------------------------------
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_+")
_KEYWORDS = frozenset(
    "token key secret password passwd pwd api access ssn social security iban account call phone tel fax version mr mrs ms dr dear name contact signed regards address lives user username login rue calle license".split()
)
#: What a word stands for as a keyword: itself, or its list. Names and streets count with a capital alone.
_LISTED = dict.fromkeys(FIRST_NAMES, "<first>") | dict.fromkeys(_STREETS, "<street>")
_TAGS = ("O", *[f"{p}-{k}" for k in KINDS[4:] for p in "BI"])
#: Tokens that are decoded at once: bounds memory, not what is read.
_AT_ONCE = 500_000


def shape(w: str) -> str:
    """Letters and digits by kind; counts up to 4 stay, longer runs show their rough length."""
    if not w[0].isalnum():
        return w[0]
    if w.isdigit():
        return f"0{len(w)}" if len(w) <= 4 else "0<9" if len(w) < 9 else "0<16" if len(w) < 16 else "0>"
    has = any(c.isdigit() for c in w)
    if not has:
        return ("Aa" if w[0].isupper() and not w.isupper() else "A" if w.isupper() else "a") + ("+" if len(w) > 15 else "")
    hexa = all(c in "0123456789abcdef" for c in w)
    return ("hex" if hexa else "mix" if any(c.isupper() for c in w) else "mixlow") + ("<8" if len(w) < 8 else "<16" if len(w) < 16 else "<24" if len(w) < 24 else ">")


def keyword(w: str) -> str:
    low = w.lower()
    return _LISTED.get(w) or (low if low in _KEYWORDS else "<street>" if low.endswith(("straße", "strasse", "weg")) and w[0].isupper() else "")


def features(words: list[str], gaps: list[bool]) -> list[list[str]]:
    """Names of what holds at each token: its shape, its neighbours' shapes, near keywords, white space before it."""
    s = ["<s>", "<s>", *map(shape, words), "</s>", "</s>"]
    low = ["", "", "", *map(keyword, words), "", ""]
    out = []
    for i in range(len(words)):
        k, g = i + 2, "_" if gaps[i] else "."
        n = "_" if i + 1 < len(words) and gaps[i + 1] else "."
        out.append(
            [
                "bias", f"s={s[k]}", f"p={s[k - 1]}{g}{s[k]}", f"n={s[k]}{n}{s[k + 1]}", f"pp={s[k - 2]}|{s[k - 1]}|{s[k]}", f"nn={s[k]}|{s[k + 1]}|{s[k + 2]}", f"pn={s[k - 1]}|{s[k]}|{s[k + 1]}",
                f"k1={low[i + 2]}|{s[k]}", f"k2={low[i + 1]}|{s[k]}", f"k3={low[i]}|{s[k]}", f"own={low[i + 3]}", f"a1={low[i + 4]}|{s[k]}", f"a2={low[i + 5]}|{s[k]}", f"head={words[i][:2] if words[i][:2].isupper() else ''}|{s[k]}",
            ]
        )
    return out


@dataclass(frozen=True)
class Field:
    """Weights of features by tag (row 0: unknown features, all 0), of neighbouring tags, of first tags."""

    names: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def ids(self, words: list[str], gaps: list[bool]) -> np.ndarray:
        return np.array([[self.names.get(f, 0) for f in fs] for fs in features(words, gaps)], np.int32)

    def decode(self, sequences: list[np.ndarray], batch: int = 256) -> list[np.ndarray]:
        """Viterbi tags of sequences of feature ids, many at once; sequences of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        by_size = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        for at in range(0, len(by_size), batch):
            part = by_size[at : at + batch]
            longest = len(sequences[part[-1]])
            if not longest:
                continue
            score = np.zeros((len(part), longest, len(_TAGS)))
            for row, i in enumerate(part):
                if len(sequences[i]):
                    score[row, : len(sequences[i])] = self.emit[sequences[i]].sum(axis=1)
            best, back = score[:, 0] + self.first, np.zeros((longest, len(part), len(_TAGS)), np.int64)
            live = np.array([len(sequences[i]) for i in part])
            for t in range(1, longest):
                paths = best[:, :, None] + self.move
                back[t] = paths.argmax(axis=1)
                best = np.where((t < live)[:, None], paths.max(axis=1) + score[:, t], best)
            last = best.argmax(axis=1)
            for row, i in enumerate(part):
                tags = np.zeros(live[row], np.int64)
                if live[row]:
                    tags[-1] = last[row]
                    for t in range(live[row] - 1, 0, -1):
                        tags[t - 1] = back[t, row, tags[t]]
                out[i] = tags
        return out


_NEVER = -1e4


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Inside tags follow a begin or inside tag of their kind alone."""
    move, first = np.zeros((len(_TAGS), len(_TAGS))), np.zeros(len(_TAGS))
    for j, tag in enumerate(_TAGS):
        if tag[0] == "I":
            first[j] = _NEVER
            for i, before in enumerate(_TAGS):
                move[i, j] = 0.0 if before[1:] == tag[1:] else _NEVER
    return move, first


def _laid_out(table: list[tuple[str, list[Span]]], names: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids and tags of all tokens of the table, and how many rows have a token at each place.

    Tokens lie by place first, then by row, longest rows first: those at one place are neighbours, and the rows that go on
    are the first of them. New features are added to ``names``.
    """
    rows = []
    for text, spans in table:
        toks = list(_TOKEN.finditer(text))
        fs = features([m[0] for m in toks], _gaps(toks))
        tags = np.zeros(len(toks), np.int64)
        for kind, a, b in spans:
            own = [i for i, m in enumerate(toks) if a <= m.start() < b]
            tags[own] = _TAGS.index(f"I-{kind}")
            tags[own[0]] = _TAGS.index(f"B-{kind}")
        rows.append(([[names.setdefault(f, len(names)) for f in x] for x in fs], tags))
    rows.sort(key=lambda r: -len(r[1]))
    live = np.array([sum(len(t) > k for _, t in rows) for k in range(len(rows[0][1]))])
    at = [(i, k) for k, m in enumerate(live) for i in range(m)]
    return np.array([rows[i][0][k] for i, k in at], np.int32), np.array([rows[i][1][k] for i, k in at]), live


def gradient(ids: np.ndarray, gold: np.ndarray, live: np.ndarray, emit: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log likelihood of the tags given the features: what was seen less what forward-backward expects."""
    begin = np.cumsum(live) - live
    m, n = np.exp(move), len(first)
    score = emit[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        score += emit[ids[:, k]]
    e = np.exp(score - score.max(axis=1, keepdims=True))
    # Chances ahead of and behind each token, scaled to sum to 1 at each: only their products' shares are needed.
    ahead, behind = np.empty_like(e), np.ones_like(e)
    for t, k in enumerate(live):
        now = slice(begin[t], begin[t] + k)
        ahead[now] = e[now] * (ahead[begin[t - 1] : begin[t - 1] + k] @ m if t else np.exp(first))
        ahead[now] /= ahead[now].sum(axis=1, keepdims=True)
    for t in range(len(live) - 1, 0, -1):
        now, then = slice(begin[t], begin[t] + live[t]), slice(begin[t - 1], begin[t - 1] + live[t])
        behind[then] = (e[now] * behind[now]) @ m.T
        behind[then] /= behind[then].sum(axis=1, keepdims=True)
    share = ahead * behind
    share /= share.sum(axis=1, keepdims=True)
    diffs = np.eye(n)[gold] - share
    d_emit, d_move = np.empty_like(emit), np.zeros_like(move)
    for t in range(1, len(live)):
        now, then = slice(begin[t], begin[t] + live[t]), slice(begin[t - 1], begin[t - 1] + live[t])
        b = e[now] * behind[now]
        z = ((ahead[then] @ m) * b).sum(axis=1, keepdims=True)
        d_move -= m * ((ahead[then] / z).T @ b)
        np.add.at(d_move, (gold[then], gold[now]), 1.0)
    flat, width = ids.ravel(), ids.shape[1]
    for k in range(n):
        d_emit[:, k] = np.bincount(flat, np.repeat(diffs[:, k], width), len(emit))
    return d_emit, d_move, diffs[: live[0]].sum(axis=0)


def train(table: list[tuple[str, list[Span]]], rounds: int = 60, rate: float = 0.25, decay: float = 1e-3) -> Field:
    """Maximises the conditional log likelihood of the table by adaptive gradient steps over the whole table."""
    names: dict[str, int] = {"": 0}
    ids, gold, live = _laid_out(table, names)
    n = len(_TAGS)
    fixed_move, fixed_first = _allowed()
    emit, move, first = np.zeros((len(names), n)), np.zeros((n, n)), np.zeros(n)
    sums = [np.full_like(x, 1e-6) for x in (emit, move, first)]
    for _ in range(rounds):
        found = gradient(ids, gold, live, emit, move + fixed_move, first + fixed_first)
        for x, d, g in zip((emit, move, first), found, sums, strict=True):
            d = d - decay * len(table) * x
            g += d * d
            x += rate * d / np.sqrt(g)
        emit[0] = 0.0
    return Field(names, emit, move + fixed_move, first + fixed_first)


def _gaps(toks: list[re.Match]) -> list[bool]:
    return [i > 0 and toks[i - 1].end() < m.start() for i, m in enumerate(toks)]


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table() + open_table(), rounds=100)


class _Codes(dict):
    """Token to a number: shape, keyword and capital head of those that the field knows; -1 for white space."""

    def __init__(self, shapes: dict[str, int], words: dict[str, int], heads: dict[str, int]):
        self.shapes, self.words, self.heads = shapes, words, heads

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        head = w[:2] if w[:2].isupper() else ""
        code = -1 if w.isspace() else self.shapes.get(shape(w), 0) | self.words.get(keyword(w), 0) << 10 | self.heads.get(head, 0) << 20
        self[w] = code
        return code


class _Scorer:
    """What ``Field.ids`` and ``Field.decode`` give, for whole texts: features come from tables of small numbers."""

    def __init__(self, field: Field):
        shapes, heads = {"": 0, "<s>": 1, "</s>": 2}, {"": 0}
        for f in field.names:  # n= names hold a shape, a mark of white space and the next shape; s= names are shapes
            if f.startswith("s="):
                shapes.setdefault(f[2:], len(shapes))
            elif f.startswith("head="):
                heads.setdefault(f[5:7] if f[5:6] != "|" else "", len(heads))
        words = {"": 0} | {w: i + 1 for i, w in enumerate(sorted({*_KEYWORDS, *_LISTED.values()}))}
        self.codes, get, n = _Codes(shapes, words, heads), field.names.get, len(shapes)
        names = list(shapes)
        names[0] = "\0"  # a shape that the field does not know: no feature has it

        def table(name, *sizes) -> np.ndarray:
            return np.array([get(name(*at), 0) for at in np.ndindex(*sizes)], np.int32).reshape(sizes)

        S, K, H = names, list(words), list(heads)
        self.prev = table(lambda a, g, b: f"p={S[a]}{'._'[g]}{S[b]}", n, 2, n)
        self.next = table(lambda a, g, b: f"n={S[a]}{'._'[g]}{S[b]}", n, 2, n)
        self.three = [table(lambda a, b, c: f"{x}={S[a]}|{S[b]}|{S[c]}", n, n, n) for x in ("pp", "pn", "nn")]  # noqa: B023
        self.emit, self.move, self.first = (x.astype(np.float32) for x in (field.emit, field.move, field.first))
        held = lambda *a: self.emit[table(*a)]
        self.base = held(lambda a: f"s={S[a]}", n) + self.emit[get("bias", 0)]
        self.near = {d: held(lambda k, a: f"{f'k{-d}' if d < 0 else f'a{d}'}={K[k]}|{S[a]}", len(K), n) for d in (-1, -2, -3, 1, 2)}  # noqa: B023
        self.own, self.head = held(lambda k: f"own={K[k]}", len(K)), held(lambda h, a: f"head={H[h]}|{S[a]}", len(H), n)
        self.base = self.base + sum(x[0] for x in self.near.values()) + self.own[0] + self.head[0]

    def scores(self, codes: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """A row of scores by tag for each token of one text or, with six empty places between them, of several."""
        s, k, h = codes & 1023, codes >> 10 & 1023, codes >> 20
        i = np.arange(2, len(codes) - 2)
        a, b, c, d, e = s[i - 2], s[i - 1], s[i], s[i + 1], s[i + 2]
        out = self.base[c]
        for ids in (self.prev[b, gaps[i], c], self.next[c, gaps[i + 1], d], self.three[0][a, b, c], self.three[1][b, c, d], self.three[2][c, d, e]):
            out += self.emit[ids]
        for d, near in self.near.items():
            there = k[np.maximum(i + d, 0)]
            on = np.flatnonzero(there)
            out[on] += near[there[on], c[on]] - near[0, c[on]]
        on = np.flatnonzero(k[i])
        out[on] += self.own[k[i[on]]] - self.own[0]
        on = np.flatnonzero(h[i])
        out[on] += self.head[h[i[on]], c[on]] - self.head[0, c[on]]
        return np.concatenate([np.zeros((2, len(self.first)), np.float32), out])

    def tags(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text the tags of its tokens, and where they begin and end."""
        parts, gaps, bounds, begin, at = [], [], [], [], 0
        edge, none = np.array([1, 1, 1]), np.zeros(3, np.int64)
        for t in texts:
            toks = _PIECE.findall(t)
            codes = np.fromiter(map(self.codes.__getitem__, toks), np.int64, len(toks))
            sizes = np.fromiter(map(len, toks), np.int64, len(toks))
            ends = np.cumsum(sizes)
            on = codes >= 0
            before = np.zeros(len(toks), np.int64)
            before[1:] = ~on[:-1]
            before, stops = before[on], ends[on]
            if len(before):
                before[0] = 0
            bounds.append((stops - sizes[on], stops))
            begin.append(at + 3)
            parts += [edge, codes[on], edge + 1]
            gaps += [none, before, none]
            at += 6 + len(stops)
        score = self.scores(np.concatenate(parts), np.concatenate(gaps)) if parts else np.zeros((0, len(self.first)), np.float32)
        sizes = np.array([len(x) for _, x in bounds], np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        offs, live = np.array(begin, np.int64)[by_size], sizes[by_size]
        found, best = np.zeros(len(score), np.int8), np.zeros((len(texts), len(self.first)), np.float32)
        back = np.zeros(score.shape, np.int8)
        counts = np.searchsorted(-live, -np.arange(1, (live[0] if len(live) else 0) + 1), side="right")  # texts longer than t
        move = np.ascontiguousarray(self.move.T)[None]
        rows = np.arange(best.size) * best.shape[1]  # where each text's and tag's paths begin
        for t, m in enumerate(counts):
            now = score[offs[:m] + t]
            if t:
                paths = best[:m, None, :] + move
                pick = paths.argmax(axis=2)
                back[offs[:m] + t] = pick
                best[:m] = paths.reshape(-1)[rows[: pick.size] + pick.reshape(-1)].reshape(now.shape) + now
            else:
                best[:m] = now + self.first
        tag = best.argmax(axis=1)
        for t in range(len(counts) - 1, -1, -1):
            where = offs[: counts[t]] + t
            found[where] = tag[: counts[t]]
            tag[: counts[t]] = back[where, tag[: counts[t]]]
        return [(found[b : b + n], *x) for b, n, x in zip(begin, sizes, bounds)]


#: Tokens and the white space between them.
_PIECE = re.compile(rf"\s+|{_TOKEN.pattern}")
_scorers: dict[bytes, _Scorer] = {}


def _scorer(field: Field) -> _Scorer:
    """The field's tables, made once a process."""
    key = hashlib.sha256(repr(sorted(field.names.items())).encode() + b"".join(x.tobytes() for x in (field.emit, field.move, field.first))).digest()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = _Scorer(field)
    return _scorers[key]


def find_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text its fixed spans and all spans: the field reads whole texts and adds what touches no fixed one."""
    scorer = _scorer(field)
    out: list[tuple[list[Span], list[Span]]] = [([], [])] * len(texts)
    by_size = sorted(range(len(texts)), key=lambda k: len(texts[k]))
    at = 0
    while at < len(by_size):
        chars, end = 0, at
        while end < len(by_size) and (end == at or chars + len(texts[by_size[end]]) <= _AT_ONCE * 4):
            chars += len(texts[by_size[end]]) + 12
            end += 1
        part = by_size[at:end]
        for k, (tags, starts, stops) in zip(part, scorer.tags([texts[k] for k in part]), strict=True):
            out[k] = _spans(texts[k], tags, starts, stops)
        at = end
    return out


def _spans(text: str, tags: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[list[Span], list[Span]]:
    fixed = base_spans(text)
    every = list(fixed)
    named = np.flatnonzero(tags).tolist()
    at = 0
    while at < len(named):
        i = j = named[at]
        kind = _TAGS[tags[i]][2:]
        at += 1
        if _TAGS[tags[i]][0] == "B":
            while at < len(named) and named[at] == j + 1 and _TAGS[tags[j + 1]] == f"I-{kind}":
                j, at = j + 1, at + 1
            a, b = int(starts[i]), int(stops[j])
            if (kind not in _NUMBERS or _DIGIT.search(text, a, b)) and not any(x < b and a < y for _, x, y in fixed):
                every.append((kind, a, b))
    return fixed, sorted(every, key=order)


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text", mask: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (or the columns in ``keep``), base and spans (kind:start:end, comma-joined, code points) of every row.

    Base spans are those of the four fixed patterns; the field adds spans of secrets, national ids, account numbers,
    local phone numbers, names, addresses and user names. With ``mask`` a further column ``masked`` has the text with each span replaced by its kind in
    angle brackets (overlapping spans become one). A null text has no spans and stays null. Null ids and repeated rows
    each give a row; an empty table gives an empty result; columns not named are ignored. A column in ``keep`` that has a
    name of the result raises.
    """
    field = field or default_field()
    added = ["base", "spans", *(["masked"] if mask else [])]
    if clash := {*added, "__text"} & set(keep):
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    kept = docs.select(*([F.col(id_col).alias("doc_id")] if not keep else keep), F.col(text_col).alias("__text"))
    schema = kept.drop("__text").schema
    for name in added:
        schema = schema.add(name, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            found = find_spans([t or "" for t in texts], field)
            rest = batch.drop_columns(["__text"])
            cols = [*rest.columns, pa.array([_listed(b) for b, _ in found], pa.string()), pa.array([_listed(s) for _, s in found], pa.string())]
            if mask:
                cols.append(pa.array([masked(t, s) for t, (_, s) in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return kept.mapInArrow(run, schema)


def masked(text: str | None, spans: list[Span]) -> str | None:
    if not text or not spans:
        return text
    parts, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            parts += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]])
