"""Chat formatting by incremental black-box rendering."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

SPANS = "array<struct<turn:int,role:string,start:int,end:int,text_start:int,text_end:int>>"


def escape(text: str) -> str:
    """Breaks every control string: each begins with < or [, and both are followed by a backslash afterwards."""
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return re.sub(r"([<\[])\\|\\\\", lambda m: m[1] or "\\", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"([<\[])\\|\\(.)", lambda m: m[1] or {"n": "\n"}.get(m[2], m[2]), role)


def marked_turns(turns: list[Turn]) -> str:
    """The template used by the query: a mark, the role, a line break, the escaped text, a closing mark."""
    return "".join(f"<|turn|>{escape_role(role)}\n{escape(text)}<|end|>\n" for role, text in turns)


def read_back(formatted: str) -> list[Turn]:
    """The turns that a text made by ``marked_turns`` holds."""
    found = re.findall(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", formatted, re.DOTALL)
    return [(unescape_role(role), unescape(text)) for role, text in found]


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by bisection over slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _pieces(template: Template, turns: list[Turn], block: int, whole: str) -> list[tuple[int, int, int, int]] | None:
    """(start, end, head, tail) of each turn when it is the newest: its span, and what stands there before and behind its text.

    Each turn is rendered after all turns of its block and of the block before it: itself, and with two one-letter texts.
    The pieces are put together, and must equal the whole rendering at the begin of each block and at the end; None if
    they don't, as with a template that looks further back.
    """
    found, out = [], ""
    for first in range(0, len(turns), block):
        if first and out != template(turns[:first]):
            return None
        context = turns[max(0, first - block) : first]
        before = template(context) if context else ""
        for k in range(first, min(first + block, len(turns))):
            seen, role = context + turns[first:k], turns[k][0]
            now, a, b = (template([*seen, (role, t)]) for t in (turns[k][1], "a", "b"))
            same = len(before) if now.startswith(before) else _common(before, now)
            start = max(0, len(out) + same - len(before))
            out = out[:start] + now[same:]
            found.append((start, len(out), max(0, _common(a, b) - same), _common(a[::-1], b[::-1])))
            before = now
    return found if out == whole else None


def locate(template: Template, turns: list[Turn], block: int = 256) -> tuple[str, list[tuple[int, str, int, int, int, int]], bool]:
    """The formatted conversation, a span for each turn, and whether the template rewrites history.

    Successive prefixes are rendered and consecutive outputs compared: what turn k adds to the output of turns 0 to k-1
    is its span. Rendering the last turn with two one-letter texts shows where its text starts, and its end follows from
    what stands behind that letter. If a longer prefix changes what stood before, history is rewritten: spans past the
    first changed character no longer hold and are cut there, and the span of the newest turn begins at that character.
    So that the work is linear in the turns, a prefix starts one block before the turn's own block; where that does not give
    the whole prefixes, all are rendered whole.
    """
    if not turns:
        return "", [], False
    whole = template(turns)
    pieces = _pieces(template, turns, block, whole) or _pieces(template, turns, len(turns), whole) or []
    spans, rewrites, kept = [], False, 0
    for k, (start, end, head, tail) in enumerate(pieces):
        if start < kept:
            rewrites = True
            spans = [(t, r, min(s, start), min(e, start), min(a, start), min(z, start)) for t, r, s, e, a, z in spans]
        a = min(start + head, end)
        spans.append((k, turns[k][0], start, end, a, max(a, end - tail)))
        kept = end
    return whole, spans, rewrites


def format_conversations(
    turns: DataFrame,
    template: Template = marked_turns,
    loss_roles: tuple[str, ...] = ("assistant",),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row for each conversation: conv_id, formatted, spans, loss_spans, rewrites_history.

    ``spans`` has each turn's place in ``formatted`` in code points, and the place of its text inside; ``loss_spans`` has
    (start, end) of the texts of ``loss_roles``. Turns are ordered by turn number, role and text, nulls first, so ties
    and repeated rows have a fixed order and all count. A null text or role is empty. Nothing tells
    which rows without a conversation id belong together, so each is a conversation of its own with a null id. An empty table gives an empty result; other columns are ignored. A conversation is
    one output string, so its turns meet in one task; nothing else does.
    """
    kept = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
        ).alias("t"),
    )
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    grouped = kept.withColumn("own", own).groupBy("conv_id", "own").agg(F.sort_array(F.collect_list("t")).alias("turns")).drop("own")
    id_type = dict(grouped.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"formatted": [], "spans": [], "loss_spans": [], "rewrites_history": []}
            for row in batch.column("turns").to_pylist():
                text, spans, rewrites = locate(template, [(t["role"], t["text"]) for t in row])
                out["formatted"].append(text)
                out["spans"].append([dict(zip(("turn", "role", "start", "end", "text_start", "text_end"), s, strict=True)) for s in spans])
                out["loss_spans"].append([{"start": s[4], "end": s[5]} for s in spans if s[1] in loss_roles])
                out["rewrites_history"].append(rewrites)
            names = ("turn", "role", "start", "end", "text_start", "text_end")
            types = [pa.int32(), pa.string(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    pa.array(out["formatted"], pa.string()),
                    pa.array(out["spans"], pa.list_(pa.struct(list(zip(names, types, strict=True))))),
                    pa.array(out["loss_spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(out["rewrites_history"], pa.bool_()),
                ],
                ["conv_id", "formatted", "spans", "loss_spans", "rewrites_history"],
            )

    return grouped.mapInArrow(
        run, f"conv_id {id_type}, formatted string, spans {SPANS}, loss_spans array<struct<start:int,end:int>>, rewrites_history boolean"
    )
