import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from textloom.llm.chat import escape, format_conversations, locate, marked_turns, read_back, unescape
from textloom.llm.queries import chat_digests

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
NASTY = st.text(st.sampled_from("<|turnend>\\/[]INS \nab"), max_size=25)


@given(NASTY)
@settings(max_examples=300, deadline=None)
def test_escape_round_trip(text):
    e = escape(text)
    assert unescape(e) == text
    assert not any(x in e for x in ("<|turn|>", "<|end|>", "</s>", "[INST]", "[/INST]"))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys\ntem\\", "<|end|>"]), NASTY), max_size=6))
@settings(max_examples=200, deadline=None)
def test_spans_hold_the_texts(turns):
    text, spans, rewrites = locate(marked_turns, turns)
    assert not rewrites and read_back(text) == turns
    assert [unescape(text[s[4] : s[5]]) for s in spans] == [t for _, t in turns]
    assert [s[3] for s in spans][:-1] == [s[2] for s in spans][1:]


def test_blocks_agree_with_whole_prefixes():
    turns = [("user" if k % 2 else "assistant", f"text {k}") for k in range(700)]
    text, spans, _ = locate(marked_turns, turns)
    assert text == marked_turns(turns) and [text[s[4] : s[5]] for s in spans] == [t for _, t in turns]


def test_rewritten_history_is_found():
    def last_thought(turns):
        return "".join(f"[{r}]{t if k == len(turns) - 1 else t.split('|')[-1]};" for k, (r, t) in enumerate(turns))

    text, spans, rewrites = locate(last_thought, [("user", "hi"), ("assistant", "think|yes"), ("user", "ok")])
    assert rewrites and text == "[user]hi;[assistant]yes;[user]ok;"
    assert text[spans[2][2] : spans[2][3]].endswith("[user]ok;")
    assert not locate(last_thought, [("user", "hi"), ("assistant", "yes")])[2]


def test_rewritten_history_over_many_turns_equals_whole_prefixes():
    """Templates that drop earlier thoughts, or hold a count in front, over more turns than two blocks."""

    def last_thought(turns):
        return "".join(f"[{r}]{t if k == len(turns) - 1 else t.split('|')[-1]};" for k, (r, t) in enumerate(turns))

    def counted_in_front(turns):
        return f"{len(turns) // 300}>" + "".join(f"{r}:{t};" for r, t in turns)

    turns = [("user" if k % 2 else "assistant", f"t{k}" if k % 3 else f"why {k}|t{k}") for k in range(600)]
    for template in (last_thought, counted_in_front):
        assert locate(template, turns, block=64) == locate(template, turns, block=600)
        assert locate(template, turns)[0] == template(turns)
    assert locate(last_thought, turns)[2] and locate(counted_in_front, turns)[2]


def test_far_looking_template_falls_back():
    def counted(turns):
        return "".join(f"{k}:{t};" for k, (_, t) in enumerate(turns))

    turns = [("user", f"t{k}") for k in range(600)]
    text, spans, rewrites = locate(counted, turns)
    assert not rewrites and [text[s[4] : s[5]] for s in spans] == [t for _, t in turns]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, "user", None, "x"), (2, 0, None, "solo", "x"), (None, 0, "assistant", "n", "x"), (1, 2, "assistant", "c", "x"), (1, 2, "assistant", "c", "x")]
    out = {r.conv_id: r for r in chat_digests(format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert out[1].n_turns == 4 and out[1].loss_chars == 3
    assert out[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nc\nassistant\nc\n").hexdigest()
    assert out[1].loss_sha256 == hashlib.sha256(b"bcc").hexdigest()
    assert out[2].loss_chars == 0 and out[None].loss_chars == 1
    lost = [(None, 0, "user", f"n{k}", "x") for k in range(40)]
    assert sorted(r.n_turns for r in format_conversations(spark.createDataFrame(lost, SCHEMA)).transform(chat_digests).collect()) == [1] * 40


def test_empty(spark):
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
