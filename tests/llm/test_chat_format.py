import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import chat_format
from tests.llm.helpers import pairs

TURNS = [
    (1, 0, "user", "hello <|end|> there"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "assistant", "<\\s> <\\\\s> <<SYS>> é文 <|body|>"),
    (2, None, None, "no role"), (2, 1, "assistant", "x" * 30_000), (3, 0, "assistant", "same turn b"), (3, 0, "assistant", "same turn a"), (3, 0, "assistant", "same turn a"), (None, 0, "assistant", "no conversation"), (4, 0, "<|body|>", "odd role"),
]


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, ids string")


def _want(turns):
    every = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    marks = sum(map(len, chat_format.MARKS))
    return len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(marks + len(chat_format.escape(r or "")) + len(chat_format.escape(t or "")) for r, t in turns)


def test_round_trip(spark):
    rows = {r.conv_id: tuple(r)[1:] for r in chat_format.digests(chat_format.format_turns(_frame(spark, TURNS))).collect()}
    turn = lambda c: [(r, t) for i, _, r, t in TURNS if i == c]
    for c in (1, 2, 4, None):
        assert rows[c] == _want(turn(c))
    assert rows[3] in [_want(o) for o in ([turn(3)[0], *turn(3)[1:]], [*turn(3)[1:], turn(3)[0]])]


def test_production_conversation(spark):
    rows = chat_format.production_conversations(_frame(spark, TURNS[:2]))
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_turns(rows)).collect()}
    text = "</s>[INST] ok [/INST]"
    assert tuple(got[-7])[1:] == _want([("user", text), ("assistant", text)])


def test_masks_and_marks(spark):
    for r in chat_format.format_turns(_frame(spark, TURNS)).collect():
        first = max(r.ids) - 2
        body, end = r.ids.index(first + 1), r.ids.index(first + 2)
        assert r.ids[0] == first and end == len(r.ids) - 1 and sum(i >= first for i in r.ids) == 3
        assert all(m == 0 for m in [*r.loss_mask[: body + 1], r.loss_mask[end]]) and len(set(r.loss_mask[body + 1 : end])) <= 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<[\\s>/INST]|a_b", max_size=40))
def test_escape_is_reversible_and_hides_marks(text):
    hidden = chat_format.escape(text)
    assert chat_format.unescape(hidden) == text
    assert not any(m in hidden for m in (*chat_format.MARKS, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_empty_table(spark):
    assert pairs(chat_format.digests(chat_format.format_turns(_frame(spark, []))), "conv_id") == []
