from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import chat

PIECES = st.sampled_from(["<", "|", "end", "turn", "says", "|>", ">", "\\", "[", "INST]", "/", "s", "<SYS>>", "<|end|>", "<|says|>", "<|turn|>", "\n", " ", "a_b", "é"])
TEXTS = st.lists(PIECES, max_size=9).map("".join)


@settings(max_examples=500, deadline=None)
@given(TEXTS, TEXTS)
def test_round_trip(role, text):
    assert chat.unescape(chat.escape(text)) == text
    rendered, start, end = chat.render_turn(role, text)
    assert chat.parse(rendered * 2) == [(role, text)] * 2
    assert chat.unescape(rendered[start:end]) == text


def test_plain_text_is_untouched():
    assert chat.render_turn("user", "hello < world > [x]")[0] == "<|turn|>user<|says|>hello < world > [x]<|end|>\n"


def test_conversations(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "assistant", None), (2, 1, "assistant", "b"), (2, 0, None, "<|end|>"),
        (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (None, 0, "user", ""), (3, 0, "assistant", "x" * 5000),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'n' as n_turns", "1 as part")
    got = {r.conv_id: r for r in chat.read_conversations(chat.format_conversations(frame, part_chars=60)).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv in got:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == sum(len(chat.render_turn(r, x)[0]) for _, r, x in turns)
    assert chat.write_and_read(frame.limit(0)).count() == 0
