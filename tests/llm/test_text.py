from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import text as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t日.", max_size=30)), max_size=12))
def test_words_of_many_texts(texts):
    data, offsets = T.buffers(pa.array(texts, pa.string()))
    starts, ends = T.word_spans(data[offsets[0] : offsets[-1]], offsets[1:-1] - offsets[0])
    found = [bytes(data[s:e]).decode() for s, e in zip(starts, ends)]
    assert found == [w for t in texts for w in WORD.findall(t or "")]
    hashes = T.span_hashes(data[offsets[0] : offsets[-1]], starts, ends)
    assert len(set(hashes.tolist())) == len(set(found))


def test_sliced_column():
    column = pa.array(["aa", None, "bb cc", ""])[1:]
    data, offsets = T.buffers(column)
    assert [bytes(data[a:b]) for a, b in zip(offsets, offsets[1:])] == [b"", b"bb cc", b""]


def test_segments_do_not_change_hashes(monkeypatch):
    text = np.frombuffer(("word " * 50 + "x" * 400 + " end").encode(), dtype=np.uint8)
    whole = T.span_hashes(text, *T.word_spans(text))
    pieces = list(T.segments(text, 64))
    assert b"".join(p.tobytes() for p in pieces) == text.tobytes() and len(pieces) > 3
    parts = np.concatenate([T.span_hashes(p, *T.word_spans(p)) for p in pieces])
    assert (parts == whole).all()


def test_occurrences():
    assert T.occurrences(np.array([5, 7, 5, 5, 7], dtype=np.uint64)).tolist() == [0, 0, 1, 2, 1]


def test_hashes_have_no_pattern():
    """The doubling sequence and its complement collide under every polynomial modulo a power of two."""
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((one + two).encode(), dtype=np.uint8)
    a, b = T.span_hashes(data, np.array([0, 1024]), np.array([1024, 2048]))
    assert len(one) == 1024 and a != b


def test_long_spans_hash_as_short_ones(monkeypatch):
    data = np.frombuffer(bytes(range(33, 123)) * 50, dtype=np.uint8)
    starts, ends = np.array([0, 5, 5, 4000, 7]), np.array([4500, 5, 4400, 4010, 15])
    whole = T.span_hashes(data, starts, ends)
    monkeypatch.setattr(T, "SEGMENT", 64)
    assert (T.span_hashes(data, starts, ends) == whole).all() and len(set(whole.tolist())) == 5
