from __future__ import annotations

import base64
import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import byte_bpe, token_files
from tests.llm.cases import documents, frame

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 20), st.lists(st.integers(0, 2**20 - 1), max_size=60))
def test_pack_round_trip(bits, ids):
    ids = np.array(ids, dtype=np.uint32) & np.uint32((1 << bits) - 1)
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert (token_files.unpack(packed, bits, len(ids)) == ids).all()


def test_width():
    assert [token_files.width(n) for n in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_random_access():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 5000, n).astype(np.uint32) for n in (0, 3, 70, 1, 0, 45)]
    writer = token_files.Writer(13, block=16)
    writer.add(pa.array([10, 20, None]), np.concatenate(docs[:3]), np.array([len(d) for d in docs[:3]]))
    writer.add(pa.array([40, 50, 60]), np.concatenate(docs[3:]), np.array([len(d) for d in docs[3:]]))
    reader = token_files.Reader(io.BytesIO(b"".join(writer.parts())))
    assert reader.doc_ids.to_pylist() == [10, 20, None, 40, 50, 60]
    for i, d in enumerate(docs):
        assert (reader.document(i) == d).all()
    assert (reader.tokens(17, 50) == np.concatenate(docs)[17:50]).all()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbé'., \n!<|>şİ́日0ß\x1c sT", max_size=40))
def test_chunks_encode_as_whole_texts(text):
    encoder = token_files._encoder(WORD_BPE)
    whole = encoder.tokenizer.encode(text, add_special_tokens=False)
    assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == whole.ids


def test_files_read_back(spark):
    rows = [(r, t or "") for r, t, *_ in documents()]
    manifest = token_files.write_token_files(frame(spark), WORD_BPE, 49_408, 1)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.doc_no)
    assert [r.doc_no for r in got] == list(range(len(rows)))
    assert [r.doc_id for r in got] == sorted((r for r, _ in rows), key=lambda x: (x is not None, x))
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = {}
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        want.setdefault(doc_id, set()).add((len(ids), zlib.crc32(ids.tobytes())))
    start = 0
    for r in got:
        assert (r.n_tokens, r.ids_crc32) in want[r.doc_id] and r.start == start
        start += r.n_tokens


def test_empty_table(spark):
    empty = frame(spark, [])
    assert token_files.read_token_files(token_files.write_token_files(empty, WORD_BPE, 49_408, 1)).count() == 0
    assert byte_bpe.encode_and_digest(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_is_tiktoken(spark, plain, monkeypatch):
    rows = documents()
    got = byte_bpe.encode_documents(frame(spark), RANKS, public_tokenizers.PATTERN, keep=("source", "ids")).toDF("doc_id", "source", "other", "ids").collect()
    want = sorted((str(r[0]), str(r[3]), np.array(plain.encode_ordinary(r[1] or ""), dtype="<u4").tobytes()) for r in rows)
    assert sorted((str(r.doc_id), str(r.source), bytes(r.ids)) for r in got) == want
    assert {r.other for r in got} == {"z"}


def test_digests(spark, plain):
    want = sorted((hashlib.sha256(np.array(plain.encode_ordinary(r[1] or ""), dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in documents())
    got = byte_bpe.encode_and_digest(frame(spark), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.ids_sha256, r.decoded_sha256) for r in got) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB é'. \n\r\t!\x1c\x85  ᠎​日0٣ß-_", max_size=30))
def test_words_one_by_one(plain, text):
    words = byte_bpe.pre_tokens(text, public_tokenizers.PATTERN)
    assert "".join(words) == text
    ids = b"".join(byte_bpe.encode_word(w.encode(), RANKS, public_tokenizers.PATTERN) for w in words)
    assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text)
    assert byte_bpe.decode_ids(np.frombuffer(ids, "<u4"), RANKS) == text.encode()


def test_files_roll_by_size(spark):
    rows = documents(1500)
    manifest = token_files.write_token_files(frame(spark, rows), WORD_BPE, file_bytes=2000).cache()
    plain = token_files.write_token_files(frame(spark, rows), WORD_BPE)
    assert manifest.count() > plain.count()
    rolled = [(r.doc_no, r.doc_id, r.start, r.ids_crc32) for r in token_files.read_token_files(manifest).collect()]
    whole = [(r.doc_no, r.doc_id, r.start, r.ids_crc32) for r in token_files.read_token_files(plain).collect()]
    assert sorted(rolled, key=str) == sorted(whole, key=str)


def test_ids_beyond_the_width():
    with pytest.raises(ValueError, match="does not fit"):
        token_files.pack(np.array([1, 70_000], dtype=np.uint32), 16)


def test_ids_of_another_type(spark):
    named = spark.createDataFrame([("b", "the stone"), ("a", None)], "doc_id string, text string")
    got = token_files.read_token_files(token_files.write_token_files(named, WORD_BPE)).collect()
    assert [(r.doc_id, r.start) for r in sorted(got, key=lambda r: r.doc_no)] == [("a", 0), ("b", 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZéÀßÿ×÷ªµ́ \n.,", max_size=30), max_size=5))
def test_joined_ids_of_several_texts(texts):
    encoder = token_files._encoder(WORD_BPE)
    ids, counts = encoder.encode_joined([t.encode() for t in texts])
    whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in whole]
    assert ids.tolist() == [i for w in whole for i in w]


def test_tokenizer_of_other_steps(tmp_path):
    other = Tokenizer.from_file(WORD_BPE)
    other.normalizer = None
    other.save(str(tmp_path / "other.json"))
    encoder = token_files.ChunkEncoder(str(tmp_path / "other.json"))
    assert not encoder.by_chunk
    ids, counts = encoder.encode_joined([b"The Stone. ", b"", "Été".encode()])
    whole = [other.encode(t, add_special_tokens=False).ids for t in ("The Stone. ", "", "Été")]
    assert (ids.tolist(), counts.tolist()) == ([i for w in whole for i in w], [len(w) for w in whole])
