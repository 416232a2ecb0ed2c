"""The registered queries themselves, on small tables of the same shape as the real ones."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from ledgerloom.llm import queries
from tests.llm.cases import documents

TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "[/INST] </s>"), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, "assistant", "alone")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rows = [r[:5] for r in documents(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string").write.parquet(f"{root}/conversations.parquet")
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(100)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{root}/embeddings.parquet")
    return root, rows, dict(vectors)


def test_all_are_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [*(f"op{n}" for n in range(1, 11)), "pipeline"]


def test_op1(spark, tables):
    root, rows, _ = tables
    got = sorted(queries.op1_token_files(spark, root).collect(), key=lambda r: r.doc_no)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got][:-1]]).tolist()


def test_op2_op4_op8_columns(spark, tables):
    root, rows, _ = tables
    for name, columns in (
        ("op2_language_id", ["doc_id", "held_out", "lang_pred", "score"]),
        ("op4_quality_rules", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]),
        ("op8_quality_knn", ["doc_id", "held_out", "score", "predicted"]),
    ):
        got = queries.queries()[name](spark, root)
        assert got.columns[: len(columns)] == columns
        found = got.collect()
        assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
        if "held_out" in columns:
            assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
        if "predicted" in columns:
            assert all(r.predicted == int(r.score >= 0.7) for r in found)


def test_op3_has_the_planted_conversation(spark, tables):
    root, _, _ = tables
    got = {r.conv_id: r for r in queries.op3_chat_format(spark, root).collect()}
    said = "</s>[INST] ok [/INST]"
    planted = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    for conv in (-7, 1, 2, 3):
        turns = [t for t in TURNS + planted if t[0] == conv]
        loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3] or ''}\n" for t in turns)
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()) and r.formatted_chars > len(loss)
    assert set(got) == {-7, 1, 2, 3}


def test_op5_law(spark, tables):
    root, rows, _ = tables
    got = queries.op5_sharding(spark, root).collect()
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and len(got) == len(rows)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_op6_op7_op10(spark, tables):
    root, rows, _ = tables
    coded = queries.op6_byte_bpe(spark, root).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in coded) == Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    mixed = queries.op7_mixing(spark, root).collect()
    assert mixed and all(0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in mixed) and Counter(r.doc_id for r in mixed) == Counter(r[0] for r in rows)
    classes = queries.op10_order_minhash(spark, root).collect()
    assert Counter(r.doc_id for r in classes) == Counter(r[0] for r in rows)


def test_op9(spark, tables):
    root, _, vectors = tables
    got = queries.op9_hnsw(spark, root).collect()
    for query in range(0, 100, 20):
        q = np.array(vectors[query], dtype=float)
        want = sorted((-float((np.array(v, dtype=float) * q).sum()), i) for i, v in vectors.items() if i != query)[:20]
        mine = sorted((r["rank"], r.vec_id) for r in got if r.query_id == query)
        assert [i for _, i in mine] == [i for _, i in want]
