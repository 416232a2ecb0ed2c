from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import hnsw, order_minhash
from tests.llm.cases import documents, frame


def brute(vectors: list[tuple[int, list[float]]], query: int, k: int) -> list[int]:
    q = np.array(dict(vectors)[query])
    found = sorted(((-float((np.array(v) * q).sum()), i) for i, v in vectors if i != query))
    return [i for _, i in found[:k]]


def test_hnsw_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(600)]
    rows += [(600 + i, rows[0][1]) for i in range(50)]  # copies: ties go to smaller ids
    odd = [(900, None), (901, [0.0] * 16), (902, [math.nan] * 16), (903, [1.0, None] * 8), (904, [1.0] * 3), (None, rows[1][1]), (5, rows[5][1])]
    frame_ = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(3)
    got = hnsw.nearest(frame_, F.col("vec_id") % 20 == 0, k=20, shard_size=150).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by) == {i for i in range(650) if i % 20 == 0}
    hits = sum(len(set(by[q]) & set(brute(rows, q, 20))) for q in by)
    assert hits >= 0.95 * 20 * len(by)
    assert by[0] == sorted(by[0], key=lambda i: brute(rows, 0, 649).index(i))
    table = dict(rows)
    assert all(r.score == pytest.approx(float((np.array(table[r.vec_id]) * np.array(table[r.query_id])).sum()), abs=1e-12) for r in got)


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in hnsw.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert hnsw.nearest(few.limit(0), F.col("vec_id") == 0).count() == 0
    assert hnsw.nearest(few.filter("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def distance(a: list[int], b: list[int]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


LISTS = st.lists(st.integers(0, 6), min_size=1, max_size=40)


@settings(max_examples=300, deadline=None)
@given(LISTS, st.lists(st.tuples(st.integers(0, 39), st.integers(0, 2), st.integers(0, 6)), max_size=9), st.integers(1, 45))
def test_alignment_is_exact(a, edits, band):
    b = list(a)
    for at, kind, value in edits:
        at = min(at, len(b))
        b[at : at + (kind > 0)] = [value] * (kind < 2)
    x, y = np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)
    true = distance(a, b)
    found = order_minhash.banded_distance(x, y, band)
    assert found == true if true <= band else found > band
    if b:
        assert order_minhash.similar(x, y) == (true <= 0.2 * max(len(a), len(b)) + 1e-9)
        assert order_minhash._anchored(x, y) >= true


def near_rows() -> list[tuple]:
    rng = random.Random(6)
    rows = documents()
    base = " ".join(f"w{rng.randint(0, 400)}" for _ in range(150)).split()
    for i in range(40):  # near copies of one text, one word in forty changed
        words = list(base)
        for _ in range(4):
            words[rng.randrange(150)] = f"x{rng.randint(0, 10**6)}"
        rows.append((300 + i, " ".join(words), "en", "s", 1, 1, 0.1, 1, ""))
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(30):  # clean texts that share a passage
        rows.append((400 + i, passage + " " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(90)), "en", "s", 1, 1, 0.1, 1, ""))
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    got = order_minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    words = [(r[1] or "").split() for r in rows]
    number = {w: i for i, w in enumerate({w for ws in words for w in ws})}
    arrays = [np.array([number[w] for w in ws], dtype=np.uint64) for ws in words]
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] == rows[j][1] and (rows[i][1] is not None or rows[i][0] == rows[j][0])
            if same or order_minhash.similar(arrays[i], arrays[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(root(i), []).append(rows[i][0])
    want = Counter((r[0], min((x for x in classes[root(i)] if x is not None), default=None)) for i, r in enumerate(rows))
    assert Counter((r.doc_id, r.class_id) for r in got) == want


def test_keep_one(spark):
    docs = frame(spark, near_rows())
    classes = order_minhash.near_duplicates(docs)
    kept = [r.doc_id for r in order_minhash.keep_one(docs, classes).collect()]
    assert sorted(kept, key=str) == sorted({r.class_id for r in classes.collect()}, key=str)
    assert sum(300 <= (i or 0) < 340 for i in kept) == 1 and sum(400 <= (i or 0) < 430 for i in kept) == 30
    assert order_minhash.near_duplicates(frame(spark, [])).count() == 0


def test_keep_one_of_null_and_repeated_ids(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(50)) for _ in range(12)]
    ids = [None] * 5 + [7] * 4 + [1, 2, 3]
    rows = [(i, t, "en", "s", 1, 1, 0.1, 1, "") for i, t in zip(ids, texts, strict=True)]
    rows += [(None, texts[0], "en", "t", 1, 1, 0.1, 1, ""), (7, texts[5] + " end", "en", "s", 1, 1, 0.1, 1, ""), (None, texts[9], "en", "s", 1, 1, 0.1, 1, "")]
    docs = frame(spark, rows)
    kept = order_minhash.keep_one(docs, order_minhash.near_duplicates(docs)).collect()
    assert len(kept) == 12 and {r.text.removesuffix(" end") for r in kept} == set(texts)
    assert Counter(r.doc_id for r in kept) == Counter(ids)


def scattered(rng: random.Random, n: int, changes: int, tag: str) -> tuple[str, str]:
    words = [f"{tag}{rng.randint(0, 4 * n)}" for _ in range(n)]
    other = list(words)
    for k in range(changes):  # evenly scattered, which breaks the most k-mers
        other[k * n // changes + rng.randrange(max(1, n // changes))] = f"new{tag}{k}"
    return " ".join(words), " ".join(other)


def test_isolated_pairs_with_scattered_changes(spark):
    rng = random.Random(12)
    rows, number = [], 0
    for n in (5, 10, 12, 20, 33, 41, 60, 150, 400):
        for changes in {max(1, n // 20), max(1, n // 10), max(1, n * 3 // 20), n // 5}:
            for _ in range(8):
                for text in scattered(rng, n, changes, f"t{number}x"):
                    rows.append((number, text, "en", "s", 1, 1, 0.1, 1, ""))
                    number += 1
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(frame(spark, rows)).collect()}
    missed = sum(got[i] != got[i + 1] for i in range(0, number, 2))
    assert missed == 0 and all(got[i] in (i, i - 1) for i in got)


def test_texts_that_first_meet_another(spark):
    """Each pair at 0.9 shares its beginning or end with a smaller id that is no link of either."""
    rng = random.Random(13)
    rows = []
    for g in range(40):
        left, right = scattered(rng, 100, 10, f"g{g}x")
        words = left.split()
        hub = " ".join(words[:55] + [f"h{g}y{i}" for i in range(45)])
        rows += [(g, hub, "en", "s", 1, 1, 0.1, 1, ""), (100 + g, left, "en", "s", 1, 1, 0.1, 1, ""), (200 + g, right, "en", "s", 1, 1, 0.1, 1, "")]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(frame(spark, rows)).collect()}
    assert all(got[g] == g and got[100 + g] == got[200 + g] == 100 + g for g in range(40))


def test_signatures_do_not_rule_out_similar_texts():
    rng = np.random.default_rng(3)
    for n in (4, 10, 30, 100, 400):
        for kind in range(3):
            for _ in range(60):
                a = rng.integers(0, 1 << 63, n, dtype=np.uint64) if kind < 2 else rng.integers(0, max(2, n // 20), n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                at = rng.choice(n, n // 5, replace=False)
                b = np.delete(a, at) if kind == 1 else a.copy()
                if kind != 1:
                    b[at] = rng.integers(0, 1 << 63, n // 5, dtype=np.uint64)
                rows = [np.frombuffer(order_minhash.signature(x), np.uint8)[None] for x in (a, b)]
                assert order_minhash.plausible(np.array([len(a)]), np.array([len(b)]), *rows)[0][0]
    far = [rng.integers(0, 1 << 63, 300, dtype=np.uint64) for _ in range(2)]
    assert not order_minhash.plausible(np.array([300]), np.array([300]), *[np.frombuffer(order_minhash.signature(x), np.uint8)[None] for x in far])[0][0]


def test_blocks_of_a_bucket_give_each_pair_once(spark, monkeypatch):
    """Chains of near copies whose ends are not similar, and strays among them, in blocks smaller than a bucket."""
    monkeypatch.setattr(order_minhash, "STRAYS", 4)
    monkeypatch.setattr(order_minhash, "TEXTS", 8)
    rng = random.Random(21)
    base = [f"w{i}" for i in range(100)]
    rows, number = [], 0
    for g in range(30):
        words = list(base)
        for _ in range(14):
            words[rng.randrange(100)] = f"g{g}x{rng.randint(0, 10**6)}"
        rows.append((number, " ".join(words), "en", "s", 1, 1, 0.1, 1, ""))
        number += 1
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(frame(spark, rows)).collect()}
    arrays = [np.array([hash(w) & 0x7FFFFFFF for w in r[1].split()], dtype=np.uint64) for r in rows]
    parent = list(range(number))
    for _ in range(number):  # labels spread along links
        for i in range(number):
            for j in range(i):
                if order_minhash.similar(arrays[i], arrays[j]):
                    parent[i] = parent[j] = min(parent[i], parent[j])
    assert got == dict(enumerate(parent))
