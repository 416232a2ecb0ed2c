"""Quality classification by nearest-neighbour voting on latent-semantic vectors.

Pieces of a text's bytes and of its shape (letters, digits and white space folded to classes) hash to a
fixed number of terms. Weighted counts of labelled documents are factored once, by a truncated singular
value decomposition in numpy; the labelled documents' vectors, at most ``MAX_LABELLED`` of them, and the
projection have a fixed largest size and are broadcast. Every document is projected, its cosines with
all labelled vectors are computed exactly, in blocks, and the labels of the nearest vote with weights that
rise with similarity.

Defined results: a null text is an empty one; a text without pieces has no neighbours and gets the share
of label 1 among the labelled; with no labels the score is 0.5; repeated rows get equal results; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import text as T
from ledgerloom.llm.sampling import bounded_rows, held_out, one_label
from ledgerloom.shared import materialize

#: Hashed terms: half of them for shapes, half for bytes.
HALF = 1024
TERMS = 2 * HALF
#: Bound of the labelled sample.
MAX_LABELLED = 3000
RANK = 48
NEIGHBOURS = 15
#: Rows whose cosines are computed at once.
BLOCK = 1024

# Classes of bytes: white space, line break, lower case, upper case, digit; other ASCII signs stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[[0x09, 0x0B, 0x0C, 0x0D]] = 0x20
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[0x80:] = ord("a")


def _terms(data: np.ndarray) -> list[np.ndarray]:
    """Term of each shape 4-gram and each byte 3-gram, at the byte it starts at."""
    with np.errstate(over="ignore"):
        s = _SHAPE[data]
        shape = ((s[:-3] << np.uint64(24)) | (s[1:-2] << np.uint64(16)) | (s[2:-1] << np.uint64(8)) | s[3:]) * np.uint64(0x9E3779B97F4A7C15)
        d = data.astype(np.uint64)
        raw = ((d[:-2] << np.uint64(16)) | (d[1:-1] << np.uint64(8)) | d[2:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return [(shape >> np.uint64(54)).astype(np.int64), (raw >> np.uint64(54)).astype(np.int64) + HALF]


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term counts for each text of a buffer, float32 (texts, TERMS)."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), dtype=np.float32)
    if n == 1:
        for piece in T.segments(data[offsets[0] : offsets[1]]):
            for terms in _terms(piece) if len(piece) >= 4 else []:
                out[0] += np.bincount(terms, minlength=TERMS)
        return out
    chunk, inner = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    if len(chunk) < 4:
        return out
    doc = np.repeat(np.arange(n), np.diff(inner))
    for terms, size in zip(_terms(chunk), (4, 3), strict=True):
        whole = doc[: len(terms)] == doc[size - 1 :][: len(terms)]
        flat = doc[: len(terms)][whole] * TERMS + terms[whole]
        out += np.bincount(flat, minlength=n * TERMS).reshape(n, TERMS)
    return out


def _weigh(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of the terms' shares, weighted; both halves of equal length."""
    out = np.sqrt(c) * idf
    for half in (slice(0, HALF), slice(HALF, TERMS)):
        norm = np.linalg.norm(out[:, half], axis=1, keepdims=True)
        out[:, half] /= np.where(norm > 0, norm, 1)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    idf: np.ndarray
    mean: np.ndarray
    projection: np.ndarray  # (TERMS, RANK)
    vectors: np.ndarray  # (labelled, RANK), unit length
    labels: np.ndarray
    prior: float


def fit(term_counts: np.ndarray, labels: np.ndarray, rank: int = RANK, seed: int = 11) -> Model:
    """Truncated decomposition by subspace iteration with a fixed seed."""
    present = (term_counts > 0).sum(axis=0)
    idf = (np.log((1 + len(labels)) / (1 + present)) + 0.5).astype(np.float32)
    x = _weigh(term_counts, idf)
    mean = x.mean(axis=0)
    x = x - mean
    rng = np.random.default_rng(seed)
    basis = rng.normal(size=(TERMS, min(rank + 8, max(1, len(labels))))).astype(np.float32)
    for _ in range(5):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    projection = (basis @ turn.T)[:, :rank].astype(np.float32)
    return Model(idf, mean, projection, _unit(x @ projection).astype(np.float32), labels.astype(np.float32), float(labels.mean()))


def score_counts(model: Model, term_counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors."""
    out = np.full(len(term_counts), model.prior)
    some = np.flatnonzero(term_counts.any(axis=1))
    k = min(neighbours, len(model.labels))
    for at in range(0, len(some), BLOCK):
        rows = some[at : at + BLOCK]
        vectors = _unit((_weigh(term_counts[rows], model.idf) - model.mean) @ model.projection)
        cosine = vectors @ model.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0.0).astype(np.float64) ** 4 + 1e-9
        out[rows] = (weight * model.labels[near]).sum(axis=1) / weight.sum(axis=1)
    return np.clip(out, 0.0, 1.0)


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit on at most ``bound`` labelled documents outside the held-out fold; the rarer label fills up to half of them."""
    labelled = one_label(labels.filter(~held_out(F.col("doc_id"))), label_col)
    half = bound // 2
    present = labelled.join(docs.select(F.col(id_col).alias("label_id")), "label_id", "left_semi")
    present = materialize(present, "labelled-ids")
    picks = []
    for value in (0, 1):
        rows = bounded_rows(present.filter(F.col("label") == value), "label_id", bound)
        picks.append([(r.label_id, r.label) for r in rows])
    few, many = sorted(picks, key=len)
    few = few[:half]
    chosen = few + many[: bound - len(few)]
    if not chosen:
        return None
    spark = docs.sparkSession
    kind = labels.schema["doc_id"].dataType.simpleString()
    small = F.broadcast(spark.createDataFrame(chosen, f"sample_id {kind}, label int"))
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(small, F.col("id") == F.col("sample_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.buffers(batch.column("text"))
            rows = [counts(data, offsets[i : j + 1]) for i, j in T.groups(offsets)]
            packed = [r.astype("<f4").tobytes() for part in rows for r in part]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(packed, pa.binary())], names=["id", "label", "terms"])

    dense = picked.select(F.col("id").cast("string").alias("id"), "label", "text").mapInArrow(run, "id string, label int, terms binary")
    # one row of each id, however often an id repeats
    found = dense.groupBy("id").agg(F.min(F.struct("label", "terms")).alias("r")).select("id", "r.*").collect()
    found.sort(key=lambda r: r.id)
    if not found:
        return None
    matrix = np.stack([np.frombuffer(r.terms, "<f4") for r in found])
    return fit(matrix, np.array([r.label for r in found]))


def classify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with quality_score added at the end, in place of a column of this name."""
    docs = docs.drop("quality_score")
    handle = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = handle.value
        for batch in batches:
            data, offsets = T.buffers(batch.column(text_col))
            score = np.full(len(offsets) - 1, 0.5)
            if fitted is not None:
                for i, j in T.groups(offsets):
                    score[i:j] = score_counts(fitted, counts(data, offsets[i : j + 1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*names, "quality_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, quality_score double")
