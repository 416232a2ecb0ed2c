"""Language identification by averaged hashed subword embeddings and a linear softmax.

Every 2-, 3- and 4-byte piece of a text's letters, with white space marking word ends, hashes to an
embedding. A text is the mean of its pieces' embeddings, and a linear softmax on that mean gives the
languages. Both layers are trained together by stochastic gradient descent in numpy. A temperature fitted
on documents held back from training calibrates the probabilities. Two thresholds reject a text: its best
calibrated probability, and its familiarity, the mean logarithm of its pieces' share among all pieces trained on, which
tells strings that are no language from confident guesses. Each is the ``RISK`` quantile of the held-back
documents that are labelled correctly, less a tenth of the way to what chance would give, so that
of clean documents about that share is lost.

As mean and softmax layer are linear, prediction folds both into one score per piece and language, with one more
column for the familiarity, and averages those over the whole text.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; a table
with no usable label gives ``und`` for all; repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import text as T
from ledgerloom.llm.sampling import held_out

BUCKETS = 1 << 14
DIMENSIONS = 16
#: Bound of the labelled sample for each language.
MAX_PER_LANGUAGE = 400
SIZES = (2, 3, 4)
#: Share of correctly labelled documents that each threshold may reject, about.
RISK = 0.001
LETTER = regex.compile(r"\p{L}")

# ASCII letters in lower case, bytes of other characters as they are, all else a word end.
_FOLD = np.full(256, 0x20, dtype=np.uint64)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the pieces that start at each byte, one array for each size."""
    folded = _FOLD[data]
    key = folded.copy()
    for size in range(2, max(SIZES) + 1):
        key = (key[:-1] << np.uint64(8)) | folded[size - 1 :]
        if size in SIZES:
            with np.errstate(over="ignore"):
                mixed = (key + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
            yield (mixed >> np.uint64(64 - 14)).astype(np.int32)


def histogram(data: np.ndarray) -> np.ndarray:
    """Counts of one text's pieces by bucket."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    for piece in T.segments(data):
        for buckets in _pieces(piece):
            out += np.bincount(buckets, minlength=BUCKETS)
    return out


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (BUCKETS, languages + 1): a piece's share of each language's logit, and its familiarity
    bias: np.ndarray
    temperature: float
    threshold: float
    least_familiar: float
    calibration_error: float  # of held-back documents, before any is rejected


def expected_calibration_error(prob: np.ndarray, right: np.ndarray, bins: int = 10) -> float:
    """Mean gap between confidence and accuracy over bins of confidence, by their sizes."""
    at = np.minimum((prob * bins).astype(int), bins - 1)
    size = np.bincount(at, minlength=bins)
    gap = np.abs(np.bincount(at, prob, bins) - np.bincount(at, right, bins))
    return float(gap.sum() / max(size.sum(), 1))


def train(
    texts: list[tuple[np.ndarray, np.ndarray]], targets: list[str], epochs: int = 12, rate: float = 8.0, batch: int = 16, seed: int = 5
) -> Model:
    """Fit on sparse histograms (buckets, counts); every fifth text is held back for calibration."""
    languages = sorted(set(targets))
    y = np.array([languages.index(t) for t in targets])
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, len(languages)), dtype=np.float32)
    weights += rng.normal(0, 0.1, weights.shape).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    back = np.arange(len(y)) % 5 == 4
    fit, held = np.flatnonzero(~back), np.flatnonzero(back)
    if not len(fit):
        fit = held
    shares = [(c / max(c.sum(), 1)).astype(np.float32) for _, c in texts]
    inverse = 1.0 / np.maximum(np.bincount(y[fit], minlength=len(languages)), 1)
    inverse *= len(languages) / inverse.sum() if inverse.sum() else 1

    def means(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows = np.concatenate([np.full(len(texts[i][0]), k) for k, i in enumerate(at)]).astype(np.int64)
        buckets = np.concatenate([texts[i][0] for i in at]).astype(np.int64)
        share = np.concatenate([shares[i] for i in at])
        mean = np.zeros((len(at), DIMENSIONS), dtype=np.float32)
        np.add.at(mean, rows, embeddings[buckets] * share[:, None])
        return mean, rows, buckets, share

    def softmax(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // batch)):
            mean, rows, buckets, share = means(at)
            error = softmax(mean @ weights + bias)
            error[np.arange(len(at)), y[at]] -= 1
            error *= inverse[y[at]][:, None] / len(at)
            to_mean = error @ weights.T
            weights -= np.float32(step / 8) * (mean.T @ error)
            bias -= np.float32(step / 80) * error.sum(axis=0)
            np.subtract.at(embeddings, buckets, np.float32(step * 8) * share[:, None] * to_mean[rows])
    trained = np.zeros(BUCKETS)
    for i in fit:
        np.add.at(trained, texts[i][0], shares[i])
    familiar = np.log((trained + 1e-3) / (trained.sum() + 1e-3 * BUCKETS)).astype(np.float32)
    scores = np.hstack([embeddings @ weights, familiar[:, None]])
    temperature, threshold, least_familiar, error = 1.0, 0.0, -np.inf, 0.0
    if len(held):
        logits = np.concatenate([means(np.array([i]))[0] for i in held]) @ weights + bias
        options = np.geomspace(0.02, 20, 121)
        losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(held)), y[held]], 1e-9)).mean() for t in options]
        temperature = float(options[int(np.argmin(losses))])
        prob = softmax(logits / temperature)
        right = prob.argmax(axis=1) == y[held]
        error = expected_calibration_error(prob.max(axis=1), right)
        if right.any():
            chance = 1 / len(languages)
            low = float(np.quantile(prob.max(axis=1)[right], RISK))
            threshold = min(low - (low - chance) / 10, 1.0)
            known = np.array([float((familiar[texts[i][0]] * shares[i]).sum()) for i in held])[right]
            low = float(np.quantile(known, RISK))
            least_familiar = low - (low - np.log(1 / BUCKETS)) / 10 if low > np.log(1 / BUCKETS) else low
    return Model(languages, scores.astype(np.float32), bias, temperature, threshold, float(least_familiar), error)


def predict(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated probabilities and familiarity for each text of a buffer, over whole texts."""
    n, k = len(offsets) - 1, len(model.languages) + 1
    sums, pieces = np.zeros((n, k)), np.zeros(n)
    for i, j in T.groups(offsets):
        whole = [data[offsets[i] : offsets[j]]] if j - i > 1 else T.segments(data[offsets[i] : offsets[j]])
        for chunk in whole:
            inner = offsets[i : j + 1] - offsets[i] if j - i > 1 else np.array([0, len(chunk)])
            for size, buckets in zip(SIZES, _pieces(chunk), strict=False):
                # a piece belongs to the text it starts in, if it ends there too
                first = np.minimum(inner[:-1], len(buckets))
                last = np.clip(inner[1:] - size + 1, first, len(buckets))
                pieces[i:j] += last - first
                for lang in range(k):
                    sums_to = np.zeros(len(buckets) + 1)
                    np.cumsum(model.scores[:, lang][buckets], out=sums_to[1:])
                    sums[i:j, lang] += sums_to[last] - sums_to[first]
    means = sums / np.maximum(pieces, 1)[:, None]
    logits = (means[:, :-1] + model.bias) / model.temperature
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True), means[:, -1]


def fit_languages(docs: DataFrame, bound: int = MAX_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Train on at most ``bound`` documents of each language outside the held-out fold.

    Ids are counted by language first, and a hash chooses the matching share of each, so what is sent
    follows the bound, not the table; the executors turn the chosen texts into histograms of fixed size,
    and only those reach the driver. One row of each id is used, however often it repeats.
    """
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    counted = usable.groupBy(F.col(lang_col).cast("string").alias("l")).agg(F.approx_count_distinct(id_col).alias("n")).collect()  # one row per language
    wide = 1 << 31
    order = F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(wide))
    limit = F.lit(0)
    for r in counted:
        limit = F.when(F.col(lang_col).cast("string") == r.l, int(min(1.0, (1.2 * bound + 40) / max(r.n, 1)) * wide)).otherwise(limit)
    picked = usable.filter(order < limit).select(F.col(id_col), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), order.alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.buffers(batch.column("text"))
            buckets, counts = [], []
            for i in range(len(offsets) - 1):
                h = histogram(data[offsets[i] : offsets[i + 1]])
                at = np.flatnonzero(h)
                buckets.append(at.astype("<i4").tobytes())
                counts.append(h[at].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "lang", "place")), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())],
                names=["id", "lang", "place", "buckets", "counts"],
            )

    sparse = picked.select(F.col(id_col).cast("string").alias("id"), "lang", "place", "text").mapInArrow(run, "id string, lang string, place long, buckets binary, counts binary")
    found = sparse.groupBy("id").agg(F.min(F.struct("lang", "place", "buckets", "counts")).alias("r")).select("id", "r.*").collect()
    rows, taken = [], dict.fromkeys((r.l for r in counted), 0)
    for r in sorted(found, key=lambda r: (r.place, r.id)):
        if len(r.buckets) and taken[r.lang] < bound:
            rows.append(r)
            taken[r.lang] += 1
    if not rows:
        return None
    shuffled = np.random.default_rng(1).permutation(len(rows))
    rows = [rows[i] for i in shuffled]
    texts = [(np.frombuffer(r.buckets, "<i4"), np.frombuffer(r.counts, "<i8")) for r in rows]
    return train(texts, [r.lang for r in rows])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and accepted added at the end, in place of columns of these names."""
    docs = docs.drop("lang_pred", "score", "accepted")
    handle = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = handle.value
        for batch in batches:
            column = batch.column(text_col)
            lettered = np.array([x is not None and LETTER.search(x) is not None for x in column.to_pylist()], dtype=bool)
            if fitted is None or not len(lettered):
                best, score = np.zeros(len(lettered), dtype=int), np.zeros(len(lettered))
                lettered[:] = trusted = False
            else:
                prob, known = predict(fitted, *T.buffers(column))
                best, score = prob.argmax(axis=1), prob.max(axis=1)
                trusted = (score >= fitted.threshold) & (known >= fitted.least_familiar)
            score = np.where(lettered, score, 0.0)
            pred = [fitted.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
            accepted = lettered & trusted
            extra = [pa.array(pred, pa.string()), pa.array(score), pa.array(accepted)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, "lang_pred", "score", "accepted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, accepted boolean")
