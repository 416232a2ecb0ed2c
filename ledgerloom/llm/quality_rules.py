"""Quality rules as a learned decision list.

Statistics of every whole text come from one vectorised pass. From the statistics of labelled documents,
sequential covering learns an ordered list of threshold conjunctions: each rule is grown condition by
condition on one part of the sample by information gain, with thresholds midway between values, pruned on
the other part, and kept while it is precise enough; what it covers is removed before the next rule is grown. The list is emitted as one
Spark conditional expression over the statistics.

Defined results: a null or empty text has no words and all statistics 0, so it fails the base rules;
rows are judged one by one, so repeated rows get the same verdict; with no labelled rows, or labels of one
kind only, the list is empty and keeps all that the base rules keep; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import text as T
from ledgerloom.llm.sampling import bounded_rows, held_out, one_label
from ledgerloom.shared import materialize

#: Bound of the labelled sample from which the list is learned.
MAX_LABELLED = 20_000

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_lower", "n_digits", "n_punct", "n_lines", "n_distinct_words",
)

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
_UPPER = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))
_LOWER = np.isin(np.arange(256), np.arange(ord("a"), ord("z") + 1))
_DIGIT = np.isin(np.arange(256), np.arange(ord("0"), ord("9") + 1))
_PUNCT = np.isin(np.arange(256), np.frombuffer(b"!?.,;:", dtype=np.uint8))
_CONTINUATION = (np.arange(256) & 0xC0) == 0x80


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    some = np.diff(offsets) > 0
    if some.any():
        out[some] = np.add.reduceat(flags, offsets[:-1][some], dtype=np.int64)
    return out


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: equals an earlier key; equals any other key."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    same = held[1:] == held[:-1]
    later, any_ = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return later, any_


def _salted(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes of the same text."""
    with np.errstate(over="ignore"):
        return T.mix(hashes + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All of ``COUNTS`` for the texts ``data[offsets[i]:offsets[i + 1]]``.

    A text by itself is hashed in segments, so beside its bytes and a few flags for each, only
    one number for each word and line is held.
    """
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets - base
    n = len(offsets) - 1
    out = {c: np.zeros(n, dtype=np.int64) for c in COUNTS}
    if not len(data):
        return out
    if n == 1:
        words = T.word_hashes(data)
        doc = np.zeros(len(words), dtype=np.int32)
    else:
        starts, ends = T.word_spans(data, offsets[1:-1])
        words = T.span_hashes(data, starts, ends)
        doc = np.searchsorted(offsets, starts, side="right") - 1
    inside = ~T.SEPARATOR[data]
    out["n_words"] = np.bincount(doc, minlength=n)
    out["word_chars"] = _per_text(inside & ~_CONTINUATION[data], offsets)
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_lower", _LOWER), ("n_digits", _DIGIT), ("n_punct", _PUNCT)):
        out[name] = _per_text(table[data], offsets)
    later, _ = _repeated(_salted(words, doc))
    out["n_distinct_words"] = out["n_words"] - np.bincount(doc[later], minlength=n)
    if len(words) >= 3:
        whole = doc[2:] == doc[:-2]
        with np.errstate(over="ignore"):
            window = (words[:-2] * np.uint64(3) + words[1:-1]) * np.uint64(0x9FB21C651E98DF25) + words[2:]
        at = np.flatnonzero(whole)
        _, twice = _repeated(_salted(T.mix(window[at]), doc[at]))
        marked = np.zeros(len(words), dtype=bool)
        for step in range(3):
            marked[at[twice] + step] = True
        out["n_repeat_words"] = np.bincount(doc[marked], minlength=n)
    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    limit = np.append(line_start[1:], len(data))
    line_end = np.where((limit > 0) & (data[np.maximum(limit - 1, 0)] == 0x0A), limit - 1, limit)
    # a text that ends in a line break, or an empty text, must not lend its end to the next one
    full = np.logical_or.reduceat(inside, line_start)
    line_start, line_end = line_start[full], line_end[full]
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    later, _ = _repeated(_salted(T.span_hashes(data, line_start, line_end), line_doc))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, ``COUNTS``) for each row of ``docs``."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.buffers(batch.column("text"))
            parts = [statistics(data, offsets[i : j + 1]) for i, j in T.groups(offsets)]
            if parts:
                columns = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in COUNTS]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *COUNTS])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


#: Statistics that rules may test: a numerator and a denominator of the counts.
FEATURES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "punct_share": ("n_punct", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] > self.threshold if self.above else values[self.feature] <= self.threshold

    def column(self) -> Column:
        top, bottom = FEATURES[self.feature]
        ratio = F.col(top) / F.greatest(F.col(bottom), F.lit(1))
        return ratio > self.threshold if self.above else ratio <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    n = len(next(iter(values.values())))
    out = np.ones(n, dtype=bool)
    for condition in rule:
        out &= condition.holds(values)
    return out


def _thresholds(column: np.ndarray, cuts: int) -> np.ndarray:
    """Midpoints between neighbouring values, at evenly spaced ranks and where the gap is widest."""
    held = np.unique(column)
    if len(held) < 2:
        return np.zeros(0)
    at = np.searchsorted(held, np.quantile(column, np.linspace(0, 1, cuts + 2)[1:-1]))
    at = np.concatenate([at, at - 1, np.argsort(-np.diff(held))[:2]])
    at = np.unique(at[(at >= 0) & (at < len(held) - 1)])
    return (held[at] + held[at + 1]) / 2


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, longest: int, cuts: int) -> Rule:
    """Add the condition of the largest information gain until no good document is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < longest and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for feature in FEATURES:
            column = values[feature][inside]
            for threshold in _thresholds(column, cuts):
                for above in (True, False):
                    take = column > threshold if above else column <= threshold
                    p, n = (take & bad[inside]).sum(), (take & ~bad[inside]).sum()
                    if p:
                        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if g > gain:
                            best, gain = Condition(feature, above, float(threshold)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(values)
    return tuple(rule)


def _prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop last conditions while (p - n) / (p + n) on the other part doesn't fall."""

    def worth(r: Rule) -> float:
        take = _covers(r, values)
        p, n = (take & bad).sum(), (take & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn_list(
    values: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, longest: int = 4, cuts: int = 48, most: int = 16
) -> list[Rule]:
    """The ordered rules that condemn a document; what no rule covers is kept.

    Every third document is held back for pruning; a rule must reach ``precision`` on all documents that
    are left, and cover at least 3 bad ones, so clean documents are rarely touched.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    prune_part = np.arange(len(bad)) % 3 == 2
    while len(rules) < most:
        grow_at, prune_at = left & ~prune_part, left & prune_part
        if not (grow_at & bad).any() or not (grow_at & ~bad).any():
            break
        rule = _grow({k: v[grow_at] for k, v in values.items()}, bad[grow_at], longest, cuts)
        if not rule:
            break
        rule = _prune(rule, {k: v[prune_at] for k, v in values.items()}, bad[prune_at])
        take = _covers(rule, values) & left
        hits = (take & bad).sum()
        if hits < 3 or hits < precision * take.sum():
            break
        rules.append(rule)
        left &= ~take
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: the first rule that holds condemns."""
    if not rules:
        return F.lit(True)
    out = None
    for rule in rules:
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.column()
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return out.otherwise(F.lit(True))


def base_failed() -> Column:
    """Too few words, or more than half of them in windows that repeat."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn_from(stats: DataFrame, labels: DataFrame, label_col: str = "quality", bound: int = MAX_LABELLED) -> list[Rule]:
    """Learn from at most ``bound`` labelled documents that pass the base rules and aren't held out."""
    labelled = one_label(labels.filter(~held_out(F.col("doc_id"))), label_col)
    joined = (
        stats.filter(~base_failed())
        .join(labelled, F.col("doc_id") == F.col("label_id"))
        .groupBy("label_id")  # one row of each id, however often it repeats
        .agg(F.min(F.struct("label", *COUNTS)).alias("r"))
        .select("label_id", "r.*")
    )
    rows = bounded_rows(materialize(joined, "labelled-statistics"), "label_id", bound)
    if not rows:
        return []
    held = {c: np.array([r[c] for r in rows]) for c in ("label", *COUNTS)}
    values = {name: held[top] / np.maximum(held[bottom], 1) for name, (top, bottom) in FEATURES.items()}
    return learn_list(values, held["label"] == 0)


def apply_quality_rules(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` for every row of ``docs``."""
    stats = materialize(document_statistics(docs), "quality-statistics")
    rules = learn_from(stats, labels, bound=bound)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))

