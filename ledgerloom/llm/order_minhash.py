"""Near-duplicates by Order MinHash with banded alignment.

A pair is a link if its word edit similarity, 1 - distance / longer length, is at least 0.8 as the banded
alignment of the whole word sequences finds it. Candidates are texts that share a sample: each hash function takes the
three k-mers of smallest value, k-mers being labelled with how many equal ones stand before them. Texts of at
least 32 words are sampled by two words in a row, which carry the order, in 100 hashes; those of 4 to 40 by
single words in 40. A sample is a set: equal k-mers change their label when an earlier one goes, and with it
their order, so ordered samples would miss links.

An edit takes at most one word, or two pairs of words, from each side. So two texts of n words at similarity 0.8 exactly,
with all changes apart, share a sample with a probability of 0.999 or more, and more similar ones nearly surely.
Two texts that are similar enough hold at least 0.8 of the longer one's labelled words in common. A signature tells
how many they hold: exactly for up to eight words that a text repeats often, and for all others by the smallest
labelled word of each of 256 bins; pairs four standard errors below what their lengths demand, which loses about 3 of
100,000 at 0.8, are not aligned.

Exact copies are one node. A bucket, the texts that share a sample, doesn't emit all its pairs. First each text meets
the first texts of its buckets, and is aligned with the one whose signature is nearest. Then, after components are
formed, the texts of a bucket that lie outside its largest component are held against all of the bucket in blocks, by
lengths and signatures, each pair in the smallest bucket that both share, and pairs of different components
that pass are aligned, until their components are one. So every pair of a bucket is in one class or compared.

Defined results: a null text is a class of its own for each row; texts without words are equal only to exact
copies; a text of fewer than five words is one k-mer; repeated rows are in one class and each get a row;
a null id stands in a class but never names one with other ids; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import text as T
from ledgerloom.shared import materialize, release

SAMPLE = 3
SIMILARITY = 0.8
#: Texts of fewer words are similar only to equal sequences.
LEAST_WORDS = 4
#: Texts up to so many words are sampled by words, texts from so many on by two words in a row. At 0.8 the shorter
#: of a pair has four fifths of the longer's words, so every pair has a kind of sample in common.
SHORT, LONG = 40, 32
SHORT_HASHES, LONG_HASHES = 40, 100
#: Bins of a signature, a byte each; words counted exactly, and how often these occur at least.
BINS, OFTEN, HEAVY = 256, 8, 16
_WIDE = BINS + 8 * OFTEN
#: Standard errors that a signature may lie below what the lengths demand.
ERRORS = 4.0
#: Strays and texts of a bucket that one block holds against each other.
STRAYS, TEXTS = 512, 1024
#: Texts, about, along each side of a cell of pairs that are aligned together.
CELL = 128
#: K-mers hashed at once, and pairs of signatures compared at once.
_BLOCK = 1 << 14

_rng = np.random.default_rng(97)
_HASHES = SHORT_HASHES + LONG_HASHES
_XOR = _rng.integers(0, 1 << 32, _HASHES, dtype=np.uint32)
_MULTIPLY = _rng.integers(0, 1 << 31, _HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SLOT = T.mix(np.arange(1, _HASHES + 1, dtype=np.uint64))


def _smallest(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the ``most`` smallest of each row, the leftmost on ties; changes ``values``."""
    rows = np.arange(len(values))
    places, held = [], []
    for _ in range(min(most, values.shape[1])):
        at = values.argmin(axis=1)
        places.append(at)
        held.append(values[rows, at])
        values[rows, at] = np.uint32(0xFFFFFFFF)
    return np.stack(places, axis=1), np.stack(held, axis=1)


def _labelled(kmers: np.ndarray) -> np.ndarray:
    """K-mers told apart by how many equal ones stand before them."""
    with np.errstate(over="ignore"):
        return T.mix(kmers + T.occurrences(kmers).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _samples(kmers: np.ndarray, hashes: slice, size: int) -> np.ndarray:
    """Places of the ``size`` labelled k-mers of smallest value, a row for each hash function."""
    short = (kmers >> np.uint64(32)).astype(np.uint32)
    places, values = [], []
    with np.errstate(over="ignore"):
        for at in range(0, len(short), _BLOCK):
            hashed = (short[None, at : at + _BLOCK] ^ _XOR[hashes, None]) * _MULTIPLY[hashes, None]
            p, v = _smallest(hashed, size)
            places.append(p + at)
            values.append(v)
    place = np.concatenate(places, axis=1)
    if len(places) > 1:
        best, _ = _smallest(np.concatenate(values, axis=1), size)
        place = np.take_along_axis(place, best, axis=1)
    return place


def _keys(kmers: np.ndarray, hashes: slice) -> np.ndarray:
    place = _samples(kmers, hashes, SAMPLE)
    key = _SLOT[hashes].copy()
    with np.errstate(over="ignore"):
        for column in range(place.shape[1]):
            key = T.mix(key * np.uint64(0x9FB21C651E98DF25) + kmers[place[:, column]])
    return key


def sketch(words: np.ndarray) -> np.ndarray:
    """The 64-bit samples of a text; none for a text without words."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    if len(words) < LEAST_WORDS:
        return T.shingle_hashes(words, LEAST_WORDS)
    keys = []
    if len(words) <= SHORT:
        keys.append(_keys(_labelled(T.shingle_hashes(words, 1)), slice(0, SHORT_HASHES)))
    if len(words) >= LONG:
        keys.append(_keys(_labelled(T.shingle_hashes(words, 2)), slice(SHORT_HASHES, _HASHES)))
    return np.concatenate(keys)


def signature(words: np.ndarray) -> bytes:
    """Bins and often repeated words of a text.

    For each bin a byte, never 0, of its smallest labelled word, 0 if it is empty; then the hash and number, 32 bits each,
    of the most frequent words, most frequent first, whose occurrences are in no bin.
    """
    bins, often = np.zeros(BINS, dtype=np.uint8), np.zeros((OFTEN, 2), dtype="<u4")
    if len(words) >= HEAVY:
        found, times = np.unique(words, return_counts=True)
        top = np.lexsort((found, -times))[:OFTEN]
        top = top[times[top] >= HEAVY]
        if len(top):
            often[: len(top), 0], often[: len(top), 1] = found[top] >> np.uint64(32), times[top]
            words = words[~np.isin(words, found[top])]
    if len(words):
        values = np.sort(_labelled(T.shingle_hashes(words, 1)))
        at = (values >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        bins[at[first]] = values[first] % np.uint64(255) + np.uint64(1)
    return bins.tobytes() + often.tobytes()


def _in_reach(n_a: np.ndarray, n_b: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Whether lengths allow the similarity."""
    return np.minimum(n_a, n_b) >= np.floor(least * np.maximum(n_a, n_b))


def plausible(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of texts, by lengths and signatures (rows of bytes): whether they may be similar, and the share of words they seem to hold in common."""
    longest = np.maximum(n_a, n_b)
    needed = np.ceil(least * longest - 1e-9)
    left, right = n_a, n_b  # words in bins
    sure = np.zeros(len(n_a))
    some = np.flatnonzero(a[:, BINS + 4 :].any(axis=1) | b[:, BINS + 4 :].any(axis=1))
    if len(some):
        (hash_a, times_a), (hash_b, times_b) = (np.moveaxis(np.ascontiguousarray(x[some, BINS:]).view("<u4").reshape(len(some), OFTEN, 2).astype(np.int64), 2, 0) for x in (a, b))
        same = (hash_a[:, :, None] == hash_b[:, None, :]) & (times_a[:, :, None] > 0) & (times_b[:, None, :] > 0)
        sure[some] = (np.minimum(times_a[:, :, None], times_b[:, None, :]) * same).sum(axis=(1, 2))
        left, right = left.copy(), right.copy()
        left[some] -= times_a.sum(axis=1)
        right[some] -= times_b.sum(axis=1)
        # a word listed on one side only occurs no more often on the other than the least one listed there, and only in bins
        most_a, most_b = (np.where(t[:, -1] > 0, t[:, -1], HEAVY - 1)[:, None] for t in (times_a, times_b))
        needed[some] -= sure[some] + np.minimum((np.minimum(times_a, most_b) * ~same.any(axis=2)).sum(axis=1), right[some])
        needed[some] -= np.minimum((np.minimum(times_b, most_a) * ~same.any(axis=1)).sum(axis=1), left[some])
    a, b = a[:, :BINS], b[:, :BINS]
    agree = ((a == b) & (a > 0)).sum(axis=1)
    used = ((a | b) > 0).sum(axis=1)
    union = np.maximum(left + right - needed, 1)
    share = np.clip(needed / union, 0.0, 1.0)
    # bins draw from the union without repetition, hence the factor for a finite one
    finite = np.clip((union - used) / np.maximum(union - 1, 1), 0.02, 1.0)
    bound = used * share - ERRORS * np.sqrt(used * share * (1 - share) * finite) - 1
    held = agree / np.maximum(used, 1)
    possible = (needed <= np.minimum(left, right)) & _in_reach(n_a, n_b, least)
    return possible & (agree >= bound), (sure + held / (1 + held) * (left + right)) / np.maximum(longest, 1)


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the common beginning and end, which some best alignment keeps."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    return a[: len(a) - tail], b[: len(b) - tail]


def _in_common(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common, repeats counted."""
    left, n_left = np.unique(a, return_counts=True)
    right, n_right = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    return int(np.minimum(n_left[i], n_right[j]).sum())


def _anchored(a: np.ndarray, b: np.ndarray, k: int = 3) -> int:
    """Cost of one valid alignment: occurrence-labelled k-mers of both as anchors in rising order, all between them replaced."""
    if min(len(a), len(b)) < k:
        return max(len(a), len(b))
    ka, kb = (_labelled(T.shingle_hashes(x, k)) for x in (a, b))
    ia, ib = np.argsort(ka), np.argsort(kb)
    _, x, y = np.intersect1d(ka[ia], kb[ib], assume_unique=True, return_indices=True)
    i, j = ia[x], ib[y]
    order = np.argsort(i)
    i, j = i[order], j[order]
    if len(j) > 1 and (np.diff(j) < 0).any():
        tails: list[int] = []
        at: list[int] = []
        before = [-1] * len(j)
        for n, value in enumerate(j.tolist()):
            place = bisect_left(tails, value)
            before[n] = at[place - 1] if place else -1
            tails[place : place + 1] = [value]
            at[place : place + 1] = [n]
        chain, n = [], at[-1]
        while n >= 0:
            chain.append(n)
            n = before[n]
        i, j = i[chain[::-1]], j[chain[::-1]]
    gap_a = np.diff(np.concatenate([[-1], i, [len(a)]])) - 1
    gap_b = np.diff(np.concatenate([[-1], j, [len(b)]])) - 1
    # the words behind an anchor's first are equal on both sides, as far as the gap reaches
    equal = np.minimum(np.minimum(gap_a, gap_b), k - 1)
    equal[0] = 0
    return int((np.maximum(gap_a, gap_b) - equal).sum())


def banded_distance(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Word edit distance if it is at most ``band``; else something larger than ``band``."""
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return band + 1
    width = 2 * band + 1
    steps = np.arange(width)
    far = n + m + 1
    padded = np.zeros(m + 2 * width, dtype=a.dtype)
    padded[width : width + m] = b
    prev = np.where((steps >= band) & (steps - band <= m), steps - band, far)
    for i in range(1, n + 1):
        first = i - band  # column of the band's first cell
        column = first + steps
        differs = padded[width + first - 1 : 2 * width + first - 1] != a[i - 1]
        base = np.where((column >= 1) & (column <= m), prev + differs, far)
        base = np.minimum(base, np.append(prev[1:], far) + 1)
        base = np.where(column == 0, i, base)
        base = np.where((column < 0) | (column > m), far, base)
        prev = np.minimum.accumulate(base - steps) + steps
        prev = np.where((column < 0) | (column > m), far, prev)
        if prev.min() > band:
            return band + 1
    return int(prev[m - n + band])


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the word edit similarity is at least ``least``; exact: bounds first, then the alignment."""
    longest = max(len(a), len(b))
    if not longest or not min(len(a), len(b)):
        return False
    most = int((1 - least) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    a, b = _trimmed(a, b)
    if max(len(a), len(b)) <= most:
        return True
    if max(len(a), len(b)) - _in_common(a, b) > most:
        return False
    if _anchored(a, b) <= most:
        return True
    band = min(most, max(32, abs(len(a) - len(b))))
    while True:
        distance = banded_distance(a, b, band)
        if distance <= band:
            return distance <= most
        if band >= most:
            return False
        band = min(most, 2 * band)


def _words_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The word hashes of each text of a batch."""
    data, offsets = T.buffers(batch.column("text"))
    for i, j in T.groups(offsets):
        if j - i == 1:
            yield T.word_hashes(data[offsets[i] : offsets[j]])
            continue
        chunk, inner = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends = T.word_spans(chunk, inner[1:-1])
        hashes = T.span_hashes(chunk, starts, ends)
        cuts = np.searchsorted(starts, inner)
        for k in range(j - i):
            yield hashes[cuts[k] : cuts[k + 1]]


def _sketches(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signed = [], [], []
            for words in _words_of(batch):
                sizes.append(len(words))
                keys.append(sketch(words).view(np.int64))
                signed.append(signature(words))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "text_key", "quick")), pa.array(sizes, pa.int64()), lists, pa.array(signed, pa.binary())],
                names=["doc_id", "text_key", "quick", "n_words", "samples", "signature"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, text_key string, quick long, n_words long, samples array<bigint>, signature binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures of a column as rows of bytes."""
    data, offsets = T.buffers(column)
    return data[offsets[0] : offsets[-1]].reshape(len(column), _WIDE)


def _hub_pairs(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, lengths and signatures of both) those that may be similar, with how ``near`` they seem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(at, _BLOCK)
                ok, near = plausible(*(part.column(c).to_numpy() for c in ("n_a", "n_b")), *(_matrix(part.column(c)) for c in ("signature_a", "signature_b")))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(near)], names=["a", "b", "near"]).filter(pa.array(ok))

    return pairs.mapInArrow(run, "a long, b long, near double")


def _block_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, part_a, b, part_b) of different components that may be similar, each once, from the mixed buckets' members.

    ``members``: key, strays, texts (numbers of both in the bucket), main, node, part, smaller (the node's smaller keys),
    n_words, signature. Strays and all texts of a bucket are dealt by hash into blocks of a bounded size, and each
    pair of blocks is a group. A pair with a smaller key in common belongs to that one's bucket.
    """
    rows = members.withColumn("s_blocks", F.ceil(F.col("strays") / STRAYS)).withColumn("t_blocks", F.ceil(F.col("texts") / TEXTS))
    held = ["is_text", "node", "part", "main", "n_words", "signature", "smaller"]

    def place(salt: str, blocks: str) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(blocks))

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))

    strays = rows.filter(F.col("part") != F.col("main")).withColumns({"is_text": F.lit(False), "s": place("stray", "s_blocks"), "t": every("t_blocks")})
    texts = rows.withColumns({"is_text": F.lit(True), "s": every("s_blocks"), "t": place("text", "t_blocks")})
    dealt = strays.select("key", "s", "t", *held).unionByName(texts.select("key", "s", "t", *held)).repartition("key", "s", "t").sortWithinPartitions("key", "s", "t", "is_text")

    def met_before(smaller: pa.Array, cut: int) -> np.ndarray:
        """Whether a stray (row) and a text (column) have a smaller key in common."""
        ends = np.asarray(smaller.offsets).astype(np.int64)
        keys, owner = smaller.flatten().to_numpy(), np.repeat(np.arange(len(smaller)), np.diff(ends))
        _, number, times = np.unique(keys, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times > 1)
        rank = np.full(len(times), -1)
        rank[shared] = np.arange(len(shared))
        number = rank[number]
        out = np.zeros((cut, len(smaller) - cut), dtype=bool)
        for at in range(0, len(shared), 2048):
            own = (number >= at) & (number < at + 2048)
            held_by = np.zeros((len(smaller), min(2048, len(shared) - at)), dtype=np.float32)
            held_by[owner[own], number[own] - at] = 1
            out |= held_by[:cut] @ held_by[cut:].T > 0
        return out

    def compare(group: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, node, part, main, size = (group.column(c).to_numpy() for c in ("is_text", "node", "part", "main", "n_words"))
        cut = int(np.searchsorted(kind, True))
        if not 0 < cut < len(node):
            return
        signed = _matrix(group.column("signature"))
        before = met_before(group.column("smaller").combine_chunks(), cut)
        for i in range(0, cut, 64):  # a few strays at a time against all texts of the block
            left, right = np.arange(i, min(i + 64, cut))[:, None], np.arange(cut, len(node))[None, :]
            once = (part[right] == main[right]) | (node[left] < node[right])
            x, y = np.nonzero((part[left] != part[right]) & once & _in_reach(size[left], size[right]) & ~before[i : i + 64])
            for at in range(0, len(x), _BLOCK):
                l, r = x[at : at + _BLOCK] + i, y[at : at + _BLOCK] + cut
                ok, _ = plausible(size[l], size[r], signed[l], signed[r])
                l, r = l[ok], r[ok]
                a, b = np.where(node[l] < node[r], l, r), np.where(node[l] < node[r], r, l)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (node[a], part[a], node[b], part[b])], names=["a", "part_a", "b", "part_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups stand in order; the last one of a batch may go on in the next."""
        waiting: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column(c).to_numpy() for c in ("key", "s", "t")])
            starts = np.concatenate([[0], np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            for first, last in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                here = tuple(where[:, first].tolist())
                if here != at:
                    if waiting:
                        yield from compare(pa.Table.from_batches(waiting).combine_chunks())
                    waiting, at = [], here
                waiting.append(batch.slice(first, last - first))
        if waiting:
            yield from compare(pa.Table.from_batches(waiting).combine_chunks())

    return dealt.mapInArrow(run, "a long, part_a long, b long, part_b long")


def _word_arrays(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.astype("<u8").tobytes() for w in _words_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(words, pa.binary())], names=["node", "words"])

    return docs.select("node", "text").mapInArrow(run, "node long, words binary")


class Forest:
    """Which numbers are joined so far."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether they weren't joined yet."""
        top, bottom = self.root(a), self.root(b)
        self.parent[max(top, bottom)] = min(top, bottom)
        return top != bottom


def _linked(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join the components (part_a, part_b) of all pairs whose texts are similar enough.

    Both ends of pairs are dealt by hash, so that a cell of their square holds few texts, whose words go there once
    for all its pairs. A task doesn't align a pair whose components its earlier links have joined.
    """
    side = max(1, math.ceil(words.count() / CELL))
    cells = pairs.select("a", "part_a", "b", "part_b", *[F.pmod(F.xxhash64(end), F.lit(side)).alias(f"at_{end}") for end in ("a", "b")])
    ends = cells.select("at_a", "at_b", F.col("a").alias("node")).union(cells.select("at_a", "at_b", "b")).distinct()
    texts = ends.join(words, "node").select("at_a", "at_b", F.lit(0).alias("kind"), "node", "words", *[F.lit(None).cast("long").alias(c) for c in ("b", "part_a", "part_b")])
    asked = cells.select("at_a", "at_b", F.lit(1).alias("kind"), F.col("a").alias("node"), F.lit(None).cast("binary").alias("words"), "b", "part_a", "part_b")
    dealt = texts.union(asked).repartition("at_a", "at_b").sortWithinPartitions("at_a", "at_b", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Forest()
        held: dict[int, np.ndarray] = {}
        at = None
        for batch in batches:
            packed = batch.column("words")
            found: list[tuple[int, int]] = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("at_a", "at_b", "kind", "node", "b", "part_a", "part_b")), strict=True)
            for i, (x, y, kind, a, b, part_a, part_b) in enumerate(rows):
                if (x, y) != at:
                    held, at = {}, (x, y)
                if not kind:
                    held[a] = np.frombuffer(packed[i].as_py(), "<u8")
                elif joined.root(part_a) != joined.root(part_b) and similar(held[a], held[b], least):
                    joined.join(part_a, part_b)
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the component is its smallest node.

    Each round points every node at the smallest one around it, jumps twice along these pointers, and
    contracts the links by them, so the links shrink from round to round; stars, which most classes are,
    vanish in one. Links and labels of a round are written to the shared folder.
    """
    links = materialize(edges.filter(F.col("a") != F.col("b")).distinct(), "links")
    whole = None
    for _ in range(limit):
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"))
        labels = materialize(ends.select("e.*").groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("label")), "labels")
        for _ in range(2):
            ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
            labels = materialize(labels.join(ahead, "label", "left").select("node", F.coalesce("far", "label").alias("label")), "labels")
        if whole is None:
            whole = labels
        else:
            moved = labels.select(F.col("node").alias("label"), F.col("label").alias("now"))
            whole = materialize(whole.join(moved, "label", "left").select("node", F.coalesce("now", "label").alias("label")), "labels")
        first, second = (labels.select(F.col("node").alias(c), F.col("label").alias(f"to_{c}")) for c in ("a", "b"))
        contracted = links.join(first, "a").join(second, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        smaller = materialize(contracted.filter(F.col("a") != F.col("b")).distinct(), "links")
        release(links)
        links = smaller
        if not links.limit(1).count():
            return whole.select("node", F.col("label").alias("component"))
    raise RuntimeError("components didn't settle")


def _text_key(doc_id: Column, text: Column) -> Column:
    """Equal for rows of equal text; null texts are told apart by their ids."""
    return F.coalesce(F.sha2(text, 256), F.concat(F.lit("none "), F.coalesce(doc_id.cast("string"), F.lit(""))))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, class_id, copy_of, n_words, text_key, part) for each row of ``docs``.

    ``class_id`` is the smallest id of its class, ``copy_of`` the smallest id with the same text. ``part`` numbers the
    classes, also those without an id or with a repeated one; ``text_key`` tells the texts of one id apart.
    """
    if least < SIMILARITY:
        raise ValueError(f"the samples reach a similarity of {SIMILARITY}, not {least}")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("quick"))
    sketches = materialize(_sketches(rows.withColumn("text_key", _text_key(F.col("doc_id"), F.col("text")))), "sketches")
    # numbered in a fixed order, as which texts meet hangs on it
    nodes = materialize(
        sketches.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.first("quick").alias("quick")).orderBy("rep", "text_key").withColumn("node", F.monotonically_increasing_id()),
        "texts",
    )
    sampled = materialize(
        sketches.join(nodes.select("text_key", "rep", "node"), "text_key")
        .filter(F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("n_words") > 0))
        .select("node", "n_words", "samples", "signature")
        .dropDuplicates(["node"]),
        "samples",
    )
    buckets = sampled.select("node", F.explode("samples").alias("key")).repartition("key")
    shared = buckets.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter(F.col("a") != F.col("z")).select("key", "a")
    held = materialize(buckets.join(shared, "key").select("key", "node", "a"), "buckets")
    light = sampled.select("node", "n_words", "signature")
    first, second = (light.toDF(c, f"n_{c}", f"signature_{c}") for c in ("a", "b"))
    met = held.filter(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")).distinct().join(second, "b").join(first, "a")
    hubs = _hub_pairs(met.filter(F.least("n_a", "n_b") >= F.floor(F.lit(least) * F.greatest("n_a", "n_b"))))
    pairs = materialize(hubs.groupBy("b").agg(F.max_by("a", F.struct("near", -F.col("a"))).alias("a")).select("a", "b"), "pairs")

    def compared(candidates: DataFrame, name: str) -> DataFrame:
        wanted = candidates.select("a").union(candidates.select("b")).distinct().withColumnRenamed("a", "node")
        places = nodes.join(wanted, "node").select("node", F.col("rep").alias("rep_id"), "quick", F.col("text_key").alias("key"))
        found = rows.join(places, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (rows["quick"] == places["quick"]))
        texts = found.filter(_text_key(F.col("doc_id"), F.col("text")) == F.col("key")).select("node", "text")
        words = materialize(_word_arrays(texts).dropDuplicates(["node"]), "words")
        links = materialize(_linked(candidates, words, least), name)
        release(words)
        return links

    links = compared(pairs.withColumns({"part_a": F.col("a"), "part_b": F.col("b")}), "first-links")
    parts = components(links)

    # texts of a bucket that still lie apart
    placed = held.select("key", "node").join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    tally = placed.groupBy("key", "part").count()
    mixed = (
        tally.groupBy("key")
        .agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.max("count").alias("most"), F.sum("count").alias("texts"))
        .filter(F.col("texts") > F.col("most"))
        .select("key", "main", "texts", (F.col("texts") - F.col("most")).alias("strays"))
    )
    apart = materialize(placed.join(mixed, "key"), "mixed-buckets")
    # a text's buckets, no more than it has samples, meet its signature as one row
    of_node = apart.groupBy("node", "part").agg(F.collect_list(F.struct("key", "main", "texts", "strays")).alias("held")).join(light, "node")
    members = of_node.select("*", F.explode("held").alias("bucket")).select(
        "node", "part", "n_words", "signature", "bucket.*", F.filter(F.col("held.key"), lambda k: k < F.col("bucket.key")).alias("smaller")
    )
    late = materialize(_block_pairs(members).join(pairs, ["a", "b"], "left_anti"), "late-pairs")
    for done in (held, sampled, pairs, apart):
        release(done)
    if late.limit(1).count():
        parts = components(links.unionByName(compared(late, "late-links")))

    whole = nodes.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    names = whole.groupBy("part").agg(F.min("rep").alias("class_id"))
    classes = whole.join(names, "part").select("text_key", "class_id", F.col("rep").alias("copy_of"), "part")
    return sketches.select("doc_id", "text_key", "n_words").join(classes, "text_key").select("doc_id", "class_id", "copy_of", "n_words", "text_key", "part")


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class: that of the smallest id, null last; then of the smallest text key; then the first in column order."""
    repeated = docs.groupBy(id_col).count().filter(F.col("count") > 1).limit(1).count()
    if not repeated:  # ids name rows, so class ids name classes
        kept = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("kept_id"))
        return docs.join(kept, F.col(id_col).eqNullSafe(F.col("kept_id"))).drop("kept_id")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("s")
    kept = classes.groupBy("part").agg(smallest).select(F.col("s.doc_id").alias("kept_id"), F.col("s.text_key").alias("kept_key"))
    keyed = docs.withColumn("key_of_row", _text_key(F.col(id_col), F.col(text_col).cast("string")))
    chosen = keyed.join(kept, F.col(id_col).eqNullSafe(F.col("kept_id")) & (F.col("key_of_row") == F.col("kept_key")))
    order = Window.partitionBy(id_col, "key_of_row").orderBy(*[F.col(c) for c in docs.columns])
    return chosen.withColumn("place_of_row", F.row_number().over(order)).filter(F.col("place_of_row") == 1).select(*docs.columns)
