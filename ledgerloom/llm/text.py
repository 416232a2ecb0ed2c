"""Vectorised work on the bytes of many texts at once.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``, all ASCII, so words of UTF-8 bytes are words of
characters. Hashes are sums of mixed chunks, so no algebraic pattern of the bytes makes two texts collide.
Long texts are cut into segments at white space, so the temporary arrays stay near
``SEGMENT`` bytes whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
MAX_DOCS = 512

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_ODD = 0x2545F4914F6CDD1D
#: Masks that keep the first 0 to 8 bytes of a little-endian number.
_LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64 over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def _chunk_sums(data: np.ndarray, starts: np.ndarray, length: np.ndarray, place: int = 0) -> np.ndarray:
    """Sums of the mixed eight-byte chunks of each span; ``place``: number of a span's first chunk."""
    low = int(starts.min())
    near = data[low : int((starts + length).max())]
    padded = np.zeros(len(near) + 8, dtype=np.uint8)
    padded[: len(near)] = near
    at_byte = np.ndarray(len(near) + 1, dtype="<u8", buffer=padded, strides=(1,))
    chunks = (length + 7) >> 3
    single = bool((chunks == 1).all())
    with np.errstate(over="ignore"):
        if single:
            at, left, step = starts - low, length, np.uint64(0)
        else:
            first = np.cumsum(chunks) - chunks
            number = np.arange(int(chunks.sum())) - np.repeat(first, chunks)
            at, left, step = np.repeat(starts - low, chunks) + 8 * number, np.repeat(length, chunks) - 8 * number, number.astype(np.uint64)
        value = at_byte[at] & _LOW_BYTES[np.minimum(left, 8)]
        mixed = mix(mix(value + np.uint64(_ODD)) + (step + np.uint64(place)) * np.uint64(0x9E3779B97F4A7C15))
        if single:
            return mixed
        sums = np.zeros(len(mixed) + 1, dtype=np.uint64)
        np.cumsum(mixed, out=sums[1:])
        return sums[first + chunks] - sums[first]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]`` for many spans: equal bytes, equal hash.

    A span's eight-byte chunks are mixed with their places, one by one, and the mixes are summed, in
    runs of about ``SEGMENT`` bytes, also within a longer span.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    length = (ends - starts).astype(np.int64)
    reach = np.cumsum(length)
    sums = np.zeros(len(starts), dtype=np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(reach, reach[i] - length[i] + SEGMENT, side="right")))
            if length[i] <= SEGMENT:
                sums[i:j] = _chunk_sums(data, starts[i:j], length[i:j])
            else:
                j = i + 1
                for at in range(0, int(length[i]), SEGMENT):
                    sums[i] += _chunk_sums(data, starts[i:j] + at, np.minimum(length[i:j] - at, SEGMENT), at >> 3)[0]
            i = j
        return mix(sums + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; ``bounds``: offsets at which one text ends and the next begins."""
    inside = ~SEPARATOR[data]
    if not inside.any():
        none = np.zeros(0, dtype=np.int64)
        return none, none
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    if bounds is not None and len(bounds):
        cut = bounds[(bounds > 0) & (bounds < len(data))]
        first[cut] |= inside[cut]
        last[cut - 1] |= inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = column.fill_null(empty)
    kind = np.int64 if wide else np.int32
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, dtype=kind, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.zeros(0, dtype=np.uint8)
    return data, at


def groups(offsets: np.ndarray, limit: int = SEGMENT, docs: int = MAX_DOCS) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``limit`` bytes together, at least one text each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), i + docs, n)
        yield i, j
        i = j


def segments(data: np.ndarray, limit: int = SEGMENT) -> Iterator[np.ndarray]:
    """One text in pieces cut before white space; a longer word stays whole."""
    i, n = 0, len(data)
    while n - i > limit:
        window = np.flatnonzero(SEPARATOR[data[i + 1 : i + limit]])
        if len(window):
            cut = i + 1 + int(window[-1])
        else:
            later, at = None, i + limit
            while at < n and later is None:
                found = np.flatnonzero(SEPARATOR[data[at : at + limit]])
                later = at + int(found[0]) if len(found) else None
                at += limit
            cut = n if later is None else later
        yield data[i:cut]
        i = cut
    if i < n:
        yield data[i:]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """The hashes of one text's words, in order."""
    parts = [span_hashes(piece, *word_spans(piece)) for piece in segments(data)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row; a text of fewer words, but some, is one shingle."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint64)
        for i in range(min(k, len(words))):
            h = h * np.uint64(0x9FB21C651E98DF25) + words[i : i + n]
        return mix(h)


def occurrences(values: np.ndarray) -> np.ndarray:
    """For each value how many equal ones stand before it."""
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(values, kind="stable")
    held = values[order]
    new = np.ones(len(held), dtype=bool)
    new[1:] = held[1:] != held[:-1]
    run = np.flatnonzero(new)
    out = np.empty(len(values), dtype=np.int64)
    out[order] = np.arange(len(held)) - np.repeat(run, np.diff(np.append(run, len(held))))
    return out
