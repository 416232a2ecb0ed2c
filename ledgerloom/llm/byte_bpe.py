"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

1. Texts fall into blocks of consecutive rows of one input partition. A block's pre-tokens are reduced to
   its distinct words, which are dealt by hash into buckets and packed, one row for each block and bucket.
2. The rows are shuffled by bucket. All blocks' copies of a word meet there and it is encoded once; the ids go
   back to each block that asked, in the order of its words.
3. The ids of a block's words meet the block's texts, packed and compressed. Pre-tokens are looked up in
   order of position and their ids joined, so no (document, position) row is ever shuffled.
4. Decoding joins ids with the table of token bytes, which has a fixed size.

A word that a block's dictionary lacks, which only happens if a lost partition was read again in another
order, is encoded on the spot, so results never depend on that order.

Defined results: a null text is an empty one and has no ids; every row is encoded by itself, so repeated rows and
ids are fine; an empty table gives no rows; other columns are not read unless named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import text as T

#: Bytes of text that share one dictionary.
BLOCK_BYTES = 12 << 20
#: Bytes of text packed in one row on the way to their block's dictionary.
CHUNK_BYTES = 1 << 20
#: Largest number of buckets of words.
MAX_BUCKETS = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from a file of base64 tokens and ranks; the driver's or an executor's own copy."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@cache
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes joined, each one's start and its length, by id."""
    ranks = load_ranks(path)
    size = max(ranks.values()) + 1
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


def pre_tokens(text: str, pattern: str) -> list[str]:
    """The matches of the pattern, in order."""
    return _compiled(pattern).findall(text)


@cache
def _compiled(pattern: str):
    return regex.compile(pattern)


def encode_word(word: bytes, path: str, pattern: str) -> bytes:
    """Ids of one pre-token as little-endian unsigned 32-bit integers."""
    encoding = _encoding(path, pattern)
    rank = encoding._mergeable_ranks.get(word)
    ids = [rank] if rank is not None else encoding._core_bpe.encode_single_piece(word)
    return struct.pack(f"<{len(ids)}I", *ids)


def _pack(items: list[bytes]) -> bytes:
    """Byte strings with their lengths, compressed."""
    lengths = np.array([len(x) for x in items], dtype="<u4").tobytes()
    return zstandard.compress(struct.pack("<I", len(items)) + lengths + b"".join(items), 3)


def _unpack(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = struct.unpack_from("<I", raw)[0]
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", count=n, offset=4), dtype=np.int64)).tolist()
    start, out = 4 + 4 * n, []
    for end in ends:
        out.append(raw[start:end])
        start = end
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch, list[bytes]]]:
    """(block, whether it ends here, rows, their texts) for short runs of rows, in order.

    The same rows in the same order give the same blocks, whatever the sizes of the batches.
    """
    part = TaskContext.get().partitionId()
    number, held, waiting = 0, 0, None
    for batch in batches:
        data, offsets = T.buffers(batch.column("text"))
        raw = data.tobytes() if len(offsets) > 1 else b""
        for i in range(len(offsets) - 1):
            text = raw[offsets[i] : offsets[i + 1]]
            if waiting is None:
                waiting = (batch, i, [])
            waiting[2].append(text)
            held += len(text)
            full = held >= BLOCK_BYTES
            if full or held // CHUNK_BYTES > (held - len(text)) // CHUNK_BYTES:
                yield (part << 24) | number, full, batch.slice(waiting[1], i + 1 - waiting[1]), waiting[2]
                waiting = None
            if full:
                number, held = number + 1, 0
        if waiting is not None:
            yield (part << 24) | number, False, batch.slice(waiting[1]), waiting[2]
            waiting = None


def encode_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    then: tuple[Callable[[list[bytes]], list[pa.Array]], str] | None = None,
) -> DataFrame:
    """One row (doc_id, ``keep``, ids) for each row of ``docs``; ids: little-endian unsigned 32-bit integers.

    ``then``, a function from many texts' ids to columns, and their schema, takes the place of ids in the
    same pass.
    """
    finish, finished = then or ((lambda out: [pa.array(out, pa.binary())]), "ids binary")
    last_names = [part.split()[0] for part in finished.split(",")]
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"keep_{c}") for c in keep], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    buckets = max(1, min(MAX_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kept_schema = [f for f in rows.schema.fields if f.name != "text"]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's distinct words, one row for each bucket."""
        find = _compiled(pattern).findall

        def emit(block: int, found: set[str]) -> pa.RecordBatch:
            dealt: list[list[bytes]] = [[] for _ in range(buckets)]
            for word in map(str.encode, found):
                dealt[zlib.crc32(word) % buckets].append(word)
            some = [b for b in range(buckets) if dealt[b]]
            for b in some:
                dealt[b].sort()
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([_pack(dealt[b]) for b in some], pa.binary())],
                names=["block", "bucket", "words"],
            )

        found: set[str] = set()
        last = None
        for block, full, _, texts in _blocks(batches):
            for text in texts:
                found.update(find(text.decode()))
            last = block
            if full:
                yield emit(block, found)
                found, last = set(), None
        if last is not None:
            yield emit(last, found)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct word of a bucket once; ids back to every block that holds it."""
        known: dict[bytes, bytes] = {}
        at = None
        for batch in batches:
            blocks, answers = batch.column("block"), []
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if bucket != at:
                    known, at = {}, bucket
                asked = _unpack(packed)
                for word in asked:
                    if word not in known:
                        known[word] = encode_word(word, ranks_path, pattern)
                answers.append(_pack([_pack(asked), _pack([known[w] for w in asked])]))
            yield pa.RecordBatch.from_arrays([blocks, pa.array([0] * len(answers), pa.int32()), pa.array(answers, pa.binary()), pa.array([b""] * len(answers), pa.binary())], names=["block", "kind", "payload", "rows"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts on their way to their block's dictionary."""
        for block, _, batch, texts in _blocks(batches):
            sink = pa.BufferOutputStream()
            held = batch.select([f.name for f in kept_schema])
            with pa.ipc.new_stream(sink, held.schema) as stream:
                stream.write_batch(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([1], pa.int32()), pa.array([_pack(texts)], pa.binary()), pa.array([zstandard.compress(sink.getvalue().to_pybytes())], pa.binary())],
                names=["block", "kind", "payload", "rows"],
            )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Dictionaries of a block come first, then its texts."""
        find = _compiled(pattern).findall
        known: dict[str, bytes] = {}
        at = None
        for batch in batches:
            for block, kind, payload, held in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "payload", "rows")), strict=True):
                if block != at:
                    known, at = {}, block
                if kind == 0:
                    asked, ids = map(_unpack, _unpack(payload))
                    known.update(zip(map(bytes.decode, asked), ids, strict=True))
                    continue
                out = []
                for text in _unpack(payload):
                    found = find(text.decode())
                    try:
                        out.append(b"".join([known[w] for w in found]))
                    except KeyError:
                        known.update((w, encode_word(w.encode(), ranks_path, pattern)) for w in set(found).difference(known))
                        out.append(b"".join([known[w] for w in found]))
                rows_of = pa.ipc.open_stream(zstandard.decompress(held)).read_all().combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*rows_of.columns, *finish(out)], names=[*rows_of.schema.names, *last_names])

    middle = "block long, kind int, payload binary, rows binary"
    asked = rows.select("text").mapInArrow(words, "block long, bucket int, words binary")
    answered = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(encode, middle)
    together = answered.unionByName(rows.mapInArrow(chunks, middle)).repartition("block").sortWithinPartitions("block", "kind")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_schema)
    done = together.mapInArrow(assemble, f"{schema}, {finished}")
    return done.select("doc_id", *[F.col(f"keep_{c}").alias(c) for c in keep], *last_names)


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """Join ids with the table of token bytes."""
    table, starts, lengths = _token_bytes(path)
    if not len(ids):
        return b""
    size = lengths[ids]
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1])) - np.repeat(ends - size, size) + np.repeat(starts[ids], size)
    return table[at].tobytes()


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded`` (binary) added: the bytes that its ids stand for."""
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decode_ids(np.frombuffer(x, "<u4"), ranks_path) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")


def encode_and_digest(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row encoded and decoded again: doc_id, ``keep``, n_tokens and the digests of ids and of decoded bytes."""

    def finish(ids: list[bytes]) -> list[pa.Array]:
        decoded = [decode_ids(np.frombuffer(x, "<u4"), ranks_path) for x in ids]
        return [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
        ]

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encode_documents(docs, ranks_path, pattern, keep=keep, then=(finish, schema))
