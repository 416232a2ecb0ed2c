"""Token-id files of fixed-width bit packing.

A file holds a run of whole documents in ascending order of id. Ids are packed in the fewest bits that hold
the vocabulary, in blocks of ``BLOCK`` ids; each block starts at a byte of its own, and the table of
block offsets lets a reader seek to any token and unpack whole blocks with numpy.

Layout, all little-endian::

    magic "LLTF" | u32 version | u32 bits | u32 block length | u64 documents | u64 tokens
    u64 document offsets, in tokens (documents + 1) | u64 block offsets, in bytes of the payload (blocks + 1)
    u64 length of the ids' section | document ids, an Arrow IPC stream | payload

Files go to the shared folder under names of their own, each closed at ``FILE_BYTES``; a lost task writes new ones and the
manifest, a table with one row per file, names only those of tasks that ended well. As files are in id order, running
sums over the manifest give the place of every document in the whole corpus.

Defined results: a null text is an empty one; an empty text has only the end id; rows with equal ids
are ordered by a hash of the text, then the text; a null id comes first; an empty table gives an empty
manifest; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import text as T
from ledgerloom.shared import materialize, shared_path

MAGIC = b"LLTF"
VERSION = 1
BLOCK = 8192
_HEAD = struct.Struct("<4sIIIQQ")
#: Entries of encoded chunks a worker keeps in each of two generations.
CACHE = 600_000
#: Bytes of packed ids at which a file is closed and the next one begun.
FILE_BYTES = 128 << 20
#: Bytes of texts encoded together, and chunks numbered at once.
GROUP = 4 << 20
CHUNKS = 1 << 20
# The steps before the merges of the tokenizer whose texts are encoded by chunks, as its file states them.
STEPS = [
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ]},
    {"type": "Sequence", "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
]
# Words of letters that the tokenizer only lower-cases and writes by their bytes.
_LETTERS = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")


def _kind(byte: int) -> bytes:
    """Stop, letter or digit or white space, first byte of other characters than U+00C0 to U+00FF, of those, or other sign."""
    if byte in b".,":
        return b"."
    if byte < 0x80:
        return b"a" if bytes([byte]).isalnum() or T.SEPARATOR[byte] else b"!"
    if byte < 0xC0:
        return b"x" if byte in (0x97, 0xB7) else b"a"
    return b"c" if byte == 0xC3 else b"o"


_KINDS = b"".join(map(_kind, range(256)))
# In kinds: a stop behind a sign; characters other than ASCII and the letters from U+00C0 to U+00FF.
_UNSAFE = (b"!.", b"..", b"o", b"cx")


def width(vocabulary: int) -> int:
    """The fewest bits that hold ids 0 to ``vocabulary`` - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a bit string, least significant bit first, filled up to a whole byte; an id of more bits is an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit {bits} bits")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The inverse of :func:`pack`, vectorised."""
    if bits == 16:
        return np.frombuffer(data, "<u2", count=count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits)
    weights = np.uint32(1) << np.arange(bits, dtype=np.uint32)
    return (flat.reshape(count, bits) * weights).sum(axis=1, dtype=np.uint32)


class Writer:
    """Collects packed blocks of one file; holds packed bytes only."""

    def __init__(self, bits: int, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.blocks: list[bytes] = []
        self.left = np.zeros(0, dtype=np.uint32)
        self.docs = [0]
        self.doc_ids: list[pa.Array] = []
        self.size = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents with these lengths, their token ids joined."""
        self.doc_ids.append(doc_ids)
        self.docs.extend((self.docs[-1] + np.cumsum(lengths)).tolist())
        ids = np.concatenate([self.left, ids])
        full = len(ids) // self.block
        for i in range(full):
            self.blocks.append(pack(ids[i * self.block : (i + 1) * self.block], self.bits))
            self.size += len(self.blocks[-1])
        self.left = ids[full * self.block :]

    def parts(self) -> Iterator[bytes]:
        blocks = [*self.blocks, pack(self.left, self.bits)] if len(self.left) else self.blocks
        yield _HEAD.pack(MAGIC, VERSION, self.bits, self.block, len(self.docs) - 1, self.docs[-1])
        yield np.array(self.docs, dtype="<u8").tobytes()
        yield np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes()
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([pa.concat_arrays(self.doc_ids)], names=["doc_id"])
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        named = sink.getvalue().to_pybytes()
        yield struct.pack("<Q", len(named))
        yield named
        yield from blocks


class Reader:
    """Random access to one file."""

    def __init__(self, file):
        self.file = file
        magic, version, self.bits, self.block, self.n_docs, self.n_tokens = _HEAD.unpack(file.read(_HEAD.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        blocks = -(-self.n_tokens // self.block)
        self.docs = np.frombuffer(file.read(8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(file.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        named = file.read(struct.unpack("<Q", file.read(8))[0])
        self.doc_ids = pa.ipc.open_stream(named).read_all().column("doc_id").combine_chunks()
        self.payload = file.tell()

    def tokens(self, first: int, last: int) -> np.ndarray:
        """Tokens ``first`` up to ``last``; reads only the blocks that hold them."""
        if last <= first:
            return np.zeros(0, dtype=np.uint32)
        a, b = first // self.block, -(-last // self.block)
        self.file.seek(self.payload + int(self.offsets[a]))
        data = self.file.read(int(self.offsets[b] - self.offsets[a]))
        out = []
        for i in range(a, b):
            count = min(self.block, self.n_tokens - i * self.block)
            out.append(unpack(data[self.offsets[i] - self.offsets[a] : self.offsets[i + 1] - self.offsets[a]], self.bits, count))
        joined = np.concatenate(out) if len(out) > 1 else out[0]
        return joined[first - a * self.block : last - a * self.block]

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file."""
        return self.tokens(int(self.docs[i]), int(self.docs[i + 1]))


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder; a plain path is local."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _steps(tokenizer) -> list[dict | None]:
    return [json.loads(step.__getstate__()) if step else None for step in (tokenizer.normalizer, tokenizer.pre_tokenizer)]


class ChunkEncoder:
    """Encodes texts through a cache of their white-space-free chunks.

    The tokenizer drops white space, lower-cases, and never looks across white space, so a text's ids are those of its
    chunks, joined. ASCII is lower-cased before the lookup, and a full stop or comma that ends a chunk behind a
    letter or digit, where the tokenizer always cuts, is looked up by itself; both only where a text holds no
    sign that could make a difference. Arrow numbers the chunks of many texts, each distinct one is looked up once,
    and its ids are taken wherever it stands. A new chunk of plain letters is one word to the tokenizer and goes straight to its
    merges. All this holds for tokenizers of the steps in ``STEPS`` without added tokens that hold white space or reach
    beyond themselves; others encode texts whole. Tests compare all this with the tokenizer's own result.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        alone = all(not any(c.isspace() for c in t.content) and not (t.lstrip or t.rstrip or t.single_word) for t in added)
        self.by_chunk = alone and _steps(self.tokenizer) == STEPS
        self.marks = sorted({t.content.encode()[:2] for t in added})
        if self.by_chunk:
            letters = [chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha()]
            written = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.as_bytes = str.maketrans({c: written(c)[0][0] for c in letters})

    def _prepared(self, text: bytes) -> bytes:
        """The text with its chunks between white space."""
        if any(mark in text for mark in self.marks):
            return text
        text = text.lower()
        kinds = text.translate(_KINDS)
        if not any(unsafe in kinds for unsafe in _UNSAFE):
            text = text.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n")
        return text

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, counts = self.encode_joined(texts)
        raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
        return [raw[end - 4 * n : end] for n, end in zip(counts.tolist(), ends.tolist(), strict=True)]

    def encode_joined(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and the number of each text's ids."""
        if not self.by_chunk:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.array(list(chain.from_iterable(found)), dtype=np.uint32), np.array([len(f) for f in found], dtype=np.int64)
        split = pc.ascii_split_whitespace(pa.array([self._prepared(t) for t in texts], pa.large_string()))
        chunks, ends = split.flatten(), np.diff(split.offsets.to_numpy()).cumsum()
        ids, counts = [np.zeros(0, dtype=np.uint32)], np.zeros(len(chunks) + 1, dtype=np.int64)
        for at in range(0, len(chunks), CHUNKS):
            coded = chunks[at : at + CHUNKS].dictionary_encode()
            words = pa.array(self._lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
            laid, offsets = T.buffers(words.take(coded.indices))
            ids.append(np.frombuffer(laid, "<u4", count=int(offsets[-1]) // 4))
            counts[at + 1 : at + len(offsets)] = np.diff(offsets) // 4
        return np.concatenate(ids), np.diff(np.cumsum(counts)[ends], prepend=0)

    def _lookup(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks; an empty one, left by white space at an end of a text, has none."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        ids = list(map(self.known.get, chunks))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            self._learn([chunks[i] for i in missing])
            for i in missing:
                ids[i] = self.known[chunks[i]]
        return ids

    def _learn(self, chunks: list[str]) -> None:
        merges, new = self.tokenizer.model.tokenize, []
        for chunk in chunks:
            ids = self.older.get(chunk)
            if ids is not None:
                self.known[chunk] = ids
            elif _LETTERS.fullmatch(chunk):
                word = chunk.lower()
                found = [t.id for t in merges(word if word.isascii() else word.translate(self.as_bytes))]
                self.known[chunk] = struct.pack(f"<{len(found)}I", *found)
            else:
                new.append(chunk)
        found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.known.update((c, struct.pack(f"<{len(e)}I", *e.ids)) for c, e in zip(new, found, strict=True))


@cache
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encoder_for(path: str) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    return lambda texts: _encoder(path).encode_joined(texts)


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    vocabulary: int | None = None,
    end_id: int = 1,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Encode every text, append ``end_id``, write files in ascending id order; returns the manifest.

    ``vocabulary``: the number of ids, by default the tokenizer's. The manifest has one row per file: file_no, path,
    n_docs, n_tokens, first_id, first_token, first_doc. Texts are shuffled
    once, by ranges of id and text hash, so a hot id is spread too; encoding and writing happen in the task
    that holds the range.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-files")
    bits = width(max(vocabulary or _tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn(
        "tie", F.xxhash64("text")
    )
    ranged = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_for(tokenizer_path)
        writer, first, number = Writer(bits), None, 0

        def close() -> pa.RecordBatch:
            store, path = store_of(folder)
            store.create_dir(path, recursive=True)
            name = f"{uuid.uuid4().hex}.lltf"
            with store.open_output_stream(f"{path}/{name}") as out:
                for part in writer.parts():
                    out.write(part)
            held = [[first[0].as_py()], [first[1].as_py()], [number], [name], [len(writer.docs) - 1], [writer.docs[-1]]]
            kinds = [first[0].type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(held, kinds, strict=True)], names=["first_id", "first_tie", "number", "name", "n_docs", "n_tokens"])

        for batch in batches:
            data, offsets = T.buffers(batch.column("text"))
            raw = data.tobytes()
            for i, j in T.groups(offsets, min(GROUP, file_bytes), len(batch)):
                if first is None:
                    first = (batch.column("doc_id")[i], batch.column("tie")[i])
                ids, counts = encode([raw[offsets[k] : offsets[k + 1]] for k in range(i, j)])
                writer.add(batch.column("doc_id")[i:j], np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1)
                if writer.size >= file_bytes:
                    yield close()
                    writer, first, number = Writer(bits), None, number + 1
        if first is not None:
            yield close()

    written = ranged.mapInArrow(run, f"first_id {kind}, first_tie long, number long, name string, n_docs long, n_tokens long")
    manifest = materialize(written, "token-manifest")  # one row per file; from here on the files are fixed
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_tie", "number")
    return manifest.select(
        (F.row_number().over(order) - 1).cast("long").alias("file_no"),
        F.concat(F.lit(f"{folder}/"), "name").alias("path"),
        "n_docs",
        "n_tokens",
        "first_id",
        F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_token"),
        F.coalesce(F.sum("n_docs").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_doc"),
    )


def read_token_files(manifest: DataFrame, run_docs: int = 256) -> DataFrame:
    """Every document as the files hold it: doc_id, doc_no (its place in the corpus), start, n_tokens, ids_crc32, file_no.

    Each task opens the files of its manifest rows and reads runs of documents by their block offsets.
    """
    id_type = manifest.schema["first_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = store_of(row["path"])
                with store.open_input_file(path) as file:
                    reader = Reader(file)
                    for i in range(0, reader.n_docs, run_docs):
                        j = min(i + run_docs, reader.n_docs)
                        at = reader.docs[i : j + 1]
                        raw = memoryview(reader.tokens(int(at[0]), int(at[-1])).astype("<u4").tobytes())
                        here = 4 * (at - at[0])
                        sums = [zlib.crc32(raw[here[k] : here[k + 1]]) for k in range(j - i)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                reader.doc_ids[i:j],
                                pa.array(np.arange(row["first_doc"] + i, row["first_doc"] + j)),
                                pa.array(row["first_token"] + at[:-1]),
                                pa.array(np.diff(at)),
                                pa.array(sums, pa.int64()),
                                pa.array([row["file_no"]] * (j - i), pa.int64()),
                            ],
                            names=["doc_id", "doc_no", "start", "n_tokens", "ids_crc32", "file_no"],
                        )

    tasks = manifest.repartition(F.col("file_no"))
    return tasks.mapInArrow(run, f"doc_id {id_type}, doc_no long, start long, n_tokens long, ids_crc32 long, file_no long")
