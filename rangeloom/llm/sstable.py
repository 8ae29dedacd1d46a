"""Token ids in sorted-string-table shards with binary-search lookup.

File layout, all integers little-endian: data blocks, one after another; the
sparse index; the Bloom filter; a footer of fixed size.

* Block: zstd frame of entries.  An entry is ``<HHI`` (bytes shared with the
  key before it, bytes that follow, bytes of value), the key's new bytes and the
  value.  The first key of a block is whole.  A value is the ids, two or four
  bytes each; four where an id exceeds 65535.
* Index: for each block its first key's length and bytes, offset, stored length
  and number of entries.
* Bloom filter: BLOOM_HASHES probes of a bitmap of a power of two bits.
* Footer: offsets of index and filter, their lengths, the numbers of blocks,
  entries and ids, id width, and a magic number.

A key is the identifier as eight bytes that sort as the number does; the key of
a null identifier is empty and sorts first.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.llm import _text as T
from rangeloom.llm._store import scratch_path, stored

BLOCK_BYTES = 1 << 18
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 12, 8
END_ID = 2
#: Segments whose ids a worker process remembers, about 200 bytes each.
MEMO_SEGMENTS = 400_000
#: Text bytes cut into segments at once.
ENCODE_BYTES = 1 << 22
#: Punctuation that a word's end is cut before.
_MARKS = np.frombuffer(b".,;:!?", np.uint8)
MAGIC = b"RLTOKSS1"
_ENTRY = struct.Struct("<HHI")
_INDEX = struct.Struct("<HQII")
_FOOTER = struct.Struct("<QQQQIQQB8s")


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the segments of a chunk of UTF-8 texts, and how many segments each text has.

    The byte-level pre-tokenizer's pieces never cross from a character that is no
    white space into white space, nor from a letter or digit into plain
    punctuation; texts are cut there and nowhere else, so the segments' ids, one
    after another, are the text's.  A character counts as a letter here if it is
    an ASCII one or one of U+00C0 to U+00FF; others are left uncut before
    punctuation, which is always safe.
    """
    lower = data | 32
    plain = ((lower >= 97) & (lower <= 122)) | ((data >= 48) & (data <= 57))
    tail = data >= 128
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & tail[1:] & (data[1:] != 0x97) & (data[1:] != 0xB7)
    word = plain | latin
    solid = word | ((data > 32) & (data < 127))
    gap = (data == 32) | (data == 10)
    mark = np.isin(data, _MARKS)
    cut = np.zeros(len(data), bool)
    cut[1:] = (gap[1:] & solid[:-1]) | (mark[1:] & word[:-1])
    full = np.flatnonzero(np.diff(offsets))
    cut[offsets[:-1][full]] = True
    starts = np.flatnonzero(cut)
    return starts, np.diff(np.searchsorted(starts, offsets))


class Encoder:
    """Ids of whole texts, with the ids of recurring segments remembered."""

    def __init__(self, path: str, end_id: int = END_ID, memo: int = MEMO_SEGMENTS):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._memo: dict[str, bytes] = {}
        self._limit = memo
        self._end = np.array([end_id], "<u4")

    def _encode(self, texts: list[str]) -> list[bytes]:
        made = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in made]

    def _known(self, texts: list[str]) -> list[bytes]:
        """Ids of distinct segments.  A full memory takes no more, until half of what is asked for is missing in it."""
        memo = self._memo
        found = list(map(memo.get, texts))
        fresh = [i for i, x in enumerate(found) if x is None]
        if fresh:
            made = self._encode([texts[i] for i in fresh])
            if 2 * len(fresh) > len(texts) and len(memo) >= self._limit:
                memo.clear()
            room = self._limit - len(memo)
            for n, (i, ids) in enumerate(zip(fresh, made, strict=True)):
                found[i] = ids
                if n < room:
                    memo[texts[i]] = ids
        return found

    def batches(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of each text and the end id, as little-endian unsigned 32-bit integers; null texts are empty.

        Segments of a bounded chunk of texts become a dictionary, only whose
        entries are looked up; their ids are gathered by index.
        """
        for _, _, data, offsets in T.chunks(column, ENCODE_BYTES):
            starts, counts = segments(data, offsets)
            edges = pa.array(np.append(starts, len(data)), pa.int64())
            cut = pa.LargeStringArray.from_buffers(len(starts), edges.buffers()[1], pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
            known = self._known(cut.dictionary.to_pylist())
            sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
            values = np.frombuffer(b"".join(known), "<u4")
            at = cut.indices.to_numpy()
            begins = np.cumsum(sizes) - sizes
            long = sizes[at]
            ends = np.cumsum(long)
            ids = values[np.repeat(begins[at] - (ends - long), long) + np.arange(ends[-1] if len(ends) else 0)]
            bounds = np.append(0, ends)[np.append(0, np.cumsum(counts))]
            for low, high in pairwise(bounds.tolist()):
                yield np.append(ids[low:high], self._end).tobytes()

    def ids(self, text: str | None) -> bytes:
        """Ids of one text and the end id."""
        return next(self.batches(pa.array([text], pa.large_string())))


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """The worker process's encoder, whose memory outlasts a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def key_of(identifier: int | None) -> bytes:
    return b"" if identifier is None else struct.pack(">Q", (identifier + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard; keys must come in order.  Holds one block at a time, and the index and keys' hashes."""

    def __init__(self, sink):
        self._sink = sink
        self._at = 0
        self._block, self._entries, self._first, self._last = bytearray(), 0, b"", b""
        self._index: list[bytes] = []
        self._hashes: list[bytes] = []
        self._count = self._ids = 0
        self._packer = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        values = np.frombuffer(ids, "<u4")
        # id width goes with the value: its first byte
        value = b"\x02" + values.astype("<u2").tobytes() if not len(values) or values.max() < 1 << 16 else b"\x04" + ids
        shared = 0
        if self._entries:
            most = min(len(key), len(self._last))
            while shared < most and key[shared] == self._last[shared]:
                shared += 1
        else:
            self._first = key
        self._block += _ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self._entries += 1
        self._last = key
        self._hashes.append(key)
        self._count += 1
        self._ids += len(values)
        if len(self._block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> None:
        self._sink.write(data)
        self._at += len(data)

    def _flush(self) -> None:
        if self._entries:
            packed = self._packer.compress(bytes(self._block))
            self._index.append(_INDEX.pack(len(self._first), self._at, len(packed), self._entries) + self._first)
            self._put(packed)
            self._block, self._entries = bytearray(), 0

    def close(self) -> tuple[int, int, int]:
        """Finish the shard; returns its documents, ids and bytes."""
        self._flush()
        index, index_at = b"".join(self._index), self._at
        self._put(index)
        bits = 1 << max(6, (BLOOM_BITS_PER_KEY * max(1, self._count) - 1).bit_length())
        bloom = np.zeros(bits // 8, np.uint8)
        for key in self._hashes:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self._at
        self._put(bloom.tobytes())
        self._put(_FOOTER.pack(index_at, len(index), bloom_at, len(bloom), len(self._index), self._count, self._ids, BLOOM_HASHES, MAGIC))
        return self._count, self._ids, self._at


class Reader:
    """Reads one shard: all entries in order, or those of one key by binary search."""

    def __init__(self, source, size: int):
        self._source = source
        source.seek(size - _FOOTER.size)
        footer = _FOOTER.unpack(source.read(_FOOTER.size))
        index_at, index_len, self._bloom_at, self._bloom_len, blocks, self.documents, self.ids, _, magic = footer
        if magic != MAGIC:
            raise ValueError("not a token shard")
        source.seek(index_at)
        raw, at = source.read(index_len), 0
        self._keys: list[bytes] = []
        self._blocks: list[tuple[int, int, int]] = []
        for _ in range(blocks):
            n, *place = _INDEX.unpack_from(raw, at)
            at += _INDEX.size
            self._keys.append(raw[at : at + n])
            self._blocks.append(tuple(place))
            at += n
        self._bloom: bytes | None = None

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        offset, length, entries = self._blocks[i]
        self._source.seek(offset)
        data = zstandard.ZstdDecompressor().decompress(self._source.read(length))
        at, key = 0, b""
        for _ in range(entries):
            shared, rest, size = _ENTRY.unpack_from(data, at)
            at += _ENTRY.size
            key = key[:shared] + data[at : at + rest]
            at += rest
            value = data[at : at + size]
            at += size
            yield key, value[1:] if value[0] == 4 else np.frombuffer(value, "<u2", offset=1).astype("<u4").tobytes()

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self._blocks)):
            yield from self._block(i)

    def may_hold(self, key: bytes) -> bool:
        if self._bloom is None:
            self._source.seek(self._bloom_at)
            self._bloom = self._source.read(self._bloom_len)
        return all(self._bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, 8 * self._bloom_len))

    def get(self, key: bytes) -> list[bytes]:
        """Ids of every document with this key."""
        if not self._keys or not self.may_hold(key):
            return []
        # the first block that starts at or after the key, and the one before it
        i, found = max(0, bisect_right(self._keys, key) - 1), []
        while i > 0 and self._keys[i] == key:
            i -= 1
        for j in range(i, len(self._blocks)):
            if self._keys[j] > key:
                break
            found += [ids for k, ids in self._block(j) if k == key]
        return found


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode documents and write them as shards in ascending order of id; returns the manifest.

    The rows are range-partitioned by id, sorted within partitions, and
    streamed, a document at a time, into one shard each.  A task writes under a
    name of its own, and the manifest (stored as Parquet beside the shards)
    names only those of tasks that finished, so a task that is run again leaves
    nothing that counts.  Nulls sort first; equal ids are ordered by text.
    ``path`` is a URI that pyarrow's file systems open.
    """
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    by = [F.col("doc_id").asc_nulls_first()]
    ordered = ordered.repartitionByRange(shards, *by) if shards else ordered.repartitionByRange(*by)
    ordered = ordered.sortWithinPartitions(*by, F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = writer = sink = None
        low = high = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = encoder_for(tokenizer_path)
                files, root = pafs.FileSystem.from_uri(path)
                files.create_dir(root, recursive=True)
                name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.sst"
                sink = files.open_output_stream(f"{root}/{name}")
                writer, low = Writer(sink), batch.column(0)[0].as_py()
            for high, ids in zip(batch.column(0).to_pylist(), encoder.batches(batch.column(1)), strict=True):
                writer.add(key_of(high), ids)
        if writer is not None:
            documents, ids, size = writer.close()
            sink.close()
            row = {"shard": [TaskContext.get().partitionId()], "file": [f"{path}/{name}"], "low": [low], "high": [high], "documents": [documents], "ids": [ids], "bytes": [size]}
            schema = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
            yield pa.RecordBatch.from_pydict(row, schema=schema)

    return stored(ordered.mapInArrow(run, "shard long, file string, low long, high long, documents long, ids long, bytes long"), "token_manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document of the shards: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, in no order.

    ``start`` counts the ids of all documents before it: those of the shards
    before (a running sum over the manifest, a row for each shard) and those
    before it in its shard.
    """
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", "file", "bytes", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("before"))
    placed = placed.repartition(placed.sparkSession.sparkContext.defaultParallelism * 4, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for row in batch.to_pylist():
                files, root = pafs.FileSystem.from_uri(row["file"])
                start, out = row["before"], [[], [], [], []]
                with files.open_input_file(root) as source:
                    for key, ids in Reader(source, row["bytes"]):
                        for column, value in zip(out, (id_of(key), start, len(ids) // 4, zlib.crc32(ids)), strict=True):
                            column.append(value)
                        start += len(ids) // 4
                        if len(out[0]) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)
                            out = [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, identifiers: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token ids (``array<long>``) of the asked documents: range join on shards' key ranges, then binary search.

    An identifier that no shard holds gives no row; one that several documents
    have gives a row for each.
    """
    asked = identifiers.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    ranges = manifest.select("file", "bytes", "low", "high")
    inside = (F.col("doc_id") >= F.coalesce("low", F.lit(-(1 << 63)))) & (F.col("doc_id") <= F.col("high"))
    per_file = asked.join(F.broadcast(ranges), inside).groupBy("file", "bytes").agg(F.collect_list("doc_id").alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, root = pafs.FileSystem.from_uri(row["file"])
                with files.open_input_file(root) as source:
                    reader = Reader(source, row["bytes"])
                    for identifier in sorted(row["wanted"]):
                        for ids in reader.get(key_of(identifier)):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([identifier], pa.int64()), pa.array([np.frombuffer(ids, "<u4").astype(np.int64)], pa.list_(pa.int64()))], ["doc_id", "ids"]
                            )

    return per_file.mapInArrow(run, "doc_id long, ids array<long>")


def token_shards(spark: SparkSession, docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token shards and return what reading them back gives.

    Null and empty texts hold only the end id; a null ``doc_id`` comes first;
    rows that repeat are all written.  An empty table writes no shard and gives
    an empty result; other columns are ignored.
    """
    return read_shards(write_shards(docs, path or scratch_path(spark, "tokens"), tokenizer_path, **options))
