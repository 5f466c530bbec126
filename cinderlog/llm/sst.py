"""Token ids in sorted-string-table shards.

A shard holds documents in ascending doc_id order:

    block*    zstd of entries: varint(shared key bytes) varint(other key bytes)
              varint(ids) key-suffix ids; each followed by its crc32
    index     for each block: its last key, offset and length (sparse index)
    bloom     10 bits a key, 7 probes
    footer    80 bytes: counts, places, id width, magic

Keys are 9 bytes that sort as the ids do, null first. Ids take 2 bytes where the
vocabulary has no more than 65,536 of them, else 4. A lookup asks the Bloom filter,
bisects the index and reads one block.

Cases: null text is empty and has its end id alone; a null doc_id sorts first; rows that
repeat a doc_id are kept next to each other, ordered by their text's hash, and a lookup
returns all of them; an empty table gives no shard and an empty result; texts are encoded
whole; other columns are ignored. A task that runs again writes a shard of another name;
only shards named in the manifest count.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm._text import cut, docs_of, map_arrow, mix, work_dir
from cinderlog.llm.bpe import encoder, vocabulary

MAGIC = b"CLSSTBL1"
BLOCK_BYTES = 64 << 10
BITS_PER_KEY, PROBES = 10, 7
FOOTER = struct.Struct("<9q8s")
END_ID = 1


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        one, two = mix(np.array([zlib.crc32(key), zlib.crc32(key, 0x9747B28C)], np.uint64) + np.frombuffer(key[1:], "<u8")[0])
        return (one + np.arange(PROBES, dtype=np.uint64) * (two | np.uint64(1))) % np.uint64(bits)


class ShardWriter:
    """Writes one shard to a stream; keys must come in ascending order."""

    def __init__(self, stream: object, width: int) -> None:
        self.stream, self.width = stream, width
        self.at = self.docs = self.ids = 0
        self.block, self.block_size, self.last = [], 0, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.zstd = zstandard.ZstdCompressor(level=1)

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        while self.block and shared < len(key) and key[shared] == self.last[shared]:
            shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block.append(entry)
        self.block_size += len(entry)
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(ids)
        if self.block_size >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            data = self.zstd.compress(b"".join(self.block))
            self.index.append((self.last, self.at, len(data)))
            self._write(data + struct.pack("<I", zlib.crc32(data)))
            self.block, self.block_size = [], 0

    def close(self) -> None:
        self._end_block()
        index_at = self.at
        self._write(b"".join(key + struct.pack("<qq", a, n) for key, a, n in self.index))
        bloom_at, bits = self.at, max(64, len(self.keys) * BITS_PER_KEY // 8 * 8)
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_probes(key, bits)] = True
        self._write(np.packbits(bloom, bitorder="little").tobytes())
        self._write(FOOTER.pack(self.docs, self.ids, self.width, len(self.index), index_at, bloom_at, bits, 0, 0, MAGIC))


class ShardReader:
    """Lookups and scans over one shard, read from any file system that pyarrow knows."""

    def __init__(self, path: str) -> None:
        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        self.docs, self.ids, self.width, blocks, index_at, bloom_at, self.bits, _, _, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        raw = self._read(index_at, blocks * 25)
        self.index = [(raw[i : i + 9], *struct.unpack_from("<qq", raw, i + 9)) for i in range(0, len(raw), 25)]
        self.last_keys = [x[0] for x in self.index]
        self.bloom = np.unpackbits(np.frombuffer(self._read(bloom_at, self.bits // 8), np.uint8), bitorder="little")
        self.blocks_read = 0

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def close(self) -> None:
        self.file.close()

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n = self.index[i]
        raw = self._read(at, n + 4)
        if zlib.crc32(raw[:n]) != struct.unpack("<I", raw[n:])[0]:
            raise ValueError("a block is damaged")
        self.blocks_read += 1
        data, at, key = zstandard.ZstdDecompressor().decompressobj().decompress(raw[:n]), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, np.frombuffer(data, "<u2" if self.width == 2 else "<u4", n, at).astype("<u4")
            at += n * self.width

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, ids in self._block(i):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of the documents with this id: none, one, or one for each repeated row."""
        key, out = key_of(doc_id), []
        if not self.bloom[_probes(key, self.bits)].all():
            return out
        for i in range(bisect_left(self.last_keys, key), len(self.index)):
            for own, ids in self._block(i):
                if own == key:
                    out.append(ids)
                elif own > key:
                    return out
        return out


def write_shards(documents: DataFrame, vocabulary_path: str, folder: str) -> DataFrame:
    """Writes shards to folder (a URI that all executors reach); returns the manifest.

    The manifest has a row for each shard: path, first_id, n_docs, n_ids.
    """
    docs = docs_of(documents).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own, writer = encoder(vocabulary_path), None
        width = 2 if len(vocabulary(vocabulary_path).names) <= 1 << 16 else 4
        path, first = f"{folder}/shard-{uuid.uuid4().hex}.sst", None
        end = np.array([END_ID], "<u4")
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, found in zip(ids, own.encode(batch.column("text").to_pylist()), strict=True):
                if writer is None:
                    system, name = fs.FileSystem.from_uri(path)
                    system.create_dir(name.rpartition("/")[0], recursive=True)
                    writer, first = ShardWriter(system.open_output_stream(name), width), doc_id
                writer.add(doc_id, np.concatenate([found, end]))
        if writer is not None:
            writer.close()
            writer.stream.close()
            yield {"path": [path], "first_id": [first], "n_docs": [writer.docs], "n_ids": [writer.ids]}

    return cut(map_arrow(docs, run, "path string, first_id long, n_docs long, n_ids long"))


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the files.

    The driver gets the manifest alone, a row for each shard, to add up where each starts.
    """
    spark = manifest.sparkSession
    shards = sorted(manifest.collect(), key=lambda x: key_of(x.first_id))
    starts = np.cumsum([0, *(x.n_ids for x in shards)])
    rows = [(x.path, int(s)) for x, s in zip(shards, starts, strict=False)]
    todo = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader = ShardReader(path)
                part: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                for doc_id, ids in reader.scan():
                    for name, value in (("doc_id", doc_id), ("start", start), ("n_tokens", len(ids)), ("ids_crc32", zlib.crc32(ids.tobytes()))):
                        part[name].append(value)
                    if with_ids:
                        part["ids"].append(ids.tolist())
                    start += len(ids)
                    if len(part["doc_id"]) == 5000:
                        yield part
                        part = {k: [] for k in part}
                yield part
                reader.close()

    return map_arrow(todo, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_output(documents: DataFrame, vocabulary_path: str, folder: str | None = None) -> DataFrame:
    """Encodes documents to shards and returns what the shards hold."""
    folder = folder or work_dir(documents.sparkSession)
    return read_shards(write_shards(documents, vocabulary_path, folder))


def find(paths: Iterable[str], doc_id: int | None) -> list[np.ndarray]:
    """A document's ids from whichever shard has it."""
    out = []
    for path in paths:
        reader = ShardReader(path)
        out += reader.get(doc_id)
        reader.close()
    return out
