"""Sorted-string-table shards of token ids (operator 6).

A shard file holds entries in ascending key order:

  blocks    zstd frames of about BLOCK bytes; an entry is three varints (shared
            prefix with the previous key, rest of the key, ids) followed by the
            key's rest and the ids (little-endian, 2 or 4 bytes each)
  index     for each block: its last key, its place, and how many ids come before
  bloom     one bit array over all keys, double hashing
  footer    64 bytes: places of index and bloom, totals, id width, magic

A lookup reads the footer, asks the Bloom filter, searches the block index by
bisection and decodes one block. Keys are 8 bytes, big-endian with the sign bit
turned (so byte order is integer order); a null key is the empty string.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import open_fs, write_whole
from .storage import cut, fresh_path, partitions
from .textvec import chunks
from .tokens import tokenizer

MAGIC = b"PWSSTBL1"
BLOCK = 64 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
FOOTER = struct.Struct("<QQQQQQII8s")
#: Bytes of text that one shard takes at most, about.
SHARD_BYTES = 256 << 20

MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"
ENTRIES = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encode_key(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def decode_key(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


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


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 0), xxhash.xxh64_intdigest(key, 1) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Takes (key, ids) in ascending key order; equal keys may follow each other."""

    def __init__(self, out, id_bytes: int):
        self.out, self.width = out, id_bytes
        self.zip = zstandard.ZstdCompressor(level=1)
        self.block, self.last, self.place, self.before = bytearray(), b"", 0, 0
        self.keys: list[bytes] = []
        self.index: list[bytes] = []
        self.n_docs = self.n_tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        data = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + data
        self.last = key
        self.keys.append(key)
        self.n_docs += 1
        self.n_tokens += len(ids)
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.zip.compress(bytes(self.block))
            self.out.write(data)
            self.index.append(_varint(len(self.last)) + self.last + struct.pack("<QQQ", self.place, len(data), self.before))
            self.place += len(data)
            self.block, self.before = bytearray(), self.n_tokens

    def close(self) -> int:
        """Writes what is left; the file's size."""
        self._flush()
        index = _varint(len(self.index)) + b"".join(self.index)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros(-(-bits // 8), np.uint8)
        places = np.array([p for k in self.keys for p in _bloom_places(k, bits)], np.int64)
        np.bitwise_or.at(bloom, places >> 3, (1 << (places & 7)).astype(np.uint8))
        self.out.write(index)
        self.out.write(bloom.tobytes())
        at = self.place
        self.out.write(FOOTER.pack(at, len(index), at + len(index), bits, self.n_docs, self.n_tokens, self.width, 0, MAGIC))
        return at + len(index) + len(bloom) + FOOTER.size


class Reader:
    """One shard file: get(doc_id) by bisection, or iteration over everything."""

    def __init__(self, uri: str):
        system, path = open_fs(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        at, n, bloom_at, self.bits, self.n_docs, self.n_tokens, self.width, _, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no table of this format")
        index = self.file.read_at(n, at)
        self.bloom = self.file.read_at(-(-self.bits // 8), bloom_at)
        blocks, p = _read_varint(index, 0)
        self.last_keys: list[bytes] = []
        self.blocks: list[tuple[int, int, int]] = []
        for _ in range(blocks):
            k, p = _read_varint(index, p)
            self.last_keys.append(index[p : p + k])
            self.blocks.append(struct.unpack_from("<QQQ", index, p + k))
            p += k + 24
        self.unzip = zstandard.ZstdDecompressor()

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits))

    def _entries(self, block: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        place, size, before = self.blocks[block]
        data, at, key = self.unzip.decompress(self.file.read_at(size, place)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, before, np.frombuffer(data, "<u2" if self.width == 2 else "<u4", n, at)
            at += n * self.width
            before += n

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of this shard before it, ids) in key order."""
        for b in range(len(self.blocks)):
            for key, before, ids in self._entries(b):
                yield decode_key(key), before, ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each entry with this key (none, one, or several repeated rows)."""
        key, out = encode_key(doc_id), []
        if not self.may_have(key):
            return out
        for b in range(bisect_left(self.last_keys, key), len(self.blocks)):
            for k, _, ids in self._entries(b):
                if k == key:
                    out.append(ids)
                elif k > key:
                    return out
        return out


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Encode docs (doc_id, text) and write them as shards below path; the manifest (MANIFEST).

    Null text counts as empty and still has end_id; a null doc_id comes first;
    repeated rows are entries each, equal keys in order of their text. The texts
    are dealt by doc_id range and sorted there, then encoded and written in one go.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(partitions(docs.sparkSession), ceil(size / SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, shard = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        target = f"{path}/shard-{shard:06d}.sst"
        done: list[tuple] = []

        def write(out) -> None:
            width = 2 if max(tok.tokenizer.get_vocab_size(), end_id + 1) <= 65_536 else 4
            w, batch = Writer(out, width), first
            while batch is not None:
                ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for lo, hi in chunks(texts):
                    flat, off = tok.ids(texts[lo:hi])
                    for k in range(hi - lo):
                        w.add(encode_key(ids_of[lo + k]), np.append(flat[off[k] : off[k + 1]], np.uint32(end_id)))
                batch = next(batches, None)
            size = w.close()
            done.append((w.n_docs, w.n_tokens, size))

        write_whole(target, write)
        n_docs, n_tokens, n_bytes = done[0]
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [target], "n_docs": [n_docs], "n_tokens": [n_tokens], "n_bytes": [n_bytes]})

    dealt = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return cut(dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").mapInArrow(run, MANIFEST))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Everything in the shards, from the files: ENTRIES, start counting over all shards."""
    total = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(total), F.lit(0).cast("long"))).select("path", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with Reader(path) as r:
                    rows = [(d, base + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, before, ids in r]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(partitions(manifest.sparkSession), manifest.count()))
    return files.repartition(n).mapInArrow(run, ENTRIES)


def token_shards(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 2) -> tuple[DataFrame, DataFrame]:
    """Write docs as shards (below the shared folder unless path is given): manifest and what the files hold."""
    manifest = write_shards(docs, path or fresh_path(docs.sparkSession, "sst"), tokenizer_path, end_id)
    return manifest, read_shards(manifest)
