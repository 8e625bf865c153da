"""Token-id output as sorted-string-table shards, keyed by document id.

File layout, little-endian throughout:

    block*  bloom  index  footer
    block   zstd of: entry*, restart offsets (u32 each), number of restarts (u32); then crc32 of the compressed bytes (u32)
    entry   varint shared, varint unshared, varint value length, unshared key bytes, value
    index   per block: varint key length, last key, u64 offset, u32 size (with its crc32)
    bloom   u32 hashes k, u32 bits m, m/8 bytes
    footer  u64 index offset, u64 bloom offset, u64 entries, u64 ids, u32 id width, u32 crc32 of bloom and index, 8-byte magic

Keys sort as bytes as their documents do by number: the 64-bit id with its sign bit flipped, big-endian,
then a 32-bit counter that tells rows of one id apart; a null id has the key of its counter alone, and sorts first.
Values are the document's ids, id-width bytes each. A key is found by binary search in the index, then among the
block's restart points, after the Bloom filter has let it pass.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import require, scratch_path, staged
from .tokens import encode_slices, encoder

MAGIC = b"LMSSTAB1"
FOOTER = struct.Struct("<QQQQII8s")
BLOCK_BYTES = 256 * 1024
RESTART_EVERY = 16
BLOOM_BITS_PER_KEY = 10
#: A shard is closed at this many ids, so that no file or its index grows with the input.
SHARD_IDS = 16_000_000
#: Bytes of input, as its files have them, for each partition of a write.
PARTITION_BYTES = 32 << 20
MANIFEST = "path string, first_key binary, n_docs long, n_ids long"


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def make_key(doc_id: int | None, copy: int) -> bytes:
    return (b"" if doc_id is None else ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")) + copy.to_bytes(4, "big")


def split_key(key: bytes) -> int | None:
    return None if len(key) == 4 else int.from_bytes(key[:8], "big") - (1 << 63)


def bloom_places(key: bytes, k: int, m: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % m for i in range(k)]


class Writer:
    """Writes one shard; add() takes keys in ascending order."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.at = sink, width, 0
        self.index, self.keys, self.n_ids = bytearray(), [], 0
        self.pack = zstandard.ZstdCompressor(level=1)
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % RESTART_EVERY:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.count, self.last = self.count + 1, key
        self.keys.append(key)
        self.n_ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.count:
            raw = self.pack.compress(bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts)))
            raw += struct.pack("<I", zlib.crc32(raw))
            self.sink.write(raw)
            self.index += varint(len(self.last)) + self.last + struct.pack("<QI", self.at, len(raw))
            self.at += len(raw)
        self._open()

    def finish(self) -> None:
        self._close()
        m, k = max(64, (len(self.keys) * BLOOM_BITS_PER_KEY + 7) // 8 * 8), 7
        bits = np.zeros(m // 8, np.uint8)
        for key in self.keys:
            for p in bloom_places(key, k, m):
                bits[p >> 3] |= 1 << (p & 7)
        bloom = struct.pack("<II", k, m) + bits.tobytes()
        index = bytes(self.index)
        self.sink.write(bloom + index)
        self.sink.write(FOOTER.pack(self.at + len(bloom), self.at, len(self.keys), self.n_ids, self.width, zlib.crc32(bloom + index), MAGIC))


class Reader:
    """Reads a shard from a random-access file: a scan in key order, or one key by binary search."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        if size < FOOTER.size:
            raise ValueError("not a shard: too short")
        index_at, self.bloom_at, self.n_docs, self.n_ids, self.width, crc, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard: wrong magic")
        tail = file.read_at(size - FOOTER.size - self.bloom_at, self.bloom_at)
        if zlib.crc32(tail) != crc:
            raise ValueError("damaged index or Bloom filter")
        self.k, self.m = struct.unpack_from("<II", tail)
        self.bloom = tail[8 : index_at - self.bloom_at]
        index, at = tail[index_at - self.bloom_at :], 0
        self.last_keys, self.places = [], []
        while at < len(index):
            n, at = read_varint(index, at)
            self.last_keys.append(index[at : at + n])
            self.places.append(struct.unpack_from("<QI", index, at + n))
            at += n + 12

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        offset, size = self.places[i]
        raw = self.file.read_at(size, offset)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"damaged block {i}")
        data = zstandard.ZstdDecompressor().decompress(raw[:-4])
        (n,) = struct.unpack_from("<I", data, len(data) - 4)
        end = len(data) - 4 - 4 * n
        return data[:end], list(struct.unpack_from(f"<{n}I", data, end))

    @staticmethod
    def _entry(data: bytes, at: int, last: bytes) -> tuple[bytes, bytes, int]:
        shared, at = read_varint(data, at)
        fresh, at = read_varint(data, at)
        n, at = read_varint(data, at)
        key = last[:shared] + data[at : at + fresh]
        at += fresh
        return key, data[at : at + n], at + n

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.places)):
            data, _ = self._block(i)
            at, key = 0, b""
            while at < len(data):
                key, value, at = self._entry(data, at, key)
                yield key, value

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, self.k, self.m))

    def get(self, key: bytes) -> bytes | None:
        if not self.may_hold(key):
            return None
        i = bisect.bisect_left(self.last_keys, key)
        if i == len(self.places):
            return None
        data, restarts = self._block(i)
        low, high = 0, len(restarts) - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self._entry(data, restarts[mid], b"")[0] <= key else (low, mid - 1)
        at, found = restarts[low], b""
        while at < len(data):
            found, value, at = self._entry(data, at, found)
            if found >= key:
                return value if found == key else None
        return None


def open_shard(path: str) -> Reader:
    fs, inner = pafs.FileSystem.from_uri(path)
    return Reader(fs.open_input_file(inner))


def lookup(manifest: Iterable[tuple[str, bytes]], doc_id: int, copy: int = 0) -> np.ndarray | None:
    """Ids of one document, given (path, first_key) of all shards in key order."""
    shards, key = list(manifest), make_key(doc_id, copy)
    i = bisect.bisect_right([bytes(k) for _, k in shards], key) - 1
    if i < 0:
        return None
    reader = open_shard(shards[i][0])
    value = reader.get(key)
    reader.file.close()
    return None if value is None else np.frombuffer(value, f"<u{reader.width}").astype(np.uint32)


def write_shards(documents: DataFrame, folder: str, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Encode and write all documents in ascending doc_id order; returns the manifest, staged.

    Each attempt of a task writes files of its own name, and only the files of attempts that succeeded
    enter the manifest, so lost executors and repeated tasks leave no half-written shard in it.
    """

    def write(batches):
        fs, inner = pafs.FileSystem.from_uri(folder)
        fs.create_dir(inner, recursive=True)
        width = 2 if encoder(vocabulary).n_ids <= 1 << 16 and end_id < 1 << 16 else 4
        end = end_id.to_bytes(width, "little")
        sink = writer = None
        last_id, copy, done = 0, -1, []

        def close():
            writer.finish()
            sink.close()
            done.append((f"{folder}/{name}", first, len(writer.keys), writer.n_ids))

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, raw in encode_slices(batch.column(1).to_pylist(), vocabulary):
                copy = copy + 1 if copy >= 0 and ids[i] == last_id else 0
                last_id = ids[i]
                key = make_key(last_id, copy)
                if writer is None:
                    name, first = f"{uuid.uuid4().hex}.sst", key
                    sink = fs.open_output_stream(f"{inner}/{name}")
                    writer = Writer(sink, width)
                writer.add(key, np.frombuffer(raw, "<u4").astype(f"<u{width}").tobytes() + end)
                if writer.n_ids >= SHARD_IDS:
                    close()
                    writer = None
        if writer is not None:
            close()
        for path, first_key, docs, n in done:
            yield pa.RecordBatch.from_pylist([{"path": path, "first_key": first_key, "n_docs": docs, "n_ids": n}], schema=pa.schema([("path", pa.string()), ("first_key", pa.binary()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    require(documents, "doc_id", "text")
    spark = documents.sparkSession
    held = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = held.repartitionByRange(_partitions(documents), "doc_id").sortWithinPartitions("doc_id", "text")
    return staged(ordered.mapInArrow(write, MANIFEST), "sst-manifest")


def _partitions(documents: DataFrame) -> int:
    """Partitions of a write: by the planner's estimate of the input's size, which costs no scan; at least the session's number."""
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = max(8, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return least if size >= 1 << 60 else max(least, -(-size // PARTITION_BYTES))  # no estimate is a huge one


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; start counts the ids of all before it."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader, at = open_shard(row["path"]), row["start"]
                out: list[tuple] = []
                for key, value in reader.scan():
                    raw = np.frombuffer(value, f"<u{reader.width}").astype("<u4").tobytes()
                    out.append((split_key(key), at, len(raw) // 4, zlib.crc32(raw)))
                    at += len(raw) // 4
                    if len(out) >= 20_000:
                        yield _batch(out)
                        out = []
                reader.file.close()
                if out:
                    yield _batch(out)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("path", "start")
    shards = max(8, min(manifest.count(), 100_000))
    return starts.repartition(shards, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_sstable(spark, sf_dir: str) -> DataFrame:
    """Contract query: encode all documents, write shards, read them back.

    Null texts are empty and hold the end id alone. Rows of one doc_id are kept apart by a counter, in the
    order of their texts (null first); null ids come first. An empty table writes no shard and gives no rows.
    """
    folder = scratch_path(spark, "sst")
    return read_shards(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder))
