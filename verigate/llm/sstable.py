"""Operator 1: token ids in sorted-string-table shards.

A shard is one file. Documents stand in it by ascending key, in blocks; keys within a block are
prefix-compressed, with restart points for a binary search; a sparse index has one entry for each block; a
Bloom filter answers for absent keys; a footer of fixed size says where these parts are::

    block* index bloom footer          (each part is followed by one byte, 0x0A)

The parts are rows of a DataFrame and Spark's text writer puts them down, with 0x0A as its line end. So the
files go to any store that Spark can write, by its commit protocol: a task that is lost and run again leaves
exactly one copy. Byte offsets count the line ends.

Defined results: a null identifier has the empty key and comes first; a null text has no ids of its own;
repeated identifiers are all kept, next to each other, ordered by a hash of the text, in one shard or in shards that
follow each other; an empty table gives no shard; columns other than the identifier and the text are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verigate.llm.common import fresh_path, frugal, n_partitions
from verigate.llm.tokens import encoder

MAGIC, VERSION = b"VGSST\x00\x00\x01", 1
#: Raw bytes after which a block ends; entries between restart points; Bloom bits for each key and hashes.
BLOCK_BYTES, RESTART, BLOOM_BITS, BLOOM_HASHES = 128 << 10, 16, 10, 7
_FOOTER = struct.Struct("<8sIIQQQQQQIB8s")
_ENTRY = struct.Struct("<QIIIQ")
_END = b"\n"


def key_of(doc_id: int | None) -> bytes:
    """Order-preserving key: the identifier with its sign bit turned, big-endian; empty for null."""
    return b"" if doc_id is None else struct.pack(">Q", (int(doc_id) + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
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


def _bloom_at(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % (1 << 64) % bits for i in range(BLOOM_HASHES)]


class _Block:
    def __init__(self) -> None:
        self.out, self.restarts, self.n, self.last, self.tokens = bytearray(), [], 0, b"", 0

    def add(self, key: bytes, value: bytes, tokens: int) -> None:
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.out))
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        self.out += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.n, self.tokens = key, self.n + 1, self.tokens + tokens

    def done(self) -> bytes:
        return bytes(self.out) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))


def shard_parts(entries: Iterator[tuple[bytes, bytes]], id_width: int) -> Iterator[bytes]:
    """The parts of one shard, from (key, ids as little-endian 32-bit) in ascending order of the keys."""
    squeeze = zstandard.ZstdCompressor(level=1)
    index, keys, block, at, docs, tokens = [], [], _Block(), 0, 0, 0

    def flush() -> bytes:
        nonlocal block, at, tokens
        raw = block.done()
        packed = squeeze.compress(raw)
        index.append(struct.pack("<I", len(block.last)) + block.last + _ENTRY.pack(at, len(packed), len(raw), zlib.crc32(packed), tokens))
        at += len(packed) + len(_END)
        tokens += block.tokens
        block = _Block()
        return packed

    for key, ids in entries:
        n = len(ids) // 4
        block.add(key, ids if id_width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes(), n)
        keys.append(key)
        docs += 1
        if len(block.out) >= BLOCK_BYTES:
            yield flush()
    if block.n:
        yield flush()
    if not docs:
        return
    index_at, body = at, b"".join(index)
    yield body
    bits = max(64, len(keys) * BLOOM_BITS)
    bloom = bytearray((bits + 7) // 8)
    for key in keys:
        for b in _bloom_at(key, bits):
            bloom[b >> 3] |= 1 << (b & 7)
    bloom_at = index_at + len(body) + len(_END)
    yield bytes(bloom)
    head = _FOOTER.pack(MAGIC, VERSION, id_width, docs, tokens, index_at, len(body), bloom_at, len(bloom), bits, len(keys[0]), keys[0])
    yield head + struct.pack("<I", zlib.crc32(head))


class Shard:
    """Reads one shard by byte ranges: the footer, then index and Bloom filter, then single blocks as they are asked for."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        """``read(at, n)`` gives n bytes from byte ``at`` on; ``size`` is the shard's."""
        length = _FOOTER.size + 4
        foot = read(size - len(_END) - length, length) if size > length else b""
        if len(foot) != length or struct.unpack("<I", foot[-4:])[0] != zlib.crc32(foot[:-4]) or foot[:8] != MAGIC:
            raise ValueError("not a shard, or damaged")
        self.read = read
        _, _, self.id_width, self.n_docs, self.n_tokens, self.index_at, self.index_len, self.bloom_at, self.bloom_len, self.bits, n, first = _FOOTER.unpack(foot[:-4])
        self.first_key = first[:n]

    @classmethod
    def of(cls, data: bytes) -> Shard:
        return cls(lambda at, n: data[at : at + n], len(data))

    @cached_property
    def bloom(self) -> bytes:
        return self.read(self.bloom_at, self.bloom_len)

    @cached_property
    def _index(self) -> tuple[list[bytes], list[tuple]]:
        data, at, keys, blocks = self.read(self.index_at, self.index_len), 0, [], []
        while at < len(data):
            (n,) = struct.unpack_from("<I", data, at)
            keys.append(data[at + 4 : at + 4 + n])
            blocks.append(_ENTRY.unpack_from(data, at + 4 + n))
            at += 4 + n + _ENTRY.size
        return keys, blocks

    @property
    def last_keys(self) -> list[bytes]:
        return self._index[0]

    @property
    def blocks(self) -> list[tuple]:
        return self._index[1]

    def _raw(self, i: int) -> bytes:
        at, length, raw, crc, _ = self.blocks[i]
        packed = self.read(at, length)
        if zlib.crc32(packed) != crc:
            raise ValueError(f"block {i} is damaged")
        return zstandard.ZstdDecompressor().decompress(packed, max_output_size=raw)

    def _entries(self, raw: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        (n,) = struct.unpack_from("<I", raw, len(raw) - 4)
        end, key = len(raw) - 4 * (n + 1), b""
        while at < end:
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            yield key, raw[at + rest : at + rest + size]
            at += rest + size

    def _wide(self, value: bytes) -> bytes:
        return value if self.id_width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()

    def documents(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            for key, value in self._entries(self._raw(i)):
                yield key, self._wide(value)

    def lookup(self, doc_id: int | None) -> list[bytes]:
        """The ids of all documents with this identifier (none, one, or more where it repeats)."""
        key = key_of(doc_id)
        if key < self.first_key or not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_at(key, self.bits)):
            return []
        found, i = [], bisect.bisect_left(self.last_keys, key)
        while i < len(self.blocks):
            raw = self._raw(i)
            (n,) = struct.unpack_from("<I", raw, len(raw) - 4)
            restarts = struct.unpack_from(f"<{n}I", raw, len(raw) - 4 * (n + 1))
            lo = bisect.bisect_left(restarts, key, key=lambda at, raw=raw: next(self._entries(raw, at))[0])
            for k, value in self._entries(raw, restarts[max(0, lo - 1)]):
                if k > key:
                    return found
                if k == key:
                    found.append(self._wide(value))
            i += 1
        return found


def write_shards(docs: DataFrame, folder: str, tokenizer: str, pattern: str | None = None, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Encodes every whole text and writes the shards. One exchange, by ranges of the identifier."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]  # an identifier that many rows have may go over several shards
    rows = rows.repartitionByRange(shards or n_partitions(docs), *order).sortWithinPartitions(*order)
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, pattern)

        def entries() -> Iterator[tuple[bytes, bytes]]:
            for b, part in enc.encode_batches(batches, "text"):
                for doc_id, out in zip(b.column(0).to_pylist(), part, strict=True):
                    yield key_of(doc_id), out + tail

        for part in shard_parts(entries(), 2 if max(enc.vocabulary, (end_id or 0) + 1) <= 1 << 16 else 4):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], ["part"])

    rows.mapInArrow(frugal(parts), "part binary").select(F.col("part").cast("string")).write.option("lineSep", "\n").option("compression", "none").text(folder)


def _opened(spark: SparkSession, folder: str) -> list[tuple[str, Shard]]:
    """The shards of a folder by ascending first key, read by byte ranges through Spark's file system: a footer each."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    slurp = spark._jvm.org.apache.commons.io.IOUtils.toByteArray

    def open_(file: tuple) -> tuple[str, Shard]:
        path, size = file

        def read(at: int, n: int) -> bytes:
            stream = system.open(path)
            try:
                stream.seek(at)
                return bytes(slurp(stream, n))
            finally:
                stream.close()

        return path.toString(), Shard(read, size)

    files = [(s.getPath(), s.getLen()) for s in system.listStatus(root) if s.getPath().getName().startswith("part-")]
    with ThreadPoolExecutor(16) as pool:
        return sorted(pool.map(open_, [f for f in files if f[1]]), key=lambda s: (s[1].first_key, s[0]))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the shards: doc_id, start, n_tokens, ids (binary, little-endian 32-bit).

    start counts the ids of all documents before it. The shards' totals come from their footers (one row for each
    shard) and are added up in the order of the shards' first keys; the shards themselves are read once.
    """

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "doc_id", "at", "n_tokens", "ids"])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard, name = Shard.of(b.column(0)[i].as_py()), b.column(1)[i].as_py()
                at, rows, size = 0, [], 0
                for key, ids in shard.documents():
                    rows.append((name, id_of(key), at, len(ids) // 4, ids))
                    at, size = at + len(ids) // 4, size + len(ids)
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    totals, at = [], 0
    for path, shard in _opened(spark, folder):
        totals.append((path.rsplit("/", 1)[-1], at))
        at += shard.n_tokens
    shift = spark.createDataFrame(totals, "of string, shift long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content", F.element_at(F.split("path", "/"), -1).alias("name"))
    rows = files.mapInArrow(frugal(decoded), "shard string, doc_id long, at long, n_tokens long, ids binary")
    return rows.join(F.broadcast(shift), rows["shard"] == shift["of"]).select("doc_id", (F.col("at") + F.col("shift")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, folder: str, doc_ids: list[int | None]) -> DataFrame:
    """The ids of a short list of documents: doc_id, ids.

    Only shards whose first key isn't beyond an identifier are asked; of these the footer, then (where the identifier may
    be in it) Bloom filter and index, and single blocks are read.
    """
    shards = [s for _, s in _opened(spark, folder)]
    firsts = [s.first_key for s in shards]
    found = []
    for doc_id in doc_ids:
        i = bisect.bisect_right(firsts, key_of(doc_id)) - 1
        while i >= 0:
            found += [(doc_id, bytearray(ids)) for ids in shards[i].lookup(doc_id)]
            i = i - 1 if firsts[i] == key_of(doc_id) else -1  # the shard before may end with the same identifier
    return spark.createDataFrame(found, "doc_id long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents through the shards and back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_path(spark, "sstable")
    write_shards(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=0)
    return read_shards(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
