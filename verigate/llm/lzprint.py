"""Operator 7: Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (each is the shortest string that isn't a phrase yet: a known phrase and
one more character). The phrases' hashes, as a set, give a one-permutation minimum-hash signature; the share of
equal bins estimates how many phrases two texts have in common, as a compressor that knows one would on the other.

Phrase sets contain every prefix of a phrase, so the longest known phrase at a place is found by stepping from
the last phrase's length up or down. A text and its edited form share their parse up to the first edited
character.

Documents meet their successors by ranges of (identifier, text hash): the bounds are where the ranges of an exchange
of these two numbers begin; the first document of a range also goes, once more, to the range before it. Equal rows are
counted before the exchange, and go as one.

Defined results: a null text is empty; an empty text has the fingerprint without phrases, likeness 1 to another
such and 0 to all others; repeated identifiers follow each other by a hash of their texts; a null identifier comes
first; a single document is its own successor; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verigate.llm.common import frugal, mix64, n_partitions, seeds64

BINS, NO_ID = 128, -(1 << 63)
#: Ranges at most (their bounds are known to every task); beyond, ranges grow and stay streams.
MAX_RANGES = 20_000
_NONE = 0xFFFF
_BASE = int(seeds64(1, 77)[0]) | 1
_tables: list[np.ndarray] = []


def _parse(text: str, known: set[str], at: int, stop: int) -> tuple[int, list[int]]:
    """Phrases from ``at`` on that end by ``stop``: where the next one begins, and the ends."""
    n, size, ends = len(text), 4, []
    while at < stop:
        if text[at : at + size] in known:
            size += 1
            while at + size <= n and text[at : at + size] in known:
                size += 1
        else:
            while size > 1 and text[at : at + size - 1] not in known:
                size -= 1
        end = min(at + size, n)
        if end > stop:
            return at, ends
        known.add(text[at:end])
        ends.append(end)
        at = end
    return at, ends


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        _tables.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 17), base, dtype=np.uint64)
            p[0] = 1
            _tables.append(np.cumprod(p))
    return _tables[0][:n], _tables[1][:n]


def signature(text: str, ends: list[int]) -> np.ndarray:
    """The smallest hash in each bin (16 bits of it; ``_NONE``: no phrase there) of the phrases that end at ``ends``."""
    sig = np.full(BINS, _NONE, dtype=np.uint64)
    if not ends:
        return sig.astype(np.uint16)
    up, down = _powers(len(text) + 1)
    prefix = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum(mix64(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    end = np.array(ends)
    begin = np.concatenate(([0], end[:-1]))
    h = mix64((prefix[end] - prefix[begin]) * down[begin])
    low = np.full(BINS, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(low, (h >> np.uint64(57)).astype(np.int64), h & np.uint64((1 << 57) - 1))
    held = low != np.uint64(0xFFFFFFFFFFFFFFFF)
    sig[held] = low[held] % np.uint64(_NONE)
    return sig.astype(np.uint16)


def parsed(text: str) -> tuple[list[int], np.ndarray]:
    """The ends of a text's phrases, and its fingerprint."""
    ends = _parse(text, set(), 0, len(text))[1]
    return ends, signature(text, ends)


def edited_fingerprint(text: str, ends: list[int], edited: str, shared: int) -> np.ndarray:
    """The fingerprint of a text that begins with ``shared`` characters of a parsed one."""
    same = ends[: bisect.bisect_right(ends, shared)]
    known = {text[s:e] for s, e in zip([0, *same], same, strict=False)}
    return signature(edited, same + _parse(edited, known, same[-1] if same else 0, len(edited))[1])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    used = (a != _NONE) | (b != _NONE)
    n = int(used.sum())
    return float(((a == b) & used).sum() / n) if n else 1.0


def _hex(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def _codes(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a number that Spark's hash deals to it."""
    found = spark.range(32 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("code")).collect()  # n rows
    codes = {r["p"]: r["code"] for r in found}
    return [codes.get(p, p) for p in range(n)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last n_chars // 2 characters replaced by the first as many (or all) of the next document.
    """
    spark = docs.sparkSession
    n = min(MAX_RANGES, partitions or n_partitions(docs, 16 << 20))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    text = F.coalesce(F.col(text_col), F.lit(""))
    no_id = F.col(id_col).isNull()
    rows = docs.select(key.alias("key"), no_id.alias("no_id"), F.xxhash64(no_id, text).alias("tie"), text.alias("text"))
    dealt_numbers = rows.select("key", "tie").repartitionByRange(n, "key", "tie").withColumn("part", F.spark_partition_id())
    firsts = dealt_numbers.groupBy("part").agg(F.min(F.struct("key", "tie")).alias("first")).collect()  # one row for each range
    bounds = np.array(sorted({(r["first"]["key"], r["first"]["tie"]) for r in firsts}), dtype=[("key", "<i8"), ("tie", "<i8")])
    last = len(bounds) - 1
    codes = np.array(_codes(spark, last + 1) if last >= 0 else [], dtype=np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        names = ["code", "part", "tail", "key", "no_id", "tie", "copies", "zip"]
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.empty(b.num_rows, dtype=bounds.dtype)
            ids["key"], ids["tie"] = b.column(0).to_numpy(), b.column(2).to_numpy()
            _, one, copies = np.unique(ids, return_index=True, return_counts=True)
            own, ids = b.take(pa.array(one)), ids[one]
            part = np.searchsorted(bounds, ids, side="right") - 1
            zips = pa.array([squeeze.compress(t.as_buffer()) for t in own.column(3).cast(pa.large_binary())], pa.binary())
            first = np.flatnonzero(ids == bounds[part])  # these go to the range before, too
            for take, where, tail in ((np.arange(len(ids)), part, False), (first, (part[first] - 1) % (last + 1), True)):
                if len(take):
                    at = pa.array(take)
                    columns = [pa.array(codes[where]), pa.array(where.astype(np.int32)), pa.array([tail] * len(take)), *(own.column(c).take(at) for c in range(3)), pa.array(copies[take].astype(np.int64)), zips.take(at)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        held, where, out = None, None, []
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        with np.errstate(over="ignore"):
            for b in batches:
                for part, tail, doc_id, no_id, copies, zipped in zip(*(b.column(i) for i in (1, 2, 3, 4, 6, 7)), strict=True):
                    if tail.as_py() and held is None:
                        continue  # a repeat of the next range's first document
                    text = unzip.decompress(zipped.as_buffer()).decode("utf-8", "replace")
                    own = parsed(text)
                    if held is not None and where == part.as_py():
                        out.append(_compared(*held, text, own))
                    where = part.as_py()
                    held = None if tail.as_py() else (None if no_id.as_py() else doc_id.as_py(), text, own)
                    if held and copies.as_py() > 1:  # equal rows follow each other
                        again = _compared(*held, text, own)
                        for _ in range(copies.as_py() - 1):
                            out.append(again)
                            if len(out) >= 1024:
                                yield batch()
                                out.clear()
                yield batch()
                out.clear()

    parts = rows.mapInArrow(frugal(dealt), "code long, part int, tail boolean, key long, no_id boolean, tie long, copies long, zip binary").repartition(max(1, last + 1), "code")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return parts.sortWithinPartitions("part", "tail", "key", "tie").mapInArrow(frugal(printed), schema)


def _compared(doc_id: int | None, text: str, own: tuple, following: str, after: tuple) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    changed = edited_fingerprint(text, own[0], edited, len(text) - half)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), _hex(own[1]), _hex(changed), likeness(own[1], changed), likeness(own[1], after[1])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: fingerprints of all documents, of their edited forms, and likeness to these and to the next document."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
