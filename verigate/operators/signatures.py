"""Signatures of sets: keys by which like sets meet, and sketches by which unlike ones part, before a set is moved.

Sets are arrays of distinct 64-bit hashes. Two sets of sizes a and b that are alike by t differ in at most
D = (1 - t) / (1 + t) * (a + b) elements. Hence

* *shares*: when elements are dealt by their hash to more than D shares, one share at least is equal in both. D is taken
  for a range of sizes (a level): a set has keys for its own level, and for the level below, where it is the larger set.
  That misses nothing.
* *bands*: minimum hashes in bands, of which like sets share one but for a known chance.
* *sketches*: each element turns one bit over. Bits that differ are never more than elements that differ, so a pair whose
  sketches differ in more than D bits isn't alike. That drops nothing that is.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

#: Words of a sketch, of a wide one, and the size from which a set has a wide one too.
WORDS, WIDE, WIDE_FROM = 8, 64, 400
#: Elements that are signed at once, so that memory is bounded.
AT_ONCE = 1 << 19


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bounded(threshold: float) -> float:
    return min(max(threshold, 0.01), 1.0)


@lru_cache
def levels(threshold: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The least size of each level up to the size ``most``, and how many shares sets have that meet there: the smaller
    one is of the level."""
    t, low = bounded(threshold), [1]
    while low[-1] <= most:
        low.append(int(np.floor(low[-1] / t + 1e-9)) + 1)
    top = np.array(low[1:]) - 1
    return np.array(low), np.floor((1 - t) / (1 + t) * (top + np.floor(top / t + 1e-9)) + 1e-9).astype(np.int64) + 1


def _shares(v: np.ndarray, of: np.ndarray, m: np.ndarray, salt: np.ndarray, threshold: float, lower: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, how many of each set) at the sets' own level, or so many below it."""
    low, shares = levels(threshold, 1 << int(m.max(initial=1)).bit_length())
    level = np.searchsorted(low, m, "right") - 1 - lower
    n = np.where(level >= 0, shares[np.maximum(level, 0)], 0)
    n[m == 0] = 0
    base = np.concatenate([[0], np.cumsum(n)])
    here = n[of] > 0
    v, of = v[here], of[here]
    with np.errstate(over="ignore"):
        sums = np.zeros(base[-1], np.uint64)
        np.add.at(sums, base[of] + ((v >> np.uint64(7)) % n[of].astype(np.uint64)).astype(np.int64), _mix(v))
        owner = np.repeat(np.arange(len(m)), n)
        place = (level[owner].astype(np.uint64) << np.uint64(40)) + (np.arange(base[-1]) - base[owner]).astype(np.uint64)
        return _mix(sums + _mix(place + np.uint64(1)) + salt[owner]), n


def _bands(v: np.ndarray, start: np.ndarray, m: np.ndarray, salt: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, how many of each set): a key for each band of minimum hashes."""
    some = m > 0
    factor = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    keys = np.zeros((len(m), bands), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(bands * rows) if some.any() else ():
            keys[some, i // rows] = _mix(keys[some, i // rows] + np.minimum.reduceat(v * factor[i], start[some]))
        keys = _mix(keys + _mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :] + salt[:, None])
    return keys[some].ravel(), np.where(some, bands, 0)


def _parity(bit: np.ndarray, of: np.ndarray, n: int, words: int) -> np.ndarray:
    odd = (np.bincount(of * (words * 64) + bit.astype(np.int64), minlength=n * words * 64) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, words * 64), axis=1, bitorder="little").view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray, null: np.ndarray | None = None) -> pa.ListArray:
    at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=None if null is None else np.append(null, False))
    return pa.ListArray.from_arrays(at, pa.array(values.view(np.int64)))


def signed(sets: DataFrame, threshold: float, bands: int = 0, rows: int = 0) -> DataFrame:
    """``sets`` (its columns, of which ``set`` and the long ``salt`` go) with m (size), s, sketch and wide (sketches of 64
    bits, more, and many), and the keys ``own`` and ``up``: shares, or bands where their number is given."""
    kept = [c for c in sets.columns if c not in ("set", "salt")]

    def part(b: pa.RecordBatch) -> pa.RecordBatch:
        col = b.column(b.schema.get_field_index("set"))
        at = col.offsets.to_numpy().astype(np.int64)
        v = _mix(col.values.to_numpy()[at[0] : at[-1]].view(np.uint64))
        salt = _mix(b.column(b.schema.get_field_index("salt")).to_numpy().view(np.uint64))
        m, start, n = np.diff(at), at[:-1] - at[0], b.num_rows
        of = np.repeat(np.arange(n), m)
        sketch = _parity(v % np.uint64(WORDS * 64), of, n, WORDS)
        large = m >= WIDE_FROM
        place = np.cumsum(large) - 1
        wide = _parity((v[large[of]] >> np.uint64(20)) % np.uint64(WIDE * 64), place[of[large[of]]], int(large.sum()), WIDE)
        own, k = _bands(v, start, m, salt, bands, rows) if bands else _shares(v, of, m, salt, threshold, 0)
        up, j = (own[:0], np.zeros(n, np.int64)) if bands else _shares(v, of, m, salt, threshold, 1)
        made = [pa.array(m.astype(np.int32)), pa.array(np.bitwise_xor.reduce(sketch, axis=1)), _lists(sketch.ravel(), np.full(n, WORDS)), _lists(wide.ravel(), np.where(large, WIDE, 0), ~large), _lists(own, k), _lists(up, j)]
        return pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in kept] + made, kept + ["m", "s", "sketch", "wide", "own", "up"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b.column(b.schema.get_field_index("set")).offsets.to_numpy()
            lo = 0
            while lo < b.num_rows:
                hi = min(max(int(np.searchsorted(ends, int(ends[lo]) + AT_ONCE, "right")) - 1, lo + 1), b.num_rows, lo + 2000)
                yield part(b.slice(lo, hi - lo))
                lo = hi

    longs = ArrayType(LongType())
    made = [("m", IntegerType()), ("s", LongType()), ("sketch", longs), ("wide", longs), ("own", longs), ("up", longs)]
    return sets.mapInArrow(run, StructType([sets.schema[c] for c in kept] + [StructField(c, t) for c, t in made]))


def _differ(x: Column, y: Column) -> Column:
    """In how many bits two sketches differ."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, c: n + c)


def of_like_size(threshold: float, x: str = "x", y: str = "y") -> Column:
    return (F.col(f"{x}.m") >= threshold * F.col(f"{y}.m") - 1e-9) & (F.col(f"{y}.m") >= threshold * F.col(f"{x}.m") - 1e-9)


def _most(threshold: float, x: str, y: str) -> Column:
    t = bounded(threshold)
    return F.floor((1 - t) / (1 + t) * (F.col(f"{x}.m") + F.col(f"{y}.m")) + 1e-9)


def may_be_alike(threshold: float, x: str = "x", y: str = "y") -> Column:
    """Of like sizes, and no more bits of the shortest sketch differ than elements may."""
    return of_like_size(threshold, x, y) & (F.bit_count(F.col(f"{x}.s").bitwiseXOR(F.col(f"{y}.s"))) <= _most(threshold, x, y))


def sketches_alike(threshold: float, x: str = "x", y: str = "y") -> Column:
    """The same of the longer sketches, the wide ones where both sets have one."""
    most = _most(threshold, x, y)
    wide = F.when(F.col(f"{x}.wide").isNotNull() & F.col(f"{y}.wide").isNotNull(), _differ(F.col(f"{x}.wide"), F.col(f"{y}.wide")) <= most).otherwise(True)
    return F.when(_differ(F.col(f"{x}.sketch"), F.col(f"{y}.sketch")) <= most, wide).otherwise(False)


def words_alike(threshold: float, x: str = "x", y: str = "y") -> Column:
    """Of like sizes, and by the sketch alike, whose words are columns of their own (w0, w1, ...): for joins that look at
    many pairs."""
    differ = [F.bit_count(F.col(f"{x}.w{i}").bitwiseXOR(F.col(f"{y}.w{i}"))) for i in range(WORDS)]
    return of_like_size(threshold, x, y) & (reduce(operator.add, differ) <= _most(threshold, x, y))
