"""Operator 10: best-fit packing of token sequences.

Lengths are packed, not documents: a histogram with one bin for each length (at most the sequence length)
says everything. The configuration linear program over it

    minimise sum_j x_j   subject to   sum_j a_jl x_j >= n_l   for every length l

has a variable for each way to fill one sequence. Multiplicative weights solve it. Every length has a price; a
knapsack by dynamic programming finds, for each length at once, the best configuration with it under these prices.
A schedule says which share of every length should be covered by when. In each round the lengths behind it take what
they lack from their own best configurations, as far as no other length of these gets further ahead than ``AHEAD``;
prices fall by a factor where a length is ahead and rise where it is behind. After the schedule's end covered lengths
have no price, and rounds go on until everything is covered. Any prices, divided by the worth of the best
configuration, are feasible for the dual program, so the best of them bounds the number of sequences from below;
``Plan`` holds both sides.

Rounding goes along the configurations that fill a sequence, in the order of their longest lengths, and takes as many of
each as the running total gains whole ones, where all its pieces are still there; some at the end, which hold the
shortest pieces, are kept back. The program is solved again for what a pass leaves, while that is more than ``REST``
pieces and passes place a tenth of it; best fit by decreasing
length packs the rest. All of that costs the same at any input size; only the histogram and the final assignment see
the rows.

Defined results: a null text is empty (its document is the end id alone); a document longer than a sequence is
cut into full pieces after a first piece that may be shorter; repeated identifiers are separate documents,
ordered by their ids' checksum; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verigate.llm.common import frugal, number_rows, staged, trim
from verigate.llm.tokens import encoder

LENGTH = 1024
#: Rounds of the schedule, the share of its need that a length may be ahead of it, the exponent of the prices.
ROUNDS, AHEAD, STEP, TILT = 64, 0.05, 1.0, 0.3
#: As many pieces may be left to best fit; sequences that rounding keeps back for it at first; the parts of the
#: program's sequences that it keeps back at most at first, and then.
REST, BACK, BACK_PARTS = 1024, 128, (0.04, 0.08, 0.12, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5)


class Plan(NamedTuple):
    """Configurations (counts by length) and how often each is used; pieces by where their places come from."""

    configurations: list[tuple[np.ndarray, int]]
    full: int
    by_program: int
    by_best_fit: int
    use: float  # the program's value for the lengths below a full sequence
    bound: float  # from the dual: no packing of these needs less


def knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every room c up to the capacity: the largest total price that fits, and how many of each length give it.

    Dynamic programming over the rooms; where ``most`` binds, a length is taken only while the configuration it joins
    has fewer of it.
    """
    best, counts = np.zeros(capacity + 1), np.zeros((capacity + 1, len(lengths)), dtype=np.int16)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    scarce = np.flatnonzero(most < capacity // lengths)
    limit = most[scarce]
    upto_scarce = np.searchsorted(scarce, upto)
    for c in range(int(lengths[0]), capacity + 1):
        k, m = upto[c], upto_scarce[c]
        before = c - lengths[:k]
        gain = price[:k] + best[before]
        if m:
            own = scarce[:m]
            gain[own[counts[before[own], own] >= limit[:m]]] = -1.0
        i = int(gain.argmax())
        if gain[i] > best[c - 1]:
            best[c], counts[c] = gain[i], counts[before[i]]
            counts[c, i] += 1
        else:
            best[c], counts[c] = best[c - 1], counts[c - 1]
    return best, counts


def solve(histogram: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Multiplicative weights for the configuration program: configurations (rows, by length), how often to use each
    (fractional; together they cover the histogram), and the dual's lower bound."""
    lengths = np.flatnonzero(histogram)
    if not len(lengths):
        return np.zeros((0, capacity + 1), dtype=np.int16), np.zeros(0), 0.0
    whole, need = histogram[lengths], histogram[lengths].astype(float)
    covered = np.zeros(len(lengths))
    # prices that are feasible as they are: the room taken, and 1 for all from a length on that leaves less than k
    bound = max(float(need @ np.where(lengths > capacity - k, 1.0, np.where(lengths < k, 0.0, lengths / capacity))) for k in range(capacity // 2 + 1))
    found: dict[bytes, int] = {}
    rows: list[np.ndarray] = []
    used: list[float] = []
    t, gained, open_ = 0, 0.0, np.ones(len(lengths), dtype=bool)
    while open_.any():
        price = lengths / capacity * np.exp(STEP * (min(1.0, t / rounds) - covered / need))
        if t % 8 == 0 and t <= rounds:
            best, _ = knapsack(price, lengths, capacity, np.full(len(lengths), capacity))
            bound = max(bound, float(need @ price) / float(best[capacity]))
        price *= (lengths / capacity) ** TILT  # long pieces first: short ones fill what is left at the end
        if t >= rounds:
            price[~open_] = 0.0
        best, counts = knapsack(price, lengths, capacity, whole)
        goal, most = need * min(1.0, (t + 1) / rounds), need * min(1.0, (t + 1) / rounds + AHEAD)
        # hardly ever: rounds that gain too little, and what is still open is covered whatever else that covers
        late = t >= rounds and gained < 1e-3 * float((need - covered).clip(0) @ lengths)
        before = float(covered @ lengths)
        for i in np.flatnonzero(goal - covered > 1e-9 * need)[::-1].tolist():
            lack = goal[i] - covered[i]
            if lack <= 1e-9 * need[i]:
                continue
            a = counts[capacity - lengths[i]]
            if a[i] < whole[i]:
                a = a.copy()
                a[i] += 1
            held = np.flatnonzero(a)
            amount = lack / a[i]
            if not late:
                amount = min(amount, float(((most[held] - covered[held]) / a[held]).min()))
            if amount <= 1e-12 * need[i]:
                continue
            j = found.setdefault(a.tobytes(), len(rows))
            if j == len(rows):
                rows.append(a.astype(np.int16))
                used.append(0.0)
            used[j] += amount
            covered[held] += a[held] * amount
        t, gained = t + 1, float(covered @ lengths) - before
        open_ = covered < need * (1 - 1e-6)
    wide = np.zeros((len(rows), capacity + 1), dtype=np.int16)
    wide[:, lengths] = rows
    return wide, np.array(used), bound


def best_fit(histogram: np.ndarray, capacity: int = LENGTH) -> list[tuple[np.ndarray, int]]:
    """Best fit by decreasing length, for all items of a length at once: configurations and how many of each.

    Items of one length go to the open sequences with the least room for one, each of which takes as many as it has
    room for before the next one. A length opens three kinds of sequences at most, so this is bounded by the lengths.
    """
    rooms: dict[int, list[tuple[np.ndarray, int]]] = {}
    for length in range(capacity, 0, -1):
        left = int(histogram[length])
        for room in sorted(r for r in rooms if r >= length) if left else []:
            fits, groups = room // length, rooms.pop(room)
            for a, n in groups:
                whole = min(n, left // fits)
                some = left - whole * fits if whole < n else 0
                for k, times in ((fits, whole), (some, int(some > 0)), (0, n - whole - int(some > 0))):
                    if times:
                        more = a.copy()
                        more[length] += k
                        rooms.setdefault(room - k * length, []).append((more, times))
                left -= whole * fits + some
        fits = capacity // length
        for k, times in ((fits, left // fits), (left % fits, int(left % fits > 0))):
            if times:
                a = np.zeros(capacity + 1, dtype=np.int64)
                a[length] = k
                rooms.setdefault(capacity - k * length, []).append((a, times))
    return [group for groups in rooms.values() for group in groups]


def _rounded(left: np.ndarray, rows: np.ndarray, x: np.ndarray, back: float) -> list[tuple[np.ndarray, int]]:
    """Whole configurations from fractional ones, the last ``back`` of them not used; takes their items from ``left``."""
    out = []
    longest = left.shape[0] - 1 - np.argmax(rows[:, ::-1] > 0, axis=1)
    order = np.lexsort((-x, -longest))
    order = order[np.cumsum(x[order][::-1])[::-1] > back]
    times = np.diff(np.floor(np.append(0.0, np.cumsum(x[order])) + 0.5)).astype(np.int64)
    for j, n in zip(order.tolist(), times.tolist(), strict=True):
        held = np.flatnonzero(rows[j])
        n = min(n, int((left[held] // rows[j, held]).min())) if n else 0
        if n:
            a = rows[j].astype(np.int64)
            out.append((a, n))
            left[held] -= a[held] * n
    return out


def plan(histogram: np.ndarray, capacity: int = LENGTH, rounds: int = ROUNDS) -> Plan:
    """Whole configurations that hold every item of the histogram exactly once.

    The program's solution is rounded with ever more of its last configurations kept back, until no more sequences are
    needed than best fit alone needs, or the bound is met; the rounding with the fewest sequences counts.
    """
    needs = histogram.astype(np.int64).copy()
    needs[0] = 0
    full, out = int(needs[capacity]), []
    if full:  # a full sequence is a configuration of its own
        only = np.zeros(capacity + 1, dtype=np.int64)
        only[capacity] = 1
        out.append((only, full))
        needs[capacity] = 0
    if not needs.any():
        return Plan(out, full, 0, 0, 0.0, 0.0)
    rows, x, bound = solve(needs, capacity, rounds)
    goal = max(int(np.ceil(bound - 1e-6)), 0)
    plain = sum(n for _, n in best_fit(needs, capacity))
    best: tuple[int, list, int] | None = None
    for part in BACK_PARTS:
        left = needs.copy()
        made = _rounded(left, rows, x, min(BACK, part * x.sum()) if part == BACK_PARTS[0] else part * x.sum())
        while int(left.sum()) > REST:
            had = int(left.sum())
            again, y, _ = solve(left, capacity, rounds // 4)
            made += _rounded(left, again, y, min(BACK, BACK_PARTS[0] * y.sum()))
            if had - int(left.sum()) < had / 10:
                break
        rest = int(left.sum())
        made += best_fit(left, capacity)
        n = sum(k for _, k in made)
        if best is None or n < best[0]:
            best = (n, made, rest)
        if best[0] <= max(goal, plain):
            break
    return Plan(out + best[1], full, int(needs.sum()) - best[2], best[2], float(x.sum()), bound)


def pieces(docs: DataFrame, tokenizer: str, pattern: str | None, end_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises and cuts: doc_id, copy (tells repeated identifiers apart), piece, start, length, ids_crc32."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tail = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, pattern)
        for b, part in enc.encode_batches(batches, "text"):
            out = []
            for doc_id, data in zip(b.column(0).to_pylist(), part, strict=True):
                data += tail
                n, copy = len(data) // 4, zlib.crc32(data)
                cuts = [0, *range(n % length or length, n + 1, length)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    out.append((doc_id, copy, k, s, e - s, zlib.crc32(data[4 * s : 4 * e])))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "copy", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(frugal(cut), "doc_id long, copy long, piece int, start long, length long, ids_crc32 long")


def assign(rows: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to ``rows`` (with a column length of 1..capacity and doc_id, copy, piece).

    Items of one length are interchangeable: the n-th item of a length takes the n-th place that the plan has
    for it. The places are ranges (one row for each configuration and length in it), found by a range join that
    is an equality on the length. Full pieces need no such search.
    """
    spark = rows.sparkSession
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in rows.groupBy("length").count().collect():  # at most one row for each length
        counts[r["length"]] = r["count"]
    sequence, at, places = 0, np.zeros(capacity + 1, dtype=np.int64), []
    made = plan(counts, capacity).configurations
    trim()  # what the solution took on the driver
    for a, n in made:
        offset = 0
        for length in np.flatnonzero(a)[::-1].tolist():
            k = int(a[length])
            places.append((length, int(at[length]), int(at[length]) + k * n, k, sequence, offset))
            at[length] += k * n
            offset += k * length
        sequence += n
    if not (at == counts).all():
        raise AssertionError("the plan doesn't hold every item once")
    table = spark.createDataFrame(places, "length long, first long, beyond long, each int, sequence long, base long")
    numbered = number_rows(rows, ["length"], ["doc_id", "copy", "piece"], "item")
    # at most (configurations x lengths in each) rows: a bound that doesn't depend on the input
    found = numbered.join(F.broadcast(table), (numbered["length"] == table["length"]) & (F.col("item") >= F.col("first")) & (F.col("item") < F.col("beyond")))
    nth = F.col("item") - F.col("first")
    return found.select(
        *[numbered[c] for c in rows.columns],
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + (nth % F.col("each")) * numbered["length"]).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, pattern: str | None, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Documents to packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = staged(pieces(docs, tokenizer, pattern, end_id, length), "pieces")
    return assign(rows, length).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents packed into sequences of 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
