"""Operator 4: suffix-array dedup by depth-limited radix passes.

A suffix is ordered only through its first ``THRESHOLD`` bytes, so equal groups are exactly the repeated windows
of that length. Each pass sorts rows by their next digit, most significant first, finds equal neighbours while the
sorted ranges stream by, and drops what has none.

The digits are read in an order that the window's own bytes fix, so that neighbouring suffixes share a row until late.
The first digit is the window's anchor, the 32-byte string in it with the smallest hash. Equal windows have equal
anchors at equal places. Suffixes in a row with the same anchor form a run, about one for each 85 bytes of text. Later
passes cut runs into blocks of 42, 7 and 1 places; a block's digit (its core) is what all windows at its places share:
159, 194 and at last all 200 bytes. A row's hull is all that its windows cover.

* A core that stands alone rules out all windows of its row.
* Equal hulls at equal places make all windows of their rows repeated.
* What shares a core but not its hull goes on to the next pass, with one row of each repeated hull around that core.

Rows are dealt by ranges of (core, hull, row), so a digit that a third of all rows hold spreads over many tasks; each
range tells its neighbours its first and last digit (two rows for each range), and nothing is gathered or joined back.
Digits are compared by their 64-bit hashes, core and hull together by 128 bits.

Defined results: a null text is empty; texts shorter than the threshold keep everything; repeated rows are
copies of each other; matches never cross texts; a very long text is read in overlapping parts; an empty table gives no
rows; a null identifier is kept as such; extra columns are ignored by ``removals`` and kept by ``deduplicate``,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verigate.llm.common import Rolling, discard, frugal, mix64, n_partitions, seeds64, staged, text_runs

THRESHOLD, GRAM, RUN_BYTES, PART_BYTES, NO_ID = 200, 32, 1 << 18, 1 << 20, -(1 << 63)
PLACES = THRESHOLD - GRAM + 1
#: Places in a block, pass by pass; each number divides the one before it.
BLOCKS = (42, 7, 1)
#: Bytes of rows in a range.
RANGE_BYTES = 16 << 20
_C = seeds64(4, 404) | np.uint64(1)


def _pack(start: np.ndarray, n: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 18 | n.astype(np.int64) << 9 | hi.astype(np.int64)


def _start(c: str = "at") -> Column:
    return F.shiftright(F.col(c), 18)


def anchored_runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """text, start, n (windows), hi (place of the anchor in the first window), core hash, hull hash of each run."""
    size = len(data)
    lengths = np.diff(starts)
    if size < THRESHOLD or not (lengths >= THRESHOLD).any():
        return (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=np.uint64),) * 2
    roll = Rolling(data, 4)
    at = np.arange(size - GRAM + 1)
    gram = roll.of(at, at + GRAM)
    bits = np.uint64(max(24, size.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (gram & ~low) | at.astype(np.uint64)
    span = 1
    while span * 2 <= PLACES:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = PLACES - span
    least = np.minimum(least[: len(least) - rest], least[rest:])
    inside = np.zeros(size + 1, dtype=np.int8)
    long = lengths >= THRESHOLD
    inside[starts[:-1][long]] += 1
    inside[starts[1:][long] - THRESHOLD + 1] -= 1
    window = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    anchor = (least[window] & low).astype(np.int64)
    new = np.ones(len(window), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(window)))
    first, anchor = window[head], anchor[head]
    hi = anchor - first
    hull = mix64(roll.of(first, first + n - 1 + THRESHOLD) + (hi << 9 | n).astype(np.uint64) * _C[0])
    text = np.searchsorted(starts, first, side="right") - 1
    return text, first - starts[text], n, hi, gram[anchor], hull


def block_rows(data: np.ndarray, shift: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Splits rows (packed) into blocks of ``width`` places: owner, packed place, core hash, hull hash.

    ``data`` holds the rows' hulls; a byte of row i's text stands in it ``shift[i]`` further on.
    """
    start, n, hi = at >> 18, at >> 9 & 511, at & 511
    lo = hi - n + 1
    pieces = hi // width - lo // width + 1
    owner = np.repeat(np.arange(len(at)), pieces)
    b = (lo // width)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    anchor = (start + hi)[owner]
    top, bottom = np.minimum(hi[owner], b * width + width - 1), np.maximum(lo[owner], b * width)
    first, k = anchor - top, top - bottom + 1
    move = shift[owner]
    begin = anchor - b * width + move
    core = mix64(Rolling(data, 5).of(begin, begin - width + 1 + THRESHOLD) + b.astype(np.uint64) * _C[1])
    hull = mix64(Rolling(data, 6).of(first + move, first + move + k - 1 + THRESHOLD) + (top << 9 | k).astype(np.uint64) * _C[2])
    return owner, _pack(first, k, top), core, hull


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    holder, text = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(holder.alias("holder"), F.xxhash64(F.col(id_col).isNull(), holder, text).alias("row"), text.alias("text"))


_ROW = "holder long, row long, run long, at long, core long, hull long"


def _runs(rows: DataFrame) -> DataFrame:
    """The runs of all texts; a long text goes in parts that overlap by a window less one byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                for lo, _, whole, ends in text_runs(b, "text", RUN_BYTES):
                    for begin in range(0, max(1, len(whole) - THRESHOLD + 1), PART_BYTES) if len(ends) == 2 else [0]:
                        cut = len(ends) == 2
                        data = whole[begin : begin + PART_BYTES + THRESHOLD - 1] if cut else whole
                        text, start, n, hi, core, hull = anchored_runs(data, np.array([0, len(data)]) if cut else ends)
                        take, at = pa.array(text + lo), pa.array(_pack(start + begin, n, hi))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), at, at, pa.array(core.view(np.int64)), pa.array(hull.view(np.int64))], ["holder", "row", "run", "at", "core", "hull"])

    return rows.mapInArrow(frugal(run), _ROW)


def _squeezed(rows: DataFrame) -> DataFrame:
    """The texts compressed, for the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = b.column(2).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([squeeze.compress(t.as_buffer()) for t in texts], pa.binary())], ["holder", "row", "zip"])

    return rows.mapInArrow(frugal(run), "holder long, row long, zip binary")


def _hulls(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """The bytes that the runs' windows cover, from the texts."""
    wanted = runs.groupBy("holder", "row").agg(F.collect_set("run").alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(b.num_rows):
                data = unzip.decompress(b.column(2)[i].as_buffer())
                at = np.sort(b.column(3)[i].values.to_numpy())
                begin, beyond = (at >> 18).tolist(), ((at >> 18) + (at >> 9 & 511) - 1 + THRESHOLD).tolist()
                m = len(at)
                hulls = pa.array([data[s:e] for s, e in zip(begin, beyond, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * m, pa.int64()), pa.array([b.column(1)[i].as_py()] * m, pa.int64()), pa.array(at), hulls], ["holder", "row", "run", "bytes"])

    both = _squeezed(rows).join(wanted.hint("shuffle_hash"), ["holder", "row"]).select("holder", "row", "zip", "runs")
    return both.mapInArrow(frugal(run), "holder long, row long, run long, bytes binary")


def _blocks(hulls: DataFrame, left: DataFrame, width: int) -> DataFrame:
    """The rows that are left, cut into blocks of ``width`` places, with their digits."""
    wanted = left.groupBy("holder", "row", "run").agg(F.collect_set("at").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                if not b.num_rows:
                    continue
                holder, row, runs = (b.column(c).to_numpy() for c in range(3))
                data = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8)
                size = np.array([len(x) for x in b.column(4)])
                of = np.repeat(np.arange(b.num_rows), size)
                length = (runs >> 9 & 511) - 1 + THRESHOLD
                shift = np.cumsum(length) - length - (runs >> 18)
                owner, at, core, hull = block_rows(data, shift[of], b.column(4).flatten().to_numpy(), width)
                of = of[owner]
                columns = [holder[of], row[of], runs[of], at, core.view(np.int64), hull.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["holder", "row", "run", "at", "core", "hull"])

    both = hulls.join(wanted.hint("shuffle_hash"), ["holder", "row", "run"]).select("holder", "row", "run", "bytes", "at")
    return both.mapInArrow(frugal(run), _ROW)


#: What a range knows of a row: shared core, repeated hull, first of its hull, hulls of its core that aren't repeated
#: (or may not be); first and last core, first and last hull of the range.
_SHARED, _TWICE, _ONE, _MIXED, _FIRST, _LAST, _FIRST_HULL, _LAST_HULL = (1 << i for i in range(8))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range: the rows with equal neighbours or at its edges, with flags, and its first and last digits."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    core, hull = table.column("core").to_numpy(), table.column("hull").to_numpy()
    n = len(core)
    new = np.ones(n, dtype=bool)
    new[1:] = core[1:] != core[:-1]
    other = new.copy()
    other[1:] |= hull[1:] != hull[:-1]
    ends, other_ends = np.append(new[1:], True), np.append(other[1:], True)
    shared, twice = ~(new & ends), ~(other & other_ends)
    group, part = np.cumsum(new) - 1, np.cumsum(other) - 1
    first, last, first_hull, last_hull = group == 0, group == group[-1], part == 0, part == part[-1]
    mixed = (np.bincount(group, weights=~twice) > 0)[group] | first | last
    flags = sum(f.astype(np.int32) * bit for f, bit in ((shared, _SHARED), (twice, _TWICE), (other & twice, _ONE), (mixed, _MIXED), (first, _FIRST), (last, _LAST), (first_hull, _FIRST_HULL), (last_hull, _LAST_HULL)))
    keep = np.flatnonzero(shared | first | last)
    take = np.concatenate((keep, [0, n - 1]))
    out = table.take(pa.array(take)).combine_chunks()
    where = pa.array(np.full(len(take), TaskContext.get().partitionId(), dtype=np.int32))
    out = out.append_column("part", where).append_column("flags", pa.array(np.append(flags[keep], [-1, -2]).astype(np.int32)))
    yield from out.to_batches(max_chunksize=1 << 16)


def _sorted_pass(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One radix pass: the rows whose hull is repeated, the rows that go on, and the staged table of both."""
    order = ["core", "hull", "holder", "row", "at"]
    dealt = rows.repartitionByRange(n_partitions(rows, RANGE_BYTES), *order).sortWithinPartitions(*order)
    table = staged(dealt.mapInArrow(frugal(_streamed), _ROW + ", part int, flags int"), name)
    edges: dict[int, dict[int, tuple[int, int]]] = {}
    for r in table.where("flags < 0").collect():  # two rows for each range
        edges.setdefault(r["part"], {})[r["flags"]] = (r["core"], r["hull"])
    parts = sorted(edges)
    around = [(p, *(edges[parts[i - 1]][-2] if i else (None, None)), *(edges[parts[i + 1]][-1] if i + 1 < len(parts) else (None, None))) for i, p in enumerate(parts)]
    near = rows.sparkSession.createDataFrame(around, "part int, core_before long, hull_before long, core_after long, hull_after long")
    has = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    same = lambda side: F.coalesce(F.col("core") == F.col(f"core_{side}"), F.lit(False))
    equal = lambda side: same(side) & (F.col("hull") == F.col(f"hull_{side}"))
    settled = table.where("flags >= 0").join(F.broadcast(near), "part")  # one row for each range
    settled = settled.withColumns({
        "shared": has(_SHARED) | (has(_FIRST) & same("before")) | (has(_LAST) & same("after")),
        "twice": has(_TWICE) | (has(_FIRST_HULL) & equal("before")) | (has(_LAST_HULL) & equal("after")),
    })
    columns = ["holder", "row", "run", "at"]
    goes_on = (F.col("shared") & ~F.col("twice")) | (F.col("twice") & has(_MIXED) & (has(_ONE) | ~has(_TWICE)))
    return settled.where("twice").select(*columns), settled.where(goes_on).select(*columns), table


def repeated(rows: DataFrame) -> DataFrame:
    """The repeated windows as (holder, row, start, n): n windows from byte start on. The table is staged."""
    whole, left, table = _sorted_pass(_runs(rows), "runs")
    found, done = [whole], [table]
    hulls = staged(_hulls(rows, left), "hulls")
    for i, width in enumerate(BLOCKS):
        if i:  # the bytes of runs that are settled aren't needed any more
            fewer = staged(hulls.join(left.select("holder", "row", "run").distinct(), ["holder", "row", "run"], "left_semi"), "hulls")
            discard(hulls)
            hulls = fewer
        whole, left, table = _sorted_pass(_blocks(hulls, left, width), "blocks")
        found.append(whole)
        done.append(table)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = staged(out.select("holder", "row", _start().alias("start"), F.shiftright("at", 9).bitwiseAND(511).alias("n")), "repeated")
    discard(hulls, *done)
    return out


def _spans(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed byte runs [begin, end) from repeated windows."""
    order = np.argsort(start, kind="stable")
    begin, end = start[order], np.maximum.accumulate((start + n - 1 + THRESHOLD)[order])
    new = np.append(True, begin[1:] > end[:-1])
    last = np.append(new[1:], True)
    return begin[new], end[last]


def _cuts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (holder, row, text) and, for each that loses bytes, its repeated windows."""
    rows = _rows(docs, id_col, text_col)
    found = repeated(rows)
    cuts = staged(found.groupBy("holder", "row").agg(F.collect_set(F.struct("start", "n")).alias("cuts")), "cuts")
    discard(found)
    return rows, cuts.select("holder", "row", F.col("cuts.start").alias("start"), F.col("cuts.n").alias("n"))


def _kept(data: bytes, start: pa.ListScalar, n: pa.ListScalar) -> tuple[bytes, int]:
    """What is left of a text, and how many runs of bytes go."""
    begin, end = _spans(start.values.to_numpy().astype(np.int64), n.values.to_numpy().astype(np.int64))
    return b"".join(data[e:s] for e, s in zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True)), len(begin)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes)."""
    rows, cuts = _cuts(docs, id_col, text_col)
    both = _squeezed(rows).join(cuts.hint("shuffle_hash"), ["holder", "row"], "left").select("holder", "zip", "start", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        names = ["holder", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            out = []
            for holder, zipped, start, n in zip(*b.columns, strict=True):
                data = unzip.decompress(zipped.as_buffer())
                kept, spans = _kept(data, start, n) if start.is_valid else (data, 0)
                out.append((holder.as_py(), len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    out = both.mapInArrow(frugal(run), "holder long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(F.col("holder") != NO_ID, F.col("holder")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their repeated bytes; other columns as they were. No row goes.

    Where a cut leaves part of a character, that part goes too. A null text stays null.
    """
    _, cuts = _cuts(docs, id_col, text_col)
    cuts = cuts.select(F.col("holder").alias("_vg_holder"), F.col("row").alias("_vg_row"), F.col("start").alias("_vg_start"), F.col("n").alias("_vg_n"))
    holder, text = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)), F.coalesce(docs[text_col], F.lit(""))
    row = F.xxhash64(docs[id_col].isNull(), holder, text)
    both = docs.join(cuts.hint("shuffle_hash"), (holder == cuts["_vg_holder"]) & (row == cuts["_vg_row"]), "left")
    both = both.select(*[docs[c] for c in docs.columns], "_vg_start", "_vg_n")
    names, place, width = list(docs.columns), docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(place)
            texts = []
            for text, start, n in zip(column, b.column(width), b.column(width + 1), strict=True):
                texts.append(_kept(text.as_py().encode(), start, n)[0].decode("utf-8", errors="ignore") if start.is_valid else text.as_py())
            columns = [pa.array(texts, column.type) if i == place else b.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return both.mapInArrow(frugal(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: per document, what repeated 200-byte strings take from it."""
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
