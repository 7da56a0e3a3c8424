"""What the operators share: the shared folder, staged tables, row numbering, byte buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local session, whose driver is its one executor, may do without it: a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="verigate-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again.

    This cuts the lineage; the rows outlive any executor.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_vg_path"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``staged`` gave and nothing reads any more, where all that came from them is staged itself.

    A collection on the driver lets Spark's cleaner delete the shuffle files of the steps that are over, too; without
    tables it does this alone.
    """
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.__dict__["_vg_path"])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark._jvm.System.gc()


def trim() -> None:
    """Gives free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if give_back:
        give_back(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: gives free memory back to the system after a task, for Python workers outlive their tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return task


def n_partitions(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Partitions for an exchange of ``df``: the session's number, or more where the input's size asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    asked = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(asked, min(1_000_000, -(-size // bytes_each) if size < 1 << 60 else asked))


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each group, in the given order, without one task per group.

    Rows are dealt by ranges of (group, order), so a group that holds most rows spreads over many tasks; each
    range counts its rows for each group, and the running totals of these counts (one row for each range and
    group) shift the numbers of the rows in it.
    """
    n = n_partitions(df)
    dealt = df.repartitionByRange(n, *group, *order).withColumn("_range", F.spark_partition_id())
    dealt = staged(dealt, "numbered")
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_n"))
    totals = totals.select("_range", *[F.col(g).alias(f"_of_{g}") for g in group], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("_range", *group).orderBy(*order)
    rows = dealt.withColumn("_at", F.row_number().over(within) - 1)
    same = rows["_range"] == totals["_range"]
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    joined = rows.join(totals, same)
    return joined.select(*[rows[c] for c in df.columns], (F.col("_at") + F.col("_shift")).cast("long").alias(name))


def text_runs(batch: pa.RecordBatch, column: str, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows of about ``most`` bytes of text.

    Yields (first row, rows, bytes, starts): the bytes of the texts in one uint8 array and the start of each
    text in it, with the end of the last. Null texts are empty.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(col.type) and not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_large_binary(col.type) else "")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * col.offset)
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


class Rolling:
    """Hashes of any byte ranges of one buffer, from one pass over it.

    With B odd, prefix[i] = sum of value[b_j] * B^j for j < i modulo 2^64; a range's hash is the difference of
    two prefixes divided by B^start, so equal bytes hash alike wherever they stand.
    """

    def __init__(self, data: np.ndarray, seed: int):
        base = int(seeds64(1, seed)[0]) | 1
        values = seeds64(256, seed + 1)
        n = len(data)
        self.inverse = _powers(pow(base, -1, 1 << 64), n + 1, seed)
        powers = _powers(base, n + 1, seed + 7)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values[data] * powers[:n], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.inverse[start])


_power_cache: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int, key: int) -> np.ndarray:
    have = _power_cache.get((base, key))
    if have is None or len(have) < n:
        m = max(n, 1 << 16)
        have = np.full(m, base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _power_cache.clear() if len(_power_cache) > 8 else None
        _power_cache[(base, key)] = have
    return have[:n]

