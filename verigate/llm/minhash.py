"""Operator 8: near-duplicates by one-permutation hashing.

One hash of each shingle picks a bin and a value; a bin keeps its smallest value. Empty bins borrow the value
of a bin that a fixed pseudo-random sequence finds first among the filled ones (optimal densification). Bands
of bins are bucket keys. Within a bucket the edges form a star around one centre, so a bucket of m sets gives
m - 1 pairs; the centre is the set whose buckets are largest, which for a group of edited copies is their
common source. Pairs are compared by one byte of each bin first, then confirmed on the full sets. While members that are
still apart would make very many pairs, and a round finds links, every bucket that still holds several components gets two more stars, around the member with the
most links so far and around one drawn by a hash, towards the members of other components. Bucket keys are one,
two or three neighbouring bands: the wider ones part dissimilar sets that share a narrow one. When the stars find no more,
all members of each bucket of a single band that are still in different components meet: in blocks of a bounded
number of rows, by how many of their rarest shingles they share (``occurrence``): only pairs that can reach the
threshold by that are confirmed. Components of the links are the groups.

Equal sets are one node, so exact copies never become pairs. Sets of up to ``SMALL`` shingles have too few
values for reliable bands: their bucket keys are the smallest hashes of the set, as many as the prefix filter
needs so that two sets above the threshold always share one.

Defined results: null and wordless texts have no shingles and are linked with nothing; fewer words than a
shingle are one shingle; repeated rows are equal sets; a null identifier counts as the smallest long; an empty
table gives no rows; extra columns are ignored by ``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verigate.llm.common import Rolling, discard, frugal, mix64, seeds64, staged, text_runs
from verigate.llm.components import components
from verigate.llm.occurrence import indexed, merged

WORDS, BINS, SMALL, RUN_BYTES, NO_ID = 5, 120, 64, 1 << 18, -(1 << 63)
ROWS_A_TASK, BLOCK_ROWS_A_TASK, PAIRS_A_TASK, BLOCK = 50_000, 5_000, 3_000, 1_024
#: While members that are still apart make more pairs than this, further stars thin them out before all of them meet.
MEET = 50_000_000
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_C = seeds64(16, 81) | np.uint64(1)


def shingles(data: np.ndarray, starts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text of a run, as (text, hash), sorted by both."""
    n = len(starts) - 1
    inside = ~_SEP[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[starts] = True
    before = np.concatenate(([False], inside[:-1])) & ~first[:-1] if len(data) else inside
    after = np.concatenate((inside[1:], [False])) & ~first[1:] if len(data) else inside
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if not len(begin):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    word = Rolling(_LOWER[data], 8).of(begin, end)
    text = np.searchsorted(starts, begin, side="right") - 1
    count = np.bincount(text, minlength=n)
    at = np.flatnonzero(text[words - 1 :] == text[: len(text) - words + 1]) if len(text) >= words else np.zeros(0, dtype=np.int64)
    full = np.zeros(len(at), dtype=np.uint64)
    for j in range(words):
        full += word[at + j] * _C[j]
    short = np.flatnonzero((count > 0) & (count < words))
    head = (np.cumsum(count) - count)[short]
    part = count[short].astype(np.uint64) * _C[15]
    for j in range(words - 1):
        more = count[short] > j
        part[more] += word[head[more] + j] * _C[j]
    doc, h = np.concatenate((text[at], short)), mix64(np.concatenate((full, part)))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


_PROBES = 512
_PROBE = (mix64(np.arange(BINS * _PROBES, dtype=np.uint64) + np.uint64(1 << 40)) % np.uint64(BINS)).astype(np.int64).reshape(_PROBES, BINS)


def signatures(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """One-permutation signatures, n x BINS, densified; rows of empty sets stay at the largest value."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * BINS, empty, dtype=np.uint64)
    bins = ((h >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)).astype(np.int64)
    np.minimum.at(sig, doc * BINS + bins, h & np.uint64((1 << 40) - 1))
    sig = sig.reshape(n, BINS)
    filled = sig != empty
    rows, cols = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for probe in _PROBE:
        if not len(rows):
            return sig
        hit = filled[rows, probe[cols]]
        sig[rows[hit], cols[hit]] = sig[rows[hit], probe[cols[hit]]]
        rows, cols = rows[~hit], cols[~hit]
    for r, c in zip(rows.tolist(), cols.tolist(), strict=True):  # hardly ever: the next filled bin to the right
        sig[r, c] = sig[r, (c + 1 + np.flatnonzero(np.roll(filled[r], -c - 1))[0]) % BINS]
    return sig


def _profile(data: np.ndarray, starts: np.ndarray, percent: int, band: int, words: int) -> list[list]:
    """Columns n, k1, k2, keys, sketch for the texts of a run."""
    n = len(starts) - 1
    doc, h = shingles(data, starts, words)
    size = np.bincount(doc, minlength=n)
    sig = signatures(doc, h, n)
    bands = np.zeros((n, BINS // band), dtype=np.uint64)
    for j in range(band):
        bands += sig[:, j::band][:, : BINS // band] * _C[j]
    bands = mix64(bands + np.arange(BINS // band, dtype=np.uint64) * _C[14]).view(np.int64)
    first = np.cumsum(size) - size
    sums = []
    for s in (1, 2):
        total = np.zeros(n, dtype=np.uint64)
        np.add.at(total, doc, mix64(h + _C[10 + s]))
        sums.append(total.view(np.int64))
    sketch = sig.astype(np.uint8)
    keys = []
    for i, m in enumerate(size.tolist()):
        own: list[int] = []
        if 0 < m <= SMALL * 100 // percent:
            own += mix64(h[first[i] : first[i] + m - -(-percent * m // 100) + 1] + _C[13]).view(np.int64).tolist()
        if m > SMALL:
            own += bands[i].tolist()
        keys.append(own)
    return [size.tolist(), sums[0].tolist(), sums[1].tolist(), keys, [x.tobytes() for x in sketch]]


def profiles(docs: DataFrame, percent: int, band: int, words: int) -> DataFrame:
    """For each row (doc_id, t, text): doc_id, t, n (set size), node (of its set; null where empty), keys (buckets), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "t", "n", "k1", "k2", "keys", "sketch"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        with np.errstate(over="ignore"):
            for b in batches:
                for lo, rows, data, starts in text_runs(b, "text", RUN_BYTES):
                    columns = _profile(data, starts, percent, band, words)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, rows), b.column(1).slice(lo, rows), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    out = docs.mapInArrow(frugal(run), "doc_id long, t long, n long, k1 long, k2 long, keys array<long>, sketch binary")
    return out.select("doc_id", "t", "n", F.when(F.col("n") > 0, F.xxhash64("k1", "k2", "n")).alias("node"), "keys", "sketch")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """node and its whole set (sorted 64-bit hashes) for each row with a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                for lo, rows, data, starts in text_runs(b, "text", RUN_BYTES):
                    doc, h = shingles(data, starts, words)
                    ends = np.cumsum(np.bincount(doc, minlength=rows)).tolist()
                    sets = [h[s:e].tobytes() for s, e in zip([0, *ends[:-1]], ends, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, rows), pa.array(sets, pa.binary())], ["node", "members"])

    return docs.mapInArrow(frugal(run), "node long, members binary")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Drops pairs whose sizes rule a link out, or whose sketches are more than six deviations below the threshold."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    both = pairs.join(a, "a").join(b, "b").where((100 * F.least("n_a", "n_b")) >= (percent * F.greatest("n_a", "n_b")))
    t = percent / 100
    least = BINS * (t - 6 * math.sqrt(t * (1 - t) / BINS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
                small = b.column(4).to_numpy(zero_copy_only=False) <= SMALL
                keep = small | ((x == y).sum(axis=1) >= least)
                yield b.select([0, 1]).filter(pa.array(keep))

    return both.select("a", "b", "s_a", "s_b", F.least("n_a", "n_b").alias("n")).mapInArrow(frugal(run), "a long, b long")


def _blocks(left: DataFrame, percent: int) -> DataFrame:
    """From rows (key, node, root, n) the blocks in which all pairs of a bucket meet: block, node, root, own, i, j, key.

    A bucket of up to BLOCK rows is one block. A larger one is split into classes of size of which only equal and
    neighbouring ones can hold a link, each two neighbours into cells, and each two cells are a block: rows of cell i
    meet those of cell j.
    """
    wide = math.log(100 / max(percent, 1) * 1.0001) if percent < 100 else 1e-4
    size = left.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    rows = left.join(size, "key")
    few = rows.where(F.col("size") <= BLOCK).select(F.xxhash64("key").alias("block"), "node", "root", F.lit(0).alias("own"), F.lit(0).alias("i"), F.lit(0).alias("j"), "key")
    rank = F.floor(F.log(F.col("n").cast("double")) / wide).cast("int")
    many = rows.where(F.col("size") > BLOCK).select("key", "node", "root", F.explode(F.array(rank, rank - 1)).alias("k"))
    cells = many.groupBy("key", "k").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cells"))
    many = many.join(cells, ["key", "k"]).withColumn("own", F.pmod(F.xxhash64("node", F.lit("cell")), F.col("cells")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    return few.union(many.select(F.xxhash64("key", "k", i, j).alias("block"), "node", "root", "own", i.alias("i"), j.alias("j"), "key"))


def _elements(sets: DataFrame) -> DataFrame:
    """node, n and h for each member of rows (node, n, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                held = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(2)]
                of = np.repeat(np.arange(b.num_rows), [len(x) for x in held])
                yield pa.RecordBatch.from_arrays([*(pa.array(b.column(k).to_numpy()[of]) for k in (0, 1)), pa.array(np.concatenate(held))], ["node", "n", "h"])

    return sets.select("node", "n", "members").mapInArrow(frugal(run), "node long, n long, h long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("node").alias("a"), F.col("members").alias("m_a"))
    b = sets.select(F.col("node").alias("b"), F.col("members").alias("m_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            if keep:
                yield t.select([0, 1]).filter(pa.array(keep))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "m_a", "m_b").mapInArrow(frugal(run), "a long, b long")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t, text: rows are told apart by identifier and text hash, for an identifier may be null or repeat."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.col(id_col).isNull(), text).alias("t"), text.alias("text"))


def _grouped(rows: DataFrame, percent: int, words: int) -> tuple[DataFrame, DataFrame]:
    """The profiles of all rows, and for each node: root (of its component) and label (its smallest identifier)."""
    spark = rows.sparkSession
    steps: list[DataFrame] = []

    def step(df: DataFrame, name: str) -> DataFrame:
        steps.append(staged(df, name))
        return steps[-1]

    band = 5 if percent >= 85 else 4
    every = staged(profiles(rows, percent, band, words), "profiles")
    held = every.where("node is not null")
    labels = held.groupBy("node").agg(F.min(F.struct("doc_id", "t")).alias("first"))
    labels = step(labels.select("node", F.col("first.doc_id").alias("label"), F.col("first.t").alias("label_t")), "labels")
    nodes = held.select("node", "n", "keys", "sketch").dropDuplicates(["node"])
    buckets = step(nodes.select("node", F.explode(F.array_distinct("keys")).alias("key")), "buckets")
    shared = step(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    members = step(buckets.join(shared, "key"), "members")
    busy = step(members.groupBy("node").agg(F.sum("size").alias("rank")), "busy")
    involved = step(held.join(busy, "node").select("node", "n", "sketch", "doc_id", "t").join(labels, "node").where("doc_id = label and t = label_t").dropDuplicates(["node"]).select("node", "n", "sketch", "label", "label_t"), "involved")
    texts = rows.join(involved.select(F.col("label").alias("doc_id"), F.col("label_t").alias("t"), "node").hint("shuffle_hash"), ["doc_id", "t"]).select("text", "node")
    sets = step(full_sets(texts, words), "sets").dropDuplicates(["node"])
    keyed = step(nodes.select("node", "keys").join(busy, "node"), "keyed")

    def bucketed(width: int) -> DataFrame:
        # a key is as many neighbouring keys of a set as the width says: wider ones part the dissimilar sets of a large bucket
        wide = F.transform("keys", lambda _, i: F.xxhash64(F.lit(width), *[F.get("keys", (i + j) % F.size("keys")) for j in range(width)]))
        return keyed.select("node", "rank", F.explode(F.array_distinct(wide)).alias("key"))

    links = spark.createDataFrame([], "a long, b long")
    joined = spark.createDataFrame([], "node long, root long")
    tested = links
    everyone = step(bucketed(1).select("key", F.lit(1).alias("width"), "node", "rank"), "everyone")

    def apart(everyone: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of single bands with their roots, and the bands that still hold several (with their number of pairs)."""
        left = everyone.where("width = 1").join(joined, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        mixed = left.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("c")).where("r1 < r2")
        return left, mixed.select("key", (F.col("c") * (F.col("c") - 1) / 2).alias("pairs"))

    turn, more = 0, True
    while more:
        # first one star in every bucket of a single band; then, while a round finds links, stars around the member
        # with the most links so far, and in buckets of several bands around one drawn by a hash that changes with
        # the round, both towards the members of other components
        ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
        degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        now = everyone
        now = now.join(joined, "node", "left").join(degree, "node", "left").select("key", "width", "node", "rank", F.coalesce("root", "node").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))
        mixed = now.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("key")
        # tables of a round get tasks by their rows, not by the session's number of partitions
        parts = 1 + everyone.count() // ROWS_A_TASK
        now = step(now.join(mixed, "key").coalesce(parts), "now")
        drawn = F.when(F.col("width") > 1, F.struct(F.xxhash64("key", "node", F.lit(turn)), "node", "root"))
        picks = now.groupBy("key").agg(F.max(F.struct("degree", "rank", "node", "root")).alias("x"), F.max(drawn).alias("y"))
        near = step(now.join(picks.select("key", "x.node", "x.root", "y.node", "y.root").toDF("key", "x", "x_root", "y", "y_root"), "key").coalesce(parts), "near")
        pairs = None
        for centre in "xy":
            own = near.where(F.col("root") != F.col(f"{centre}_root")).select(F.least("node", centre).alias("a"), F.greatest("node", centre).alias("b"))
            pairs = own if pairs is None else pairs.union(own)
        pairs = step(pairs.distinct().join(tested, ["a", "b"], "left_anti").coalesce(parts), "pairs")
        # a centre has met all of its bucket and leaves it
        rest = near.where((F.col("node") != F.col("x")) & (F.col("y").isNull() | (F.col("node") != F.col("y")))).select("key", "width", "node", "rank")
        everyone = rest
        few = 1 + pairs.count() // PAIRS_A_TASK
        found = step(_confirmed(step(_likely(pairs, involved, percent).coalesce(few), "likely"), sets, percent).coalesce(few), "links")
        more = not found.isEmpty() or not turn
        turn += 1
        tested = tested.union(pairs)
        if more:
            links = links.union(found)
            joined = step(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")
        if turn == 1:
            # the last step makes the result the same with and without further stars: they only save it work
            more = (apart(everyone, joined)[1].agg(F.sum("pairs").alias("n")).first()["n"] or 0) > MEET
            if more:
                wider = bucketed(2).withColumn("width", F.lit(2)).union(bucketed(3).withColumn("width", F.lit(3)))
                everyone = step(everyone.union(wider.select("key", "width", "node", "rank")), "everyone")
    # the stars end with the first round that finds no link; all members of a bucket that are still apart now meet
    left, mixed = apart(everyone, joined)
    left = step(left.join(mixed.select("key"), "key").join(involved.select("node", "n"), "node").coalesce(1 + everyone.count() // ROWS_A_TASK), "apart")
    blocks = step(_blocks(left, percent), "blocks")
    still = step(sets.join(left.select("node", "n").distinct(), "node"), "still")
    index = indexed(_elements(still), percent)
    steps.append(index)
    # a set's own buckets go along (a few for each band), for a pair counts in the first bucket that it shares alone
    own = left.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    whole = step(index.join(own, "node").select("node", "n", "least", "short", "keys"), "whole")
    met = blocks.join(whole, "node").select("block", "own", "i", "j", "node", "root", "n", "least", "short", "key", "keys")
    met = met.repartition(1 + blocks.count() // BLOCK_ROWS_A_TASK, "block").sortWithinPartitions("block")
    pairs = step(merged(met, percent).distinct(), "met")
    pairs = step(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    found = step(_confirmed(pairs.coalesce(1 + pairs.count() // PAIRS_A_TASK), sets, percent), "links")
    if not found.isEmpty():
        links = links.union(found)
        joined = step(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")
    out = staged(labels.join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "label"), "groups")
    discard(*steps)
    return every, out


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest identifier of its group), kept.

    Two sets are linked where 100 * intersection >= percent * union.
    """
    every, groups = _grouped(_rows(docs, id_col, text_col), percent, words)
    least = groups.groupBy("root").agg(F.min("label").alias("component"))
    of = staged(groups.join(least, "root").select("node", "component"), "components")
    out = every.select("doc_id", "n", "node").join(of, "node", "left").select(F.col("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    real = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    return out.select(real.alias("doc_id"), "n_shingles", F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 80, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which one of each group stays (that with the smallest identifier), all columns as they were.

    Rows without words all stay. Of rows with equal identifiers and texts, which are one group, an arbitrary one stays.
    """
    rows = _rows(docs, id_col, text_col)
    every, groups = _grouped(rows, percent, words)
    alone = F.col("node").isNull()
    own = every.select("doc_id", "t", "node").groupBy("doc_id", "t").agg(F.first("node").alias("node"), F.count(F.lit(1)).alias("copies"))
    first = own.join(groups.select("node", "root"), "node").groupBy("root").agg(F.min(F.struct("doc_id", "t", "copies")).alias("first")).select("first.*")
    stay = staged(first.union(own.where(alone).select("doc_id", "t", F.lit(0).cast("long"))), "stay").select(F.col("doc_id").alias("_vg_id"), F.col("t").alias("_vg_t"), F.col("copies").alias("_vg_copies"))
    text = F.coalesce(docs[text_col], F.lit(""))
    same = (F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)) == stay["_vg_id"]) & (F.xxhash64(docs[id_col].isNull(), text) == stay["_vg_t"])
    both = docs.join(stay.hint("shuffle_hash"), same)
    repeated = both.where("_vg_copies > 1").dropDuplicates(["_vg_id", "_vg_t"])
    return both.where("_vg_copies <= 1").unionByName(repeated).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: groups of near-duplicate documents at 85 %."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
e AS (SELECT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(sh) AS x FROM s)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, d.b FROM r JOIN d ON r.reached = d.a)
SELECT r.doc_id, any_value(n.n) AS n_shingles, min(reached) AS component_id, r.doc_id = min(reached) AS kept
FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
