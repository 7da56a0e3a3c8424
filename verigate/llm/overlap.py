"""Operator 11: n-gram Jaccard join as a T-occurrence search with DivideSkip.

Two sets are linked where 100 * intersection >= percent * union, so a set of n shingles shares at least T = percent % of
them with any partner. All bounds below are exact; nothing is missed by chance. Equal sets are one node.

1. Elimination. In the order of their hashes, the first n - T + k shingles of a set hold at least k that a partner has
   among its own first ones, k being an eighth of the smaller set. Sets with fewer shared keys than that have no partner.
2. Lists. For what is left, inverted lists are counted and a set's shingles are ordered by the length of their list.
   Lists of one set alone are of no use; a set with fewer than T others has no partner.
3. DivideSkip. Of the lists of a set the L longest are long, L = T / (MU * log2(longest) + 1); a partner is in at least
   T - L of the short ones. The first n - T + 1 lists are the buckets in which partners meet, for each pair shares one of
   them; buckets of the same members are one.
4. Stars. In a bucket with several components all are tested against one centre, so copies of one source become one
   component by one test each, not by all pairs. Rounds go on while they find links and much is left to meet.
5. Merge. Members of a bucket that are still apart meet in blocks: the short lists of each are merged by a heap that
   skips, with binary search, what can't reach T - L; pairs that can still be linked, if they share all of the long
   lists too, are candidates.
6. Probe. The shingles of a candidate's smaller set, long lists included, are looked up in the other by binary search.

Defined results: null and wordless texts have an empty set and are linked with nothing; fewer words than a shingle are
one shingle; repeated rows are equal sets; a null identifier is the smallest one; an empty table gives no rows; other
columns are ignored, whatever their names. Shingles are told apart by 64-bit hashes, sets by 64 bits of two sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verigate.llm.common import discard, frugal, mix64, seeds64, staged, text_runs
from verigate.llm.components import components
from verigate.llm.minhash import NO_ID, _blocks, _rows, shingles
from verigate.llm.occurrence import indexed, least_overlap, merged

WORDS, PERCENT = 4, 85
RUN_BYTES, ROWS_A_TASK, PAIRS_A_TASK = 1 << 18, 50_000, 3_000
#: Further stars only while members that are apart would make more pairs than this; the merge finds the rest anyhow.
MEET = 50_000_000
_C = seeds64(4, 111)


def _least(n, percent: int):
    """The least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def _share(n):
    return -(-n // 8)


def profiles(rows: DataFrame, percent: int, words: int) -> DataFrame:
    """doc_id, t, n, node (null where the set is empty), keys: the first n - T + k hashes of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                for lo, count, data, starts in text_runs(b, "text", RUN_BYTES):
                    doc, h = shingles(data, starts, words)
                    n = np.bincount(doc, minlength=count)
                    first = np.cumsum(n) - n
                    keep = np.arange(len(h)) - first[doc] < (n - _least(n, percent) + _share(n))[doc]
                    sums = []
                    for c in _C[:2]:
                        total = np.zeros(count, dtype=np.uint64)
                        np.add.at(total, doc, mix64(h ^ c))
                        sums.append(pa.array(total.view(np.int64)))
                    offsets = np.append(0, np.cumsum(np.bincount(doc[keep], minlength=count))).astype(np.int32)
                    keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[keep].view(np.int64)))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, count), b.column(1).slice(lo, count), pa.array(n), *sums, keys], ["doc_id", "t", "n", "k1", "k2", "keys"])

    out = rows.mapInArrow(frugal(run), "doc_id long, t long, n long, k1 long, k2 long, keys array<long>")
    return out.select("doc_id", "t", "n", F.when(F.col("n") > 0, F.xxhash64("k1", "k2", "n")).alias("node"), "keys")


def _elements(texts: DataFrame, words: int) -> DataFrame:
    """node, n and h for each shingle of rows (node, n, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                for lo, count, data, starts in text_runs(b, "text", RUN_BYTES):
                    doc, h = shingles(data, starts, words)
                    of = [b.column(k).slice(lo, count).to_numpy()[doc] for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, of), pa.array(h.view(np.int64))], ["node", "n", "h"])

    return texts.select("node", "n", "text").mapInArrow(frugal(run), "node long, n long, h long")


def buckets(index: DataFrame) -> DataFrame:
    """key, node: the members of each list of ``route``, one list of those that have the same members."""
    rows = index.select("node", F.explode("route").alias("key"))
    lists = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("c > 1")
    one = staged(lists.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"), "keys")
    return rows.join(one, "key").select("key", "node")


def _probed(pairs: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links: the members of the smaller set are looked up in the larger one by binary search."""
    a = index.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.array_sort("members").alias("m_a"))
    b = index.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.array_sort("members").alias("m_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for p, q, x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), t.column(4), t.column(5), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (p + q - both))
            if keep:
                yield t.select([0, 1]).filter(pa.array(keep))

    both = pairs.join(a, "a").join(b, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return both.select("a", "b", "n_a", "n_b", "m_a", "m_b").mapInArrow(frugal(run), "a long, b long")


def _linked(index: DataFrame, percent: int) -> DataFrame:
    """node and root (of its component) for the sets of an index."""
    steps: list[DataFrame] = []

    def step(df: DataFrame, name: str) -> DataFrame:
        steps.append(staged(df, name))
        return steps[-1]

    def tasks(df: DataFrame, each: int) -> int:
        return 1 + df.count() // each

    everyone = step(buckets(index), "buckets")
    rank = step(everyone.groupBy("node").agg(F.count(F.lit(1)).alias("rank")), "ranks")
    joined = step(index.select("node", F.col("node").alias("root")), "roots")
    tested = everyone.sparkSession.createDataFrame([], "a long, b long")
    degree = everyone.sparkSession.createDataFrame([], "node long, degree long")

    def apart() -> DataFrame:
        """The rows (key, node, root) of buckets that hold several components."""
        now = everyone.join(joined, "node")
        mixed = now.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("size")).where("r1 < r2").select("key", "size")
        return step(now.join(mixed, "key").select("key", "node", "root", "size"), "apart")

    def join_up(links: DataFrame, joined: DataFrame) -> DataFrame:
        """Components after new links, which join only the roots so far."""
        ends = links.join(joined.select(F.col("node").alias("a"), F.col("root").alias("u")), "a").join(joined.select(F.col("node").alias("b"), F.col("root").alias("v")), "b")
        higher = step(components(ends.select("u", "v")), "components").select(F.col("node").alias("root"), F.col("root").alias("top"))
        return step(joined.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return step(_probed(pairs.coalesce(tasks(pairs, PAIRS_A_TASK)), index, percent), "links")

    now = apart()
    while not now.isEmpty():
        ranked = now.join(rank, "node").join(degree, "node", "left")
        centre = ranked.groupBy("key").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "rank", "node", "root")).alias("x")).select("key", F.col("x.node").alias("x"), F.col("x.root").alias("x_root"))
        near = step(now.join(centre, "key").coalesce(tasks(now, ROWS_A_TASK)), "near")
        pairs = near.where("root <> x_root").select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct()
        pairs = step(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(pairs)
        found = confirmed(pairs)
        if not found.isEmpty():
            joined = join_up(found, joined)
            ends = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node")))
            degree = step(ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "degrees")
        # a centre has met all of its bucket and leaves it
        everyone = step(near.where("node <> x").select("key", "node"), "buckets")
        now = apart()
        left = now.groupBy("key").agg(F.first("size").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).first()[0] or 0
        if left <= MEET or found.isEmpty():
            break
    if not now.isEmpty():
        blocks = step(_blocks(now.select("key", "node", "root").join(index.select("node", "n"), "node"), percent), "blocks")
        rows = blocks.join(index.select("node", "n", "least", "short"), "node").select("block", "own", "i", "j", "node", "root", "n", "least", "short")
        met = rows.repartition(tasks(blocks, ROWS_A_TASK // 10), "block").sortWithinPartitions("block")
        pairs = step(step(merged(met, percent), "met").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        found = confirmed(pairs)
        if not found.isEmpty():
            joined = join_up(found, joined)
    out = staged(joined, "linked")
    discard(*steps)
    return out


def similarity_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest identifier reachable by links, its own included)."""
    rows = _rows(docs, id_col, text_col)
    first = staged(profiles(rows, percent, words), "profiles")
    held = first.where("node is not null")
    labels = held.groupBy("node").agg(F.min(F.struct("doc_id", "t")).alias("first"), F.first("n").alias("n"))
    labels = staged(labels.select("node", "n", F.col("first.doc_id").alias("label"), F.col("first.t").alias("label_t")), "labels")
    nodes = staged(held.dropDuplicates(["node"]).select("node", "keys"), "nodes")
    every = staged(first.drop("keys"), "every")
    discard(first)
    keys = nodes.select("node", F.explode("keys").alias("key"))
    shared = staged(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "shared")
    discard()
    # a partner has at least T shingles, so it shows k of its own size at least
    of_node = keys.join(shared, "key").groupBy("node").agg(F.count(F.lit(1)).alias("c"))
    likely = staged(of_node.join(labels, "node").where(F.col("c") >= F.ceil(least_overlap(percent) / 8)).select("node"), "likely")
    discard(nodes, shared)
    wanted = likely.join(labels, "node").select("node", "n", F.col("label").alias("doc_id"), F.col("label_t").alias("t"))
    texts = rows.join(wanted.hint("shuffle_hash"), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"])
    elements = staged(_elements(texts, words), "elements")
    index = indexed(elements, percent)
    discard(likely, elements)
    roots = _linked(index, percent)
    discard(index)
    of = labels.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "label")
    least = of.groupBy("root").agg(F.min("label").alias("component_id"))
    of = staged(of.join(least, "root").select("node", "component_id"), "component")
    out = every.join(of, "node", "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: components of documents linked by four-word shingles at 85 %."""
    return similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
e AS (SELECT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(sh) AS x FROM s)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, d.b FROM r JOIN d ON r.reached = d.a)
SELECT r.doc_id, any_value(n.n) AS n_shingles, min(reached) AS component_id FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
