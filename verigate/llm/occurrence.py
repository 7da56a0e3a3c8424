"""T-occurrence search over inverted lists: what operators 8 and 11 share.

A set's shingles are ordered by the length of their lists. By DivideSkip the L longest of a set's lists are long, and a
partner that shares T of its shingles is in at least T - L of the short ones. Members of a block are merged by these; a
pair is a candidate if it can reach the threshold with all long lists counted in, so no pair above it is missed.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigate.llm.common import discard, frugal, staged

#: DivideSkip's weight of a list's length; postings above which a merge counts all of them in one pass, without a heap.
MU, HEAP_POSTINGS = 0.0085, 4_096


def least_overlap(percent: int) -> Column:
    """T of a column n."""
    return F.expr(f"cast(({percent} * n + 99) div 100 as int)")


def indexed(elements: DataFrame, percent: int) -> DataFrame:
    """node, n, least (T - L), short and route (hashes, shortest list first), members (all in lists of several sets).

    A set that is in too few lists of several sets is left out.
    """
    sizes = elements.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    sizes = staged(sizes, "lists")
    of = elements.join(sizes, "h").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("lists"))
    of = of.withColumn("t", least_overlap(percent)).where(F.size("lists") >= F.col("t"))
    longest = F.element_at("lists", -1)["df"]
    of = of.withColumn("long", F.least(F.col("t") - 1, F.floor(F.col("t") / (MU * F.log2(longest.cast("double")) + 1)).cast("int")))
    hashes = F.col("lists.h")
    out = of.select("node", "n", (F.col("t") - F.col("long")).alias("least"), F.slice(hashes, F.lit(1), F.size("lists") - F.col("long")).alias("short"), F.slice(hashes, F.lit(1), F.size("lists") - F.col("t") + 1).alias("route"), hashes.alias("members"))
    out = staged(out, "index")
    discard(sizes)
    return out


def merge_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(value, occurrences) for the values that stand in at least ``least`` of the ascending lists, by a heap that jumps
    over values which can't."""
    at = [0] * len(lists)
    heap = [(own[0], k) for k, own in enumerate(lists) if own]
    heapq.heapify(heap)
    found = []
    while len(heap) >= least:
        top, out = heap[0][0], []
        while heap and heap[0][0] == top:
            out.append(heapq.heappop(heap)[1])
        if len(out) >= least:
            found.append((top, len(out)))
            goal = top + 1
        else:
            while heap and len(out) < least - 1:  # the next value that reaches ``least`` isn't below what is left then
                out.append(heapq.heappop(heap)[1])
            if not heap:
                return found
            goal = heap[0][0]
        for k in out:
            at[k] = bisect_left(lists[k], goal, at[k])
            if at[k] < len(lists[k]):
                heapq.heappush(heap, (lists[k][at[k]], k))
    return found


def occurrences(lists: list[list[int]], least: int, n: int) -> list[tuple[int, int]]:
    """What ``merge_skip`` gives, of values below n; where very many postings meet, by counting them all."""
    if sum(map(len, lists)) <= HEAP_POSTINGS:
        return merge_skip(lists, least)
    count = np.bincount(np.concatenate([np.array(x, dtype=np.int64) for x in lists]), minlength=n)
    return [(int(k), int(count[k])) for k in np.flatnonzero(count >= least)]


def block_pairs(own, i: int, j: int, node, root, n, least, short: list, percent: int, key: int | None = None, keys: list | None = None) -> list[tuple[int, int]]:
    """The pairs of a block that are in different components, of sizes that can be linked, and share so many short lists that, with all the long ones, they can be linked.

    With ``key`` (the block's bucket) and ``keys`` (all buckets of each set) a pair only counts in the first bucket that
    both are in. Sets of the largest component don't search: all others are searched for in the lists of all.
    """
    order = np.argsort(n, kind="stable")
    roots, sizes = np.unique(root, return_counts=True)
    main = roots[np.argmax(sizes)]
    lists: dict[int, list[int]] = {}
    for x, k in enumerate(order.tolist()):
        for h in short[k]:
            lists.setdefault(h, []).append(x)
    held = [set(x) for x in keys] if keys is not None else []
    own, node, root, n, least = (c[order] for c in (own, node, root, n, least))
    long, place = -(-percent * n // 100) - least, np.arange(len(n))
    found = []
    for x, k in enumerate(order.tolist()):
        if root[x] == main:
            continue
        # what two sets share beyond their short lists stands in the long lists of the one whose short ones end first
        goal = np.maximum(np.minimum(least, least[x]), -(-percent * (n + n[x]) // (100 + percent)) - np.maximum(long, long[x]))
        may = (root != root[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])) & ((place > x) | (root == main))
        may &= (own != own[x]) if i != j else True
        if not may.any():
            continue
        mine = [own_list for h in short[k] if len(own_list := lists[h]) > 1]
        for y, c in occurrences(mine, max(1, int(goal[may].min())), len(n)):
            if not may[y] or c < goal[y] or (keys is not None and key != min(held[k] & held[int(order[y])])):
                continue
            found.append((int(min(node[x], node[y])), int(max(node[x], node[y]))))
    return found


def merged(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of all blocks; rows are block, own, i, j, node, root, n, least, short, sorted by
    block, and key and keys where a pair is to count in one bucket alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            i, j = t["i"][0].as_py(), t["j"][0].as_py()
            pairs = block_pairs(*[t["own"].to_numpy(), i, j], *[t[c].to_numpy() for c in ("node", "root", "n", "least")], t["short"].to_pylist(), percent, *([t["key"][0].as_py(), t["keys"].to_pylist()] if "keys" in t.column_names else [])) if t.num_rows > 1 else []
            held.clear()
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], ["a", "b"])

        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and held[-1].column(0)[0].as_py() != int(block[lo]):
                    yield from done()
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from done()

    return rows.mapInArrow(frugal(run), "a long, b long")
