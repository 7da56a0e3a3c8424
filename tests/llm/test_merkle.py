"""Operator 12 against a plain loop."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from verigate.llm import merkle


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(*values) -> str:
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _tree(nodes: list[str], fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and for each node its path of (left, right)."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, k in zip(paths, place):
            lo = k - k % fanout
            path.append(("".join(nodes[lo:k]), "".join(nodes[k + 1 : lo + fanout])))
        nodes = [_h(*nodes[lo : lo + fanout]) for lo in range(0, len(nodes), fanout)]
        place = [k // fanout for k in place]
    return nodes[0], paths


def _expected(rows: list[tuple], fanout: int) -> dict:
    groups: dict = {}
    for ident, lang, text in rows:
        groups.setdefault(lang, []).append((ident is not None, ident, _leaf(ident, lang, text)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0], r[1] or 0, r[2]))
        trees[g] = _tree([r[2] for r in groups[g]], fanout)
    root, above = _tree([trees[g][0] for g in order], fanout)
    return {(ident, node): (trees[g][0], root, path + above[k]) for k, g in enumerate(order) for (_, ident, node), path in zip(groups[g], trees[g][1])}


@pytest.mark.parametrize("fanout,levels,sizes", [(2, 2, [1, 4, 5, 17]), (2, 8, [3, 1]), (3, 1, [10, 9, 2]), (2, 1, [33]), (5, 2, [26, 25, 1, 7])])
def test_equals_a_loop(spark, fanout, levels, sizes):
    names = [None, "", "é", "zz"]
    rows = [(k * 100 + i, names[k], None if i % 5 == 3 else "" if i % 5 == 2 else f"text {i} ü\n") for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    out = merkle.manifest(df, ["doc_id", "lang", "text"], "lang", ["doc_id"], fanout=fanout, levels=levels)
    want = _expected(rows, fanout)
    got = {(r.doc_id, r.leaf): (r.subroot, r.root, [tuple(s) for s in r.path]) for r in out.collect()}
    assert got == want
    assert out.where(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).count() == len(rows)


def test_ties_nulls_clashing_names_and_long_texts(spark):
    long = "x" * 1_000_000
    rows = [(1, None, "a"), (1, None, "a"), (None, None, None), (None, None, "b"), (2, None, long), (1, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    clash = df.withColumns({c: F.lit(c) for c in ["leaf", "g", "at", "node", "path", "root", "block", "id0", "changed", "rows", "levels"]})
    want = _expected(rows, 2)
    for table in (df, clash):
        got = merkle.manifest(table, ["doc_id", "lang", "text"], "lang", ["doc_id"], levels=1).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, r.leaf) for r in got} == set(want) and {r.root for r in got} == {next(iter(want.values()))[1]}


def test_a_change_shows(spark):
    df = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("l").alias("lang"), F.col("id").cast("string").alias("text"))
    out = merkle.manifest(df, ["doc_id", "text"], "lang", ["doc_id"], {"changed": merkle.leaf(F.col("doc_id"), F.lit("other"))}, levels=3)
    assert out.where(merkle.fold(F.col("changed"), F.col("path")) == F.col("root")).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert merkle.manifest(df, ["doc_id", "text"], "lang", ["doc_id"]).count() == 0
