"""Operator 12: a Merkle manifest of a table, by higher-order functions over blocks of leaves.

A leaf is the hash of a row's fields. In each group leaves stand in order and every ``fanout`` neighbours become the
hash of their join, level by level, until one node (the group's root) remains; the roots of the groups, in order of the
group, give the table's root in the same way. Leaves are numbered by ranges (``number_rows``) and gathered into blocks
of ``fanout ** LEVELS``; sequence, transform, slice and aggregate collapse a block by that many levels, and the roots of
the blocks are the leaves of the next pass. So no array is longer than a block, a group of any size spreads over its
blocks, and each pass has that many times fewer rows. On the way back each block takes the rest of the path from the
pass above: a join of unique keys.

Defined results: a null field is hashed as ``-``, so null and empty differ; rows are ordered by the given columns
(nulls first), then by their leaf, so equal rows are interchangeable; a null group is the first one; an empty table has
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verigate.llm.common import discard, number_rows, staged

#: A block has fanout ** LEVELS leaves.
LEVELS = 8
_STEP = "struct<left:string,right:string>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(c: Column) -> Column:
    """A value as it is hashed: its UTF-8 length, a colon, itself; ``-`` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(F.concat(*[field(c) for c in fields]))


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its path (array of struct left, right) lead to."""
    return F.aggregate(path, node, lambda x, s: digest(F.concat(s["left"], x, s["right"])))


def _powers(fanout: int, levels: int) -> list[int]:
    return [fanout**k for k in range(levels + 1)]


def _collapsed(nodes: Column, single: Column, fanout: int, levels: int) -> Column:
    """All levels of a block, from its nodes to one: as many as a block has, or up to the first single node where the
    block is all there is of its group."""

    def above(now: Column) -> Column:
        runs = F.sequence(F.lit(0), F.ceil(F.size(now) / fanout).cast("int") - 1)
        return F.transform(runs, lambda i: digest(F.array_join(F.slice(now, i * fanout + 1, F.lit(fanout)), "")))

    shorter = F.filter(F.array(*[F.lit(p) for p in _powers(fanout, levels)]), lambda p: p < F.size(nodes))
    high = F.when(single, F.size(shorter)).otherwise(F.lit(levels))
    steps = F.when(high > 0, F.sequence(F.lit(1), high)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes), lambda all_, _: F.concat(all_, F.array(above(F.element_at(all_, -1)))))


def _path_of(at: Column, levels_of: Column, fanout: int, levels: int) -> Column:
    """What stands left and right of the node ``at`` in its run, in each level but the last."""
    power = F.array(*[F.lit(p) for p in _powers(fanout, levels)])

    def step(nodes: Column, level: Column) -> Column:
        place = F.floor(at / F.element_at(power, level + 1)).cast("int")
        within = place % fanout
        left = F.array_join(F.slice(nodes, place - within + 1, within), "")
        right = F.array_join(F.slice(nodes, place + 2, fanout - 1 - within), "")
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(F.slice(levels_of, F.lit(1), F.size(levels_of) - 1), step)


def _climb(leaves: DataFrame, carried: Sequence[str], fanout: int, levels: int, used: list[DataFrame]) -> list[DataFrame]:
    """The passes from rows (g, at, node, carried...): tables of g, block, rows, levels; the last has a block a group."""
    size, passes = fanout**levels, []
    while True:
        rows = F.sort_array(F.collect_list(F.struct("at", "node", *carried)))
        blocks = leaves.withColumn("block", F.expr(f"at div {size}")).groupBy("g", "block").agg(rows.alias("rows"))
        single = (F.col("block") == 0) & (F.size("rows") < size)
        blocks = staged(blocks.withColumn("levels", _collapsed(F.col("rows.node"), single, fanout, levels)), "merkle")
        used.append(blocks)
        passes.append(blocks)
        if blocks.where("block > 0").isEmpty():
            return passes
        leaves, carried = blocks.select("g", F.col("block").alias("at"), F.element_at(F.element_at("levels", -1), 1).alias("node")), ()


def _descend(passes: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The leaves of the first pass with their path to the top. ``tops`` has g, path (from the group's root on), and
    what else goes down to each leaf."""
    extra = [c for c in tops.columns if c not in ("g", "path")]
    size, up = fanout**levels, tops.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(passes) - 1, -1, -1):
        both = passes[k].join(up, ["g", "block"])
        own = F.transform("rows", lambda r: F.struct(r.alias("row"), _path_of((r["at"] % size).cast("int"), F.col("levels"), fanout, levels).alias("own")))
        each = both.select("g", "path", *extra, F.explode(own).alias("x")).select("g", F.col("x.row").alias("row"), F.concat("x.own", "path").alias("path"), *extra)
        up = each if k == 0 else each.select("g", F.col("row.at").alias("block"), "path", *extra)
    return up


def manifest(docs: DataFrame, fields: Sequence[str], group: str, order: Sequence[str], carry: dict[str, Column] | None = None, fanout: int = 2, levels: int = LEVELS) -> DataFrame:
    """Per row: the ``order`` columns, leaf, subroot (of its group), root, path (array of struct left, right, from the
    leaf to the root), and the ``carry`` columns, which are taken from the row."""
    used: list[DataFrame] = []
    carry = carry or {}
    ids = [f"id{k}" for k in range(len(order))]
    held = [f"carry{k}" for k in range(len(carry))]
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("g"),
        leaf(*[F.col(c) for c in fields]).alias("node"),
        *[F.col(c).alias(a) for c, a in zip(order, ids, strict=True)],
        *[c.alias(a) for c, a in zip(carry.values(), held, strict=True)],
    )
    numbered = number_rows(leaves, ["g"], [*ids, "node"], "at")
    passes = _climb(numbered, [*ids, *held], fanout, levels, used)
    top = lambda p: p.select("g", F.element_at(F.element_at("levels", -1), 1).alias("node"))
    roots = number_rows(top(passes[-1]).select(F.lit("").alias("all"), F.col("g").alias("of"), "node"), ["all"], ["of"], "at")
    above = _climb(roots.select(F.lit("").alias("g"), "at", "node", "of"), ["of"], fanout, levels, used)
    whole = top(above[-1]).select("g", F.array().cast(f"array<{_STEP}>").alias("path"), F.col("node").alias("root"))
    groups = _descend(above, whole, fanout, levels).select(F.col("row.of").alias("g"), "path", F.col("row.node").alias("subroot"), "root")
    out = _descend(passes, groups, fanout, levels)
    out = staged(out.select(*[F.col(f"row.{a}").alias(c) for c, a in zip(order, ids, strict=True)], F.col("row.node").alias("leaf"), "subroot", "root", "path", *[F.col(f"row.{a}").alias(c) for c, a in zip(carry, held, strict=True)]), "manifest")
    discard(*used)
    return out


_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: leaf, roots and proof of each document, and the root that tampered rows lead to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    rows = manifest(docs, _FIELDS, "lang", ["doc_id"], {"changed": F.when(tampered, changed)})
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR END"


def _leaf_sql(*columns: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in columns) + ")"


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"

ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {_leaf_sql(*_FIELDS)} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN {_leaf_sql("doc_id", "source", "lang", "n_chars + 1", "text")} ELSE {_leaf_sql(*_FIELDS)} END AS now FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT g, 0 AS lvl, pos, n, leaf AS h FROM k
    UNION ALL SELECT g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY g, lvl, pos // 2, (n + 1) // 2),
s AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, n, h FROM s
    UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 2, (n + 1) // 2),
p AS (SELECT doc_id, g, 0 AS lvl, pos, n, '' AS sibs, now AS f FROM k
    UNION ALL SELECT p.doc_id, p.g, p.lvl + 1, p.pos // 2, (p.n + 1) // 2, p.sibs || coalesce(x.h, ''), sha256(CASE WHEN p.pos % 2 = 0 THEN p.f || coalesce(x.h, '') ELSE x.h || p.f END)
    FROM p LEFT JOIN t x ON x.g = p.g AND x.lvl = p.lvl AND x.pos = xor(p.pos, 1) WHERE p.n > 1),
q AS (SELECT doc_id, p.g, 0 AS lvl, s.pos, s.n, sibs, f FROM p JOIN s ON p.g = s.g WHERE p.n = 1
    UNION ALL SELECT q.doc_id, q.g, q.lvl + 1, q.pos // 2, (q.n + 1) // 2, q.sibs || coalesce(x.h, ''), sha256(CASE WHEN q.pos % 2 = 0 THEN q.f || coalesce(x.h, '') ELSE x.h || q.f END)
    FROM q LEFT JOIN u x ON x.lvl = q.lvl AND x.pos = xor(q.pos, 1) WHERE q.n > 1)
SELECT k.doc_id, leaf, s.h AS subroot, u.h AS root, sha256(q.sibs) AS proof_sha256, q.f AS folded_root, q.f = u.h AS verified
FROM k JOIN q ON q.doc_id = k.doc_id AND q.n = 1 JOIN s ON s.g = k.g JOIN u ON u.n = 1
"""
