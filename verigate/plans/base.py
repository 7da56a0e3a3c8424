"""The registry of queries and what their definitions share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = frozenset("region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split())
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: White space as Python and Java with (?U) have it, for DuckDB.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: The normal form of code (of a column ``text``) in DuckDB.
BASE = r"regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', ' ', 'g'), '//[^\n]*', ' ', 'g')"
NORM = f"trim(regexp_replace(lower({BASE}), '{WS}+', ' ', 'g'))"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inline(spark: SparkSession, values: str, columns: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def over(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A SELECT in words that both engines read, over the given tables that it names after FROM and JOIN."""
    for name in dict.fromkeys(re.findall(r"(?:FROM|JOIN) (\w+)", sql)):
        if name in TABLES:
            table(spark, sf_dir, name).createOrReplaceTempView(f"vg_{name}")
            sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 vg_{name}", sql)
    return spark.sql(sql)


def mixed(values: str, columns: str, select: str) -> str:
    """Awkward rows as constants, and a row (or more) of every row of a given table; in words that both engines read."""
    return f"SELECT {columns} FROM (VALUES {values}) t({columns}) UNION ALL {select}"


def wilson_sql(k: str, n: str) -> str:
    p, zz = f"({k}::DOUBLE / {n}::DOUBLE)", "(1.96::DOUBLE * 1.96::DOUBLE)"
    centre = f"(({p} + {zz} / (2.0::DOUBLE * {n}::DOUBLE)) / (1.0::DOUBLE + {zz} / {n}::DOUBLE))"
    half = f"((1.96::DOUBLE * sqrt(({p} * (1.0::DOUBLE - {p}) + {zz} / (4.0::DOUBLE * {n}::DOUBLE)) / {n}::DOUBLE)) / (1.0::DOUBLE + {zz} / {n}::DOUBLE))"
    return f"CASE WHEN {n} > 0 THEN {k}::DOUBLE / {n}::DOUBLE ELSE 0.0::DOUBLE END AS rate, CASE WHEN {n} > 0 THEN greatest(0.0::DOUBLE, {centre} - {half}) ELSE 0.0::DOUBLE END AS ci_low, CASE WHEN {n} > 0 THEN least(1.0::DOUBLE, {centre} + {half}) ELSE 0.0::DOUBLE END AS ci_high"


# What has to be redacted, as RE2 has it.
REDACTED = [
    (r"(?://|/\*|#)\s*(?:FIX(?:ME|ED)?|VULN(?:ERABILITY|ERABLE)?|PATCH(?:ED)?|SECURITY|EXPLOIT|SINK)\b[^\n*]*", "", "gi"),
    (r"\bCVE-[0-9]{4}-[0-9]{4,}\b", "<CVE>", "gi"),
    (r"\bCWE[-_]?[0-9]+\b", "<CWE>", "gi"),
    (r"\b(?:VUL4J|VJBENCH)[-_]?[0-9]+\b", "<BUGID>", "gi"),
    (r"\b[A-Za-z]:\\(?:[^\s\\]+\\)*[^\s\\]+\.(?:java|kt|xml|properties|json)\b", "<PATH>", "g"),
    (r"\b(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.(?:java|kt|xml|properties|json)\b", "<PATH>", "g"),
    (r"\b[0-9a-f]{7,40}\b", "<HASH>", "gi"),
]


def redacted_sql(c: str) -> str:
    for pattern, by, flags in REDACTED:
        c = f"regexp_replace({c}, '{pattern}', '{by}', '{flags}')"
    return c
