"""Acceptance verdicts and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigate.functions.rates import rate, wilson

# Weaknesses that the scanners cover, strata, verdict flags.
COVERED = ["CWE-89", "CWE-78", "CWE-79", "CWE-22", "CWE-327", "CWE-328", "CWE-611", "CWE-502", "CWE-90", "CWE-91", "CWE-113", "CWE-326", "CWE-295"]
STRATA = ["overall", "vul4j", "vjbench", "vjbench-trans", "semgrep-covered", "semgrep-uncovered"]
FLAGS = ["compiles", "regression_pass", "pov_flipped", "semgrep_clean", "codeql_clean", "not_deleted"]


def cleared(flags: list[str] = FLAGS) -> Column:
    """A verdict holds if all its flags do."""
    out = F.lit(True)
    for f in flags:
        out &= F.coalesce(F.col(f), F.lit(False))
    return out


def quick_verdict(before: str, after: str, kept: str) -> Column:
    """Findings before, none after, and nothing deleted; a count of -1 is a scanner error and neither."""
    return (F.col(before) > 0) & (F.col(after) == 0) & F.col(kept)


def tool_clean(n: Column, failed: Column, required: bool) -> Column:
    """A scanner's verdict: an error counts against a required tool and for an optional one."""
    return F.when(failed, F.lit(not required)).otherwise(n == 0)


def is_covered(cwe: str, covered: list[str] = COVERED) -> Column:
    return F.upper(F.trim(F.coalesce(F.col(cwe), F.lit("")))).isin(covered)


def source_stratum(bug: str, source: str) -> Column:
    b, s = F.lower(F.coalesce(F.col(bug), F.lit(""))), F.lower(F.coalesce(F.col(source), F.lit("")))
    return F.when(b.contains("trans"), "vjbench-trans").when((s == "vjbench") | b.startswith("vjbench"), "vjbench").otherwise("vul4j")


def rates_by(df: DataFrame, keys: list[str], flag: str = "cleared") -> DataFrame:
    """n, cleared, rate and interval for each key."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("cleared"))
    low, high = wilson(F.col("cleared"), F.col("n"))
    return out.select(*keys, "n", "cleared", rate(F.col("cleared"), F.col("n")).alias("rate"), low.alias("ci_low"), high.alias("ci_high"))


def stratified(df: DataFrame, strata: Column, names: list[str], flag: str = "cleared") -> DataFrame:
    """Rates for every named stratum; ``strata`` is the array of those that a row counts in. Empty ones have n = 0."""
    counts = df.select(F.explode(strata).alias("stratum"), F.col(flag).alias("ok")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("cleared"))
    every = df.sparkSession.createDataFrame([(s,) for s in names], "stratum string")
    both = every.join(counts, "stratum", "left").select("stratum", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cleared", F.lit(0)).alias("cleared"))
    low, high = wilson(F.col("cleared"), F.col("n"))
    return both.select("stratum", "n", "cleared", rate(F.col("cleared"), F.col("n")).alias("rate"), low.alias("ci_low"), high.alias("ci_high"))


def compare_tags(df: DataFrame, tag: str, baseline: str, flag: str = "cleared") -> DataFrame:
    """Rates by tag with the difference to the baseline's (null without one), four digits."""
    by = rates_by(df, [tag], flag)
    base = by.where(F.col(tag) == baseline).select(F.col("rate").alias("_base"))
    delta = F.when(F.col(tag) != baseline, F.round(F.col("rate") - F.col("_base"), 4))
    return by.join(base, how="left").withColumn("delta", delta).drop("_base")
