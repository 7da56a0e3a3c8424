"""Runs over a manifest: attempts to rows, rows to stratified rates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigate.operators.gate import MIN_RETAINED, code_guard
from verigate.operators.metrics import COVERED, FLAGS, STRATA, cleared, compare_tags, is_covered, quick_verdict, rates_by, source_stratum, stratified
from verigate.operators.ranking import best_candidate, decisive_attempt

_BUG = "bug:struct<id:string,project:string,cwe:string,source:string,checkout_dir:string,pov_tests:array<string>,vulnerable_file:string>"
_VERDICT = "verdict:struct<bug_id:string," + ",".join(f"{f}:boolean" for f in FLAGS) + ">"
RESULTS = f"rows array<struct<{_BUG},{_VERDICT},tag:string,cleared:boolean>>"
AXE = "source string, violationCount int, ruleCount int, byRule map<string,int>, violations array<struct<id:string,impact:string,help:string,nodes:array<struct<html:string,failureSummary:string>>>>"


def result_rows(docs: DataFrame, value: str = "value") -> DataFrame:
    """One row for each bug of a results document; missing fields have their defaults, a missing verdict is derived."""
    r = docs.select(F.explode(F.from_json(value, RESULTS)["rows"]).alias("r"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    out = r.select(
        blank(F.col("r.bug.id")).alias("id"), blank(F.col("r.bug.project")).alias("project"), blank(F.col("r.bug.cwe")).alias("cwe"), F.coalesce("r.bug.source", F.lit("vul4j")).alias("source"),
        blank(F.col("r.bug.vulnerable_file")).alias("vulnerable_file"), F.coalesce("r.bug.pov_tests", F.array().cast("array<string>")).alias("pov_tests"),
        *[F.coalesce(F.col(f"r.verdict.{f}"), F.lit(False)).alias(f) for f in FLAGS], F.coalesce("r.tag", F.lit("finetuned")).alias("tag"), F.col("r.cleared").alias("_said"),
    )
    return out.withColumn("cleared", F.coalesce("_said", cleared())).drop("_said")


def row_strata(covered: list[str] = COVERED) -> Column:
    """The strata that a row (id, source, cwe) counts in: all, its source's, and covered or not."""
    return F.array(F.lit(STRATA[0]), source_stratum("id", "source"), F.when(is_covered("cwe", covered), STRATA[-2]).otherwise(STRATA[-1]))


def summarize(rows: DataFrame, baseline: str = "baseline") -> tuple[DataFrame, DataFrame]:
    """(rates of every stratum, rates by tag with the difference to the baseline)."""
    return stratified(rows, row_strata(), STRATA), compare_tags(rows, "tag", baseline)


def rate_lines(strata: DataFrame) -> DataFrame:
    """A line of text for each stratum: name, n, cleared, rate and interval in percent."""
    percent = [F.col(c) * 100 for c in ("rate", "ci_low", "ci_high")]
    return strata.select("stratum", F.format_string("%-18s %4d %8d %6.1f%%  [%.1f%%, %.1f%%]", "stratum", "n", "cleared", *percent).alias("line"))


def rounded(strata: DataFrame) -> DataFrame:
    """The rates of a report's table, to three digits."""
    return strata.select("stratum", *[F.round(c, 3).alias(c) for c in ("rate", "ci_low", "ci_high")], "cleared", "n")


def badges() -> list[Column]:
    """The report's five marks of a verdict; the scanners' two flags are one."""
    scanners = F.coalesce(F.col("semgrep_clean"), F.lit(False)) & F.coalesce(F.col("codeql_clean"), F.lit(False))
    return [F.coalesce(F.col(c), F.lit(False)).alias(a) for c, a in (("compiles", "compiles"), ("regression_pass", "regression"), ("pov_flipped", "pov"), ("not_deleted", "not_deleted"))] + [scanners.alias("scanners")]


def layer_rows(verdicts: DataFrame, key: str, layers: str = "layers", most: int = 140) -> DataFrame:
    """The layers of each verdict as rows, their detail cut to ``most`` characters."""
    flat = verdicts.select(key, F.explode(layers).alias("l"))
    return flat.select(key, F.col("l.name").alias("layer"), F.col("l.passed").alias("passed"), F.left(F.coalesce("l.detail", F.lit("")), F.lit(most)).alias("detail"))


def verdict_json(verdicts: DataFrame, key: str) -> DataFrame:
    """Each verdict as one JSON object with sorted keys and the derived flag."""
    return verdicts.select(key, F.to_json(F.struct(*sorted([key, *FLAGS, "cleared"]))).alias("json"))


def chosen(candidates: DataFrame, bug: str = "bug", attempt: str = "attempt", position: str = "position", score: str | None = None) -> DataFrame:
    """One candidate of each attempt: the judge's best, or the first without a judge."""
    out = candidates if score else candidates.withColumn("_score", F.lit(0.0))
    keyed = out.withColumn("_of", F.struct(bug, attempt))
    return best_candidate(keyed, "_of", score or "_score", attempt, position).drop("_of", "_score")


def run(manifest: DataFrame, candidates: DataFrame, tag: str, score: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a recorded run: gated candidates (bug, attempt, position, the flags) over a manifest.

    An attempt's candidate is chosen, its verdict derived, and a bug has the first attempt that cleared, else its last.
    Bugs without any candidate are errors. ``limit`` takes the first bugs of the manifest (by id; below 0 is none).
    """
    if limit is not None:
        manifest = manifest.orderBy("id").limit(max(0, limit))
    gated = chosen(candidates, score=score).withColumn("cleared", cleared())
    last = decisive_attempt(gated, "bug", "attempt").withColumnRenamed("bug", "id")
    rows = manifest.select("id", "project", "cwe", "source").join(last, "id").withColumn("tag", F.lit(tag))
    errors = manifest.join(last, "id", "left_anti").select(F.col("id").alias("bug_id"), F.lit("checkout").alias("stage"), F.lit("no candidate was recorded").alias("error"))
    return rows, errors


def report(rows: DataFrame, errors: DataFrame, manifest: str, tag: str, baseline: str = "baseline") -> DataFrame:
    """The results document as one row of JSON: rates overall, by stratum and by tag, and counts. The rows stay a table."""
    strata, tags = summarize(rows, baseline)
    stat = F.struct("n", "cleared", "rate", "ci_low", "ci_high")
    by_stratum = strata.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stratum", stat.alias("s"))))).alias("strata"))  # one entry for each stratum
    by_tag = tags.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", stat.alias("s"))))).alias("tags"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct("tag", "delta"))))).alias("delta"))
    n_errors = errors.agg(F.count(F.lit(1)).alias("errors"))
    whole = by_stratum.crossJoin(by_tag).crossJoin(n_errors)  # one row each
    return whole.select(F.to_json(F.struct(F.lit(tag).alias("model_tag"), F.lit(manifest).alias("manifest"), F.col("strata")[STRATA[0]]["n"].alias("n"), "errors", F.col("strata")[STRATA[0]].alias("overall"), "strata", F.struct(F.col("tags").alias("per_tag"), F.lit(baseline).alias("baseline_tag"), F.col("delta").alias("delta_vs_baseline")).alias("compare"))).alias("json"))


def quick_rows(samples: DataFrame, least: float = MIN_RETAINED) -> DataFrame:
    """Red, green, not deleted and cleared of samples (file, cwe, original, patched, before, after).

    A sample without a patch is none of green, not deleted and cleared. The ratio has three digits.
    """
    guard = code_guard("original", "patched", least)
    out = samples.withColumn("_g", guard).withColumns({"red": F.col("before") > 0, "green": F.coalesce(F.col("after") == 0, F.lit(False)) & F.col("patched").isNotNull(), "not_deleted": F.col("_g.ok") & F.col("patched").isNotNull(), "retained_ratio": F.when(F.col("patched").isNotNull(), F.round("_g.ratio", 3))})
    verdict = F.coalesce(quick_verdict("before", "after", "not_deleted"), F.lit(False))
    return out.withColumn("cleared", verdict & F.col("green")).select("file", "cwe", "red", "green", "not_deleted", "cleared", "before", "after", "retained_ratio")


def quick_summary(rows: DataFrame, tag: str) -> DataFrame:
    """n, cleared, rate and interval of a quick run; one row also where there are no rows."""
    every = rows.sparkSession.createDataFrame([(tag,)], "model_tag string")
    own = rates_by(rows.withColumn("model_tag", F.lit(tag)), ["model_tag"])
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return every.join(own, "model_tag", "left").select("model_tag", zero("n", 0), zero("cleared", 0), zero("rate", 0.0), zero("ci_low", 0.0), zero("ci_high", 0.0))


def axe_scans(docs: DataFrame, value: str, keep: list[str]) -> DataFrame:
    """Scan reports: source, counts and map of rule to count; missing numbers are 0, a missing map is empty."""
    d = docs.select(*keep, F.from_json(value, AXE).alias("d"))
    empty = F.create_map().cast("map<string,int>")
    return d.select(*keep, F.coalesce("d.source", F.lit("")).alias("source"), F.coalesce("d.violationCount", F.lit(0)).alias("violation_count"), F.coalesce("d.ruleCount", F.lit(0)).alias("rule_count"), F.coalesce("d.byRule", empty).alias("by_rule"), F.coalesce("d.violations", F.array().cast("array<struct<id:string,impact:string,help:string,nodes:array<struct<html:string,failureSummary:string>>>>")).alias("violations"))


def rule_counts(scans: DataFrame, key: str) -> DataFrame:
    """Nodes by rule of every scan, from its list of violations."""
    return scans.select(key, F.explode("violations").alias("v")).groupBy(key, F.col("v.id").alias("rule")).agg(F.sum(F.size(F.coalesce("v.nodes", F.array().cast("array<struct<html:string,failureSummary:string>>")))).alias("nodes"))


def flips(phases: DataFrame, key: str, phase: str, failed: str) -> DataFrame:
    """Failed before and not after, by a row of each phase ('before', 'after')."""
    side = lambda name: F.max(F.when(F.col(phase) == name, F.col(failed)))
    both = phases.groupBy(key).agg(side("before").alias("before"), side("after").alias("after"))
    return both.select(key, F.coalesce(F.col("before") & ~F.col("after"), F.lit(False)).alias("flipped"))


def with_text(rows: DataFrame, files: DataFrame, path: str, name: str = "text") -> DataFrame:
    """Rows with the text of the file that they name (files: path, text); empty where there is none."""
    own = files.select(F.col("path").alias("_path"), F.col("text").alias("_text"))
    return rows.join(own, rows[path] == own["_path"], "left").withColumn(name, F.coalesce("_text", F.lit(""))).drop("_path", "_text")
