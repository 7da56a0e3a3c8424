"""The relational corpus: methods, files, commits, fixes and weaknesses to before/after pairs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from verigate.functions.text import collapse_whitespace, pair_key, repo_key
from verigate.operators.dedup import first_per_key, minhash_duplicates
from verigate.operators.split import before, hold_out


def first_weakness(classes: DataFrame) -> DataFrame:
    """The first weakness seen of each CVE (by ``ord``)."""
    return classes.groupBy("cve_id").agg(F.min_by("cwe_id", "ord").alias("cwe"))


def _digest(text: Column) -> Column:
    """SHA-256; an empty text stays empty, null stays null."""
    return F.when(text == "", text).otherwise(F.sha2(text, 256))


def pairs(methods: DataFrame, files: DataFrame, commits: DataFrame, fixes: DataFrame, classes: DataFrame, language: str = "java", empty: bool = False, digests: bool = False) -> DataFrame:
    """vuln, fixed, repo, cdate, cve, cwe and ord for each (file, method): the last code before and after, the first of the rest.

    A pair with an empty side is none, and code that is null is empty. With ``empty`` an empty side is a side like any
    other, and null is no code: the last one that isn't null counts. With ``digests`` vuln and fixed are digests of the
    texts, which then go into no join: enough to count by.
    """
    code = F.col("code") if empty else F.coalesce("code", F.lit(""))
    if digests:
        methods = methods.select("file_change_id", "name", "before_change", "ord", _digest(code).alias("code"), _digest(collapse_whitespace(code)).alias("_flat"))
    kept = F.struct("code", "_flat") if digests else F.struct(code.alias("code"))
    rows = methods.join(files, "file_change_id").where(F.lower("programming_language") == language).join(commits, "hash").join(fixes, "hash")
    yes = F.lower(F.col("before_change").cast("string")).isin("1", "true", "t", "yes")
    last = lambda side: F.max_by(F.when(side, kept), F.when(side & code.isNotNull(), F.col("ord")))
    own = rows.groupBy("file_change_id", "name").agg(
        last(yes).alias("_vuln"),
        last(~yes).alias("_fixed"),
        *[F.min_by(c, F.struct("ord", "cve_id")).alias(a) for c, a in (("repo_url", "repo"), ("committer_date", "cdate"), ("cve_id", "cve"))],
        F.min("ord").alias("ord"),
    )
    own = own.withColumns({"vuln": F.col("_vuln.code"), "fixed": F.col("_fixed.code")})
    flat = (lambda side: F.col(f"_{side}._flat")) if digests else collapse_whitespace
    sides = F.col("vuln").isNotNull() & F.col("fixed").isNotNull() if empty else (F.coalesce("vuln", F.lit("")) != "") & (F.coalesce("fixed", F.lit("")) != "")
    own = own.where(sides & (flat("vuln") != flat("fixed")))
    cwe = first_weakness(classes)
    return own.join(cwe, own["cve"] == cwe["cve_id"], "left").select("vuln", "fixed", "repo", "cdate", "cve", F.coalesce("cwe", F.lit("")).alias("cwe"), "ord")


# The names of the columns of the five tables, in the order in which they are tried.
COLUMNS = {
    "methods": {"code": ["code", "code_change", "method_code"], "before_change": ["before_change", "is_before", "before"], "name": ["name", "method_name", "signature"], "file_change_id": ["file_change_id"]},
    "files": {"file_change_id": ["file_change_id"], "programming_language": ["programming_language", "language"], "hash": ["hash", "commit_hash"]},
    "commits": {"hash": ["hash", "commit_hash"], "repo_url": ["repo_url", "repo_name", "repository"], "committer_date": ["committer_date", "author_date", "commit_date", "date"]},
    "fixes": {"hash": ["hash", "commit_hash"], "cve_id": ["cve_id", "cve"]},
    "classes": {"cve_id": ["cve_id", "cve"], "cwe_id": ["cwe_id", "cwe"]},
}
OPTIONAL = {"name", "repo_url", "committer_date"}


def probed(table: DataFrame, kind: str) -> DataFrame:
    """One of the five tables with its columns under their common names (``ord`` too, where it has one).

    Optional columns that are missing are empty; others that are missing are named in an error, before anything runs.
    """
    have, out, missing = set(table.columns), [], []
    for name, aliases in COLUMNS[kind].items():
        found = next((a for a in aliases if a in have), None)
        if found:
            out.append(F.col(found).alias(name))
        elif name in OPTIONAL:
            out.append(F.lit("").alias(name))
        else:
            missing.append(f"{kind}.{name}")
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return table.select(*out, *(["ord"] if "ord" in have else []))


def near_dedup(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Without pairs whose words (both sides together) are like those of an earlier pair that stays (by ``ord``).

    Candidates come from minimum hashes; likeness is exact, so that nothing goes by a chance of the hashes.
    """
    both = pairs.withColumn("_both", F.concat("vuln", F.lit(" "), "fixed"))
    gone = minhash_duplicates(both, "ord", "_both", threshold, tokens_of="words")
    return pairs.join(gone, pairs["ord"] == gone["_gone"], "left_anti")


def write_counted(raw: DataFrame, cves: DataFrame, repos: DataFrame, cutoff: str, path: str) -> DataFrame:
    """Writes the corpus (hold-out, temporal cut, exact dedup) to ``path`` and gives (stage, n), all in one job.

    Each stage counts its rows as they stream by, so nothing is read or joined again for the counts.
    """
    spark = raw.sparkSession
    counts = {stage: Observation(f"{stage}-{uuid.uuid4().hex}") for stage in ("raw", "after_holdout", "after_temporal_cut", "after_dedup")}
    seen = lambda df, stage: df.observe(counts[stage], F.count(F.lit(1)).alias("n"))
    held = seen(hold_out(seen(raw, "raw").withColumn("_repo", repo_key("repo")), "cve", "_repo", cves, repos).drop("_repo"), "after_holdout")
    cut = seen(held.where(before(F.coalesce("cdate", F.lit("")), cutoff)), "after_temporal_cut")
    seen(first_per_key(cut, pair_key("vuln", "fixed"), [F.col("ord")]), "after_dedup").write.parquet(path)
    return spark.createDataFrame([(stage, int(o.get["n"])) for stage, o in counts.items()], "stage string, n long")


def build(raw: DataFrame, cves: DataFrame, repos: DataFrame, cutoff: str, near: float | None = None, key: Column | None = None) -> dict[str, DataFrame]:
    """The stages of the corpus by name: raw, after the hold-out, the temporal cut, the exact and the near dedup.

    The exact dedup is by collapsed texts (``pair_key``), or by another ``key``.
    """
    held = hold_out(raw.withColumn("_repo", repo_key("repo")), "cve", "_repo", cves, repos).drop("_repo")
    cut = held.where(before(F.coalesce("cdate", F.lit("")), cutoff))
    stages = {"raw": raw, "after_holdout": held, "after_temporal_cut": cut, "after_dedup": first_per_key(cut, pair_key("vuln", "fixed") if key is None else key, [F.col("ord")])}
    if near is not None:
        stages["after_near_dedup"] = near_dedup(stages["after_dedup"], near)
    return stages
