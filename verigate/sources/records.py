"""Readers: records, id lists, findings, test results, manifests; and the writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verigate.functions.text import first_nonempty, listed, norm_cwe, repo_key
from verigate.operators.split import default_repos

SEMGREP = "results array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<severity:string,message:string>>>"
SARIF = (
    "runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,defaultConfiguration:struct<level:string>>>>>,"
    "results:array<struct<ruleId:string,rule:struct<id:string>,level:string,message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>>>>>"
)
_METRICS = "number_running:string,number_passing:string,number_error:string,number_failing:string,number_skipping:string"
_RUN = f"overall_metrics:struct<{_METRICS}>,failures:array<struct<test_class:string,test_method:string,failure_name:string,detail:string>>,passing_tests:array<string>,skipping_tests:array<string>"
TEST_RESULTS = f"tests struct<{_RUN}>, " + _RUN.replace("overall_metrics:", "overall_metrics ").replace(",failures:", ", failures ").replace(",passing_tests:", ", passing_tests ").replace(",skipping_tests:", ", skipping_tests ")

# The names under which records hold their fields, in the order in which they are tried.
ALIASES = {
    "vuln_code": ["vuln_code", "vulnerable_code", "before", "buggy_code", "input"],
    "fixed_code": ["fixed_code", "patched_code", "after", "fix_code", "output"],
    "cve": ["cve", "cve_id", "CVE"],
    "cwe": ["cwe", "cwe_id", "CWE"],
    "date": ["date", "published", "commit_date", "fix_date", "published_date"],
    "project": ["project", "repo", "repository", "project_name"],
}


def json_items(value: Column | str) -> Column:
    """The elements of a JSON list as an array of JSON, a single object as an array of itself; null where it doesn't parse."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")).when(F.try_parse_json(c).isNotNull(), F.array(F.trim(c)))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The objects in all .jsonl (one a line) and .json files (one, or a list) below a folder: value, source_file, ord.

    What doesn't parse and what isn't an object is dropped; a missing folder raises. ``ord`` rises within a file.
    """
    files = spark.read.option("recursiveFileLookup", "true")
    name = F.col("_metadata.file_path").alias("source_file")
    lines = files.option("pathGlobFilter", "*.jsonl").text(folder).select(F.trim("value").alias("value"), name, F.monotonically_increasing_id().alias("ord")).where("try_parse_json(value) is not null")
    whole = files.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select("value", name)
    items = whole.select("source_file", F.posexplode(json_items("value")).alias("ord", "value")).select("value", "source_file", F.col("ord").cast("long"))
    return lines.unionByName(items).where("startswith(value, '{')")


def scan_records(spark: SparkSession, folder: str, lines: str = "*.jsonl", documents: str = "*.json", observed: Observation | None = None) -> DataFrame:
    """Every entry of all files below a folder, bad ones too: source_file (from the folder on), place, value, problem.

    Files that match ``lines`` have one entry a line (blank ones don't count as entries), those that match ``documents``
    hold one object or a list. ``place`` is the line's number or the place in the list, from 1. ``problem`` is null for
    an object, else why the entry can't be used; then ``value`` is what stands there. Sort by source_file and place for
    the order of a sequential reader. A large file is read by many tasks: lines are numbered within its blocks, and the
    blocks' counts (a row for each) shift them. ``observed`` gets entries and problems in the pass that reads the rows
    (a sort of all rows reads them twice, so write them first).
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    home = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getRawPath().rstrip("/") + "/"
    files = spark.read.option("recursiveFileLookup", "true")
    at = F.col("_metadata.file_path")
    name = F.substring(at, F.locate(home, at) + len(home), F.length(at)).alias("source_file")
    read = files.option("pathGlobFilter", lines).text(folder).select(name, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = read.groupBy("source_file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("source_file", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    numbered = read.join(blocks, ["source_file", "block"]).select("source_file", (F.col("id") + F.col("shift")).alias("place"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("value")).where("value <> ''")
    whole = files.option("pathGlobFilter", documents).text(folder, wholetext=True).select(name, "value")
    entries = F.coalesce(json_items("value"), F.array("value"))
    items = whole.select("source_file", F.posexplode(entries).alias("place", "value")).select("source_file", (F.col("place") + 1).cast("long").alias("place"), "value")
    kind = F.when(F.col("value").isNull() | F.try_parse_json("value").isNull(), "not JSON").when(~F.ltrim("value").startswith("{"), "not an object")
    out = numbered.unionByName(items).withColumn("problem", kind)
    return out.observe(observed, F.count(F.lit(1)).alias("entries"), F.count("problem").alias("problems")) if observed is not None else out


def records(raw: DataFrame, value: str = "value") -> DataFrame:
    """Repair records from JSON under any of their aliases; without both code sides a record goes."""
    pick = lambda names: first_nonempty(*[F.get_json_object(value, f"$.{n}") for n in names])
    out = raw.withColumns({field: pick(names) for field, names in ALIASES.items()})
    return out.where("vuln_code <> '' and fixed_code <> ''").drop(value)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document as a row ``value``; no row where the file is missing or doesn't parse."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path, wholetext=True).where("try_parse_json(value) is not null")


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are skipped, a bad one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def id_list(lines: DataFrame, value: str = "value", inline_comments: bool = False) -> DataFrame:
    """Ids of a text list without blank lines and full-line comments; inline comments stay unless asked."""
    t = F.trim(value)
    if inline_comments:
        t = F.trim(F.regexp_replace(t, r"\s+#.*$", ""))
    return lines.select(t.alias("id")).where("id <> '' and not startswith(id, '#')")


def exclusions(csv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cve, repo lists) from any columns whose names say so, and the repositories that are always held out."""
    cves = [F.upper(F.trim(F.col(c))) for c in csv.columns if "cve" in c.lower()]
    repos = [repo_key(c) for c in csv.columns if any(x in c.lower() for x in ("repo", "project", "url"))]
    empty = F.array().cast("array<string>")
    cve = csv.select(F.explode(F.array(*cves) if cves else empty).alias("cve")).where("startswith(cve, 'CVE-')").distinct()
    repo = csv.select(F.explode(F.array(*repos) if repos else empty).alias("repo")).where("repo <> ''")
    return cve, repo.union(default_repos(csv.sparkSession)).distinct()


def semgrep_findings(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    r = F.explode(F.from_json(raw, SEMGREP)["results"]).alias("r")
    out = df.select(*keep, r)
    line = F.coalesce("r.start.line", F.lit(0))
    return out.select(*keep, F.coalesce("r.check_id", F.lit("")).alias("check_id"), F.coalesce("r.path", F.lit("")).alias("path"), line.alias("start_line"), F.coalesce(F.col("r.end.line"), line).alias("end_line"), F.coalesce("r.extra.severity", F.lit("")).alias("severity"), F.coalesce("r.extra.message", F.lit("")).alias("message"), F.lit("semgrep").alias("tool"))


def sarif_findings(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    runs = df.select(*keep, F.explode(F.from_json(raw, SARIF)["runs"]).alias("run"))
    rows = runs.select(*keep, F.col("run.tool.driver.rules").alias("rules"), F.explode("run.results").alias("r"))
    rule = F.coalesce(F.col("r.ruleId"), F.col("r.rule.id"), F.lit(""))
    default = F.get(F.filter("rules", lambda x: x["id"] == rule), 0)["defaultConfiguration"]["level"]
    at = F.get("r.locations", 0)["physicalLocation"]
    start = F.coalesce(at["region"]["startLine"], F.lit(0))
    return rows.select(*keep, rule.alias("check_id"), F.coalesce(at["artifactLocation"]["uri"], F.lit("")).alias("path"), start.alias("start_line"), F.coalesce(at["region"]["endLine"], start).alias("end_line"), F.coalesce(F.col("r.level"), default, F.lit("")).alias("severity"), F.coalesce("r.message.text", F.lit("")).alias("message"), F.lit("codeql").alias("tool"))


def test_summary(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """Counts and lists of a test-results document, nested below ``tests`` or not."""
    d = df.select(*keep, F.from_json(raw, TEST_RESULTS).alias("d"))
    m = F.coalesce("d.tests.overall_metrics", "d.overall_metrics")
    number = lambda n: F.coalesce(m[f"number_{n}"].try_cast("int"), F.lit(0)).alias(n)
    failures = F.coalesce("d.tests.failures", "d.failures", F.array().cast("array<struct<test_class:string,test_method:string,failure_name:string,detail:string>>"))
    none = F.array().cast("array<string>")
    return d.select(*keep, *[number(n) for n in ("running", "passing", "error", "failing", "skipping")], F.filter(failures, lambda x: x.isNotNull()).alias("failures"), F.coalesce("d.tests.passing_tests", "d.passing_tests", none).alias("passing_tests"), F.coalesce("d.tests.skipping_tests", "d.skipping_tests", none).alias("skipping_tests"))


def manifest_entries(meta: DataFrame) -> DataFrame:
    """Manifest rows from metadata columns under their aliases (all strings); missing columns count as empty."""
    have = set(meta.columns)
    pick = lambda *names: first_nonempty(*[n for n in names if n in have]) if have & set(names) else F.lit("")
    cwe = norm_cwe(pick("cwe_id", "cwe"))
    return meta.select(pick("id", "bug_id").alias("id"), pick("project", "repo_slug", "repo").alias("project"), cwe.alias("cwe"), pick("source").alias("source"), pick("vulnerable_file", "file").alias("vulnerable_file"), pick("human_patch", "patch").alias("human_patch_ref"), listed(pick("failing_tests", "pov_tests", "tests")).alias("pov_tests"))


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the first by ``order``."""
    row = F.min_by(F.struct(*[F.col(c) for c in df.columns if c != key]), F.col(order)).alias("_r")
    return df.groupBy(key).agg(row).select(key, "_r.*")


def manifest_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("source") == "vul4j").alias("vul4j"), F.count_if(F.col("source") == "vjbench").alias("vjbench"), F.count_if("transformed").alias("transformed"), F.count_if("semgrep_covered").alias("covered"))


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines in the order of the columns."""
    df.write.mode("overwrite").json(path)


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, n) for each stage of a pipeline."""
    out = None
    for name, df in stages.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = row if out is None else out.unionByName(row)
    return out
