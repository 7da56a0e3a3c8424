"""Bug metadata, covered weaknesses and rule maps, and the evaluation manifest made of them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verigate.functions.text import first_nonempty, listed, norm_cwe
from verigate.sources.records import first_wins, json_items, manifest_summary

# The names under which metadata holds a bug's identifier and its failing tests.
ID_NAMES = ["id", "vul_id", "bug_id", "name"]
TEST_NAMES = ["failing_tests", "pov_tests", "tests", "reproduce_tests"]

MANIFEST = ["id", "project", "cwe", "source", "vulnerable_file", "human_patch_ref", "pov_tests", "semgrep_covered", "transformed"]


def field(value: Column | str, *names: str) -> Column:
    """The first of a JSON object's fields that holds anything; empty where none does."""
    return first_nonempty(*[F.get_json_object(value, f"$.{n}") for n in names])


def truthy(value: Column | str, *names: str) -> Column:
    """Does any of the fields hold a true value (not false, zero, empty or null)?"""
    return field(value, *names).isin("", "false", "0", "0.0", "[]", "{}", "null") == F.lit(False)


def failing_tests(value: Column | str) -> Column:
    """Test ids from the first alias that is a list with elements, or a comma-separated string."""

    def one(name: str) -> Column:
        raw = F.get_json_object(value, f"$.{name}")
        items = F.from_json(raw, "array<string>")
        return F.when(F.size(items) > 0, items).when((F.coalesce(raw, F.lit("")) != "") & ~raw.startswith("["), listed(raw))

    return F.coalesce(*[one(n) for n in TEST_NAMES], F.array().cast("array<string>"))


def by_id(doc: DataFrame, value: str = "value") -> DataFrame:
    """(id, value) from a JSON object of objects by id; no rows from anything else."""
    return doc.select(F.explode(F.from_json(value, "map<string,string>")).alias("id", "value"))


def benchmark_records(files: DataFrame, value: str = "value") -> DataFrame:
    """(id, value, ord) of every record in JSON files of any shape: a list, one record, or records by id.

    An object without an identifier field is taken for a map; its keys are the identifiers of records without one.
    """
    items = files.select(F.posexplode(json_items(value)).alias("ord", "item")).where(F.col("item").startswith("{"))
    own = field("item", *ID_NAMES)
    inner = F.transform(F.map_entries(F.from_json("item", "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("item")))
    rows = F.when(own != "", F.array(F.struct(F.lit("").alias("key"), F.col("item").alias("item")))).otherwise(F.filter(inner, lambda e: F.ltrim(e["item"]).startswith("{")))
    flat = items.select("ord", F.posexplode(rows).alias("at", "r"))
    return flat.select(F.coalesce(F.nullif(field("r.item", *ID_NAMES), F.lit("")), F.col("r.key")).alias("id"), F.col("r.item").alias("value"), "ord", "at").where("id <> ''")


def focus_rules(spark: SparkSession, doc: dict | None) -> DataFrame:
    """(cwe, tool, rule) of a parsed focus document: ``cwes`` with id, semgrep.rule_ids and codeql. A weakness without
    rules has one row without a tool."""
    rows = []
    for entry in (doc or {}).get("cwes") or []:
        if isinstance(entry, dict) and entry.get("id"):
            cwe = str(entry["id"]).strip().upper()
            own = [(cwe, "semgrep", str(r)) for r in (entry.get("semgrep") or {}).get("rule_ids") or []]
            own += [(cwe, "codeql", str(r)) for r in entry.get("codeql") or []]
            rows += own or [(cwe, None, None)]
    return spark.createDataFrame(rows, "cwe string, tool string, rule string")


def read_focus(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a YAML file on the driver; none where the file or the YAML library is missing."""
    try:
        import yaml
    except ImportError:
        return focus_rules(spark, None)
    file = Path(path)
    return focus_rules(spark, yaml.safe_load(file.read_text(encoding="utf-8")) if file.exists() else None)


def covered_set(rules: DataFrame) -> DataFrame:
    """The weaknesses that a rule map names."""
    return rules.select("cwe").distinct()


def with_coverage(entries: DataFrame, covered: DataFrame) -> DataFrame:
    """semgrep_covered: is the weakness in the covered set? An empty one is not."""
    known = covered.select(F.upper("cwe").alias("_cwe")).distinct()
    both = entries.join(F.broadcast(known), F.upper(entries["cwe"]) == known["_cwe"], "left")  # weaknesses: some hundreds at most
    return both.withColumn("semgrep_covered", F.col("_cwe").isNotNull() & (F.col("cwe") != "")).drop("_cwe")


def reproducible_entries(ids: DataFrame, meta: DataFrame) -> DataFrame:
    """One entry for each id (id, ord) from its metadata (id, value); a stub where there is none."""
    both = ids.join(meta.withColumnRenamed("value", "_meta"), "id", "left")
    pick = lambda *names: field("_meta", *names)
    return both.select(
        "id", pick("project", "project_name").alias("project"), norm_cwe(pick("cwe_id", "cwe")).alias("cwe"), F.lit("vul4j").alias("source"),
        pick("vulnerable_file", "human_patch_file", "file").alias("vulnerable_file"), pick("human_patch", "fixing_commit_hash", "revision").alias("human_patch_ref"),
        failing_tests("_meta").alias("pov_tests"), F.lit(False).alias("transformed"), "ord",
    )


def benchmark_entries(records: DataFrame, include_transformed: bool = False) -> DataFrame:
    """One entry for each record (id, value, ord); transformed variants only if asked for, under an id of their own."""
    trans = truthy("value", "transformed", "is_trans")
    pick = lambda *names: field("value", *names)
    out = records.select(
        F.when(trans, F.concat("id", F.lit("-trans"))).otherwise(F.col("id")).alias("id"), pick("project", "repo").alias("project"), norm_cwe(pick("cwe", "cwe_id")).alias("cwe"),
        F.lit("vjbench").alias("source"), pick("vulnerable_file", "file", "buggy_file").alias("vulnerable_file"), pick("human_patch", "fix_commit", "patch_ref").alias("human_patch_ref"),
        failing_tests("value").alias("pov_tests"), trans.alias("transformed"), "ord",
    )
    return out if include_transformed else out.where(~F.col("transformed"))


def evaluation_set(first: DataFrame, second: DataFrame, covered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest, summary): the entries of both sources, one for each id (the first source and the lowest ord win).

    The summary counts all entries, before ids are made unique.
    """
    both = first.withColumn("_part", F.lit(0)).unionByName(second.withColumn("_part", F.lit(1)))
    both = with_coverage(both, covered).withColumn("_order", F.struct("_part", "ord"))
    manifest = first_wins(both.select(*MANIFEST, "_order"), "id", "_order").select(*MANIFEST)
    return manifest, manifest_summary(both)


def read_lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file with their place (``value``, ``ord``)."""
    return spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())


def key_values(text: Column | str) -> Column:
    """map from lines "key: value": keys lower-cased with _ for spaces; the last of equal keys wins; other lines don't count."""
    c = F.col(text) if isinstance(text, str) else text
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.replace(F.lower(F.trim(F.substring_index(x, ":", 1))), F.lit(" "), F.lit("_")).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    late = F.transform(F.array(pairs), lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["k"] == x["k"])))[0]
    return F.map_from_entries(late)


def evaluate_entry(doc: Column | str, bug: Column | str) -> Column:
    """The bug's entry (JSON) in an evaluation document: by id at the top or below results, in the list below results,
    or the document itself. Null where it isn't there."""
    d, b = (F.col(c) if isinstance(c, str) else c for c in (doc, bug))
    at_top = F.try_element_at(F.from_json(d, "map<string,string>"), b)
    nested = F.get_json_object(d, "$.results")
    below = F.try_element_at(F.from_json(nested, "map<string,string>"), b)
    named = lambda x: (F.get_json_object(x, "$.id") == b) | (F.get_json_object(x, "$.vul_id") == b)
    inside = F.get(F.filter(F.from_json(nested, "array<string>"), lambda x: F.coalesce(named(x), F.lit(False))), 0)
    whole = F.when(F.coalesce(named(d), F.lit(False)), d)
    is_object = lambda x: F.when(F.ltrim(x).startswith("{"), x)
    return F.coalesce(is_object(at_top), is_object(below), inside, whole)


def entry_compiled(entry: Column) -> Column:
    """Does an evaluation entry say that the code compiled, itself or below results or metrics?"""
    names = [f"$.{n}" for n in ("compile_success", "compiled", "compile", "build_success")]
    names += [f"$.{part}.{n}" for part in ("results", "metrics") for n in ("compile_success", "compiled", "compile")]
    said = F.coalesce(*[F.get_json_object(entry, n) for n in names])
    return F.coalesce(~said.isin("", "false", "0", "null"), F.lit(False))


def preferred_results(new: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """The results under their new name, and those under the legacy name of keys that have no new ones."""
    return new.unionByName(legacy.join(new.select(key), key, "left_anti"))
