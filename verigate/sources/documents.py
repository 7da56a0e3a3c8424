"""JSON objects of unlike shapes: a variant column, and fields taken from it by path with a type and a default."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Field(NamedTuple):
    """A field of a row: its name, where it stands in the object, its type, and what stands for it where it is absent,
    null or of another type. ``required`` fields have no default: without one the row is an error that names it."""

    name: str
    path: str
    kind: str = "string"
    default: object = ""
    required: bool = False


# The fields of a defect and of a candidate patch, with their defaults.
BUG = [Field("id", "$.id", required=True), Field("project", "$.project"), Field("cwe", "$.cwe"), Field("source", "$.source", default="vul4j"), Field("checkout_dir", "$.checkout_dir"), Field("pov_tests", "$.pov_tests", "array<string>", []), Field("vulnerable_file", "$.vulnerable_file")]
PATCH = [Field("bug_id", "$.bug_id", required=True), Field("patched_file_path", "$.patched_file_path"), Field("patched_code", "$.patched_code"), Field("model", "$.model"), Field("attempt", "$.attempt", "int", 0)]
# What a results document shows at a glance.
RESULTS = [Field("model_tag", "$.model_tag"), Field("n", "$.n", "int", 0), Field("cleared", "$.overall.cleared", "int", 0), Field("rate", "$.overall.rate", "double", 0.0), Field("ci_low", "$.overall.ci_low", "double", 0.0), Field("ci_high", "$.overall.ci_high", "double", 0.0), Field("errors", "$.errors", "array<string>", [])]


def objects(df: DataFrame, value: str, strict: bool = False) -> DataFrame:
    """``df`` with ``doc``, a variant of the JSON text in ``value``.

    What isn't an object (or doesn't parse, or is null) is an empty object; with ``strict`` it is an error that names
    the type found.
    """
    doc = F.try_parse_json(F.col(value))
    kind = F.schema_of_variant(doc)
    if strict:
        wrong = F.raise_error(F.concat(F.lit("a JSON object is expected, not "), F.coalesce(kind, F.lit("text that isn't JSON"))))
        return df.withColumn("doc", F.when(kind.startswith("OBJECT"), doc).otherwise(wrong.cast("string").cast("variant")))
    return df.withColumn("doc", F.when(kind.startswith("OBJECT"), doc).otherwise(F.parse_json(F.lit("{}"))))


def _literal(field: Field) -> Column:
    return F.array(*[F.lit(x) for x in field.default]).cast(field.kind) if isinstance(field.default, list) else F.lit(field.default).cast(field.kind)


def taken(field: Field, doc: Column | str = "doc") -> Column:
    found = F.try_variant_get(F.col(doc) if isinstance(doc, str) else doc, field.path, field.kind)
    if field.required:
        return F.coalesce(found, F.raise_error(F.lit(f"the object has no {field.name}")).cast(field.kind)).alias(field.name)
    return F.coalesce(found, _literal(field)).alias(field.name)


def rows(df: DataFrame, fields: list[Field], keep: list[str] | None = None) -> DataFrame:
    """The fields of each object in ``doc`` as columns, beside the columns ``keep``."""
    return df.select(*(keep or []), *[taken(f) for f in fields])


def read_objects(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A row (source_file, doc) for each JSON file at a path, a folder or a pattern. Without ``strict`` a path that isn't
    there gives one empty object, as a file that can't be read does."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not strict and not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
        return objects(spark.createDataFrame([(path, None)], "source_file string, value string"), "value").drop("value")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
    return objects(files, "value", strict).drop("value")
