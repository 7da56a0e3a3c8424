"""Operator 5: line dedup, DataFrame functions only.

Lines become 128-bit hashes of their keys with document and position. These narrow rows are dealt by ranges of
(hash, document descending, position) and streamed in that order, so a line that a third of all documents hold spreads
over many ranges: within a range a running rank counts a hash's documents, and its first occurrence is the document
that keeps the line. Only a range's first and last hash can go on in its neighbours; what a range knows of these two
(documents, largest and smallest identifier) is carried over, two rows for each range. The result is not text but, for
each document that loses lines, a run-length compressed keep bitmap: the lengths of alternating runs kept, dropped,
kept, ...

Defined results: a null or empty text is one empty line; rows with the same identifier are one holder of a
line; a null identifier is a holder too, smaller than all others; a document that loses every line keeps an
empty text; an empty table gives no rows; other columns pass through ``apply_bitmaps`` untouched, but for columns with
the names of its two counts, which it replaces (with ``counts=None`` it adds none and replaces none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verigate.llm.common import discard, n_partitions, staged

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(1 << 63)


def lower_ascii(c: Column) -> Column:
    """A-Z lowered, other letters as they are; a text of one-byte characters takes the short way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    holder = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.withColumns({"_vg_holder": holder, "_vg_row": F.xxhash64(holder, text), "_vg_text": text})


def occurrences(docs: DataFrame, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines with long enough keys: h1, h2 (the key's hash), holder, row, pos."""
    rows = _keyed(docs, id_col, text_col).select("_vg_holder", "_vg_row", F.posexplode(F.split("_vg_text", "\n", -1)).alias("pos", "line"))
    rows = rows.where(F.octet_length("line") >= min_chars).withColumn("key", F.btrim("line", F.lit(WHITE)))
    key = lower_ascii(F.col("key"))
    return rows.where(F.char_length("key") >= min_chars).select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(0x5EED), key).alias("h2"), F.col("_vg_holder").alias("holder"), F.col("_vg_row").alias("row"), "pos")


def _carried(stream: DataFrame) -> DataFrame:
    """For the first and last hash of every range: at, h1, h2, and over all ranges n (documents) and first (largest holder)."""
    key = F.struct("h1", "h2")
    ends = stream.groupBy("at").agg(F.min(key).alias("low"), F.max(key).alias("high"))  # one row for each range
    edge = stream.join(F.broadcast(ends), "at").where((key == F.col("low")) | (key == F.col("high")))
    edge = edge.groupBy("at", "h1", "h2").agg(F.count_distinct("holder").alias("m"), F.max("holder").alias("top"), F.min("holder").alias("least"))
    in_order = Window.partitionBy("h1", "h2").orderBy("at")
    every = Window.partitionBy("h1", "h2")
    # a holder that ends one range and begins the next counts once
    own = edge.withColumn("m", F.col("m") - F.coalesce(F.lag("least").over(in_order) == F.col("top"), F.lit(False)).cast("long"))
    return own.select("at", "h1", "h2", F.sum("m").over(every).alias("n_over"), F.max("top").over(every).alias("first_over"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document that loses lines: holder, row, n_dropped, keep_runs (array of run lengths).

    Runs alternate between kept and dropped lines and begin with kept ones (0 where the first line goes);
    kept lines after the last run aren't written.
    """
    lines = staged(occurrences(docs, min_chars, id_col, text_col), "lines")
    order = [F.col("h1"), F.col("h2"), F.col("holder").desc(), F.col("row"), F.col("pos")]
    stream = staged(lines.repartitionByRange(n_partitions(lines), *order).withColumn("at", F.spark_partition_id()), "stream")
    discard(lines)
    own = Window.partitionBy("at", "h1", "h2")
    ranked = stream.withColumns({"k": F.dense_rank().over(own.orderBy(F.col("holder").desc())), "top": F.max("holder").over(own)})
    ranked = ranked.withColumn("m", F.max("k").over(own))
    found = ranked.join(F.broadcast(_carried(stream)), ["at", "h1", "h2"], "left")  # two rows for each range
    frequent = F.coalesce("n_over", F.col("m")) >= min_docs
    dropped = found.where(frequent & (F.col("holder") != F.coalesce("first_over", "top"))).select("holder", "row", "pos")
    at = dropped.groupBy("holder", "row").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    begin = F.filter("at", lambda p, i: (i == 0) | (p != F.get("at", i - 1) + 1))
    end = F.filter("at", lambda p, i: (i == F.size("at") - 1) | (p != F.get("at", i + 1) - 1))
    runs = F.transform("begin", lambda b, i: F.array(b - F.coalesce(F.get("end", i - 1) + 1, F.lit(0)), F.get("end", i) - b + 1))
    return at.withColumns({"begin": begin, "end": end}).select("holder", "row", F.size("at").cast("long").alias("n_dropped"), F.flatten(runs).alias("keep_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """The documents with their text cut to the kept lines, and two counts: lines before, and dropped."""
    maps = bitmaps.select(F.col("holder").alias("_vg_of"), F.col("row").alias("_vg_of_row"), F.col("n_dropped").alias("_vg_n"), F.col("keep_runs").alias("_vg_runs"))
    rows = _keyed(docs, id_col, text_col)
    both = rows.join(maps.hint("shuffle_hash"), (F.col("_vg_holder") == F.col("_vg_of")) & (F.col("_vg_row") == F.col("_vg_of_row")), "left")
    flags = F.flatten(F.transform("_vg_runs", lambda n, i: F.array_repeat(i % 2 == 0, n)))
    kept = F.array_join(F.filter(F.split("_vg_text", "\n", -1), lambda _, i: F.coalesce(F.get("_vg_flags", i), F.lit(True))), "\n")
    n_lines = F.octet_length("_vg_text") - F.octet_length(F.replace(F.col("_vg_text"), F.lit("\n"), F.lit(""))) + 1
    both = both.withColumn("_vg_flags", flags)
    text = F.when(F.col("_vg_n").isNull(), F.col(text_col)).otherwise(kept)
    added = dict(zip(counts, (n_lines, F.coalesce("_vg_n", F.lit(0))), strict=True)) if counts else {}
    kept_columns = [text.alias(c) if c == text_col else docs[c] for c in docs.columns if c not in added]
    return both.select(*kept_columns, *[value.cast("long").alias(name) for name, value in added.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: per document, how many lines it had and lost, and the hash of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = apply_bitmaps(docs, keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
