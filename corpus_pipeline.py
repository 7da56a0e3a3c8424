"""The corpus pipeline: documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; what it returns is written
as Parquet in the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verigate.llm import bytecnn, linededup, minhash, packing, suffixes
from verigate.llm.common import discard, staged


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: no text, no letter, or a score under the threshold.

    Without labelled rows to learn from nothing can be told, and all go. Repeated rows share their fate; an empty table
    stays empty; columns that have names of this operator's results pass untouched.
    """
    return bytecnn.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go from all documents but that with the largest identifier; n_chars is counted anew.

    A null text stays null; a text that loses all lines is empty. Rows with one identifier are one holder, null
    identifiers too. No row goes; columns named n_lines or n_dropped pass untouched.
    """
    return _measured(linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs), counts=None))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8 or more).

    Of a group the smallest identifier stays (null is the smallest), of equal rows any one; rows without words all stay.
    """
    return minhash.deduplicate(docs, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings go, all their copies; n_chars is counted anew. No row goes; a null text stays null."""
    return _measured(suffixes.deduplicate(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as packed pieces; a null or empty text is the end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The learnt classifier and the packing have no SQL form; tests hold the three stages between them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
            if before is not None:
                discard(before)
            before = docs
    return docs
