"""Hold-outs, temporal cuts and splits by family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verigate.functions.text import tokens

# Repositories held out by default.
HELD_OUT_REPOS = ["javamelody", "jsoup", "jackson-dataformat-xml", "jackson-databind", "openrefine", "plexus-archiver", "sling", "rdf4j", "xstream", "esapi-java-legacy", "esapi", "swagger-parser", "commons-compress"]

#: Ranges of the hash order over which family sizes are summed first.
_SLICES = 4096


def default_repos(spark) -> DataFrame:
    """The repositories that are always held out, as one column."""
    return spark.createDataFrame([(r,) for r in HELD_OUT_REPOS], "repo string")


def hold_out(df: DataFrame, cve: str, repo: str, cves: DataFrame, repos: DataFrame) -> DataFrame:
    """Rows whose CVE (in any case) and whose repository key aren't held out (both lists have one column)."""
    c, r = cves.select(F.upper(cves.columns[0]).alias("_cve")).distinct(), repos.select(F.col(repos.columns[0]).alias("_repo")).distinct()
    return df.join(c, F.upper(df[cve]) == c["_cve"], "left_anti").join(r, df[repo] == r["_repo"], "left_anti")


def decontaminated(df: DataFrame, items: DataFrame, id_col: str, text: str, words: int = 8) -> DataFrame:
    """The rows that share no run of ``words`` code tokens with any item (both have a column ``text``)."""

    def grams(c: str) -> Column:
        each = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (words - 1), F.lit(1))), lambda i: F.md5(F.array_join(F.slice(t, i, words), " ")))
        return F.array_distinct(F.flatten(F.transform(F.array(tokens(c)), lambda t: F.when(F.size(t) >= words, each(t)).otherwise(F.array().cast("array<string>")))))

    held = items.select(F.explode(grams(text)).alias("_gram")).distinct()
    dirty = df.select(F.col(id_col).alias("_dirty"), F.explode(grams(text)).alias("_gram")).join(held, "_gram", "left_semi").select("_dirty").distinct()
    return df.join(dirty, df[id_col] == dirty["_dirty"], "left_anti")


def before(date: Column, cutoff: str) -> Column:
    """Dated before the cutoff by the first ten characters, or undated."""
    return (date == "") | (F.substring(date, 1, 10) < F.lit(cutoff))


def auto_cutoff(df: DataFrame, date: str, fraction: float) -> DataFrame:
    """One row: the date at place clamp(int(n * (1 - fraction)), 0, n - 1) of the sorted dates.

    Counts by date (few) are summed up instead of sorting rows.
    """
    days = df.where((F.col(date) != "") & F.col(date).isNotNull()).groupBy(date).agg(F.count(F.lit(1)).alias("n"))
    total = days.agg(F.sum("n").alias("total"))
    upto = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    place = F.greatest(F.lit(0), F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(1 - fraction))))
    return days.withColumn("upto", F.sum("n").over(upto)).crossJoin(total).where(F.col("upto") > place).agg(F.min(date).alias("cutoff"))


def temporal_split(df: DataFrame, date: str, cutoff: str | None, fraction: float = 0.2, family: Column | None = None) -> DataFrame:
    """``split``: eval for dated rows from the cutoff on, train for the rest.

    Without a cutoff it is taken from the dates; where no row has a date, whole families are split instead.
    """
    if cutoff is None:
        cutoff = auto_cutoff(df, date, fraction).first()["cutoff"]
        if cutoff is None:
            return family_split(df, family if family is not None else F.lit(None).cast("string"), fraction)
    late = (F.coalesce(F.col(date), F.lit("")) != "") & (F.substring(date, 1, 10) >= F.lit(cutoff))
    return df.withColumn("split", F.when(late, "eval").otherwise("train"))


def family_of(cve: str, project: str, row: str) -> Column:
    """A record's family: its CVE, else its project, else the record itself (by ``row``, which tells records apart)."""
    own = F.concat(F.lit("__rec_"), F.col(row).cast("string"))
    return F.coalesce(F.nullif(F.col(cve), F.lit("")), F.nullif(F.col(project), F.lit("")), own)


def family_split(df: DataFrame, family: Column | str, fraction: float, seed: int = 13) -> DataFrame:
    """``split`` by whole families: in the order of a seeded hash, a family goes to eval while those before it hold
    less than the target. A null family is one too.

    Families may be as many as records, so their sizes are summed by slices of the hash order first: the running total
    over slices (a fixed number) shifts the one within each slice.
    """
    key = F.coalesce((F.col(family) if isinstance(family, str) else family).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_family")))
    sizes = df.groupBy(key.alias("_family")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_at", digest)
    sizes = sizes.withColumn("_slice", F.conv(F.substring("_at", 1, 3), 16, 10).cast("int"))
    slices = sizes.groupBy("_slice").agg(F.sum("_n").alias("_in"))
    upto = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(F.col("_slice").alias("_of"), F.coalesce(F.sum("_in").over(upto), F.lit(0)).alias("_shift"))  # at most _SLICES rows
    within = Window.partitionBy("_slice").orderBy("_at", "_family").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(F.broadcast(slices), F.col("_slice") == F.col("_of"))
    target = df.agg(F.floor(F.count(F.lit(1)) * F.lit(fraction)).alias("_target"))
    label = placed.crossJoin(target).select(F.col("_family"), F.when(F.col("_before") + F.col("_shift") < F.col("_target"), "eval").otherwise("train").alias("split"))
    return df.withColumn("_key", key).join(label, F.col("_key") == F.col("_family")).drop("_key", "_family")


def leaked(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand on both sides of a split; empty where nothing leaks."""
    return df.where(F.col(key) != "").groupBy(key).agg(F.count_distinct("split").alias("sides")).where("sides > 1").select(key)


def assert_no_leak(df: DataFrame, key: str) -> None:
    """Raises where a key stands on both sides; names up to five of them."""
    found = [r[0] for r in leaked(df, key).orderBy(key).limit(5).collect()]
    if found:
        raise ValueError(f"on both sides of the split: {found}")


def sampled(df: DataFrame, n: int, name: str = "sample") -> DataFrame:
    """Every row n times, numbered from 0 (at least once): the places for n candidates of each."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1))))
