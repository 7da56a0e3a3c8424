"""Training examples from repair records: dedup, split, leak check, examples, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigate.functions.text import code_key, first_nonempty, jaccard, redact, tokens
from verigate.operators.dedup import date_key, hashed_sets, near_duplicates_of
from verigate.operators.signatures import signed
from verigate.operators.split import assert_no_leak, family_of, family_split, temporal_split
from verigate.operators.tables import staged

INSTRUCTION = "Repair the vulnerability in this Java file. Keep all other behaviour and give back the whole corrected source, nothing else."
SYSTEM = "You repair vulnerable Java sources and answer with the whole corrected file."


def dedup_records(records: DataFrame, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(kept, statistics) of records with vuln_code, fixed_code, project, date, source_file and ord.

    Records come in the order of date (none is last), file and place. Of equal normalised pairs the first stays; then
    one goes that is like an earlier kept one of its project on both sides. A threshold outside (0, 1] ends with the
    first step. Copies of a record that goes count as near duplicates, as it does.
    """
    order = [date_key("date"), F.col("source_file"), F.col("ord")]
    keyed = records.withColumn("_id", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.unhex(code_key("vuln_code", "fixed_code")).alias("_pair")))
    near = 0 < threshold <= 1
    if near:
        # alike on both sides is alike on both taken together, so one search over marked tokens finds all candidates; a
        # token's side is the last bit of its hash
        side = lambda mark, c: F.transform(tokens(c), lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(mark)))
        only = lambda mark, c: F.filter(c, lambda w: w.bitwiseAND(F.lit(1)) == mark)
        alike = lambda x, y: (jaccard(only(0, x), only(0, y)) >= threshold) & (jaccard(only(1, x), only(1, y)) >= threshold)
        sets = hashed_sets(keyed, "_id", "project", F.concat(side(0, "vuln_code"), side(1, "fixed_code")))
        own = staged(signed(sets, threshold))
    else:
        own = staged(keyed.select(F.col("_id").alias("id")))
    # the texts are read again at the end; until then there are keys, signatures and the sets of candidates alone
    least = staged(own.groupBy(F.col("id._pair").alias("_pair")).agg(F.min("id").alias("_least")))
    if near:
        of = own.select("node", "id").join(least, F.col("id") == F.col("_least"), "left_semi")
        gone = near_duplicates_of(own, sets, threshold, alike, of).select(F.col("_gone._pair").alias("_gone"))
    else:
        gone = records.sparkSession.createDataFrame([], "_gone binary")
    gone = staged(gone)
    stay = staged(least.join(gone, least["_pair"] == gone["_gone"], "left_anti").select("_least"))
    kept = keyed.join(stay, F.col("_id") == F.col("_least"), "left_semi").drop("_id")
    marked = own.select("id").join(least, F.col("id._pair") == F.col("_pair")).select("_pair", (F.col("id") != F.col("_least")).alias("dup"))
    counts = marked.join(gone, marked["_pair"] == gone["_gone"], "left").agg(
        F.count(F.lit(1)).alias("input"), F.count_if(F.col("_gone").isNull() & F.col("dup")).alias("exact_dups"),
        F.count_if(F.col("_gone").isNotNull()).alias("near_dups"), F.count_if(F.col("_gone").isNull() & ~F.col("dup")).alias("kept"),
    )
    return kept, counts


def split_records(kept: DataFrame, mode: str = "temporal", cutoff: str | None = None, fraction: float = 0.2, seed: int = 13) -> DataFrame:
    """``split`` of records: by date (by family where no record has one), or by family."""
    family = family_of("cve", "project", "ord")
    if mode == "cve":
        return family_split(kept, family, fraction, seed)
    return temporal_split(kept, "date", cutoff, fraction, family)


def examples(split: DataFrame, cutoff: str) -> DataFrame:
    """Instruction, redacted input, verbatim output and meta without weakness, CVE or file; ``split`` beside them."""
    meta = F.struct("project", "date", F.col("split").alias("split"), F.lit(cutoff).alias("cutoff"), code_key("vuln_code", "fixed_code").alias("dedup_key"))
    return split.select(F.lit(INSTRUCTION).alias("instruction"), redact("vuln_code").alias("input"), F.col("fixed_code").alias("output"), meta.alias("meta"), "split")


def prepare(records: DataFrame, mode: str = "temporal", cutoff: str | None = None, threshold: float = 0.9, fraction: float = 0.2, seed: int = 13) -> tuple[DataFrame, DataFrame]:
    """(examples, dedup statistics) of records. Raises where a CVE stands on both sides of the split."""
    kept, counts = dedup_records(records, threshold)
    split = staged(split_records(kept, mode, cutoff, fraction, seed))
    assert_no_leak(split, "cve")
    return examples(split, cutoff or f"({mode}, seed={seed})"), counts


def write_examples(made: DataFrame, train: str, held_out: str) -> None:
    """JSON lines of either side, in the order of the columns."""
    for side, path in (("train", train), ("eval", held_out)):
        made.where(F.col("split") == side).drop("split").write.mode("overwrite").json(path)


def corpus_examples(pairs: DataFrame) -> DataFrame:
    """(cwe, prompt, completion) of before/after pairs, code in fences."""
    cwe = F.coalesce(F.nullif("cwe", F.lit("")), F.lit("security"))
    fence = lambda c: F.concat(F.lit("```java\n"), F.trim(c), F.lit("\n```"))
    head = F.concat(F.lit("This Java method has a "), cwe, F.lit(" weakness. Give back the whole corrected method and nothing else."))
    return pairs.select(cwe.alias("cwe"), F.concat(head, F.lit("\n\n"), fence("vuln")).alias("prompt"), fence("fixed").alias("completion"))


def fix_prompt(project: Column, file: Column, code: Column, note: Column) -> Column:
    """The request for a repair: project and file (or unknown), feedback where there is any, and the code in a fence."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    parts = [F.lit("Repair the security defect in the Java file below; find it in the code itself."), F.concat(F.lit("Project: "), known(project)), F.concat(F.lit("File: "), known(file))]
    again = F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit("The last attempt failed the gate:\n"), F.trim(note)))
    body = F.concat(F.lit("Give back the whole file in one fence:\n\n```java\n"), F.coalesce(code, F.lit("")), F.lit("\n```"))
    return F.concat_ws("\n\n", *parts, again, body)  # a null part is left out


def judge_prompt(project: Column, file: Column, code: Column) -> Column:
    """The request for a verdict on one candidate."""
    head = F.concat(F.lit("Does this patch close the defect without taking behaviour away?\n\nProject: "), F.coalesce(F.nullif(project, F.lit("")), F.lit("unknown")), F.lit("\nFile: "), F.coalesce(file, F.lit("")))
    return F.concat(head, F.lit("\n\n```java\n"), F.coalesce(code, F.lit("")), F.lit('\n```\n\nAnswer with one JSON object: {"accept": bool, "score": 0..1, "reason": "..."}.'))


def a11y_prompt(rules: Column, html: Column) -> Column:
    """The request to mend a page: the summary of its rules, and the page in a fence."""
    return F.concat(F.lit("Accessibility violations: "), rules, F.lit(".\n\n```html\n"), F.coalesce(html, F.lit("")), F.lit("\n```\n\nGive back the whole corrected page."))


def chat_of(df: DataFrame) -> Column:
    """Messages of a training example: those that it has, else system, user and assistant from their aliases."""
    have = set(df.columns)
    pick = lambda *names: first_nonempty(*[n for n in names if n in have]) if have & set(names) else F.lit("")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    made = F.array(message("system", F.lit(SYSTEM)), message("user", pick("prompt", "instruction", "input", "vulnerable")), message("assistant", pick("completion", "output", "response", "fixed")))
    return F.coalesce(F.col("messages"), made) if "messages" in have else made
