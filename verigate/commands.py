"""Whole runs from files to files: ``python -m verigate.commands prepare | metrics | pages``.

``prepare`` makes training examples of repair records, ``metrics`` a table of rates of a results document, ``pages``
accessibility findings of HTML files. Each returns 0, 1 for input that can't be used, 2 for a file that can't be read.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from verigate.operators import accessibility, evaluation, sft
from verigate.operators.tables import staged
from verigate.sources import records as R


def _say(command: str, text: str) -> None:
    print(f"[{command}] {text}", file=sys.stderr)


def prepare(spark: SparkSession, args: argparse.Namespace) -> int:
    """Records below a folder to examples: scan, dedup, split, leak check, JSON lines of both sides."""
    seen = Observation("scan")
    try:
        entries = staged(R.scan_records(spark, args.raw, observed=seen))
    except AnalysisException as e:
        _say("prepare", f"error: {args.raw} can't be read: {e.getCondition()}")
        return 1
    counts = seen.get
    bad = entries.where("problem is not null")
    if args.bad:
        bad.select("source_file", "place", "problem", "value").write.mode("overwrite").json(args.bad)
    else:
        for r in bad.orderBy("source_file", "place").limit(args.show).collect():  # a report's first lines
            _say("prepare", f"warning: {r.source_file}:{r.place}: {r.problem}")
    usable = R.records(entries.where("problem is null").select("value", "source_file", F.col("place").alias("ord")))
    if usable.isEmpty():
        _say("prepare", f"error: no usable records among {counts['entries']} entries")
        return 1
    try:
        made, dedup = sft.prepare(usable, args.split, args.cutoff, args.min_jaccard, args.eval_frac, args.seed)
    except ValueError as e:
        _say("prepare", f"error: {e}")
        return 1
    made = staged(made)
    sft.write_examples(made, args.out, args.eval_out)
    sides = {r["split"]: r["count"] for r in made.groupBy("split").count().collect()}  # two rows
    n = dedup.first()
    _say("prepare", f"entries={counts['entries']} problems={counts['problems']} input={n['input']} exact_dups={n['exact_dups']} near_dups={n['near_dups']} kept={n['kept']} train={sides.get('train', 0)} eval={sides.get('eval', 0)}")
    return 0


def metrics(spark: SparkSession, args: argparse.Namespace) -> int:
    """A results document to its table of rates and the rates by tag, printed."""
    doc = R.read_document(spark, args.results)
    if doc.isEmpty():
        _say("metrics", f"error: {args.results} can't be read")
        return 2
    strata, tags = evaluation.summarize(evaluation.result_rows(doc))
    lines = {r["stratum"]: r["line"] for r in evaluation.rate_lines(strata).collect()}  # a row a stratum
    print(f"{'stratum':<18} {'n':>4} {'cleared':>8} {'rate':>7}  interval of 95 %")
    for stratum in evaluation.STRATA:
        print(lines[stratum])
    print(json.dumps({r["tag"]: {k: v for k, v in r.asDict().items() if k != "tag"} for r in tags.orderBy("tag").collect()}, indent=2))
    if args.out:
        strata.write.mode("overwrite").json(args.out)
    return 0


def pages(spark: SparkSession, args: argparse.Namespace) -> int:
    """HTML files to their findings, a JSON line for each file with the rules' numbers of nodes."""
    try:
        files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", args.glob).text(args.folder, wholetext=True)
        files = files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("html"))
        found = accessibility.by_rule(files, "source", "html", args.rules.split(",") if args.rules else None)
    except AnalysisException as e:
        _say("pages", f"error: {args.folder} can't be read: {e.getCondition()}")
        return 2
    except ValueError as e:
        _say("pages", f"error: {e}")
        return 1
    total = F.aggregate(F.map_values("by_rule"), F.lit(0), lambda s, n: s + n)
    found.select("source", total.alias("violationCount"), F.size("by_rule").alias("ruleCount"), F.col("by_rule").alias("byRule")).write.mode("overwrite").json(args.out)
    return 0


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="python -m verigate.commands")
    sub = ap.add_subparsers(dest="command", required=True)
    p = sub.add_parser("prepare", help="training examples of repair records")
    p.add_argument("raw", help="folder of .jsonl and .json files")
    p.add_argument("--out", required=True, help="folder for the training side")
    p.add_argument("--eval-out", required=True, help="folder for the held-out side")
    p.add_argument("--bad", help="folder for entries that can't be used; without it the first are shown")
    p.add_argument("--show", type=int, default=20)
    p.add_argument("--split", choices=["temporal", "cve"], default="temporal")
    p.add_argument("--cutoff", help="first date of the held-out side; without it the fraction decides")
    p.add_argument("--eval-frac", type=float, default=0.2)
    p.add_argument("--min-jaccard", type=float, default=0.9)
    p.add_argument("--seed", type=int, default=13)
    m = sub.add_parser("metrics", help="rates of a results document")
    m.add_argument("results")
    m.add_argument("--out", help="folder for the rates as JSON lines")
    a = sub.add_parser("pages", help="accessibility findings of HTML files")
    a.add_argument("folder")
    a.add_argument("out")
    a.add_argument("--glob", default="*.html")
    a.add_argument("--rules", help="only these, by commas")
    return ap


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return {"prepare": prepare, "metrics": metrics, "pages": pages}[args.command](spark, args)


if __name__ == "__main__":
    raise SystemExit(main())
