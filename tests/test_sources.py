"""Readers and writers on files, and rules that need more than a row of SQL."""

import itertools
import json
import re

import pytest
from pyspark.sql import functions as F

from verigate.functions import text as T
from verigate.functions.java import java_counts
from verigate.operators import corpus, dedup, gate, sft, split
from verigate.operators.metrics import FLAGS, source_stratum
from verigate.sources import metadata as M
from verigate.sources import records as R
from verigate.streaming import streams


def test_records_of_a_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.jsonl").write_text('{"before": "v1", "after": "f1", "CVE": "CVE-1"}\n\nnot json\n[1]\n  {"input": "v2", "output": "f2", "repository": "r"}  \n')
    (tmp_path / "deep" / "list.json").write_text('[{"buggy_code": "v3", "fix_code": "f3", "published_date": "2020"}, 7, {"vuln_code": "v4"}]')
    (tmp_path / "one.json").write_text('{"vulnerable_code": "v5", "patched_code": "f5", "nested": {"x": 1}}')
    (tmp_path / "bad.json").write_text("{broken")
    (tmp_path / "skip.txt").write_text('{"before": "no", "after": "no"}')
    raw = R.read_records(spark, str(tmp_path))
    got = {r.vuln_code: (r.fixed_code, r.cve, r.date, r.project, r.source_file.rsplit("/", 1)[-1]) for r in R.records(raw).collect()}
    assert got == {"v1": ("f1", "CVE-1", "", "", "a.jsonl"), "v2": ("f2", "", "", "r", "a.jsonl"), "v3": ("f3", "", "2020", "", "list.json"), "v5": ("f5", "", "", "", "one.json")}
    with pytest.raises(Exception, match="(?i)path"):
        R.read_records(spark, str(tmp_path / "missing")).count()


def test_manifest_and_lines(spark, tmp_path):
    rows = spark.createDataFrame([("B-1", "ä"), ("B-2", "")], "id string, project string")
    R.write_lines(rows.coalesce(1), str(tmp_path / "m"))
    lines = [json.loads(x) for f in (tmp_path / "m").glob("part-*") for x in f.read_text().splitlines()]
    assert lines == [{"id": "B-1", "project": "ä"}, {"id": "B-2", "project": ""}]
    assert {tuple(r) for r in R.read_manifest(spark, str(tmp_path / "m"), "id string, project string").collect()} == {("B-1", "ä"), ("B-2", "")}
    (tmp_path / "bad.jsonl").write_text('{"id": "x"}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        R.read_manifest(spark, str(tmp_path / "bad.jsonl"), "id string").collect()


def test_examples_are_written_by_side(spark, tmp_path):
    records = spark.createDataFrame([(i, f"int a{i}; // fix CVE-2020-1234{i}", f"int b{i};", f"CVE-{i}", f"202{i}-01-01", "p", "f") for i in range(5)], "ord long, vuln_code string, fixed_code string, cve string, date string, project string, source_file string")
    made, counts = sft.prepare(records, cutoff="2023-01-01")
    sft.write_examples(made, str(tmp_path / "train"), str(tmp_path / "eval"))
    sides = {s: [json.loads(x) for f in (tmp_path / s).glob("part-*") for x in f.read_text().splitlines()] for s in ("train", "eval")}
    assert (len(sides["train"]), len(sides["eval"])) == (3, 2) and counts.first().kept == 5
    for x in sides["train"] + sides["eval"]:
        assert list(x) == ["instruction", "input", "output", "meta"] and "CVE" not in json.dumps(x).replace("<CVE>", "") and "cwe" not in x["meta"]


def test_leaks_raise(spark):
    rows = spark.createDataFrame([("CVE-1", "train"), ("CVE-1", "eval"), ("", "eval")], "cve string, split string")
    with pytest.raises(ValueError, match="CVE-1"):
        split.assert_no_leak(rows, "cve")
    split.assert_no_leak(rows.where("split = 'eval'"), "cve")


def test_greedy_against_a_loop(spark):
    """Records in order; one goes if it is like an earlier one that stays. All documents of the smallest table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    norm = lambda t: re.sub(r"\s+", " ", re.sub(r"//[^\n]*", " ", re.sub(r"(?s)/\*.*?\*/", " ", t)).lower()).strip()
    kept = []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        s = set(re.findall("[a-z0-9_]+", norm(r.text or "")))
        if not any(lang == r.lang and (not s | o or len(s & o) / len(s | o) >= 0.9) for _, lang, o in kept):
            kept.append((r.doc_id, r.lang, s))
    assert sorted(r.doc_id for r in dedup.near_dedup(docs, "doc_id", "lang", "text", 0.9).collect()) == [k[0] for k in kept]


def test_guard_wants_as_many_exits(spark):
    code = "if (a) {\nreturn 1;\n}\nthrow e;\nint b;\nreturn 2;"
    rows = spark.createDataFrame([(code, code.replace("throw e;", "b();")), (code, code), (code, code + "\nreturn 3;")], "a string, b string")
    got = [tuple(r) for r in rows.select(gate.code_guard("a", "b").alias("g")).select("g.ok", "g.returns_kept", "g.orig_returns", "g.new_returns").collect()]
    assert got == [(False, False, 3, 2), (True, True, 3, 3), (True, True, 3, 4)]


METHOD = "class A {{ int f() {{ {0} }} }}"


def test_gate_of_the_single_false(spark):
    """Each flag alone takes the verdict away; all 64 combinations of tool flags."""
    base = {"compiles": True, "semgrep_clean": True, "codeql_clean": True}
    rows = []
    for bits in itertools.product([True, False], repeat=6):
        c, s, q, reg, pov, kept = bits
        rows.append((*bits, c, ["T#a"], [("T", "a")], [] if reg else [("U", "z")], ["T#a"] if pov else [], s, q, METHOD.format("return 1;"), METHOD.format("return 2;" if kept else "x();")))
    schema = "b0 boolean, b1 boolean, b2 boolean, b3 boolean, b4 boolean, b5 boolean, compiles boolean, pov_tests array<string>, failures_before array<struct<test_class:string,test_method:string>>, failures_after array<struct<test_class:string,test_method:string>>, passing_after array<string>, semgrep_clean boolean, codeql_clean boolean, code_before string, code_after string"
    out = gate.run_gate(spark.createDataFrame(rows, schema)).collect()
    assert set(base) < set(FLAGS)
    for r in out:
        c, s, q, reg, pov, kept = (r[f"b{i}"] for i in range(6))
        assert (r.compiles, r.semgrep_clean, r.codeql_clean, r.regression_pass, r.pov_flipped, r.not_deleted) == (c, s, q, c and reg, c and pov, kept)
        assert r.cleared == all((c, s, q, reg, pov, kept))


def test_no_violations_is_no_flip(spark):
    html = "<html lang=en><title>t</title></html>"
    rows = spark.createDataFrame([(html, html), ("<html lang=en><title>t</title><img></html>", html), ("<html><title>t</title><img></html>", "<html><title>t</title><img alt=x></html>")], "a string, b string")
    g = gate.a11y_gate(gate.accessibility("a"), gate.accessibility("b"), F.col("a"), F.col("b"))
    only = gate.a11y_gate(gate.accessibility("a"), gate.accessibility("b"), F.col("a"), F.col("b"), targets=["image-alt"])
    got = [(r[0].flipped, r[0].still_failing, r[1].flipped) for r in rows.select(g, only).collect()]
    assert got == [(False, [], False), (True, [], True), (False, ["html-has-lang"], True)]


def test_null_families_stay(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "b"), (5, "")], "id long, family string")
    out = split.family_split(rows, "family", 0.4).collect()
    assert sorted(r.id for r in out) == [1, 2, 3, 4, 5] and len({r.split for r in out if r.id in (1, 2, 5)}) == 1


def test_strata_by_equality(spark):
    rows = spark.createDataFrame([("x", "vjbench"), ("x", "vjbench-extra"), ("VJBench-1", ""), ("a-Trans", "vul4j"), (None, None)], "id string, source string")
    assert [r[0] for r in rows.select(source_stratum("id", "source")).collect()] == ["vjbench", "vul4j", "vjbench", "vjbench-trans", "vul4j"]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="files.hash"):
        corpus.probed(spark.createDataFrame([("a", "b")], "file_change_id string, language string"), "files")


def test_focus_file(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "f.yaml").write_text("cwes:\n- id: cwe-89\n  semgrep: {rule_ids: [a, b]}\n  codeql: [c]\n- id: CWE-1\n")
    rules = M.read_focus(spark, str(tmp_path / "f.yaml"))
    assert {r.cwe for r in M.covered_set(rules).collect()} == {"CWE-89", "CWE-1"} and rules.count() == 4
    assert M.read_focus(spark, str(tmp_path / "none.yaml")).count() == 0
    findings = spark.createDataFrame([("x.a", "CWE-89"), ("z", "CWE-89"), ("z", "CWE-1")], "check_id string, cwe string")
    assert {tuple(r) for r in gate.in_scope(findings, rules).collect()} == {("x.a", "CWE-89"), ("z", "CWE-1")}


def test_forbidden_paths(spark):
    rows = spark.createDataFrame([("a/.env",), ("a/.envx",), ("K.TOKEN",), ("src/keys.py",), ("docs/x.pptx",)], "p string")
    assert [r[0] for r in rows.select(T.forbidden_path("p")).collect()] == [True, False, True, False, True]


def test_best_so_far_over_batches(spark, tmp_path):
    """The state outlives micro-batches: only improvements come out."""
    folder = tmp_path / "in"
    for i, rows in enumerate([[("b", 0, 0.5), ("b", 1, 0.5), ("c", 0, 0.1)], [("b", 2, 0.4), ("c", 1, 0.9)]]):
        spark.createDataFrame(rows, "bug string, attempt long, score double").coalesce(1).write.mode("append").parquet(str(folder))
        if not i:
            first = {f.name for f in folder.glob("part-*")}
    assert len(first) == 1
    stream = spark.readStream.schema("bug string, attempt long, score double").option("maxFilesPerTrigger", 1).parquet(str(folder))
    run = streams.best_so_far(stream, "bug", "attempt", "score").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    best = out.groupBy("bug").agg(F.min_by("attempt", F.struct(-F.col("score"), F.col("attempt"))).alias("a"), F.max("score").alias("s"))
    assert {tuple(r) for r in best.collect()} == {("b", 0, 0.5), ("c", 1, 0.9)}


JAVA = """package a;
/* block; */ class X {
  private int f = 1; // field;
  int g(String s) {
    int a = 0;
    for (int i = 0; i < 3; i++) { a += i; }
    do { a--; } while (a > 0);
    if (a == 1) return 2; else a = 3;
    String t = "x; return";
    try { h(a); } finally { k(); }
    throw new E(t);
  }
}
"""


def test_java_counts(spark):
    codes = [JAVA, "class X { int f; void g() { } }", "", "class X { void g() { a(); }", "class X { void g() ( a(); } }"]
    rows = spark.createDataFrame([(c,) for c in codes], "code string").select(java_counts("code").alias("c")).collect()
    assert [r.c and tuple(r.c) for r in rows] == [(13, 2), (0, 0), (0, 0), None, None]


def test_parsed_guard(spark):
    fewer = JAVA.replace("    throw new E(t);\n", "    a();\n")
    rows = spark.createDataFrame([(JAVA, JAVA), (JAVA, fewer), (JAVA, JAVA[:-3]), (JAVA[:-3], JAVA)], "a string, b string")
    got = [tuple(r)[::3] for r in rows.select(gate.parsed_guard("a", "b").alias("g")).select("g.ok", "g.ratio", "g.returns_kept", "g.method").collect()]
    assert got == [(True, "parsed"), (False, "parsed"), (False, "parsed"), (True, "lines")]


def test_documents_that_are_missing(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rows": []}')
    (tmp_path / "b.json").write_text("{oops")
    assert [R.read_document(spark, str(tmp_path / n)).count() for n in ("a.json", "b.json", "c.json")] == [1, 0, 0]


def test_queries_from_the_command_line(spark, tmp_path, capsys):
    from verigate.__main__ import main

    assert main(["q_verdict_truth", "/root/testdata/sf0.001", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 64
