"""Record scans by place, counts of one pass, suffix and key joins, SQL functions: against plain loops."""

from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from verigate.functions import sql
from verigate.functions import text as T
from verigate.operators import corpus, gate
from verigate.sources import records as R


@pytest.mark.parametrize("bytes_each", ["64", "128m"])
def test_scan_of_files_cut_into_blocks(spark, tmp_path, bytes_each):
    """Places and problems are a sequential reader's, however many tasks read a file."""
    (tmp_path / "in" / "sub dir").mkdir(parents=True)
    lines = ['{"a": 1}', "", "  {oops ", "[1]", "7"] + ['{"k": %d, "t": "%s"}' % (i, "é" * (i % 40)) for i in range(60)] + ["", "bad again", '{"z": 1}  ']
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "in" / "sub dir" / "b.jsonl").write_text("\n".join(reversed(lines)))
    (tmp_path / "in" / "c.json").write_text(json.dumps([{"x": 1}, 2, {"y": 3}]))
    (tmp_path / "in" / "d.json").write_text('{"only": true}')
    (tmp_path / "in" / "e.json").write_text("{broken")
    (tmp_path / "in" / "empty.jsonl").write_text("")
    (tmp_path / "in" / "ignored.txt").write_text("no")
    want = []
    for name, own in (("a.jsonl", lines), ("sub%20dir/b.jsonl", lines[::-1])):
        for k, line in enumerate(own, 1):
            if line.strip():
                try:
                    problem = None if isinstance(json.loads(line), dict) else "not an object"
                except ValueError:
                    problem = "not JSON"
                want.append((name, k, problem))
    want += [("c.json", 1, None), ("c.json", 2, "not an object"), ("c.json", 3, None), ("d.json", 1, None), ("e.json", 1, "not JSON")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_each)
    spark.conf.set("spark.sql.files.openCostInBytes", "1" if bytes_each == "64" else "4m")
    try:
        seen = Observation()
        got = [(r.source_file, r.place, r.problem) for r in R.scan_records(spark, str(tmp_path / "in"), observed=seen).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    assert seen.get == {"entries": len(want), "problems": sum(p is not None for *_, p in want)}


def test_scan_of_a_missing_folder(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        R.scan_records(spark, str(tmp_path / "none")).collect()


def test_counts_of_one_pass(spark, tmp_path):
    rows = [("a", "b", "h/x", "2020", "CVE-1", "", 1), ("a ", "b", "h/x", "2020", "CVE-2", "", 2), ("c", "d", "h/held.git", "", "CVE-3", "", 3), ("e", "f", "h/y", "2023-05", "CVE-4", "", 4), ("g", "h", "h/y", "", "cve-9", "", 5), (None, "h", "h/y", None, "", "", 6)]
    raw = spark.createDataFrame(rows, "vuln string, fixed string, repo string, cdate string, cve string, cwe string, ord long")
    out = corpus.write_counted(raw, spark.createDataFrame([("CVE-9",)], "c string"), spark.createDataFrame([("held",)], "r string"), "2022-01-01", str(tmp_path / "out"))
    counts = {r.stage: r.n for r in out.collect()}
    assert counts == {"raw": 6, "after_holdout": 4, "after_temporal_cut": 3, "after_dedup": 2}
    assert sorted(r.ord for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 6]


def test_suffix_pairs(spark):
    texts = ["a.b.c", "b.c", "c", ".c", "x.b.c", "", "c.b", "aa.b.c", None]
    left = [(b, t) for b in ("p", "q") for t in texts]
    right = [("p", t) for t in texts[:6]] + [("q", "b"), ("r", "c")]
    got = {tuple(r) for r in gate.suffix_pairs(spark.createDataFrame(left, "k string, x string"), spark.createDataFrame(right, "k string, y string"), "k", "x", "y").collect()}
    assert got == {(b, x, y) for (b, x), (d, y) in itertools.product(left, right) if b == d and x and y and (x.endswith(y) or y.endswith(x))}


def test_named_pairs_equal_same_test(spark):
    """The key join against the comparison of every two ids."""
    ids = ["C#m", "C::m", " C ", "C", "C.m", "Cm", "C#", "#m", "", "D#m", "C#m#n", "C.m#", "Cm#", "p.C#m", "Dm", "C::", "m", "#", "C#n"]
    df = spark.createDataFrame([(i,) for i in ids], "test string")
    every = df.withColumnRenamed("test", "w").crossJoin(df.withColumnRenamed("test", "f"))
    want = {tuple(r) for r in every.where(gate.same_test(F.col("w"), F.col("f"))).collect()}
    got = {tuple(r) for r in gate.named_pairs(df, df).collect()}
    assert got == want and len(want) > len(ids)


def test_sql_functions_equal_the_columns(spark):
    sql.register(spark)
    texts = [None, "", "Int A; // x\n/* y */ return b;\n}", "CVE-2020-12345 at src/a/B.java deadbeef1 CWE_79", "a b c", "x\r\ny\x0breturn z;\x85@a\n* b", "<a><b></b><!-- <c> --><script><d></script>", "' \\' \\\\ \"quoted\""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df.createOrReplaceTempView("vg_texts")
    names = {"collapse_whitespace": T.collapse_whitespace, "strip_comments": T.strip_comments, "normalize_code": T.normalize_code, "tokens": T.tokens, "redact": T.redact, "norm_cwe": T.norm_cwe, "repo_key": T.repo_key, "count_statements": T.count_statements, "count_exits": T.count_returns, "count_elements": T.count_elements, "cased_tokens": T.whitespace_tokens}
    for name, column in names.items():
        assert [r[0] for r in spark.sql(f"SELECT vg_{name}(t) FROM vg_texts").collect()] == [r[0] for r in df.select(column("t")).collect()], name


def test_diff_lines(spark):
    sql.register(spark)
    rows = spark.sql("SELECT d.mark, d.line FROM VALUES ('a\nb\nc', 'a\nx\nc\nd'), ('same', 'same'), (CAST(NULL AS STRING), 'new') AS t(x, y), LATERAL vg_diff_lines(x, y) d").collect()
    assert sorted(map(tuple, rows)) == [("+", "d"), ("+", "new"), ("+", "x"), ("-", "b")]


def test_named_pairs_are_dealt_by_key_alone(spark):
    """Two ids of several common keys are one pair, without an exchange of the pairs."""
    import re

    from verigate.operators import gate

    ids = ["T#a", "T::a", "T.a", "Ta", "T", "T#", "p.T#a", " T#b ", "T"]
    rows = spark.createDataFrame([(i,) for i in ids], "test string")
    found = gate.named_pairs(rows, rows)
    got = [tuple(r) for r in found.collect()]
    both = rows.distinct().withColumnRenamed("test", "w").crossJoin(rows.distinct().withColumnRenamed("test", "f"))
    want = [tuple(r) for r in both.where(gate.same_test(both["w"], both["f"])).collect()]
    assert sorted(got) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(_key", plan) and not re.search(r"hashpartitioning\(wanted#\d+L?, found", plan)
