"""Queries of metadata, evaluation runs and training examples."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from verigate.functions import sql
from verigate.functions import text as T
from verigate.functions.java import counts_of, java_statements
from verigate.operators import accessibility, corpus, dedup, evaluation, gate, metrics, sft, split
from verigate.operators.tables import shared_folder, staged
from verigate.plans.base import NORM, WS, inline, mixed, over, query, redacted_sql, table, wilson_sql
from verigate.sources import documents as D
from verigate.sources import metadata as M
from verigate.sources import records as R
from verigate.streaming import streams

_STMT = "list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x)), lambda s: s NOT IN ('', '{{', '}}') AND NOT regexp_matches(s, '^(//|\\*|/\\*|@)'))"
_EXITS = "len(list_filter({0}, lambda x: contains(x, 'return') OR contains(x, 'throw')))"
_CODES = "(1, 'int a;' || chr(10) || 'return 1;' || chr(10) || 'throw e;', 'int a;' || chr(10) || 'return 1;' || chr(10) || 'int b;'), (2, 'a();' || chr(10) || 'b();' || chr(10) || 'c();', 'a();'), (3, '', 'x();'), (4, '{' || chr(10) || 'return x;' || chr(10) || '}', '// gone' || chr(10) || 'return y;'), (5, 'a();' || chr(10) || 'b();' || chr(10) || 'return c;', 'a();' || chr(10) || 'return c;')"


@query(f"""WITH c AS (SELECT -id AS id, a, b FROM (VALUES {_CODES}) t(id, a, b) UNION ALL SELECT doc_id, text, left(text, (length(text) * 7 // 10)::BIGINT) FROM documents),
s AS (SELECT id, {_STMT.format("a")} AS x, {_STMT.format("b")} AS y FROM c), n AS (SELECT id, len(x) AS s0, len(y) AS s1, {_EXITS.format("x")} AS r0, {_EXITS.format("y")} AS r1 FROM s)
SELECT id, CASE WHEN s0 > 0 THEN s1::DOUBLE / s0 ELSE 1.0 END AS ratio, r1 >= r0 AS returns_kept, (CASE WHEN s0 > 0 THEN s1::DOUBLE / s0 ELSE 1.0 END) >= 0.6 AND r1 >= r0 AS ok FROM n""")
def q_code_guard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id as id", "text as a", "left(text, length(text) * 7 div 10) as b")
    codes = inline(spark, _CODES, "id, a, b").selectExpr("cast(-id as long) as id", "a", "b").unionByName(docs)
    return codes.select("id", gate.code_guard("a", "b").alias("g")).select("id", "g.ratio", "g.returns_kept", "g.ok")


_IDS = "('T#a'), ('T::a'), ('T.a'), ('Ta'), ('T'), ('U#z'), ('p.T#a'), (' T#b ')"


@query(f"""WITH i AS (SELECT replace(trim(v), '::', '#') AS v, v AS raw FROM (VALUES {_IDS}) t(v)), p AS (SELECT raw, v, split_part(v, '#', 1) AS c, CASE WHEN contains(v, '#') THEN substr(v, instr(v, '#') + 1) ELSE '' END AS m FROM i)
SELECT w.raw AS wanted, f.raw AS found, w.v = f.v OR (f.m = '' AND w.m <> '' AND (f.v = w.c || '.' || w.m OR f.c = w.c || w.m)) OR (w.m = '' AND f.m <> '' AND w.c = f.c || f.m) OR (f.c = w.c AND (w.m = '' OR w.m = f.m)) AS same FROM p w, p f""")
def q_test_ids(spark, sf_dir):
    wanted, found = inline(spark, _IDS, "wanted"), inline(spark, _IDS, "found")
    return wanted.crossJoin(found).withColumn("same", gate.same_test(F.col("wanted"), F.col("found")))  # eight constant rows


_SUMMARIES = "(1, 0, 0, 'T#a,T#b', 'T#a'), (2, 1, 0, 'T#a', 'T#a'), (3, 0, 0, 'T#a', 'U#z'), (4, 0, 0, '', ''), (5, 0, 2, 'T#a', '')"
_SUMMARIES_OVER = mixed(_SUMMARIES, "id, failing, error, passing, required", """SELECT cast(doc_id + 100 as int), cast(doc_id % 3 as int), cast(doc_id % 2 as int), concat('T#', doc_id % 5, ',U#', doc_id % 7), CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('T#', doc_id % 4) END FROM documents""")


@query(f"SELECT id, failing = 0 AND error = 0 AND len(list_filter(list_filter(string_split(required, ','), lambda r: r <> ''), lambda r: NOT list_contains(string_split(passing, ','), r))) = 0 AS ok FROM ({_SUMMARIES_OVER}) t(id, failing, error, passing, required)")
def q_tests_pass(spark, sf_dir):
    rows = over(spark, sf_dir, _SUMMARIES_OVER)
    return rows.select("id", gate.tests_pass(F.col("failing"), F.col("error"), T.listed("passing"), T.listed("required")).alias("ok"))


_PATHS = "('file:///w/src/A.java', 'src/A.java'), ('C:' || chr(92) || 'w' || chr(92) || 'A.java', 'A.java'), ('src/B.java', 'src/A.java'), ('', 'A.java'), ('/A.java', 'A.java'), ('secrets/x.key', 'Photos/a.png'), ('.env', 'docs/handbook.md')"
_PATHS_OVER = mixed(_PATHS, "a, b", """SELECT concat('file:///w/', source, '/D', doc_id, '.java'), concat('src/D', doc_id - doc_id % 3, '.java') FROM documents""")


@query(f"""WITH p AS (SELECT *, replace(replace(a, 'file://', ''), chr(92), '/') AS x, replace(b, chr(92), '/') AS y FROM ({_PATHS_OVER}) t(a, b))
SELECT a, b, a <> '' AND b <> '' AND string_split(x, '/')[-1] = string_split(y, '/')[-1] AS same, regexp_matches(a, '(?i)(^|/)(\\.env$|secrets/|.*\\.token$|.*\\.key$|.*\\.pptx?$|handbook|problem-statement|photos/)') AS forbidden, CASE WHEN starts_with(x, '/w/') THEN substr(x, 4) ELSE x END AS relative FROM p""")
def q_paths(spark, sf_dir):
    rows = over(spark, sf_dir, _PATHS_OVER)
    plain = F.replace(F.replace(F.col("a"), F.lit("file://"), F.lit("")), F.lit("\\"), F.lit("/"))
    return rows.select("a", "b", gate.same_file(F.col("a"), F.col("b")).alias("same"), T.forbidden_path("a").alias("forbidden"), T.relative_path(plain, F.lit("/w")).alias("relative"))


_GATE = """(1, true, 'T#a', 'T#a,U#z', 'U#z', 'T#a,V#x', true, true, 'return 1;', 'return 2;'), (2, true, 'T#a', 'U#z', '', 'T#a', true, true, 'return 1;', 'return 2;'), (3, true, 'T#a', 'T#a', 'W#n', 'T#a', true, true, 'x();', 'y();'),
(4, true, 'T#a', 'T#a', '', '', true, true, 'x();', 'y();'), (5, false, 'T#a', 'T#a', '', 'T#a', true, true, 'x();', 'y();'), (6, true, '', 'U#z', '', 'U#z', true, false, 'x();', 'y();'), (7, true, 'T#a', 'T#a', '', 'T#a', true, true, 'return 1;', 'a();')"""
_LIST = "list_filter(string_split({0}, ','), lambda s: s <> '')"
_FLAG_SQL = "compiles, regression_pass, pov_flipped, semgrep_clean, codeql_clean, not_deleted"


#: Code around a whole text, which stands in a comment and in a string. So many calls and guarded returns come after it.
_QUOTED = "replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n'))"
_WRAPPED = f"concat('class D {{{{ int m() {{{{ /* ', replace(text, '*/', '* /'), chr(10), ' */ String s = ', chr(34), {_QUOTED}, chr(34), ';', chr(10), repeat('a();', {{0}}), repeat('if (b) {{{{ return 1; }}}}', {{1}}), ' return 0; }}}}', {{2}})"
_GATE_SQL = f"""SELECT id, compiles, pov, before, after, passing, sg, cq, concat('class A {{ int f() {{ ', x, ' }} }}') AS x, concat('class A {{ int f() {{ ', y, ' }} }}') AS y FROM (VALUES {_GATE}) t(id, compiles, pov, before, after, passing, sg, cq, x, y) UNION ALL
SELECT doc_id + 1000, doc_id % 11 <> 0, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('T', doc_id, '#a,U#', doc_id % 3) END, CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('T', doc_id, '#a,U#', doc_id % 3, ',W#n') END, CASE WHEN doc_id % 5 = 0 THEN 'V#x' WHEN doc_id % 5 = 1 THEN 'W#n' ELSE '' END, concat('T', doc_id, '#a,U#', doc_id % 3), doc_id % 7 <> 1, doc_id % 8 <> 2,
{_WRAPPED.format("cast(doc_id % 7 as int)", "cast(doc_id % 3 as int)", "CASE WHEN doc_id % 17 = 0 THEN '' ELSE ' }' END")}, {_WRAPPED.format("cast(doc_id % 5 as int)", "cast(doc_id % 2 as int)", "CASE WHEN doc_id % 13 = 0 THEN ' ) }' ELSE ' }' END")} FROM documents"""


@query(f"""WITH c AS ({_GATE_SQL}), n AS (SELECT *, id - 1000 AS d, {_STMT.format("x")} AS xs, {_STMT.format("y")} AS ys FROM c),
g AS (SELECT id, compiles, {_LIST.format("pov")} AS pov, {_LIST.format("before")} AS fb, {_LIST.format("after")} AS fa, {_LIST.format("passing")} AS pa, sg, cq, CASE WHEN id < 1000 THEN contains(y, 'return') >= contains(x, 'return') WHEN d % 13 = 0 THEN false
WHEN d % 17 = 0 THEN len(ys)::DOUBLE / len(xs) >= 0.6 AND {_EXITS.format("ys")} >= {_EXITS.format("xs")} ELSE (2 + d % 5 + 2 * (d % 2))::DOUBLE / (2 + d % 7 + 2 * (d % 3)) >= 0.6 AND d % 2 >= d % 3 END AS kept FROM n),
h AS (SELECT *, CASE WHEN len(pov) > 0 THEN list_has_all(fb, pov) ELSE len(fb) > 0 END AS base, CASE WHEN len(pov) > 0 THEN list_has_all(pa, pov) ELSE len(fa) = 0 END AS fixed, len(list_filter(fa, lambda f: NOT list_contains(pov, f) AND NOT list_contains(fb, f))) = 0 AS quiet FROM g),
f AS (SELECT id, base AS baseline_failed, base AND compiles AS compiles, base AND compiles AND quiet AS regression_pass, base AND compiles AND fixed AS pov_flipped, base AND sg AS semgrep_clean, base AND cq AS codeql_clean, base AND kept AS not_deleted FROM h)
SELECT id, baseline_failed, {_FLAG_SQL}, compiles AND regression_pass AND pov_flipped AND semgrep_clean AND codeql_clean AND not_deleted AS cleared, compiles::INT + regression_pass::INT + pov_flipped::INT + semgrep_clean::INT + codeql_clean::INT + not_deleted::INT AS passed FROM f""")
def q_gate(spark, sf_dir):
    rows = over(spark, sf_dir, _GATE_SQL)
    failures = lambda c: F.transform(T.listed(c), lambda t: F.struct(F.substring_index(t, "#", 1).alias("test_class"), F.substring_index(t, "#", -1).alias("test_method")))
    ready = rows.select("id", "compiles", T.listed("pov").alias("pov_tests"), failures("before").alias("failures_before"), failures("after").alias("failures_after"), T.listed("passing").alias("passing_after"), F.col("sg").alias("semgrep_clean"), F.col("cq").alias("codeql_clean"), F.col("x").alias("code_before"), F.col("y").alias("code_after"))
    out = gate.run_gate(ready)
    return out.select("id", "baseline_failed", *metrics.FLAGS, "cleared", F.size(F.filter("layers", lambda x: x["passed"])).alias("passed"))


@query(f"""WITH c AS (SELECT doc_id AS d FROM documents) SELECT d AS id, CASE WHEN d % 17 <> 0 THEN (2 + d % 7 + 2 * (d % 3))::INT END AS statements, CASE WHEN d % 17 <> 0 THEN (1 + d % 3)::INT END AS exits, CASE WHEN d % 17 <> 0 THEN (d % 3)::INT END AS ifs, CASE WHEN d % 17 <> 0 THEN (d % 7)::INT END AS calls FROM c
UNION ALL SELECT -doc_id - 1, NULL, NULL, NULL, NULL FROM documents WHERE regexp_matches(text, '[A-Za-z0-9]')""")
def q_java_statements(spark, sf_dir):
    """Statements of code that holds each whole text in a comment and a string; the text itself isn't Java."""
    docs = table(spark, sf_dir, "documents")
    codes = docs.select(F.col("doc_id").alias("id"), F.expr(_WRAPPED.format("cast(doc_id % 7 as int)", "cast(doc_id % 3 as int)", "CASE WHEN doc_id % 17 = 0 THEN '' ELSE ' }' END")).alias("code"))
    plain = docs.where(F.col("text").rlike("[A-Za-z0-9]")).select((-F.col("doc_id") - 1).alias("id"), F.col("text").alias("code"))
    n = lambda kind: F.size(F.filter("s", lambda f: f["kind"] == kind))
    rows = codes.union(plain).select("id", java_statements("code").alias("s")).withColumn("c", counts_of("s"))
    return rows.select("id", "c.statements", "c.exits", F.when(F.col("s").isNotNull(), n("if")).alias("ifs"), F.when(F.col("s").isNotNull(), n("expression")).alias("calls"))


_FOUND = "('r1', 'src/A.java', 'semgrep', 'b1'), ('r1', 'src/B.java', 'semgrep', 'b1'), ('r2', 'file:///w/A.java', 'codeql', 'b2'), ('r3', '', 'semgrep', 'b2')"
_FOUND_OVER = mixed(_FOUND, "rule, path, tool, bug", """SELECT concat('r', doc_id % 9), CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat('file:///w/', source, '/D', doc_id % 3, '.java') END, CASE WHEN doc_id % 2 = 0 THEN 'semgrep' ELSE 'codeql' END, concat('d', doc_id % 400) FROM documents""")
_TARGETS = "('b1', 'A.java', false, false), ('b2', 'A.java', false, false), ('b3', 'A.java', true, true)"
_TARGETS_OVER = mixed(_TARGETS, "bug, patched_file, semgrep_error, codeql_error", """SELECT concat('d', doc_id), concat('src/D', doc_id % 4, '.java'), doc_id % 11 = 0, doc_id % 13 = 0 FROM documents""")


@query(f"""WITH f AS (SELECT * FROM ({_FOUND_OVER}) t(rule, path, tool, bug)), p AS (SELECT * FROM ({_TARGETS_OVER}) t(bug, patched_file, semgrep_error, codeql_error)),
n AS (SELECT f.bug, count(*) FILTER (tool = 'semgrep') AS a, count(*) FILTER (tool = 'codeql') AS b FROM f JOIN p ON f.bug = p.bug AND path <> '' AND string_split(path, '/')[-1] = string_split(patched_file, '/')[-1] GROUP BY 1)
SELECT p.bug, NOT semgrep_error AND coalesce(a, 0) = 0 AS semgrep_clean, codeql_error OR coalesce(b, 0) = 0 AS codeql_clean FROM p LEFT JOIN n ON p.bug = n.bug""")
def q_file_scope(spark, sf_dir):
    patches = over(spark, sf_dir, _TARGETS_OVER)
    found = gate.on_file(over(spark, sf_dir, _FOUND_OVER), patches, "bug")
    return gate.sast_gate(patches, found, "bug").select("bug", "semgrep_clean", "codeql_clean")


_FOCUS = {"cwes": [{"id": "cwe-89", "semgrep": {"rule_ids": ["sqli", "sqli2"]}, "codeql": ["java/sqli"]}, {"id": "CWE-79", "semgrep": {}}, {"name": "no id"}]}


@query("SELECT * FROM (VALUES ('CWE-89', 'semgrep', 'sqli'), ('CWE-89', 'semgrep', 'sqli2'), ('CWE-89', 'codeql', 'java/sqli'), ('CWE-79', NULL, NULL)) t(cwe, tool, rule)")
def q_focus_rules(spark, sf_dir):
    return M.focus_rules(spark, _FOCUS)


_COVERED = "('CWE-89'), ('cwe-79')"
_META_DOC = """('{"B-1": {"cwe_id": "CWE_89", "project_name": "p", "human_patch_file": "F.java", "failing_tests": ["T#a", "T#b"], "revision": "abc"}, "B-2": {"cwe": "79", "project": "q", "vulnerable_file": "G.java", "tests": "x, y"}, "B-9": {"cwe": ""}}')"""
_META_DOC_OVER = mixed(_META_DOC, "value", """SELECT concat('{"D-', doc_id, '": {"cwe": "', doc_id % 90, '", "project": "', source, '", "vulnerable_file": "D.java", "tests": "T#', doc_id, ', U"}}') FROM documents WHERE doc_id % 2 = 0""")
_IDS_DOC = "('B-1', 1), ('B-3', 2), ('B-2', 3), ('B-1', 4)"
_IDS_DOC_OVER = mixed(_IDS_DOC, "id, ord", """SELECT concat('D-', doc_id), cast(doc_id + 100 as int) FROM documents""")
_SHAPES = """('[{"vul_id": "V-1", "cwe": "22", "repo": "r", "file": "H.java", "tests": "t"}, 5]'), ('{"id": "V-2", "cwe_id": "CWE-89", "is_trans": true}'), ('{"V-3": {"project": "s", "pov_tests": ["k"]}, "V-4": {"name": "V-4b"}, "x": 1}'), ('{broken')"""
_SHAPES_OVER = mixed(_SHAPES, "value", """SELECT CASE doc_id % 3 WHEN 0 THEN concat('[{"vul_id": "E-', doc_id, '", "cwe": "79", "repo": "', source, '", "file": "E.java", "tests": "t"}, 5]') WHEN 1 THEN concat('{"id": "E-', doc_id, '", "cwe_id": "CWE-', doc_id % 100, '", "is_trans": true}') ELSE concat('{"E-', doc_id, '": {"project": "', lang, '", "pov_tests": ["k"]}}') END FROM documents""")
_CWE_SQL = "CASE WHEN c = '' THEN '' WHEN starts_with(c, 'CWE-') THEN c WHEN starts_with(c, 'CWE') THEN 'CWE-' || regexp_replace(substr(c, 4), '^[-_]+', '') WHEN regexp_matches(c, '^[0-9]+$') THEN 'CWE-' || c ELSE c END"
_TESTS_SQL = "CASE WHEN json_type(v->'failing_tests') = 'ARRAY' THEN (v->>'failing_tests')::JSON::VARCHAR[] WHEN json_type(v->'pov_tests') = 'ARRAY' THEN (v->>'pov_tests')::JSON::VARCHAR[] WHEN v->>'tests' IS NOT NULL THEN list_transform(string_split(v->>'tests', ','), lambda x: trim(x)) ELSE []::VARCHAR[] END"
_FIRST_SQL = f"""m AS (SELECT key AS id, value AS v FROM ({_META_DOC_OVER}) t(j), json_each(j::JSON)), i AS (SELECT * FROM ({_IDS_DOC_OVER}) t(id, ord)),
a0 AS (SELECT i.id, ord, coalesce(v->>'project', v->>'project_name', '') AS project, upper(coalesce(v->>'cwe_id', v->>'cwe', '')) AS c, coalesce(v->>'vulnerable_file', v->>'human_patch_file', '') AS vulnerable_file, coalesce(v->>'revision', '') AS human_patch_ref, {_TESTS_SQL} AS pov_tests FROM i LEFT JOIN m ON i.id = m.id),
a AS (SELECT 0 AS part, ord, id, project, {_CWE_SQL} AS cwe, 'vul4j' AS source, vulnerable_file, human_patch_ref, pov_tests, false AS transformed FROM a0)"""
_BENCH_SQL = f"""d AS (SELECT j::JSON AS j FROM ({_SHAPES_OVER}) t(j) WHERE json_valid(j)), o AS (SELECT value AS v FROM d, json_each(j) WHERE json_type(j) = 'ARRAY' UNION ALL SELECT j FROM d WHERE json_type(j) = 'OBJECT'),
named AS (SELECT coalesce(v->>'id', v->>'vul_id', v->>'bug_id', v->>'name') AS id, v FROM o WHERE json_type(v) = 'OBJECT'), inner_ AS (SELECT coalesce(e.value->>'id', e.value->>'vul_id', e.value->>'bug_id', e.value->>'name', e.key) AS id, e.value AS v FROM named, json_each(v) e WHERE named.id IS NULL AND json_type(e.value) = 'OBJECT'),
b0 AS (SELECT id, v, coalesce((v->>'transformed') = 'true', false) OR coalesce((v->>'is_trans') = 'true', false) AS transformed, upper(coalesce(v->>'cwe', v->>'cwe_id', '')) AS c FROM (SELECT * FROM named WHERE id IS NOT NULL UNION ALL SELECT * FROM inner_)),
b AS (SELECT 1 AS part, 0 AS ord, id || CASE WHEN transformed THEN '-trans' ELSE '' END AS id, coalesce(v->>'project', v->>'repo', '') AS project, {_CWE_SQL} AS cwe, 'vjbench' AS source, coalesce(v->>'vulnerable_file', v->>'file', '') AS vulnerable_file, '' AS human_patch_ref, {_TESTS_SQL} AS pov_tests, transformed FROM b0)"""
_ENTRY = "id, project, cwe, source, vulnerable_file, human_patch_ref, pov_tests, upper(cwe) IN ('CWE-89', 'CWE-79') AS semgrep_covered, transformed"


def _first_entries(spark, sf_dir):
    return M.reproducible_entries(over(spark, sf_dir, _IDS_DOC_OVER), M.by_id(over(spark, sf_dir, _META_DOC_OVER)))


def _bench_entries(spark, sf_dir, include):
    return M.benchmark_entries(M.benchmark_records(over(spark, sf_dir, _SHAPES_OVER)).drop("at"), include)


@query(f"WITH {_BENCH_SQL} SELECT {_ENTRY} FROM b WHERE NOT transformed")
def q_benchmark_entries(spark, sf_dir):
    return M.with_coverage(_bench_entries(spark, sf_dir, False), inline(spark, _COVERED, "cwe")).select(*M.MANIFEST)


@query(f"WITH {_FIRST_SQL}, {_BENCH_SQL}, e AS (SELECT * FROM a UNION ALL SELECT * FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, ord) AS k FROM e) SELECT {_ENTRY} FROM r WHERE k = 1")
def q_evaluation_set(spark, sf_dir):
    return M.evaluation_set(_first_entries(spark, sf_dir), _bench_entries(spark, sf_dir, True), inline(spark, _COVERED, "cwe"))[0]


@query(f"WITH {_FIRST_SQL}, {_BENCH_SQL}, e AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT count(*) AS total, count(*) FILTER (source = 'vul4j') AS vul4j, count(*) FILTER (source = 'vjbench') AS vjbench, count(*) FILTER (transformed) AS transformed, count(*) FILTER (upper(cwe) IN ('CWE-89', 'CWE-79')) AS covered FROM e")
def q_evaluation_summary(spark, sf_dir):
    return M.evaluation_set(_first_entries(spark, sf_dir), _bench_entries(spark, sf_dir, True), inline(spark, _COVERED, "cwe"))[1]


_KEYS = "(1, 'Bug ID: V-1' || chr(10) || 'no colon' || chr(10) || 'cwe: 89' || chr(10) || 'CWE: 79: x'), (2, '')"
_KEYS_OVER = mixed(_KEYS, "id, t", """SELECT cast(doc_id + 100 as int), concat('Doc ID: ', doc_id, chr(10), replace(text, ':', ';'), chr(10), 'lang: ', lang, chr(10), ' Lang : ', source) FROM documents""")


@query(f"""WITH l AS (SELECT id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM ({_KEYS_OVER}) x(id, t)), k AS (SELECT id, replace(lower(trim(split_part(line, ':', 1))), ' ', '_') AS key, trim(substr(line, instr(line, ':') + 1)) AS value, pos FROM l WHERE contains(line, ':'))
SELECT id, key, arg_max(value, pos) AS value FROM k GROUP BY 1, 2""")
def q_key_values(spark, sf_dir):
    return over(spark, sf_dir, _KEYS_OVER).select("id", F.explode(M.key_values("t")).alias("key", "value"))


_EVALS = """('B-1', '{"B-1": {"compiled": true, "n": 1}}'), ('B-1', '{"results": {"B-1": {"compile_success": false}}}'), ('B-1', '{"results": [{"vul_id": "B-0"}, {"id": "B-1", "metrics": {"compile": true}}]}'), ('B-1', '{"vul_id": "B-1", "build_success": true}'), ('B-1', '{"id": "B-2"}')"""
_EVALS_OVER = mixed(_EVALS, "bug, doc", """SELECT concat('D-', doc_id), CASE doc_id % 4 WHEN 0 THEN concat('{"D-', doc_id, '": {"compiled": ', CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END, '}}') WHEN 1 THEN concat('{"results": {"D-', doc_id, '": {"compile_success": true}}}') WHEN 2 THEN concat('{"results": [{"vul_id": "D-0"}, {"id": "D-', doc_id, '", "metrics": {"compile": true}}]}') ELSE concat('{"id": "', source, doc_id, '"}') END FROM documents WHERE doc_id > 0""")


@query(f"""WITH d AS (SELECT bug, j::JSON AS j, j AS raw FROM ({_EVALS_OVER}) t(bug, j)), l AS (SELECT raw, bug, value AS v FROM d, json_each(j->'results') WHERE json_type(j->'results') = 'ARRAY'),
e AS (SELECT d.raw, coalesce(d.j->d.bug, d.j->'results'->d.bug, l.v, CASE WHEN d.j->>'id' = d.bug OR d.j->>'vul_id' = d.bug THEN d.j END) AS e FROM d LEFT JOIN l ON l.raw = d.raw AND (l.v->>'id' = d.bug OR l.v->>'vul_id' = d.bug))
SELECT raw AS doc, e IS NOT NULL AS found, coalesce(coalesce(e->>'compile_success', e->>'compiled', e->>'build_success', e->'metrics'->>'compile') = 'true', false) AS compiled FROM e""")
def q_evaluate_entry(spark, sf_dir):
    rows = over(spark, sf_dir, _EVALS_OVER).withColumn("entry", M.evaluate_entry("doc", "bug"))
    return rows.select("doc", F.col("entry").isNotNull().alias("found"), M.entry_compiled(F.col("entry")).alias("compiled"))


_RESULT_DOC = """('{"rows": [{"bug": {"id": "VUL4J-1", "cwe": "CWE-89"}, "verdict": {"compiles": true, "regression_pass": true, "pov_flipped": true, "semgrep_clean": true, "codeql_clean": true, "not_deleted": true}, "tag": "baseline"}, {"bug": {"id": "VJBench-2", "source": "x"}, "verdict": {"compiles": true}, "cleared": true}, {"bug": {"id": "B-trans", "source": "vjbench", "cwe": " cwe-22 "}, "verdict": {}, "cleared": false, "tag": "baseline"}, {}]}')"""
_RESULT_DOC_OVER = mixed(_RESULT_DOC, "value", """SELECT concat('{"rows": [{"bug": {"id": "', CASE WHEN doc_id % 3 = 0 THEN 'VJBench-' ELSE 'VUL4J-' END, doc_id, CASE WHEN doc_id % 9 = 0 THEN '-trans' ELSE '' END, '", "cwe": "CWE-', doc_id % 100, '"}, "verdict": {"compiles": ', CASE WHEN doc_id % 5 = 0 THEN 'false' ELSE 'true' END, ', "not_deleted": true, "pov_flipped": ', CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END, '}, "cleared": ', CASE WHEN doc_id % 4 = 0 THEN 'true' ELSE 'false' END, ', "tag": "', lang, '"}]}') FROM documents""")
_ROWS_SQL = f"""r AS (SELECT value AS v FROM ({_RESULT_DOC_OVER}) t(j), json_each(j::JSON->'rows')), x AS (SELECT coalesce(v->'bug'->>'id', '') AS id, coalesce(v->'bug'->>'cwe', '') AS cwe, coalesce(v->'bug'->>'source', 'vul4j') AS source, coalesce(v->>'tag', 'finetuned') AS tag,
coalesce((v->>'cleared')::BOOLEAN, coalesce((v->'verdict'->>'not_deleted')::BOOLEAN, false) AND coalesce((v->'verdict'->>'pov_flipped')::BOOLEAN, false)) AS cleared, coalesce((v->'verdict'->>'compiles')::BOOLEAN, false) AS compiles FROM r)"""


@query(f"WITH {_ROWS_SQL} SELECT * FROM x")
def q_result_rows(spark, sf_dir):
    return evaluation.result_rows(over(spark, sf_dir, _RESULT_DOC_OVER)).select("id", "cwe", "source", "tag", "cleared", "compiles")


_STRATA_SQL = f"""{_ROWS_SQL}, y AS (SELECT cleared, unnest(['overall', CASE WHEN contains(lower(id), 'trans') THEN 'vjbench-trans' WHEN lower(source) = 'vjbench' OR starts_with(lower(id), 'vjbench') THEN 'vjbench' ELSE 'vul4j' END,
CASE WHEN upper(trim(cwe)) IN ('CWE-89', 'CWE-78', 'CWE-79', 'CWE-22', 'CWE-327', 'CWE-328', 'CWE-611', 'CWE-502', 'CWE-90', 'CWE-91', 'CWE-113', 'CWE-326', 'CWE-295') THEN 'semgrep-covered' ELSE 'semgrep-uncovered' END]) AS stratum FROM x),
z AS (SELECT s.stratum, count(y.stratum) AS n, count(*) FILTER (y.cleared) AS cleared FROM (SELECT unnest(['overall', 'vul4j', 'vjbench', 'vjbench-trans', 'semgrep-covered', 'semgrep-uncovered']) AS stratum) s LEFT JOIN y ON s.stratum = y.stratum GROUP BY 1), w AS (SELECT stratum, n, cleared, {wilson_sql("cleared", "n")} FROM z)"""


def _summary(spark, sf_dir):
    return evaluation.summarize(evaluation.result_rows(over(spark, sf_dir, _RESULT_DOC_OVER)))


@query(f"WITH {_STRATA_SQL} SELECT * FROM w")
def q_canonical_strata(spark, sf_dir):
    return _summary(spark, sf_dir)[0]


@query(f"WITH {_STRATA_SQL} SELECT stratum, printf('%-18s %4d %8d %6.1f%%  [%.1f%%, %.1f%%]', stratum, n, cleared, rate * 100, ci_low * 100, ci_high * 100) AS line FROM w")
def q_rate_lines(spark, sf_dir):
    return evaluation.rate_lines(_summary(spark, sf_dir)[0])


@query(f"WITH {_STRATA_SQL} SELECT stratum, round(rate, 3) AS rate, round(ci_low, 3) AS ci_low, round(ci_high, 3) AS ci_high, cleared, n FROM w")
def q_rounded_strata(spark, sf_dir):
    return evaluation.rounded(_summary(spark, sf_dir)[0])


@query(f"WITH {_ROWS_SQL}, t AS (SELECT tag, count(*) AS n, count(*) FILTER (cleared) AS cleared FROM x GROUP BY 1), u AS (SELECT tag, n, cleared, {wilson_sql('cleared', 'n')} FROM t) SELECT u.*, CASE WHEN tag <> 'baseline' THEN round(rate - (SELECT rate FROM u WHERE tag = 'baseline'), 4) END AS delta FROM u")
def q_tag_rates(spark, sf_dir):
    return _summary(spark, sf_dir)[1]


_MANIFEST = "('B-1', 'p', 'CWE-89', 'vul4j'), ('B-2', 'q', '', 'vul4j'), ('B-3', 'r', 'CWE-1', 'vjbench')"
_MANIFEST_OVER = mixed(_MANIFEST, "id, project, cwe, source", """SELECT concat('D-', doc_id), source, concat('CWE-', doc_id % 9), 'vul4j' FROM documents""")
_TRIES = "('B-1', 0, 0, 0.1, true, false), ('B-1', 0, 1, 0.9, true, true), ('B-1', 1, 0, 0.5, true, true), ('B-2', 0, 0, 0.7, false, true), ('B-2', 1, 0, 0.7, true, false), ('B-2', 1, 1, 0.7, true, true)"
_TRIES_OVER = mixed(_TRIES, "bug, attempt, position, score, compiles, not_deleted", """SELECT concat('D-', doc_id), 0, 0, cast(doc_id % 7 as double), doc_id % 3 = 0, doc_id % 2 = 0 FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT concat('D-', doc_id), 0, 1, cast(doc_id % 4 as double), doc_id % 4 <> 0, true FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT concat('D-', doc_id), 1, 0, cast(doc_id % 3 as double), true, doc_id % 7 = 0 FROM documents WHERE doc_id % 3 = 0""")


def _tries(spark, sf_dir):
    rows = over(spark, sf_dir, _TRIES_OVER).withColumn("score", F.col("score").cast("double"))
    return rows.withColumns({f: F.lit(True) for f in metrics.FLAGS if f not in ("compiles", "not_deleted")})


def _run_sql(order: str) -> str:
    return f"""WITH m AS (SELECT * FROM ({_MANIFEST_OVER}) t(id, project, cwe, source)), c AS (SELECT *, row_number() OVER (PARTITION BY bug, attempt ORDER BY {order}) AS k FROM ({_TRIES_OVER}) t(bug, attempt, position, score, compiles, not_deleted)),
g AS (SELECT *, compiles AND not_deleted AS cleared FROM c WHERE k = 1), d AS (SELECT *, row_number() OVER (PARTITION BY bug ORDER BY cleared DESC, CASE WHEN cleared THEN attempt ELSE -attempt END) AS r FROM g)"""


@query(_run_sql("score DESC, position") + " SELECT m.id, cwe, attempt, position, cleared, 'tag' AS tag FROM m JOIN d ON m.id = d.bug WHERE r = 1")
def q_run_judged(spark, sf_dir):
    rows, _ = evaluation.run(over(spark, sf_dir, _MANIFEST_OVER), _tries(spark, sf_dir), "tag", score="score")
    return rows.select("id", "cwe", "attempt", "position", "cleared", "tag")


@query(_run_sql("position") + " SELECT m.id, attempt, position, cleared FROM m JOIN d ON m.id = d.bug WHERE r = 1")
def q_run_first(spark, sf_dir):
    rows, _ = evaluation.run(over(spark, sf_dir, _MANIFEST_OVER), _tries(spark, sf_dir), "tag")
    return rows.select("id", "attempt", "position", "cleared")


@query(_run_sql("position") + " SELECT id AS bug_id, 'checkout' AS stage FROM m WHERE id NOT IN (SELECT bug FROM d)")
def q_run_errors(spark, sf_dir):
    return evaluation.run(over(spark, sf_dir, _MANIFEST_OVER), _tries(spark, sf_dir), "tag")[1].select("bug_id", "stage")


@query(f"WITH m AS (SELECT id IN (SELECT bug FROM ({_TRIES_OVER})) AS tried FROM ({_MANIFEST_OVER})) SELECT 'tag' AS model_tag, count(*) FILTER (tried) AS n, count(*) FILTER (NOT tried) AS errors, 'manifest' AS manifest FROM m")
def q_report(spark, sf_dir):
    rows, errors = evaluation.run(over(spark, sf_dir, _MANIFEST_OVER), _tries(spark, sf_dir), "tag")
    doc = evaluation.report(rows, errors, "manifest", "tag")
    return doc.select(F.get_json_object("json", "$.model_tag").alias("model_tag"), F.get_json_object("json", "$.n").cast("long").alias("n"), F.get_json_object("json", "$.errors").cast("long").alias("errors"), F.get_json_object("json", "$.manifest").alias("manifest"))


_SAMPLES = "('A.java', 'CWE-89', 'return a;' || chr(10) || 'x();', 'return b;' || chr(10) || 'y();', 2, 0), ('B.java', '', 'return a;', 'z();', 1, 0), ('C.java', '', 'a();', 'a();', 0, 0), ('D.java', '', 'a();', 'a();', 1, -1), ('E.java', '', 'a();', NULL, 1, NULL)"
_SAMPLES_OVER = mixed(_SAMPLES, "file, cwe, original, patched, before, after", """SELECT concat('D', doc_id, '.java'), concat('CWE-', doc_id % 9), text, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE substring(text, 1, cast(floor(length(text) * (5 + doc_id % 6) / 10.0) as int)) END, cast(doc_id % 3 as int), cast(doc_id % 2 as int) FROM documents""")
_QUICK_SQL = f"""q AS (SELECT *, before > 0 AS red, patched IS NOT NULL AND coalesce(after = 0, false) AS green, {_STMT.format("original")} AS x, {_STMT.format("coalesce(patched, '')")} AS y FROM ({_SAMPLES_OVER}) t(file, cwe, original, patched, before, after)),
k AS (SELECT *, len(y)::DOUBLE / len(x) AS ratio, patched IS NOT NULL AND len(y)::DOUBLE / len(x) >= 0.6 AND {_EXITS.format("y")} >= {_EXITS.format("x")} AS not_deleted FROM q)"""


@query(f"WITH {_QUICK_SQL} SELECT file, cwe, red, green, not_deleted, red AND green AND not_deleted AS cleared, before, after, CASE WHEN patched IS NOT NULL THEN round(ratio, 3) END AS retained_ratio FROM k")
def q_quick_rows(spark, sf_dir):
    return evaluation.quick_rows(over(spark, sf_dir, _SAMPLES_OVER))


@query(f"WITH {_QUICK_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (red AND green AND not_deleted) AS cleared FROM k) SELECT 'base' AS model_tag, n, cleared, {wilson_sql('cleared', 'n')} FROM c")
def q_quick_summary(spark, sf_dir):
    return evaluation.quick_summary(evaluation.quick_rows(over(spark, sf_dir, _SAMPLES_OVER)), "base")


_AXE = """('p1', '{"source": "a.html", "violationCount": 3, "ruleCount": 2, "byRule": {"image-alt": 2, "label": 1}, "violations": [{"id": "image-alt", "nodes": [{"html": "x"}, {"html": "y"}]}, {"id": "label", "nodes": [{"html": "z"}]}]}'), ('p2', '{}')"""
_AXE_OVER = mixed(_AXE, "page, j", """SELECT concat('q', page_id), concat('{"source": "', page_id, '.html", "violationCount": ', page_id % 9, ', "ruleCount": ', page_id % 3, ', "byRule": {"image-alt": ', page_id % 5, ', "list": 2}, "violations": [{"id": "image-alt", "nodes": [{"html": "x"}]}, {"id": "r', page_id % 4, '", "nodes": [{"html": "y"}, {"html": "z"}]}]}') FROM pages""")


@query(f"WITH a AS (SELECT p, j::JSON AS j FROM ({_AXE_OVER}) t(p, j)), k AS (SELECT p, string_agg(e.key || ' (x' || (e.value->>'$') || ')', ', ' ORDER BY e.key) AS s FROM a, json_each(j->'byRule') e GROUP BY 1) SELECT a.p AS page, coalesce(j->>'source', '') AS source, coalesce((j->>'violationCount')::INT, 0) AS violation_count, coalesce((j->>'ruleCount')::INT, 0) AS rule_count, coalesce(s, 'none reported') AS summary FROM a LEFT JOIN k ON a.p = k.p")
def q_axe_scans(spark, sf_dir):
    scans = evaluation.axe_scans(over(spark, sf_dir, _AXE_OVER), "j", ["page"])
    return scans.select("page", "source", "violation_count", "rule_count", gate.rule_summary(F.col("by_rule")).alias("summary"))


@query(f"SELECT p AS page, v.value->>'id' AS rule, json_array_length(v.value->'nodes')::BIGINT AS nodes FROM ({_AXE_OVER}) t(p, j), json_each(j::JSON->'violations') v")
def q_rule_counts(spark, sf_dir):
    return evaluation.rule_counts(evaluation.axe_scans(over(spark, sf_dir, _AXE_OVER), "j", ["page"]), "page")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN false ELSE page_id % 2 = 0 END AS flipped FROM pages")
def q_flips(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id")
    both = pages.select("page_id", F.lit("before").alias("phase"), (F.col("page_id") % 2 == 0).alias("failed")).union(pages.select("page_id", F.lit("after"), F.col("page_id") % 3 == 0))
    return evaluation.flips(both, "page_id", "phase", "failed")


@query("SELECT conv_id, turn, role AS layer, length(text) % 2 = 0 AS passed, left(text, 140) AS detail FROM conversations")
def q_layer_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    layers = F.array(F.struct(F.col("role").alias("name"), (F.length("text") % 2 == 0).alias("passed"), F.col("text").alias("detail")))
    return evaluation.layer_rows(rows.select(F.struct("conv_id", "turn").alias("of"), layers.alias("layers")), "of").select("of.conv_id", "of.turn", "layer", "passed", "detail")


_FLAGS_OVER = mixed("(1, true, true, false, true, true, true), (2, true, false, true, false, true, false)", "id, compiles, regression_pass, pov_flipped, not_deleted, semgrep_clean, codeql_clean", "SELECT cast(doc_id + 100 as int), doc_id % 2 = 0, doc_id % 3 = 0, doc_id % 5 = 0, doc_id % 7 <> 0, doc_id % 4 = 0, doc_id % 8 < 4 FROM documents")


@query(f"SELECT id, compiles, regression_pass AS regression, pov_flipped AS pov, not_deleted, semgrep_clean AND codeql_clean AS scanners FROM ({_FLAGS_OVER})")
def q_badges(spark, sf_dir):
    return over(spark, sf_dir, _FLAGS_OVER).select("id", *evaluation.badges())


@query(f"""SELECT id, '{{"cleared":' || (compiles AND regression_pass AND pov_flipped AND not_deleted AND semgrep_clean AND codeql_clean) || ',"codeql_clean":' || codeql_clean || ',"compiles":' || compiles || ',"id":' || id || ',"not_deleted":' || not_deleted || ',"pov_flipped":' || pov_flipped || ',"regression_pass":' || regression_pass || ',"semgrep_clean":' || semgrep_clean || '}}' AS json FROM ({_FLAGS_OVER})""")
def q_verdict_json(spark, sf_dir):
    return evaluation.verdict_json(over(spark, sf_dir, _FLAGS_OVER).withColumn("cleared", metrics.cleared()), "id")


@query("SELECT a.page_id, coalesce(b.text, '') AS text FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE '' END AS path FROM pages) a LEFT JOIN (SELECT url, max(md5(html)) AS text FROM pages GROUP BY 1) b ON a.path = b.url")
def q_file_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    files = pages.groupBy(F.col("url").alias("path")).agg(F.max(F.md5("html")).alias("text"))
    rows = pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("").alias("path"))
    return evaluation.with_text(rows, files, "path").select("page_id", "text")


_RECORDS = """(1, 'int a; // x', 'int b;', 'CVE-2020-12345', '2021-01-01', 'p', 'f1'), (2, 'INT  a;', 'int b;', 'CVE-2', '2020-01-01', 'q', 'f2'), (3, 'w1 w2 w3 w4 w5 w6 w7 w8 w9 w10', 'v1 v2 v3', 'CVE-3', '', 'p', 'f1'), (4, 'w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11', 'v1 v2 v3', '', '2022-03-04', 'p', 'f3'),
(5, 'w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12', 'other words', '', '2022-03-05', 'p', 'f3'), (6, 'see CVE-2021-44444', 'ok', 'CVE-6', '2023-01-01', '', 'f4'), (7, 'lone', 'one', '', '', '', 'f5')"""
_RECORD_COLUMNS = "ord, vuln_code, fixed_code, cve, date, project, source_file"
#: The awkward records above and one of every document, in words that both engines read.
_RECORDS_SQL = f"""SELECT {_RECORD_COLUMNS} FROM (VALUES {_RECORDS}) t({_RECORD_COLUMNS}) UNION ALL
SELECT doc_id + 100, text, concat(text, ' guarded ', doc_id % 2), CASE WHEN doc_id % 2 = 0 THEN concat('CVE-2023-', doc_id) ELSE '' END, CASE WHEN doc_id % 10 = 0 THEN '' ELSE concat('202', doc_id % 4, '-0', 1 + doc_id % 9, '-1', doc_id % 10) END, source, lang FROM documents"""
_KEPT_SQL = f"""d AS ({_RECORDS_SQL}), n AS (SELECT *, {NORM.replace("text", "vuln_code")} AS a, {NORM.replace("text", "fixed_code")} AS b, row_number() OVER (ORDER BY CASE WHEN date = '' THEN '9999-99-99' ELSE date END, source_file, ord) AS o FROM d),
e AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY o) AS k FROM n), x AS (SELECT *, list_distinct(regexp_extract_all(a, '[a-z0-9_]+')) AS s, list_distinct(regexp_extract_all(b, '[a-z0-9_]+')) AS u FROM e WHERE k = 1),
like_v AS (SELECT p.o AS p, q.o AS q FROM x p JOIN x q ON p.project = q.project AND p.o < q.o WHERE len(p.s) BETWEEN 0.9 * len(q.s) AND len(q.s) / 0.9 AND (len(p.s) + len(q.s) = 0 OR len(list_intersect(p.s, q.s))::DOUBLE / len(list_distinct(list_concat(p.s, q.s))) >= 0.9)),
alike AS (SELECT p.o AS p, q.o AS q FROM like_v l JOIN x p ON p.o = l.p JOIN x q ON q.o = l.q WHERE len(p.u) + len(q.u) = 0 OR len(list_intersect(p.u, q.u))::DOUBLE / len(list_distinct(list_concat(p.u, q.u))) >= 0.9),
fold AS (SELECT list_reduce(list([q, p] ORDER BY q, p), lambda gone, y: CASE WHEN list_contains(gone, y[2]) THEN gone ELSE list_append(gone, y[1]) END, []::BIGINT[]) AS l FROM alike),
gone AS (SELECT ord, k FROM e JOIN (SELECT a AS ga, b AS gb FROM x, fold WHERE list_contains(l, o)) ON a = ga AND b = gb), kept AS (SELECT * FROM x WHERE ord NOT IN (SELECT ord FROM gone))"""


def _records(spark, sf_dir):
    return over(spark, sf_dir, _RECORDS_SQL)


@query(f"WITH {_KEPT_SQL} SELECT ord FROM kept")
def q_dedup_records(spark, sf_dir):
    return sft.dedup_records(_records(spark, sf_dir), 0.9)[0].select("ord")


@query(f"WITH {_KEPT_SQL} SELECT (SELECT count(*) FROM d) AS input, (SELECT count(*) FROM e WHERE k > 1 AND ord NOT IN (SELECT ord FROM gone)) AS exact_dups, (SELECT count(*) FROM gone) AS near_dups, (SELECT count(*) FROM kept) AS kept")
def q_dedup_counts(spark, sf_dir):
    return sft.dedup_records(_records(spark, sf_dir), 0.9)[1]


@query(f"WITH {_KEPT_SQL} SELECT fixed_code AS output, date, project, CASE WHEN date <> '' AND date >= '2022-03-05' THEN 'eval' ELSE 'train' END AS split, {redacted_sql('vuln_code')} AS input, sha1(a || chr(0) || b) AS dedup_key, '2022-03-05' AS cutoff FROM kept")
def q_sft_examples(spark, sf_dir):
    made, _ = sft.prepare(_records(spark, sf_dir), cutoff="2022-03-05")
    return made.select("output", "meta.date", "meta.project", "split", "input", "meta.dedup_key", "meta.cutoff")


_FAMILY = "coalesce(nullif(cve, ''), nullif(project, ''), '__rec_' || ord)"


@query(f"""WITH d AS (SELECT ord, {_FAMILY} AS f FROM ({_RECORDS_SQL})), s AS (SELECT f, count(*) AS n FROM d GROUP BY 1), o AS (SELECT f, coalesce(sum(n) OVER (ORDER BY md5('13:' || f), f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, floor((SELECT count(*) FROM d) * 0.4) AS t FROM s)
SELECT ord, CASE WHEN b < t THEN 'eval' ELSE 'train' END AS split FROM d JOIN o ON d.f = o.f""")
def q_family_fallback(spark, sf_dir):
    return sft.split_records(_records(spark, sf_dir), "cve", fraction=0.4).select("ord", "split")


@query(f"""WITH d AS (SELECT ord, date FROM ({_RECORDS_SQL})), r AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM d WHERE date <> ''), c AS (SELECT date AS c FROM r WHERE i = greatest(0, least(n - 1, floor(n * 0.8))))
SELECT ord, CASE WHEN date <> '' AND date >= c THEN 'eval' ELSE 'train' END AS split FROM d, c""")
def q_temporal_auto(spark, sf_dir):
    return sft.split_records(_records(spark, sf_dir), "temporal").select("ord", "split")


@query(f"""WITH d AS (SELECT ord, {_FAMILY} AS f FROM ({_RECORDS_SQL})), s AS (SELECT f, count(*) AS n FROM d GROUP BY 1), o AS (SELECT f, coalesce(sum(n) OVER (ORDER BY md5('13:' || f), f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, floor((SELECT count(*) FROM d) * 0.2) AS t FROM s)
SELECT ord, CASE WHEN b < t THEN 'eval' ELSE 'train' END AS split FROM d JOIN o ON d.f = o.f""")
def q_undated_split(spark, sf_dir):
    return sft.split_records(_records(spark, sf_dir).withColumn("date", F.lit("")), "temporal").select("ord", "split")


@query("SELECT s.doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS source, doc_id % 50 = 0 AS held FROM documents) s WHERE NOT held AND source NOT IN ('src1', 'jsoup', 'javamelody')")
def q_default_holdout(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")).alias("source"), F.concat(F.lit("cve-"), "doc_id").alias("cve"))
    listed = docs.where("doc_id % 50 = 0").select(F.upper("cve").alias("cve_id"), F.lit("https://h/x/src1.git/").alias("repo_url"), F.lit("z").alias("other"))
    cves, repos = R.exclusions(listed)
    return split.hold_out(docs, "cve", "source", cves, repos).select("doc_id")


_NEAR = "(1, 'w1 w2 w3 w4 w5 w6 w7 w8 w9', 'x'), (2, 'w1 w2 w3 w4 w5 w6 w7 w8', 'x'), (3, 'a b c', 'd'), (4, 'w1 w2 w3 w4 w5 w6 w7 w8 w9', 'x y')"


_NEAR_OVER = mixed(_NEAR, "ord, vuln, fixed", "SELECT cast(doc_id + 100 as int), text, source FROM documents")


@query(f"""WITH s AS (SELECT ord, list_distinct(string_split(trim(regexp_replace(concat(vuln, ' ', fixed), '{WS}+', ' ', 'g')), ' ')) AS t FROM ({_NEAR_OVER})), w AS (SELECT ord, unnest(t) AS w FROM s), c AS (SELECT a.ord AS a, b.ord AS b, count(*) AS i FROM w a JOIN w b ON a.w = b.w AND a.ord < b.ord GROUP BY 1, 2),
p AS (SELECT a, b FROM c JOIN s x ON x.ord = a JOIN s y ON y.ord = b WHERE i::DOUBLE / (len(x.t) + len(y.t) - i)::DOUBLE >= 0.8), g AS (SELECT list_reduce(list([b, a] ORDER BY b, a), lambda gone, x: CASE WHEN list_contains(gone, x[2]) THEN gone ELSE list_append(gone, x[1]) END, []::INT[]) AS gone FROM p)
SELECT ord FROM s, g WHERE NOT list_contains(gone, ord)""")
def q_corpus_near_dedup(spark, sf_dir):
    return corpus.near_dedup(over(spark, sf_dir, _NEAR_OVER), 0.8).select("ord")


@query(f"SELECT ord, 'security' AS cwe, contains(f, 'x') AS same, '```java' || chr(10) || f || chr(10) || '```' AS completion FROM (VALUES {_NEAR}) t(ord, v, f)")
def q_corpus_examples(spark, sf_dir):
    pairs = inline(spark, _NEAR, "ord, vuln, fixed").withColumn("cwe", F.lit(""))
    made = sft.corpus_examples(pairs.orderBy("ord")).select("cwe", "completion", "prompt")
    return made.join(pairs.select("ord", F.concat(F.lit("```java\n"), "vuln", F.lit("\n```")).alias("_end"), F.concat(F.lit("```java\n"), "fixed", F.lit("\n```")).alias("_c")), made["prompt"].endswith(F.col("_end")) & (made["completion"] == F.col("_c"))).select("ord", "cwe", F.contains("completion", F.lit("x")).alias("same"), "completion")  # four constant rows


@query("SELECT conv_id, turn, 'Project: unknown' || chr(10) || chr(10) || 'File: ' || role || chr(10) || chr(10) AS middle, turn % 2 = 0 AS again FROM conversations")
def q_fix_prompt(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("p", sft.fix_prompt(F.lit(""), F.col("role"), F.col("text"), F.when(F.col("turn") % 2 == 0, "note")))
    begin = F.instr("p", "Project: ")
    return rows.select("conv_id", "turn", F.substring("p", begin, F.length("role") + F.lit(len("Project: unknown\n\nFile: \n\n"))).alias("middle"), F.contains("p", F.lit("failed the gate:\nnote\n\n")).alias("again"))


_SFT = "(1, 'fix it', '', 'done'), (2, '', 'in', ''), (3, 'a', 'b', 'c')"
_SFT_OVER = mixed(_SFT, "id, instruction, input, output", """SELECT cast(doc_id + 100 as int), CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END, concat(source, text), lang FROM documents""")


@query(f"SELECT id, 3 AS n, coalesce(nullif(i, ''), x) AS user, o AS assistant FROM ({_SFT_OVER}) t(id, i, x, o)")
def q_chat_aliases(spark, sf_dir):
    rows = over(spark, sf_dir, _SFT_OVER)
    return rows.withColumn("m", sft.chat_of(rows)).select("id", F.size("m").alias("n"), F.col("m")[1]["content"].alias("user"), F.col("m")[2]["content"].alias("assistant"))


_FENCES = "(1, 'x ```java int a; ``` y'), (2, '```html' || chr(10) || '<p>' || chr(10) || '```'), (3, ' none '), (4, '```java' || chr(10) || chr(10) || 'b' || chr(10) || '```'), (5, '``` c ```')"
_FENCES_OVER = mixed(_FENCES, "id, t", """SELECT cast(doc_id + 100 as int), concat('see ```', CASE doc_id % 3 WHEN 0 THEN 'java' WHEN 1 THEN 'html' ELSE '' END, chr(10), text, chr(10), '``` end') FROM documents""")


@query(f"""SELECT id, CASE WHEN regexp_matches(t, '(?is)```(?:java)?\\s*(.*?)```') THEN trim(regexp_extract(t, '(?is)```(?:java)?\\s*(.*?)```', 1), ' ' || chr(10)) ELSE trim(t) END AS java, CASE WHEN regexp_matches(t, '(?is)```(?:html)?\\s*(.*?)```') THEN trim(regexp_extract(t, '(?is)```(?:html)?\\s*(.*?)```', 1), ' ' || chr(10)) ELSE trim(t) END AS html FROM ({_FENCES_OVER}) x(id, t)""")
def q_fences_anyhow(spark, sf_dir):
    return over(spark, sf_dir, _FENCES_OVER).select("id", T.fenced_anyhow("t").alias("java"), T.fenced_anyhow("t", "html").alias("html"))


_CLASSES = "(1, 'package a.b;' || chr(10) || 'public class X extends Y { int q() { return 1; } }'), (2, 'interface I {}'), (3, 'nothing')"
_CLASSES_OVER = mixed(_CLASSES, "id, t", """SELECT cast(doc_id + 100 as int), concat('package p', doc_id, '.q;', chr(10), 'final class D', doc_id, ' { // ', text, ' }') FROM documents""")


@query(f"""SELECT id, CASE WHEN contains(t, 'package') THEN 'package ' || regexp_extract(t, 'package\\s+([\\w.]+)', 1) || ';' || chr(10) || chr(10) ELSE '' END || 'public class ' || coalesce(nullif(regexp_extract(t, '\\b(?:class|interface|enum)\\s+(\\w+)', 1), ''), 'Emptied') || ' {{' || chr(10) || '}}' || chr(10) AS code FROM ({_CLASSES_OVER}) x(id, t)""")
def q_skeleton(spark, sf_dir):
    return over(spark, sf_dir, _CLASSES_OVER).select("id", T.skeleton("t").alias("code"))


@query(f"SELECT doc_id, CASE WHEN n = '' THEN 0 ELSE len(string_split(n, ' ')) END::INT AS words, md5(n) AS normal FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\\n]*', ' ', 'g'), '{WS}+', ' ', 'g')) AS n FROM documents)")
def q_cased_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.whitespace_tokens("text")).alias("words"), F.md5(T.normalize_code("text", lower=False)).alias("normal"))


@query("SELECT n_nationkey AS id, k::INT AS sample FROM nation, range(0, 3) r(k)")
def q_samples(spark, sf_dir):
    return split.sampled(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), 3)


_METHODS = "('f1', 'a'), ('f2', 'b')"
_METHODS_OVER = mixed(_METHODS, "file_change_id, method_code", """SELECT concat('g', doc_id), text FROM documents""")


@query(f"SELECT f AS file_change_id, '' AS name, c AS code, 'true' AS before_change FROM ({_METHODS_OVER}) t(f, c)")
def q_probed(spark, sf_dir):
    rows = over(spark, sf_dir, _METHODS_OVER).withColumn("is_before", F.lit("true"))
    return corpus.probed(rows, "methods")


@query("SELECT bug, j FROM (VALUES ('a', 'new'), ('b', 'old')) t(bug, j)")
def q_preferred_results(spark, sf_dir):
    return M.preferred_results(inline(spark, "('a', 'new')", "bug, j"), inline(spark, "('a', 'old'), ('b', 'old')", "bug, j"), "bug")


#: Every page as it is, and once more with so many planted nodes.
_PLANTED_SQL = """SELECT page_id, html FROM pages UNION ALL SELECT page_id + 10000000, concat(html, repeat('<img src="x">', cast(page_id % 3 as int)), '<img src="x" alt=""><img aria-label="n">', repeat('<a href="#"><img alt=""> </a>', cast(page_id % 2 as int)), '<a href="#"><img alt="name"></a><a name="x"></a>',
'<label for="f">L</label><input id="f"><input type="hidden"><label>T <textarea></textarea></label><input type="submit">', repeat('<INPUT name=q>', cast(page_id % 4 as int)), repeat('<ul><p>no</p><li>yes</ul>', cast(page_id % 2 as int)), repeat('<iframe src="y"></iframe>', cast(page_id % 3 as int)), '<iframe title="t"></iframe>',
'<button aria-labelledby="f2"></button><span id="f2">n</span>', repeat('<button> <b></b></button>', cast(page_id % 5 as int)), '<select></select><h4 tabindex="3">x</h4><h5> </h5><li>lone</li><!-- <img> --><script>"<img>"</script><meta http-equiv="refresh" content="5">', repeat('<i id="same"></i>', cast(page_id % 3 as int))) FROM pages"""


@query(f"""WITH p AS ({_PLANTED_SQL}), b AS (SELECT *, page_id % 10000000 AS k, page_id >= 10000000 AS planted FROM p),
r AS (SELECT page_id, unnest(['image-alt', 'link-name', 'label', 'list', 'frame-title', 'button-name', 'select-name', 'tabindex', 'empty-heading', 'listitem', 'meta-refresh', 'duplicate-id', 'heading-order', 'landmark-one-main', 'html-has-lang', 'document-title']) AS rule,
unnest([CASE WHEN planted THEN k % 3 ELSE 0 END, CASE WHEN planted THEN k % 2 ELSE 0 END, CASE WHEN planted THEN k % 4 ELSE 0 END, CASE WHEN planted THEN k % 2 ELSE 0 END, CASE WHEN planted THEN k % 3 ELSE 0 END, CASE WHEN planted THEN k % 5 ELSE 0 END, planted::INT, planted::INT, planted::INT, planted::INT, planted::INT, CASE WHEN planted THEN greatest(k % 3 - 1, 0) ELSE 0 END, planted::INT,
(NOT regexp_matches(html, '(?i)<main\\b|role="?main'))::INT, (NOT regexp_matches(html, '(?i)<html\\b[^>]*\\blang='))::INT, (NOT regexp_matches(html, '(?i)<title>[^<]*\\S[^<]*</title>'))::INT]) AS n FROM b) SELECT page_id, rule, n::BIGINT AS n FROM r WHERE n > 0""")
def q_a11y_findings(spark, sf_dir):
    """Findings by page and rule, over nodes with parents."""
    found = accessibility.findings(over(spark, sf_dir, _PLANTED_SQL), "page_id", "html")
    return found.groupBy(F.col("page").alias("page_id"), "rule").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, len(regexp_extract_all(h, '<(?:img|input|br|meta|link|hr)\\b'))::BIGINT AS void, len(regexp_extract_all(h, '<a\\b'))::BIGINT AS links, len(regexp_extract_all(h, '<li\\b'))::BIGINT AS items, len(regexp_extract_all(h, '<li\\b'))::BIGINT AS in_lists
FROM (SELECT page_id, lower(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style|title)\\b[^>]*>.*?</(script|style|title)>', '', 'g')) AS h FROM pages)""")
def q_page_nodes(spark, sf_dir):
    """Nodes of each page by kind; items that have a list as their parent."""
    tree = accessibility.nodes(table(spark, sf_dir, "pages"), "page_id", "html")
    up = tree.select("page", F.col("node").alias("parent"), F.col("tag").alias("above"))
    rows = tree.join(up, ["page", "parent"], "left").groupBy(F.col("page").alias("page_id"))
    n = F.count_if
    return rows.agg(n(F.col("tag").isin("img", "input", "br", "meta", "link", "hr")).alias("void"), n(F.col("tag") == "a").alias("links"), n(F.col("tag") == "li").alias("items"), n((F.col("tag") == "li") & F.col("above").isin("ul", "ol")).alias("in_lists"))


@query(f"""SELECT doc_id, md5({NORM}) AS normal, len(list_distinct(regexp_extract_all({NORM}, '[a-z0-9_]+')))::INT AS words, md5({redacted_sql("text")}) AS redacted, replace(string_split(regexp_replace(lower(trim(source)), '/+$', ''), '/')[-1], '.git', '') AS repo,
CASE WHEN doc_id % 3 = 0 THEN 'CWE-' || (doc_id % 90) ELSE 'CWE-' || doc_id END AS cwe, len({_STMT.format("text")})::INT AS statements, {_EXITS.format(_STMT.format("text"))}::INT AS exits FROM documents""")
def q_sql_functions(spark, sf_dir):
    """The functions in SQL text alone."""
    sql.register(spark)
    return over(spark, sf_dir, """SELECT doc_id, md5(vg_normalize_code(text)) AS normal, size(array_distinct(vg_tokens(text))) AS words, md5(vg_redact(text)) AS redacted, vg_repo_key(source) AS repo,
vg_norm_cwe(CASE WHEN doc_id % 3 = 0 THEN concat('cwe_', doc_id % 90) ELSE concat(' ', doc_id) END) AS cwe, vg_count_statements(text) AS statements, vg_count_exits(text) AS exits FROM documents""")


@query(f"""WITH w AS (SELECT lang, unnest(list_distinct(regexp_extract_all({NORM}, '[a-z0-9_]+'))) AS word, doc_id FROM documents), c AS (SELECT lang, word, count(*) AS k FROM w GROUP BY 1, 2), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
SELECT c.lang, word, {wilson_sql("k", "n")} FROM c JOIN n ON c.lang = n.lang WHERE k::DOUBLE / n >= 0.5""")
def q_sql_table_functions(spark, sf_dir):
    """Words of at least half of a language's documents, by a table function over a scalar one in SQL text."""
    sql.register(spark)
    return over(spark, sf_dir, """WITH c AS (SELECT lang, word, count(*) AS k FROM (SELECT lang, vg_distinct_tokens(text) AS words FROM documents), LATERAL explode(words) AS t(word) GROUP BY lang, word), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
r AS (SELECT c.lang, word, CAST(k AS DOUBLE) / n AS rate, vg_wilson(k, n) AS w FROM c JOIN n ON c.lang = n.lang WHERE k / n >= 0.5) SELECT lang, word, rate, w.ci_low, w.ci_high FROM r""")


_LINE_SQL = "CASE WHEN doc_id % 7 = 0 THEN '{oops' WHEN doc_id % 11 = 0 THEN '  ' WHEN doc_id % 13 = 0 THEN '[1, 2]' ELSE concat('{\"vuln_code\": \"', md5(text), '\"}') END"


@query(f"""WITH l AS (SELECT source, {_LINE_SQL} AS v, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents)
SELECT source, place, trim(v) AS value, CASE WHEN v = '{{oops' THEN 'not JSON' WHEN starts_with(v, '[') THEN 'not an object' END AS problem, count(*) OVER () AS entries, count(*) FILTER (v = '{{oops' OR starts_with(v, '[')) OVER () AS problems FROM l WHERE trim(v) <> ''""")
def q_record_scan(spark, sf_dir):
    """Files of lines written from all documents, some broken, read again by place, with the counts of the same pass."""
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    lines = over(spark, sf_dir, f"SELECT source, doc_id, {_LINE_SQL} AS value FROM documents")
    lines.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(folder)
    seen = Observation(f"records-{uuid.uuid4().hex}")
    rows = staged(R.scan_records(spark, folder, lines="*.txt", observed=seen))
    n = seen.get
    return rows.select(F.regexp_extract("source_file", "source=([^/]+)/", 1).alias("source"), "place", "value", "problem", F.lit(n["entries"]).alias("entries"), F.lit(n["problems"]).alias("problems"))


_PAIRS_OF = "SELECT text AS vuln, concat(text, ' ', doc_id % 2) AS fixed, concat('https://host/x/', source, '.git') AS repo, CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat('202', doc_id % 4, '-03-04') END AS cdate, concat('CVE-', doc_id) AS cve, '' AS cwe, doc_id AS ord FROM documents"


@query(f"""WITH p AS ({_PAIRS_OF}), h AS (SELECT * FROM p WHERE ord NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND repo NOT LIKE '%/src3.git' AND repo NOT LIKE '%/src5.git'), c AS (SELECT * FROM h WHERE cdate = '' OR cdate < '2022-01-01'), d AS (SELECT DISTINCT trim(regexp_replace(vuln, '{WS}+', ' ', 'g')), trim(regexp_replace(fixed, '{WS}+', ' ', 'g')) FROM c)
SELECT 'raw' AS stage, count(*) AS n FROM p UNION ALL SELECT 'after_holdout', count(*) FROM h UNION ALL SELECT 'after_temporal_cut', count(*) FROM c UNION ALL SELECT 'after_dedup', count(*) FROM d""")
def q_provenance_counted(spark, sf_dir):
    """The stages' counts from the one job that writes the corpus of all documents."""
    cves = over(spark, sf_dir, "SELECT concat('cve-', doc_id) AS cve FROM labels WHERE toxic = 1")
    return corpus.write_counted(over(spark, sf_dir, _PAIRS_OF), cves, inline(spark, "('src3'), ('src5')", "repo"), "2022-01-01", f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}")


_SCOPE_SQL = ("SELECT page_id, url AS check_id, CASE WHEN page_id % 10 = 0 THEN '' ELSE concat('cwe-', page_id % 4) END AS cwe FROM pages UNION ALL SELECT -page_id - 1, CASE WHEN page_id % 5 = 0 THEN '' ELSE substring(url, 9) END, 'CWE-1' FROM pages", "SELECT CASE WHEN page_id % 2 = 0 THEN substring(url, 12) ELSE concat('own.', url) END AS rule, concat('CWE-', page_id % 3) AS cwe FROM pages WHERE page_id % 3 <> 1 UNION ALL SELECT '', 'CWE-3' FROM pages")


@query(f"""WITH f AS ({_SCOPE_SQL[0]}), r AS ({_SCOPE_SQL[1]}) SELECT page_id, check_id FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE rule <> '' AND upper(r.cwe) = upper(f.cwe)) OR (check_id <> '' AND EXISTS (SELECT 1 FROM r WHERE rule <> '' AND upper(r.cwe) = upper(f.cwe) AND (suffix(check_id, rule) OR suffix(rule, check_id))))""")
def q_scope_pages(spark, sf_dir):
    """Rule ids that are suffixes of one another, either way: addresses of all pages."""
    found, rules = (over(spark, sf_dir, q) for q in _SCOPE_SQL)
    return gate.in_scope(found, rules).select("page_id", "check_id")


_NAMED_SQL = ("SELECT CASE o_orderkey % 5 WHEN 0 THEN concat('pkg.C', o_custkey, '#m', o_orderkey % 7) WHEN 1 THEN concat('pkg.C', o_custkey, '::m', o_orderkey % 7) WHEN 2 THEN concat(' pkg.C', o_custkey) WHEN 3 THEN concat('C', o_custkey, 'x') ELSE concat('pkg.C', o_custkey, '#') END AS test FROM orders", "SELECT CASE l_orderkey % 4 WHEN 0 THEN concat('pkg.C', l_partkey, '#m', l_linenumber) WHEN 1 THEN concat('pkg.C', l_partkey, '.m', l_linenumber) WHEN 2 THEN concat('pkg.C', l_partkey) ELSE concat('C', l_partkey, '#x') END AS test FROM lineitem")
_SPLIT_TEST = "replace(trim(test), '::', '#') AS i"


@query(f"""WITH w AS (SELECT *, string_split(i, '#')[1] AS c, CASE WHEN contains(i, '#') THEN substr(i, strpos(i, '#') + 1) ELSE '' END AS m, regexp_extract(i, '[0-9]+') AS k FROM (SELECT DISTINCT test, {_SPLIT_TEST} FROM ({_NAMED_SQL[0]}))),
f AS (SELECT *, string_split(i, '#')[1] AS c, CASE WHEN contains(i, '#') THEN substr(i, strpos(i, '#') + 1) ELSE '' END AS m, regexp_extract(i, '[0-9]+') AS k FROM (SELECT DISTINCT test, {_SPLIT_TEST} FROM ({_NAMED_SQL[1]})))
SELECT w.test AS wanted, f.test AS found FROM w JOIN f ON w.k = f.k WHERE w.i = f.i OR (f.m = '' AND w.m <> '' AND (f.i = w.c || '.' || w.m OR f.c = w.c || w.m)) OR (w.m = '' AND f.m <> '' AND w.c = f.c || f.m) OR (f.c = w.c AND (w.m = '' OR f.m = w.m))""")
def q_named_tests(spark, sf_dir):
    """Wanted and found test ids of all orders and lines that name the same test, by blocks of keys."""
    wanted, found = (over(spark, sf_dir, q) for q in _NAMED_SQL)
    return gate.named_pairs(wanted, found)


#: Events in ten batches by time, some of which come three batches late.
_BATCHES_SQL = "SELECT event_id, ts, value, least(9, slot + CASE WHEN event_id % 37 = 0 THEN 3 ELSE 0 END) AS batch FROM (SELECT event_id, ts, value, ntile(10) OVER (ORDER BY ts, event_id) - 1 AS slot FROM events)"


@query(f"""WITH b AS ({_BATCHES_SQL}), m AS (SELECT batch, CASE WHEN batch = 5 THEN max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) END - INTERVAL 1 DAY AS mark FROM b GROUP BY batch), f AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM b),
k AS (SELECT date_trunc('day', ts) AS d, value FROM b JOIN m ON b.batch = m.batch WHERE m.mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > m.mark)
SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (value > 50) AS cleared FROM k, f WHERE d + INTERVAL 1 DAY <= f.mark GROUP BY 1""")
def q_stream_late(spark, sf_dir):
    """Daily rates over ten micro-batches with late rows; the stream stops after five and starts again from its checkpoint.

    Late is what the watermark of the batch before rules out; a run ends with a batch without rows, so the sixth batch
    has the mark of the first five.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = staged(over(spark, sf_dir, _BATCHES_SQL).withColumn("ok", F.col("value") > 50))
    for half in ([0, 1, 2, 3, 4], [5, 6, 7, 8, 9]):
        streams.written_in_batches(rows, "batch", half, f"{folder}/in")
        found = streams.run_to_end(streams.windowed_rate(streams.from_batches(rows, "batch", f"{folder}/in"), "ts", "ok"), folder)
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "cleared")


@query(f"""WITH s AS (SELECT doc_id, doc_id % 3 * 10000000 + doc_id AS o, list_distinct(regexp_extract_all({NORM}, '[a-z0-9_]+')) AS t FROM documents), w AS (SELECT o, unnest(t) AS w FROM s),
c AS (SELECT a.o AS a, b.o AS b, count(*) AS i FROM w a JOIN w b ON a.w = b.w AND a.o < b.o GROUP BY 1, 2), p AS (SELECT a, b FROM c JOIN s x ON x.o = a JOIN s y ON y.o = b WHERE i::DOUBLE / (len(x.t) + len(y.t) - i)::DOUBLE >= 0.9),
g AS (SELECT list_reduce(list([b, a] ORDER BY b, a), lambda gone, x: CASE WHEN list_contains(gone, x[2]) THEN gone ELSE list_append(gone, x[1]) END, []::BIGINT[]) AS gone FROM p)
SELECT doc_id FROM s, g WHERE gone IS NULL OR NOT list_contains(gone, o)""")
def q_kept_index(spark, sf_dir):
    """All documents in three batches against an index of what has been kept."""
    index = dedup.KeptIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", 0.9)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = [staged(index.add(docs.where(F.col("doc_id") % 3 == k), "doc_id", "text", k).select("doc_id")) for k in range(3)]
    return parts[0].union(parts[1]).union(parts[2])


#: Objects of unlike shapes around each event's props: as they are, deeper, incomplete, of other types, no object.
_OBJECTS_SQL = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN concat('{"model_tag": "', event_type, '", "n": ', user_id, ', "overall": {"cleared": ', user_id % 5, ', "rate": ', user_id % 4, '.5}}') WHEN 2 THEN '[1, 2]' WHEN 3 THEN '{oops' WHEN 4 THEN '{"n": "many", "overall": [], "errors": ["a", "b"]}' ELSE NULL END AS value FROM events"""


@query(f"""SELECT event_id, CASE WHEN event_id % 6 = 1 THEN v->>'model_tag' ELSE '' END AS model_tag, CASE WHEN event_id % 6 = 1 THEN (v->>'n')::INT ELSE 0 END AS n, CASE WHEN event_id % 6 = 1 THEN (v->'overall'->>'cleared')::INT ELSE 0 END AS cleared, CASE WHEN event_id % 6 = 1 THEN (v->'overall'->>'rate')::DOUBLE ELSE 0.0 END AS rate, CASE WHEN event_id % 6 = 4 THEN 2 ELSE 0 END AS errors
FROM (SELECT event_id, CASE WHEN json_valid(value) THEN value::JSON END AS v FROM ({_OBJECTS_SQL}))""")
def q_unlike_objects(spark, sf_dir):
    rows = D.rows(D.objects(over(spark, sf_dir, _OBJECTS_SQL), "value"), D.RESULTS, ["event_id"])
    return rows.select("event_id", "model_tag", "n", "cleared", "rate", F.size("errors").alias("errors"))
