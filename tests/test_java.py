"""The statements of Java code: what each kind counts, what can't be parsed, and the guard that rests on it."""

import pytest
from pyspark.sql import functions as F

from verigate.functions.java import java_counts, java_statements
from verigate.operators import gate

HEAD = "package demo; import java.util.*;\npublic class A {\n"
# Codes with the kinds of their statements in order, None where they can't be parsed.
CODES = [
    ("", ""),
    ("// only a comment", ""),
    ("package a.b; import static x.Y.*; /* c */", ""),
    ("class A { int x = 1; final List<String> l = new ArrayList<>(); static { a(); } }", "expression"),
    ("class A { class B { int y; void f() { } } enum E { P, Q(1) { void g() { h(); } }; int z; } }", "expression"),
    ("interface I { default int f() { return 1; } void g(); }", "return"),
    ("class A { void f() { int a = 1; String[] b = {\"x;\", \"{\"}; List<int[]> c; a = 2; a++; --a; f(); this.f(); new A(); } }", "local local local expression expression expression expression expression expression"),
    ("class A { A() { super(); this.x = y; } }", "expression expression"),
    ("class A { void f() { if (a) b(); else if (c) { d(); } else return; } }", "if expression if expression return"),
    ("class A { void f() { for (int i = 0; i < 3; i++) g(i); for (String s : l) { g(s); } while (x) y(); do { z(); } while (w); } }", "for expression for expression while expression do expression while"),
    ("class A { int f() { switch (x) { case 1: a(); break; case B: default: return 2; } throw new E(\"}\"); } }", "switch expression break return throw"),
    ("class A { void f() { try (R r = g(); R q = h()) { a(); } catch (E | F e) { b(); } finally { c(); } synchronized (this) { d(); } assert x : y; } }", "try expression expression expression synchronized expression assert"),
    ("class A { synchronized void f() { o: for (;;) { if (a) continue o; break o; } } }", "for if continue break"),
    ("class A { int f() { return g(x -> { a(); return 1; }, () -> b()); } }", "return expression return"),
    ("class A { void f() { run(new R() { int n = 1; public void run() { a(); } }); int[] q = new int[] {1, 2}; x = c ? d : e; } }", "expression expression local expression"),
    ("class A { void f() { Runnable r = () -> { a(); }; } }", "expression local"),
    ("@Ann({\"a\", \"b\"}) class A { @B(c = {1}) int f(final int x) throws E { return x; } }", "return"),
    ("class A { char c = '\"'; String s = \"\\\"\"; void f() { g('}', '\\''); } }", "expression"),
    ("class A { void f() { Class<?> k = A.class; Object o = (Object) x; } }", "local local"),
    ("class A { void f() { class L { int x; } ; } }", ""),
    ("class A { void f() { return } }", None),
    ("class A { void f() { int x = ; } }", None),
    ("class A { void f() { g( ; } }", None),
    ("class A { void f() { g(]); } }", None),
    ("class A { void f() { ", None),
    ("class A { } }", None),
    ("class A { String s = \"open; }", None),
    ("int f() { return 1; }", None),
    ("return x;", None),
    ("Some words of prose; and more.", None),
    ("package demo; public class UserDao { this won't parse ( ; }", None),
]


def test_kinds(spark):
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CODES)], "i long, code string")
    got = {r.i: None if r.s is None else " ".join(x.kind for x in r.s) for r in rows.select("i", java_statements("code").alias("s")).collect()}
    for i, (code, want) in enumerate(CODES):
        kinds = sorted((want or "").split())
        assert (got[i] is None) == (want is None) and sorted((got[i] or "").split()) == kinds, (code, got[i])


def test_depth_is_a_tree(spark):
    code = "class A { void f() { if (a) { b(); while (c) { d(); } } e(); } }"
    row = spark.createDataFrame([(code,)], "code string").select(java_statements("code").alias("s")).first()
    assert [(x.kind, x.depth) for x in row.s] == [("if", 1), ("expression", 2), ("while", 2), ("expression", 3), ("expression", 1)]


def test_counts_take_do_and_while_as_one(spark):
    rows = spark.createDataFrame([("class A { int f() { do { a(); } while (b); while (c) d(); return 1; } }",), ("class",)], "code string")
    got = rows.select(java_counts("code").alias("c")).collect()
    assert tuple(got[0].c) == (5, 1) and got[1].c is None


ORIGINAL = HEAD + """  private final java.sql.Connection conn;
  public A(java.sql.Connection c) { this.conn = c; }
  public String find(String name) throws Exception {
    String sql = "SELECT * FROM users WHERE name = '" + name + "'";
    java.sql.Statement st = conn.createStatement();
    if (name == null) { throw new IllegalArgumentException("null"); }
    return st.executeQuery(sql).toString();
  }
}"""
FIXED = ORIGINAL.replace("String sql = \"SELECT * FROM users WHERE name = '\" + name + \"'\";", "").replace("java.sql.Statement st = conn.createStatement();", "java.sql.PreparedStatement st = conn.prepareStatement(\"SELECT ?\"); st.setString(1, name);")
DELETED = HEAD + "public String find(String name) { return null; } }"


@pytest.mark.parametrize("before,after,ok,method", [(ORIGINAL, ORIGINAL, True, "parsed"), (ORIGINAL, FIXED, True, "parsed"), (ORIGINAL, DELETED, False, "parsed"), (ORIGINAL, "class A { (", False, "parsed"), ("a();\nb();\nreturn c;", "class A { int f() {\n a();\n b();\n return c;\n} }", True, "lines"), ("", "", True, "parsed")])
def test_guard(spark, before, after, ok, method):
    row = spark.createDataFrame([(before, after)], "a string, b string").select(gate.parsed_guard("a", "b").alias("g")).first().g
    assert (row.ok, row.method) == (ok, method)


def test_long_code(spark):
    body = " ".join(f"a{i}(\"x;\"); if (b) {{ c = {i}; }}" for i in range(3000))
    row = spark.createDataFrame([("class A { void f() { " + body + " } }",)], "code string").select(java_counts("code").alias("c"), F.lit(1)).first()
    assert tuple(row.c) == (9000, 0)
    literal = "class A { String s = \"" + "x\\n;" * 200_000 + "\"; String t = \"\"\"" + "y{\n" * 200_000 + "\"\"\"; /*" + "z;\n" * 200_000 + "*/ void f() { a(); } }"
    row = spark.createDataFrame([(literal,)], "code string").select(java_counts("code").alias("c")).first()
    assert tuple(row.c) == (1, 0)


def test_fold_sees_no_prose(spark):
    """Runs of words are two steps at most, and what can't be Java by its last sign is told without the fold."""
    long = " ".join(["word"] * 300)
    codes = ["", "()", ";", "class A { int f() { " + long + " x; return 1; } }", long + ".", long, "class A { void f() { a(); } } '", "import a.b;", "class A { int[] x() [] }", "int f() { while (a) b(); }", "a()", "[]", "class A { " + long + " = 1; }"]
    rows = spark.createDataFrame(list(enumerate(codes)), "i int, code string")
    got = {r.i: r.s and [(x.kind, x.at) for x in r.s] for r in rows.select("i", java_statements("code").alias("s")).collect()}
    assert got[0] == [] and got[1] == [] and got[2] == [] and got[4] is None and got[5] is None and got[6] is None and got[7] == []
    assert got[3] == [("local", 309), ("return", 310)]
    assert "filter(" in str(java_statements("code"))
