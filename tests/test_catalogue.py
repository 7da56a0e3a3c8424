"""Every query with SQL against DuckDB on the smallest tables; every other query runs."""

import os

import duckdb
import pytest

from verigate.plans import catalogue

SF = "/root/testdata/sf0.001"


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def show(x):
        return "[" + ",".join(map(show, x)) + "]" if isinstance(x, (list, tuple)) else repr(x) if isinstance(x, float) else "~" if x is None else str(x)

    return sorted(columns), sorted("|".join(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in catalogue.ORACLE:
        assert df.columns
        return
    cur = con.execute(catalogue.ORACLE[name])
    assert canon(df.columns, rows) == canon([c[0] for c in cur.description], cur.fetchall())


def test_words_by_table_function_stay_in_their_task(spark, tmp_path):
    """No text goes into a join, and each row counts as a document, whatever its identifier."""
    from verigate.plans.catalogue import QUERIES

    rows = [(1, "one two", "en"), (1, "two two", "en"), (None, "two", "en"), (2, None, "en"), (3, "x", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["q_sql_table_functions"](spark, str(tmp_path))
    assert {(r.lang, r.word): r.rate for r in found.collect()} == {("en", "two"): 0.75, ("fr", "x"): 1.0}
    assert "coalesce(text" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)


@pytest.mark.parametrize("name", ["q_provenance", "q_pair_pivot"])
def test_texts_of_pairs_count_as_they_are(spark, tmp_path, name):
    """White space makes another text, an empty text is one, null is none."""
    texts = ["a b", "a  b", "a\nb", "a\u00a0b", "a\u000bb", "a b", "", "", " ", None, "a\0", "a\0b", "A b", "\u3000"]
    rows = [(10 * i + k, t) for i, t in enumerate(texts) for k in (1, 6, 8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(catalogue.ORACLE[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("empty", [False, True])
def test_pairs_by_digests(spark, empty):
    """The same pairs as with texts."""
    import hashlib

    from verigate.operators import corpus

    codes = [("1", "a", 1), ("0", " a", 2), ("1", "x y", 3), ("1", None, 4), ("0", "", 5), ("1", "b", 6), ("0", "b\u00a0c", 7), ("1", "", 8), ("0", "d", 9), ("0", None, 10)]
    of = {1: "f", 2: "f", 3: "g", 4: "g", 5: "g", 6: "h", 7: "h", 8: "i", 9: "i", 10: "i"}
    tables = {
        "methods": spark.createDataFrame([(of[o], "m", b, c, o) for b, c, o in codes], "file_change_id string, name string, before_change string, code string, ord int"),
        "files": spark.createDataFrame([(f, "java", "c") for f in "fghi"], "file_change_id string, programming_language string, hash string"),
        "commits": spark.createDataFrame([("c", "r", "")], "hash string, repo_url string, committer_date string"),
        "fixes": spark.createDataFrame([("c", "CVE-1")], "hash string, cve_id string"),
        "classes": spark.createDataFrame([("CVE-1", "CWE-1", 1)], "cve_id string, cwe_id string, ord int"),
    }
    texts, digests = corpus.pairs(**tables, empty=empty), corpus.pairs(**tables, empty=empty, digests=True)
    own = sorted((r.vuln, r.fixed) for r in texts.collect())
    assert own == ([("", "d"), ("b", "b\u00a0c"), ("x y", "")] if empty else [("b", "b\u00a0c")])
    short = lambda t: t and hashlib.sha256(t.encode()).hexdigest()
    assert sorted((r.vuln, r.fixed) for r in digests.collect()) == sorted((short(a), short(b)) for a, b in own)
