"""Properties on small rows, against independent Python where there is a model."""

import difflib
import itertools

from pyspark.sql import functions as F

from verigate.functions import text as T
from verigate.functions.rates import wilson
from verigate.operators import dedup, gate, sft, split


def test_wilson_known_values(spark):
    rows = spark.createDataFrame([(0, 0), (10, 10), (50, 100)], "k long, n long")
    low, high = wilson(F.col("k"), F.col("n"))
    got = [(round(a, 4), round(b, 4)) for a, b in rows.select(low, high).collect()]
    assert got[0] == (0.0, 0.0) and got[1][1] == 1.0 and got[2] == (0.4038, 0.5962)


def test_unicode_white_space_and_word_bounds(spark):
    rows = spark.createDataFrame([("a   b",), ("édeadbee1 deadbee1",)], "t string")
    assert [r[0] for r in rows.select(T.collapse_whitespace("t")).collect()][0] == "a b"
    assert [r[0] for r in rows.select(T.redact("t")).collect()][1] == "édeadbee1 <HASH>"


def test_greedy_chain(spark):
    """a ~ b ~ c, a and c unlike: b goes, c stays because b is gone."""
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    assert sorted(r[0] for r in dedup.greedy_drops(pairs).collect()) == [2, 4]


def test_similar_pairs_brute_force(spark):
    words = "a b c d e f g h i j".split()
    texts = [" ".join(words[i:] + words[: i // 2]) for i in range(8)] + ["a b", "a b", ""]
    rows = spark.createDataFrame([(i, "x" if i % 2 else "y", t) for i, t in enumerate(texts)], "id long, block string, text string")
    want = set()
    for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2):
        x, y = set(a.split()), set(b.split())
        if i % 2 == j % 2 and x and y and len(x & y) / len(x | y) >= 0.7:
            want.add((i, j))
    assert {(r.a, r.b) for r in dedup.similar_pairs(rows, "id", "block", "text", 0.7).collect()} == want


def test_minhash_pairs_brute_force(spark):
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base[:40 - i] + [f"z{i}"] * (i > 0)) for i in range(5)] + [" ".join(base)] * 3 + [" ".join(base[:20] + [f"y{i}" for i in range(20)]), "", "w1 w2"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = [set(t.split()) for t in texts]
    want = {(i, j) for (i, x), (j, y) in itertools.combinations(enumerate(sets), 2) if x and y and len(x & y) / len(x | y) >= 0.9}
    got = [(r.a, r.b) for r in dedup.minhash_pairs(rows, "id", "text", 0.9).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_code_guard(spark):
    code = "int a;\n// note\nint b;\nreturn a;\n}"
    rows = spark.createDataFrame([(code, code), (code, "int a;"), ("", "x"), (code, "int a;\nint b;\nint c;")], "a string, b string")
    assert [r[0] for r in rows.select(gate.code_guard("a", "b")["ok"]).collect()] == [True, False, True, False]


def test_diff_and_changed_lines(spark):
    a, b = "x\ny\nz", "x\nq\nz\nw"
    row = spark.createDataFrame([(a, b)], "a string, b string").select(T.unified_diff("a", "b"), T.changed_lines("a", "b")).first()
    assert row[0] == "\n".join(difflib.unified_diff(a.split("\n"), b.split("\n"), "before", "after", lineterm="")) and row[1] == 3


def test_leak_assertion(spark):
    rows = spark.createDataFrame([("c1", "train"), ("c1", "eval"), ("", "train"), ("", "eval")], "cve string, split string")
    assert [r[0] for r in split.leaked(rows, "cve").collect()] == ["c1"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, block string, text string")
    assert dedup.near_dedup(empty, "id", "block", "text").count() == 0
    assert dedup.minhash_pairs(empty, "id", "text", 0.9).count() == 0
    assert split.family_split(empty, "block", 0.2).count() == 0


def test_streaming_window_equals_batch(spark):
    from verigate.streaming import streams

    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001").withColumn("ok", F.col("value") > 50)
    run = streams.windowed_rate(rows, "ts", "ok").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ok", F.col("value") > 50)
    assert sorted(spark.table("rates").collect()) == sorted(streams.windowed_rate(batch, "ts", "ok").collect())


def test_blocks_with_blanks_stay_apart(spark):
    rows = [(1, "a", "b c"), (2, "a b", "c"), (3, "a b c", ""), (4, None, "b c"), (5, "", "b c"), (6, "a", "B  c"), (7, "z", "..."), (8, "z", "!"), (9, "y", "?")]
    df = spark.createDataFrame(rows, "id long, block string, text string")
    assert sorted(r.id for r in dedup.near_dedup(df, "id", "block", "text").collect()) == [1, 2, 3, 4, 7, 9]


def test_records_of_other_projects_and_one_like_side(spark):
    """Alike on one side alone, or of another project, is no duplicate; two sides without tokens are."""
    words = " ".join(f"w{i}" for i in range(20))
    rows = [(1, words, "x y", "p q"), (2, words + " more", "x  Y", "p q"), (3, words, "x y z", "p"), (4, words + " yet", "quite other", "p q"), (5, "{}", ";", "n"), (6, "( )", ",", "n"), (7, "{}", "words", "n")]
    df = spark.createDataFrame([(*r, "", "", "f") for r in rows], "ord long, vuln_code string, fixed_code string, project string, date string, cve string, source_file string")
    kept, counts = sft.dedup_records(df)
    assert sorted(r.ord for r in kept.collect()) == [1, 3, 4, 5, 7]
    assert counts.first().asDict() == {"input": 7, "exact_dups": 0, "near_dups": 2, "kept": 5}
