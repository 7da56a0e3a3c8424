"""Candidates by signatures: nothing that is alike is missed, little else is moved."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from verigate.operators import dedup, signatures


def likeness(x, y):
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("threshold", [0.9, 0.8, 0.5, 1.0])
def test_shares_and_sketches_miss_no_pair(spark, threshold):
    rng, sets = random.Random(7), []
    for size in (1, 2, 9, 10, 11, 40, 399, 401, 900):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for cut in {0, 1, 2, round(size * 0.05), round(size * (1 - threshold)), round(size * (1 - threshold) / 2)}:
            sets.append(set(base[cut:]) | {f"z{rng.randrange(10**6)}" for _ in range(cut % 3)})
    sets = [set(x) for x in {frozenset(s) for s in sets if s}]
    want = {(i, j) for (i, x), (j, y) in itertools.combinations(enumerate(sets), 2) if likeness(x, y) >= threshold}
    rows = spark.createDataFrame([(i, "b", " ".join(sorted(x))) for i, x in enumerate(sets)], "id long, block string, text string")
    assert {(r.a, r.b) for r in dedup.similar_pairs(rows, "id", "block", "text", threshold).collect()} == want


def test_unlike_sets_of_one_band_are_not_moved(spark, monkeypatch):
    """Sets that share two thirds share a band, but no pair of them reaches the likeness."""
    common = [f"c{i}" for i in range(200)]
    rows = spark.createDataFrame([(k, " ".join(common + [f"o{k}x{i}" for i in range(50)])) for k in range(30)], "id long, text string")
    moved = []
    monkeypatch.setattr(dedup, "_verified", lambda pairs, *a, f=dedup._verified: (moved.append(pairs.count()), f(pairs, *a))[1])
    assert dedup.minhash_pairs(rows, "id", "text", 0.9).count() == 0 and moved == [0]
    keys = dedup._band_rows(signatures.signed(dedup._word_sets(rows, "id", "text", "code"), 0.9, 16, 4))
    assert keys.groupBy("key").count().where("count > 1").count() > 0


def test_index_moves_no_unlike_sets(spark, tmp_path, monkeypatch):
    common = [f"c{i}" for i in range(200)]
    rows = spark.createDataFrame([(k, " ".join(common + [f"o{k}x{i}" for i in range(50)])) for k in range(20)], "id long, text string")
    moved = []
    monkeypatch.setattr(dedup, "_verified", lambda pairs, *a, f=dedup._verified: (moved.append(pairs.count()), f(pairs, *a))[1])
    index = dedup.KeptIndex(spark, f"file://{tmp_path}/index", 0.9)
    kept = [index.add(rows.where(F.col("id") % 2 == k), "id", "text", k).count() for k in range(2)]
    assert kept == [10, 10] and not any(moved)


def test_copies_are_no_pairs_of_the_corpus(spark, monkeypatch):
    """A thousand equal rows go without a pair; one that is like them goes by one pair."""
    from verigate.operators import corpus

    words = " ".join(f"w{i}" for i in range(40))
    rows = [(i, words, "x") for i in range(1000)] + [(1000, words, "y"), (1001, "other words", ""), (1002, "", ""), (1003, " ", "")]
    seen = []
    monkeypatch.setattr(dedup, "greedy_drops", lambda pairs, f=dedup.greedy_drops: (seen.append(pairs.count()), f(pairs))[1])
    kept = corpus.near_dedup(spark.createDataFrame(rows, "ord int, vuln string, fixed string"), 0.8)
    assert sorted(r.ord for r in kept.collect()) == [0, 1001, 1002, 1003] and seen == [1]


def test_texts_of_records_are_not_staged(spark, monkeypatch):
    """The search for duplicates puts down keys and signatures; texts are read again for what stays."""
    from verigate.operators import sft

    put = []
    for module in (sft, dedup):
        monkeypatch.setattr(module, "staged", lambda df, f=module.staged: (put.append(df.columns), f(df))[1])
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words, words + " a", "p", "2020", "", "f"), (2, words.upper(), words + " A", "p", "2021", "", "f"), (3, words + " more", words + " a", "p", "2022", "", "f"), (4, words, words + " a", "q", "2023", "", None)]
    df = spark.createDataFrame(rows, "ord long, vuln_code string, fixed_code string, project string, date string, cve string, source_file string")
    kept, counts = sft.dedup_records(df)
    assert sorted(r.ord for r in kept.collect()) == [1] and counts.first().asDict() == {"input": 4, "exact_dups": 2, "near_dups": 1, "kept": 1}
    assert put and not any("code" in c for columns in put for c in columns)


def test_index_makes_sets_once(spark, tmp_path, monkeypatch):
    """A batch's texts are split into words once; what reads the sets again reads what was put down."""
    put = []
    monkeypatch.setattr(dedup, "staged", lambda df, f=dedup.staged: (put.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())), f(df))[1])
    rows = spark.createDataFrame([(k, f"a b c d{k // 2}") for k in range(6)], "id long, text string")
    index = dedup.KeptIndex(spark, f"file://{tmp_path}/index", 0.9)
    assert index.add(rows, "id", "text", 0).count() == 3
    assert put[0][0] == ["id", "salt", "node", "set"] and not any("regexp_extract_all" in plan for _, plan in put[1:])


def test_sets_without_candidate_are_not_exchanged(spark, monkeypatch):
    """While few sets have a candidate, the others are read where they are."""
    plans = []
    monkeypatch.setattr(dedup, "staged", lambda df, f=dedup.staged: (plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())), f(df))[1])
    rows = spark.createDataFrame([(k, "b", " ".join(f"w{k // 2 * 40 + i}" for i in range(20 + k % 2))) for k in range(40)], "id long, block string, text string")
    assert dedup.similar_pairs(rows, "id", "block", "text", 0.9).count() == 20
    (moved,) = [plan for columns, plan in plans if columns == ["node", "set"]]
    assert "BroadcastHashJoin" in moved and "SortMergeJoin" not in moved
