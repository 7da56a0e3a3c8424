"""Operator 11 against all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verigate.llm import occurrence, overlap


def _set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def _expected(rows, percent=85, words=4):
    sets = [_set(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least: dict = {}
    order = lambda d: -(1 << 63) if d is None else d
    for k, (d, _) in enumerate(rows):
        t = top(k)
        if t not in least or order(d) < order(least[t]):
            least[t] = d
    return Counter((d, len(s), least[top(k)]) for k, ((d, _), s) in enumerate(zip(rows, sets)))


def _corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = [None, "", "  \t\n", "One", "one", "one two three", "ONE two Three", "one two three four", "a b c d e", "a  b\tc d\ne"]
    for _ in range(12):  # groups of copies of unlike closeness, chains, and a passage that most of them hold
        source = [word() for _ in range(r.choice([5, 12, 40, 150, 400]))]
        for _ in range(r.randrange(2, 14)):
            own = list(source)
            for _ in range(r.randrange(0, 1 + len(own) // r.choice([8, 25, 60]))):
                own[r.randrange(len(own))] = word()
            source = own if r.random() < 0.4 else source
            texts.append(" ".join(own + (passage if r.random() < 0.5 else [])))
    texts += [" ".join(passage), " ".join(passage[:-2]), " ".join(passage * 40)]
    texts += [r.choice(texts) for _ in range(20)]
    r.shuffle(texts)
    return list(enumerate(texts))


def _check(spark, rows, percent=85, words=4):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in overlap.similarity_components(df, percent, words).collect())
    assert got == _expected(rows, percent, words)


@pytest.mark.parametrize("seed,percent,words,meet,postings", [(1, 85, 4, 5_000_000, 4_096), (2, 85, 4, 0, 0), (3, 60, 2, 5_000_000, 10_000_000), (4, 95, 5, 0, 4_096)])
def test_equals_all_pairs(spark, monkeypatch, seed, percent, words, meet, postings):
    monkeypatch.setattr(overlap, "MEET", meet)  # more rounds of stars, or one
    monkeypatch.setattr(occurrence, "HEAP_POSTINGS", postings)
    _check(spark, _corpus(seed), percent, words)


def test_repeated_and_null_identifiers(spark):
    long = " ".join(f"w{i}" for i in range(80))
    _check(spark, [(None, long), (None, long), (3, long + " more"), (3, "another text of five words"), (3, "another text of five words"), (4, None), (None, "")])


def test_a_very_long_text(spark):
    long = " ".join(f"w{i * i % 100_003}" for i in range(120_000))
    _check(spark, [(1, long), (2, long.replace("w1 ", "v1 ")), (3, long[: len(long) // 2]), (4, "x" * 1_000_000)])


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert overlap.similarity_components(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d e"), (2, "A b c d e")], "doc_id long, text string").withColumns({c: F.lit(c) for c in ["n", "node", "t", "keys", "label", "root", "component_id", "n_shingles"]})
    assert sorted(map(tuple, overlap.similarity_components(df).collect())) == [(1, 2, 1), (2, 2, 1)]


def test_merge_skip_and_counting_agree():
    r = random.Random(5)
    for _ in range(300):
        lists = [sorted(r.sample(range(40), r.randrange(0, 30))) for _ in range(r.randrange(1, 9))]
        for least in range(1, len(lists) + 1):
            want = sorted((k, c) for k, c in Counter(x for own in lists for x in own).items() if c >= least)
            assert sorted(occurrence.merge_skip(lists, least)) == want


def test_a_block_of_many_components():
    """All pairs of a block, whatever the largest component is, against plain sets."""
    r = random.Random(6)
    n = 120
    short = [sorted(r.sample(range(60), r.randrange(25, 50))) for _ in range(n)]
    size = np.array([r.randrange(90, 120) for _ in range(n)])
    root = np.array([r.choice([0, 0, 0, k + 1]) for k in range(n)])
    least = np.array([r.randrange(6, 12) for _ in range(n)])
    own = np.array([r.randrange(2) for _ in range(n)])
    for i, j in ((0, 0), (0, 1)):
        got = set(occurrence.block_pairs(own, i, j, np.arange(n), root, size, least, short, 85))
        need = lambda x, y: max(min(least[x], least[y]), -(-85 * (size[x] + size[y]) // 185) - max(-(-85 * size[z] // 100) - least[z] for z in (x, y)))
        want = {(x, y) for y in range(n) for x in range(y) if root[x] != root[y] and len(set(short[x]) & set(short[y])) >= need(x, y) and 100 * min(size[x], size[y]) >= 85 * max(size[x], size[y]) and (i == j or own[x] != own[y])}
        assert want
        assert got == want
