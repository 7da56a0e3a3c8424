"""Operator 10's plan never needs more sequences than best fit by decreasing length; best fit in bulk is best fit."""

from __future__ import annotations

import bisect
import random

import numpy as np
import public_tokenizers
import pytest

from verigate.llm import packing
from verigate.llm.tokens import encoder


def _best_fit(histogram, capacity):
    room, n = [], 0
    for length in range(capacity, 0, -1):
        for _ in range(int(histogram[length])):
            i = bisect.bisect_left(room, length)
            free = capacity if i == len(room) else room.pop(i)
            n += free == capacity
            bisect.insort(room, free - length)
    return n


def _holds(configurations, histogram, capacity):
    held = sum((a * n for a, n in configurations), np.zeros(capacity + 1, dtype=np.int64))
    return (held[1:] == histogram[1:]).all() and all((a * np.arange(capacity + 1)).sum() <= capacity and n > 0 for a, n in configurations)


@pytest.mark.parametrize("seed", range(12))
def test_best_fit_in_bulk(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 20, 64])
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for _ in range(r.choice([0, 1, 30, 500])):
        histogram[r.choice([r.randrange(1, capacity + 1), r.randrange(1, capacity // 3 + 1)])] += r.choice([1, 1, 1, 9])
    made = packing.best_fit(histogram, capacity)
    assert _holds(made, histogram, capacity) and sum(n for _, n in made) == _best_fit(histogram, capacity)


@pytest.mark.parametrize("seed", range(6))
def test_plan_of_random_histograms(seed):
    r = random.Random(seed)
    histogram = np.zeros(packing.LENGTH + 1, dtype=np.int64)
    for _ in range(r.choice([3, 200, 3000])):
        histogram[min(packing.LENGTH, 1 + int(r.expovariate(1 / r.choice([40, 300, 600]))))] += 1
    plan = packing.plan(histogram)
    n = sum(k for _, k in plan.configurations)
    assert _holds(plan.configurations, histogram, packing.LENGTH)
    assert plan.bound + plan.full - 1e-6 <= n <= _best_fit(histogram, packing.LENGTH)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_plan_of_the_tables(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text").collect()]
    enc = encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    histogram = np.zeros(packing.LENGTH + 1, dtype=np.int64)
    for lo in range(0, len(texts), 500):
        for ids in enc.encode(texts[lo : lo + 500]):
            whole, rest = divmod(len(ids) // 4 + 1, packing.LENGTH)
            histogram[packing.LENGTH] += whole
            histogram[rest] += rest > 0
    plan = packing.plan(histogram)
    assert sum(k for _, k in plan.configurations) <= _best_fit(histogram, packing.LENGTH)
    assert plan.by_program > 0
