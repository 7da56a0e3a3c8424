"""Streams over several micro-batches: late rows, state that expires, a restart from the checkpoint; against loops."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from verigate.streaming import streams

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "batch int, ts timestamp, k string, attempt long, score double"


def _rows(seed):
    r = random.Random(seed)
    rows = []
    for batch in range(6):
        for _ in range(12):
            hours = batch * 20 + r.randrange(20) - (60 if r.random() < 0.15 else 0)
            rows.append((batch, T0 + dt.timedelta(hours=hours, minutes=r.randrange(60)), r.choice("abcd"), r.randrange(50), float(r.randrange(5))))
    return rows


def _marks(rows, hours):
    """The watermark at the start of each batch."""
    return {b: max((t for c, t, *_ in rows if c < b), default=None) and max(t for c, t, *_ in rows if c < b) - dt.timedelta(hours=hours) for b in range(7)}


def _late(marks):
    """What is late in a batch: by the watermark of the batch before. After a run's last batch of rows one without rows
    follows, so the first batch of the second run (3) has that one's."""
    return {b: marks[b] if b == 3 else marks[max(b - 1, 0)] for b in range(6)}


def _run(spark, rows, tmp_path, made):
    df = spark.createDataFrame(rows, SCHEMA)
    for part in ([0, 1, 2], [3, 4, 5]):
        streams.written_in_batches(df, "batch", part, str(tmp_path / "in"))
        out = streams.run_to_end(made(streams.from_batches(df, "batch", str(tmp_path / "in"))), str(tmp_path / "out"))
    return out.collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_distinct_forgets_and_drops_late(spark, tmp_path, seed):
    rows, seen = [], set()
    for r in _rows(seed):  # one row a key and batch, so that it's determined which one is the first
        if (r[0], r[2]) not in seen:
            seen.add((r[0], r[2]))
            rows.append(r)
    marks, delay = _marks(rows, 12), dt.timedelta(hours=12)
    late, state, want = _late(marks), {}, []
    for b in range(6):
        for _, t, k, *_ in (r for r in rows if r[0] == b):
            if (late[b] is None or t > late[b]) and k not in state:
                state[k] = t + delay
                want.append(k)
        for mark in (marks[b], marks[b + 1] if b in (2, 5) else None):
            state = {k: e for k, e in state.items() if mark is None or e > mark}
    got = _run(spark, rows, tmp_path, lambda s: streams.distinct_events(s, ["k"], "ts", "12 hours").select("k"))
    assert sorted(r.k for r in got) == sorted(want) and len(want) > 4


@pytest.mark.parametrize("seed", [3, 4])
def test_windows_drop_late_rows(spark, tmp_path, seed):
    rows = _rows(seed)
    marks, day = _marks(rows, 24), dt.timedelta(days=1)
    late, counts = _late(marks), {}
    for b, t, *_ in rows:
        start = T0 + (t - T0) // day * day
        if late[b] is None or start + day > late[b]:
            counts[start] = counts.get(start, 0) + 1
    got = {r.start: r.n for r in _run(spark, rows, tmp_path, lambda s: streams.windowed_rate(s.withColumn("ok", F.lit(True)), "ts", "ok"))}
    assert got == {s: n for s, n in counts.items() if s + day <= marks[6]}


@pytest.mark.parametrize("seed", [5, 6])
def test_best_so_far_goes_on_and_forgets(spark, tmp_path, seed):
    rows = _rows(seed)
    idle = dt.timedelta(hours=10)
    marks = _marks(rows, 6)
    late, state, want = _late(marks), {}, []
    for b in range(6):
        fresh = set()
        for k in "abcd":
            own = [r for r in rows if r[0] == b and r[2] == k and (late[b] is None or r[1] > late[b])]
            if not own:
                continue
            fresh.add(k)
            before = state.get(k)
            best = min([(-s, a) for *_, a, s in own] + ([(-before[1], before[0])] if before else []))
            last = max([t for _, t, *_ in own] + ([before[2]] if before else []))
            ends = max(last + idle, marks[b] + dt.timedelta(milliseconds=1)) if marks[b] else last + idle
            state[k] = (best[1], -best[0], last, ends)
            if before is None or before[:2] != state[k][:2]:
                want.append((k, *state[k][:2]))
        state = {k: v for k, v in state.items() if k in fresh or marks[b] is None or v[3] >= marks[b]}
        if b in (2, 5):
            state = {k: v for k, v in state.items() if v[3] >= marks[b + 1]}
    got = _run(spark, rows, tmp_path, lambda s: streams.best_so_far(s, "k", "attempt", "score", "ts", "6 hours", int(idle.total_seconds() * 1000)))
    assert sorted((r.k, r.attempt, r.score) for r in got) == sorted(want)
