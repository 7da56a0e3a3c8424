"""Records batch by batch against a kept index, and objects of unlike shapes."""

from __future__ import annotations

import random
import re

import pytest

from verigate.operators.dedup import KeptIndex
from verigate.sources import documents as D


def _texts(seed, n=60):
    r = random.Random(seed)
    bases = [[f"w{r.randrange(400)}" for _ in range(60)] for _ in range(8)]
    texts = []
    for _ in range(n):
        own = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 3, 9])):
            own[r.randrange(60)] = f"z{r.randrange(10_000)}"
        texts.append(" ".join(own))
    return texts + ["", "", "lone word", "lone WORD"]


def _greedy(rows, threshold):
    kept = []
    for i, t in rows:
        s = set(re.findall("[a-z0-9_]+", t.lower()))
        if not s or not any(o and len(s & o) / len(s | o) >= threshold for _, o in kept):
            kept.append((i, s))
    return {i for i, _ in kept}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_one(spark, tmp_path, seed):
    rows = list(enumerate(_texts(seed)))
    df = spark.createDataFrame(rows, "id long, text string")
    whole = KeptIndex(spark, str(tmp_path / "one"), 0.9)
    one = {r.id for r in whole.add(df, "id", "text", 0).collect()}
    parts, index = set(), KeptIndex(spark, str(tmp_path / "three"), 0.9)
    for k, (lo, hi) in enumerate([(0, 20), (20, 21), (21, 100)]):
        batch = df.where(f"id >= {lo} and id < {hi}")
        again = {r.id for r in index.add(batch, "id", "text", k).collect()} if k == 2 else None
        own = {r.id for r in KeptIndex(spark, str(tmp_path / "three"), 0.9).add(batch, "id", "text", k).collect()}
        assert again is None or again == own  # a batch run again replaces its part
        parts |= own
    want = _greedy(rows, 0.9)
    assert one == parts
    missed = len(one - want) / max(1, len(rows) - len(want))
    assert not want - one and missed <= 0.1  # bands may miss a pair, likeness is exact
    kept = spark.read.parquet(str(tmp_path / "three" / "sets"))
    assert kept.count() == kept.select("node").distinct().count() == len([i for i in parts if rows[i][1]])


def test_empty_batch(spark, tmp_path):
    index = KeptIndex(spark, str(tmp_path / "i"), 0.9)
    empty = spark.createDataFrame([], "id long, text string")
    assert index.add(empty, "id", "text", 0).count() == 0
    assert index.add(spark.createDataFrame([(1, "a b c")], "id long, text string"), "id", "text", 1).count() == 1
    assert index.add(spark.createDataFrame([(2, "a b c")], "id long, text string"), "id", "text", 2).count() == 0


def test_defaults_and_errors_of_objects(spark, tmp_path):
    values = ['{"id": 7, "pov_tests": ["T#a"], "extra": {"x": 1}}', '{"id": "b", "project": "p", "source": "other", "pov_tests": null}', '{"project": "no id"}', "[1]", "{oops", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string")
    good = D.rows(D.objects(df, "value").where("i < 2"), D.BUG).collect()
    assert [tuple(r) for r in good] == [("7", "", "", "vul4j", "", ["T#a"], ""), ("b", "p", "", "other", "", [], "")]
    with pytest.raises(Exception, match="has no id"):
        D.rows(D.objects(df, "value").where("i = 2"), D.BUG).collect()
    for i, kind in ((3, "ARRAY"), (4, "isn't JSON"), (5, "isn't JSON")):
        with pytest.raises(Exception, match=kind):
            D.rows(D.objects(df, "value", strict=True).where(f"i = {i}"), D.RESULTS).collect()
    lenient = D.rows(D.objects(df, "value").where("i > 2"), D.RESULTS).collect()
    assert [tuple(r) for r in lenient] == [("", 0, 0, 0.0, 0.0, 0.0, [])] * 3
    patch = spark.createDataFrame([('{"bug_id": "x", "attempt": "3", "patched_code": "c"}',)], "value string")
    assert tuple(D.rows(D.objects(patch, "value"), D.PATCH).first()) == ("x", "", "c", "", 3)


def test_files_of_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "model_tag": "m",\n "n": 3, "overall": {"rate": 0.5}}')
    (tmp_path / "b.json").write_text("not json")
    got = {r.model_tag: (r.n, r.rate) for r in D.rows(D.read_objects(spark, str(tmp_path / "*.json")), D.RESULTS).collect()}
    assert got == {"m": (3, 0.5), "": (0, 0.0)}
    assert D.rows(D.read_objects(spark, str(tmp_path / "none.json")), D.RESULTS).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        D.read_objects(spark, str(tmp_path / "none.json"), strict=True).collect()
