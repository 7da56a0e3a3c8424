"""Runs from files to files."""

from __future__ import annotations

import json

from verigate.commands import main


def _lines(path):
    return [json.loads(line) for f in sorted(path.glob("*.json")) for line in f.read_text().splitlines()]


def test_prepare(spark, tmp_path, capsys):
    raw = tmp_path / "raw"
    raw.mkdir()
    good = [{"vuln_code": f"int f{i}() {{ return {i} + x{i}; }}", "fixed_code": f"int f{i}() {{ return safe({i}); }}", "cve": f"CVE-202{i}-11111", "date": f"202{i}-01-01", "project": f"p{i}"} for i in range(6)]
    (raw / "a.jsonl").write_text("\n".join([json.dumps(good[0]), "{broken", *map(json.dumps, good[1:4]), json.dumps(good[1] | {"date": "2029-01-01"})]))
    (raw / "b.json").write_text(json.dumps([good[4], good[5], 7, {"vuln_code": "only one side"}]))
    args = ["prepare", str(raw), "--out", str(tmp_path / "train"), "--eval-out", str(tmp_path / "eval"), "--cutoff", "2024-01-01"]
    assert main([*args, "--bad", str(tmp_path / "bad")]) == 0
    train, held = _lines(tmp_path / "train"), _lines(tmp_path / "eval")
    assert len(train) == 4 and len(held) == 2 and {e["meta"]["date"] for e in held} == {"2024-01-01", "2025-01-01"}
    assert {(b["source_file"], b["place"], b["problem"]) for b in _lines(tmp_path / "bad")} == {("a.jsonl", 2, "not JSON"), ("b.json", 3, "not an object")}
    said = capsys.readouterr().err
    assert "entries=10 problems=2 input=7 exact_dups=1 near_dups=0 kept=6 train=4 eval=2" in said
    assert main(args) == 0 and "a.jsonl:2: not JSON" in capsys.readouterr().err
    assert main(["prepare", str(tmp_path / "none"), "--out", str(tmp_path / "t"), "--eval-out", str(tmp_path / "e")]) == 1
    (tmp_path / "poor").mkdir()
    (tmp_path / "poor" / "x.jsonl").write_text('{"vuln_code": "a"}')
    assert main(["prepare", str(tmp_path / "poor"), "--out", str(tmp_path / "t"), "--eval-out", str(tmp_path / "e")]) == 1


def test_metrics(spark, tmp_path, capsys):
    flags = ["compiles", "regression_pass", "pov_flipped", "semgrep_clean", "codeql_clean", "not_deleted"]
    rows = [{"bug": {"id": f"VUL4J-{i}", "cwe": "CWE-89"}, "verdict": {f: i % 2 == 0 for f in flags}, "tag": "baseline" if i < 3 else "new"} for i in range(6)]
    (tmp_path / "r.json").write_text(json.dumps({"rows": rows}))
    assert main(["metrics", str(tmp_path / "r.json"), "--out", str(tmp_path / "out")]) == 0
    out = capsys.readouterr().out
    assert out.splitlines()[1].split()[:4] == ["overall", "6", "3", "50.0%"]
    assert json.loads(out[out.index("{") :])["new"]["n"] == 3
    assert {r["stratum"]: r["n"] for r in _lines(tmp_path / "out")}["overall"] == 6
    assert main(["metrics", str(tmp_path / "none.json")]) == 2


def test_pages(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.html").write_text('<html lang="en"><title>t</title><main><img><img></main></html>')
    (tmp_path / "in" / "sub" / "b.html").write_text('<html lang="en"><title>t</title><main></main></html>')
    assert main(["pages", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    got = {r["source"].rsplit("/", 1)[1]: (r["violationCount"], r["ruleCount"], r["byRule"]) for r in _lines(tmp_path / "out")}
    assert got == {"a.html": (2, 1, {"image-alt": 2}), "b.html": (0, 0, {})}
    assert main(["pages", str(tmp_path / "in"), str(tmp_path / "out"), "--rules", "nothing"]) == 1
    assert main(["pages", str(tmp_path / "none"), str(tmp_path / "out")]) == 2
