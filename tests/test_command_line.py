import json

from inkwarp.__main__ import main


def test_commands(spark, tmp_path, capsys):
    a, b, out = tmp_path / "a.md", tmp_path / "b.md", str(tmp_path / "r.json")
    a.write_text("# 제목\n\n첫째 12명이다.", encoding="utf-8")
    b.write_text("# 제목\n\n그리고 12명이다.", encoding="utf-8")

    def run(*args, code=0):
        assert main(["--output", out, *args], spark) == code
        return json.loads(open(out, encoding="utf-8").read())

    got = run("scan", "--input", str(a))
    assert [f["rule_id"] for f in got["findings"]] == ["KH-S03"] and len(got["skipped_rules"]) == 5
    assert run("gate", "--before", str(a), "--candidate", f"b={b}", "--target-rule", "KH-S03")["status"] == "통과"
    assert run("gate", "--before", str(a), "--candidate", f"a={a}", "--target-rule", "KH-S03", code=2)["status"] == "보류"
    assert run("measure", "--before", str(a), "--after", str(b))["comparison_method"] == "character-sequence"
    assert run("protected", "--before", str(a), "--after", str(b))["missing"] == []
    assert run("markdown", "--before", str(a), "--after", str(b))["changed"] == []
    assert run("iterations", "--baseline", str(a), "--version", str(b), "--version", str(a), code=2)["oscillations"] == 1
    run("ledger", "--input", str(a), "--ledger", str(tmp_path / "l"))
    assert run("coverage", "--input", str(a), "--ledger", str(tmp_path / "l"), "--mode", "residual", code=2)["anchors_unresolved"] == 1
    assert len(run("rules")["rules"]) == 26
    assert run("comparison", "--before", str(a), "--candidate", f"a={a}", "--candidate", f"b={b}", "--target-rule", "KH-S03")["eligible_candidates"] == ["b"]
    assert main(["comparison", "--before", str(a), "--candidate", f"a={a}"], spark) == 1
    (tmp_path / "s.json").write_text(json.dumps({"strengths": [{"id": "s", "policy": "exact", "baseline_text": "첫째", "position": "p", "function": "f", "surface_cost": "c", "risk_if_smoothed": "r"}]}), encoding="utf-8")
    assert run("strengths", "--before", str(a), "--after", str(b), "--ledger", str(tmp_path / "s.json"), code=2)["failures"] == 1
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.json").write_text(json.dumps({"kind": "scan", "before": "../a.md", "minimum_counts": {"KH-S03": 2}}), encoding="utf-8")
    assert run("cases", "--folder", str(tmp_path / "c"), code=2)["cases"][0]["status"] == "failed"
    assert main(["scan"], spark) == 1 and main(["scan", "--input", str(tmp_path / "none")], spark) == 1
    assert main(["rules"], spark) == 0 and "KH-S01" in capsys.readouterr().out
