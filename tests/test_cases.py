"""Declared cases of every kind, with texts written for them; each is one parametrised test."""

import json

import pytest

from inkwarp.operators.cases import read_cases, run_cases

PASS, HOLD, DONE, HUMAN = "통과", "보류", "기계 확인 완료", "사람 판정 기록"
BEFORE = "# 제목\n\n첫째 3명이 2024-05-06에 왔다. “그대로 둔다”라고 적었다. 제3조를 본다."
TERM = {"id": "t", "old": ["경기"], "new": "시합 규칙", "scope": ["body"], "rationale": "한 낱말"}


def _map(**more):
    return {"schema_version": "0.1", "terms": [TERM | more]}


def _strength(policy="exact", text="첫째 3명", **more):
    return {"id": "s", "policy": policy, "baseline_text": text, "position": "처음", "function": "연다", "surface_cost": "없음", "risk_if_smoothed": "흐려짐"} | more


def _sequence(**more):
    return {"id": "q", "baseline_anchors": ["첫째", "제3조"], "candidate_anchors": ["첫째", "제3조"], "function": "차례", "review": "preserved", "reviewer_note": "읽음"} | more


HEADING = {"genre": "글", "allow": [{"rule_id": "KH-S03", "scope": "heading", "reason": "제목"}]}
CASES = {
    "expanded": {"kind": "scan", "before": "결론적으로 첫째는 아니라 둘째다. 또한 이를 통해 볼 수 있다.", "minimum_counts": {"KH-S02": 1, "KH-S03": 2, "KH-S04": 1, "KH-S12": 1}, "absent_rules": ["KH-S08"]},
    "word-boundary": {"kind": "scan", "before": "이것은 아니라고 한다. 말다만 하다. 뒤즉흥 연주다.", "absent_rules": ["KH-S01", "KH-S04"]},
    "run": {"kind": "scan", "before": "길을 간다. 밥을 먹습니다. 물이 있습니다. 산이 높습니다. 끝.", "minimum_counts": {"KH-S08": 1}},
    "run-parted": {"kind": "scan", "before": "밥을 먹습니다. 물이 있습니다. <!-- inkwarp:protect-start -->산이 높습니다.<!-- inkwarp:protect-end --> 강이 깁니다.", "absent_rules": ["KH-S08"]},
    "translation": {"kind": "scan", "before": "그에 의해 되었다.", "translation_source": True, "minimum_counts": {"KH-S06": 1}},
    "no-translation": {"kind": "scan", "before": "그에 의해 되었다.", "absent_rules": ["KH-S06"]},
    "allow-heading": {"kind": "scan", "before": "# 첫째\n\n둘째다.", "allow_profile": HEADING, "minimum_counts": {"KH-S03": 1}, "minimum_allowed_counts": {"KH-S03": 1}},
    "masked": {"kind": "scan", "before": "```\n첫째\n```\n\n<!-- 둘째 -->\n\n> 셋째\n\n“넷째”", "absent_rules": ["KH-S03"]},
    "edited-only": {"kind": "scan", "before": "이 장은 차를 다룬다.\n\n답은 분명하다.", "absent_rules": ["KH-S34", "KH-S36"]},
    "edited": {"kind": "scan", "before": "이 장은 차를 다룬다.\n\n답은 분명하다.", "provenance": "ai_edited", "minimum_counts": {"KH-S34": 1, "KH-S36": 1}},
    "guided": {"kind": "scan", "before": "이 장은 차를 다룬다.", "provenance": "rule_guided_draft", "minimum_counts": {"KH-S34": 1}},
    "labels": {"kind": "scan", "provenance": "ai_edited", "before": "**물**을 본다.\n\n**불**을 본다.\n\n**흙**을 본다.", "minimum_counts": {"KH-S37": 1}},
    "navigation-labels": {"kind": "scan", "provenance": "ai_edited", "before": "**1장** 본다.\n\n**2장** 본다.\n\n**3장** 본다.", "absent_rules": ["KH-S37"]},
    "triads": {"kind": "scan", "before": "길을 걷고, 물을 마시며, 산을 본다. “먹고, 자며, 논다.”", "minimum_counts": {"KH-S40": 1}},
    "manifest": {"kind": "manifest", "before": "x", "manifest": {"a": "첫째다.", "b": "둘째다.", "-c": "셋째다."}, "expected_scanned": 2, "expected_excluded": 1, "minimum_counts": {"KH-S03": 2}},
    "safe": {"kind": "gate", "before": BEFORE, "after": BEFORE.replace("첫째", "먼저"), "target_rules": ["KH-S03"], "expected_status": PASS},
    **{f"lost-{k}": {"kind": "gate", "before": BEFORE, "after": BEFORE.replace("첫째", "먼저").replace(v, ""), "target_rules": ["KH-S03"], "expected_status": HOLD} for k, v in {"date": "2024-05-06", "statute": "제3조", "number": "3명", "quotation": "“그대로 둔다”"}.items()},
    "no-op": {"kind": "gate", "before": BEFORE, "after": BEFORE, "target_rules": ["KH-S03"], "expected_status": HOLD},
    "introduced": {"kind": "gate", "before": BEFORE, "after": BEFORE.replace("첫째", "또한"), "target_rules": ["KH-S03"], "expected_status": HOLD},
    "preserved": {"kind": "gate", "before": BEFORE, "after": BEFORE, "target_rules": ["KH-S03"], "preserved_rules": ["KH-S03"], "expected_status": PASS},
    "preserved-unknown": {"kind": "gate", "before": BEFORE, "after": BEFORE, "target_rules": ["KH-S03"], "preserved_rules": ["KH-S03", "KH-S99"], "expected_status": HOLD},
    "preserved-absent": {"kind": "gate", "before": BEFORE, "after": BEFORE, "target_rules": ["KH-S02"], "preserved_rules": ["KH-S02"], "expected_status": HOLD},
    "comparison": {"kind": "comparison", "before": BEFORE, "candidates": {"one": BEFORE.replace("첫째", "먼저"), "two": BEFORE, "three": BEFORE.replace("첫째 3명", "먼저 몇")}, "target_rules": ["KH-S03"], "eligible_candidates": ["one"]},
    "unresolved": {"kind": "coverage", "before": "첫째", "mode": "residual", "expected_status": HOLD},
    "residual": {"kind": "coverage", "before": "첫째", "mode": "residual", "review_method": "mechanical", "verdict": "preserve", "expected_status": PASS, "expected_forbidden_claims": ["모든 용례를 읽음"]},
    "exhaustive-mechanical": {"kind": "coverage", "before": "첫째", "mode": "exhaustive", "review_method": "mechanical", "verdict": "preserve", "expected_status": HOLD},
    "exhaustive": {"kind": "coverage", "before": "첫째", "mode": "exhaustive", "review_method": "human", "verdict": "edit", "expected_status": PASS},
    "migrated": {"kind": "term_migration", "before": "경기를 본다.", "after": "시합 규칙을 본다.", "term_map": _map(), "expected_status": DONE},
    "echo": {"kind": "term_migration", "before": "경기 시합 규칙이다.", "after": "시합 규칙의 시합과 규칙과 시합 규칙이다.", "term_map": _map(), "expected_status": DONE, "minimum_echo_candidates": 2},
    "residue": {"kind": "term_migration", "before": "경기와 경기다.", "after": "시합 규칙과 경기다.", "term_map": _map(), "expected_status": HOLD, "expected_residue_count": 1},
    "gap": {"kind": "term_migration", "before": "경기와 시합 규칙이다.", "after": "시합 규칙이다.", "term_map": _map(), "expected_status": HOLD},
    "quoted-and-excepted": {"kind": "term_migration", "before": "“경기”와 경기다.", "after": "“경기”와 경기다.", "term_map": _map(exceptions=[{"text": "경기", "reason": "이름", "document_id": "single-input", "scope": "body", "line": 1, "occurrence": 2}]), "expected_status": DONE},
    "kept": {"kind": "strength_ledger", "before": BEFORE, "after": BEFORE, "ledger": {"strengths": [_strength()]}, "expected_status": DONE},
    "lost": {"kind": "strength_ledger", "before": BEFORE, "after": BEFORE.replace("첫째", "먼저"), "ledger": {"strengths": [_strength()]}, "expected_status": HOLD},
    "functional": {"kind": "strength_ledger", "before": BEFORE, "after": BEFORE.replace("첫째", "먼저"), "ledger": {"strengths": [_strength("functional", candidate_text="먼저 3명", review="preserved", reviewer_note="읽음")]}, "expected_status": HUMAN},
    "ask": {"kind": "strength_ledger", "before": BEFORE, "after": BEFORE, "ledger": {"strengths": [_strength("ask")]}, "expected_status": HOLD},
    "order": {"kind": "strength_ledger", "before": BEFORE, "after": BEFORE, "ledger": {"sequences": [_sequence()]}, "expected_status": HUMAN},
    "reversed": {"kind": "strength_ledger", "before": BEFORE, "after": BEFORE, "ledger": {"sequences": [_sequence(candidate_anchors=["제3조", "첫째"])]}, "expected_status": HOLD},
    "unheard-of": {"kind": "odd", "before": "x"},
}


@pytest.fixture(scope="module")
def outcome(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cases")

    def put(name, what):
        (folder / name).write_text(what if isinstance(what, str) else json.dumps(what, ensure_ascii=False), encoding="utf-8")
        return name

    for name, case in CASES.items():
        case = dict(case)
        for k in ("before", "after"):
            if k in case:
                case[k] = put(f"{name}.{k}.md", case[k])
        for k in ("allow_profile", "term_map", "ledger"):
            if k in case:
                case[k] = put(f"{name}.{k}.part", case[k])
        if "candidates" in case:
            case["candidates"] = {n: put(f"{name}.{n}.md", t) for n, t in case["candidates"].items()}
        if "manifest" in case:
            rows = [{"id": n, "path": put(f"{name}.{n}.md", t), "include": not n.startswith("-")} for n, t in case["manifest"].items()]
            case["manifest"] = put(f"{name}.list", {"documents": rows})
        put(f"{name}.json", case)
    put("no-case.json", {"terms": []})
    return {r.case: r for r in run_cases(spark, read_cases(str(folder))).collect()}


@pytest.mark.parametrize("name", [n for n in CASES if n != "unheard-of"])
def test_case(outcome, name):
    assert outcome[f"{name}.json"].failures == []


def test_failures_are_told(spark, outcome):
    assert outcome["unheard-of.json"].status == "failed" and "no-case.json" not in outcome
    wrong = [{"name": "a"} | CASES["masked"] | {"minimum_counts": {"KH-S03": 1}}, {"name": "b"} | CASES["safe"] | {"expected_status": HOLD}]
    assert [len(r.failures) for r in run_cases(spark, wrong).collect()] == [1, 1]
