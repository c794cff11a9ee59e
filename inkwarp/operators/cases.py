"""Declared cases: small texts with what an operator must say of them. Cases of a kind that share their options run as one table."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarp.operators.gate import compare_candidates, style_gate
from inkwarp.operators.ledger import build_ledger, coverage, reconcile
from inkwarp.operators.markdown import HOLD
from inkwarp.operators.rules import KOREAN, validate_allowances
from inkwarp.operators.scan import rule_counts, scan
from inkwarp.operators.strength import strength_status
from inkwarp.operators.terms import DONE, term_rollup, term_scopes, term_status, validate_terms
from inkwarp.sources.documents import manifest

STRENGTHS = "pair_id string, id string, policy string, baseline_text string, candidate_text string, position string, function string, surface_cost string, risk_if_smoothed string, review string, reviewer_note string"
SEQUENCES = "pair_id string, id string, baseline_anchors array<string>, candidate_anchors array<string>, function string, review string, reviewer_note string, compression_review string, compression_note string"
ALONE = ("glossary", "index")
_PATHS = ("before", "after")
_DOCUMENTS = ("allow_profile", "term_map", "ledger")

Found = dict[str, list[str]]


def read_cases(folder: str) -> list[dict]:
    """The ``*.json`` cases of a folder in the order of their names; texts and maps named in them are read from beside them."""
    out = []
    for name in sorted(n for n in os.listdir(folder) if n.endswith(".json")):
        with open(f"{folder}/{name}", encoding="utf-8") as f:
            case = json.load(f)
        if not isinstance(case, dict) or "kind" not in case:
            continue  # a map or profile that a case names

        def beside(path: str) -> str:
            with open(f"{folder}/{path}", encoding="utf-8") as f:
                return f.read()

        case |= {k: beside(case[k]) for k in _PATHS if k in case} | {k: json.loads(beside(case[k])) for k in _DOCUMENTS if case.get(k)}
        if "candidates" in case:
            case["candidates"] = {n: beside(p) for n, p in case["candidates"].items()}
        if "manifest" in case:
            case["manifest"] = f"{folder}/{case['manifest']}"
        out.append({"name": name} | case)
    return out


def _origin(c: dict) -> dict:
    return {"translation_source": bool(c.get("translation_source")), "provenance": c.get("provenance", "unknown")}


def _allow(c: dict):
    return validate_allowances(c.get("allow_profile"), {r.id for r in KOREAN})


def _alike(cases: Iterable[dict], *keys: str) -> list[list[dict]]:
    """Cases in groups that agree in the origin, the allowances and ``keys``."""
    groups: dict[str, list[dict]] = {}
    for c in cases:
        groups.setdefault(json.dumps([_origin(c), c.get("allow_profile"), [c.get(k) for k in keys]], sort_keys=True), []).append(c)
    return list(groups.values())


def _count_faults(c: dict, active: dict[str, int], allowed: dict[str, int]) -> list[str]:
    low = [f"{r}: {n} or more expected, {active.get(r, 0)} found" for r, n in c.get("minimum_counts", {}).items() if active.get(r, 0) < n]
    low += [f"{r}: {n} or more allowed ones expected, {allowed.get(r, 0)} found" for r, n in c.get("minimum_allowed_counts", {}).items() if allowed.get(r, 0) < n]
    return low + [f"{r}: none expected, {active[r]} found" for r in c.get("absent_rules", []) if active.get(r)]


def _scans(spark: SparkSession, cases: list[dict]) -> Found:
    out: Found = {}
    for group in _alike(cases):
        documents = spark.createDataFrame([(c["name"], c["before"]) for c in group], "document_id string, text string")
        counts: dict[str, tuple[dict, dict]] = {c["name"]: ({}, {}) for c in group}
        for r in rule_counts(scan(documents, KOREAN, allow=_allow(group[0]), **_origin(group[0])), ("document_id", "rule_id")).collect():
            counts[r.document_id][0][r.rule_id] = r.active_count
            counts[r.document_id][1][r.rule_id] = r.allowed_count
        out |= {c["name"]: _count_faults(c, *counts[c["name"]]) for c in group}
    return out


def _manifests(spark: SparkSession, cases: list[dict]) -> Found:
    out: Found = {}
    for c in cases:
        included, excluded = manifest(spark, c["manifest"])
        counts = {r.rule_id: r for r in rule_counts(scan(included, KOREAN, allow=_allow(c), **_origin(c))).collect()}
        sizes = {"scanned": included.count(), "excluded": excluded.count()}
        out[c["name"]] = [f"{n} {what} documents, not {c[f'expected_{what}']}" for what, n in sizes.items() if n != c[f"expected_{what}"]] + _count_faults(c, {k: r.active_count for k, r in counts.items()}, {k: r.allowed_count for k, r in counts.items()})
    return out


def _status(cases: Iterable[dict], got: dict[str, str]) -> Found:
    return {c["name"]: [] if got.get(c["name"]) == c["expected_status"] else [f"status {got.get(c['name'])}, not {c['expected_status']}"] for c in cases}


def _gates(spark: SparkSession, cases: list[dict]) -> Found:
    out: Found = {}
    for group in _alike(cases, "target_rules", "preserved_rules"):
        c = group[0]
        pairs = spark.createDataFrame([(x["name"], "after", x["before"], x["after"]) for x in group], "pair_id string, candidate string, before string, after string")
        gates = style_gate(pairs, c.get("target_rules", []), c.get("preserved_rules", []), allow=_allow(c), **_origin(c))
        out |= _status(group, {r.pair_id: r.status for r in gates.collect()})
    return out


def _comparisons(spark: SparkSession, cases: list[dict]) -> Found:
    out: Found = {}
    for group in _alike(cases, "target_rules"):
        pairs = spark.createDataFrame([(c["name"], n, c["before"], t) for c in group for n, t in c["candidates"].items()], "pair_id string, candidate string, before string, after string")
        got = {r.pair_id: r.eligible_candidates for r in compare_candidates(pairs, group[0].get("target_rules", []), **_origin(group[0]))[1].collect()}
        out |= {c["name"]: [] if got[c["name"]] == sorted(c["eligible_candidates"]) else [f"eligible {got[c['name']]}, not {sorted(c['eligible_candidates'])}"] for c in group}
    return out


def _coverages(spark: SparkSession, cases: list[dict]) -> Found:
    out: Found = {}
    for c in cases:
        ledger = build_ledger(scan(spark.createDataFrame([(c["name"], c["before"])], "document_id string, text string"), KOREAN, **_origin(c)))
        reviewed = ledger.withColumn("review_method", F.lit(c.get("review_method", "unreviewed"))).withColumn("verdict", F.lit(c.get("verdict", "unreviewed")))
        got = coverage(reconcile(ledger, reviewed), c["mode"]).first()
        out |= _status([c], {c["name"]: got.status})
        out[c["name"]] += [f"claim not forbidden: {x}" for x in c.get("expected_forbidden_claims", []) if x not in got.forbidden_claims]
    return out


def _migrations(spark: SparkSession, cases: list[dict]) -> Found:
    out: Found = {}
    for c in cases:
        terms = validate_terms(c["term_map"])
        scopes = sorted({s for t in terms for s in t.scope})
        together = [s for s in scopes if s not in ALONE]
        rows = [("single-input", xs, c["before"], c["after"]) for xs in ([together] if together else []) + [[s] for s in scopes if s in ALONE]]
        documents = spark.createDataFrame(rows, "document_id string, scopes array<string>, before string, after string")
        rollup = term_rollup(term_scopes(documents, terms))
        status = term_status(documents, terms, rollup).collect()
        sums = rollup.where("level = 7").first()
        residues, echoes = (sums.residue_count, sums.echo_count) if sums else (0, 0)
        out |= _status([c], {c["name"]: HOLD if any(r.status == HOLD for r in status) else DONE})
        if residues != c.get("expected_residue_count", 0):
            out[c["name"]].append(f"{residues} residues, not {c.get('expected_residue_count', 0)}")
        if echoes < c.get("minimum_echo_candidates", 0):
            out[c["name"]].append(f"{echoes} echoes, fewer than {c['minimum_echo_candidates']}")
    return out


def strengths_of(spark: SparkSession, cases: list[dict]) -> DataFrame:
    """The strength status of cases with name, before, after and a ledger of strengths and sequences; pair_id is the name."""
    names = lambda schema: [c.split()[0] for c in schema.split(", ")][1:]
    rows = lambda part, schema: [(c["name"], *(e.get(n) for n in names(schema))) for c in cases for e in c["ledger"].get(part, [])]
    pairs = spark.createDataFrame([(c["name"], c["before"], c["after"]) for c in cases], "pair_id string, baseline string, candidate string")
    return strength_status(pairs, spark.createDataFrame(rows("strengths", STRENGTHS), STRENGTHS), spark.createDataFrame(rows("sequences", SEQUENCES), SEQUENCES))


def _strengths(spark: SparkSession, cases: list[dict]) -> Found:
    return _status(cases, {r.pair_id: r.status for r in strengths_of(spark, cases).collect()})


KINDS: dict[str, Callable[[SparkSession, list[dict]], Found]] = {"scan": _scans, "manifest": _manifests, "gate": _gates, "comparison": _comparisons, "coverage": _coverages, "term_migration": _migrations, "strength_ledger": _strengths}


def run_cases(spark: SparkSession, cases: list[dict]) -> DataFrame:
    """case, kind, status ('passed' or 'failed') and failures of every case; one of an unknown kind fails."""
    faults: Found = {}
    for kind, run in KINDS.items():
        if mine := [c for c in cases if c["kind"] == kind]:
            faults |= run(spark, mine)
    rows = [(c["name"], c["kind"], faults.get(c["name"], [f"unknown kind {c['kind']}"])) for c in cases]
    return spark.createDataFrame([(n, k, "failed" if f else "passed", f) for n, k, f in rows], "case string, kind string, status string, failures array<string>")
