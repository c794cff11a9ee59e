"""Command line: ``python -m inkwarp COMMAND ...``; prints a JSON receipt. Exit code 0: done or passed, 2: held, 1: not valid."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwarp.functions.spans import MARKER, lost_values
from inkwarp.operators.edits import measure_edits
from inkwarp.operators.gate import compare_candidates, style_gate
from inkwarp.operators.iterations import iteration_audit
from inkwarp.operators.ledger import MODES, build_ledger, coverage, reconcile
from inkwarp.operators.markdown import HOLD, changed_keys
from inkwarp.operators.rules import KOREAN, PROVENANCES, gate_rules, scope_warning, validate_allowances, validate_rules
from inkwarp.operators.scan import LIMIT, cross_document_repeats, distribution_maps, document_receipts, ordered, paragraph_rhythm, rule_counts, scan, sentence_clusters
from inkwarp.operators.biblio import by_year, first_by_key, languages, summary, topic_signals
from inkwarp.operators.cases import read_cases, run_cases, strengths_of
from inkwarp.operators.terms import audit_uses, term_rollup, term_scopes, term_status, validate_senses, validate_terms
from inkwarp.session import local_session
from inkwarp.sources.documents import allow_profile, manifest, one_text, pair_manifest, protect_list, read_ledger, write_ledger
from inkwarp.sources.docx import format_findings, read_docx
from inkwarp.sources.harvest import read_runs


def _rows(df: DataFrame) -> list:
    return [json.loads(r.j) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _pair(spark, before: str, *after: tuple[str, str]) -> DataFrame:
    return spark.createDataFrame([("pair", n, _read(before), _read(p)) for n, p in after], "pair_id string, candidate string, before string, after string")


def _extra(spark, a) -> list[str] | None:
    return protect_list(spark, a.protect_file) if a.protect_file else None


def _scan(spark, a) -> dict:
    if sum(x is not None for x in (a.input, a.text, a.manifest)) != 1:
        raise ValueError("give one of --input, --text and --manifest")
    allow = validate_allowances(allow_profile(a.allow_profile) if a.allow_profile else None, {r.id for r in KOREAN})
    excluded = []
    if a.manifest:
        documents, left = manifest(spark, a.manifest)
        excluded = _rows(left)
    else:
        documents = one_text(spark, a.text if a.text is not None else _read(a.input))
    extra = _extra(spark, a)
    _, skipped = gate_rules(KOREAN, a.translation_source, a.provenance)
    found = scan(documents, KOREAN, translation_source=a.translation_source, provenance=a.provenance, extra=extra, allow=allow, marker=a.marker).cache()
    active = found.where("not allowed")
    return {
        "kind": "style-candidate-scan", "provenance": a.provenance, "skipped_rules": [{"rule_id": i, "reason": r} for i, r in skipped], "scope_warnings": scope_warning(skipped),
        "documents_scanned": _rows(document_receipts(documents, found, extra=extra, marker=a.marker)), "documents_excluded": excluded, "counts": _rows(rule_counts(found)), "rule_distribution": _rows(distribution_maps(active, 1000)),
        "cross_document_repeats": _rows(cross_document_repeats(active)), "per_sentence_rule_distribution": _rows(sentence_clusters(active)), "paragraph_rhythm": _rows(paragraph_rhythm(documents)), "findings": _rows(ordered(found)), "limit": LIMIT,
    }


def _protected(spark, a) -> dict:
    lost = _rows(lost_values(_pair(spark, a.before, ("after", a.after)), ["pair_id"], extra=_extra(spark, a), marker=a.marker))
    return {"kind": "protected-values", "status": HOLD if lost else "통과", "missing": lost}


def _gate(spark, a) -> dict:
    names = [c.partition("=") for c in a.candidate]
    if any(not n or not p for n, _, p in names) or len({n for n, _, _ in names}) < len(names):
        raise ValueError("candidates are NAME=PATH with distinct names")
    pairs = _pair(spark, a.before, *[(n, p) for n, _, p in names])
    allow = validate_allowances(allow_profile(a.allow_profile) if a.allow_profile else None, {r.id for r in KOREAN})
    gates = _rows(style_gate(pairs, a.target_rule, a.preserve_rule, KOREAN, allow, _extra(spark, a), translation_source=a.translation_source, provenance=a.provenance))
    sizes = _rows(measure_edits(pairs, ["pair_id", "candidate"]))
    return {"kind": "style-gate", "status": HOLD if all(g["status"] == HOLD for g in gates) else "통과", "candidates": gates, "edit_measurements": sizes}


def _measure(spark, a) -> dict:
    return {"kind": "edit-measurement", **_rows(measure_edits(_pair(spark, a.before, ("after", a.after)), ["pair_id"]))[0]}


def _iterations(spark, a) -> dict:
    rows = [("chain", 0, "baseline", _read(a.baseline))] + [("chain", i, p, _read(p)) for i, p in enumerate(a.version, 1)]
    versions, chains = iteration_audit(spark.createDataFrame(rows, "chain_id string, ord int, label string, text string"))
    return {"kind": "iteration-audit", **_rows(chains)[0], "rows": _rows(versions.orderBy("ord"))}


def _ledger(spark, a) -> dict:
    write_ledger(build_ledger(scan(one_text(spark, _read(a.input)), KOREAN, provenance=a.provenance)), a.ledger)
    return {"kind": "review-ledger", "path": a.ledger}


def _coverage(spark, a) -> dict:
    expected = build_ledger(scan(one_text(spark, _read(a.input)), KOREAN, provenance=a.provenance))
    states = reconcile(expected, read_ledger(spark, a.ledger))
    return {"kind": "review-coverage", **_rows(coverage(states, a.mode))[0], "open": _rows(states.where("state not in ('human', 'reviewed')"))}


def _terms(spark, a) -> dict:
    terms, documents = validate_terms(json.loads(_read(a.map))), pair_manifest(spark, a.manifest)
    scopes = term_scopes(documents, terms)
    status = _rows(term_status(documents, terms, term_rollup(scopes)))
    return {"kind": "term-migration-audit", "status": HOLD if any(s["status"] == HOLD for s in status) else "기계 확인 완료", "terms": status, "scopes": _rows(scopes)}


def _senses(spark, a) -> dict:
    uses, terms = audit_uses(pair_manifest(spark, a.manifest), validate_senses(json.loads(_read(a.map))))
    status = _rows(terms)
    return {"kind": "selective-terminology-audit", "status": HOLD if any(s["status"] == HOLD for s in status) else "기계 확인 완료", "terms": status, "occurrences": _rows(uses)}


def _markdown(spark, a) -> dict:
    changed = _pair(spark, a.before, ("after", a.after)).select(changed_keys(F.col("before"), F.col("after")).alias("c")).first().c
    return {"kind": "markdown-structure", "status": HOLD if changed else "통과", "changed": changed}


def _comparison(spark, a) -> dict:
    names = [c.partition("=") for c in a.candidate]
    if any(not n or not p for n, _, p in names):
        raise ValueError("candidates are NAME=PATH")
    each, whole = compare_candidates(_pair(spark, a.before, *[(n, p) for n, _, p in names]), a.target_rule, extra=_extra(spark, a), translation_source=a.translation_source, provenance=a.provenance)
    return {"kind": "candidate-comparison", **_rows(whole)[0], "candidates": _rows(each)}


def _strengths(spark, a) -> dict:
    case = {"name": "pair", "before": _read(a.before), "after": _read(a.after), "ledger": json.loads(_read(a.ledger))}
    return {"kind": "strength-verification", **_rows(strengths_of(spark, [case]))[0]}


def _cases(spark, a) -> dict:
    rows = [r for folder in a.folder for r in _rows(run_cases(spark, read_cases(folder)))]
    return {"kind": "cases", "status": HOLD if any(r["status"] == "failed" for r in rows) else "통과", "cases": rows}


def _bibliography(spark, a) -> dict:
    records = first_by_key(read_runs(spark, a.records), ["run_id"])
    return {"kind": "bibliography", **_rows(summary(records))[0], "years": _rows(by_year(records)), "topics": _rows(topic_signals(records)), "title_languages": _rows(languages(records, "titles")), "abstract_languages": _rows(languages(records, "abstracts"))}


def _docx(spark, a) -> dict:
    return {"kind": "docx-format-candidate-scan", "findings": _rows(format_findings(read_docx(spark, a.input)))}


def _rules(spark, a) -> dict:
    return {"kind": "rules", "rules": [vars(r) for r in validate_rules(KOREAN)]}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="inkwarp", description=__doc__)
    top.add_argument("--output", help="file for the receipt")
    top.add_argument("--marker", default=MARKER, help="name in the comments that mark protected blocks")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name, fn, *needed, optional=()):
        p = commands.add_parser(name)
        p.set_defaults(fn=fn)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        for n in optional:
            p.add_argument(f"--{n}")
        return p

    def origin(p):
        p.add_argument("--translation-source", action="store_true")
        p.add_argument("--provenance", default="unknown", choices=PROVENANCES)

    origin(add("scan", _scan, optional=("input", "text", "manifest", "protect-file", "allow-profile")))
    add("protected", _protected, "before", "after", optional=("protect-file",))
    g = add("gate", _gate, "before", optional=("protect-file", "allow-profile"))
    origin(g)
    g.add_argument("--candidate", action="append", required=True)
    g.add_argument("--target-rule", action="append", default=[])
    g.add_argument("--preserve-rule", action="append", default=[])
    add("measure", _measure, "before", "after")
    add("iterations", _iterations, "baseline").add_argument("--version", action="append", required=True)
    origin(add("ledger", _ledger, "input", "ledger"))
    c = add("coverage", _coverage, "input", "ledger")
    origin(c)
    c.add_argument("--mode", required=True, choices=MODES)
    add("terms", _terms, "manifest", "map")
    add("senses", _senses, "manifest", "map")
    add("markdown", _markdown, "before", "after")
    k = add("comparison", _comparison, "before", optional=("protect-file",))
    origin(k)
    k.add_argument("--candidate", action="append", required=True)
    k.add_argument("--target-rule", action="append", default=[])
    add("strengths", _strengths, "before", "after", "ledger")
    add("cases", _cases).add_argument("--folder", action="append", required=True)
    add("bibliography", _bibliography, "records")
    add("docx", _docx, "input")
    add("rules", _rules)
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    spark = spark or local_session(memory="2g")
    try:
        receipt = a.fn(spark, a)
    except (ValueError, OSError) as e:
        print(f"not valid: {e}", file=sys.stderr)
        return 1
    text = json.dumps(receipt, ensure_ascii=False, indent=2) + "\n"
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text, end="")
    return 2 if receipt.get("status") in (HOLD, "사람 검토") else 0


if __name__ == "__main__":
    sys.exit(main())
