"""Rule packs as data: validation, gating, allow profiles. Small and on the driver; the scan compiles them to columns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from inkwarp.functions.offsets import valid_pattern

PROVENANCES = ("raw_ai", "ai_edited", "human_draft", "rule_guided_draft", "human_polished", "unknown")
ALLOW_SCOPES = ("all", "heading", "body", "first_sentence")
ANCHOR_TYPES = ("regex", "sentence_run", "structural", "triadic_chain")
STRUCTURAL_KINDS = ("meta_discourse", "return_signal", "advance_label", "emphasis_run")
RULE_ID = re.compile(r"KH-S\d{2}")


@dataclass(frozen=True)
class Rule:
    id: str
    anchor_type: str
    pattern: str | None = None
    structural_kind: str | None = None
    minimum_run: int | None = None
    requires: tuple[str, ...] = ()
    count_mode: str = "deterministic"
    disposition: str = "contextual"


@dataclass(frozen=True)
class Allowance:
    rule_id: str
    scope: str
    reason: str


# The Korean rule pack.
KOREAN: tuple[Rule, ...] = (
    Rule("KH-S01", "regex", r"(?:은|는|이|가)\s+아니라(?!고)"),
    Rule("KH-S02", "regex", r"결론적으로|요약하면|정리하자면|종합하면|시사하는 바가 크다"),
    Rule("KH-S03", "regex", r"첫째|둘째|셋째|넷째|다섯째"),
    Rule("KH-S04", "regex", r"(?<![가-힣])(?:한편(?:으로)?|또한|다만|즉|나아가|아울러|다시\s+말해)(?![가-힣])(?:\s*(?:,|，))?"),
    Rule("KH-S06", "regex", r"(?:에\s*의해|에\s*의하여|에\s*의한)", requires=("translation_source",)),
    Rule("KH-S07", "regex", r"(?:며|고|지만|는데|면서)\s*,"),
    Rule("KH-S08", "sentence_run", minimum_run=3),
    Rule("KH-S09", "regex", r"(?:할 수 있다|가능성이 있다|(?:로|으로) 보인다|라고 여겨진다)"),
    Rule("KH-S11", "regex", r"(?:에\s*대해(?:서)?|에\s*대하여|에\s*관하여|와\s*관련하여|과\s*관련하여)"),
    Rule("KH-S12", "regex", r"(?:을|를)\s*(?:통해|통하여)"),
    Rule("KH-S13", "regex", r"(?:(?:다는|라는)\s*(?:점|것)|(?:할|해야\s*할)\s*필요가\s*있다)"),
    Rule("KH-S15", "regex", r"(?:되어진|되어지|보여진|보여지|이루어진|이루어지|만들어진|만들어지)"),
    Rule("KH-S16", "regex", r"[가-힣][가-힣 ]{0,24}\([A-Za-z][A-Za-z0-9 .&/+_-]{2,}\)"),
    Rule("KH-S17", "regex", r"(?:매우\s+중요|주목할\s+만|혁신적|획기적|전례\s+없는)"),
    Rule("KH-S18", "regex", r"(?:을|를)?\s*넘어\s+[^,.!?\n]{1,30}(?:로|으로)"),
    Rule("KH-S19", "regex", r"(?m)^[ \t]*(?:이는|이것은|이러한)(?:[ \t]|,)"),
    Rule("KH-S20", "regex", r"(?:을|를|기)\s*위해(?:서)?"),
    Rule("KH-S21", "regex", r"(?:중요하고\s+핵심적|핵심적이고\s+중요|역할과\s+기능|기능과\s+역할|적\s+(?:측면|관점))"),
    Rule("KH-S26", "regex", r"(?:(?:다는|라는)\s*것이다|(?:할|해야\s*할)\s*필요가\s*있다)"),
    Rule("KH-S27", "regex", r"(?m)(?:이\s*(?:글|장|절)에서는?)[^.!?\n]{0,80}(?:살펴본다|다룬다|알아본다)"),
    Rule("KH-S32", "regex", r"(?:긴밀(?:히|하게)\s+(?:연결|맞물)|능동적(?:으로|인)\s+(?:상호작용|참여)|체계적(?:으로|인)\s+(?:정리|분석|접근|관리|기록|적어)|(?:삶|문화|경험|논의)(?:을|를)\s+풍요롭게|(?:성장|발전)(?:을|의)\s+위한\s+(?:핵심|중요한)\s+(?:습관|수단|과정)|(?:핵심|중요한)\s+(?:습관|수단|과정)(?:으로)?\s+(?:인식|받아들))"),
    Rule("KH-S34", "structural", structural_kind="meta_discourse", requires=("ai_edited",)),
    Rule("KH-S35", "structural", structural_kind="return_signal", requires=("ai_edited",)),
    Rule("KH-S36", "structural", structural_kind="advance_label", requires=("ai_edited",)),
    Rule("KH-S37", "structural", structural_kind="emphasis_run", minimum_run=3, requires=("ai_edited",)),
    Rule("KH-S40", "triadic_chain"),
)

# Why a rule was not scanned.
NO_SOURCE = "원문 대조가 확인되지 않아 번역투 앵커를 스캔하지 않음"
NOT_EDITED = "후편집 수사·구조 후보는 ai_edited 또는 rule_guided_draft 입력에서만 스캔함"


def validate_rules(rules: Iterable[Rule], id_pattern: re.Pattern[str] | None = RULE_ID) -> tuple[Rule, ...]:
    """The rules, or ValueError: unique ids of the form, known types and kinds, patterns that compile, runs of two or more."""
    rules, seen = tuple(rules), set()
    if not rules:
        raise ValueError("a rule pack needs a rule")
    for r in rules:
        if not r.id or id_pattern and not id_pattern.fullmatch(r.id):
            raise ValueError(f"rule id has the wrong form: {r.id!r}")
        if r.id in seen:
            raise ValueError(f"rule id given twice: {r.id}")
        seen.add(r.id)
        if r.anchor_type not in ANCHOR_TYPES:
            raise ValueError(f"{r.id}: unknown anchor type {r.anchor_type!r}")
        if r.anchor_type == "regex" and not (r.pattern and valid_pattern(r.pattern)):
            raise ValueError(f"{r.id}: pattern missing or not valid")
        if r.anchor_type == "structural" and r.structural_kind not in STRUCTURAL_KINDS:
            raise ValueError(f"{r.id}: unknown structural kind {r.structural_kind!r}")
        runs = r.anchor_type == "sentence_run" or r.structural_kind == "emphasis_run"
        if runs and (not isinstance(r.minimum_run, int) or r.minimum_run < 2):
            raise ValueError(f"{r.id}: minimum_run must be 2 or more")
    return rules


def gate_rules(rules: Iterable[Rule], translation_source: bool = False, provenance: str = "unknown") -> tuple[list[Rule], list[tuple[str, str]]]:
    """Rules to scan, and (rule id, reason) of those that the input's origin rules out."""
    if provenance not in PROVENANCES:
        raise ValueError(f"provenance must be one of: {', '.join(PROVENANCES)}")
    scanned, skipped = [], []
    for r in rules:
        if "translation_source" in r.requires and not translation_source:
            skipped.append((r.id, NO_SOURCE))
        elif "ai_edited" in r.requires and provenance not in ("ai_edited", "rule_guided_draft"):
            skipped.append((r.id, NOT_EDITED))
        else:
            scanned.append(r)
    return scanned, skipped


def scope_warning(skipped: list[tuple[str, str]]) -> list[str]:
    if not skipped:
        return []
    return [f"{len(skipped)}개 규칙을 스캔하지 않았습니다 ({', '.join(i for i, _ in skipped)}). 이 결과는 해당 규칙군의 전수 진단이 아닙니다."]


def validate_allowances(profile: dict | None, rule_ids: set[str]) -> tuple[Allowance, ...]:
    """Entries of an allow profile in their order, or ValueError; an absent profile allows nothing."""
    if profile is None:
        return ()
    if not isinstance(profile, dict):
        raise ValueError("an allow profile is an object")
    if not isinstance(profile.get("genre"), str) or not profile["genre"].strip():
        raise ValueError("an allow profile needs a genre")
    if not isinstance(profile.get("allow"), list):
        raise ValueError("an allow profile needs a list 'allow'")
    out: list[Allowance] = []
    for n, e in enumerate(profile["allow"], 1):
        if not isinstance(e, dict):
            raise ValueError(f"allow entry {n} is no object")
        rule_id, scope, reason = (e.get(k) for k in ("rule_id", "scope", "reason"))
        if rule_id not in rule_ids:
            raise ValueError(f"allow entry {n}: unknown rule_id")
        if scope not in ALLOW_SCOPES:
            raise ValueError(f"allow entry {n}: scope must be one of {', '.join(ALLOW_SCOPES)}")
        if not isinstance(reason, str) or not reason.strip():
            raise ValueError(f"allow entry {n}: needs a reason")
        if any((a.rule_id, a.scope) == (rule_id, scope) for a in out):
            raise ValueError(f"allow entry {n}: rule and scope given twice")
        out.append(Allowance(rule_id, scope, reason.strip()))
    return tuple(out)
