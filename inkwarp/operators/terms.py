"""Terminology: validation of term maps, and the audit of a migration from old words to new ones by document and scope.

Scope views and protected spans are worked out once for each document and scope; the terms, a declared list, are one array that is
exploded on that row, so the plan is the same for one term and for hundreds. Counts are then rolled up from scope to document to term.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarp.functions.offsets import SPANS, apply, context, count_literal, find_all, find_literal, find_value, line_of, mask_spans, nth_on_line, settle, squeeze
from inkwarp.functions.spans import overlaps, with_protected
from inkwarp.operators.markdown import HOLD, SCOPES, scope_lines, scope_view

DONE = "기계 확인 완료"
SENTENCE = "(?d)[^.!?]+(?:[.!?]|$)"
_TOKEN = re.compile(r"[A-Za-z0-9가-힣]+")


@dataclass(frozen=True)
class Exception_:
    """One occurrence that may keep the old word."""

    text: str
    reason: str
    document_id: str
    scope: str
    line: int
    occurrence: int = 1


@dataclass(frozen=True)
class Term:
    id: str
    old: tuple[str, ...]
    new: str
    scope: tuple[str, ...]
    rationale: str
    exceptions: tuple[Exception_, ...] = ()
    components: tuple[str, ...] = ()
    source: str | None = None
    do_not_use: tuple[str, ...] = field(default=())


def _text(x: object) -> str:
    return x.strip() if isinstance(x, str) else ""


def _natural(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= 1


def _need(good: bool, what: str) -> None:
    if not good:
        raise ValueError(what)


def _scopes(xs: object, who: str) -> tuple[str, ...]:
    _need(isinstance(xs, list) and bool(xs) and all(isinstance(x, str) and x in SCOPES for x in xs), f"{who}: scopes must be a list of supported scopes")
    _need(len(set(xs)) == len(xs), f"{who}: scope given twice")
    return tuple(xs)


def validate_terms(payload: dict) -> list[Term]:
    """The terms of a map (schema_version 0.1), or ValueError for the first fault."""
    _need(payload.get("schema_version") == "0.1", "schema_version must be 0.1")
    raw_terms = payload.get("terms")
    _need(isinstance(raw_terms, list) and bool(raw_terms), "a term map needs terms")
    out: list[Term] = []
    owner: dict[str, str] = {}
    for n, raw in enumerate(raw_terms, 1):
        _need(isinstance(raw, dict), f"term {n} is no object")
        who, new, why = _text(raw.get("id")), _text(raw.get("new")), _text(raw.get("rationale"))
        _need(bool(who) and who not in {t.id for t in out}, f"term {n} needs an id of its own")
        _need(bool(new) and new not in {t.new for t in out}, f"{who}: needs a new value of its own")
        old = [raw["old"]] if isinstance(raw.get("old"), str) else raw.get("old")
        _need(isinstance(old, list) and all(isinstance(x, str) for x in old), f"{who}: old must be text or a list of texts")
        old = [x.strip() for x in old if x.strip()]
        _need(bool(old), f"{who}: needs an old value")
        _need(len(set(old)) == len(old) and new not in old, f"{who}: old values repeat or hold the new one")
        scopes = _scopes(raw.get("scope"), who)
        _need(bool(why), f"{who}: needs a rationale")
        _need(raw.get("source") is None or isinstance(raw["source"], str), f"{who}: source must be text")
        unused = raw.get("do_not_use", [])
        _need(isinstance(unused, list) and all(_text(x) for x in unused), f"{who}: do_not_use must be a list of texts")
        listed = raw.get("exceptions", [])
        _need(isinstance(listed, list), f"{who}: exceptions must be a list")
        exceptions = []
        for e in listed:
            _need(isinstance(e, dict) and all(_text(e.get(k)) for k in ("text", "reason", "document_id")), f"{who}: an exception needs text, reason and document_id")
            _need(e.get("scope") in SCOPES, f"{who}: an exception needs a supported scope")
            _need(_natural(e.get("line")) and _natural(e.get("occurrence", 1)), f"{who}: line and occurrence of an exception count from 1")
            exceptions.append(Exception_(_text(e["text"]), _text(e["reason"]), _text(e["document_id"]), e["scope"], e["line"], e.get("occurrence", 1)))
        parts = raw.get("components")
        if parts is None:
            parts = [x for x in _TOKEN.findall(new) if len(x) >= 2]
        else:
            _need(isinstance(parts, list) and bool(parts) and all(_text(x) for x in parts), f"{who}: components must be a list of texts")
            parts = [x.strip() for x in parts]
        _need(all(x in new for x in parts), f"{who}: components must be parts of the new value")
        for x in old:
            _need(owner.setdefault(x, who) == who, f"old value {x} belongs to two terms")
        out.append(Term(who, tuple(old), new, scopes, why, tuple(exceptions), tuple(sorted(set(parts))), raw.get("source"), tuple(unused)))
    return out


def validate_documents(documents: list[dict]) -> list[dict]:
    """Documents with id, scopes, before and after, or ValueError; glossary and index stand alone."""
    _need(bool(documents), "needs a document")
    seen: set[str] = set()
    for n, d in enumerate(documents, 1):
        who = _text(d.get("id"))
        _need(bool(who) and who not in seen, f"document {n} needs an id of its own")
        seen.add(who)
        scopes = _scopes(d.get("scopes"), who)
        _need(not {"glossary", "index"} & set(scopes) or len(scopes) == 1, f"{who}: glossary and index need a document of their own")
        _need(isinstance(d.get("before"), str) and isinstance(d.get("after"), str), f"{who}: needs text before and after")
    return [{"document_id": _text(d["id"]), "scopes": d["scopes"], "before": d["before"], "after": d["after"]} for d in documents]


def scope_views(documents: DataFrame) -> DataFrame:
    """One row for each document and scope: both texts, their views and the protected spans of these.

    ``documents``: document_id, scopes ARRAY<STRING>, before, after; rows with a null text are left out.
    """
    rows = documents.where("before is not null and after is not null").select("document_id", "scopes", "before", "after", scope_lines(F.col("before")).alias("kb"), scope_lines(F.col("after")).alias("ka"))
    each = rows.select("document_id", F.explode("scopes").alias("scope"), "before", "after", "kb", "ka")
    views = settle(each, before_view=scope_view(F.col("before"), F.col("kb"), F.col("scope")), after_view=scope_view(F.col("after"), F.col("ka"), F.col("scope"))).drop("kb", "ka")
    return with_protected(with_protected(views, "before_view", "before_protected"), "after_view", "after_protected")


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).cast(SPANS)


def longest_first(text: Column, phrases: Column, taken: Column) -> Column:
    """Occurrences of any of ``phrases`` outside ``taken``: by start, longer ones first, none that overlaps one chosen before.

    The folded array is copied when it grows, so the fold keeps hits in blocks (see :func:`inkwarp.functions.offsets.find_all`).
    """
    found = F.filter(F.flatten(F.transform(phrases, lambda p: find_value(text, p))), lambda s: ~overlaps(s["start"], s["end"], taken))
    longest = "transform(array_sort(transform(t, s -> named_struct('start', s.start, 'back', -s.`end`, 'value', s.value))), s -> named_struct('start', s.start, 'end', -s.back, 'value', s.value))"
    kind = f"struct<at:int,out:{SPANS}>"
    step = f"cast(if(x.start >= a.at, named_struct('at', x.`end`, 'out', concat(a.out, array(x))), a) as {kind})"
    zero = f"cast(named_struct('at', 0, 'out', array()) as {kind})"
    # of a block all that start within what earlier blocks took are left out before it is folded
    block = f"aggregate(slice(xs, i * 128 + 1, 128), cast(named_struct('at', b.at, 'out', array()) as {kind}), (a, x) -> {step})"
    folded = f"transform(array({longest}), xs -> aggregate(sequence(0, cast(floor((size(xs) - 1) / 128) as int)), {zero}, (b, i) -> transform(array({block}), n -> cast(named_struct('at', n.at, 'out', concat(b.out, n.out)) as {kind}))[0], b -> b.out))[0]"
    return apply(found, f"if(size(t) = 0, cast(array() as {SPANS}), {folded})")


def sentences_with(text: Column, phrase: Column) -> Column:
    """The sentences that hold a phrase: ARRAY<STRUCT<start, end, value>> with squeezed values."""
    said = F.transform(find_all(text, SENTENCE), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), squeeze(s["value"]).alias("value")))
    return F.filter(said, lambda s: F.contains(s["value"], phrase))


ECHO = "array<struct<kind:string,component:string,count:int,start:int,end:int,context:string>>"


def echoes(said: Column, new: Column, components: Column) -> Column:
    """Of the sentences with the new term, those in which it, or a part of it outside of it, comes again: component, count, start."""

    def row(name: str, part: Column, n: Column, s: Column) -> Column:
        return F.struct(F.lit(name).alias("kind"), part.alias("component"), n.cast("int").alias("count"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("context"))

    whole = F.transform(F.filter(said, lambda s: count_literal(s["value"], new) > 1), lambda s: row("full-term-repeat", new, count_literal(s["value"], new), s)).cast(ECHO)

    def part(c: Column) -> Column:
        more = F.filter(said, lambda s: count_literal(s["value"], c) > count_literal(s["value"], new) * count_literal(new, c))
        return F.transform(more, lambda s: row("component-echo", c, count_literal(s["value"], c), s)).cast(ECHO)

    return F.concat(whole, F.flatten(F.transform(components, part)))


_TERM = "struct<id:string,old:array<string>,new:string,scope:array<string>,components:array<string>,exceptions:array<struct<text:string,document_id:string,scope:string,line:int,occurrence:int>>>"


def terms_literal(terms: Sequence[Term]) -> Column:
    """The terms as one constant array."""
    listed = [{"id": t.id, "old": t.old, "new": t.new, "scope": t.scope, "components": t.components, "exceptions": [asdict(e) for e in t.exceptions]} for t in terms]
    return F.from_json(F.lit(json.dumps(listed, ensure_ascii=False)), f"array<{_TERM}>")


def term_scopes(documents: DataFrame, terms: Sequence[Term]) -> DataFrame:
    """By term, document and scope of both: old and new counts, residues with context, gap, sentences, echoes and exceptions not found."""
    views = scope_views(documents)
    rows = views.withColumn("t", F.explode(F.filter(terms_literal(terms), lambda t: F.array_contains(t["scope"], F.col("scope")))))
    bv, av, new = F.col("before_view"), F.col("after_view"), F.col("t.new")
    own = F.filter("t.exceptions", lambda e: (e["document_id"] == F.col("document_id")) & (e["scope"] == F.col("scope")))
    at = lambda view: F.transform(own, lambda e: nth_on_line(view, e["text"], e["line"], e["occurrence"]))
    rows = settle(rows, bx=at(bv), ax=at(av), bn=find_value(bv, new), an=find_value(av, new))
    got = lambda c: F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("").alias("value"))).cast(SPANS)
    rows = settle(rows, bfree=F.concat(_plain(F.col("before_protected")), got("bx"), F.col("bn")), akept=F.concat(_plain(F.col("after_protected")), got("ax")))
    rows = settle(rows, old=longest_first(bv, F.col("t.old"), F.col("bfree")), left=longest_first(av, F.col("t.old"), F.col("an")), said=sentences_with(mask_spans(av, F.col("akept")), new), shown=sentences_with(mask_spans(av, _plain(F.col("after_protected"))), new))
    rows = settle(rows, echo=echoes(F.col("said"), new, F.col("t.components")))
    free = F.filter("left", lambda s: ~overlaps(s["start"], s["end"], F.col("akept")))
    held = F.filter("left", lambda s: overlaps(s["start"], s["end"], F.col("akept")))
    place = lambda s: line_of(F.col("after"), s["start"]).alias("line")
    shown = lambda spans: F.transform(spans, lambda s: F.struct(s["value"].alias("old"), s["start"].alias("start"), s["end"].alias("end"), place(s), context(F.col("after"), s["start"], s["end"], 60).alias("context")))
    count = lambda spans, taken: F.size(F.filter(spans, lambda s: ~overlaps(s["start"], s["end"], taken)))
    missing = lambda c: F.size(F.filter(c, lambda x: x.isNull()))
    out = rows.select(
        F.col("t.id").alias("term_id"), "document_id", "scope",
        F.size("old").alias("old_count_before"),
        F.transform("t.old", lambda p: F.struct(p.alias("old"), F.size(F.filter("old", lambda s: s["value"] == p)).alias("count"))).alias("old_counts_before"),
        shown(free).alias("residues"), shown(held).alias("protected_residues"), F.size(free).alias("residue_count"),
        count(F.col("bn"), F.col("before_protected")).alias("new_count_before"), count(F.col("an"), F.col("after_protected")).alias("new_count_after"),
        F.transform("shown", lambda s: F.struct(place(s), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("context"))).alias("new_sentence_contexts"),
        F.col("echo").alias("echo_candidates"), F.size("echo").alias("echo_count"), (missing("bx") + missing("ax")).alias("unmatched_exceptions"),
    )
    return out.withColumn("replacement_gap", F.greatest(F.lit(0), F.col("new_count_before") + F.col("old_count_before") - F.col("new_count_after")))


def term_failures(status: DataFrame, rollup: DataFrame) -> DataFrame:
    """What holds a migration back: term_id, document_id (null for the term as a whole), problem, count. See :func:`term_status`."""
    documents = rollup.where("level = 1").select("term_id", "document_id", F.explode(F.array(F.struct(F.lit("residue").alias("problem"), F.col("residue_count").alias("count")), F.struct(F.lit("gap").alias("problem"), F.col("replacement_gap").alias("count")))).alias("x"))
    whole = status.select("term_id", F.lit(None).cast("string").alias("document_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("problem"), n.cast("long").alias("count")) for k, n in (("missing scope", F.size("missing_scopes")), ("stale exception", F.col("stale_exceptions")), ("unmatched exception", F.col("unmatched_exceptions")))])).alias("x"))
    return documents.unionByName(whole).select("term_id", "document_id", "x.problem", "x.count").where("count > 0")


def term_rollup(scopes: DataFrame) -> DataFrame:
    """Counts of :func:`term_scopes` by scope, document, term and in all; level 0 is a scope, 1 a document, 3 a term, 7 the corpus."""
    names = ("old_count_before", "residue_count", "new_count_before", "new_count_after", "replacement_gap", "echo_count", "unmatched_exceptions")
    return scopes.rollup("term_id", "document_id", "scope").agg(*[F.sum(n).alias(n) for n in names], F.grouping_id().alias("level"))


def term_status(documents: DataFrame, terms: Sequence[Term], rollup: DataFrame) -> DataFrame:
    """By term: its counts, scopes that no document has, exceptions that point nowhere, and status."""
    covered = {r[0] for r in documents.select(F.explode("scopes").alias("s")).distinct().collect()}  # at most six
    named = sorted({e.document_id for t in terms for e in t.exceptions})
    have = {r.document_id: set(r.scopes) for r in documents.where(F.col("document_id").isin(named)).select("document_id", "scopes").collect()} if named else {}
    rows = []
    for t in terms:
        stale = sum(e.document_id not in have or e.scope not in t.scope or e.scope not in have[e.document_id] for e in t.exceptions)
        rows.append((t.id, sorted(set(t.scope) - covered), stale))
    spark = documents.sparkSession
    base = spark.createDataFrame(rows, "term_id string, missing_scopes array<string>, stale_exceptions int")
    out = base.join(rollup.where("level = 3").drop("document_id", "scope", "level"), "term_id", "left").fillna(0)
    bad = (F.size("missing_scopes") > 0) | (F.col("stale_exceptions") > 0) | (F.col("residue_count") > 0) | (F.col("replacement_gap") > 0) | (F.col("unmatched_exceptions") > 0)
    return out.withColumn("status", F.when(bad, HOLD).otherwise(DONE))


DECISIONS = ("replace", "preserve", "ask")


def validate_senses(payload: dict) -> list[dict]:
    """The terms of a sense map (schema_version 0.1), or ValueError for the first fault."""
    _need(payload.get("schema_version") == "0.1", "schema_version must be 0.1")
    terms = payload.get("terms")
    _need(isinstance(terms, list) and bool(terms), "a sense map needs terms")
    ids: set[str] = set()
    for n, t in enumerate(terms, 1):
        _need(isinstance(t, dict), f"term {n} is no object")
        who, forms, senses, uses = t.get("id"), t.get("forms"), t.get("senses"), t.get("occurrences")
        _need(bool(_text(who)) and who not in ids, f"term {n} needs an id of its own")
        ids.add(who)
        _need(isinstance(forms, list) and bool(forms) and all(_text(f) for f in forms) and len(set(forms)) == len(forms), f"{who}: needs forms, none twice")
        _need(isinstance(senses, list) and bool(senses) and all(isinstance(s, dict) and _text(s.get("id")) and _text(s.get("definition")) for s in senses), f"{who}: senses need id and definition")
        known = [s["id"] for s in senses]
        _need(len(set(known)) == len(known), f"{who}: sense given twice")
        _need(isinstance(uses, list) and bool(uses), f"{who}: needs occurrences")
        seen = set()
        for u in uses:
            _need(isinstance(u, dict) and bool(_text(u.get("document_id"))) and u.get("scope") in SCOPES, f"{who}: an occurrence needs document_id and scope")
            _need(_natural(u.get("line")) and _natural(u.get("occurrence", 1)), f"{who}: line and occurrence count from 1")
            _need(u.get("form") in forms and u.get("sense") in known and u.get("decision") in DECISIONS, f"{who}: unknown form, sense or decision")
            _need(bool(_text(u.get("rationale"))), f"{who}: an occurrence needs a rationale")
            replace, ask = u["decision"] == "replace", u["decision"] == "ask"
            _need(bool(_text(u.get("after"))) if replace else u.get("after") is None, f"{who}: 'after' goes with replace only")
            where = (u.get("after_line"), u.get("after_occurrence"))
            _need(where == (None, None) if ask else all(map(_natural, where)), f"{who}: after_line and after_occurrence go with replace and preserve")
            key = (u["document_id"], u["scope"], u["line"], u.get("occurrence", 1), u["form"])
            _need(key not in seen, f"{who}: place given twice")
            seen.add(key)
    return terms


USES = "term_id string, document_id string, scope string, line int, occurrence int, form string, sense string, decision string, after string, after_line int, after_occurrence int, rationale string"
PLACE = ["term_id", "document_id", "scope", "line", "occurrence", "form"]


def declared_uses(spark, terms: list[dict]) -> DataFrame:
    """The occurrences of a sense map as rows."""
    names = [c.split()[0] for c in USES.split(", ")]
    return spark.createDataFrame([tuple({"term_id": t["id"], "occurrence": 1, **u}.get(n) for n in names) for t in terms for u in t["occurrences"]], USES)


def discovered_uses(documents: DataFrame, terms: list[dict]) -> DataFrame:
    """Every unprotected occurrence of every form: its place (:data:`PLACE`); ordinals on a line count protected ones too."""
    views = scope_views(documents).select("document_id", "scope", "before_view", "before_protected")
    forms = [F.struct(F.lit(t["id"]).alias("term_id"), F.lit(f).alias("form"), find_literal(F.col("before_view"), f).alias("spans")) for t in terms for f in t["forms"]]
    each = views.select("document_id", "scope", "before_view", "before_protected", F.inline(F.array(*forms)))
    hits = each.select("document_id", "scope", "term_id", "form", "before_protected", F.explode(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), line_of(F.col("before_view"), s["start"]).alias("line")))).alias("h"), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), line_of(F.col("before_view"), s["start"]).alias("line"))).alias("all"))
    nth = F.size(F.filter("all", lambda x: (x["line"] == F.col("h.line")) & (x["start"] <= F.col("h.start"))))
    return hits.where(~overlaps(F.col("h.start"), F.col("h.end"), F.col("before_protected"))).select("term_id", "document_id", "scope", F.col("h.line").alias("line"), nth.alias("occurrence"), "form")


def audit_uses(documents: DataFrame, terms: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(uses, terms): each declared use with its problem if it has one, and each term's counts and status."""
    declared = declared_uses(documents.sparkSession, terms)
    views = scope_views(documents)
    rows = declared.withColumnRenamed("after", "said").join(views, ["document_id", "scope"], "left")
    rows = settle(rows, b=nth_on_line(F.col("before_view"), F.col("form"), F.col("line"), F.col("occurrence")), a=nth_on_line(F.col("after_view"), F.coalesce("said", "form"), F.col("after_line"), F.col("after_occurrence")))
    problem = (
        F.when(F.col("before_view").isNull(), "문서 또는 scope가 manifest에 없음")
        .when(F.col("b").isNull(), "변경 전 좌표에서 기존어를 찾지 못함")
        .when(overlaps(F.col("b.start"), F.col("b.end"), F.col("before_protected")), "보호 구간 용례는 기존 term map 예외로 처리해야 함")
        .when((F.col("decision") != "ask") & F.col("a").isNull(), "변경 후 좌표에서 결정 표기를 찾지 못함")
    )
    uses = rows.select(*PLACE, "decision", problem.alias("problem")).withColumn("status", F.when(F.col("problem").isNull(), "확인").otherwise(HOLD))
    found = discovered_uses(documents, terms)
    undeclared = found.join(declared, PLACE, "left_anti").groupBy("term_id").agg(F.count(F.lit(1)).alias("undeclared"))
    stale = declared.join(found, PLACE, "left_anti").groupBy("term_id").agg(F.count(F.lit(1)).alias("stale"))
    sums = uses.groupBy("term_id").agg(F.count_if(F.col("decision") == "ask").alias("ask_count"), F.count("problem").alias("problems"))
    total = found.groupBy("term_id").agg(F.count(F.lit(1)).alias("discovered_count"))
    out = sums.join(total, "term_id", "left").join(undeclared, "term_id", "left").join(stale, "term_id", "left").fillna(0)
    bad = (F.col("problems") > 0) | (F.col("undeclared") > 0) | (F.col("stale") > 0) | (F.col("ask_count") > 0)
    return uses, out.withColumn("status", F.when(bad, HOLD).otherwise(DONE))
