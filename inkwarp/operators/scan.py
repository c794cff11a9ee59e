"""Rule scan of documents: findings with exact places, and what is summed from them.

The scan is one narrow stage of built-in expressions: protected spans, mask, structure and all rules are arrays on the document row,
then one explode gives the findings without the text. Only the summaries shuffle, on small rows.
Results are candidate places; they say nothing about authorship or quality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwarp.functions.offsets import column_of, context, found_sql, line_of, mask, settle, sql_string
from inkwarp.functions.spans import MARKER, with_protected
from inkwarp.functions.structure import COMMENT, EDGES, FENCE, location, rhythm_kind, with_structure
from inkwarp.operators.rules import KOREAN, Allowance, Rule, gate_rules

HITS = "array<struct<rule_id:string,start:int,end:int,evidence:string,shape:string>>"
LIMIT = "결정적 앵커의 위치 후보일 뿐, 저자 판별·품질 점수·자동 수정 지시가 아님"
PLACE = ("paragraph", "sentence_in_paragraph", "is_paragraph_first", "is_paragraph_last", "paragraph_kind", "section_heading", "is_document_last", "body_paragraphs_to_end")
FINDING = ("document_id", "rule_id", "start", "end", "line", "column", "evidence", "context", *PLACE, "shape", "allowed", "allow_scope", "allow_reason")

# Endings, connectors and labels of the anchors that are no single pattern.
RUN_SENTENCE = "[^.!?\\n]+[.!?]"
RUN_ENDING = "(습니다|이다|한다|된다|있다)\\.$"
_JOIN = "(?:(?<![다라냐자])고|(?<![다라냐자])며)(?:\\s*,\\s*|\\s+)"
TRIAD = f"[^.!?\\n,]{{1,36}}?{_JOIN}[^.!?\\n,]{{1,28}}?{_JOIN}[^.!?\\n]{{1,40}}(?=[.!?])"
TRIAD_SHAPE = "삼항 병렬: -고/-며"
TRIAD_LABEL = "삼항 병렬 후보—세 항목의 의미 기여도 확인: "
META = (
    ("(?:이|이런)\\s*(?:글|장|절)(?:은|에서는?)\\s*[^.!?\\n]{0,60}(?:장이다|이야기다|다룬다|시작한다|핵심이다|쓴다)", "장·절 선언", "이 장은 __다."),
    ("(?:이제|먼저|여기서)\\s+[^.!?\\n]{0,48}(?:하자|두자|밝힌다|정리하자|살펴보자|이야기하자|짚고\\s*가자|말해\\s*두자|시작하자|긋자|듣자|들자|넘어가자)", "메타 청유", "메타 지시: __"),
    ("(?:전제|기준|뜻|범위)[^.!?\\n]{0,24}(?:밝힌다|정리한다|정해\\s*두자)", "논지 예고", "논지 예고: __"),
)
RETURN = ("(?:이제\\s+)?[^.!?\\n]{2,40}?(?:으로|로)\\s*(?:돌아가자|마무리하자)", "장면 회귀", "__로 돌아가자.")
ADVANCE = (
    ("[^.!?\\n]{1,48}(?:은|는|이|가|지는)\\s+(?:분명하다|분명해진다)", "자명 선언", "__는 분명하다."),
    ("[^.!?\\n]{1,40}(?:은|는|이|가)\\s*(?:하나|둘|셋|넷|다섯|한|두|세|네)\\s*(?:가지|개|뿐)이다", "열거 예고", "__는 N가지다."),
    ("한\\s*문장으로\\s*(?:하면|말하면|요약하면|정리하면|이렇다|요약된다|정한다)[^.!?\\n]{0,32}", "한 문장 예고", "한 문장으로 __"),
)
BOLD_LEAD = "^\\*\\*([^*\\n]{1,72})\\*\\*"
NAVIGATION = "^(?:(?:제\\s*)?\\d+\\s*(?:장|부|절)|(?:프롤로그|에필로그|부록|후기|이\\s*책을\\s*사용하는\\s*법))"


def _u(pattern: str) -> str:
    """Unicode classes and line feeds as the only line ends."""
    return "(?dU)" + pattern


# The rules are compiled to SQL text about t (the text without comments and code), protected and structure: one call to the JVM for
# a whole pack, and one expression in which every pattern is constant.


def _hit(rule: Rule, start: str, end: str, evidence: str, shape: str | None = None) -> str:
    return f"named_struct('rule_id', {sql_string(rule.id)}, 'start', cast({start} as int), 'end', cast({end} as int), 'evidence', {evidence}, 'shape', {'cast(null as string)' if shape is None else sql_string(shape)})"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {sql_string(EDGES)}, '')"


def _regex(rule: Rule) -> str:
    return f"transform({found_sql(_u(rule.pattern))}, s -> {_hit(rule, 's.start', 's.`end`', 's.value')})"


def _triads(rule: Rule) -> str:
    return f"transform({found_sql(_u(TRIAD))}, s -> {_hit(rule, 's.start', 's.`end`', f'concat({sql_string(TRIAD_LABEL)}, {_strip("s.value")})', TRIAD_SHAPE)})"


def _runs(items: str, minimum: int, made: str) -> str:
    """Islands of equal keys in an array of (key, start, end): a null key parts them. ``made`` gives a hit for r (key, start, end, n).

    Items are numbered, those whose key is that of the one before left out, and every island ends where the next one starts.
    """
    numbered = f"transform({items}, (x, i) -> named_struct('key', x.key, 'start', x.start, 'end', x.`end`, 'i', i))"
    heads = "transform(filter(xs, x -> x.i = 0 or not (x.key <=> xs[x.i - 1].key)), (x, k) -> named_struct('i', x.i, 'k', k))"
    lasts = "transform(hs, h -> named_struct('i', h.i, 'n', if(h.k + 1 < size(hs), hs[least(h.k + 1, size(hs) - 1)].i, size(xs)) - h.i))"
    islands = f"filter(transform({lasts}, h -> named_struct('key', xs[h.i].key, 'start', xs[h.i].start, 'end', xs[h.i + h.n - 1].`end`, 'n', h.n)), r -> r.key is not null and r.n >= {minimum})"
    return f"flatten(transform(array({numbered}), xs -> flatten(transform(array({heads}), hs -> transform({islands}, r -> {made})))))"


def _sentence_run(rule: Rule) -> str:
    ending = f"nullif(regexp_extract({_strip('s.value')}, {sql_string(RUN_ENDING)}, 1), '')"
    items = f"transform({found_sql(RUN_SENTENCE)}, s -> named_struct('key', if(exists(protected, p -> s.start < p.`end` and s.`end` > p.start), cast(null as string), {ending}), 'start', s.start, 'end', s.`end`))"
    return _runs(items, rule.minimum_run, _hit(rule, "r.start", "r.`end`", "concat(r.key, ' 종결 ', cast(r.n as string), '문장 연속')"))


#: Whether an offset lies in the first sentence of a paragraph (as :func:`location` says).
_FIRST = "if(p.sentences[0].start <= s.start + p.start and p.sentences[0].`end` > s.start + p.start, true, size(p.sentences) = 1)"


def _in_bodies(rule: Rule, patterns, keep: str = "true") -> str:
    """Matches of labelled patterns inside each body paragraph."""
    parts = []
    for pattern, label, shape in patterns:
        hit = _hit(rule, "s.start + p.start", "s.`end` + p.start", f"concat({sql_string(label + ': ')}, s.value)", shape)
        inside = f"transform(array(substring(t, p.start + 1, p.`end` - p.start)), t -> transform(filter({found_sql(_u(pattern))}, s -> {keep}), s -> {hit}))[0]"
        parts.append(f"flatten(transform(filter(structure, p -> p.kind = 'body'), p -> {inside}))")
    return f"concat({', '.join(parts)})"


def _structural(rule: Rule) -> str:
    if rule.structural_kind == "meta_discourse":
        return _in_bodies(rule, META, f"not contains(s.value, '돌아가자') and {_FIRST}")
    if rule.structural_kind == "return_signal":
        return _in_bodies(rule, (RETURN,))
    if rule.structural_kind == "advance_label":
        return _in_bodies(rule, ADVANCE)
    raw = _strip("substring(t, p.start + 1, p.`end` - p.start)")
    lead = _strip(f"regexp_extract({raw}, {sql_string(BOLD_LEAD)}, 1)")
    good = f"p.kind = 'body' and exists(array({lead}), x -> x <> '' and length(x) <= 52 and not x rlike {sql_string('(?U)' + NAVIGATION)})"
    items = f"transform(structure, p -> named_struct('key', if({good}, 'bold', cast(null as string)), 'start', p.start, 'end', p.`end`))"
    return _runs(items, rule.minimum_run or 3, _hit(rule, "r.start", "r.`end`", "concat('굵은 도입 라벨 ', cast(r.n as string), '문단 연속')", "굵은 도입 라벨 연속"))


_BUILD = {"regex": _regex, "triadic_chain": _triads, "sentence_run": _sentence_run, "structural": _structural}


def hits(rules: Sequence[Rule]) -> Column:
    """Hits of rules in ``scan_text``; those that overlap a protected span are left out, but for runs of sentences, which such spans part."""
    free = [f"cast({_BUILD[r.anchor_type](r)} as {HITS})" for r in rules if r.anchor_type != "sentence_run"]
    runs = [f"cast({_sentence_run(r)} as {HITS})" for r in rules if r.anchor_type == "sentence_run"]
    none = f"cast(array() as {HITS})"
    kept = f"filter(concat({', '.join([none, *free])}), h -> not exists(protected, p -> h.start < p.`end` and h.`end` > p.start))"
    return F.expr(f"transform(array(scan_text), t -> concat({', '.join([kept, *runs])}))[0]")


def prepare(documents: DataFrame, text: str = "text", extra: list[str] | None = None, marker: str = MARKER) -> DataFrame:
    """``documents`` with protected spans of the raw text, the text without comments and code, and its structure."""
    out = with_protected(documents, text, "protected", extra, marker)
    out = settle(out, __open=mask(F.col(text), COMMENT))
    out = settle(out, scan_text=mask(F.col("__open"), FENCE)).drop("__open")
    return with_structure(out, "scan_text")


def _allowance(allow: Sequence[Allowance]) -> Column:
    """Scope and reason of the first allowance that fits a finding; null if none does."""
    fits = {
        "all": F.lit(True),
        "heading": F.col("paragraph_kind") == "heading",
        "body": F.col("paragraph_kind") == "body",
        "first_sentence": (F.col("paragraph_kind") == "body") & F.col("is_paragraph_first"),
    }
    kind = "struct<scope:string,reason:string>"
    each = [F.when((F.col("rule_id") == a.rule_id) & fits[a.scope], F.struct(F.lit(a.scope).alias("scope"), F.lit(a.reason).alias("reason"))).cast(kind) for a in allow]
    return F.coalesce(*each) if each else F.lit(None).cast(kind)


def scan(
    documents: DataFrame,
    rules: Sequence[Rule] = KOREAN,
    key: str = "document_id",
    text: str = "text",
    translation_source: bool = False,
    provenance: str = "unknown",
    extra: list[str] | None = None,
    allow: Sequence[Allowance] = (),
    marker: str = MARKER,
) -> DataFrame:
    """Findings of all rules that apply, one row each (columns :data:`FINDING`, in no order).

    A null or empty text has no findings; a document given twice is scanned twice.
    """
    scanned, _ = gate_rules(rules, translation_source, provenance)
    rows = prepare(documents.select(F.col(key).alias("document_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()), "text", extra, marker)
    at = rows.select("document_id", "text", "structure", F.explode(hits(scanned)).alias("h"))
    placed = at.select("document_id", "h.*", line_of(F.col("text"), F.col("h.start")).alias("line"), column_of(F.col("text"), F.col("h.start")).alias("column"), context(F.col("text"), F.col("h.start"), F.col("h.end")).alias("context"), F.inline(F.array(location(F.col("structure"), F.col("h.start")))))
    placed = placed.withColumn("allowance", _allowance(allow))
    done = placed.withColumn("allowed", F.col("allowance").isNotNull()).withColumn("allow_scope", F.col("allowance.scope")).withColumn("allow_reason", F.col("allowance.reason"))
    return done.select(*FINDING)


def allowed_hit(h: Column, allow: Sequence[Allowance], structure: str = "structure") -> Column:
    """Whether an allowance takes a hit of :func:`hits`, before it is a row."""
    fits = {"all": lambda p: F.lit(True), "heading": lambda p: p["paragraph_kind"] == "heading", "body": lambda p: p["paragraph_kind"] == "body", "first_sentence": lambda p: (p["paragraph_kind"] == "body") & p["is_paragraph_first"]}
    taken = F.lit(False)
    for a in allow:
        taken = taken | ((h["rule_id"] == a.rule_id) & fits[a.scope](location(F.col(structure), h["start"])))
    return taken


def rule_counts(findings: DataFrame, by: Sequence[str] = ("rule_id",)) -> DataFrame:
    """Findings by rule: not allowed, allowed, all."""
    return findings.groupBy(*by).agg(F.count_if(~F.col("allowed")).alias("active_count"), F.count_if("allowed").alias("allowed_count"), F.count(F.lit(1)).alias("all_count"))


def rule_distribution(findings: DataFrame) -> DataFrame:
    """By rule, part ('document' or 'evidence') and value: occurrences. Flat, so a rule found everywhere is never one row; nulls are left out."""
    parts = F.array(*[F.struct(F.lit(name).alias("part"), F.col(c).cast("string").alias("value")) for name, c in (("document", "document_id"), ("evidence", "evidence"))])
    return findings.select("rule_id", F.inline(parts)).where("value is not null").groupBy("rule_id", "part", "value").agg(F.count(F.lit(1)).alias("occurrences"))


def distribution_maps(findings: DataFrame, most: int) -> DataFrame:
    """For sinks, by rule: occurrences, and maps of the ``most`` documents and evidences with the most occurrences."""
    whole = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("occurrences"))
    order = Window.partitionBy("rule_id", "part").orderBy(F.desc("occurrences"), "value")
    top = rule_distribution(findings).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)

    def as_map(part: str, name: str) -> DataFrame:
        return top.where(F.col("part") == part).groupBy("rule_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "occurrences")))).alias(name))

    return whole.join(as_map("document", "documents"), "rule_id", "left").join(as_map("evidence", "evidence"), "rule_id", "left")


def repeat_documents(findings: DataFrame) -> DataFrame:
    """By rule, shape and document: occurrences, of the shapes found in two or more documents."""
    shaped = findings.where("shape is not null and shape <> ''")
    docs = shaped.groupBy("rule_id", "shape", "document_id").agg(F.count(F.lit(1)).alias("occurrences"))
    several = docs.groupBy("rule_id", "shape").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    return docs.join(several, ["rule_id", "shape"])


def cross_document_repeats(findings: DataFrame, examples: int = 3) -> DataFrame:
    """Shapes of a rule found in two or more documents: documents, occurrences, and the first ``examples`` by place.

    The documents of a shape are rows of :func:`repeat_documents`.
    """
    shaped = findings.where("shape is not null and shape <> ''")
    docs = shaped.groupBy("rule_id", "shape", "document_id").agg(F.count(F.lit(1)).alias("n"))
    sums = docs.groupBy("rule_id", "shape").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences")).where("documents >= 2")
    order = Window.partitionBy("rule_id", "shape").orderBy("document_id", "start", "end")
    first = shaped.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= examples)
    kept = first.groupBy("rule_id", "shape").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "document_id", "line", "paragraph", "context"))), lambda e: F.struct(e["document_id"].alias("document_id"), e["line"].alias("line"), e["paragraph"].alias("paragraph"), e["context"].alias("context"))).alias("examples"))
    return sums.join(kept, ["rule_id", "shape"])


def sentence_clusters(findings: DataFrame) -> DataFrame:
    """By rule: sentences with a finding, with two or more, and the most in one."""
    slots = findings.groupBy("rule_id", "document_id", "paragraph", "sentence_in_paragraph").agg(F.count(F.lit(1)).alias("n"))
    return slots.groupBy("rule_id").agg(F.count(F.lit(1)).alias("sentences_with_findings"), F.count_if(F.col("n") >= 2).alias("sentences_with_2plus"), F.max("n").alias("max_per_sentence"))


def paragraph_rhythm(documents: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """By document: prose paragraphs, their sentences, single-sentence ones, mean, median, and paragraphs left out by kind.

    The mean and the ratio are null where there is no prose paragraph.
    """
    rows = settle(documents.select(F.col(key).alias("document_id"), F.col(text).alias("x")), o=mask(F.coalesce("x", F.lit("")), COMMENT))
    rows = with_structure(settle(rows, t=mask(F.col("o"), FENCE)).select("document_id", "t"), "t", "s")
    each = rows.select("document_id", F.explode_outer(F.transform("s", lambda p: F.struct(rhythm_kind(F.col("t"), p).alias("kind"), F.size(p["sentences"]).alias("n")))).alias("p")).select("document_id", "p.*")
    prose = F.col("kind") == "prose"
    left = [F.count_if(F.col("kind") == k).alias(f"excluded_{k}") for k in ("heading", "blockquote", "list", "table", "horizontal_rule")]
    single, count, total = F.count_if(prose & (F.col("n") == 1)), F.count_if(prose), F.coalesce(F.sum(F.when(prose, F.col("n"))), F.lit(0))
    return each.groupBy("document_id").agg(
        count.alias("paragraph_count"),
        total.alias("sentence_count"),
        single.alias("single_sentence_paragraph_count"),
        F.round(F.try_divide(single, count), 4).alias("single_sentence_paragraph_ratio"),
        F.round(F.avg(F.when(prose, F.col("n"))), 4).alias("mean_sentences_per_paragraph"),
        F.median(F.when(prose, F.col("n"))).alias("median_sentences_per_paragraph"),
        *left,
    )


def _receipt(text: str, marker: str) -> list[Column]:
    """What a receipt says of a prepared text."""
    t = F.col(text)
    starts, ends = (F.regexp_count(t, F.lit(f"(?iU)<!--\\s*{marker}:protect-{x}\\s*-->")) for x in ("start", "end"))
    return [
        F.length(text).alias("characters"),
        F.size("protected").alias("protected_spans_excluded"),
        F.regexp_count(text, F.lit(COMMENT)).alias("html_comments"),
        F.regexp_count(mask(t, COMMENT), F.lit(FENCE)).alias("fenced_code_blocks"),
        (starts != ends).alias("unbalanced_markers"),
        F.size("structure").alias("paragraphs"),
        F.size(F.filter("structure", lambda p: p["kind"] == "body")).alias("body_paragraphs"),
    ]


def document_receipts(documents: DataFrame, findings: DataFrame, key: str = "document_id", text: str = "text", extra: list[str] | None = None, marker: str = MARKER) -> DataFrame:
    """By document: characters, findings (all, active, allowed), protected spans, masked comments and code, unbalanced markers, paragraphs."""
    t = F.col(text)
    rows = prepare(documents.where(t.isNotNull()).select(F.col(key).alias("document_id"), t.alias(text)), text, extra, marker).select("document_id", *_receipt(text, marker))
    counts = findings.groupBy("document_id").agg(F.count(F.lit(1)).alias("finding_count"), F.count_if(~F.col("allowed")).alias("candidate_finding_count"), F.count_if("allowed").alias("allowed_finding_count"))
    zero = {c: 0 for c in ("finding_count", "candidate_finding_count", "allowed_finding_count")}
    return rows.join(counts, "document_id", "left").fillna(zero)


def scan_receipts(documents: DataFrame, rules: Sequence[Rule] = KOREAN, key: str = "document_id", text: str = "text", translation_source: bool = False, provenance: str = "unknown", extra: list[str] | None = None, allow: Sequence[Allowance] = (), marker: str = MARKER) -> DataFrame:
    """:func:`document_receipts` of a scan that is not wanted otherwise: every text is prepared once, and nothing is shuffled."""
    scanned, _ = gate_rules(rules, translation_source, provenance)
    rows = prepare(documents.where(F.col(text).isNotNull()).select(F.col(key).alias("document_id"), F.col(text).alias("text")), "text", extra, marker)
    rows = settle(rows, found=F.transform(hits(scanned), lambda h: allowed_hit(h, allow)))
    count = lambda c: F.size(c).cast("long")
    return rows.select("document_id", *_receipt("text", marker), count("found").alias("finding_count"), count(F.filter("found", lambda a: ~a)).alias("candidate_finding_count"), count(F.filter("found", lambda a: a)).alias("allowed_finding_count"))


def all_counts(findings: DataFrame) -> DataFrame:
    """Rule counts by document and rule with totals, as a rollup: a null document is the corpus, a null rule a document's total."""
    return findings.rollup("document_id", "rule_id").agg(F.count_if(~F.col("allowed")).alias("active_count"), F.count(F.lit(1)).alias("all_count"), F.grouping_id().alias("level"))


def ordered(findings: DataFrame) -> DataFrame:
    """In the order of receipts: document, start, rule. For sinks only."""
    return findings.orderBy("document_id", "start", "rule_id")
