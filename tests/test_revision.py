import io
import zipfile

import pytest
from pyspark.sql import functions as F

from inkwarp.functions.offsets import anchors_in_order, count_literal, find_all, find_literal, mask, mask_spans, nth_on_line
from inkwarp.functions.spans import lost_values, protect_values, with_protected
from inkwarp.operators.edits import measure_edits
from inkwarp.operators.gate import style_gate
from inkwarp.operators.iterations import iteration_audit
from inkwarp.operators.ledger import build_ledger, coverage, reconcile
from inkwarp.operators.markdown import changed_keys, line_kinds
from inkwarp.operators.scan import scan
from inkwarp.operators.strength import sequence_records, strength_status
from inkwarp.operators.terms import audit_uses, term_rollup, term_scopes, term_status, validate_documents, validate_senses, validate_terms
from inkwarp.sources.docx import document_paragraphs, format_findings, read_docx


def test_spans_equal_brute_force(spark):
    import re

    texts = ["", "aXbX", "X", "é😀X가X", "no", None, "XX", "a\nX b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", find_all(F.col("t"), "X|b").alias("s"), mask(F.col("t"), "X[^X]*").alias("m"), count_literal(F.col("t"), "X").alias("n"), find_literal(F.col("t"), "").alias("e")).orderBy("i").collect()
    for r, t in zip(rows, texts, strict=True):
        if t is None:
            assert r.s is None and r.m is None
            continue
        assert [(x.start, x.end, x.value) for x in r.s] == [(m.start(), m.end(), m.group()) for m in re.finditer("X|b", t)]
        assert r.m == re.sub("X[^X]*", lambda m: re.sub("[^\n]", " ", m.group()), t) and r.n == t.count("X") and r.e == []
    one = spark.createDataFrame([("ab ab\nab ab ab",)], "t string")
    got = one.select(nth_on_line(F.col("t"), F.lit("ab"), F.lit(2), F.lit(3)).alias("a"), nth_on_line(F.col("t"), F.lit("ab"), F.lit(1), F.lit(3)).alias("b"), nth_on_line(F.col("t"), F.lit("ab"), F.lit(9), F.lit(1)).alias("c"), anchors_in_order(F.col("t"), F.array(F.lit("b a"), F.lit("b\n"))).alias("d"), anchors_in_order(F.col("t"), F.array(F.lit("\n"), F.lit("ab ab ab"), F.lit("ab"))).alias("e"), mask_spans(F.col("t"), F.array(F.struct(F.lit(4).alias("start"), F.lit(7).alias("end")))).alias("f")).first()
    assert tuple(got.a) == (12, 14) and got.b is None and got.c is None and got.d == [1, 4] and got.e is None and got.f == "ab a \n b ab ab"


def test_protected_kinds_and_loss(spark):
    text = "2026-01-02 제3조 제2항 \"인용 5\" 12명 1234 2024년 3월"
    df = spark.createDataFrame([(1, text, "x 12명 12명"), (2, "“말”", "“말”")], "id int, before string, after string")
    kinds = [s.kind for s in with_protected(df.where("id = 1"), "before").first().protected]
    assert kinds == ["date", "statute", "quotation", "number", "number", "date"]
    lost = {(r.id, r.value): (r.expected, r.actual) for r in lost_values(df, ["id"]).collect()}
    assert lost[1, "제3조 제2항"] == (1, 0) and (1, "12명") not in lost and all(i == 1 for i, _ in lost)
    assert protect_values(spark.createDataFrame([(" # no",), (" keep ",), ("",), ("a#b",)], "value string")) == ["keep", "a#b"]


def test_gate(spark):
    before = "첫째 결론적으로 12명이다."
    cases = {"good": ("그리고 12명이다.", "통과"), "same": (before, "보류"), "lost": ("그리고 이다.", "보류"), "new": ("또한 12명이다.", "보류")}
    df = spark.createDataFrame([("p", n, before, a) for n, (a, _) in cases.items()], "pair_id string, candidate string, before string, after string")
    got = {r.candidate: r for r in style_gate(df, ["KH-S02", "KH-S03"]).collect()}
    assert {n: got[n].status for n in cases} == {n: s for n, (_, s) in cases.items()}
    assert got["good"].target_reduced == ["KH-S02", "KH-S03"] and got["new"].introduced_candidates == ["KH-S04"] and got["lost"].lost_values[0].value == "12명"
    kept = style_gate(df.where("candidate = 'same'"), ["KH-S02", "KH-S03"], ["KH-S02", "KH-S03"]).first()
    assert kept.status == "통과"
    assert style_gate(df.where("candidate = 'good'"), ["KH-S02"], ["KH-S17"]).first().invalid_preserved_rules == ["KH-S17"]


def test_measure_tiers(spark):
    rows = [(1, "같다. 끝.", "같다. 끝."), (2, "하나. 둘. 셋.", "하나. 새 문장. 둘. 셋."), (3, "a\n" * 60, "a\n" * 30 + "b\n" * 30), (4, None, "x"), (5, "", "x")]
    got = {r.id: r for r in measure_edits(spark.createDataFrame(rows, "id int, before string, after string"), ["id"], characters=100, lines=50).collect()}
    assert set(got) == {1, 2, 3, 5}
    assert got[1].comparison_method == "exact-equality" and got[1].before_sentence_count == 2
    assert got[2].changed_sentence_slots == 1 and got[2].comparison_method == "character-sequence"
    assert got[3].changed_character_ratio is None and got[3].line_measurement_method == "positional-line-fallback" and got[3].changed_line_ratio == 0.5
    assert got[5].changed_character_ratio == 1.0


def test_iterations(spark):
    a, b = "# 제목\n\n하나.", "# 제목\n\n하나. 둘."
    chains = {"osc": [a, b, a, b], "still": [a, b, b, a], "end": [a, b, b], "head": [a, "제목\n\n하나."]}
    df = spark.createDataFrame([(c, i, f"v{i}", t) for c, ts in chains.items() for i, t in enumerate(ts)], "chain_id string, ord int, label string, text string")
    rows, done = iteration_audit(df)
    got = {r.chain_id: r for r in done.collect()}
    assert (got["osc"].oscillations, got["osc"].status) == (2, "사람 검토")
    assert got["still"].changed_after_no_change and got["end"].status == "기계 확인 완료" and got["end"].latest_same_as_previous
    assert got["head"].structure_changes == 1
    assert [r.returned_to for r in rows.where("chain_id = 'osc'").orderBy("ord").collect()] == [None, "v0", "v1"]


def test_ledger_and_coverage(spark):
    d = spark.createDataFrame([("b", "첫째 둘째"), ("a", "또한 첫째")], "document_id string, text string")
    rows = build_ledger(scan(d)).orderBy("document_id", "start").collect()
    assert [r.anchor_id for r in rows] == ["a:KH-S04:0:2:1", "a:KH-S03:3:5:2", "b:KH-S03:0:2:3", "b:KH-S03:3:5:4"]
    ids = [r.anchor_id for r in rows]
    expected = spark.createDataFrame([(i,) for i in ids], "anchor_id string")

    def status(reviews, mode):
        have = spark.createDataFrame(reviews, "anchor_id string, review_method string, verdict string")
        return coverage(reconcile(expected, have), mode).first()

    human = [(i, "human", "edit") for i in ids]
    assert status(human, "exhaustive").status == "통과"
    assert status(human[1:], "residual").missing == 1
    assert status([*human, ("x", "human", "edit"), human[0]], "sample")[-1] == "보류"
    mixed = [*human[:2], (ids[2], "mechanical", "edit"), (ids[3], "unreviewed", "edit")]
    assert status(mixed, "sample").status == "통과" and status(mixed, "residual").anchors_unresolved == 1
    assert status([*human[:3], (ids[3], "odd", "edit")], "sample").invalid == 1
    with pytest.raises(ValueError):
        coverage(reconcile(expected, expected.withColumn("review_method", F.lit("")).withColumn("verdict", F.lit(""))), "all")


def test_markdown(spark):
    a = "# 제목 \n\n**굵은** 😀\n```py\nx\n```"
    df = spark.createDataFrame([(a, a), (a, a.replace("# 제목 ", "## 제목")), (a, a.replace("**", "", 1)), (a, a.replace("😀", "")), (a, a.replace("py", ""))], "a string, b string")
    assert [r[0] for r in df.select(changed_keys(F.col("a"), F.col("b"))).collect()] == [[], ["headings"], ["bold_markers"], ["emoji"], ["fences"]]
    text = "제목\n===\n\n| a | b\n- | ---\nx | y\n---|---\nc | d\n\n[^1]: 주\n    이어\n# 안\n````\n```\n````\n끝"
    assert line_kinds(text) == ["heading", "heading", "body", "body", "body", "table", "table", "table", "body", "footnote", "footnote", "heading", "code", "code", "code", "body"]


TERMS = {"schema_version": "0.1", "terms": [{"id": "t1", "old": ["유저", "유저 경험"], "new": "사용자 경험", "scope": ["body"], "rationale": "r", "components": ["사용자", "경험"], "exceptions": [{"text": "유저", "reason": "q", "document_id": "d1", "scope": "body", "line": 3, "occurrence": 1}]}]}


def _pairs(spark, *docs):
    rows = validate_documents([{"id": i, "scopes": s, "before": b, "after": a} for i, s, b, a in docs])
    return spark.createDataFrame([(r["document_id"], r["scopes"], r["before"], r["after"]) for r in rows], "document_id string, scopes array<string>, before string, after string")


def test_term_migration(spark):
    before = "유저 경험이 좋다. 유저가 온다.\n\n유저 목록과 “유저”."
    good = "사용자 경험이 좋다. 사용자 경험이 온다. 사용자 경험과 경험.\n\n유저 목록과 “유저”."
    docs = _pairs(spark, ("d1", ["body"], before, good), ("d2", ["body"], "유저", "유저"), ("d3", ["heading"], "x", "y"))
    terms = validate_terms(TERMS)
    rows = term_scopes(docs, terms)
    got = {r.document_id: r for r in rows.collect()}
    assert (got["d1"].old_count_before, got["d1"].residue_count, len(got["d1"].protected_residues), got["d1"].new_count_after, got["d1"].replacement_gap) == (2, 0, 2, 3, 0)
    assert [(e.kind, e.component, e["count"]) for e in got["d1"].echo_candidates] == [("component-echo", "경험", 2)]
    assert (got["d2"].residue_count, got["d2"].replacement_gap) == (1, 1) and "d3" not in got
    status = term_status(docs, terms, term_rollup(rows)).first()
    assert status.status == "보류" and status.residue_count == 1 and status.stale_exceptions == 0
    clean = docs.where("document_id = 'd1'")
    assert term_status(clean, terms, term_rollup(term_scopes(clean, terms))).first().status == "기계 확인 완료"
    for k, v in (("old", []), ("new", "유저"), ("scope", ["x"]), ("rationale", ""), ("components", ["없음"]), ("exceptions", [{}])):
        with pytest.raises(ValueError):
            validate_terms({"schema_version": "0.1", "terms": [TERMS["terms"][0] | {k: v}]})


def test_selective_uses(spark):
    docs = _pairs(spark, ("d", ["body"], "말 말\n> 말", "뜻 말\n> 말"))
    use = {"document_id": "d", "scope": "body", "line": 1, "form": "말", "sense": "s", "rationale": "r"}
    both = [use | {"occurrence": 1, "decision": "replace", "after": "뜻", "after_line": 1, "after_occurrence": 1}, use | {"occurrence": 2, "decision": "preserve", "after_line": 1, "after_occurrence": 1}]

    def run(uses):
        terms = validate_senses({"schema_version": "0.1", "terms": [{"id": "t", "forms": ["말"], "senses": [{"id": "s", "definition": "d"}], "occurrences": uses}]})
        rows, done = audit_uses(docs, terms)
        return rows.collect(), done.first()

    rows, done = run(both)
    assert done.status == "기계 확인 완료" and all(r.status == "확인" for r in rows)
    assert run(both[:1])[1].undeclared == 1
    assert run([both[0], use | {"occurrence": 2, "decision": "ask"}])[1].ask_count == 1
    assert run([*both, use | {"line": 2, "occurrence": 1, "decision": "preserve", "after_line": 2, "after_occurrence": 1}])[1].stale == 1


def test_strengths(spark):
    pairs = spark.createDataFrame([("p", "하나 둘. 셋.\n\n넷. 끝", "하나 둘 셋 넷. 끝"), ("q", "말", "글"), ("e", "a", "b")], "pair_id string, baseline string, candidate string")
    s = "pair_id string, id string, policy string, baseline_text string, candidate_text string, position string, function string, surface_cost string, risk_if_smoothed string, review string, reviewer_note string"
    q = "pair_id string, id string, baseline_anchors array<string>, candidate_anchors array<string>, function string, review string, reviewer_note string, compression_review string, compression_note string"
    note = ("x", "x", "x", "x")
    strengths = spark.createDataFrame([("p", "s1", "exact", "하나 둘", None, *note, None, None), ("q", "s2", "exact", "말", None, *note, None, None)], s)
    none = spark.createDataFrame([], q)
    got = {r.pair_id: r.status for r in strength_status(pairs, strengths, none).collect()}
    assert got == {"p": "기계 확인 완료", "q": "보류", "e": "보류"}
    seq = lambda cr, cn, after=("하나", "넷"): spark.createDataFrame([("p", "k", ["하나", "넷"], list(after), "f", "preserved", "n", cr, cn)], q)
    assert sequence_records(pairs, seq(None, None)).first().failures == ["sequence layout compressed; compression review required"]
    assert sequence_records(pairs, seq("preserved", "ok")).first().failures == []
    assert not sequence_records(pairs, seq("preserved", "ok", ("넷", "하나"))).first().candidate_ordered
    assert {r.pair_id: r.status for r in strength_status(pairs, strengths, seq("preserved", "ok")).collect()}["p"] == "사람 판정 기록"


def _docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx(spark, tmp_path):
    p = lambda text, style="", num=False, bold=False: f'<w:p><w:pPr>{f"<w:pStyle w:val=\"{style}\"/>" if style else ""}{"<w:numPr/>" if num else ""}</w:pPr><w:r><w:rPr>{"<w:b/>" if bold else ""}</w:rPr><w:t>{text}</w:t></w:r></w:p>'
    payload = _docx(p("머리", "Heading1") + p("본문 😀") + p("굵은 본문 문단이다", bold=True) + p("a", num=True) * 3 + p("b") + p("c", num=True) + "<w:tbl><w:tc>" + p("표") + "</w:tc></w:tbl>")
    (tmp_path / "a.docx").write_bytes(payload)
    assert len(list(document_paragraphs(payload))) == 8
    got = format_findings(read_docx(spark, str(tmp_path))).collect()
    assert sorted((r.kind, r.paragraph, r.paragraphs) for r in got if r.kind != "list-run") == [("body-bold", 3, None), ("emoji", 2, None), ("short-heading", 1, None)]
    assert [r.paragraphs for r in got if r.kind == "list-run"] == [[4, 5, 6]]
