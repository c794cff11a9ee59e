import pytest
from pyspark.sql import functions as F

from inkwarp.operators.rules import KOREAN, Rule, gate_rules, validate_allowances, validate_rules
from inkwarp.operators.scan import all_counts, cross_document_repeats, distribution_maps, document_receipts, paragraph_rhythm, repeat_documents, rule_counts, rule_distribution, scan, scan_receipts, sentence_clusters

EDITED = {"provenance": "ai_edited"}


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t, "x") for i, t in enumerate(texts, 1)], "document_id string, text string, shape string")


def counts(df):
    return {r.rule_id: r.all_count for r in rule_counts(df).collect()}


def test_korean_pack_is_valid():
    assert len(validate_rules(KOREAN)) == 26 and sum(r.anchor_type == "regex" for r in KOREAN) == 20


@pytest.mark.parametrize("bad", [[], [Rule("X1", "regex", "a")], [Rule("KH-S01", "regex", "(")], [Rule("KH-S01", "odd")], [Rule("KH-S01", "structural", structural_kind="no")], [Rule("KH-S01", "sentence_run", minimum_run=1)], [Rule("KH-S01", "regex", "a")] * 2])
def test_bad_rules(bad):
    with pytest.raises(ValueError):
        validate_rules(bad)


def test_plain_anchors(spark):
    text = "결론적으로 첫째는 중요하고 핵심적이다. 또한, 이것을 통해 알 수 있다고 하며, 할 필요가 있다.\n이는 매우 중요한 일이 아니라 문제를 넘어 새 길로 간다. 번역에 의해 되었다. 사용자 경험(user experience)을 위해서 다룬다."
    got = counts(scan(docs(spark, text)))
    want = {"KH-S01": 1, "KH-S02": 1, "KH-S03": 1, "KH-S04": 1, "KH-S07": 1, "KH-S12": 1, "KH-S13": 1, "KH-S16": 1, "KH-S17": 1, "KH-S18": 1, "KH-S19": 1, "KH-S20": 1, "KH-S21": 1, "KH-S26": 1}
    assert got == want
    assert counts(scan(docs(spark, text), translation_source=True)) == want | {"KH-S06": 1}


def test_offsets_lines_and_context(spark):
    r = scan(docs(spark, "# 제목\n\n앞 😀 글. 둘째 줄\n또한 끝")).where("rule_id = 'KH-S04'").first()
    assert (r.start, r.end, r.line, r.column, r.evidence) == (18, 20, 4, 1, "또한")
    assert (r.paragraph, r.sentence_in_paragraph, r.section_heading, r.is_document_last, r.body_paragraphs_to_end) == (2, 2, "제목", True, 1)
    assert r.context == "# 제목 앞 😀 글. 둘째 줄 또한 끝"


@pytest.mark.parametrize("text", ["“결론적으로 첫째”", "> 결론적으로 첫째\n> 또한", "<!-- 결론적으로 -->", "```\n첫째\n```", "<!-- inkwarp:protect-start -->\n첫째 또한\n<!-- inkwarp:protect-end -->", "뒤다만 말고라고 아니라고", None, "", " \n "])
def test_nothing_found(spark, text):
    assert scan(docs(spark, text)).count() == 0


def test_extra_protection(spark):
    assert counts(scan(docs(spark, "첫째 둘째"), extra=["첫째"])) == {"KH-S03": 1}


def test_sentence_runs_stop_at_protected_and_other_sentences(spark):
    run = "하나를 말한다. 둘을 말한다.\n\n셋을 말한다."
    got = scan(docs(spark, run, "가를 한다. 나를 한다. “보호” 문장이다. 다를 한다.", "가를 한다. 나를 한다! 다를 한다.")).collect()
    assert [(r.document_id, r.start, r.end, r.evidence) for r in got] == [("d1", 0, len(run), "한다 종결 3문장 연속")]


def test_triads(spark):
    got = scan(docs(spark, "글은 고치고 다듬고 지운다. 있다고 하고 갔다고 했다.")).where("rule_id = 'KH-S40'").collect()
    assert [(r.start, r.end, r.shape) for r in got] == [(0, 14, "삼항 병렬: -고/-며")]


def test_structural_rules_are_gated(spark):
    text = "이 장은 기준을 다룬다. 뒤 문장이다.\n\n처음의 그 방으로 돌아가자.\n\n답은 분명하다.\n\n**굵은 말** 하나\n\n**다른 말** 둘\n\n**끝 말** 셋"
    assert counts(scan(docs(spark, text), **EDITED)) == {"KH-S34": 1, "KH-S35": 1, "KH-S36": 1, "KH-S37": 1}
    assert counts(scan(docs(spark, text), provenance="rule_guided_draft")) == {"KH-S34": 1, "KH-S35": 1, "KH-S36": 1, "KH-S37": 1}
    assert scan(docs(spark, text)).count() == 0
    assert counts(scan(docs(spark, "**제 1 장** a\n\n**2부** b\n\n**부록** c"), **EDITED)) == {}
    with pytest.raises(ValueError):
        gate_rules(KOREAN, provenance="other")


def test_allowances_split_counts(spark):
    profile = {"genre": "목차", "allow": [{"rule_id": "KH-S03", "scope": "heading", "reason": "목차"}]}
    allow = validate_allowances(profile, {r.id for r in KOREAN})
    r = rule_counts(scan(docs(spark, "# 첫째 제목\n\n본문 첫째."), allow=allow)).first()
    assert (r.active_count, r.allowed_count, r.all_count) == (1, 1, 2)
    for bad in ({}, {"genre": "x"}, {"genre": "x", "allow": [{"rule_id": "no", "scope": "all", "reason": "r"}]}, {"genre": "x", "allow": profile["allow"] * 2}, {"genre": "x", "allow": [{"rule_id": "KH-S03", "scope": "x", "reason": "r"}]}, {"genre": "x", "allow": [{"rule_id": "KH-S03", "scope": "all", "reason": " "}]}):
        with pytest.raises(ValueError):
            validate_allowances(bad, {"KH-S03"})


def test_clusters_repeats_and_distribution(spark):
    found = scan(docs(spark, "가고, 나며, 다지만, 끝.", "이 장은 이것을 다룬다.\n\n답은 분명하다.", "이 글은 저것을 다룬다.\n\n끝은 분명하다."), **EDITED)
    c = sentence_clusters(found).where("rule_id = 'KH-S07'").first()
    assert (c.sentences_with_findings, c.sentences_with_2plus, c.max_per_sentence) == (1, 1, 3)
    got = {r.rule_id: r for r in cross_document_repeats(found).collect()}
    assert set(got) == {"KH-S34", "KH-S36"} and got["KH-S34"].documents == 2 and len(got["KH-S36"].examples) == 2
    assert {(r.document_id, r.occurrences) for r in repeat_documents(found).where("rule_id = 'KH-S34'").collect()} == {("d2", 1), ("d3", 1)}
    flat = rule_distribution(found).where("rule_id = 'KH-S07'").collect()
    assert [(r.value, r.occurrences) for r in flat if r.part == "document"] == [("d1", 3)] and sum(r.occurrences for r in flat if r.part == "evidence") == 3
    d = {r.rule_id: r for r in distribution_maps(found, 1).collect()}
    assert d["KH-S07"].occurrences == 3 and d["KH-S07"].documents == {"d1": 3} and len(d["KH-S07"].evidence) == 1
    assert all_counts(found).where("level = 3").first().all_count == found.count()


def test_rhythm(spark):
    text = "# 머리\n\n하나. 둘.\n\n> 인용\n\n- a\n- b\n\n| a | b |\n| - | - |\n\n---\n\n셋만"
    r = paragraph_rhythm(docs(spark, text, "")).orderBy("document_id").collect()
    assert (r[0].paragraph_count, r[0].single_sentence_paragraph_ratio, r[0].median_sentences_per_paragraph) == (2, 0.5, 1.5)
    assert all(r[0][f"excluded_{k}"] == 1 for k in ("heading", "blockquote", "list", "table", "horizontal_rule"))
    assert r[1].paragraph_count == 0 and r[1].mean_sentences_per_paragraph is None


def test_receipts(spark):
    d = docs(spark, "<!-- x -->\n```\na\n```\n첫째 12명 <!-- inkwarp:protect-start -->", None)
    r = document_receipts(d, scan(d)).collect()
    assert len(r) == 1 and (r[0].html_comments, r[0].fenced_code_blocks, r[0].unbalanced_markers, r[0].protected_spans_excluded, r[0].finding_count) == (2, 1, True, 1, 1)


def test_long_text_and_ties(spark):
    got = scan(docs(spark, "첫째 " * 3000, "첫째", "첫째")).groupBy("document_id").agg(F.count("*").alias("n")).collect()
    assert {r.document_id: r.n for r in got} == {"d1": 3000, "d2": 1, "d3": 1}


def test_receipts_of_a_scan_equal_those_of_findings(spark):
    d = docs(spark, "# 첫째\n\n둘째 3명. 또한 <!-- x --> 끝.", "```\n첫째\n```\n\n“둘째”", "", None)
    allow = validate_allowances({"genre": "g", "allow": [{"rule_id": "KH-S03", "scope": "heading", "reason": "r"}, {"rule_id": "KH-S04", "scope": "first_sentence", "reason": "r"}]}, {r.id for r in KOREAN})
    key = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert key(scan_receipts(d, allow=allow)) == key(document_receipts(d, scan(d, allow=allow)))
