"""Spans, masks and lines against plain loops, and the term audit on many terms at once."""

import random
import re

from inkwarp.functions.offsets import find_all, find_value, mask_spans, nth_on_line, split_spans
from inkwarp.functions.spans import verify_protected
from inkwarp.operators.markdown import line_kinds, scope_lines, scope_view
from inkwarp.operators.terms import term_failures, term_rollup, term_scopes, term_status, validate_terms
from pyspark.sql import functions as F


def test_spans_and_masks_equal_plain_loops(spark):
    rng = random.Random(1)
    rows = []
    for i in range(150):
        text = "".join(rng.choice("ab \n'c한😀\\E") for _ in range(rng.choice([0, 5, 40, 600])))
        cuts = [tuple(sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)))) for _ in range(rng.choice([0, 1, 5, 300]))]
        rows.append((i, text, cuts, rng.choice(["a", "한", "\\E", "b'", "", "aa"])))
    df = spark.createDataFrame(rows, "i int, t string, s array<struct<start:int,end:int>>, v string")
    t = F.col("t")
    for r in df.select("*", mask_spans(t, F.col("s")).alias("m"), find_all(t, "(?:a|'|\\n)b?").alias("f"), split_spans(t, "a+").alias("g"), find_value(t, F.col("v")).alias("w")).collect():
        shown = list(r.t)
        for x in r.s:
            shown[x.start : x.end] = [c if c == "\n" else " " for c in shown[x.start : x.end]]
        assert "".join(shown) == r.m
        assert [tuple(x) for x in r.f] == [(m.start(), m.end(), m.group()) for m in re.finditer("(?:a|'|\\n)b?", r.t)]
        assert [x.value for x in r.g] == re.split("a+", r.t)
        assert [tuple(x) for x in r.w] == ([(m.start(), m.end(), r.v) for m in re.finditer(re.escape(r.v), r.t)] if r.v else [])


def test_line_ends(spark):
    text = "# a\r\nbody\rmore [^1]: note\x0c    goes on\n\nT\n---\nx | y\n--- | ---\n1 | 2\nend"
    assert line_kinds(text) == ["heading", "body", "body", "footnote", "footnote", "footnote", "heading", "heading", "table", "table", "table", "body"]
    df = spark.createDataFrame([(text,), ("",), (None,), ("\n\r\n",)], "t string")
    rows = df.select("t", scope_lines(F.col("t")).alias("k")).select("t", "k", scope_view(F.col("t"), F.col("k"), "body").alias("v"), nth_on_line(F.col("t"), F.lit("m"), F.lit(3), F.lit(1)).alias("n")).collect()
    assert rows[0].v.split() == ["body", "more", "end"] and len(rows[0].v) == len(text) and rows[0].v.index("more") == text.index("more")
    assert (rows[0].n.start, rows[0].n.end) == (text.index("m"), text.index("m") + 1)
    assert [r.v for r in rows[1:]] == ["", None, "\n\r\n"] and rows[2].k is None


def test_fences_notes_and_tables():
    assert line_kinds("````\n# x\n```\n````\n# y") == ["code", "code", "code", "code", "heading"]
    assert line_kinds("[^a]: n\n\n    | t\n    # h\nb") == ["footnote", "footnote", "footnote", "heading", "body"]
    assert line_kinds("a\n===\n---\nb\\|c\n-|-") == ["heading", "heading", "body", "body", "body"]
    assert line_kinds("") == [] and line_kinds("a | b\n---|---\n| c\n\n| d") == ["table", "table", "table", "body", "body"]


def test_many_terms_equal_one_by_one(spark):
    rng = random.Random(4)
    words = [f"낱말{i}" for i in range(12)]
    terms = [{"id": f"t{i}", "old": [w, f"{w} 둘"], "new": f"새말{i} 이름", "scope": ["body"] if i % 2 else ["body", "heading"], "rationale": "r"} for i, w in enumerate(words)]
    rows = [(f"d{i}", ["body", "heading"], " ".join(rng.choices([*words, "새말1 이름.", "둘", "“낱말3”", "\n\n# "], k=60)), " ".join(rng.choices([*words, "새말2 이름.", "둘"], k=60))) for i in range(4)]
    documents = spark.createDataFrame(rows, "document_id string, scopes array<string>, before string, after string")
    key = lambda r: (r.term_id, r.document_id, r.scope)
    together = {key(r): r.asDict(True) for r in term_scopes(documents, validate_terms({"schema_version": "0.1", "terms": terms})).collect()}
    for one in (terms[1], terms[2]):
        alone = {key(r): r.asDict(True) for r in term_scopes(documents, validate_terms({"schema_version": "0.1", "terms": [one]})).collect()}
        assert alone == {k: v for k, v in together.items() if k[0] == one["id"]} and alone
    assert sum(x["count"] for r in together.values() for x in r["old_counts_before"]) == sum(r["old_count_before"] for r in together.values())


def test_what_holds_a_migration(spark):
    terms = validate_terms({"schema_version": "0.1", "terms": [{"id": "t", "old": ["경기"], "new": "시합", "scope": ["body", "table"], "rationale": "r", "exceptions": [{"text": "경기", "reason": "x", "document_id": "gone", "scope": "body", "line": 1, "occurrence": 1}]}]})
    documents = spark.createDataFrame([("d", ["body"], "경기와 경기와 시합.", "경기와 시합.")], "document_id string, scopes array<string>, before string, after string")
    scopes = term_scopes(documents, terms)
    assert [tuple(x) for x in scopes.first().new_sentence_contexts] == [(1, 0, 7, "경기와 시합.")]
    rollup = term_rollup(scopes)
    found = {(r.document_id, r.problem): r["count"] for r in term_failures(term_status(documents, terms, rollup), rollup).collect()}
    assert found == {("d", "residue"): 1, ("d", "gap"): 2, (None, "missing scope"): 1, (None, "stale exception"): 1}


def test_protection_receipt(spark):
    pairs = spark.createDataFrame([("a", "3명과 “말”", "3명과 “말”"), ("b", "3명과 4명", "3명"), ("c", None, "3명")], "pair_id string, before string, after string")
    got = {r.pair_id: (r.before_protected_span_count, r.missing, r.status) for r in verify_protected(pairs, ["pair_id"]).collect()}
    assert got == {"a": (2, 0, "통과"), "b": (2, 1, "보류"), "c": (0, 0, "통과")}
