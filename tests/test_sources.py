import json

import pytest
from pyspark.sql import functions as F

from inkwarp.operators.biblio import by_year, completed_pages, first_by_key, languages, repeated_pages, run_sizes, summary, topic_signals, unique_in_harvest
from inkwarp.operators.ledger import build_ledger
from inkwarp.operators.scan import scan
from inkwarp.sources.documents import allow_profile, manifest, one_text, pair_manifest, protect_list, read_ledger, receipt, texts, write_ledger
from inkwarp.sources.harvest import fetch_pages, harvest_plan, parse_page, pdf_files, pdf_place, planned_requests, read_runs, redact, remaining_pages, store_pdf, verified_pdfs, write_raw, write_records


def _page(ids, total="3", extra=""):
    recs = "".join(f'<record><journalInfo><journal-name> 학보 </journal-name><pub-year>20{i:02d}</pub-year></journalInfo><articleInfo article-id="A{i}"><title-group><article-title lang="original">제목 {i}</article-title></title-group><abstract-group/><doi>10.1/{i}</doi></articleInfo></record>' for i in ids)
    return f'<m xmlns="urn:x"><total>{total}</total>{recs}{extra}<note>SECRET</note></m>'.encode()


def test_parse_and_redact():
    records, total = parse_page(_page([1, 2]))
    assert total == 3 and [r["source_id"] for r in records] == ["KX:A1", "KX:A2"] and records[0]["journal"]["name"] == "학보"
    assert records[0]["titles"] == [{"value": "제목 1", "attributes": {"lang": "original"}}] and records[0]["abstracts"] == [] and records[0]["pages"] == {"first": None, "last": None}
    assert parse_page(_page([], "many"))[1] is None
    with pytest.raises(RuntimeError):
        parse_page(_page([], extra="<error>no</error>"))
    assert b"SECRET" not in redact(_page([]), "SECRET")


def test_harvest(spark, tmp_path):
    plan = harvest_plan(spark, [{"id": "g", "terms": ["a", "b", "c"]}, {"id": "h", "terms": ["z"]}], ["title", "keyword"], ["g"])
    assert planned_requests(plan).first().requests == 6
    with pytest.raises(ValueError):
        harvest_plan(spark, [], ["title"])
    log = spark.createDataFrame([("g", "title", "a", 1, "ok"), ("g", "title", "b", 1, "failed")], "query_group string, field string, term string, page int, status string")
    pages = remaining_pages(plan.where("field = 'title'"), 4, log)
    assert pages.count() == 11 and completed_pages(log).count() == 1

    made = {n: _page([n] if n else []) for n in range(4)}

    def fetch(field, term, page):
        if term == "a":
            return made[1 if page == 2 else 2]
        if term == "b":
            raise OSError("secret inside")
        return made[page if page < 3 else 0]

    got = fetch_pages(pages, fetch, "SECRET", attempts=2, delays=(0,)).orderBy("term", "page").collect()
    assert [(r.term, r.page, r.status) for r in got] == [("a", 2, "ok"), ("a", 3, "ok"), ("a", 4, "repeated-page-stopped"), ("b", 1, "failed"), ("c", 1, "ok"), ("c", 2, "ok"), ("c", 3, "ok")]
    assert got[3].error == "OSError" and b"SECRET" not in bytes(got[0].payload) and got[0].records[0].article_id == "A1"
    done = fetch_pages(pages.where("term = 'c'"), fetch)
    write_raw(done, str(tmp_path / "raw"))
    with pytest.raises(Exception):
        write_raw(done, str(tmp_path / "raw"))
    records = unique_in_harvest(done.select(F.inline("records")))
    write_records(records, done.select("query_group", "field", "term", "page", "status"), str(tmp_path / "run1"))
    back = read_runs(spark, str(tmp_path / "run1" / "records"))
    assert back.count() == 2 and run_sizes(back).first().records_before_cross_run_deduplication == 2


E = "array<struct<value:string,attributes:map<string,string>>>"
R = f"rec int, article_id string, source_id string, journal struct<year:string>, titles {E}, abstracts {E}, doi string, uci string"


def test_rollups(spark):
    t = lambda s, lang="original": [(s, {"lang": lang} if lang else {})]
    rows = [(1, "A", "s", ("2020",), t("번역 연구"), t("x", "english"), None, "u"), (2, "A", "s", ("1999",), t("LLM"), None, "d", None), (3, None, "s3", (None,), t("K", None), t("문체"), "", ""), (4, None, None, ("2001",), None, None, None, None), (5, "", "s3", ("2002",), [], [], None, None)]
    df = spark.createDataFrame(rows, R)
    one = first_by_key(df, ["rec"])
    assert sorted(r.rec for r in one.collect()) == [1, 3]
    s = summary(df).first()
    assert (s.records_unique_across_runs, s.first_year, s.last_year, s.has_original_title, s.has_original_abstract, s.has_english_abstract, s.has_persistent_identifier) == (5, "1999", "2020", 2, 1, 1, 2)
    assert {r.year: r.records for r in by_year(df).collect()} == {"2020": 1, "1999": 1, "2001": 1, "2002": 1}
    assert {r.lang: r.entries for r in languages(df, "titles").collect()} == {"original": 2, "unknown": 1}
    hits = {r.topic: r.records for r in topic_signals(df).collect()}
    assert hits["ai_and_llm"] == 1 and hits["translation_and_post_editing"] == 1 and hits["style_and_naturalness"] == 1 and hits["quality_and_evaluation"] == 0
    same = df.select("article_id", "titles").union(df.select("article_id", "titles"))
    assert unique_in_harvest(same).count() == 4
    pages = spark.createDataFrame([("g", "f", "t", 1, ["a", None]), ("g", "f", "t", 2, ["b"]), ("g", "f", "t", 3, ["a", None]), ("g", "f", "u", 1, ["a", None])], "query_group string, field string, term string, page int, ids array<string>")
    assert [(r.term, r.page) for r in repeated_pages(pages).collect()] == [("t", 3)]
    none = spark.createDataFrame([], R)
    assert summary(none).first().records_unique_across_runs == 0 and first_by_key(none, ["rec"]).count() == 0


def test_manifests(spark, tmp_path):
    (tmp_path / "a.md").write_text("첫째\n", encoding="utf-8")
    (tmp_path / "b.md").write_text("둘째", encoding="utf-8")
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"documents": [{"id": "a", "path": "a.md"}, {"id": "b", "path": "b.md", "include": False}]}), encoding="utf-8")
    included, excluded = manifest(spark, str(m))
    assert [(r.document_id, r.role, r.text) for r in included.collect()] == [("a", "prose", "첫째\n")] and excluded.first().reason == "manifest에서 제외됨"
    for bad in ([], [{"id": "a", "path": ""}], [{"id": "a", "path": "a.md"}] * 2, [{"id": "a", "path": "none.md"}]):
        m.write_text(json.dumps({"documents": bad}), encoding="utf-8")
        with pytest.raises(ValueError):
            manifest(spark, str(m))[0].count()
    m.write_text(json.dumps({"schema_version": "0.1", "documents": [{"id": "x", "before": "a.md", "after": "b.md", "scopes": ["body"]}, {"id": "y", "before": "a.md", "after": "b.md", "scopes": ["body"], "include": False}]}), encoding="utf-8")
    assert [(r.document_id, r.before, r.after) for r in pair_manifest(spark, str(m)).collect()] == [("x", "첫째\n", "둘째")]
    assert texts(spark, str(tmp_path / "a.md")).first().text == "첫째\n"


def test_ledger_lists_and_receipts(spark, tmp_path):
    write_ledger(build_ledger(scan(one_text(spark, "첫째 또한"))), str(tmp_path / "l"))
    back = read_ledger(spark, str(tmp_path / "l"))
    assert sorted(r.anchor_id for r in back.collect()) == ["single-input:KH-S03:0:2:1", "single-input:KH-S04:3:5:2"]
    (tmp_path / "bad.json").write_text("[1]\nx\n")
    with pytest.raises(Exception):
        read_ledger(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "p.txt").write_text("# 주석\n\n 보호 \n값", encoding="utf-8")
    assert protect_list(spark, str(tmp_path / "p.txt")) == ["보호", "값"]
    (tmp_path / "a.json").write_text("[]")
    with pytest.raises(ValueError):
        allow_profile(str(tmp_path / "a.json"))
    assert json.loads(receipt(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "r.json"))) == {"a": 1, "b": None}


def test_pdf_files(spark, tmp_path):
    (tmp_path / "ART1.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "other.pdf").write_bytes(b"<html>")
    got = {r.article_id: (r.is_pdf, r.bytes) for r in pdf_files(spark, str(tmp_path)).collect()}
    assert got == {"ART1": (True, 10), None: (False, 6)}


def test_pdf_with_description(spark, tmp_path):
    place = pdf_place(str(tmp_path), "ART12", archive="some-archive")
    assert store_pdf(b"%PDF-1.4 text", place, source="archive")["bytes"] == 13
    with pytest.raises(RuntimeError):
        store_pdf(b"%PDF-1.4 text", place)
    with pytest.raises(RuntimeError):
        store_pdf(b"<html>", pdf_place(str(tmp_path), "ART13", file_id="KX_FI7"))
    for bad in ({}, {"archive": "a", "file_id": "KX_FI1"}, {"archive": "A b"}, {"file_id": "FI1"}):
        with pytest.raises(ValueError):
            pdf_place(str(tmp_path), "ART1", **bad)
    (tmp_path / "some-archive" / "ART9.pdf").write_bytes(b"%PDF-1.4")
    assert {r.article_id: (r.is_pdf, r.described) for r in verified_pdfs(spark, str(tmp_path)).collect()} == {"ART12": (True, True), "ART9": (True, False)}
