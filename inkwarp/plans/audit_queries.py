"""Queries of the audit operators over the manuscripts, ledger and rules tables, with DuckDB forms where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarp.functions.normal import rule_key, rule_sql
from inkwarp.functions.offsets import anchors_in_order, column_of, context, count_literal, find_all, line_of, mask, nth_on_line, settle
from inkwarp.functions.spans import DATE, QUOTATION, STATUTE, lost_values, verify_protected, with_protected
from inkwarp.functions.structure import with_structure
from inkwarp.operators.edits import measure_edits
from inkwarp.operators.gate import MEND_FIRST, REVIEW_NEXT, compare_candidates, rule_deltas, style_gate
from inkwarp.operators.iterations import iteration_audit, iteration_states
from inkwarp.operators.ledger import build_ledger, coverage, reconcile
from inkwarp.operators.markdown import changed_keys, scope_lines, signature
from inkwarp.operators.rules import KOREAN, STRUCTURAL_KINDS, Allowance, Rule, gate_rules, validate_rules
from inkwarp.operators.scan import all_counts, cross_document_repeats, paragraph_rhythm, repeat_documents, rule_counts, rule_distribution, scan, scan_receipts, sentence_clusters
from inkwarp.operators.strength import sequence_records, strength_records
from inkwarp.operators.terms import audit_uses, discovered_uses, term_rollup, term_scopes, term_status, validate_senses, validate_terms
from inkwarp.plans.scan_sql import DOCS, LINES, SPACE, findings, line_kinds, occurrences, quoted, scope_texts, starts
from inkwarp.plans.scan_sql import protected as protected_sql
from inkwarp.plans.scan_sql import receipts as receipts_sql
from inkwarp.plans.scan_sql import rhythm as rhythm_sql
from inkwarp.plans.scan_sql import signature as signature_sql
from inkwarp.plans.scan_sql import structure as structure_sql
from inkwarp.sources.documents import EXCLUDED, listed_documents
from inkwarp.sources.tables import table

NUMBER = "[0-9]+(?:[.,][0-9]+)?"
BRACKET = "[(][^()\n]{1,80}[)]"
#: The edit that makes a second version of every manuscript: words replaced, a heading mark dropped, a number changed.
EDITS = (("경기", "시합"), ("match play", "play"), ("## ", "# "), ("7", "8"))
#: The scopes a text is read in; glossary and index are documents of their own.
SCOPES_OF = {"": ("body", "heading", "table", "footnote"), ":glossary": ("glossary",), ":index": ("index",)}
TERMS = {
    "schema_version": "0.1",
    "terms": [
        {"id": "match", "old": ["경기", "match play"], "new": "시합", "scope": ["body", "heading", "table", "footnote", "glossary"], "rationale": "one word"},
        {"id": "soil", "old": ["토양"], "new": "흙", "scope": ["body", "footnote", "index"], "rationale": "plain word"},
    ],
}
FORMS = [{"id": "match", "forms": ["경기", "선수"]}, {"id": "sky", "forms": ["은하", "orbit"]}]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Manuscripts once each, with a text.

    The partitioning by document is stated with a number, so that the few bytes of a small table still keep all cores busy with what
    follows; the aggregate needs it anyway.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, folder, "manuscripts").where("text is not null").select("document_id", "text").repartition(parts, "document_id").groupBy("document_id").agg(F.min("text").alias("text"))


def _edited(text: F.Column) -> F.Column:
    for old, new in EDITS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(F.col("document_id").alias("pair_id"), F.lit("edit").alias("candidate"), F.col("text").alias("before"), _edited(F.col("text")).alias("after"))


#: Allowances of the query of that name.
ALLOWED = (Allowance("KR-C01", "heading", "a title may name it"), Allowance("KR-C02", "first_sentence", "opens"), Allowance("KR-N01", "all", "numbers"), Allowance("KR-C03", "body", "in text"), Allowance("KR-C03", "all", "anywhere"))
ORIGIN = {"translation_source": True, "provenance": "ai_edited"}
STRUCTURAL = tuple(r for r in KOREAN if r.anchor_type == "structural")


def table_rules(spark: SparkSession, folder: str) -> tuple[Rule, ...]:
    """The rules of the table, of all anchor types, and the structural ones of the built-in pack.

    A rule of a structural kind that no scan knows is no rule of the pack.
    """
    rows = table(spark, folder, "rules").orderBy("id").collect()  # a fixed, small table
    known = [r for r in rows if r.anchor_type != "structural" or r.structural_kind in STRUCTURAL_KINDS]
    own = [Rule(r.id, r.anchor_type, r.pattern, r.structural_kind, r.minimum_run, tuple(r.requires or ())) for r in known]
    return validate_rules([*own, *STRUCTURAL], None)


def ledger_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger rows as findings, each anchor once; rule ids in one form; those held to be false are the allowed ones."""
    once = table(spark, folder, "ledger").groupBy("anchor_id").agg(F.min(F.struct("document_id", F.col("rule_id"), "start_pos", "end_pos", "line_no", "column_no", "evidence", "context", "paragraph", "sentence_in_paragraph", "shape")).alias("r"), F.bool_or(F.col("verdict") == "false_positive").alias("allowed"))
    return once.select("r.document_id", rule_key(F.col("r.rule_id")).alias("rule_id"), F.col("r.start_pos").alias("start"), F.col("r.end_pos").alias("end"), F.col("r.line_no").alias("line"), F.col("r.column_no").alias("column"), "r.evidence", "r.context", "r.paragraph", "r.sentence_in_paragraph", "r.shape", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def anchor_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Every number of every manuscript with its offsets, line and column."""
    rows = documents(spark, folder).select("document_id", "text", F.explode(find_all(F.col("text"), NUMBER)).alias("s"))
    return rows.select("document_id", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), line_of(F.col("text"), F.col("s.start")).alias("line_no"), column_of(F.col("text"), F.col("s.start")).alias("column_no"), F.col("s.value").alias("value"))


def anchor_context(spark: SparkSession, folder: str) -> DataFrame:
    """Every term in brackets with its surroundings."""
    rows = documents(spark, folder).select("document_id", "text", F.explode(find_all(F.col("text"), BRACKET)).alias("s"))
    return rows.select("document_id", F.col("s.start").alias("start_pos"), context(F.col("text"), F.col("s.start"), F.col("s.end")).alias("context"))


def masked_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Manuscripts with their brackets blanked: length as before, hash, number of masks."""
    t = F.col("text")
    return settle(documents(spark, folder), m=mask(t, BRACKET)).select("document_id", F.length("m").alias("n"), F.sha2("m", 256).alias("hash"), F.regexp_count(t, F.lit(BRACKET)).alias("masks"))


def literal_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often declared literals occur in each manuscript."""
    return documents(spark, folder).select("document_id", *[count_literal(F.col("text"), x).alias(f"n{i}") for i, x in enumerate(("경기", "orbit", ". ", "\n\n"))])


def protected_quotes_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Quotations, dates and statutes of the manuscripts."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), find_all(F.col("text"), p).alias("spans")) for k, p in (("quotation", QUOTATION), ("date", DATE), ("statute", STATUTE))])
    rows = documents(spark, folder).select("document_id", F.inline(kinds)).select("document_id", "kind", F.explode("spans").alias("s"))
    return rows.select("document_id", "kind", F.col("s.start").alias("start_pos"), F.col("s.value").alias("value"))


def protected_values(spark: SparkSession, folder: str) -> DataFrame:
    """All protected spans of the manuscripts."""
    rows = with_protected(documents(spark, folder), "text").select("document_id", F.inline("protected"))
    return rows.select("document_id", "kind", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "value")


def paragraph_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of the manuscripts with offsets, kind and heading."""
    rows = with_structure(documents(spark, folder), "text").select("document_id", F.inline("structure"))
    return rows.select("document_id", "paragraph", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "kind", "heading")


def section_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Section path, sentences and body rank of every block."""
    rows = with_structure(documents(spark, folder), "text").select("document_id", F.inline("structure"))
    return rows.select("document_id", "paragraph", "section_heading", F.size("sentences").alias("sentences"), F.col("bodies").alias("bodies"))


def rhythm(spark: SparkSession, folder: str) -> DataFrame:
    return paragraph_rhythm(documents(spark, folder))


def scan_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the table's rules and of runs, chains and structure in all manuscripts."""
    found = scan(documents(spark, folder), table_rules(spark, folder), **ORIGIN)
    return found.withColumnsRenamed({"start": "start_pos", "end": "end_pos", "line": "line_no", "column": "column_no"})


def scan_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rule_counts(scan(documents(spark, folder), table_rules(spark, folder), **ORIGIN))


def scan_allowances(spark: SparkSession, folder: str) -> DataFrame:
    """Findings by rule and by the allowance that takes them."""
    return rule_counts(scan(documents(spark, folder), table_rules(spark, folder), allow=ALLOWED, **ORIGIN), ("rule_id", "allow_scope", "allow_reason"))


def scan_korean(spark: SparkSession, folder: str) -> DataFrame:
    return rule_counts(scan(documents(spark, folder), KOREAN, translation_source=True, provenance="ai_edited"))


#: Paragraphs that hold every anchor of the built-in pack, and near misses of some.
PLANTED = """

결론적으로 첫째는 중요하고 핵심적이다. 또한, 이것을 통해 알 수 있다고 하며, 할 필요가 있다. 매우 중요한 일이 아니라 문제를 넘어 새 길로 간다. 아니라고 한 적은 없다. 한편으로는 다만 그렇다.
이는 번역에 의해 되었다. 사용자 경험(user experience)을 위해서 할 수 있다. 이에 대해 말한다. 만들어진 것이다. 역할과 기능이 긴밀하게 연결된다. 그러하다는 것이다. 이 글에서는 강을 살펴본다. 말다만 한다.

이 장은 차를 다룬다. 이제 숲으로 돌아가자. 답은 분명하다. 이유는 세 가지이다. 한 문장으로 말하면 길다.

밥을 먹습니다. 물이 있습니다. 산이 높습니다. 길을 간다. “첫째”라고 적었다.

**물**을 본다.

**불**을 본다.

**흙**을 본다.

길을 걷고, 물을 마시며, 산을 본다. 먹는다고, 잔다고, 논다고 한다.
"""


def scan_planted(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of every anchor of the built-in pack in the manuscripts, each with the planted paragraphs behind it."""
    planted = documents(spark, folder).withColumn("text", F.concat("text", F.lit(PLANTED)))
    return scan(planted, KOREAN, **ORIGIN).withColumnsRenamed({"start": "start_pos", "end": "end_pos", "line": "line_no", "column": "column_no"})


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    return scan_receipts(documents(spark, folder), KOREAN)


def ledger_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rule_counts(ledger_findings(spark, folder))


def ledger_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return all_counts(ledger_findings(spark, folder))


def ledger_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of every rule by document and by evidence."""
    return rule_distribution(ledger_findings(spark, folder).where("rule_id is not null"))


def ledger_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence that several documents share, as shapes, with the first example."""
    found = cross_document_repeats(ledger_findings(spark, folder).where("rule_id is not null").withColumn("shape", F.col("evidence")))
    return found.select("rule_id", "shape", "documents", "occurrences", F.size("examples").alias("examples"), F.col("examples")[0]["document_id"].alias("first_document"), F.col("examples")[0]["line"].alias("first_line"), F.col("examples")[0]["context"].alias("first_context"))


def ledger_repeat_documents(spark: SparkSession, folder: str) -> DataFrame:
    return repeat_documents(ledger_findings(spark, folder).where("rule_id is not null").withColumn("shape", F.col("evidence")))


def ledger_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_clusters(ledger_findings(spark, folder))


def ledger_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Anchor ids built anew from the distinct findings of the ledger."""
    found = ledger_findings(spark, folder).where("rule_id is not null").groupBy("document_id", "rule_id", "start", "end").agg(F.min("line").alias("line"), F.min("shape").alias("shape"))
    return build_ledger(found).select("anchor_id", F.col("line").alias("line_no"))


def _expected(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "rules").select(F.col("id").alias("rule_id"))
    return table(spark, folder, "ledger").join(F.broadcast(known), "rule_id", "left_semi").select("anchor_id")


def coverage_states(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors of known rules against the reviews of texts that are kept: what is missing, unknown, unresolved or reviewed."""
    rows = table(spark, folder, "ledger").where("document_id <> 'single-input'")
    states = reconcile(_expected(spark, folder), rows, F.struct("exported_at", "review_method", "verdict"))
    return states.groupBy("state", "expected").agg(F.count(F.lit(1)).alias("anchors"), F.sum("ledger_rows").alias("ledger_rows"))


def coverage_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ledger").where("document_id <> 'single-input'")
    return coverage(reconcile(_expected(spark, folder), rows, F.struct("exported_at", "review_method", "verdict")), "residual").select("mode", "anchors_total", "anchors_reviewed", "anchors_human_reviewed", "anchors_unresolved", "missing", "unknown", "duplicates", "status")


def protected_loss(spark: SparkSession, folder: str) -> DataFrame:
    return lost_values(pairs(spark, folder), ["pair_id"])


def gate_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return rule_deltas(pairs(spark, folder), table_rules(spark, folder), **ORIGIN)


def gate_status(spark: SparkSession, folder: str) -> DataFrame:
    gate = style_gate(pairs(spark, folder), ["KR-C03", "KR-C07"], ["KR-C07"], rules=table_rules(spark, folder), **ORIGIN)
    joined = [F.array_join(c, ",").alias(c) for c in ("target_reduced", "target_preserved", "invalid_preserved_rules", "target_unverifiable", "target_unresolved", "target_regressions", "introduced_candidates")]
    return gate.select("pair_id", "candidate", *joined, F.size("lost_values").alias("lost"), "status")


def markdown_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Headings with levels, bold markers, emoji and fences of every manuscript."""
    rows = settle(documents(spark, folder), s=signature(F.col("text")))
    said = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[a].cast("string"), x[b])), "|")
    return rows.select("document_id", said("s.headings", "level", "title").alias("headings"), F.col("s.bold_markers").alias("bold_markers"), F.array_join("s.emoji", "|").alias("emoji"), said("s.fences", "mark", "info").alias("fences"))


def markdown_changes(spark: SparkSession, folder: str) -> DataFrame:
    """What differs in the signatures of a manuscript and its edit."""
    return pairs(spark, folder).select("pair_id", F.array_join(changed_keys(F.col("before"), F.col("after")), ",").alias("changed"))


def edit_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return measure_edits(pairs(spark, folder), ["pair_id"])


def scope_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each kind in every manuscript."""
    rows = documents(spark, folder).select("document_id", F.explode(scope_lines(F.col("text"))).alias("kind"))
    return rows.groupBy("document_id", "kind").agg(F.count(F.lit(1)).alias("lines"))


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries of an article as versions of all its titles and abstracts."""
    entries = F.concat(F.coalesce("titles", F.array()), F.coalesce("abstracts", F.array()))
    text = F.lower(F.array_join(F.transform(entries, lambda e: F.coalesce(e["value"], F.lit(""))), "\n"))
    rows = table(spark, folder, "records").where("article_id is not null").select("rec_no", F.col("article_id").alias("chain_id"), text.alias("text"))
    first = rows.where("text <> ''").groupBy("chain_id").agg(F.min("rec_no").alias("f"))
    return rows.where("text <> ''").join(first, "chain_id").select("chain_id", (F.col("rec_no") - F.col("f")).cast("int").alias("ord"), F.col("rec_no").cast("string").alias("label"), "text")


def iteration_rows(spark: SparkSession, folder: str) -> DataFrame:
    return iteration_states(_versions(spark, folder)).select("chain_id", "ord", "hash", "same_as_previous", "changed_after_no_change", "returned_to")


def iteration_chains(spark: SparkSession, folder: str) -> DataFrame:
    return iteration_audit(_versions(spark, folder))[1]


def _scoped(p: DataFrame) -> DataFrame:
    return p.select(F.inline(F.array(*[F.struct(F.concat("document_id", F.lit(end)).alias("document_id"), F.array(*map(F.lit, scopes)).alias("scopes")) for end, scopes in SCOPES_OF.items()])), "before", "after")


def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the migration of two terms, by scope, document and term and in all."""
    p = _scoped(pairs(spark, folder).withColumnRenamed("pair_id", "document_id"))
    return term_rollup(term_scopes(p, validate_terms(TERMS)))


def term_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Status of the migration where no document has the scope index and an exception points to no document."""
    p = _scoped(pairs(spark, folder).withColumnRenamed("pair_id", "document_id")).where(~F.array_contains("scopes", "index"))
    lost = {"text": "토양", "reason": "name", "document_id": "nowhere", "scope": "body", "line": 1, "occurrence": 1}
    terms = validate_terms(TERMS | {"terms": [TERMS["terms"][0], TERMS["terms"][1] | {"exceptions": [lost]}]})
    return term_status(p, terms, term_rollup(term_scopes(p, terms))).withColumn("missing_scopes", F.array_join("missing_scopes", ","))


def sense_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and status of a selective audit that declares one use, in a document that is not there."""
    p = _scoped(documents(spark, folder).select("document_id", F.col("text").alias("before"), _edited(F.col("text")).alias("after")))
    use = {"document_id": "nowhere", "scope": "body", "line": 1, "occurrence": 1, "sense": "s", "decision": "preserve", "after_line": 1, "after_occurrence": 1, "rationale": "r"}
    terms = validate_senses({"schema_version": "0.1", "terms": [t | {"senses": [{"id": "s", "definition": "d"}], "occurrences": [use | {"form": t["forms"][0]}]} for t in FORMS]})
    return audit_uses(p, terms)[1]


def term_residues(spark: SparkSession, folder: str) -> DataFrame:
    """Old words that are left, and the sentences with the new ones, with their places."""
    p = _scoped(pairs(spark, folder).withColumnRenamed("pair_id", "document_id"))
    rows = term_scopes(p, validate_terms(TERMS))
    old = lambda c, kind: F.transform(c, lambda r: F.struct(F.lit(kind).alias("kind"), r["old"].alias("value"), r["start"].alias("start_pos"), r["line"].alias("line_no"), r["context"].alias("context")))
    new = F.transform("new_sentence_contexts", lambda r: F.struct(F.lit("sentence").alias("kind"), F.lit(None).cast("string").alias("value"), r["start"].alias("start_pos"), r["line"].alias("line_no"), r["context"].alias("context")))
    return rows.select("term_id", "document_id", "scope", F.inline(F.concat(old("residues", "residue"), old("protected_residues", "protected"), new)))


def term_uses(spark: SparkSession, folder: str) -> DataFrame:
    """Unprotected occurrences of two forms, by line and number on it."""
    p = _scoped(documents(spark, folder).select("document_id", F.col("text").alias("before"), F.col("text").alias("after")))
    return discovered_uses(p, FORMS).withColumnRenamed("line", "line_no")


def nth_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Span of the second full stop on the third line of every manuscript."""
    rows = documents(spark, folder).select("document_id", nth_on_line(F.col("text"), F.lit("."), F.lit(3), F.lit(2)).alias("s"))
    return rows.select("document_id", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))


def corpus_included(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the corpus that are scanned, each once."""
    return listed_documents(table(spark, folder, "manuscripts"))[0].select("document_id", "path", "role", F.sha2("text", 256).alias("hash")).distinct()


def corpus_excluded(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the corpus that are left out, each once, with the reason."""
    return listed_documents(table(spark, folder, "manuscripts"))[1].select("document_id", "path", "role", "reason").distinct()


def protected_receipts(spark: SparkSession, folder: str) -> DataFrame:
    return verify_protected(pairs(spark, folder), ["pair_id"])


def candidate_choices(spark: SparkSession, folder: str) -> DataFrame:
    """What can be compared of two candidates for every manuscript: the edit, and the edit with all digits dropped."""
    p = pairs(spark, folder)
    bare = p.withColumn("candidate", F.lit("bare")).withColumn("after", F.regexp_replace("after", "[0-9]", ""))
    return compare_candidates(p.unionByName(bare), ["KR-C03"], rules=table_rules(spark, folder), **ORIGIN)[1].select("pair_id", F.array_join("eligible_candidates", ",").alias("eligible"), "next_step")


def strength_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Strengths of every manuscript, of a policy and review that follow from its length, and what is wrong with them in the edit."""
    p = pairs(spark, folder).select("pair_id", F.col("before").alias("baseline"), F.col("after").alias("candidate"))
    n = F.length("baseline")
    policy = F.element_at(F.array(*map(F.lit, ("exact", "functional", "ask", "other"))), n % 4 + 1)
    s = p.select(
        "pair_id", F.lit("s").alias("id"), policy.alias("policy"), F.substring("baseline", 1, 40).alias("baseline_text"), F.substring("candidate", 5, 10).alias("candidate_text"), F.lit("start").alias("position"),
        F.when(n % 5 > 0, "opens").alias("function"), F.lit("none").alias("surface_cost"), F.lit("flat").alias("risk_if_smoothed"), F.when(n % 3 == 0, "preserved").when(n % 3 == 1, "kept").alias("review"), F.when(n % 7 > 1, "read").alias("reviewer_note"),
    )
    return strength_records(p, s).select("pair_id", "id", "policy", "baseline_found", "candidate_found", "review", "human", F.array_join("failures", "; ").alias("failures"))


def anchor_order(spark: SparkSession, folder: str) -> DataFrame:
    """Starts of three anchors found one after the other, null if one is not."""
    return documents(spark, folder).select("document_id", anchors_in_order(F.col("text"), F.array(F.lit("\n"), F.lit(". "), F.lit("\n"))).alias("s")).select("document_id", F.array_join("s", ",").alias("starts"))


def sequence_layouts(spark: SparkSession, folder: str) -> DataFrame:
    p = pairs(spark, folder).select("pair_id", F.col("before").alias("baseline"), F.col("after").alias("candidate"))
    none = F.lit(None).cast("string")
    anchors = F.array(F.lit("\n"), F.lit(". "), F.lit("\n"))
    s = p.select("pair_id", F.lit("s").alias("id"), anchors.alias("baseline_anchors"), anchors.alias("candidate_anchors"), F.lit("f").alias("function"), F.lit("preserved").alias("review"), F.lit("n").alias("reviewer_note"), none.alias("compression_review"), none.alias("compression_note"))
    return sequence_records(p, s).select("pair_id", "baseline_ordered", "candidate_ordered", "layout_compressed", F.col("baseline_layout.character_span").alias("span"))


_DOCS = DOCS
_TABLE = {"rules": (Rule("KR-R01", "sentence_run", minimum_run=3), Rule("KR-T02", "triadic_chain"), *STRUCTURAL), "listed": "select id, pattern from rules where anchor_type = 'regex' and pattern is not null"}


def _replaced(x: str) -> str:
    for old, new in EDITS:
        x = f"replace({x}, {quoted(old)}, {quoted(new)})"
    return x


_SIDES = f"b_docs as (select * from docs), a_docs as (select document_id, {_replaced('text')} as text from docs)"


def _deltas_sql() -> str:
    return f"""{_DOCS}, {_SIDES}, {findings(docs="b_docs", name="fb", **_TABLE)}, {findings(docs="a_docs", name="fa", **_TABLE)},
cb as (select document_id, rule_id, count(*) as n from fb group by all), ca as (select document_id, rule_id, count(*) as n from fa group by all),
deltas as (select document_id as pair_id, rule_id, coalesce(cb.n, 0) as before_count, coalesce(ca.n, 0) as after_count, coalesce(ca.n, 0) - coalesce(cb.n, 0) as delta from cb full join ca using (document_id, rule_id)),
loss as (select document_id as pair_id, value, sum(e) as expected, sum(1 - e) as actual from (select document_id, value, 1 as e from fb_prot union all select document_id, value, 0 from fa_prot) group by all having sum(1 - e) < sum(e))"""


def _gate_sql() -> str:
    d = lambda rule: f"coalesce((select delta from deltas d where d.pair_id = p.pair_id and rule_id = '{rule}'), 0)"
    n = lambda rule: f"coalesce((select before_count from deltas d where d.pair_id = p.pair_id and rule_id = '{rule}'), 0)"
    return f"""with {_deltas_sql()},
p as (select document_id as pair_id from docs), x as (select pair_id, {d("KR-C03")} as d3, {n("KR-C03")} as n3, {d("KR-C07")} as d7, {n("KR-C07")} as n7, coalesce((select string_agg(rule_id, ',' order by rule_id) from deltas d where d.pair_id = p.pair_id and delta > 0 and rule_id not in ('KR-C03', 'KR-C07')), '') as introduced, (select count(*) from loss l where l.pair_id = p.pair_id) as lost from p),
y as (select *, concat_ws(',', case when d3 < 0 then 'KR-C03' end, case when d7 < 0 then 'KR-C07' end) as target_reduced, case when n7 > 0 then 'KR-C07' else '' end as target_preserved, case when n7 > 0 then '' else 'KR-C07' end as invalid_preserved_rules, concat_ws(',', case when n3 = 0 then 'KR-C03' end, case when n7 = 0 then 'KR-C07' end) as target_unverifiable,
  concat_ws(',', case when d3 >= 0 then 'KR-C03' end, case when d7 >= 0 and n7 = 0 then 'KR-C07' end) as target_unresolved, concat_ws(',', case when d3 > 0 then 'KR-C03' end, case when d7 > 0 then 'KR-C07' end) as target_regressions from x)
select pair_id, 'edit' as candidate, target_reduced, target_preserved, invalid_preserved_rules, target_unverifiable, target_unresolved, target_regressions, introduced as introduced_candidates, cast(lost as integer) as lost, case when lost = 0 and target_unresolved = '' and introduced = '' and invalid_preserved_rules = '' then '통과' else '보류' end as status from y"""


def _changed_sql(before: str, after: str) -> str:
    a, b = signature_sql(before), signature_sql(after)
    return "concat_ws(',', " + ", ".join(f"case when {a[k]} is distinct from {b[k]} then '{k}' end" for k in a) + ")"


def _versions_sql() -> str:
    text = "lower(array_to_string(list_transform(list_concat(coalesce(titles, []), coalesce(abstracts, [])), lambda e: coalesce(e.value, '')), chr(10)))"
    return f"""v as (select * from (select rec_no, article_id as chain_id, {text} as text from records where article_id is not null) where text <> ''),
h as (select chain_id, cast(rec_no - min(rec_no) over (partition by chain_id) as integer) as ord, cast(rec_no as varchar) as label, text, sha256(text) as hash from v),
s as (select *, coalesce(hash = lag(hash) over (partition by chain_id order by ord), false) as same_as_previous, first_value(ord) over (partition by chain_id, hash order by ord) as fo, first_value(label) over (partition by chain_id, hash order by ord) as fl, first_value(text) over (partition by chain_id order by ord) as base from h),
states as (select *, coalesce(bool_or(same_as_previous) over (partition by chain_id order by ord rows between unbounded preceding and 1 preceding), false) and not same_as_previous as changed_after_no_change, case when not same_as_previous and fo < ord then fl end as returned_to from s)"""


def _spans_sql(pattern: str, name: str = "spans") -> str:
    p = pattern.replace("'", "''")
    return f"""cut_{name} as (select document_id, text, string_split_regex(text, '{p}') as g, regexp_extract_all(text, '{p}') as h from docs),
{name} as (select document_id, text, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) as integer) as start_pos, h[i] as value
  from cut_{name}, unnest(range(1, len(h) + 1)) as u(i) where len(h) > 0)"""


_ONCE = """once as (select anchor_id, min(struct_pack(a := document_id, b := rule_id, c := start_pos, d := end_pos, e := line_no, f := column_no, g := evidence, h := context, i := paragraph, j := sentence_in_paragraph, k := shape)) as r,
  coalesce(bool_or(verdict = 'false_positive'), false) as allowed from ledger group by anchor_id)"""


def _findings_sql() -> str:
    rule = rule_sql("r.b")
    return f"{_ONCE}, f as (select r.a as document_id, {rule} as rule_id, r.c as start_pos, r.d as end_pos, r.e as line_no, r.g as evidence, r.h as context, r.i as paragraph, r.j as sentence_in_paragraph, r.k as shape, allowed from once)"


def _blank_sql(x: str) -> str:
    return f"regexp_replace({x}, '[^\\n]', ' ', 'g')"


def _last_sql() -> str:
    return """want as (select distinct anchor_id from ledger where rule_id in (select id from rules)),
have as (select anchor_id, count(*) as n, max_by(struct_pack(m := review_method, v := verdict), struct_pack(a := exported_at, b := review_method, c := verdict)) as r from ledger where document_id <> 'single-input' group by anchor_id),
st as (select anchor_id, want.anchor_id is not null as expected, coalesce(n, 0) as n,
  case when n is null then 'missing' when want.anchor_id is null then 'unknown'
    when coalesce(r.m, '') not in ('mechanical', 'human', 'excluded', 'unreviewed') or coalesce(r.v, '') not in ('preserve', 'edit', 'ask', 'false_positive', 'unreviewed') then 'invalid'
    when r.m = 'unreviewed' or r.v = 'unreviewed' then 'unresolved' when r.m = 'human' then 'human' else 'reviewed' end as state
  from want full join have using (anchor_id))"""


def _terms_sql() -> str:
    """CTEs of the term audit: views, protected spans, old and new words on both sides."""
    scoped = ", ".join(f"({quoted(end)}, {quoted(x)})" for end, xs in SCOPES_OF.items() for x in xs)
    listed = ", ".join(f"({quoted(t['id'])}, {quoted(x)})" for t in TERMS["terms"] for x in t["old"])
    fresh = ", ".join(f"({quoted(t['id'])}, {quoted(t['new'])})" for t in TERMS["terms"])
    within = ", ".join(f"({quoted(t['id'])}, {quoted(x)})" for t in TERMS["terms"] for x in t["scope"])
    clash = lambda a, b, same="": f"exists (select 1 from {b} p where p.document_id = {a}.document_id {same} and {a}.start_pos < p.end_pos and {a}.end_pos > p.start_pos)"
    own = lambda a: f"and p.term_id = {a}.term_id"
    covered = "(select coalesce(bool_or(c - 1 >= p.start_pos and c - 1 < p.end_pos), false) from ap p where p.document_id = x.document_id)"
    return f"""{_DOCS}, {_SIDES}, ends(ending, scope) as (values {scoped}), sc as (select document_id as doc, scope from docs, ends), olds(term_id, phrase) as (values {listed}), news(term_id, phrase) as (values {fresh}), reads(term_id, scope) as (values {within}),
{scope_texts("b_docs", "sc", "bv")}, {scope_texts("a_docs", "sc", "av")}, {protected_sql("bv", "bp")}, {protected_sql("av", "ap")},
{occurrences("bv", "olds", "bo")}, {occurrences("av", "olds", "ao")}, {occurrences("bv", "news", "bn")}, {occurrences("av", "news", "an")},
bx as (select * from bo where not {clash("bo", "bp")} and not {clash("bo", "bn", own("bo"))}), ax as (select *, {clash("ao", "ap")} as held from ao where not {clash("ao", "an", own("ao"))}),
masked_view as (select document_id, doc, scope, raw, text, array_to_string(list_transform(range(1, length(text) + 1), lambda c: case when substr(text, c, 1) <> chr(10) and len(list_filter(ps, lambda p: c - 1 >= p.s and c - 1 < p.e)) > 0 then ' ' else substr(text, c, 1) end), '') as m
  from av left join (select document_id, list(struct_pack(s := start_pos, e := end_pos)) as ps from ap group by document_id) using (document_id)),
{starts("masked_view", "sent", "document_id, doc, scope, raw", "m", quoted("[^.!?]+(?:[.!?]|$)"))},
said as (select document_id, doc, scope, raw, term_id, phrase, start_pos, trim(regexp_replace(value, '{SPACE}+', ' ', 'g')) as value from sent join news on contains(trim(regexp_replace(value, '{SPACE}+', ' ', 'g')), phrase)),
cell as (select r.term_id, sc.doc || e.ending as document_id, sc.scope, sc.doc || chr(1) || sc.scope as v from sc join ends e using (scope) join reads r using (scope)),
counted as (select term_id, document_id, scope, (select count(*) from bx where bx.document_id = v and bx.term_id = c.term_id) as old_count_before, (select count(*) from ax where ax.document_id = v and ax.term_id = c.term_id and not held) as residue_count,
  (select count(*) from bn where bn.document_id = v and bn.term_id = c.term_id and not {clash("bn", "bp")}) as new_count_before, (select count(*) from an where an.document_id = v and an.term_id = c.term_id and not {clash("an", "ap")}) as new_count_after,
  (select count(*) from said s where s.document_id = v and s.term_id = c.term_id and (length(s.value) - length(replace(s.value, s.phrase, ''))) / length(s.phrase) > 1) as echo_count from cell c),
gapped as (select *, greatest(0, new_count_before + old_count_before - new_count_after) as replacement_gap from counted)"""


def _uses_sql() -> str:
    return f"""with recursive {_DOCS}, ends(ending, scope) as (values {", ".join(f"({quoted(e)}, {quoted(x)})" for e, xs in SCOPES_OF.items() for x in xs)}), sc as (select document_id as doc, scope from docs, ends), forms(term_id, phrase) as (values {", ".join(f"({quoted(t['id'])}, {quoted(x)})" for t in FORMS for x in t["forms"])}),
{scope_texts("docs", "sc", "bv")}, {protected_sql("bv", "bp")}, {occurrences("bv", "forms", "o")},
n as (select o.*, doc || ending as name, scope, cast(length(substr(text, 1, start_pos)) - length(replace(substr(text, 1, start_pos), chr(10), '')) + 1 as integer) as line_no from o join bv using (document_id) join ends using (scope)),
m as (select *, cast(row_number() over (partition by document_id, term_id, phrase, line_no order by start_pos) as integer) as occurrence from n)
select term_id, name as document_id, scope, line_no, occurrence, phrase as form from m where not exists (select 1 from bp p where p.document_id = m.document_id and m.start_pos < p.end_pos and m.end_pos > p.start_pos)"""


def _place_sql(text: str, start: str, end: str, radius: int) -> str:
    return f"trim(regexp_replace(substr({text}, greatest({start} - {radius}, 0) + 1, {end} + {radius} - greatest({start} - {radius}, 0)), '{SPACE}+', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    f = _findings_sql()
    space = SPACE
    quote = "\"[^\"\\n]{1,500}\"|“[^”\\n]{1,500}”|「[^」\\n]{1,500}」|『[^』\\n]{1,500}』"
    return {
        "anchor_offsets": f"with {_DOCS}, {_spans_sql(NUMBER)} select document_id, start_pos, cast(start_pos + length(value) as integer) as end_pos, cast(length(substr(text, 1, start_pos)) - length(replace(substr(text, 1, start_pos), chr(10), '')) + 1 as integer) as line_no, cast(length(string_split(substr(text, 1, start_pos), chr(10))[-1]) + 1 as integer) as column_no, value from spans",
        "anchor_context": f"with {_DOCS}, {_spans_sql(BRACKET.replace(chr(10), chr(92) + 'n'))} select document_id, start_pos, trim(regexp_replace(substr(text, greatest(start_pos - 24, 0) + 1, start_pos + length(value) + 24 - greatest(start_pos - 24, 0)), '{space}+', ' ', 'g')) as context from spans",
        "masked_texts": f"with {_DOCS}, c as (select document_id, string_split_regex(text, '{BRACKET}') as g, regexp_extract_all(text, '{BRACKET}') as h from docs), m as (select document_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce({_blank_sql('h[i]')}, '')), '') as m, len(h) as masks from c) select document_id, cast(length(m) as integer) as n, sha256(m) as hash, cast(masks as integer) as masks from m",
        "literal_counts": f"with {_DOCS} select document_id, " + ", ".join(f"cast((length(text) - length(replace(text, {x}, ''))) / length({x}) as integer) as n{i}" for i, x in enumerate(("'경기'", "'orbit'", "'. '", "chr(10) || chr(10)"))) + " from docs",
        "protected_quotes_dates": f"with {_DOCS}, {_spans_sql(quote, 'q')}, {_spans_sql(chr(92) + 'b[0-9]{4}[.-][0-9]{1,2}[.-][0-9]{1,2}' + chr(92) + 'b|[0-9]{4}년' + SPACE + '*[0-9]{1,2}월(?:' + SPACE + '*[0-9]{1,2}일)?', 'd')}, {_spans_sql('제' + SPACE + '*[0-9]+' + SPACE + '*조(?:의' + SPACE + '*[0-9]+)?(?:' + SPACE + '*제' + SPACE + '*[0-9]+' + SPACE + '*항)?', 's')} select document_id, 'quotation' as kind, start_pos, value from q union all select document_id, 'date', start_pos, value from d union all select document_id, 'statute', start_pos, value from s",
        "paragraph_blocks": f"""with {_DOCS}, l as (select document_id, text, i, string_split(text, chr(10))[i] as line, cast(coalesce(list_sum(list_transform(string_split(text, chr(10))[1:i-1], lambda x: length(x) + 1)), 0) as integer) as pos from docs, unnest(range(1, len(string_split(text, chr(10))) + 1)) as u(i)),
b as (select *, regexp_full_match(line, '{space}*') as blank from l), g as (select *, sum(case when blank then 1 else 0 end) over (partition by document_id order by i) as grp from b),
p as (select document_id, grp, min(pos) as start_pos, least(max(pos + length(line) + 1), any_value(length(text))) as end_pos, count(*) as n, min_by(line, i) as line from g where not blank group by document_id, grp),
k as (select *, n = 1 and regexp_full_match(trim(line, ' ' || chr(9) || chr(13) || chr(160) || chr(12288)), '#{{1,6}}[ \\t]+[^\\n]+') as head from p)
select document_id, cast(row_number() over (partition by document_id order by start_pos) as integer) as paragraph, cast(start_pos as integer) as start_pos, cast(end_pos as integer) as end_pos, case when head then 'heading' else 'body' end as kind,
  case when head then regexp_replace(trim(line, ' ' || chr(9) || chr(13) || chr(160) || chr(12288)), '^#+[ \\t]+', '') else '' end as heading from k""",
        "ledger_counts": f"with {f} select rule_id, count(*) filter (where not allowed) as active_count, count(*) filter (where allowed) as allowed_count, count(*) as all_count from f group by rule_id",
        "ledger_rollup": f"with {f} select document_id, rule_id, count(*) filter (where not allowed) as active_count, count(*) as all_count, grouping(document_id, rule_id) as level from f group by rollup(document_id, rule_id)",
        "ledger_distribution": f"with {f}, x as (select rule_id, unnest([struct_pack(part := 'document', value := document_id), struct_pack(part := 'evidence', value := evidence)]) as x from f where rule_id is not null) select rule_id, x.part as part, x.value as value, count(*) as occurrences from x where x.value is not null group by all",
        "ledger_repeats": f"with {f}, s as (select rule_id, evidence as shape, document_id, line_no, context, row_number() over (partition by rule_id, evidence order by document_id nulls first, start_pos nulls first, end_pos nulls first) as rn from f where evidence is not null and evidence <> '' and rule_id is not null) select rule_id, shape, count(distinct coalesce(document_id, chr(1))) as documents, count(*) as occurrences, cast(least(count(*), 3) as integer) as examples, any_value(document_id) filter (where rn = 1) as first_document, any_value(line_no) filter (where rn = 1) as first_line, any_value(context) filter (where rn = 1) as first_context from s group by rule_id, shape having count(distinct coalesce(document_id, chr(1))) >= 2",
        "ledger_repeat_documents": f"with {f}, s as (select rule_id, evidence as shape, document_id, count(*) as occurrences from f where evidence is not null and evidence <> '' and rule_id is not null group by all) select * from s qualify count(*) over (partition by rule_id, shape) >= 2",
        "scope_kinds": f"with recursive {_DOCS}, {line_kinds()} select document_id, kind, count(*) as lines from lk group by all",
        "term_counts": f"with recursive {_terms_sql()} select term_id, document_id, scope, cast(sum(old_count_before) as bigint) as old_count_before, cast(sum(residue_count) as bigint) as residue_count, cast(sum(new_count_before) as bigint) as new_count_before, cast(sum(new_count_after) as bigint) as new_count_after, cast(sum(replacement_gap) as bigint) as replacement_gap, cast(sum(echo_count) as bigint) as echo_count, cast(0 as bigint) as unmatched_exceptions, grouping(term_id, document_id, scope) as level from gapped group by rollup(term_id, document_id, scope)",
        "term_residues": f"""with recursive {_terms_sql()}, named as (select *, (select any_value(document_id) from cell c where c.v = x.document_id) as name, (select any_value(scope) from cell c where c.v = x.document_id) as sc_name, (select raw from av where av.document_id = x.document_id) as raw_text from ax x)
select term_id, name as document_id, sc_name as scope, case when held then 'protected' else 'residue' end as kind, phrase as value, start_pos, cast(length(substr(raw_text, 1, start_pos)) - length(replace(substr(raw_text, 1, start_pos), chr(10), '')) + 1 as integer) as line_no, {_place_sql("raw_text", "start_pos", "end_pos", 60)} as context from named join reads r using (term_id) where r.scope = sc_name
union all select s.term_id, c.document_id, c.scope, 'sentence', null, start_pos, cast(length(substr(raw, 1, start_pos)) - length(replace(substr(raw, 1, start_pos), chr(10), '')) + 1 as integer), value from said s join cell c on c.v = s.document_id and c.term_id = s.term_id""",
        "term_statuses": f"""with recursive {_terms_sql()}, x as (select term_id, cast(sum(old_count_before) as bigint) as old_count_before, cast(sum(residue_count) as bigint) as residue_count, cast(sum(new_count_before) as bigint) as new_count_before, cast(sum(new_count_after) as bigint) as new_count_after, cast(sum(replacement_gap) as bigint) as replacement_gap, cast(sum(echo_count) as bigint) as echo_count from gapped where scope <> 'index' group by 1)
select term_id, case when term_id = 'soil' then 'index' else '' end as missing_scopes, cast(case when term_id = 'soil' then 1 else 0 end as integer) as stale_exceptions, old_count_before, residue_count, new_count_before, new_count_after, replacement_gap, echo_count, cast(0 as bigint) as unmatched_exceptions, case when term_id = 'soil' or residue_count > 0 or replacement_gap > 0 then '보류' else '기계 확인 완료' end as status from x""",
        "sense_statuses": f"select term_id, cast(0 as bigint) as ask_count, cast(1 as bigint) as problems, count(*) as discovered_count, count(*) as undeclared, cast(1 as bigint) as stale, '보류' as status from ({_uses_sql()}) group by term_id",
        "term_uses": _uses_sql(),
        "nth_marks": f"with {_DOCS}, l as (select document_id, regexp_extract_all(text, {quoted(LINES)}) as ls from docs), p as (select document_id, string_split(ls[3], '.') as g, length(ls[1]) + length(ls[2]) as base from l) select document_id, case when len(g) > 2 then cast(base + length(g[1]) + length(g[2]) + 1 as integer) end as start_pos, case when len(g) > 2 then cast(base + length(g[1]) + length(g[2]) + 2 as integer) end as end_pos from p",
        "corpus_included": "select distinct document_id, path, coalesce(role, 'prose') as role, sha256(text) as hash from manuscripts where coalesce(include, true)",
        "corpus_excluded": f"select distinct document_id, path, coalesce(role, 'prose') as role, coalesce(reason, {quoted(EXCLUDED)}) as reason from manuscripts where not coalesce(include, true)",
        "protected_receipts": f"with {_deltas_sql()}, n as (select document_id as pair_id, (select count(*) from fb_prot p where p.document_id = d.document_id) as k, (select count(*) from loss l where l.pair_id = d.document_id) as missing from docs d) select pair_id, cast(k as integer) as before_protected_span_count, missing, case when missing = 0 then '통과' else '보류' end as status from n",
        "candidate_choices": f"""with {_DOCS}, b_docs as (select * from docs), a_docs as (select document_id || '=edit' as document_id, {_replaced("text")} as text from docs union all select document_id || '=bare', regexp_replace({_replaced("text")}, '[0-9]', '', 'g') from docs),
{findings(docs="b_docs", name="fb", **_TABLE)}, {findings(docs="a_docs", name="fa", **_TABLE)}, c as (select document_id as pair_id, unnest(['edit', 'bare']) as candidate from docs),
cb as (select document_id, rule_id, count(*) as n from fb group by all), ca as (select document_id, rule_id, count(*) as n from fa group by all),
lost as (select pair_id, candidate, count(*) as k from (select pair_id, candidate, value, sum(e) as e, sum(a) as a from (select c.pair_id, c.candidate, value, 1 as e, 0 as a from c join fb_prot on document_id = c.pair_id union all select c.pair_id, c.candidate, value, 0, 1 from c join fa_prot on document_id = c.pair_id || '=' || c.candidate) group by all) where a < e group by all),
s as (select pair_id, candidate, coalesce((select n from ca where document_id = c.pair_id || '=' || c.candidate and rule_id = 'KR-C03'), 0) - coalesce((select n from cb where document_id = c.pair_id and rule_id = 'KR-C03'), 0) as d3,
  (select count(*) from ca where document_id = c.pair_id || '=' || c.candidate and rule_id <> 'KR-C03' and n > coalesce((select n from cb where cb.document_id = c.pair_id and cb.rule_id = ca.rule_id), 0)) as grown, coalesce((select k from lost l where l.pair_id = c.pair_id and l.candidate = c.candidate), 0) as gone from c),
g as (select pair_id, coalesce(string_agg(candidate, ',' order by candidate) filter (where d3 < 0 and grown = 0 and gone = 0), '') as eligible from s group by pair_id)
select pair_id, eligible, case when eligible <> '' then {quoted(REVIEW_NEXT)} else {quoted(MEND_FIRST)} end as next_step from g""",
        "strength_failures": f"""with {_DOCS}, {_SIDES}, p as (select b.document_id as pair_id, b.text as baseline, a.text as candidate, length(b.text) as n from b_docs b join a_docs a using (document_id)),
s as (select pair_id, n, (['exact', 'functional', 'ask', 'other'])[n % 4 + 1] as policy, baseline <> '' as baseline_found, case n % 4 when 0 then baseline <> '' and contains(candidate, substr(baseline, 1, 40)) when 1 then substr(candidate, 5, 10) <> '' end as candidate_found, case n % 3 when 0 then 'preserved' when 1 then 'kept' else 'unreviewed' end as review from p)
select pair_id, 's' as id, policy, baseline_found, candidate_found, review, policy in ('functional', 'ask') as human, concat_ws('; ', case when n % 5 = 0 then 'position, function, surface_cost, and risk_if_smoothed are required' end, case when not baseline_found then 'baseline_text not found' end, case when policy = 'exact' and not candidate_found then 'exact strength missing from candidate' end, case when policy = 'functional' and not candidate_found then 'candidate_text not found' end,
  case when policy = 'functional' and review = 'kept' then 'invalid review value' end, case when policy = 'functional' and (review <> 'preserved' or n % 7 <= 1) then 'human preserved decision and reviewer_note required' end, case when policy = 'ask' then 'author decision required' end, case when policy = 'other' then 'policy must be exact, functional, or ask' end) as failures from s""",
        "ledger_clusters": f"with {f}, s as (select rule_id, document_id, paragraph, sentence_in_paragraph, count(*) as n from f group by all) select rule_id, count(*) as sentences_with_findings, count(*) filter (where n >= 2) as sentences_with_2plus, max(n) as max_per_sentence from s group by rule_id",
        "ledger_anchors": f"with {f}, u as (select document_id, rule_id, start_pos, end_pos, min(line_no) as line_no from f where rule_id is not null group by all) select document_id || ':' || rule_id || ':' || start_pos || ':' || end_pos || ':' || row_number() over (order by document_id, start_pos, rule_id, end_pos) as anchor_id, line_no from u",
        "coverage_states": f"with {_last_sql()} select state, expected, count(*) as anchors, cast(sum(n) as bigint) as ledger_rows from st group by state, expected",
        "coverage_status": f"""with {_last_sql()}, c as (select count(*) filter (where expected) as anchors_total, count(*) filter (where state in ('human', 'reviewed')) as anchors_reviewed, count(*) filter (where state = 'human') as anchors_human_reviewed, count(*) filter (where state = 'unresolved') as anchors_unresolved,
  count(*) filter (where state = 'missing') as missing, count(*) filter (where state = 'unknown') as unknown, count(*) filter (where state = 'invalid') as invalid, count(*) filter (where n > 1) as duplicates from st)
select 'residual' as mode, anchors_total, anchors_reviewed, anchors_human_reviewed, anchors_unresolved, missing, unknown, duplicates, case when missing + unknown + invalid + duplicates + anchors_unresolved = 0 then '통과' else '보류' end as status from c""",
        "markdown_signatures": f"with {_DOCS} select document_id, " + ", ".join(f"cast({x} as integer) as {k}" if k == "bold_markers" else f"{x} as {k}" for k, x in signature_sql("text").items()) + " from docs",
        "iteration_rows": f"with {_versions_sql()} select chain_id, ord, hash, same_as_previous, changed_after_no_change, returned_to from states",
        "iteration_chains": f"""with {_versions_sql()}, c as (select *, {_changed_sql("base", "text")} as changed from states where ord > 0),
g as (select chain_id, count(*) as versions, bool_or(changed_after_no_change) as changed_after_no_change, count(returned_to) as oscillations, count(*) filter (where changed <> '') as structure_changes, max_by(same_as_previous, ord) as latest_same_as_previous from c group by chain_id)
select *, case when not changed_after_no_change and oscillations = 0 and structure_changes = 0 then '기계 확인 완료' else '사람 검토' end as status from g""",
        "protected_values": f"with {_DOCS}, {protected_sql()} select * from prot",
        "protected_loss": f"with {_deltas_sql()} select pair_id, value, cast(expected as bigint) as expected, cast(actual as bigint) as actual from loss",
        "section_paths": f"with {_DOCS}, {structure_sql()} select document_id, paragraph, section_heading, cast(len(sentences) as integer) as sentences, bodies from par",
        "rhythm": rhythm_sql(),
        "scan_findings": f"with {_DOCS}, {findings(**_TABLE)} select * from found",
        "scan_counts": f"with {_DOCS}, {findings(**_TABLE)} select rule_id, count(*) filter (where not allowed) as active_count, count(*) filter (where allowed) as allowed_count, count(*) as all_count from found group by rule_id",
        "scan_allowances": f"with {_DOCS}, {findings(allow=ALLOWED, **_TABLE)} select rule_id, allow_scope, allow_reason, count(*) filter (where not allowed) as active_count, count(*) filter (where allowed) as allowed_count, count(*) as all_count from found group by all",
        "scan_korean": f"with {_DOCS}, {findings(KOREAN)} select rule_id, count(*) filter (where not allowed) as active_count, count(*) filter (where allowed) as allowed_count, count(*) as all_count from found group by rule_id",
        "scan_planted": f"with {_DOCS}, planted as (select document_id, text || {quoted(PLANTED)} as text from docs), {findings(KOREAN, docs='planted')} select * from found",
        "receipts": receipts_sql(gate_rules(KOREAN)[0]),
        "gate_deltas": f"with {_deltas_sql()} select pair_id, 'edit' as candidate, rule_id, before_count, after_count, delta from deltas",
        "gate_status": _gate_sql(),
        "markdown_changes": f"with {_DOCS}, {_SIDES} select b.document_id as pair_id, {_changed_sql('b.text', 'a.text')} as changed from b_docs b join a_docs a using (document_id)",
        "sequence_layouts": f"""with {_DOCS}, {_SIDES}, both_sides as (select document_id, 'b' as side, text from b_docs union all select document_id, 'a', text from a_docs),
o1 as (select *, instr(text, chr(10)) as p1 from both_sides), o2 as (select *, case when p1 > 0 and instr(substr(text, p1 + 1), '. ') > 0 then p1 + instr(substr(text, p1 + 1), '. ') end as p2 from o1), o3 as (select *, case when p2 is not null and instr(substr(text, p2 + 2), chr(10)) > 0 then p2 + 1 + instr(substr(text, p2 + 2), chr(10)) end as p3 from o2),
piece as (select document_id, side, p3 is not null as ordered, p3 - p1 + 1 as span, substr(text, p1, p3 - p1 + 1) as x from o3),
l as (select document_id, side, ordered, span, greatest(1, len(list_filter(string_split_regex(x, '\\n{space}*\\n'), lambda y: regexp_replace(y, '{space}', '', 'g') <> ''))) as paragraphs, greatest(1, len(regexp_extract_all(x, '[.!?]+'))) as sentences from piece)
select b.document_id as pair_id, b.ordered as baseline_ordered, a.ordered as candidate_ordered, coalesce(b.ordered and a.ordered and (a.paragraphs < b.paragraphs or a.sentences < b.sentences), false) as layout_compressed, cast(b.span as integer) as span from l b join l a on a.document_id = b.document_id and a.side = 'a' where b.side = 'b'""",
        "anchor_order": f"with {_DOCS}, a as (select document_id, text, instr(text, chr(10)) as p1 from docs), b as (select *, case when p1 > 0 and instr(substr(text, p1 + 1), '. ') > 0 then p1 + instr(substr(text, p1 + 1), '. ') end as p2 from a), c as (select *, case when p2 is not null and instr(substr(text, p2 + 2), chr(10)) > 0 then p2 + 1 + instr(substr(text, p2 + 2), chr(10)) end as p3 from b) select document_id, case when p3 is not null then (p1 - 1) || ',' || (p2 - 1) || ',' || (p3 - 1) end as starts from c",
    }


def queries() -> dict:
    named = (anchor_offsets, anchor_context, masked_texts, literal_counts, protected_quotes_dates, protected_values, paragraph_blocks, section_paths, rhythm, scan_findings, scan_counts, scan_allowances, scan_korean, scan_planted, receipts, ledger_counts, ledger_rollup, ledger_distribution, ledger_repeats, ledger_repeat_documents, ledger_clusters, ledger_anchors, coverage_states, coverage_status, protected_loss, gate_deltas, gate_status, markdown_signatures, markdown_changes, edit_sizes, scope_kinds, iteration_rows, iteration_chains, term_counts, term_statuses, sense_statuses, term_residues, term_uses, nth_marks, corpus_included, corpus_excluded, protected_receipts, candidate_choices, strength_failures, anchor_order, sequence_layouts)
    return {q.__name__: q for q in named}
