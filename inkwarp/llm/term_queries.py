"""Queries of problem 1: how often each rule id and each evidence word occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarp.functions.normal import nfkc_sql, rule_key, word_key
from inkwarp.llm.term_counts import count_terms, mark
from inkwarp.sources.tables import table

RARE_DOCUMENTS, RARE_OCCURRENCES = 3, 3


def ledger_terms(ledger: DataFrame) -> DataFrame:
    """One row per anchor: an anchor exported again, with whatever review, is one occurrence of its rule id."""
    once = ledger.groupBy("rule_id", "document_id", "anchor_id").agg(F.count(F.lit(1)).alias("rows"))
    return (
        once.select(rule_key(F.col("rule_id")).alias("value"), F.col("document_id").alias("record"), "anchor_id")
        .where(F.col("value").isNotNull())
        .groupBy("value", "record", "anchor_id")
        .agg(F.lit(1).cast("long").alias("n"))
        .select(F.lit("rule").alias("kind"), "value", "record", "n")
    )


def evidence_terms(distribution: DataFrame) -> DataFrame:
    """One row per word of a scan and rule; a scan and rule given twice count once (the first non-null map by time)."""
    when = F.struct(F.col("evidence").isNull().cast("int").alias("empty"), F.col("scanned_at").alias("at"), F.to_json("evidence").alias("text"))
    once = (
        distribution.select("scan_id", rule_key(F.col("rule_id")).alias("rule"), "scanned_at", "evidence")
        .groupBy("scan_id", "rule")
        .agg(F.min_by("evidence", when).alias("evidence"))
    )
    return once.select("scan_id", F.explode("evidence").alias("word", "n")).select(
        F.lit("evidence").alias("kind"), word_key(F.col("word")).alias("value"), F.col("scan_id").alias("record"), F.col("n").cast("long").alias("n")
    )


def p1_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Every rule id of ledger and every word of rule_distribution.evidence with its counts and mark."""
    ledger, distribution = table(spark, folder, "ledger"), table(spark, folder, "rule_distribution")
    documents = ledger.agg(F.count_distinct("document_id")).first()[0]
    scans = distribution.agg(F.count_distinct("scan_id")).first()[0]
    counts = count_terms(ledger_terms(ledger).unionByName(evidence_terms(distribution)))
    rule = F.col("kind") == "rule"
    return mark(
        counts,
        F.when(rule, F.col("records") < RARE_DOCUMENTS).otherwise(F.col("occurrences") < RARE_OCCURRENCES),
        F.when(rule, F.col("records") * 2 > F.lit(documents)).otherwise(F.col("records") * 10 > F.lit(scans) * 4),
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The values that are rare or common."""
    return p1_frequencies(spark, folder).where(F.col("mark").isNotNull()).select("kind", "value", "mark")


def frequency_sql() -> str:
    """DuckDB form of :func:`p1_frequencies`, with NFKC for the forms that the tables hold (full width, decomposed)."""
    space = "[\\s  -   　]"
    rule = f"regexp_replace(regexp_replace(upper({nfkc_sql('rule_id')}), '{space}', '', 'g'), '[_‐-―−]', '-', 'g')"
    word = f"trim(regexp_replace(lower({nfkc_sql('k')}), '{space}+', ' ', 'g'))"
    return f"""
with led as (select {rule} as value, document_id as record, anchor_id from ledger where rule_id is not null),
rules_n as (select 'rule' as kind, value, count(distinct coalesce(record, '') || chr(1) || anchor_id) as occurrences, count(distinct record) as records from led group by value),
dist as (select scan_id, {rule} as rule, evidence, row_number() over (partition by scan_id, {rule} order by evidence is null, scanned_at) as rn from rule_distribution),
kv as (select scan_id, unnest(map_keys(evidence)) as k, unnest(map_values(evidence)) as n from dist where rn = 1 and evidence is not null),
words as (select 'evidence' as kind, {word} as value, sum(n) as occurrences, count(distinct scan_id) as records from kv group by {word}),
tot as (select (select count(distinct document_id) from ledger) as docs, (select count(distinct scan_id) from rule_distribution) as scans),
both_kinds as (select * from rules_n union all select * from words)
select kind, value, cast(occurrences as bigint) as occurrences, cast(records as bigint) as records,
  case when kind = 'rule' then case when records < 3 then 'rare' when records * 2 > docs then 'common' end
       else case when occurrences < 3 then 'rare' when records * 10 > scans * 4 then 'common' end end as mark
from both_kinds, tot"""


def queries() -> dict:
    return {"p1_found": p1_found, "p1_frequencies": p1_frequencies}


def oracle_sql() -> dict[str, str]:
    return {"p1_frequencies": frequency_sql(), "p1_found": f"select kind, value, mark from ({frequency_sql()}) where mark is not null"}
