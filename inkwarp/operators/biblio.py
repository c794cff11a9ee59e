"""Bibliographic records: deduplication, roll-ups and topic signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwarp.sources.harvest import ENDED

# Words that signal a topic.
TOPICS = {
    "ai_and_llm": ("인공지능", "생성형", "대규모 언어", "llm", "챗gpt", "chatgpt", "기계 생성"),
    "translation_and_post_editing": ("번역", "통역", "포스트에디팅", "post-edit", "translationese"),
    "korean_english_direction": ("한국어", "한영", "영한", "영어", "korean", "english"),
    "style_and_naturalness": ("문체", "자연성", "유창성", "가독성", "명사화", "피동", "종결어미", "대명사"),
    "quality_and_evaluation": ("품질", "정확성", "평가", "오역", "누락"),
}


def record_key() -> Column:
    """The article id, else the source id; null if both are missing or empty."""
    return F.coalesce(F.nullif("article_id", F.lit("")), F.nullif("source_id", F.lit("")))


def first_by_key(records: DataFrame, order: list[str]) -> DataFrame:
    """The first record of each key by ``order``; records without a key are left out.

    The first row's order is found by an aggregate with map-side combine, so that a key that many rows share is not sorted in one task.
    """
    keyed = records.withColumn("__k", record_key()).where("__k is not null")
    struct = F.struct(*[F.col(c) for c in records.columns])
    return keyed.groupBy("__k").agg(F.min_by(struct, F.struct(*order)).alias("r")).select("r.*")


def unique_in_harvest(records: DataFrame) -> DataFrame:
    """Records without those whose article id, or else whole content, came already; which of equals stays is not defined."""
    mark = F.coalesce(F.nullif("article_id", F.lit("")), F.sha2(F.to_json(F.struct(*sorted(records.columns))), 256))
    return records.withColumn("__m", mark).dropDuplicates(["__m"]).drop("__m")


def repeated_pages(pages: DataFrame) -> DataFrame:
    """Pages (query_group, field, term, page, ids ARRAY<STRING>) whose ids came on an earlier page of the same query."""
    mark = F.sha2(F.concat_ws("|", F.transform("ids", lambda x: F.coalesce(x, F.lit("")))), 256)
    before = Window.partitionBy("query_group", "field", "term", "__m").orderBy("page")
    return pages.withColumn("__m", mark).withColumn("__n", F.row_number().over(before)).where("__n > 1").drop("__m", "__n")


def completed_pages(log: DataFrame) -> DataFrame:
    return log.where(F.col("status").isin(*ENDED)).select("query_group", "field", "term", F.coalesce("page", F.lit(0)).alias("page")).distinct()


def by_year(records: DataFrame) -> DataFrame:
    """Records by their journal's year; null and empty years are left out."""
    return records.select(F.col("journal.year").alias("year")).where("year is not null and year <> ''").groupBy("year").agg(F.count(F.lit(1)).alias("records"))


def languages(records: DataFrame, column: str) -> DataFrame:
    """Entries of a column by the role in their attributes, 'unknown' without one."""
    return records.select(F.explode(column).alias("e")).select(F.coalesce(F.try_element_at("e.attributes", F.lit("lang")), F.lit("unknown")).alias("lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("entries"))


def _has(column: str, role: str) -> Column:
    return F.coalesce(F.exists(column, lambda e: F.try_element_at(e["attributes"], F.lit("lang")) == role), F.lit(False))


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def summary(records: DataFrame) -> DataFrame:
    """One row: records, first and last year (as text), and how many have an original title, abstracts, and a lasting identifier."""
    year = F.nullif("journal.year", F.lit(""))
    return records.agg(
        F.count(F.lit(1)).alias("records_unique_across_runs"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.count_if(_has("titles", "original")).alias("has_original_title"),
        F.count_if(_has("abstracts", "original")).alias("has_original_abstract"),
        F.count_if(_has("abstracts", "english")).alias("has_english_abstract"),
        F.count_if(_filled("doi") | _filled("uci")).alias("has_persistent_identifier"),
    )


def topic_signals(records: DataFrame, topics: dict[str, tuple[str, ...]] = TOPICS) -> DataFrame:
    """By topic: records with any of its words in a title or abstract, without regard to case."""
    entries = F.concat(F.coalesce("titles", F.array()), F.coalesce("abstracts", F.array()))
    text = F.lower(F.array_join(F.transform(entries, lambda e: F.coalesce(e["value"], F.lit(""))), " "))
    rows = records.select(text.alias("t"))
    held = [F.struct(F.lit(k).alias("topic"), F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("t"), w)).alias("hit")) for k, words in topics.items()]
    return rows.select(F.inline(F.array(*held))).groupBy("topic").agg(F.count_if("hit").alias("records"))


def run_sizes(records: DataFrame) -> DataFrame:
    """Records of each run before any deduplication."""
    return records.groupBy("run_id").agg(F.count(F.lit(1)).alias("records_before_cross_run_deduplication"))


def run_receipts(records: DataFrame, log: DataFrame) -> DataFrame:
    """By run_id: distinct records (see :func:`unique_in_harvest`), pages done and pages failed, which are rows of the log; no secret is kept."""
    mark = F.coalesce(F.nullif("article_id", F.lit("")), F.sha2(F.to_json(F.struct(*sorted(c for c in records.columns if c != "run_id"))), 256))
    unique = records.groupBy("run_id").agg(F.count_distinct(mark).alias("records_unique"))
    pages = log.groupBy("run_id").agg(F.count_if(F.col("status").isin(*ENDED)).alias("queries_completed"), F.count_if(F.col("status") == "failed").alias("failures"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return unique.join(pages, "run_id", "full_outer").select("run_id", zero("records_unique"), zero("queries_completed"), zero("failures"), F.lit("not persisted").alias("credential"))
