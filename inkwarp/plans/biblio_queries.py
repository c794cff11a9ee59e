"""Queries of the bibliographic operators over records and query_log, with DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarp.operators.biblio import TOPICS, by_year, completed_pages, first_by_key, languages, repeated_pages, run_receipts, run_sizes, summary, topic_signals, unique_in_harvest
from inkwarp.sources.harvest import harvest_plan, planned_requests, remaining_pages
from inkwarp.sources.tables import table

MAX_PAGES = 4


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "records")


def _unique(spark: SparkSession, folder: str) -> DataFrame:
    return first_by_key(_records(spark, folder), ["run_id", "rec_no"])


def biblio_unique(spark: SparkSession, folder: str) -> DataFrame:
    """The first delivery of every id."""
    return _unique(spark, folder).select("rec_no", "article_id", "source_id", "run_id")


def biblio_harvest_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct records of the whole harvest: by article id, or else by all their content."""
    rows = _records(spark, folder).drop("rec_no", "batch_no", "harvested_at")
    one = unique_in_harvest(rows)
    return one.agg(F.count(F.lit(1)).alias("records"), F.count("article_id").alias("with_id"))


def biblio_years(spark: SparkSession, folder: str) -> DataFrame:
    return by_year(_unique(spark, folder))


def biblio_title_languages(spark: SparkSession, folder: str) -> DataFrame:
    return languages(_unique(spark, folder), "titles")


def biblio_abstract_languages(spark: SparkSession, folder: str) -> DataFrame:
    return languages(_unique(spark, folder), "abstracts")


def biblio_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summary(_unique(spark, folder))


def biblio_topics(spark: SparkSession, folder: str) -> DataFrame:
    return topic_signals(_unique(spark, folder))


def biblio_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_sizes(_records(spark, folder))


def harvest_done(spark: SparkSession, folder: str) -> DataFrame:
    return completed_pages(table(spark, folder, "query_log"))


def harvest_resume(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of every query in the log that are still to be asked for."""
    log = table(spark, folder, "query_log")
    return remaining_pages(log.select("query_group", "field", "term").distinct(), MAX_PAGES, log)


def biblio_run_receipts(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct records and pages of every run."""
    return run_receipts(_records(spark, folder).drop("rec_no", "batch_no", "harvested_at"), table(spark, folder, "query_log"))


def repeated_log_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of the log that tell the same numbers as an earlier page of their query."""
    numbers = F.array(F.col("total").cast("string"), F.col("records").cast("string"), F.col("new_records").cast("string"))
    log = table(spark, folder, "query_log").where("page is not null").select("query_group", "field", "term", "page", numbers.alias("ids")).distinct()
    return repeated_pages(log).select("query_group", "field", "term", "page", F.array_join("ids", ",", "").alias("numbers"))


def harvest_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of a dry run by group: the groups and terms of the log, in two fields each."""
    log = table(spark, folder, "query_log").where("query_group is not null and term is not null")
    groups = log.groupBy("query_group").agg(F.sort_array(F.collect_set("term")).alias("terms")).orderBy("query_group").collect()  # the declared terms of a harvest
    return planned_requests(harvest_plan(spark, [{"id": r.query_group, "terms": r.terms} for r in groups], ["title", "keyword"]))


def queries() -> dict:
    named = (biblio_unique, biblio_harvest_unique, biblio_years, biblio_title_languages, biblio_abstract_languages, biblio_summary, biblio_topics, biblio_runs, harvest_done, harvest_resume, biblio_run_receipts, repeated_log_pages, harvest_requests)
    return {q.__name__: q for q in named}


def oracle_sql() -> dict[str, str]:
    first = "k as (select *, coalesce(nullif(article_id, ''), nullif(source_id, '')) as key from records), u as (select * from k where key is not null qualify row_number() over (partition by key order by run_id, rec_no) = 1)"
    role = "coalesce(e.attributes['lang'], 'unknown')"
    has = lambda c, r: f"count(*) filter (where coalesce(len(list_filter({c}, lambda e: e.attributes['lang'] = '{r}')) > 0, false))"
    langs = lambda c: f"with {first}, x as (select unnest({c}) as e from u) select {role} as lang, count(*) as entries from x group by 1"
    text = "lower(array_to_string(list_transform(list_concat(coalesce(titles, []), coalesce(abstracts, [])), lambda e: coalesce(e.value, '')), ' '))"
    topic = " union all ".join(f"select '{k}' as topic, count(*) filter (where {' or '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in words)}) as records from t" for k, words in TOPICS.items())
    done = "done as (select distinct query_group, field, term, coalesce(page, 0) as page from query_log where status in ('ok', 'repeated-page-stopped'))"
    return {
        "biblio_unique": f"with {first} select rec_no, article_id, source_id, run_id from u",
        "biblio_harvest_unique": "with c as (select * exclude (rec_no, batch_no, harvested_at) from records), d as (select distinct nullif(article_id, '') as a, case when nullif(article_id, '') is null then cast(c as varchar) end as s from c) select count(*) as records, count(a) as with_id from d",
        "biblio_run_receipts": "with c as (select * exclude (rec_no, batch_no, harvested_at) from records), r as (select run_id, count(distinct coalesce(nullif(article_id, ''), cast(c as varchar))) as records_unique from c group by 1), p as (select run_id, count(*) filter (where status in ('ok', 'repeated-page-stopped')) as queries_completed, count(*) filter (where status = 'failed') as failures from query_log group by 1) select coalesce(r.run_id, p.run_id) as run_id, coalesce(records_unique, 0) as records_unique, coalesce(queries_completed, 0) as queries_completed, coalesce(failures, 0) as failures, 'not persisted' as credential from r full join p on r.run_id = p.run_id",
        "repeated_log_pages": "with d as (select distinct query_group, field, term, page, concat_ws(',', coalesce(cast(total as varchar), ''), coalesce(cast(records as varchar), ''), coalesce(cast(new_records as varchar), '')) as numbers from query_log where page is not null) select * from d qualify row_number() over (partition by query_group, field, term, numbers order by page) > 1",
        "harvest_requests": "select query_group, 2 * count(distinct term) as requests from query_log where query_group is not null and term is not null group by 1",
        "biblio_years": f"with {first} select journal.year as year, count(*) as records from u where journal.year is not null and journal.year <> '' group by 1",
        "biblio_title_languages": langs("titles"),
        "biblio_abstract_languages": langs("abstracts"),
        "biblio_summary": f"with {first} select count(*) as records_unique_across_runs, min(nullif(journal.year, '')) as first_year, max(nullif(journal.year, '')) as last_year, {has('titles', 'original')} as has_original_title, {has('abstracts', 'original')} as has_original_abstract, {has('abstracts', 'english')} as has_english_abstract, count(*) filter (where coalesce(doi, '') <> '' or coalesce(uci, '') <> '') as has_persistent_identifier from u",
        "biblio_topics": f"with {first}, t as (select {text} as t from u) {topic}",
        "biblio_runs": "select run_id, count(*) as records_before_cross_run_deduplication from records group by run_id",
        "harvest_done": f"with {done} select * from done",
        "harvest_resume": f"with {done}, q as (select distinct query_group, field, term from query_log), p as (select q.*, cast(n as integer) as page from q, range(1, {MAX_PAGES + 1}) as r(n)) select p.* from p where not exists (select 1 from done d where d.query_group is not distinct from p.query_group and d.field is not distinct from p.field and d.term is not distinct from p.term and d.page = p.page)",
    }
