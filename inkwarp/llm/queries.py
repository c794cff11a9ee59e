"""Queries of the training-data operators; names and columns as the problems state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarp.llm import history_queries, term_queries
from inkwarp.llm.byte_bpe import encode, token_count
from inkwarp.llm.languages import OTHER, language_code, language_table, sample_labelled, train_on
from inkwarp.llm.mojibake import garbled
from inkwarp.llm.mixing import mix, plan_mix, row_hash, shares, source_key
from inkwarp.llm.sentences import sentence_table
from inkwarp.llm.subjects import assign_subjects
from inkwarp.session import cut
from inkwarp.sources.tables import table

MIX_SEED = 20240


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every text of documents; empty for empty and null texts."""
    return table(spark, folder, "documents").select("doc_id", encode(F.col("text")).alias("ids"))


def _sized(spark: SparkSession, folder: str) -> tuple[DataFrame, list]:
    documents = table(spark, folder, "documents")
    sized = cut(documents.select("doc_id", source_key(F.col("source")).alias("source"), row_hash(F.col("doc_id"), MIX_SEED).alias("h"), token_count(F.col("text")).alias("tokens")))
    targets = [(r.source, r.weight, r.max_repeats) for r in table(spark, folder, "mix_targets").select(source_key(F.col("source")).alias("source"), "weight", "max_repeats").where("source is not null and weight is not null and max_repeats is not null").orderBy("source").collect()]
    return sized, targets


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of documents in the mix, one row for each time a document is taken."""
    sized, targets = _sized(spark, folder)
    return mix(sized, plan_mix(sized, targets)).select("doc_id", "source", "tokens", "copy")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source of mix_targets."""
    sized, targets = _sized(spark, folder)
    return shares(sized, plan_mix(sized, targets))


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Garbled rows of documents with the original text where it can be had."""
    return garbled(table(spark, folder, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of documents whose text is garbled."""
    return p8_restored(spark, folder).select("doc_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence units of every manuscript; a row given twice counts once."""
    return sentence_table(table(spark, folder, "manuscripts"), "document_id", "text").select("document_id", "start_pos", "end_pos").distinct()


def p3_mixtures(spark: SparkSession, folder: str) -> DataFrame:
    """Subject areas of every record with their shares."""
    entries = F.concat(F.coalesce("titles", F.array()), F.coalesce("abstracts", F.array()))
    texts = F.filter(F.transform(entries, lambda e: e["value"]), lambda v: v.isNotNull())
    labels = table(spark, folder, "subject_labels").select("rec_no", F.col("subject_code").alias("subject"))
    subjects = [(r.subject_code, [r.name_ko, r.name_en]) for r in table(spark, folder, "subjects").where("subject_code is not null").orderBy("subject_code").collect()]
    records = table(spark, folder, "records").where("rec_no is not null").select("rec_no", texts.alias("texts"))
    return assign_subjects(records, "rec_no", "texts", labels, subjects)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Subject areas of every record."""
    return p3_mixtures(spark, folder).select("rec_no", "subject_code")


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of titles and abstracts: rec_no, field, pos, label, text."""
    records = table(spark, folder, "records")
    each = [records.select("rec_no", F.lit(f).alias("field"), F.posexplode(f).alias("pos", "e")) for f in ("titles", "abstracts")]
    return each[0].unionByName(each[1]).select("rec_no", "field", "pos", F.try_element_at("e.attributes", F.lit("code")).alias("label"), F.col("e.value").alias("text"))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    entries = _entries(spark, folder)
    model = train_on(sample_labelled(entries, "text", "label", ["rec_no", "field", "pos"]))
    named = entries.withColumn("named", language_code(F.col("label")))
    return language_table(named, ["rec_no", "field", "pos", "named"], "text", model)


def p2_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Language and confidence of every stretch of every title and abstract."""
    return _segments(spark, folder).drop("named")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of the entries whose label is missing or wrong or which mix languages; a stretch in none of the languages known gives no row."""
    found = _segments(spark, folder).where(F.col("lang") != OTHER).groupBy("rec_no", "field", "pos", "named").agg(F.collect_set("lang").alias("langs"))
    wrong = F.col("named").isNull() | (F.size("langs") > 1) | (F.col("langs")[0] != F.col("named"))
    return found.where(wrong).select("rec_no", "field", "pos", F.explode("langs").alias("lang"))


def queries() -> dict:
    return {**term_queries.queries(), **history_queries.queries(), "p2_found": p2_found, "p2_segments": p2_segments, "p3_found": p3_found, "p3_mixtures": p3_mixtures, "p5_found": p5_found, "p8_found": p8_found, "p8_restored": p8_restored, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares}


def oracle_sql() -> dict[str, str]:
    return {**term_queries.oracle_sql(), **history_queries.oracle_sql()}
