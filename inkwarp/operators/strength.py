"""Strengths that an edit should keep, and sequences of anchors that should keep their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarp.functions.offsets import anchors_in_order, settle
from inkwarp.operators.markdown import HOLD

REVIEWS = ("preserved", "lost", "ask", "unreviewed")
RECORDED, DONE = "사람 판정 기록", "기계 확인 완료"


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _held(text: str, part: Column) -> Column:
    return (F.coalesce(part, F.lit("")) != "") & F.coalesce(F.col(text).contains(part), F.lit(False))


def _failures(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in pairs]), lambda m: m.isNotNull()).cast("array<string>")


def strength_records(pairs: DataFrame, strengths: DataFrame) -> DataFrame:
    """By pair and strength: found before and after, and failures.

    ``pairs``: pair_id, baseline, candidate; ``strengths``: pair_id, id, policy, baseline_text, candidate_text, position, function,
    surface_cost, risk_if_smoothed, review, reviewer_note. An id given twice in a pair fails.
    """
    twice = strengths.groupBy("pair_id", "id").agg(F.count(F.lit(1)).alias("times"))
    rows = strengths.join(twice, ["pair_id", "id"]).join(pairs, "pair_id")
    before = _held("baseline", F.col("baseline_text"))
    after = F.when(F.col("policy") == "exact", _held("candidate", F.col("baseline_text"))).when(F.col("policy") == "functional", _held("candidate", F.col("candidate_text")))
    review = F.coalesce("review", F.lit("unreviewed"))
    functional = F.col("policy") == "functional"
    out = rows.withColumn("baseline_found", before).withColumn("candidate_found", after)
    failures = _failures(
        (_blank("id") | (F.col("times") > 1), "invalid or duplicate strength id"),
        (_blank("position") | _blank("function") | _blank("surface_cost") | _blank("risk_if_smoothed"), "position, function, surface_cost, and risk_if_smoothed are required"),
        (~F.col("baseline_found"), "baseline_text not found"),
        ((F.col("policy") == "exact") & ~F.col("candidate_found"), "exact strength missing from candidate"),
        (functional & ~F.col("candidate_found"), "candidate_text not found"),
        (functional & ~review.isin(*REVIEWS), "invalid review value"),
        (functional & ((review != "preserved") | _blank("reviewer_note")), "human preserved decision and reviewer_note required"),
        (F.col("policy") == "ask", "author decision required"),
        (~F.coalesce(F.col("policy").isin("exact", "functional", "ask"), F.lit(False)), "policy must be exact, functional, or ask"),
    )
    return out.select("pair_id", "id", "policy", "baseline_found", "candidate_found", review.alias("review"), F.col("policy").isin("functional", "ask").alias("human"), failures.alias("failures"))


def anchor_layout(text: Column, anchors: Column, starts: Column) -> Column:
    """Characters, paragraphs and sentence marks from the first anchor to the last; null if an anchor is missing."""
    first = F.get(starts, F.lit(0))
    end = F.element_at(starts, -1) + F.length(F.element_at(anchors, -1))
    piece = F.substring(text, first + 1, end - first)
    paragraphs = F.size(F.filter(F.split(piece, "(?U)\\n\\s*\\n", -1), lambda p: F.regexp_replace(p, "(?U)\\s", "") != ""))
    layout = F.struct((end - first).alias("character_span"), F.greatest(F.lit(1), paragraphs).alias("paragraphs_spanned"), F.greatest(F.lit(1), F.regexp_count(piece, F.lit("[.!?]+"))).alias("sentences_spanned"))
    return F.when(starts.isNotNull() & (F.size(starts) > 0), layout)


def sequence_records(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """By pair and sequence: order and layout on both sides, compression, and failures.

    ``sequences``: pair_id, id, baseline_anchors, candidate_anchors ARRAY<STRING>, function, review, reviewer_note, compression_review,
    compression_note.
    """
    twice = sequences.groupBy("pair_id", "id").agg(F.count(F.lit(1)).alias("times"))
    rows = sequences.join(twice, ["pair_id", "id"]).join(pairs, "pair_id")
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    rows = settle(rows, bs=anchors_in_order(F.col("baseline"), some("baseline_anchors")), cs=anchors_in_order(F.col("candidate"), some("candidate_anchors")))
    rows = settle(rows, baseline_layout=anchor_layout(F.col("baseline"), F.col("baseline_anchors"), F.col("bs")), candidate_layout=anchor_layout(F.col("candidate"), F.col("candidate_anchors"), F.col("cs")))
    shorter = lambda f: F.col("candidate_layout")[f] < F.col("baseline_layout")[f]
    rows = rows.withColumn("layout_compressed", F.coalesce(shorter("paragraphs_spanned") | shorter("sentences_spanned"), F.lit(False)))
    review = F.coalesce("review", F.lit("unreviewed"))
    failures = _failures(
        (_blank("id") | (F.col("times") > 1), "invalid or duplicate sequence id"),
        (_blank("function"), "function is required"),
        (F.col("bs").isNull(), "baseline anchors missing or out of order"),
        (F.col("cs").isNull(), "candidate anchors missing or out of order"),
        (~review.isin(*REVIEWS), "invalid review value"),
        ((review != "preserved") | _blank("reviewer_note"), "human preserved decision and reviewer_note required"),
        (F.col("layout_compressed") & ((F.coalesce("compression_review", F.lit("unreviewed")) != "preserved") | _blank("compression_note")), "sequence layout compressed; compression review required"),
    )
    return rows.select("pair_id", "id", F.col("bs").isNotNull().alias("baseline_ordered"), F.col("cs").isNotNull().alias("candidate_ordered"), "baseline_layout", "candidate_layout", "layout_compressed", review.alias("review"), failures.alias("failures"))


def strength_status(pairs: DataFrame, strengths: DataFrame, sequences: DataFrame) -> DataFrame:
    """By pair: records, failures and status; a pair without a record is held, an id may not serve both lists."""
    a = strength_records(pairs, strengths).select("pair_id", "id", F.size("failures").alias("f"), F.col("human").cast("int").alias("h"))
    b = sequence_records(pairs, sequences).select("pair_id", "id", F.size("failures").alias("f"), F.lit(1).alias("h"))
    both = a.select("pair_id", "id").distinct().join(b.select("pair_id", "id").distinct(), ["pair_id", "id"]).groupBy("pair_id").agg(F.count(F.lit(1)).alias("shared"))
    sums = a.unionByName(b).groupBy("pair_id").agg(F.count(F.lit(1)).alias("records"), F.sum("f").alias("failures"), F.sum("h").alias("human_records"))
    out = pairs.select("pair_id").join(sums, "pair_id", "left").join(both, "pair_id", "left").fillna(0)
    out = out.withColumn("failures", F.col("failures") + F.col("shared") + (F.col("records") == 0).cast("int")).drop("shared")
    return out.withColumn("status", F.when(F.col("failures") > 0, HOLD).when(F.col("human_records") > 0, RECORDED).otherwise(DONE))
