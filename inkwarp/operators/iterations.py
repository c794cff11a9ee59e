"""Chains of versions: what changed from version to version and from the baseline, returns to an earlier state, structure.

Windows run over hashes, not texts; a pair of texts is measured once, however often it occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwarp.operators.edits import measure_edits
from inkwarp.operators.markdown import PASS, changed_keys

DONE, REVIEW = "기계 확인 완료", "사람 검토"


def iteration_states(versions: DataFrame) -> DataFrame:
    """By version: hashes, equal to the one before, changed after an unchanged one, and the label it returned to.

    ``versions``: chain_id, ord INT (0 is the baseline), label, text; ord is unique in a chain, null texts are left out.
    """
    hashed = versions.where("text is not null").select("chain_id", "ord", "label", F.sha2("text", 256).alias("hash"))
    order = Window.partitionBy("chain_id").orderBy("ord")
    same = F.coalesce(F.col("hash") == F.lag("hash").over(order), F.lit(False))
    first = Window.partitionBy("chain_id", "hash").orderBy("ord")
    out = hashed.withColumn("previous_hash", F.lag("hash").over(order)).withColumn("baseline_hash", F.first("hash").over(order)).withColumn("same_as_previous", same)
    out = out.withColumn("changed_after_no_change", F.coalesce(F.max("same_as_previous").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)) & ~F.col("same_as_previous"))
    out = out.withColumn("first_ord", F.first("ord").over(first)).withColumn("first_label", F.first("label").over(first))
    return out.withColumn("returned_to", F.when(~F.col("same_as_previous") & (F.col("first_ord") < F.col("ord")), F.col("first_label"))).drop("first_ord", "first_label")


def iteration_audit(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions, chains): each version after the baseline with its measures, and each chain's status and warnings."""
    states = iteration_states(versions).where("ord > 0")
    texts = versions.where("text is not null").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("text").alias("text"))
    pairs = states.select(F.col("previous_hash").alias("h1"), F.col("hash").alias("h2")).union(states.select("baseline_hash", "hash")).distinct()
    both = pairs.join(texts.select(F.col("hash").alias("h1"), F.col("text").alias("before")), "h1").join(texts.select(F.col("hash").alias("h2"), F.col("text").alias("after")), "h2")
    sizes = measure_edits(both, ["h1", "h2"]).select("h1", "h2", "comparison_method", "changed_character_ratio", "changed_line_ratio", "changed_sentence_slots")
    marks = both.select("h1", "h2", changed_keys(F.col("before"), F.col("after")).alias("markdown_changed"))

    def against(side: str, tag: str) -> DataFrame:
        return sizes.select(F.col("h1").alias(side), F.col("h2").alias("hash"), *[F.col(c).alias(f"{c}_from_{tag}") for c in sizes.columns if c not in ("h1", "h2")])

    rows = states.join(against("previous_hash", "previous"), ["previous_hash", "hash"]).join(against("baseline_hash", "baseline"), ["baseline_hash", "hash"])
    rows = rows.join(marks.select(F.col("h1").alias("baseline_hash"), F.col("h2").alias("hash"), "markdown_changed"), ["baseline_hash", "hash"])
    chains = rows.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("versions"),
        F.bool_or("changed_after_no_change").alias("changed_after_no_change"),
        F.count("returned_to").alias("oscillations"),
        F.count_if(F.size("markdown_changed") > 0).alias("structure_changes"),
        F.max_by("same_as_previous", "ord").alias("latest_same_as_previous"),
    )
    clean = ~F.col("changed_after_no_change") & (F.col("oscillations") == 0) & (F.col("structure_changes") == 0)
    return rows, chains.withColumn("status", F.when(clean, DONE).otherwise(REVIEW))


__all__ = ["DONE", "PASS", "REVIEW", "iteration_audit", "iteration_states"]
