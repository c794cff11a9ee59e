"""Review ledger of findings, and its reconciliation with what was reviewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwarp.operators.markdown import HOLD, PASS
from inkwarp.session import cut

# Enumerations, and the claims each mode allows.
MODES = ("sample", "residual", "exhaustive")
METHODS = ("mechanical", "human", "excluded", "unreviewed")
VERDICTS = ("preserve", "edit", "ask", "false_positive", "unreviewed")
CLAIMS = {
    "sample": ("표본 검토", ("표본에서 확인된 경향", "추가 전수 확인 필요"), ("전부", "모두", "매번", "낱낱", "각각")),
    "residual": ("전수 기계·규칙 분류", ("전수 분류 완료", "전수 문맥 확인은 아님", "잔여 항목은 사람 검토 필요"), ("전부 문맥 확인", "모든 용례를 읽음", "매번", "낱낱")),
    "exhaustive": ("전수 문맥 검토", ("전수 문맥 검토 완료", "각 앵커의 판단 근거는 ledger에 기록됨"), ()),
}


def with_ordinal(rows: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """Number rows from 1 in the order of ``order`` without one task for all: range partitions, numbered by themselves, plus offsets.

    Ties are numbered in any order. The driver sees one count for each partition.
    """
    spread = cut(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = {r["__p"]: r["count"] for r in spread.groupBy("__p").count().collect()}
    at, offsets = 0, []
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(at)]
        at += sizes[p]
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    if not offsets:
        return spread.withColumn(name, within.cast("long")).drop("__p")
    return spread.withColumn(name, (within + F.try_element_at(F.create_map(*offsets), F.col("__p"))).cast("long")).drop("__p")


def build_ledger(findings: DataFrame) -> DataFrame:
    """A row to review for every finding, allowed ones too; its anchor id is document:rule:start:end:ordinal."""
    rows = with_ordinal(findings.withColumn("document_id", F.coalesce(F.col("document_id").cast("string"), F.lit("single-input"))), ["document_id", "start", "rule_id", "end"])
    kept = [c for c in findings.columns if c not in ("allowed", "allow_scope", "allow_reason", "shape")]
    return rows.select(F.concat_ws(":", "document_id", "rule_id", "start", "end", "ordinal").alias("anchor_id"), *kept, F.coalesce("shape", F.lit("")).alias("shape"), F.lit("unreviewed").alias("review_method"), F.lit("unreviewed").alias("verdict"), F.lit("").alias("reason"))


def reconcile(expected: DataFrame, ledger: DataFrame, order: Column | None = None) -> DataFrame:
    """By anchor of either side: expected, rows in the ledger, last review, and state.

    ``expected``: anchor_id; ``ledger``: anchor_id, review_method, verdict. The last row by ``order`` counts where an anchor has
    several (any of them without an order). States: missing, unknown, invalid, unresolved, human, reviewed. Null ids are ''.
    """
    key = F.coalesce(F.col("anchor_id"), F.lit("")).alias("anchor_id")
    last = order if order is not None else F.struct("review_method", "verdict")
    have = ledger.select(key, "review_method", "verdict", last.alias("__o")).groupBy("anchor_id").agg(F.count(F.lit(1)).alias("ledger_rows"), F.max_by(F.struct("review_method", "verdict"), "__o").alias("r"))
    want = expected.select(key).distinct().withColumn("expected", F.lit(True))
    both = want.join(have, "anchor_id", "full_outer")
    method, verdict = F.coalesce("r.review_method", F.lit("")), F.coalesce("r.verdict", F.lit(""))
    state = (
        F.when(F.col("ledger_rows").isNull(), "missing")
        .when(F.col("expected").isNull(), "unknown")
        .when(~method.isin(*METHODS) | ~verdict.isin(*VERDICTS), "invalid")
        .when((method == "unreviewed") | (verdict == "unreviewed"), "unresolved")
        .when(method == "human", "human")
        .otherwise("reviewed")
    )
    return both.select("anchor_id", F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("ledger_rows", F.lit(0)).cast("long").alias("ledger_rows"), method.alias("review_method"), verdict.alias("verdict"), state.alias("state"))


def coverage(reconciled: DataFrame, mode: str) -> DataFrame:
    """One row: counts of each state, duplicates, claim scope, and status under ``mode``."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of: {', '.join(MODES)}")
    n = lambda *states: F.count_if(F.col("state").isin(*states))
    out = reconciled.agg(
        F.count_if("expected").alias("anchors_total"),
        n("human", "reviewed").alias("anchors_reviewed"),
        n("human").alias("anchors_human_reviewed"),
        n("unresolved").alias("anchors_unresolved"),
        n("missing").alias("missing"),
        n("unknown").alias("unknown"),
        n("invalid").alias("invalid"),
        F.count_if(F.col("ledger_rows") > 1).alias("duplicates"),
    )
    sound = (F.col("missing") == 0) & (F.col("unknown") == 0) & (F.col("invalid") == 0) & (F.col("duplicates") == 0)
    rule = {
        "sample": (F.col("anchors_total") == 0) | (F.col("anchors_human_reviewed") > 0),
        "residual": F.col("anchors_unresolved") == 0,
        "exhaustive": (F.col("anchors_unresolved") == 0) & (F.col("anchors_reviewed") == F.col("anchors_human_reviewed")),
    }[mode]
    scope, allowed, forbidden = CLAIMS[mode]
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return out.select(F.lit(mode).alias("mode"), F.lit(scope).alias("claim_scope"), texts(allowed).alias("allowed_claims"), texts(forbidden).alias("forbidden_claims"), "*", F.when(sound & rule, PASS).otherwise(HOLD).alias("status"))
