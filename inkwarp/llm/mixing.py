"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 60-bit hash of its key. The tokens of each source are summed by the hash's leading digits; prefix
sums of this bounded histogram say in which bucket a source's budget ends. Only that bucket is split by the next
digits, until it is settled, and the rows below the threshold are taken by a filter: no sort, no shuffle of
rows. A row that stands across the budget is taken if that comes nearer to it, so a source misses its budget by
at most half a row, and the thresholds of growing budgets are nested whatever the rows' sizes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT_BITS = 12


@dataclass(frozen=True)
class Plan:
    """Of one source: whole repeats of all rows, and the hash threshold below which rows are taken once more."""

    source: str
    weight: float
    max_repeats: int
    available: int
    asked: float
    budget: float
    repeats: int
    threshold: int  # of 2**60


def source_key(col: Column) -> Column:
    """A source's name without regard to case, space around it, and dashes for underscores; null for blank."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(F.regexp_replace(col, "[\\s\\p{Z}]+", " "))), "[\\s\\p{Pd}_]+", "_"), F.lit(""))


def row_hash(col: Column, seed: int) -> Column:
    """60 uniform bits of a key."""
    return F.xxhash64(col, F.lit(seed)).bitwiseAND(F.lit((1 << 60) - 1))


def budgets(available: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, tuple[float, float]]:
    """Tokens asked of each source, its share among all targets of ``total``, and those it can give.

    Without ``total`` the mix is as large as what the targeted sources hold, each row counted once. A source that
    cannot fill its share gives what its repeats allow, and one without tokens nothing; the others' budgets do
    not change for that, so a scarce source neither shrinks the mix nor counts for more than it holds.
    """
    able = [(s, w, r) for s, w, r in targets if w > 0 and r > 0]
    weights = sum(w for _, w, _ in able)
    if total is None:
        total = sum(available.get(s, 0) for s, _, _ in able)
    asked = {s: total * w / weights for s, w, _ in able}
    return {s: (asked[s], min(asked[s], available.get(s, 0) * r)) for s, _, r in able}


def plan_mix(sized: DataFrame, targets: list[tuple[str, float, int]], total: float | None = None, bits: int = DIGIT_BITS) -> list[Plan]:
    """Thresholds for ``sized`` (source STRING, h LONG, tokens LONG); the driver holds ``2**bits`` sums a source."""
    names = [s for s, _, _ in targets]
    mine = sized.where(F.col("source").isin(names) & (F.col("tokens") > 0))
    digit = lambda level: F.shiftright("h", 60 - bits * (level + 1)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    first = mine.groupBy("source", digit(0).alias("d")).agg(F.sum("tokens").alias("t")).collect()
    sums: dict[str, dict[int, int]] = {}
    for r in first:
        sums.setdefault(r.source, {})[r.d] = r.t
    available = {s: sum(v.values()) for s, v in sums.items()}
    wanted = budgets(available, targets, total)
    plans = {s: (int(b // available[s]), b - available[s] * int(b // available[s])) for s, (_, b) in wanted.items() if b > 0}
    open_: dict[str, list] = {}  # source: prefix, rest of its budget
    done: dict[str, int] = {}

    def settle(s: str, prefix: int, rest: float, hist: dict[int, int], level: int) -> None:
        shift = 60 - bits * (level + 1)
        for d in sorted(hist):
            if hist[d] > rest:
                if level + 1 < 60 // bits:
                    open_[s] = [(prefix << bits) | d, rest]
                else:
                    done[s] = ((prefix << bits) | d) + (2 * rest > hist[d])  # one hash value
                return
            rest -= hist[d]
        done[s] = ((prefix + 1) << (shift + bits)) if level else 1 << 60

    for s, (_, rest) in plans.items():
        settle(s, 0, rest, sums[s], 0)
    for level in range(1, 60 // bits):
        if not open_:
            break
        now, open_ = open_, {}
        here = F.lit(False)
        for s, (prefix, _) in now.items():
            here = here | ((F.col("source") == s) & (F.shiftright("h", 60 - bits * level) == prefix))
        hists: dict[str, dict[int, int]] = {s: {} for s in now}
        for r in mine.where(here).groupBy("source", digit(level).alias("d")).agg(F.sum("tokens").alias("t")).collect():
            hists[r.source][r.d] = r.t
        for s, (prefix, rest) in now.items():
            settle(s, prefix, rest, hists[s], level)
    return [Plan(s, w, r, available.get(s, 0), *wanted.get(s, (0.0, 0.0)), plans[s][0] if s in plans else 0, done.get(s, 0)) for s, w, r in targets]


def times(plans: list[Plan]) -> Column:
    """How often a row (source, h) is taken; never more than its source's repeats."""
    taken = F.lit(0)
    for p in plans:
        if p.budget > 0:
            below = F.col("h") < F.lit(p.threshold)
            again = F.least(F.lit(p.max_repeats), F.lit(p.repeats) + below.cast("int"))
            taken = F.when(F.col("source") == p.source, again).otherwise(taken)
    return taken.cast("int")


def mix(sized: DataFrame, plans: list[Plan]) -> DataFrame:
    """The rows of ``sized`` that are taken, each as often as it is, with ``copy`` from 1."""
    return sized.where(F.col("tokens") > 0).withColumn("times", times(plans)).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "h")


def shares(sized: DataFrame, plans: list[Plan]) -> DataFrame:
    """Per target: weight, rows, rows and tokens taken, target share (of all weights) and actual share.

    ``tokens_asked`` is the target share of the mix's size; where a source's repeats cannot fill it, ``tokens_short`` tells
    what is missing.
    """
    spark = sized.sparkSession
    weights = sum(p.weight for p in plans) or 1.0
    targets = spark.createDataFrame([(p.source, float(p.weight), int(p.max_repeats), p.weight / weights, float(p.asked), float(p.asked - p.budget)) for p in plans], "source string, weight double, max_repeats int, target_share double, tokens_asked double, tokens_short double")
    used = sized.withColumn("times", times(plans)).groupBy("source").agg(F.count_if(F.col("times") > 0).alias("rows_taken"), F.max("times").alias("most_repeats"), F.sum(F.col("times") * F.col("tokens")).alias("tokens_taken"), F.sum("tokens").alias("tokens_available"))
    whole = used.agg(F.sum("tokens_taken")).first()[0] or 0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return targets.join(used, "source", "left").select("source", "weight", "max_repeats", "target_share", "tokens_asked", "tokens_short", zero("rows_taken"), zero("most_repeats"), zero("tokens_available"), zero("tokens_taken"), (F.coalesce(F.col("tokens_taken"), F.lit(0)) / F.lit(float(whole or 1))).alias("actual_share"))
