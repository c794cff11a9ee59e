"""Before and after: rule counts, deltas and what they say of target and kept rules. Before is prepared once a pair, however many candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwarp.functions.spans import MARKER
from inkwarp.operators.edits import measure_edits
from inkwarp.operators.markdown import HOLD, PASS
from inkwarp.operators.rules import KOREAN, Allowance, Rule, gate_rules
from inkwarp.operators.scan import allowed_hit, hits, prepare


def _changes(pairs: DataFrame, rules: Sequence[Rule], allow: Sequence[Allowance], extra: list[str] | None = None, translation_source: bool = False, provenance: str = "unknown", marker: str = MARKER) -> DataFrame:
    """By pair, candidate, what ('rule' or 'value') and name: findings that are not allowed, or protected spans of a value, before and after.

    Every text is prepared once, and its findings and protected values leave it as rows of two words; the candidates of a pair are a handful.
    """
    before = pairs.groupBy("pair_id").agg(F.min("before").alias("text")).select("pair_id", F.lit(None).cast("string").alias("candidate"), "text")
    sides = before.unionByName(pairs.select("pair_id", "candidate", F.col("after").alias("text"))).where("text is not null")
    rows = prepare(sides, "text", extra, marker)
    mark = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    active = F.filter(hits(gate_rules(rules, translation_source, provenance)[0]), lambda h: ~allowed_hit(h, allow))
    marks = F.concat(F.transform(active, lambda h: mark("rule", h["rule_id"])), F.transform("protected", lambda s: mark("value", s["value"])))
    counted = rows.select("pair_id", "candidate", F.inline(marks)).groupBy("pair_id", "candidate", "what", "name").agg(F.count(F.lit(1)).alias("n"))
    both = counted.groupBy("pair_id", "what", "name").agg(F.sum(F.when(F.col("candidate").isNull(), F.col("n"))).alias("b"), F.map_from_entries(F.collect_list(F.when(F.col("candidate").isNotNull(), F.struct("candidate", "n")))).alias("a"))
    each = both.join(pairs.groupBy("pair_id").agg(F.collect_set("candidate").alias("c")), "pair_id").select("pair_id", F.explode("c").alias("candidate"), "what", "name", "b", "a")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return each.select("pair_id", "candidate", "what", "name", zero(F.col("b")).alias("before_count"), zero(F.try_element_at("a", F.col("candidate"))).alias("after_count")).where("before_count > 0 or after_count > 0")


def rule_deltas(pairs: DataFrame, rules: Sequence[Rule] = KOREAN, allow: Sequence[Allowance] = (), **options) -> DataFrame:
    """By pair, candidate and rule found on either side: counts before and after (not allowed ones), and their difference.

    ``pairs``: pair_id, candidate, before, after; one text before for each pair. Null texts have no findings.
    """
    found = _changes(pairs, rules, allow, **options).where("what = 'rule'")
    return found.select("pair_id", "candidate", F.col("name").alias("rule_id"), "before_count", "after_count", (F.col("after_count") - F.col("before_count")).alias("delta"))


def style_gate(pairs: DataFrame, targets: Sequence[str], preserved: Sequence[str] = (), rules: Sequence[Rule] = KOREAN, allow: Sequence[Allowance] = (), extra: list[str] | None = None, **options) -> DataFrame:
    """By pair and candidate: reduced, preserved, invalid, unverifiable, unresolved and worse targets, new rules, lost values, status.

    It passes if no protected value is lost, every target is reduced or validly preserved, no other rule grows, and every preserved
    rule is a target that occurs before.
    """
    targets, preserved = list(dict.fromkeys(targets)), sorted(set(preserved))
    changes = _changes(pairs, rules, allow, extra, **options)
    delta = (F.col("after_count") - F.col("before_count")).alias("delta")
    whole = changes.groupBy("pair_id", "candidate").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("what") == "rule", F.struct(F.col("name").alias("rule_id"), F.struct("before_count", delta))))).alias("d"),
        F.array_sort(F.collect_list(F.when((F.col("what") == "value") & (F.col("after_count") < F.col("before_count")), F.struct(F.col("name").alias("value"), F.col("before_count").alias("expected"), F.col("after_count").alias("actual"))))).alias("lost_values"),
    )
    base = pairs.select("pair_id", "candidate").distinct().join(whole, ["pair_id", "candidate"], "left")
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    n = lambda r, f: F.coalesce(F.try_element_at("d", r)[f], F.lit(0))
    t, keep = strings(targets), strings(preserved)
    valid = F.filter(keep, lambda r: F.array_contains(t, r) & (n(r, "before_count") > 0))
    out = base.select(
        "pair_id",
        "candidate",
        F.filter(t, lambda r: n(r, "delta") < 0).alias("target_reduced"),
        valid.alias("target_preserved"),
        F.array_except(keep, valid).alias("invalid_preserved_rules"),
        F.filter(t, lambda r: n(r, "before_count") == 0).alias("target_unverifiable"),
        F.filter(t, lambda r: ~F.array_contains(valid, r) & (n(r, "delta") >= 0)).alias("target_unresolved"),
        F.filter(t, lambda r: n(r, "delta") > 0).alias("target_regressions"),
        F.array_sort(F.map_keys(F.map_filter(F.coalesce("d", F.create_map().cast("map<string,struct<before_count:bigint,delta:bigint>>")), lambda r, v: (v["delta"] > 0) & ~F.array_contains(t, r)))).alias("introduced_candidates"),
        F.coalesce("lost_values", F.array().cast("array<struct<value:string,expected:bigint,actual:bigint>>")).alias("lost_values"),
    )
    clean = (F.size("lost_values") == 0) & (F.size("target_unresolved") == 0) & (F.size("introduced_candidates") == 0) & (F.size("invalid_preserved_rules") == 0)
    return out.withColumn("status", F.when(clean, PASS).otherwise(HOLD))


# What a comparison of candidates says.
ELIGIBLE, LEFT_OUT = "비교 가능", "비교 제외"
REVIEW_NEXT, MEND_FIRST = "순서를 가린 사람 검토", "보호·표지 gate 실패를 먼저 해결"


def compare_candidates(pairs: DataFrame, targets: Sequence[str], **options) -> tuple[DataFrame, DataFrame]:
    """(candidates, pairs): each candidate's gate, edit size and eligibility; each pair's eligible candidates and what comes next.

    A pair is compared only if it has two candidates or more with distinct names; others raise ValueError. Nothing is ranked.
    """
    few = pairs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("candidate").alias("names")).where("n < 2 or names < n").first()
    if few:
        raise ValueError(f"{few.pair_id}: needs two candidates or more with distinct names")
    gates = style_gate(pairs, targets, **options)
    sizes = measure_edits(pairs, ["pair_id", "candidate"])
    each = gates.join(sizes, ["pair_id", "candidate"]).withColumn("eligibility", F.when(F.col("status") == PASS, ELIGIBLE).otherwise(LEFT_OUT))
    # candidates of one pair are a handful
    whole = gates.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.when(F.col("status") == PASS, F.col("candidate")))).alias("eligible_candidates"))
    return each, whole.withColumn("next_step", F.when(F.size("eligible_candidates") > 0, REVIEW_NEXT).otherwise(MEND_FIRST))
