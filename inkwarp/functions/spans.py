"""Values that an edit must keep: protected spans, overlap and loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwarp.functions.offsets import find_all, find_literal, settle

PROTECTED = "array<struct<kind:string,start:int,end:int,value:string>>"
MARKER = "inkwarp"

# The patterns of protected kinds, in order.
QUOTATION = '"[^"\\n]{1,500}"|“[^”\\n]{1,500}”|「[^」\\n]{1,500}」|『[^』\\n]{1,500}』'
DATE = "(?U)\\b\\d{4}[.-]\\d{1,2}[.-]\\d{1,2}\\b|\\d{4}년\\s*\\d{1,2}월(?:\\s*\\d{1,2}일)?"
STATUTE = "(?U)제\\s*\\d+\\s*조(?:의\\s*\\d+)?(?:\\s*제\\s*\\d+\\s*항)?"
NUMBER = "(?U)(?<![\\d가-힣])\\d{1,3}(?:,\\d{3})*(?:\\.\\d+)?(?:\\s*(?:%|명|개|원|회|쪽|년|월|일|조|항|호))?"
QUOTED_LINE = "(?m)^>[^\\n]*\\n?"


def block_pattern(marker: str = MARKER) -> str:
    return f"(?isU)<!--\\s*{marker}:protect-start\\s*-->.*?<!--\\s*{marker}:protect-end\\s*-->"


def _kind(name: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _merged_lines(spans: Column) -> Column:
    """Neighbouring line spans as one: line by line, so that a long quotation needs no deep recursion."""
    zero = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        grown = F.struct(last["start"].alias("start"), s["end"].alias("end"), F.concat(last["value"], s["value"]).alias("value"))
        near = (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end"] == s["start"])
        return F.when(near, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(out, F.array(s))).cast("array<struct<start:int,end:int,value:string>>")

    return F.aggregate(spans, zero, step)


def overlaps(start: Column, end: Column, spans: Column) -> Column:
    """Whether a half-open span overlaps any of ``spans``."""
    return F.exists(spans, lambda s: (start < s["end"]) & (end > s["start"]))


def with_protected(df: DataFrame, text: str, name: str = "protected", extra: list[str] | None = None, marker: str = MARKER) -> DataFrame:
    """``df`` with the protected spans of a text, sorted by start and end: blocks, quotations, dates, statutes, numbers, and ``extra`` literals.

    A number that overlaps a span of another kind is left out; the extra literals never are. A null text has none.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    first = F.concat(
        _kind("protected_block", find_all(t, block_pattern(marker))),
        _kind("blockquote", _merged_lines(find_all(t, QUOTED_LINE))),
        _kind("quotation", find_all(t, QUOTATION)),
        _kind("date", find_all(t, DATE)),
        _kind("statute", find_all(t, STATUTE)),
    )
    out = settle(df, __first=first, __numbers=_kind("number", find_all(t, NUMBER)))
    numbers = F.filter("__numbers", lambda n: ~overlaps(n["start"], n["end"], F.col("__first")))
    parts = [F.col("__first"), numbers] + [_kind("user", find_literal(t, v)) for v in dict.fromkeys(extra or []) if v]
    order = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))
    return settle(out, **{name: _back(F.array_sort(F.transform(F.concat(*parts), order)))}).drop("__first", "__numbers")


def _back(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def protect_values(lines: DataFrame, column: str = "value") -> list[str]:
    """The literals of a protect list: trimmed lines, without blank ones and those that start with '#'."""
    kept = lines.select(F.trim(F.regexp_replace(F.col(column), "(?U)^\\s+|\\s+$", "")).alias("v")).where("v <> '' and not startswith(v, '#')")
    return [r.v for r in kept.collect()]


def lost_values(pairs: DataFrame, keys: list[str], before: str = "before", after: str = "after", extra: list[str] | None = None, marker: str = MARKER) -> DataFrame:
    """Values protected more often before than after: keys, value, expected, actual. Kind and place do not count."""
    sides = []
    for column, n in ((before, "expected"), (after, "actual")):
        sides.append(with_protected(pairs.select(*keys, column), column, "__p", extra, marker).select(*keys, F.explode("__p").alias("s")).select(*keys, F.col("s.value").alias("value"), F.lit(int(n == "expected")).alias("e")))
    counted = sides[0].unionByName(sides[1]).groupBy(*keys, "value").agg(F.sum("e").alias("expected"), F.sum(1 - F.col("e")).alias("actual"))
    return counted.where("actual < expected")


def verify_protected(pairs: DataFrame, keys: list[str], before: str = "before", after: str = "after", extra: list[str] | None = None, marker: str = MARKER) -> DataFrame:
    """By pair: protected spans before, values lost (distinct ones), and status; where the values are and what they mean does not count."""
    spans = with_protected(pairs.select(*keys, before), before, "__p", extra, marker).select(*keys, F.size("__p").alias("before_protected_span_count"))
    lost = lost_values(pairs, keys, before, after, extra, marker).groupBy(*keys).agg(F.count(F.lit(1)).alias("missing"))
    out = spans.join(lost, keys, "left").fillna(0, ["missing"])
    return out.withColumn("status", F.when(F.col("missing") == 0, "통과").otherwise("보류"))
