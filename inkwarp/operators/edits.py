"""Size of an edit in three tiers: equal texts natively, short ones by characters, long ones by lines or by position.

Matching is Ratcliff and Obershelp's, which no built-in computes, so texts that differ go to Python in Arrow batches; equal ones never do.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARACTER_LIMIT = 100_000
LINE_LIMIT = 20_000
COLUMNS = "comparison_method string, changed_character_ratio double, changed_line_ratio double, line_measurement_method string, before_sentence_count int, after_sentence_count int, changed_sentence_slots int, sentence_measurement_method string"
_CUT = re.compile(r"(?<=[.!?])\s+|\n+")


def edit_sentences(text: str) -> list[str]:
    """Sentences as edits count them: cut after a terminator and white space, or at line feeds."""
    return [s for s in (x.strip() for x in _CUT.split(text)) if s]


def sentence_count(text: Column) -> Column:
    """Number of :func:`edit_sentences`, natively."""
    return F.size(F.filter(F.split(text, "(?U)(?<=[.!?])\\s+|\\n+", -1), lambda s: F.regexp_replace(s, "(?U)^\\s+|\\s+\\z", "") != ""))


def matched(a: list, b: list, junk: bool = True) -> tuple[int, int]:
    """(unchanged items, changed slots) of two sequences."""
    same = changed = 0
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=junk).get_opcodes():
        if tag == "equal":
            same += i2 - i1
        else:
            changed += max(i2 - i1, j2 - j1)
    return same, changed


def measure(before: str, after: str, characters: int = CHARACTER_LIMIT, lines: int = LINE_LIMIT) -> tuple:
    """The columns of :data:`COLUMNS` for two texts that differ."""
    short = max(len(before), len(after)) <= characters
    ratio = None
    if short:
        same, _ = matched(before, after, junk=False)
        ratio = round(1 - same / max(len(before), len(after), 1), 6)
    la, lb = before.splitlines(keepends=True), after.splitlines(keepends=True)
    most = max(len(la), len(lb), 1)
    if most <= lines:
        same, _ = matched(la, lb)
        line_ratio, how = round(1 - same / most, 6), "line-sequence"
    else:
        differ = sum(x != y for x, y in zip(la, lb, strict=False)) + abs(len(la) - len(lb))
        line_ratio, how = round(differ / most, 6), "positional-line-fallback"
    if not short:
        return "line-sequence", None, line_ratio, how, 0, 0, None, "not-run-large-input"
    sa, sb = edit_sentences(before), edit_sentences(after)
    return "character-sequence", ratio, line_ratio, how, len(sa), len(sb), matched(sa, sb)[1], "sentence-sequence"


def measure_edits(pairs: DataFrame, keys: list[str], before: str = "before", after: str = "after", characters: int = CHARACTER_LIMIT, lines: int = LINE_LIMIT) -> DataFrame:
    """``keys``, lengths, and the measured columns of every pair; a pair with a null side is left out.

    Texts longer than ``characters`` have a null character ratio; with more than ``lines`` lines, lines are compared by place.
    """
    b, a = F.col(before), F.col(after)
    sized = pairs.where(b.isNotNull() & a.isNotNull()).select(*keys, F.length(b).alias("before_characters"), F.length(a).alias("after_characters"), b.alias("__b"), a.alias("__a"))
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    equal = sized.where(F.col("__b") == F.col("__a")).select(
        *keys, "before_characters", "after_characters",
        F.lit("exact-equality").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(0.0).alias(names[2]), F.lit(None).cast("string").alias(names[3]),
        sentence_count(F.col("__b")).alias(names[4]), sentence_count(F.col("__a")).alias(names[5]), F.lit(0).alias(names[6]), F.lit("exact-equality").alias(names[7]),
    )
    kept = [*keys, "before_characters", "after_characters"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.select(*kept).schema.fields) + ", " + COLUMNS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            done = pd.DataFrame([measure(p, q, characters, lines) for p, q in zip(x["__b"], x["__a"], strict=True)], columns=names, index=x.index)
            done = done.astype({names[4]: "Int32", names[5]: "Int32", names[6]: "Int32", names[1]: "Float64"})
            yield pd.concat([x[kept], done], axis=1)

    return equal.unionByName(sized.where(F.col("__b") != F.col("__a")).mapInPandas(run, schema))
