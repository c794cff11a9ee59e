"""Column functions on text with exact code-point offsets. Starts are 0-based, ends exclusive, lines and columns 1-based.

All are built-in expressions. A null text gives null. Patterns are Java's; their own groups must not capture, and they must
not match the empty string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 128
#: A line with what ends it: a line feed, a carriage return or both, a form feed, a separator or one of Unicode's line ends.
LINE = "[^\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]*(?:\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029])|[^\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]+"
SPANS = "array<struct<start:int,end:int,value:string>>"


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once a row.

    A projection would be merged with the next one, and an expression used inside a lambda would then run once for each element; a
    generator of one row keeps them apart, in the same stage.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def empty_spans() -> Column:
    return F.array().cast(SPANS)


def literal(text: str) -> str:
    """A pattern that matches ``text`` itself."""
    return "".join("\\" + c if c in "\\^$.|?*+()[]{}-&#~<>=!:" else c for c in text)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sql_string(value: str) -> str:
    """A literal for SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def apply(value: Column, body: str) -> Column:
    """``body``, SQL text about ``t``, with ``value`` for ``t``.

    A large expression is parsed as a whole, where building it from columns takes a call to the JVM for each of its parts.
    """
    return F.get(F.call_function("transform", F.array(value), F.expr(f"t -> {body}")), F.lit(0))


def _walk(pattern: str, gaps: bool) -> str:
    """SQL text for the spans of the matches in ``t``, or of what lies between them (see :func:`_fold`)."""
    return _fold(f"zip_with(split(t, {sql_string(pattern)}, -1), regexp_extract_all(t, {sql_string(f'({pattern})')}, 1), (g, h) -> named_struct('gap', g, 'hit', h))", gaps)


def _fold(parts: str, gaps: bool) -> str:
    """SQL text for the spans of the hits, or of the gaps, of ``parts`` (gap and hit in turn), by a fold over the lengths of both.

    Appending to an array copies it, so the fold runs over blocks and then over their results, which keeps a text of many matches
    close to linear.
    """
    zero = f"named_struct('at', 0, 'out', cast(array() as {SPANS}))"
    begin, end = "a.at + length(x.gap)", "a.at + length(x.gap) + coalesce(length(x.hit), 0)"
    if gaps:
        out = f"concat(a.out, array(named_struct('start', a.at, 'end', {begin}, 'value', x.gap)))"
    else:
        out = f"if(x.hit is null, a.out, concat(a.out, array(named_struct('start', {begin}, 'end', {end}, 'value', x.hit))))"
    step = f"named_struct('at', {end}, 'out', cast({out} as {SPANS}))"
    moved = "transform(b.out, s -> named_struct('start', s.start + a.at, 'end', s.`end` + a.at, 'value', s.value))"
    block = f"transform(sequence(0, cast(floor((size(ps) - 1) / {_BLOCK}) as int)), i -> aggregate(slice(ps, i * {_BLOCK} + 1, {_BLOCK}), {zero}, (a, x) -> {step}))"
    return f"transform(array({parts}), ps -> aggregate({block}, {zero}, (a, b) -> named_struct('at', a.at + b.at, 'out', cast(concat(a.out, {moved}) as {SPANS})), a -> a.out))[0]"


def found_sql(pattern: str) -> str:
    """SQL text for :func:`find_all` in ``t``."""
    return f"case when t rlike {sql_string(pattern)} then {_walk(pattern, gaps=False)} when t is not null then cast(array() as {SPANS}) end"


def find_all(text: Column, pattern: str) -> Column:
    """Every non-overlapping match: ARRAY<STRUCT<start, end, value>>. A text without a match costs one search."""
    return apply(text, found_sql(pattern))


def find_literal(text: Column, value: str) -> Column:
    """Every non-overlapping occurrence of a literal; none for an empty one."""
    return find_all(text, literal(value)) if value else F.when(text.isNotNull(), empty_spans())


def find_value(text: Column, value: Column) -> Column:
    """Every non-overlapping occurrence of a literal that is a column; none for an empty or null one."""
    pieces = "split(t.text, concat('\\\\Q', replace(t.value, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E'), -1)"
    parts = f"transform(array({pieces}), ps -> transform(ps, (g, i) -> named_struct('gap', g, 'hit', if(i + 1 < size(ps), t.value, null))))[0]"
    return apply(F.struct(text.alias("text"), value.alias("value")), f"case when t.value <> '' and contains(t.text, t.value) then {_fold(parts, gaps=False)} when t.text is not null then cast(array() as {SPANS}) end")


def split_spans(text: Column, pattern: str) -> Column:
    """The stretches between matches, also empty ones."""
    return apply(text, _walk(pattern, gaps=True))


def count_literal(text: Column, value: Column | str) -> Column:
    """Non-overlapping occurrences of a literal; 0 for an empty one."""
    v = F.lit(value) if isinstance(value, str) else value
    return F.when(F.length(v) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, v, F.lit("")))) / F.greatest(F.length(v), F.lit(1))).cast("int"))


def blank(text: Column) -> Column:
    """Spaces of the same length; line feeds stay."""
    return F.regexp_replace(text, "[^\\n]", " ")


def mask(text: Column, pattern: str) -> Column:
    """The text with every match blanked, all offsets and lines as before."""
    hits = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), blank)
    return F.array_join(F.zip_with(F.split(text, pattern, -1), hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")


def mask_spans(text: Column, spans: Column) -> Column:
    """The text with the given spans blanked, in any order, overlapping or not.

    The spans are sorted by their starts; each blanks what it adds to those before it, and the pieces are joined once.
    """
    sorted_ = "array_sort(transform(filter(t.spans, s -> s.start is not null and s.`end` > s.start), s -> named_struct('start', s.start, 'end', s.`end`)))"
    # how far the spans before each reach, in blocks, as an appended array is copied
    reach = f"""transform(array({sorted_}), ps -> aggregate(transform(sequence(0, cast(floor((size(ps) - 1) / {_BLOCK}) as int)), i -> aggregate(slice(ps, i * {_BLOCK} + 1, {_BLOCK}),
      named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,prior:int>>)), (a, x) -> named_struct('at', greatest(a.at, x.`end`), 'out', cast(concat(a.out, array(named_struct('start', x.start, 'end', x.`end`, 'prior', a.at))) as array<struct<start:int,end:int,prior:int>>)))),
      named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,prior:int>>)), (a, b) -> named_struct('at', greatest(a.at, b.at), 'out', cast(concat(a.out, transform(b.out, s -> named_struct('start', s.start, 'end', s.`end`, 'prior', greatest(s.prior, a.at)))) as array<struct<start:int,end:int,prior:int>>)), a -> a.out))[0]"""
    piece = "concat(substring(t.text, s.prior + 1, greatest(s.start - s.prior, 0)), regexp_replace(substring(t.text, greatest(s.start, s.prior) + 1, greatest(s.`end` - greatest(s.start, s.prior), 0)), '[^\\\\n]', ' '))"
    rest = "substring(t.text, coalesce(array_max(transform(filter(t.spans, s -> s.`end` > s.start), s -> s.`end`)), 0) + 1, length(t.text))"
    both = F.struct(text.alias("text"), spans.alias("spans"))
    return F.when(F.size(spans) > 0, apply(both, f"concat(array_join(transform({reach}, s -> {piece}), ''), {rest})")).otherwise(text)


def line_of(text: Column, at: Column) -> Column:
    prefix = F.substring(text, F.lit(1), at)
    return F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, at: Column) -> Column:
    return F.length(F.substring_index(F.substring(text, F.lit(1), at), "\n", -1)) + 1


def squeeze(text: Column) -> Column:
    """Each run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)[\\s\\x1c-\\x1f]+", " "))


def context(text: Column, start: Column, end: Column, radius: int = 24) -> Column:
    """The squeezed surroundings of a span, ``radius`` characters on each side."""
    low = F.greatest(start - radius, F.lit(0))
    return squeeze(F.substring(text, low + 1, end + radius - low))


def nth_on_line(text: Column, value: Column, line: Column, occurrence: Column) -> Column:
    """Span of the nth occurrence of a literal on a line, or null: STRUCT<start, end>.

    ``value`` may be a column; lines end as :data:`LINE` says; line and occurrence count from 1.
    """
    lines = F.regexp_extract_all(text, F.lit(f"({LINE})"), F.lit(1))
    this = F.get(lines, line - 1)
    before = F.aggregate(F.slice(lines, F.lit(1), F.greatest(line - 1, F.lit(0))), F.lit(0), lambda n, x: n + F.length(x))
    pieces = F.split(this, F.concat(F.lit("\\Q"), value, F.lit("\\E")), -1)
    ahead = F.aggregate(F.slice(pieces, F.lit(1), F.greatest(occurrence, F.lit(0))), F.lit(0), lambda n, x: n + F.length(x)) + F.length(value) * (occurrence - 1)
    start = before + ahead
    good = (line >= 1) & (line <= F.size(lines)) & (occurrence >= 1) & (F.size(pieces) > occurrence) & (F.length(value) > 0)
    return F.when(good, F.struct(start.alias("start"), (start + F.length(value)).alias("end")))


def anchors_in_order(text: Column, anchors: Column) -> Column:
    """Start of each anchor, each searched after the end of the one before; null if one is not found."""
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"), F.lit(True).alias("ok"))

    def step(acc: Column, a: Column) -> Column:
        pos = F.call_function("locate", a, text, acc["at"])
        ok = acc["ok"] & (pos > 0)
        return F.struct(F.when(ok, pos + F.length(a)).otherwise(acc["at"]).cast("int").alias("at"), F.when(ok, F.concat(acc["out"], F.array((pos - 1).cast("int")))).otherwise(acc["out"]).cast("array<int>").alias("out"), ok.alias("ok"))

    return F.aggregate(anchors, zero, step, lambda acc: F.when(acc["ok"], acc["out"]))


def valid_pattern(pattern: str) -> bool:
    """Whether the driver's own regular expressions accept it (a check before Spark compiles it)."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True
