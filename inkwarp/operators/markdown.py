"""Markdown signatures and the scope of every line."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from inkwarp.functions.offsets import LINE, blank, find_all, mask_spans

PASS, HOLD = "통과", "보류"
KEYS = ("headings", "bold_markers", "emoji", "fences")

# What a signature is made of.
HEADING_LINE = "(?dmU)(^#{1,6}[ \\t]+[^\\n]+?[^\\S\\n]*$)"
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]"
FENCE_LINE = "(?dm)^[ \\t]*((?:```+|~~~+)[^\\n]*)$"


def signature(text: Column) -> Column:
    """Ordered headings, number of bold markers, ordered emoji and fences of a text, also inside code."""
    return F.struct(
        F.transform(F.regexp_extract_all(text, F.lit(HEADING_LINE), F.lit(1)), lambda h: F.struct(F.length(F.regexp_extract(h, "^(#+)", 1)).alias("level"), F.regexp_replace(F.regexp_replace(h, "^#+[ \\t]+", ""), "(?U)\\s+\\z", "").alias("title"))).alias("headings"),
        F.regexp_count(text, F.lit("\\*\\*")).alias("bold_markers"),
        F.regexp_extract_all(text, F.lit(f"({EMOJI})"), F.lit(1)).alias("emoji"),
        F.transform(F.regexp_extract_all(text, F.lit(FENCE_LINE), F.lit(1)), lambda f: F.struct(F.regexp_extract(f, "^(`+|~+)", 1).alias("mark"), F.regexp_replace(F.regexp_replace(f, "^(`+|~+)", ""), "(?U)^\\s+|\\s+\\z", "").alias("info"))).alias("fences"),
    )


def changed_keys(before: Column, after: Column) -> Column:
    """Keys of the signature in which two texts differ; a null text differs from any other."""
    a, b = signature(before), signature(after)
    return F.filter(F.array(*[F.when(~a[k].eqNullSafe(b[k]), F.lit(k)) for k in KEYS]), lambda k: k.isNotNull())


SCOPES = ("body", "glossary", "table", "heading", "footnote", "index")

# Patterns of the lines that tell a scope.
_FENCE = re.compile(r"(`{3,}|~{3,})")
_FENCE_END = re.compile(r"\s*(`{3,}|~{3,})\s*")
_UNDERLINE = re.compile(r"\s*(?:=+|-+)\s*")
_SEPARATOR = re.compile(r"\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*")
_PIPE = re.compile(r"(?<!\\)\|")
_NOTE = re.compile(r"\[\^[^\]]+\]:")
_TITLE = re.compile(r"#{1,6}[ \t]+")


def _marked(text: str) -> Iterator[tuple[str, str]]:
    """Each line with what it is by its own marks and by the fence or footnote that is open: code, heading, footnote or body."""
    fence, note = "", False
    for line in text.splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        note = note and (not line.strip() or line.startswith(("    ", "\t")))
        if fence:
            shut = _FENCE_END.fullmatch(bare)
            fence = "" if shut and shut[1].startswith(fence) else fence
            yield bare, "code"
        elif opened := _FENCE.match(line.lstrip()):
            fence = opened[1]
            yield bare, "code"
        elif _NOTE.match(line.lstrip()):
            note = True
            yield bare, "footnote"
        else:
            yield bare, "heading" if _TITLE.match(line.lstrip()) else "footnote" if note else "body"


def line_kinds(text: str) -> list[str]:
    """Kind of each line: code, heading, footnote, table or body. Lines end as :data:`LINE` says.

    One pass that sees the line below: a body line over an underline is a heading with it, and one with a bar over a separator line is in
    the table that goes on below as long as lines have bars.
    """
    out: list[str] = []
    underlined = in_table = False
    for (line, kind), (below, next_kind) in pairwise([*_marked(text), ("", "")]):
        plain, has_bar = kind == "body", bool(line.strip()) and bool(_PIPE.search(line))
        if plain and underlined:
            kind, underlined = "heading", False
        elif plain and line.strip() and next_kind == "body" and _UNDERLINE.fullmatch(below):
            kind, underlined = "heading", True
        else:
            underlined = False
        separator = kind != "code" and bool(_SEPARATOR.fullmatch(line))
        in_table = in_table and kind != "code" and has_bar
        over = has_bar and next_kind not in ("", "code") and bool(_SEPARATOR.fullmatch(below))
        if kind == "body" and (separator or in_table or over):
            kind = "table"
        in_table = in_table or separator
        out.append(kind)
    return out


def scope_lines(text: Column) -> Column:
    """ARRAY<STRING> of :func:`line_kinds`, in Arrow batches; null for null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else line_kinds(t))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, ArrayType(StringType()))(text)


def scope_view(text: Column, kinds: Column, scope: Column | str) -> Column:
    """The text with all lines outside a scope, and all comments, blanked; offsets and lines stay.

    The scopes glossary and index take every line but code. A comment or fence without end reaches to the text's end.
    """
    s = F.lit(scope) if isinstance(scope, str) else scope
    lines = F.regexp_extract_all(text, F.lit(f"({LINE})"), F.lit(1))
    shown = lambda k: F.when(s.isin("glossary", "index"), k != "code").otherwise(k == s)
    view = F.array_join(F.zip_with(lines, kinds, lambda x, k: F.when(F.coalesce(shown(k), F.lit(False)), x).otherwise(blank(x))), "")
    return mask_spans(view, find_all(text, "(?s)<!--.*?(?:-->|\\z)"))
