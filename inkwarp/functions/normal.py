"""Unicode normal forms as Arrow-batched column functions (Spark has none built in).

Each function normalises the distinct values of a batch once; nulls stay null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def rule_form(value: str) -> str:
    """NFKC, upper case, no white space, every dash or underscore as hyphen-minus."""
    tight = "".join(unicodedata.normalize("NFKC", value).upper().split())
    return "".join("-" if c in "_−" or unicodedata.category(c) == "Pd" else c for c in tight)


def word_form(value: str) -> str:
    """NFKC, lower case, trimmed, each run of white space one space."""
    return " ".join(unicodedata.normalize("NFKC", value).lower().split())


def _by_distinct(fn: Callable[[str], str], s: pd.Series) -> pd.Series:
    return s.map({v: fn(v) for v in s.dropna().unique()})


@F.pandas_udf(StringType())
def _rule_form(s: pd.Series) -> pd.Series:
    return _by_distinct(rule_form, s)


@F.pandas_udf(StringType())
def _word_form(s: pd.Series) -> pd.Series:
    return _by_distinct(word_form, s)


def rule_key(col: Column) -> Column:
    """Column form of :func:`rule_form`."""
    return _rule_form(col)


def word_key(col: Column) -> Column:
    """Column form of :func:`word_form`."""
    return _word_form(col)


def nfkc_sql(x: str) -> str:
    """DuckDB form of NFKC for the forms that the tables hold: full width, decomposed."""
    wide, plain = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)), "".join(chr(c) for c in range(0x21, 0x7F))
    return "nfc_normalize(translate({}, '{}', '{}'))".format(x, wide, plain.replace("'", "''"))


def rule_sql(x: str) -> str:
    """DuckDB form of :func:`rule_form`."""
    return f"regexp_replace(regexp_replace(upper({nfkc_sql(x)}), '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', '', 'g'), '[_\\x{{2010}}-\\x{{2015}}\\x{{2212}}]', '-', 'g')"
