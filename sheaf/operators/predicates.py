"""Conditions, filters and text search as columns."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.coerce import js_number, js_string, literal_fits
from sheaf.plans.query import Condition, Filter, Search

_COMPARE = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def column_of(df: DataFrame, column: str | int) -> tuple[Column, T.DataType]:
    field = df.schema[column]
    return df[f"`{field.name}`"], field.dataType


def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


_DECIMAL = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_RADIX = re.compile(r"0(?:[xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)")


def literal_number(value: object) -> float | None:
    """A literal as a loosely typed host reads numbers: null and blank texts are 0, hexadecimal, octal and binary forms
    count, underscores don't; None if it is no number, NaN included."""
    if value is None:
        return 0.0
    if isinstance(value, (bool, int, float)):
        return None if value != value else float(value)
    if not isinstance(value, str):
        return None
    text = value.strip()
    if not text:
        return 0.0
    if text in ("Infinity", "+Infinity", "-Infinity"):
        return float(text)
    if _RADIX.fullmatch(text):
        return float(int(text, 0))
    return float(text) if _DECIMAL.fullmatch(text) else None


def condition(df: DataFrame, c: Condition, compat: bool = False) -> Column:
    """The condition as a boolean column; null counts as false, and bare comparisons reach the scan.

    Equality doesn't coerce types. Comparisons are numeric. Text tests see numbers as text. With compat, null counts as
    0 in comparisons and as the text 'null' in text tests, and not equal to anything but null.
    """
    col, kind = column_of(df, c.column)
    op, value = c.operator, c.value
    fold = c.ignore_case and isinstance(kind, T.StringType)
    lowered = lambda v: v.lower() if fold and isinstance(v, str) else v
    own = F.lower(col) if fold else col
    if op in ("eq", "neq"):
        if value is None:
            same = col.isNull()
        elif not literal_fits(kind, value) or value != value:
            same = F.lit(False)
        else:
            same = own == F.lit(lowered(value))
        return same if op == "eq" else ~_false_if_null(same)
    if op in ("in", "notIn"):
        if not isinstance(value, (list, tuple, set)):
            return F.lit(op == "notIn")
        fit = [lowered(v) for v in value if v is not None and literal_fits(kind, v)]
        found = own.isin(*fit) if fit else F.lit(False)
        found = found | col.isNull() if None in value else found
        return found if op == "in" else ~_false_if_null(found)
    if op in _COMPARE:
        bound = literal_number(value)
        if bound is None:
            return F.lit(False)
        if isinstance(value, int) and not isinstance(value, bool) and isinstance(kind, T.IntegralType):
            bound = value  # a bare comparison reaches the scan
        test = _COMPARE[op](js_number(col, kind, compat), F.lit(bound))
        # Spark takes NaN for the largest number; here it compares with nothing
        return test & ~F.isnan(col) if isinstance(kind, (T.FloatType, T.DoubleType)) and op in ("gt", "gte") else test
    if op in ("contains", "startsWith", "endsWith", "regex"):
        text = js_string(col, kind, compat)
        text = F.lower(text) if fold and op != "regex" else text
        wanted = lowered("null" if value is None else str(value))
        if op == "regex":
            return text.rlike(("(?i)" if c.ignore_case else "") + java_regex(str(value)))
        test = {"contains": text.contains, "startsWith": text.startswith, "endsWith": text.endswith}[op]
        return test(wanted)
    if op in ("isNull", "notNull"):
        empty = col.isNull() | (col == "") if isinstance(kind, T.StringType) else col.isNull()
        empty = _false_if_null(empty)
        return empty if op == "isNull" else ~empty
    return F.lit(True)


def java_regex(pattern: str) -> str:
    """A JavaScript pattern in Java's dialect; forms that differ and can't be written are refused."""
    if re.search(r"\\u\{|\\p\{Script=", pattern):
        raise ValueError(f"unsupported pattern: {pattern}")
    out = pattern.replace(r"\/", "/").replace("[^]", r"[\s\S]")
    # at the end, Java's dollar sign also stands before a last line end
    return out[:-1] + r"\z" if re.search(r"(?<!\\)(?:\\\\)*\$$", out) else out


def filter_column(df: DataFrame, f: Filter, compat: bool = False) -> Column:
    """All conditions, or any; none at all keep every row under and, no row under or."""
    tests = [condition(df, c, compat) for c in f.conditions]
    if f.logic == "or":
        return functools.reduce(operator.or_, tests, F.lit(False))
    return functools.reduce(operator.and_, tests, F.lit(True))


def search_column(df: DataFrame, s: Search) -> Column:
    """Whether some column, as text, contains what is searched; null is an empty text."""
    wanted = s.text.lower() if s.ignore_case else s.text
    if not wanted:
        return F.lit(True)

    def has(name: str) -> Column:
        col, kind = column_of(df, name)
        text = F.coalesce(js_string(col, kind), F.lit(""))
        return (F.lower(text) if s.ignore_case else text).contains(wanted)

    return functools.reduce(operator.or_, (has(n) for n in (s.columns or df.columns)), F.lit(False))


def where(df: DataFrame, f: Filter, compat: bool = False) -> DataFrame:
    return df.where(filter_column(df, f, compat))


def search(df: DataFrame, s: Search) -> DataFrame:
    return df.where(search_column(df, s))
