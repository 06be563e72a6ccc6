"""Declared rules evaluated as columns: validations, conditional formats, auto-filters."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BINARY = {
    "equal": lambda c, a, b: c == a,
    "notEqual": lambda c, a, b: c != a,
    "greaterThan": lambda c, a, b: c > a,
    "lessThan": lambda c, a, b: c < a,
    "greaterThanOrEqual": lambda c, a, b: c >= a,
    "lessThanOrEqual": lambda c, a, b: c <= a,
    "between": lambda c, a, b: c.between(a, b),
    "notBetween": lambda c, a, b: ~c.between(a, b),
}


def validation(c: Column, kind: str, operator: str = "between", values: Sequence[object] = (), allow_blank: bool = True) -> Column:
    """Whether a cell satisfies a data validation of kind list, whole, decimal, date, textLength, custom or any."""
    if kind == "any":
        return F.lit(True)
    if kind == "list":
        ok = c.isin(*values)
    elif kind == "custom":
        ok = values[0](c)
    else:
        a, b = (list(values) + [None, None])[:2]
        measured = F.length(c) if kind == "textLength" else c
        ok = _BINARY[operator](measured, F.lit(a), F.lit(b))
        if kind == "whole":
            ok = ok & (c == F.floor(c))
    return F.coalesce(ok, F.lit(allow_blank))


def cell_is(c: Column, operator: str, *values: object) -> Column:
    a, b = (list(values) + [None, None])[:2]
    return F.coalesce(_BINARY[operator](c, F.lit(a), F.lit(b)), F.lit(False))


def contains_text(c: Column, kind: str, text: str = "") -> Column:
    """containsText, containsBlanks, notContainsBlanks, containsErrors or notContainsErrors."""
    from sheaf.functions.coerce import ERRORS

    s = F.coalesce(c.cast("string"), F.lit(""))
    tests = {
        "containsText": F.lower(s).contains(text.lower()),
        "containsBlanks": F.length(F.trim(s)) == 0,
        "notContainsBlanks": F.length(F.trim(s)) > 0,
        "containsErrors": s.isin(*ERRORS),
        "notContainsErrors": ~s.isin(*ERRORS),
    }
    return tests[kind]


def time_period(c: Column, period: str, as_of: Column) -> Column:
    """Whether a date lies in a period told from as_of; weeks start on Sunday."""
    day, now = c.cast("date"), as_of.cast("date")
    sunday = F.date_sub(now, F.dayofweek(now) - 1)
    month = F.trunc(now, "month")
    within = lambda a, b: (day >= a) & (day < b)
    tests = {
        "today": day == now,
        "yesterday": day == F.date_sub(now, 1),
        "tomorrow": day == F.date_add(now, 1),
        "last7Days": within(F.date_sub(now, 6), F.date_add(now, 1)),
        "thisWeek": within(sunday, F.date_add(sunday, 7)),
        "lastWeek": within(F.date_sub(sunday, 7), sunday),
        "nextWeek": within(F.date_add(sunday, 7), F.date_add(sunday, 14)),
        "thisMonth": within(month, F.add_months(month, 1)),
        "lastMonth": within(F.add_months(month, -1), month),
        "nextMonth": within(F.add_months(month, 1), F.add_months(month, 2)),
    }
    return F.coalesce(tests[period], F.lit(False))


FEW = 50_000  # values that one task may sort


def nth_value(values: DataFrame, n: int, total: int, few: int = FEW) -> object:
    """The n-th smallest (from 1) of the total numbers in column v; None if there are fewer."""
    below = 0  # values that are smaller than those still in question
    while total > few:
        share, error = (n - below) / total, 0.01
        low, high = (values.select(F.percentile_approx("v", F.lit(min(1.0, max(0.0, share + d))), F.lit(1000))).first()[0] for d in (-error, error))
        if low == high:
            left, same = values.agg(F.count(F.when(F.col("v") < low, 1)), F.count(F.when(F.col("v") == low, 1))).first()
            if left < n - below <= left + same:
                return low
        left, inside = values.agg(F.count(F.when(F.col("v") < low, 1)), F.count(F.when(F.col("v").between(low, high), 1))).first()
        if not left < n - below <= left + inside or inside >= total:
            break  # the quantiles were off: sort what is left
        values, below, total = values.where(F.col("v").between(low, high)), below + left, inside
    row = values.orderBy("v").limit(n - below).agg(F.max("v"), F.count("v")).first()
    return row[0] if row[1] == n - below else None


def top_n(df: DataFrame, column: str, n: int, percent: bool = False, bottom: bool = False, out: str = "in_top") -> DataFrame:
    """df with a flag: whether a row's value is among the n largest (or smallest) values, ties included.

    The threshold is found by one distributed top-n; a share's is found by narrowing down a range of values with
    approximate quantiles until few values are left to sort.
    """
    col = F.col(f"`{column}`")
    values = df.select(col.alias("v")).where(F.col("v").isNotNull())
    if percent:
        total = values.count()
        n = max(1, total * n // 100)
        edge = df.sparkSession.range(1).select(F.lit(nth_value(values, n if bottom else total - n + 1, total)).cast(df.schema[column].dataType).alias("__edge"))
    else:
        edge = values.orderBy(F.col("v").asc() if bottom else F.col("v").desc()).limit(n).agg((F.max if bottom else F.min)("v").alias("__edge"))
    joined = df.join(F.broadcast(edge))  # a single row
    flag = col <= F.col("__edge") if bottom else col >= F.col("__edge")
    return joined.withColumn(out, F.coalesce(flag, F.lit(False))).drop("__edge")


def above_average(df: DataFrame, column: str, below: bool = False, out: str = "above_average") -> DataFrame:
    """df with a flag: whether a row's value is above (or below) the mean."""
    col = F.col(f"`{column}`")
    joined = df.join(F.broadcast(df.agg(F.avg(col).alias("__mean"))))  # a single row
    flag = col < F.col("__mean") if below else col > F.col("__mean")
    return joined.withColumn(out, F.coalesce(flag, F.lit(False))).drop("__mean")


def threshold(df: DataFrame, column: str, kind: str, value: float | None = None) -> float | None:
    """The value that a scale's point stands for: min, max, num, percent (of the range) or percentile."""
    col = F.col(f"`{column}`")
    if kind == "num":
        return value
    want = {"min": F.min(col), "max": F.max(col), "percent": F.min(col) + (F.max(col) - F.min(col)) * (value or 0) / 100, "percentile": F.percentile(col, (value or 0) / 100)}[kind]
    return df.agg(want).first()[0]


def color_scale(df: DataFrame, column: str, points: Sequence[tuple[str, float | None]], out: str = "scale") -> DataFrame:
    """df with a position from 0 to len(points) - 1 along the scale, linear between its points."""
    at = [float(threshold(df, column, k, v)) for k, v in points]
    col = F.col(f"`{column}`")
    scaled = F.when(col <= at[0], F.lit(0.0))
    for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
        scaled = scaled.when(col <= b, i + (col - a) / (b - a if b > a else 1))
    return df.withColumn(out, F.when(col.isNotNull(), scaled.otherwise(float(len(at) - 1))))


def icon_set(df: DataFrame, column: str, points: Sequence[tuple[str, float | None]], out: str = "icon") -> DataFrame:
    """df with the number of the last point that the value reaches."""
    col = F.col(f"`{column}`")
    at = [threshold(df, column, k, v) for k, v in points]
    steps = sum(((col >= F.lit(a)).cast("int") for a in at[1:]), F.lit(0))
    return df.withColumn(out, F.when(col.isNotNull(), steps))


def custom_filter(c: Column, tests: Sequence[tuple[str, object]], all_of: bool = False) -> Column:
    """Auto-filter comparisons; * and ? in texts are wildcards for equal and notEqual."""

    def one(op: str, value: object) -> Column:
        if isinstance(value, str) and op in ("equal", "notEqual") and re.search(r"[*?]", value):
            pattern = "(?is)^" + "".join({"*": ".*", "?": "."}.get(x) or re.escape(x) for x in value) + "$"
            hit = F.coalesce(c.rlike(pattern), F.lit(False))
            return hit if op == "equal" else ~hit
        return cell_is(c, op, value)

    out = F.lit(all_of)
    for op, value in tests:
        out = out & one(op, value) if all_of else out | one(op, value)
    return out


def value_filter(c: Column, values: Sequence[object]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def rank_within(df: DataFrame, partition: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Extension: rank of each row within its partition."""
    return df.withColumn(out, F.rank().over(Window.partitionBy(*partition).orderBy(*order)))
