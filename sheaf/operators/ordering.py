"""Sorting and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.coerce import js_number, js_string
from sheaf.functions.dates import parse_iso
from sheaf.operators.predicates import column_of
from sheaf.plans.query import Page, Sort

ROW = "__row"  # ordinal of the input's rows, where a caller needs a stable order


def with_row(df: DataFrame) -> DataFrame:
    """df with __row: increasing in the order of the input's partitions and rows. No shuffle, no single task."""
    return df if ROW in df.columns else df.withColumn(ROW, F.monotonically_increasing_id())


def sort_keys(df: DataFrame, sorts: Sequence[Sort], numeric: dict[str, bool] | None = None) -> list[Column]:
    """Keys for orderBy. Numbers and times sort as such, text by Unicode collation with null as an empty text; what can't be
    read by the comparator comes last. Under auto, a text column sorts as numbers if numeric says that all its values are."""
    keys = []
    for s in sorts:
        col, kind = column_of(df, s.column)
        how = s.comparator
        if how == "auto":
            text = isinstance(kind, T.StringType)
            how = "string" if text and not (numeric or {}).get(str(s.column)) else "date" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "number"
        if how == "number":
            key = js_number(col, kind, compat=isinstance(kind, T.StringType))
        elif how == "date":
            key = col if not isinstance(kind, T.StringType) else parse_iso(F.coalesce(col, F.lit("1970-01-01")))
        else:
            key = F.collate(F.coalesce(js_string(col, kind), F.lit("")), "UNICODE")
        keys.append(key.desc_nulls_last() if s.order == "desc" else key.asc_nulls_last())
    return keys


def numeric_columns(df: DataFrame, names: Sequence[str]) -> dict[str, bool]:
    """Which text columns hold only numbers: one aggregation over them all."""
    text = [n for n in names if isinstance(df.schema[n].dataType, T.StringType)]
    if not text:
        return {}
    row = df.agg(*(F.coalesce(F.bool_and(js_number(F.col(f"`{n}`"), T.StringType(), True).isNotNull()), F.lit(False)).alias(n) for n in text)).first()
    return {n: bool(row[n]) for n in text}


def sort(df: DataFrame, sorts: Sequence[Sort], stable: bool = True) -> DataFrame:
    """df in order; ties keep the input's order."""
    if not sorts:
        return df
    numeric = numeric_columns(df, [str(s.column) for s in sorts if s.comparator == "auto" and isinstance(s.column, str)])
    if not stable:
        return df.orderBy(*sort_keys(df, sorts, numeric))
    had = ROW in df.columns
    rows = with_row(df)
    out = rows.orderBy(*sort_keys(rows, sorts, numeric), F.col(ROW).asc())
    return out if had else out.drop(ROW)


def page(df: DataFrame, p: Page) -> DataFrame:
    """The page's rows; a size of 0 or less gives all rows. On a sorted df only the rows up to the page's end are kept by each task."""
    if p.size <= 0:
        return df
    first = (max(1, p.number) - 1) * p.size
    return df.limit(first + p.size).offset(first) if first else df.limit(p.size)


def page_stats(df: DataFrame, p: Page) -> DataFrame:
    """One row: page, page_size, total_rows, total_pages."""
    n = F.count(F.lit(1))
    size = F.lit(p.size) if p.size > 0 else n
    pages = F.when(n == 0, F.lit(0) if p.size > 0 else F.lit(1)).otherwise(F.ceil(n / size)) if p.size > 0 else F.lit(1)
    return df.agg(F.lit(max(1, p.number) if p.size > 0 else 1).cast("long").alias("page"), size.cast("long").alias("page_size"), n.alias("total_rows"), pages.cast("long").alias("total_pages"))


def mixed_keys(df: DataFrame, column: str) -> list[Column]:
    """A total order of a text column of mixed kinds: numbers, then dates, then other text, null last."""
    c = F.col(f"`{column}`")
    number = F.when(c != "", js_number(c, T.StringType()))
    time = F.when(number.isNull(), parse_iso(c))
    rank = F.when(c.isNull(), 3).when(number.isNotNull(), 0).when(time.isNotNull(), 1).otherwise(2)
    return [rank.asc(), number.asc(), time.asc(), F.collate(c, "UNICODE").asc()]
