"""Groups and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.coerce import js_number, js_string
from sheaf.operators.ordering import ROW, with_row
from sheaf.operators.predicates import column_of
from sheaf.plans.query import Aggregate, GroupBy


def aggregate_column(df: DataFrame, a: Aggregate, compat: bool = False, row: str = ROW) -> Column:
    """One aggregate.

    count is of rows, nulls included; first and last go by row order and keep nulls; sum, avg, min and max see numbers only,
    and avg of none is 0.
    """
    col, kind = column_of(df, a.column)
    if a.function == "count":
        out = F.count(F.lit(1))
    elif a.function == "first":
        out = F.min_by(F.struct(col), F.col(row))[_name(df, a.column)]
    elif a.function == "last":
        out = F.max_by(F.struct(col), F.col(row))[_name(df, a.column)]
    else:
        number = js_number(col, kind, compat)
        number = number if isinstance(kind, T.NumericType) and not compat else F.when(~F.isnan(number), number)
        if a.function == "avg":
            out = F.coalesce(F.avg(number), F.lit(0.0))
        elif a.function in ("sum", "min", "max"):
            out = getattr(F, a.function)(number)
        else:
            raise ValueError(f"unknown aggregate: {a.function}")
    return out.alias(a.name)


def _name(df: DataFrame, column: str | int) -> str:
    return df.schema[column].name


def _ordered(df: DataFrame, aggregates: Sequence[Aggregate]) -> DataFrame:
    return with_row(df) if any(a.function in ("first", "last") for a in aggregates) else df


def global_aggregate(df: DataFrame, aggregates: Sequence[Aggregate], compat: bool = False) -> DataFrame:
    """One row, over an empty input too."""
    df = _ordered(df, aggregates)
    return df.agg(*(aggregate_column(df, a, compat) for a in aggregates if a.name != "__proto__"))


def group_by(df: DataFrame, g: GroupBy, compat: bool = False) -> DataFrame:
    """A row for each group. With compat, null, empty text and equal texts of other types are one key, the values shown are
    those of the group's first row, and groups come in order of first appearance."""
    aggregates = [a for a in g.aggregates if a.name != "__proto__"]
    if not compat:
        df = _ordered(df, aggregates)
        return df.groupBy(*(F.col(f"`{c}`") for c in g.columns)).agg(*(aggregate_column(df, a) for a in aggregates)) if aggregates else df.select(*g.columns).distinct()
    df = with_row(df)
    keys = {f"__k{i}": F.coalesce(js_string(*column_of(df, c)), F.lit("")) for i, c in enumerate(g.columns)}
    shown = F.min_by(F.struct(*(F.col(f"`{c}`") for c in g.columns)), F.col(ROW)).alias("__first")
    out = df.withColumns(keys).groupBy(*keys).agg(shown, F.min(ROW).alias(ROW), *(aggregate_column(df, a, True) for a in aggregates))
    return out.orderBy(ROW).select("__first.*", *(F.col(f"`{a.name}`") for a in aggregates))
