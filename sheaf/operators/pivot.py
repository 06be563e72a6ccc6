"""Cross tables, totals rows and field profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.coerce import js_number
from sheaf.operators.ordering import mixed_keys
from sheaf.operators.predicates import column_of

#: Metrics and how they are shown.
LABELS = {
    "sum": "Sum", "count": "Count", "average": "Average", "max": "Max", "min": "Min", "product": "Product",
    "countNums": "Count Numbers", "stdDev": "StdDev", "stdDevP": "StdDevp", "var": "Var", "varP": "Varp",
}
TOTALS = ("average", "countNums", "count", "max", "min", "stdDev", "var", "sum", "none")


def metric(df: DataFrame, column: str, name: str) -> Column:
    """A metric of a column: count is of values that aren't blank, all others see numbers only."""
    col, kind = column_of(df, column)
    if name == "count":
        return F.count(F.when(col != "", col) if isinstance(kind, T.StringType) else col)
    number = js_number(F.when(col != "", col) if isinstance(kind, T.StringType) else col, kind)
    known = {
        "sum": F.sum, "average": F.avg, "max": F.max, "min": F.min, "product": F.product, "countNums": F.count,
        "stdDev": F.stddev_samp, "stdDevP": F.stddev_pop, "var": F.var_samp, "varP": F.var_pop,
    }
    if name not in known:
        raise ValueError(f"unknown metric: {name}")
    return known[name](number)


@dataclass(frozen=True)
class Value:
    """A value field of a cross table."""

    column: str
    metric: str = "sum"
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or f"{LABELS[self.metric]} of {self.column}"


@dataclass(frozen=True)
class Pivot:
    """Fields of a cross table. pages keeps rows of one value of a field; column_values fixes the columns (else they are
    looked up, one job more)."""

    rows: Sequence[str]
    values: Sequence[Value]
    columns: Sequence[str] = ()
    pages: dict[str, object] = field(default_factory=dict)
    column_values: Sequence[object] | None = None
    totals: bool = False

    def check(self, names: Sequence[str]) -> None:
        axes = [*self.rows, *self.columns, *self.pages]
        if not self.rows or not self.values:
            raise ValueError("a cross table needs a row field and a value field")
        if len(set(axes)) < len(axes):
            raise ValueError("a field can be on one axis only")
        if len({v.name for v in self.values}) < len(self.values):
            raise ValueError("value fields need distinct names")
        missing = [n for n in [*axes, *(v.column for v in self.values)] if n not in names]
        if missing:
            raise ValueError(f"unknown fields: {missing}")


def pivot(df: DataFrame, spec: Pivot) -> DataFrame:
    """The cross table; with totals, rows of subtotals and the grand total have null in the fields they sum up, and
    __level, the number of those fields."""
    spec.check(df.columns)
    for name, value in spec.pages.items():
        df = df.where(F.col(f"`{name}`").eqNullSafe(F.lit(value)))
    measures = [metric(df, v.column, v.metric).alias(v.name) for v in spec.values]
    keys = [F.col(f"`{r}`") for r in spec.rows]
    if not spec.columns:
        if not spec.totals:
            return df.groupBy(*keys).agg(*measures)
        level = F.length(F.regexp_replace(F.bin(F.grouping_id()), "0", "")).alias("__level")
        return df.rollup(*keys).agg(level, *measures)
    across = spec.columns[0] if len(spec.columns) == 1 else "__across"
    if len(spec.columns) > 1:
        df = df.withColumn(across, F.concat_ws("|", *(F.col(f"`{c}`").cast("string") for c in spec.columns)))
    if not spec.totals:
        return df.groupBy(*keys).pivot(across, list(spec.column_values) if spec.column_values is not None else None).agg(*measures)
    values = list(spec.column_values) if spec.column_values is not None else [r[0] for r in df.select(across).distinct().orderBy(across).collect()]
    cells = [(str(value) if len(spec.values) == 1 else f"{value}_{v.name}", value, v) for value in values for v in spec.values]
    # one pass: every cell is a conditional aggregate, so that subtotals of any metric are right
    inner = df.withColumns({f"__c{i}": F.when(F.col(f"`{across}`").eqNullSafe(F.lit(value)), F.col(f"`{v.column}`")) for i, (_, value, v) in enumerate(cells)})
    aggregates = [metric(inner, f"__c{i}", v.metric).alias(name) for i, (name, _, v) in enumerate(cells)]
    totals = [metric(inner, v.column, v.metric).alias("total" if len(spec.values) == 1 else f"total_{v.name}") for v in spec.values]
    level = F.length(F.regexp_replace(F.bin(F.grouping_id()), "0", "")).alias("__level")
    return inner.rollup(*keys).agg(level, *aggregates, *totals)


def totals_row(df: DataFrame, functions: dict[str, str], label: str = "Total") -> DataFrame:
    """df and one row more: a total for each column that has a function, the label in the first column if that is text."""
    cells = []
    for i, name in enumerate(df.columns):
        kind = df.schema[name].dataType
        how = functions.get(name, "none")
        if how not in TOTALS:
            raise ValueError(f"unknown totals function: {how}")
        if how != "none":
            cells.append(metric(df, name, how).cast(kind if isinstance(kind, T.NumericType) and how not in ("average", "stdDev", "var") else "double" if isinstance(kind, T.NumericType) else kind).alias(name))
        else:
            cells.append(F.lit(label if i == 0 and isinstance(kind, T.StringType) else None).cast(kind).alias(name))
    total = df.agg(*cells) if any(functions.get(n, "none") != "none" for n in df.columns) else df.sparkSession.range(1).select(*cells)
    wide = df.select(*(F.col(f"`{n}`").cast("double").alias(n) if functions.get(n) in ("average", "stdDev", "var") and isinstance(df.schema[n].dataType, T.NumericType) else F.col(f"`{n}`") for n in df.columns))
    return wide.unionByName(total)


def shared_items(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column in mixed order, NaN as null, null last."""
    col, kind = column_of(df, column)
    clean = F.when(F.isnan(col), None).otherwise(col) if isinstance(kind, (T.FloatType, T.DoubleType)) else col
    items = df.select(clean.alias(column)).distinct()
    return items.orderBy(*mixed_keys(items, column)) if isinstance(kind, T.StringType) else items.orderBy(F.col(f"`{column}`").asc_nulls_last())


def field_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: min, max and whether all are integers, and flags of what the column contains."""
    col, kind = column_of(df, column)
    number = js_number(F.when(col != "", col) if isinstance(kind, T.StringType) else col, kind)
    text = isinstance(kind, T.StringType)
    blank = col.isNull() | (col == "") if text else col.isNull()
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    is_date = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
    string = ~blank & number.isNull() if text else F.lit(False)
    return df.agg(
        F.min(number).cast("double").alias("min_value"),
        F.max(number).cast("double").alias("max_value"),
        F.coalesce(F.bool_and(number == F.floor(number)), F.lit(False)).alias("all_integer"),
        flag(string).alias("contains_string"),
        flag(number.isNotNull() & F.lit(not is_date)).alias("contains_number"),
        flag(col.isNotNull() & F.lit(is_date)).alias("contains_date"),
        flag(blank).alias("contains_blank"),
        (flag(string) & flag(number.isNotNull())).alias("contains_mixed"),
        F.count_distinct(col).alias("distinct_values"),
    )


def encode_records(df: DataFrame, column: str) -> DataFrame:
    """df with <column>_index: the place of each value among the column's shared items, from 0. Items are numbered range by
    range, from the counts of the ranges before."""
    items = shared_items(df, column)
    kind = T.StructType([T.StructField("__item", items.schema[column].dataType), T.StructField(f"{column}_index", T.LongType(), False)])
    numbered = df.sparkSession.createDataFrame(items.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])), kind)
    return df.join(numbered, F.col(f"`{column}`").eqNullSafe(F.col("__item")), "left").drop("__item")
