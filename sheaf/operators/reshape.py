"""Reshaping between sheets, records, arrays and maps, and edits by row position."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.address import to_letters
from sheaf.operators.ordering import ROW


def sheet_headers(names: Sequence[str | None]) -> list[str]:
    """Distinct names of a sheet's header row: repeats get _1, _2, blanks __EMPTY, __EMPTY_1."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        base = str(n) if n not in (None, "") else "__EMPTY"
        name, k = base, seen.get(base, 0)
        while name in out:
            k += 1
            name = f"{base}_{k}"
        seen[base] = k
        out.append(name)
    return out


def _values(df: DataFrame, row: str) -> list[str]:
    return [c for c in df.columns if c != row]


def records(df: DataFrame, header: str | int | Sequence[str] | None = None, blank_rows: bool = False, default: str | None = None, row: str = ROW) -> DataFrame:
    """A sheet (text columns and a row ordinal) as records.

    header None: names are the first row's; "A": column letters; a list: these names; 1: one array column. Blank rows
    are dropped unless blank_rows; default stands for blank cells.
    """
    names = _values(df, row)
    first = df.where(F.col(row) == 1)
    if header is None:
        top = first.select(*names).first()
        titles, rows = sheet_headers(list(top) if top else names), df.where(F.col(row) > 1)
    elif header == "A":
        titles, rows = [to_letters(i + 1) for i in range(len(names))], df
    elif header == 1:
        titles, rows = names, df
    else:
        titles, rows = list(header), df
    if not blank_rows:
        rows = rows.where(has_values(names))
    cells = [F.coalesce(F.col(f"`{n}`"), F.lit(default)) if default is not None else F.col(f"`{n}`") for n in names]
    if header == 1:
        return rows.select(row, F.array(*cells).alias("values"))
    return rows.select(row, *(c.alias(t) for c, t in zip(cells, titles, strict=False)))


def has_values(names: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | (F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) != "")
    return out


def rename(df: DataFrame, names: Sequence[str | None]) -> DataFrame:
    """df under new names; columns named None go."""
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True) if n is not None))


def project(df: DataFrame, columns: Sequence[str | tuple[str, str]]) -> DataFrame:
    """Columns by key, or by (key, header)."""
    return df.select(*(F.col(f"`{c}`") if isinstance(c, str) else F.col(f"`{c[0]}`").alias(c[1]) for c in columns))


def append(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, over the union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def to_array(df: DataFrame, columns: Sequence[str] | None = None, out: str = "values") -> DataFrame:
    return df.select(F.array(*(F.col(f"`{c}`").cast("string") for c in (columns or df.columns))).alias(out))


def to_pairs(df: DataFrame, out: str = "pairs") -> DataFrame:
    """Rows as ordered (key, value) pairs of text."""
    return df.select(F.array(*(F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns)).alias(out))


def pairs_to_map(pairs: Column) -> Column:
    """Pairs as a map; of repeated keys the last holds."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))


def pair_keys(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["key"])


def pair_values(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["value"])


def group_columns(df: DataFrame, originals: dict[str, str]) -> DataFrame:
    """Columns that had one name before renaming, as one array column; others stay."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(originals.get(c, c), []).append(c)
    return df.select(*(F.col(f"`{cs[0]}`").alias(n) if len(cs) == 1 else F.array(*(F.col(f"`{c}`") for c in cs)).alias(n) for n, cs in groups.items()))


def last_by_key(df: DataFrame, key: str, row: str = ROW) -> DataFrame:
    """One row for each key, the last by row order."""
    rest = [c for c in df.columns if c not in (key, row)]
    return df.groupBy(f"`{key}`").agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.col(row)).alias("__last")).select(key, "__last.*")


def splice_rows(df: DataFrame, start: int, count: int, inserts: DataFrame | None = None, row: str = ROW) -> DataFrame:
    """df, numbered from 1 by row, without count rows from start on, and with inserts (numbered from 1) in their place.
    Rows further on are renumbered by arithmetic; nothing is sorted."""
    added = inserts.count() if inserts is not None else 0
    kept = df.where((F.col(row) < start) | (F.col(row) >= start + count))
    out = kept.withColumn(row, F.when(F.col(row) >= start + count, F.col(row) - count + added).otherwise(F.col(row)))
    return out.unionByName(inserts.withColumn(row, F.col(row) + start - 1), allowMissingColumns=True) if inserts is not None else out


def duplicate_row(df: DataFrame, number: int, times: int, row: str = ROW) -> DataFrame:
    """df with times copies of one row after it."""
    copies = F.when(F.col(row) == number, F.sequence(F.lit(0), F.lit(times))).otherwise(F.array(F.lit(0)))
    out = df.withColumn("__copy", F.explode(copies))
    return out.withColumn(row, F.when(F.col(row) > number, F.col(row) + times).otherwise(F.col(row) + F.col("__copy"))).drop("__copy")


def splice_columns(df: DataFrame, start: int, count: int, inserts: dict[str, Column] | None = None) -> DataFrame:
    """df without count columns from the start-th on, and with inserts in their place."""
    names = df.columns
    new = [c.alias(n) for n, c in (inserts or {}).items()]
    return df.select(*(F.col(f"`{c}`") for c in names[: start - 1]), *new, *(F.col(f"`{c}`") for c in names[start - 1 + count :]))


def add_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    return append(table, rows)


def remove_rows(table: DataFrame, start: int, count: int = 1, row: str = ROW) -> DataFrame:
    return splice_rows(table, start, count, row=row)


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], field: str = "field", value: str = "value") -> DataFrame:
    """Columns as rows: the inverse of a cross table."""
    return df.unpivot(list(ids), list(columns), field, value)


def row_text(df: DataFrame, separator: str = ",", out: str = "line") -> DataFrame:
    return df.select(F.concat_ws(separator, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns)).alias(out))


def extents(cells: DataFrame) -> DataFrame:
    """Of (row, col) cells: row_count and column_count (largest numbers), and how many rows and columns have cells."""
    return cells.agg(
        F.coalesce(F.max("row"), F.lit(0)).alias("row_count"), F.coalesce(F.max("col"), F.lit(0)).alias("column_count"),
        F.count_distinct("row").alias("actual_row_count"), F.count_distinct("col").alias("actual_column_count"),
    )


def fill_formula(df: DataFrame, column: str, translate: Callable[[Column], Column], row: str = ROW) -> DataFrame:
    """df with a column of formula texts made from each row's number."""
    return df.withColumn(column, translate(F.col(row)))


class Workbook:
    """Sheets by name: temporary views of one catalog."""

    def __init__(self, spark, prefix: str = "sheet_") -> None:  # noqa: ANN001
        self.spark, self.prefix, self.names = spark, prefix, []

    def add(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(self.prefix + name)
        if name not in self.names:
            self.names.append(name)
        return df

    def get(self, name: str) -> DataFrame:
        return self.spark.table(f"`{self.prefix}{name}`")

    def remove(self, name: str) -> None:
        self.spark.catalog.dropTempView(self.prefix + name)
        self.names.remove(name)

    def each(self) -> list[tuple[str, DataFrame]]:
        return [(n, self.get(n)) for n in self.names]
