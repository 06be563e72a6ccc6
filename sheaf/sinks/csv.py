"""Delimited text sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.coerce import format_number, js_string
from sheaf.functions.text import escape_formula, quote_field
from sheaf.operators.reshape import project


@dataclass(frozen=True)
class FormatOptions:
    delimiter: str = ","
    quote: str = '"'
    escape: str | None = None
    line_ending: str = "\n"
    headers: bool | Sequence[str] = True
    columns: Sequence[str | tuple[str, str]] | None = None
    quote_columns: bool | dict[str, bool] = False
    quote_headers: bool = False
    decimal: str = "."
    escape_formulae: bool = False
    bom: bool = False
    trailing_newline: bool = False
    compression: str | None = None
    type_transform: dict[str, Callable[[Column], Column]] | None = None  # by Spark's type name, what makes text of it

    def __post_init__(self) -> None:
        if self.decimal == self.delimiter:
            raise ValueError("the decimal sign must differ from the delimiter")


def cell_text(df: DataFrame, name: str, o: FormatOptions) -> Column:
    """A column's values as text: times ISO 8601, whole doubles without fraction, nested values JSON, null empty."""
    col, kind = F.col(f"`{name}`"), df.schema[name].dataType
    special = (o.type_transform or {}).get(kind.typeName())
    if special is not None:
        return F.coalesce(special(col).cast("string"), F.lit(""))
    text = format_number(col, kind, o.decimal) if isinstance(kind, T.NumericType) else js_string(col, kind)
    text = F.coalesce(text, F.lit(""))
    return escape_formula(text) if o.escape_formulae and isinstance(kind, T.StringType) else text


def lines(df: DataFrame, o: FormatOptions) -> DataFrame:
    """One text column, a line for each row."""
    always = lambda n: o.quote_columns if isinstance(o.quote_columns, bool) else o.quote_columns.get(n, False)
    cells = [quote_field(cell_text(df, n, o), o.delimiter, o.quote, o.escape, always(n)) for n in df.columns]
    return df.select(F.concat_ws(o.delimiter, *cells).alias("value"))


def header_line(df: DataFrame, o: FormatOptions) -> str | None:
    if not o.headers:
        return None
    names = df.columns if o.headers is True else list(o.headers)
    sign = (o.delimiter, o.quote, "\n", "\r")
    show = lambda n: o.quote + n.replace(o.quote, (o.escape or o.quote) + o.quote) + o.quote if o.quote_headers or any(s in n for s in sign) else n
    return o.delimiter.join(map(show, names))


def to_text(df: DataFrame, **options: object) -> str:
    """All rows as one text, for small tables: the driver holds it."""
    o = FormatOptions(**options)
    df = project(df, o.columns) if o.columns else df
    head = header_line(df, o)
    body = [r["value"] for r in lines(df, o).toLocalIterator()]
    all_ = ([head] if head is not None else []) + body
    return ("﻿" if o.bom else "") + o.line_ending.join(all_) + (o.line_ending if o.trailing_newline and all_ else "")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", **options: object) -> None:
    """Files of delimited text, written in parallel, each with a header line unless rows are appended."""
    o = FormatOptions(**options)
    df = project(df, o.columns) if o.columns else df
    text = df.select(*(cell_text(df, n, o).alias(h) for n, h in zip(df.columns, df.columns if isinstance(o.headers, bool) else o.headers, strict=True)))
    writer = (
        text.write.mode(mode).option("header", bool(o.headers) and mode != "append").option("sep", o.delimiter).option("quote", o.quote).option("escape", o.escape or o.quote)
        .option("emptyValue", "").option("nullValue", "").option("lineSep", o.line_ending).option("quoteAll", o.quote_columns is True)
    )
    (writer.option("compression", o.compression) if o.compression else writer).csv(path)
