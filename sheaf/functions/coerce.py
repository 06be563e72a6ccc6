"""Coercion of values to numbers, text and types, as the query layer defines it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = r"[\s\p{Z}\x{FEFF}]"
DECIMAL = r"^[+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"
#: What dynamic typing takes for a number: no plus sign, no blanks.
TYPED_NUMBER = r"^-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
LEADING_ZERO = r"^-?0[0-9]"


def trim_blanks(c: Column, left: bool = True, right: bool = True) -> Column:
    """c without Unicode white space at its ends."""
    if left:
        c = F.regexp_replace(c, rf"^{BLANKS}+", "")
    return F.regexp_replace(c, rf"{BLANKS}+$", "") if right else c


def js_number(c: Column, kind: T.DataType, compat: bool = False) -> Column:
    """c as a double; what is no number is null.

    Text: blank is 0, white space around doesn't count, 0x, 0o and 0b prefixes are read. Booleans are 1 and 0, times
    milliseconds since the epoch. With compat, null is 0 as well; numeric columns are passed through untouched, so
    that filters on them reach the scan.
    """
    if isinstance(kind, T.NumericType):
        out = c.cast("double") if compat else c
    elif isinstance(kind, T.BooleanType):
        out = c.cast("int").cast("double")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        out = F.unix_millis(c.cast("timestamp")).cast("double")
    elif isinstance(kind, T.StringType):
        s = trim_blanks(c)
        digits = F.substring(s, 3, 1 << 30)
        read = lambda base: F.conv(digits, base, 10).cast("double")
        out = (
            F.when(c.isNull(), F.lit(None))
            .when(s == "", F.lit(0.0))
            .when(s.rlike("^0[xX][0-9a-fA-F]+$"), read(16))
            .when(s.rlike("^0[oO][0-7]+$"), read(8))
            .when(s.rlike("^0[bB][01]+$"), read(2))
            .when(s.rlike(DECIMAL), s.try_cast("double"))
        )
    else:
        out = F.lit(None).cast("double")
    return F.when(c.isNull(), F.lit(0.0)).otherwise(out) if compat else out


def js_string(c: Column, kind: T.DataType, compat: bool = False) -> Column:
    """c as text: whole doubles without a fraction, times as ISO 8601 in UTC; with compat, null is the text 'null'."""
    if isinstance(kind, T.StringType):
        out = c
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (F.floor(c) == c) & (F.abs(c) < 1e15)
        out = F.when(F.isnan(c), F.lit("NaN")).when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        out = F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        out = F.to_json(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit("null")) if compat else out


def _keyword(c: Column, word: str) -> Column:
    return F.lower(c) == word


def is_typed_number(c: Column) -> Column:
    return c.isin("Infinity", "-Infinity", "NaN") | (c.rlike(TYPED_NUMBER) & ~c.rlike(LEADING_ZERO))


def convert_value(c: Column, to: str) -> Column:
    """Text under dynamic typing, as the wanted type ("boolean", "number" or "text"); null if it isn't of it.

    true, false and null count in any case; numbers with a leading zero, a plus sign or blanks stay text, and so does
    the empty text.
    """
    if to == "boolean":
        return F.when(_keyword(c, "true"), True).when(_keyword(c, "false"), False)
    if to == "number":
        return F.when(is_typed_number(c), c.try_cast("double"))
    return F.when(~_keyword(c, "null"), c)


def value_kind(c: Column) -> Column:
    """What dynamic typing makes of a text: boolean, null, number or text."""
    return F.when(c.isNull() | _keyword(c, "null"), "null").when(_keyword(c, "true") | _keyword(c, "false"), "boolean").when(is_typed_number(c), "number").otherwise("text")


def sheet_value_kind(c: Column) -> Column:
    """What a worksheet import makes of a text: null, number (any finite one that js_number reads), date, boolean, error or text."""
    number = js_number(c, T.StringType())
    from sheaf.functions.dates import parse_iso

    return (
        F.when(c.isNull() | (c == ""), "null")
        .when(number.isNotNull() & (F.abs(number) != float("inf")), "number")
        .when((F.length(c) >= 10) & parse_iso(c).isNotNull(), "date")
        .when(c.isin("true", "false"), "boolean")
        .when(c.isin(*ERRORS), "error")
        .otherwise("text")
    )


#: Error codes of cells.
ERRORS = ("#N/A", "#REF!", "#NAME?", "#DIV/0!", "#NULL!", "#VALUE!", "#NUM!")


def parse_number(c: Column, decimal: str = ".") -> Column:
    """Text with the given decimal sign as a double."""
    return js_number(F.replace(c, F.lit(decimal), F.lit(".")) if decimal != "." else c, T.StringType())


def format_number(c: Column, kind: T.DataType, decimal: str = ".") -> Column:
    out = js_string(c, kind)
    return F.replace(out, F.lit("."), F.lit(decimal)) if decimal != "." else out


def parse_boolean(c: Column) -> Column:
    """true, 1 and t, in any case, are true."""
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1", "t"), F.lit(False))


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def literal_fits(kind: T.DataType, value: object) -> bool:
    """Whether a literal can equal a column's values: types are not coerced."""
    if value is None:
        return True
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, T.NumericType)
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    return not isinstance(kind, (T.BooleanType, T.NumericType, T.StringType))
