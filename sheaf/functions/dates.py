"""Dates: parsing by fixed formats, formatting by tokens, and serial numbers of worksheets."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Supported formats.
FORMATS = (
    "YYYY-MM-DD[T]HH:mm:ssZ",
    "YYYY-MM-DD[T]HH:mm:ss",
    "YYYY-MM-DD[T]HH:mm:ss.SSSZ",
    "YYYY-MM-DD",
    "YYYY-MM-DD HH:mm:ss",
    "MM-DD-YYYY",
    "MM-DD-YYYY HH:mm:ss",
    "MM/DD/YYYY HH:mm:ss",
    "DD-MM-YYYY",
    "DD-MM-YYYY HH:mm:ss",
    "DD/MM/YYYY HH:mm:ss",
)
ISO = FORMATS[:5]
EPOCH_SERIAL = 25569  # 1970-01-01 as a serial number
EPOCH_1904 = 1462  # days between the two serial systems
DAY_MS = 86_400_000
_TOKENS = re.compile(r"\[([^\]]*)\]|YYYY|MM|DD|HH|mm|ss|SSS|Z|'|[A-Za-z]+|[^A-Za-z\[']+")
_JAVA = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "ss": "ss", "SSS": "SSS", "Z": "XXX", "'": "''"}
_SHAPES = {"YYYY": "[0-9]{4}", "SSS": "[0-9]{3}", "Z": r"(?:Z|[+-][0-9]{2}:[0-9]{2})"}


def _tokens(fmt: str) -> list[tuple[str, str]]:
    """(token, literal) of a format; one of the two is empty."""
    found = []
    for m in _TOKENS.finditer(fmt):
        literal = m.group(1) if m.group(1) is not None else "" if m.group() in _JAVA else m.group()
        found.append(("" if m.group(1) is not None or m.group() not in _JAVA else m.group(), literal))
    return found


def java_pattern(fmt: str) -> str:
    """A format as a pattern of date_format and to_timestamp."""
    quote = lambda s: "'" + s.replace("'", "''") + "'" if re.search("[A-Za-z']", s) else s
    return "".join(_JAVA[t] if t else quote(s) for t, s in _tokens(fmt))


def shape(fmt: str) -> str:
    """A regular expression for texts in a format."""
    return "^" + "".join(_SHAPES.get(t, "[0-9]{2}") if t else re.escape(s) for t, s in _tokens(fmt)) + "$"


def parse_dates(c: Column, formats: Sequence[str] = ISO) -> Column:
    """The timestamp that the first matching format reads, else null. Forms without an offset are in the session's zone."""
    unknown = set(formats) - set(FORMATS)
    if unknown:
        raise ValueError(f"unsupported date formats: {sorted(unknown)}")
    tries = [F.when(c.rlike(shape(f)), F.try_to_timestamp(c, F.lit(java_pattern(f)))) for f in formats]
    return F.coalesce(*tries)


def parse_iso(c: Column, compat: bool = False) -> Column:
    """ISO dates and times. With compat, forms with a T lose their time of day."""
    full = F.coalesce(parse_dates(c), F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"), F.try_to_timestamp(c)))
    return F.when(c.contains("T"), F.date_trunc("day", full)).otherwise(full) if compat else full


def cast_date(c: Column) -> Column:
    """Texts of at least ten characters that are ISO dates, else null."""
    return F.when(F.length(c) >= 10, parse_iso(c))


def format_date(c: Column, fmt: str | None = None, utc: bool = True) -> Column:
    """Times as text by tokens YYYY MM DD HH mm ss SSS Z and [literals]; ISO 8601 by default; null gives an empty text."""
    pattern = java_pattern(fmt or "YYYY-MM-DD[T]HH:mm:ss.SSSZ")
    return F.coalesce(F.date_format(c.cast("timestamp"), pattern), F.lit(""))


def to_serial(c: Column, date1904: bool = False) -> Column:
    """Times as serial days."""
    return F.unix_millis(c.cast("timestamp")) / float(DAY_MS) + float(EPOCH_SERIAL - (EPOCH_1904 if date1904 else 0))


def from_serial(c: Column, date1904: bool = False) -> Column:
    """Serial days as times, to the millisecond."""
    days = c.cast("double") - float(EPOCH_SERIAL - (EPOCH_1904 if date1904 else 0))
    return F.timestamp_millis(F.floor(days * DAY_MS + 0.5).cast("long"))


def is_date_format(fmt: str | None) -> bool:
    """Whether a number format shows a date or time: a date letter is left once colours, literals and quotes are gone."""
    if not fmt or fmt == "General" or "@" in fmt.split(";")[0]:
        return False
    bare = re.sub(r"\[(?!h+\]|m+\]|s+\])[^\]]*\]|\"[^\"]*\"|\\.|_.|\*.", "", fmt, flags=re.I)
    if re.search(r"[0#?]", bare) and not re.search(r"[ymdhs]", bare, re.I):
        return False
    return bool(re.search(r"[ymdhs]", re.sub(r"general|e[+-]", "", bare, flags=re.I), re.I))
