"""Number formats of worksheets: values as the texts that they are shown as."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.sources.sheet import BUILT_IN

MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
_SECTION = re.compile(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]|;|[^"\\_*\[;]+|.', re.S)
_CONDITION = re.compile(r"\[(<=|>=|<>|=|<|>)(-?[0-9.]+)\]")
_DATE = re.compile(r'\[h+\]|\[m+\]|\[s+\]|AM/PM|A/P|y+|m+|d+|h+|s+|\.0+|"[^"]*"|\\.|.', re.I | re.S)
_TESTS: dict[str, Callable[[float, float], bool]] = {
    "=": lambda v, t: v == t, "<>": lambda v, t: v != t, "<": lambda v, t: v < t, ">": lambda v, t: v > t, "<=": lambda v, t: v <= t, ">=": lambda v, t: v >= t,
}


def number_format(fmt_id: int) -> str:
    """The built-in format of an id; General for others."""
    return BUILT_IN.get(fmt_id, "General")


@functools.lru_cache(maxsize=1024)
def sections(fmt: str) -> tuple[str, ...]:
    out = [""]
    for m in _SECTION.finditer(fmt):
        if m.group() == ";":
            out.append("")
        else:
            out[-1] += m.group()
    return tuple(out)


def choose(fmt: str, value: object) -> tuple[str, object]:
    """The section for a value, and the value as that section shows it (a negative one loses its sign in its own section)."""
    parts = sections(fmt)
    if isinstance(value, str):
        return (parts[3] if len(parts) > 3 else "@" if "@" not in parts[-1] else parts[-1]), value
    conditions = [_CONDITION.search(p) for p in parts]
    if any(conditions):
        for p, c in zip(parts, conditions, strict=True):
            if c is None or _TESTS[c[1]](value, float(c[2])):
                return _CONDITION.sub("", p), value
        return "General", value
    if len(parts) == 1 or value > 0 or (value == 0 and len(parts) < 3):
        return parts[0], value
    if value < 0:
        return parts[1], -value
    return parts[2], value


def _clean(section: str) -> str:
    """A section without colours and fillers; a space where a sign's width is left free."""
    section = re.sub(r"\[(?!h+\]|m+\]|s+\])(?:\$([^\]-]*)[^\]]*|[^\]]*)\]", lambda m: f'"{m[1]}"' if m[1] else "", section, flags=re.I)
    return re.sub(r"\*.", "", re.sub(r"_.", " ", section))


def general(v: float) -> str:
    """At most 11 significant digits, or scientific."""
    if v == int(v) and abs(v) < 1e11:
        return str(int(v))
    if 1e-4 <= abs(v) < 1e11:
        return f"{Decimal(f'{v:.11g}'):f}" if "e" in f"{v:.11g}" else f"{v:.11g}"
    mantissa, _, exponent = f"{v:.5E}".partition("E")
    return f"{mantissa.rstrip('0').rstrip('.')}E{exponent[0]}{exponent[1:].zfill(2)}"


def _fixed(v: float, digits: int) -> str:
    return str(abs(Decimal(repr(v))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


HELD = "\ue000"  # stands for a literal while a pattern is read


def _literals(pattern: str) -> tuple[str, list[str]]:
    """A pattern with its literals replaced by a private sign each."""
    found: list[str] = []

    def take(m: re.Match) -> str:
        found.append(m.group()[1:-1] if m.group()[0] == '"' else m.group()[1:])
        return HELD

    return re.sub(r'"[^"]*"|\\.', take, pattern), found


def _restore(text: str, literals: list[str]) -> str:
    rest = iter(literals)
    return re.sub(HELD, lambda m: next(rest), text)


def _place(whole: str, mask: str, grouped: bool) -> str:
    """Digits of a whole number laid into a mask of 0, # and ?, and whatever stands between them."""
    digits, out = list(whole.lstrip("0")), []
    slots = [c for c in mask if c in "0#?"]
    left = len(slots)
    count = 0
    for c in reversed(mask):
        if c == ",":
            continue
        if c not in "0#?":
            out.append(c)
            continue
        left -= 1
        take = [digits.pop()] if digits else [{"0": "0", "?": " ", "#": ""}[c]]
        if left == 0:
            take += reversed(digits)
            digits = []
        for d in take:
            if d and grouped and count and count % 3 == 0 and d.isdigit():
                out.append(",")
            out.append(d)
            count += d.isdigit()
    return "".join(reversed(out))


def _number(pattern: str, v: float) -> str:
    pattern, literals = _literals(pattern)
    m = re.search(r"[0#?][0#?,]*(?:[^0#?.E%,]+[0#?,]+)*(?:\.[0#?]*)?|\.[0#?]+", pattern)
    if m is None:
        return ("-" if v < 0 else "") + _restore(pattern, literals)
    mask, end = m.group(), m.end()
    after = len(pattern[end:]) - len(pattern[end:].lstrip(","))  # each comma past the digits divides by a thousand
    scale, end = after + len(re.search(r",*(?=\.|$)", mask).group()), end + after
    v = v / 1000**scale * 100 ** pattern.count("%")
    whole_mask, _, part_mask = mask.partition(".")
    whole_mask = whole_mask.rstrip(",")
    places = sum(c in "0#?" for c in part_mask)
    whole, _, part = _fixed(v, places).partition(".")
    shown = _place(whole, whole_mask or "#", "," in whole_mask)
    if "." in mask:
        keep = len(part)
        while keep and part[keep - 1] == "0" and part_mask[keep - 1] in "#?":
            keep -= 1
        shown += "." + part[:keep] + "".join(" " for c in part_mask[keep:] if c == "?")
    negative = v < 0 and (whole.strip("0") or part.strip("0"))
    return ("-" if negative else "") + _restore(pattern[: m.start()] + shown + pattern[end:], literals)


def _scientific(pattern: str, v: float) -> str:
    m = re.search(r"([0#?.]+)E([+-])(0+)", pattern)
    mask, sign, width = m.groups()
    whole, _, part = mask.partition(".")
    step = max(1, len(whole))
    exponent = math.floor(math.log10(abs(v))) if v else 0
    exponent = exponent // step * step if step > 1 else exponent
    mantissa = _fixed(v / 10**exponent, len(part))
    if Decimal(mantissa) >= 10**step:
        exponent += step
        mantissa = _fixed(v / 10**exponent, len(part))
    shown = f"{mantissa}E{'-' if exponent < 0 else '+' if sign == '+' else ''}{str(abs(exponent)).zfill(len(width))}"
    return ("-" if v < 0 else "") + pattern[: m.start()] + shown + pattern[m.end() :]


def _fraction(pattern: str, v: float) -> str:
    m = re.search(r"(?:([#0?]+)( +))?([#0?]+)/([#0?]+|[1-9][0-9]*)", pattern)
    whole_mask, gap, top_mask, low_mask = m.groups()
    size = abs(v)
    whole = int(size) if whole_mask else 0
    rest = size - whole
    if low_mask[0] in "123456789":
        low = int(low_mask)
        top = int(rest * low + 0.5)
    else:
        best = Fraction(rest).limit_denominator(10 ** len(low_mask) - 1)
        top, low = best.numerator, best.denominator
    if whole_mask and top == low and top:
        whole, top = whole + 1, 0
    sign = "-" if v < 0 else ""
    if whole_mask and not top:
        return sign + str(whole) + " " * (len(gap) + len(top_mask) + 1 + len(low_mask))
    head = (str(whole) if whole or "0" in whole_mask else "") + gap if whole_mask else ""
    return f"{sign}{head}{str(top).rjust(len(top_mask))}/{str(low).ljust(len(low_mask))}"


def _moment(serial: float, date1904: bool) -> datetime:
    days = serial - (0 if not date1904 else -1462)
    return datetime(1899, 12, 30) + timedelta(milliseconds=math.floor(days * 86_400_000 + 0.5))


def _date(pattern: str, v: float, date1904: bool) -> str:
    t = _moment(v, date1904)
    tokens = [m.group() for m in _DATE.finditer(pattern)]
    low = [x.lower() for x in tokens]
    twelve = any(x in ("am/pm", "a/p") for x in low)
    total = v * 86400
    out = []
    for i, (token, x) in enumerate(zip(tokens, low, strict=True)):
        if x[0] == "[" and x[-1] == "]" and len(x) > 2:
            size, unit = len(x) - 2, x[1]
            out.append(str(int(total / {"h": 3600, "m": 60, "s": 1}[unit] + 1e-6)).zfill(size))
        elif x in ("am/pm", "a/p"):
            out.append(("AM", "PM")[t.hour >= 12][: 2 if x == "am/pm" else 1])
        elif x[0] == "y":
            out.append(f"{t.year:04d}" if len(x) > 2 else f"{t.year % 100:02d}")
        elif x[0] == "m":
            before = next((y for y in reversed(low[:i]) if y[0] in "hsydm["), "")
            after = next((y for y in low[i + 1 :] if y[0] in "hsydm["), "")
            if len(x) < 3 and (before.strip("[]")[:1] == "h" or after[:1] == "s"):
                out.append(str(t.minute).zfill(len(x)))
            else:
                out.append({1: str(t.month), 2: f"{t.month:02d}", 3: MONTHS[t.month - 1][:3], 4: MONTHS[t.month - 1]}.get(len(x), MONTHS[t.month - 1][:1]))
        elif x[0] == "d":
            out.append({1: str(t.day), 2: f"{t.day:02d}", 3: DAYS[t.weekday()][:3]}.get(len(x), DAYS[t.weekday()]))
        elif x[0] == "h":
            out.append(str((t.hour % 12 or 12) if twelve else t.hour).zfill(len(x)))
        elif x[0] == "s":
            out.append(str(t.second).zfill(len(x)))
        elif x[0] == "." and len(x) > 1:
            out.append("." + f"{t.microsecond:06d}"[: len(x) - 1])
        else:
            out.append(token[1:-1] if token[0] == '"' else token[1:] if token[0] == "\\" else token)
    return "".join(out)


def format_value(fmt: str, value: object, date1904: bool = False) -> str:
    """A value under a format; null is an empty text, booleans are TRUE and FALSE."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    section, shown = choose(fmt, value)
    if isinstance(shown, str):
        pattern, literals = _literals(_clean(section))
        return _restore(pattern.replace("@", shown), literals)
    if shown != shown or abs(shown) == math.inf:
        return str(shown)
    section = _clean(section)
    bare = re.sub(r'"[^"]*"|\\.', "", section)
    if re.fullmatch(r"(?i)general", bare.strip()) or bare == "@":
        return re.sub("(?i)general|@", lambda _: general(shown), section).replace('"', "")
    if re.search(r"[0#?.]+E[+-]0+", bare):
        return _scientific(section, shown)
    if re.search(r"[#0?]+ */ *[#0?1-9]", bare):
        return _fraction(section, shown)
    if re.search(r"[ymdhs]", re.sub(r"AM/PM|A/P", "h", bare), re.I) and not re.search(r"[#?]", bare):
        return _date(section, shown, date1904)
    return _number(section, shown)


def format_column(c: Column, fmt: str, date1904: bool = False) -> Column:
    """A column of numbers (serial days for dates) as shown text."""

    @F.pandas_udf(T.StringType())
    def run(s):  # noqa: ANN001, ANN202
        return s.map(lambda v: format_value(fmt, None if v is None or v != v else v, date1904))

    return run(c)
