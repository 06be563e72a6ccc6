"""Text and binary functions."""

from __future__ import annotations

import math
import re
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: First characters that a spreadsheet takes for a formula.
FORMULA_STARTS = ("=", "+", "-", "@", "\t", "\r", "\n", "＝", "＋", "－", "＠")


def escape_formula(c: Column) -> Column:
    """c with an apostrophe before texts that a spreadsheet would take for a formula."""
    return F.when(F.substring(c, 1, 1).isin(*FORMULA_STARTS), F.concat(F.lit("'"), c)).otherwise(c)


def quote_field(c: Column, delimiter: str = ",", quote: str = '"', escape: str | None = None, always: bool = False) -> Column:
    """c as a field of delimited text: quoted if it holds the delimiter, the quote or a line end; null is empty."""
    escape = escape or quote
    c = F.coalesce(c, F.lit(""))
    inner = F.replace(c, F.lit(escape), F.lit(escape * 2)) if escape != quote else c
    inner = F.replace(inner, F.lit(quote), F.lit(escape + quote))
    quoted = F.concat(F.lit(quote), inner, F.lit(quote))
    if always:
        return quoted
    needs = c.contains(delimiter) | c.contains(quote) | c.contains("\n") | c.contains("\r")
    return F.when(needs, quoted).otherwise(c)


def utf8_length(c: Column) -> Column:
    return F.octet_length(c)


def xml_encode(c: Column) -> Column:
    """c with the five XML entities, and without control characters that XML forbids."""
    out = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def xml_decode(c: Column) -> Column:
    """The five entities and numeric references decoded."""

    @F.pandas_udf(T.StringType())
    def run(s):  # noqa: ANN001, ANN202
        return s.map(decode_xml, na_action="ignore")

    return F.when(c.contains("&"), run(c)).otherwise(c)


_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decode_xml(s: str) -> str:
    def one(m: re.Match) -> str:
        name = m.group(1)
        if name[0] != "#":
            return _NAMED.get(name, m.group())
        code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m.group()

    return re.sub(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-z]+);", one, s)


def decode_ooxml(s: str) -> str:
    """_xHHHH_ escapes decoded."""
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m.group(1), 16)), s)


def encode_ooxml(s: str) -> str:
    """Control characters, and what looks like an escape, as _xHHHH_."""
    s = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", s)
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", lambda m: f"_x{ord(m.group()):04X}_", s)


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: ** crosses folders, * and ? don't, [..] and {a,b} are sets."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + r"(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
            continue
        depth += (c == "{") - (c == "}")
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else re.escape(c))
        i += 1
    return f"^{out}$"


def glob_match(c: Column, pattern: str) -> Column:
    return c.rlike(glob_regex(pattern))


def table_name(c: Column) -> Column:
    """A legal table name: no blanks, a letter, underscore or backslash first, no cell address, at most 255 characters."""
    name = F.regexp_replace(F.trim(c), r"[^\p{L}\p{N}_.\\]", "_")
    name = F.when(name.rlike(r"^[\p{L}_\\]"), name).otherwise(F.concat(F.lit("_"), name))
    address = name.rlike(r"(?i)^(?:[a-z]{1,3}[0-9]+|r[0-9]*c[0-9]*|[rc])$")
    return F.substring(F.when(address, F.concat(F.lit("_"), name)).otherwise(name), 1, 255)


@F.pandas_udf(T.LongType())
def adler32(s):  # noqa: ANN001, ANN201
    """Adler-32 of bytes."""
    return s.map(lambda b: zlib.adler32(bytes(b)), na_action="ignore").astype("Int64")


def shannon(b: bytes) -> float:
    if not b:
        return 0.0
    counts = [0] * 256
    for x in b:
        counts[x] += 1
    return -sum(n / len(b) * math.log2(n / len(b)) for n in counts if n)


@F.pandas_udf(T.DoubleType())
def entropy(s):  # noqa: ANN001, ANN201
    """Shannon entropy of bytes, in bits a byte."""
    return s.map(lambda b: shannon(bytes(b)), na_action="ignore").astype("float64")


def decompress(b: bytes) -> bytes:
    """gzip, zlib or raw deflate, told by the first bytes."""
    if b[:2] == b"\x1f\x8b":
        return zlib.decompress(b, 31)
    if len(b) >= 2 and b[0] & 0x0F == 8 and int.from_bytes(b[:2], "big") % 31 == 0:
        return zlib.decompress(b)
    return zlib.decompress(b, -15)


@F.pandas_udf(T.BinaryType())
def decompress_auto(s):  # noqa: ANN001, ANN201
    return s.map(lambda b: decompress(bytes(b)), na_action="ignore")
