"""A scanner of delimited text: records of one file, with places, quoting and faults."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Literal

CANDIDATES = (",", ";", "\t", "|")
SAMPLE_LINES = 10


@dataclass(frozen=True)
class CsvOptions:
    """How delimited text is read. An empty delimiter is detected."""

    delimiter: str = ","
    quote: str | None = '"'
    escape: str | None = None  # the quote, by default
    headers: bool | Sequence[str | None] | Callable[[list[str]], list[str | None]] = True
    skip_empty_lines: bool | Literal["greedy"] = False
    trim: bool = False
    ltrim: bool = False
    rtrim: bool = False
    comment: str | None = None
    skip_lines: int = 0
    to_line: int | None = None
    skip_rows: int = 0
    max_rows: int | None = None
    max_row_bytes: int | None = None
    less: Literal["error", "pad"] = "error"
    more: Literal["error", "truncate", "keep"] = "error"
    skip_records_with_error: bool = False
    skip_records_with_empty_values: bool = False
    relax_quotes: bool = False
    fast_mode: bool = False
    encoding: str = "utf-8"
    before_first_chunk: Callable[[str], str | None] | None = field(default=None, compare=False)


@dataclass
class Record:
    index: int
    line: int
    offset: int
    quoted: list[bool]
    raw: str
    fields: list[str]
    extra: list[str] | None = None
    error: str | None = None
    message: str | None = None
    kept: bool = True


def decode(data: bytes, options: CsvOptions) -> str:
    text = data.decode(options.encoding, "replace").removeprefix("﻿")
    if options.before_first_chunk is not None:
        new = options.before_first_chunk(text)
        if not isinstance(new, (str, type(None))):
            raise TypeError("before_first_chunk must return text or None")
        text = text if new is None else new
    return text


def _logical_lines(text: str, quote: str | None, limit: int) -> Iterator[str]:
    """Lines, quoted line ends not counting."""
    q = re.escape(quote) if quote else None
    pattern = re.compile(rf"(?:{q}(?:[^{q}]|{q}{q})*(?:{q}|\Z)|[^\r\n{q}])*" if q else r"[^\r\n]*")
    at = n = 0
    while at < len(text) and n < limit:
        m = pattern.match(text, at)
        yield m.group()
        n += 1
        at = m.end() + (2 if text.startswith("\r\n", m.end()) else 1)


def detect_delimiter(text: str, quote: str | None = '"', comment: str | None = None) -> str:
    """The candidate whose field counts vary least over the first useful lines, and that gives about two fields and more;
    of equal ones the one with more fields; the first candidate if there is none."""
    lines = []
    for line in _logical_lines(text, quote, 10 * SAMPLE_LINES):
        if line.strip() and not (comment and line.startswith(comment)):
            lines.append(line)
        if len(lines) == SAMPLE_LINES:
            break
    best, found = None, CANDIDATES[0]
    for d in CANDIDATES:
        bare = [re.sub(rf"{re.escape(quote)}[^{re.escape(quote)}]*(?:{re.escape(quote)}|$)", "", x) if quote else x for x in lines]
        counts = [x.count(d) + 1 for x in bare]
        if not counts or (mean := sum(counts) / len(counts)) <= 1.99:
            continue
        rank = (sum(abs(a - b) for a, b in zip(counts, counts[1:], strict=False)), -mean)
        if best is None or rank < best:
            best, found = rank, d
    return found


def detect_line_end(text: str, quote: str | None = '"') -> str:
    """The first line end outside quotes."""
    for line in _logical_lines(text, quote, 1):
        m = re.compile(r"\r\n|\r|\n").match(text, len(line))
        if m:
            return m.group()
    return "\n"


def distinct_headers(names: Sequence[str | None]) -> tuple[list[str | None], dict[str, str]]:
    """Headers made distinct, and which were renamed: repeats get _1, _2, empty ones _column_<place>; None stays (its
    column goes). No new name equals a given one."""
    given = {n for n in names if n}
    used: set[str] = set()
    out: list[str | None] = []
    renamed: dict[str, str] = {}
    for i, name in enumerate(names):
        if name is None or (name and name not in used):
            new = name
        else:
            base, k = (name, 1) if name else (f"_column_{i}", 0)
            new = f"{base}_{k}" if name else base
            while new in used or new in given:
                new, k = f"{base}_{k + 1 if name else k}", k + 1
            renamed[new] = name
        if new is not None:
            used.add(new)
        out.append(new)
    return out, renamed


@dataclass
class _Row:
    fields: list[str]
    quoted: list[bool]
    start: int
    end: int  # before the line end
    next: int
    unterminated: bool = False


class Scanner:
    """Rows of a text. Fields are found by patterns for the next thing that matters, not character by character."""

    def __init__(self, text: str, o: CsvOptions) -> None:
        self.text, self.o = text, o
        self.delimiter = o.delimiter or detect_delimiter(text, o.quote, o.comment)
        d = re.escape(self.delimiter)
        self.plain_end = re.compile(rf"{d}|\r\n|\r|\n|\Z")
        q, e = o.quote, o.escape or o.quote
        self.quote, self.escape = q, e
        if q:
            self.inside = re.compile("|".join(dict.fromkeys([re.escape(e) + re.escape(q), *([re.escape(e) * 2] if e != q else []), re.escape(q), r"\r\n?"])))

    def _quoted(self, at: int) -> tuple[str, int, bool]:
        """Value, place after it, and whether the quote is open at the end."""
        text, parts = self.text, []
        at += 1
        while (m := self.inside.search(text, at)) is not None:
            parts.append(text[at : m.start()])
            got = m.group()
            at = m.end()
            if got == self.quote:
                rest = self.plain_end.match(text, at)
                if rest is None and self.o.relax_quotes:
                    parts.append(self.quote)
                    continue
                return "".join(parts), at, False
            parts.append("\n" if got[0] == "\r" else got[-1])  # an escaped sign, or a line end
        return "".join([*parts, text[at:]]), len(text), True

    def rows(self) -> Iterator[_Row]:
        text, at = self.text, 0
        while at < len(text):
            start, fields, quoted, unterminated = at, [], [], False
            while True:
                if self.quote and text.startswith(self.quote, at) and not self.o.fast_mode:
                    value, at, unterminated = self._quoted(at)
                    m = self.plain_end.search(text, at)
                    value += text[at : m.start()]  # what stands between a closing quote and the delimiter
                    quoted.append(True)
                else:
                    m = self.plain_end.search(text, at)
                    value = text[at : m.start()]
                    quoted.append(False)
                fields.append(value)
                at = m.end()
                if m.group() != self.delimiter:
                    break
            yield _Row(fields, quoted, start, m.start(), at, unterminated)


def _trimmed(fields: list[str], o: CsvOptions) -> list[str]:
    if o.trim or (o.ltrim and o.rtrim):
        return [f.strip() for f in fields]
    if o.ltrim:
        return [f.lstrip() for f in fields]
    return [f.rstrip() for f in fields] if o.rtrim else fields


def _is_empty(fields: list[str], how: bool | str) -> bool:
    return all(not f.strip() for f in fields) if how == "greedy" else len(fields) == 1 and fields[0] == ""


def headers_of(text: str, o: CsvOptions) -> tuple[list[str | None] | None, dict[str, str]]:
    """The headers that a text has under these options, and renamed ones; None without headers."""
    if not o.headers:
        return None, {}
    if not callable(o.headers) and o.headers is not True:
        return distinct_headers(list(o.headers))
    for fields, _, _, _ in _useful(text, o):
        names = o.headers(fields) if callable(o.headers) else fields
        if len(names) != len(fields):
            raise ValueError(f"the header function gave {len(names)} headers for {len(fields)} columns")
        return distinct_headers(names)
    return [], {}


def _useful(text: str, o: CsvOptions) -> Iterator[tuple[list[str], _Row, int, int]]:
    """(fields, row, first line, last line) of the rows within the line window that are neither comments nor empty."""
    line = 0
    for row in Scanner(text, o).rows():
        first = line + 1
        line += 1 + len(re.findall(r"\r\n|\r|\n", text[row.start : row.end]))
        if o.to_line is not None and line > o.to_line:
            return
        if line <= o.skip_lines:
            continue
        if o.max_row_bytes is not None and len(text[row.start : row.end].encode()) > o.max_row_bytes:
            raise ValueError(f"a row exceeds {o.max_row_bytes} bytes")
        fields = _trimmed(row.fields, o)
        if o.comment and fields[0].lstrip().startswith(o.comment):
            continue
        if o.skip_empty_lines and _is_empty(fields, o.skip_empty_lines):
            continue
        yield fields, row, first, line


def scan(text: str, o: CsvOptions, width: int | None = None) -> Iterator[Record]:
    """Data records, rejected ones with kept False. width: columns that a record must have; None: no check."""
    header = o.headers is True or callable(o.headers)
    skipped = index = 0
    for fields, row, first, last in _useful(text, o):
        if header:
            header = False
            continue
        if skipped < o.skip_rows:
            skipped += 1
            continue
        r = Record(index, first, row.start, row.quoted, text[row.start : row.end], list(fields))
        if row.unterminated:
            r.error, r.message = "MissingQuotes", "Quoted field unterminated"
        if width and len(fields) != width:
            few = len(fields) < width
            r.error = "TooFewFields" if few else "TooManyFields"
            r.message = f"line {last}: expected {width} columns, got {len(fields)}"
            policy = o.less if few else o.more
            if policy == "error":
                r.kept = False
            elif policy == "pad":
                r.fields += [""] * (width - len(fields))
            else:
                r.extra = r.fields[width:] if policy == "keep" else None
                r.fields = r.fields[:width]
        if r.kept and o.skip_records_with_empty_values and all(f == "" for f in r.fields):
            continue
        if r.kept:
            if o.max_rows is not None and index >= o.max_rows:
                return
            index += 1
        yield r
