"""A1 addresses and ranges as expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def column_letters(number: Column) -> Column:
    """1-based column numbers (up to 18,278) as letters."""
    n = number.cast("int")
    letter = lambda c: F.char(F.lit(65) + F.pmod(c, F.lit(26)))
    one, two, three = n - 1, F.floor((n - 27) / 26), F.floor((n - 703) / 676)
    return F.concat(F.when(n > 702, letter(three)).otherwise(""), F.when(n > 26, letter(two)).otherwise(""), letter(one))


def column_number(letters: Column) -> Column:
    """Letters as a 1-based column number."""
    up = F.upper(letters)
    place = lambda i: F.ascii(F.substring(up, i, 1)) - 64
    return F.when(F.length(up) == 1, place(1)).when(F.length(up) == 2, place(1) * 26 + place(2)).when(F.length(up) == 3, place(1) * 676 + place(2) * 26 + place(3))


def encode_cell(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), row.cast("string"))


def decode_cell(address: Column) -> Column:
    """A1, with or without dollar signs and a sheet name, as a struct of row and col."""
    bare = F.regexp_replace(F.regexp_replace(address, r"^.*!", ""), r"\$", "")
    return F.struct(F.regexp_extract(bare, "([0-9]+)$", 1).try_cast("int").alias("row"), column_number(F.regexp_extract(bare, "^([A-Za-z]+)", 1)).alias("col"))


def to_letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def to_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


@dataclass(frozen=True)
class Range:
    """A rectangle of cells, 1-based and inclusive."""

    top: int
    left: int
    bottom: int
    right: int

    @classmethod
    def of(cls, text: str) -> Range:
        ends = [re.fullmatch(r"([A-Za-z]+)([0-9]+)", p) for p in text.rpartition("!")[2].replace("$", "").split(":")]
        if not ends[0] or not ends[-1]:
            raise ValueError(f"not a range: {text}")
        cells = [(int(m[2]), to_number(m[1])) for m in (ends[0], ends[-1])]
        rows, cols = sorted(c[0] for c in cells), sorted(c[1] for c in cells)
        return cls(rows[0], cols[0], rows[1], cols[1])

    @property
    def count(self) -> int:
        return (self.bottom - self.top + 1) * (self.right - self.left + 1)

    def contains(self, row: Column, col: Column) -> Column:
        return row.between(self.top, self.bottom) & col.between(self.left, self.right)

    def intersects(self, other: Range) -> bool:
        return self.top <= other.bottom and other.top <= self.bottom and self.left <= other.right and other.left <= self.right

    def expand(self, row: int, col: int) -> Range:
        return Range(min(self.top, row), min(self.left, col), max(self.bottom, row), max(self.right, col))

    def __str__(self) -> str:
        ends = f"{to_letters(self.left)}{self.top}", f"{to_letters(self.right)}{self.bottom}"
        return ends[0] if ends[0] == ends[1] else ":".join(ends)


REFERENCE = r"(?<![A-Za-z0-9_.])(\$?)([A-Za-z]{1,3})(\$?)([0-9]+)(?![A-Za-z0-9_(])"


def slide_formula(formula: str, rows: int, cols: int) -> str:
    """A shared formula as it reads rows and cols further on: references without a dollar sign move."""

    def move(m: re.Match) -> str:
        col = m[2] if m[1] else to_letters(max(1, to_number(m[2]) + cols))
        row = m[4] if m[3] else str(max(1, int(m[4]) + rows))
        return f"{m[1]}{col}{m[3]}{row}"

    return re.sub(REFERENCE, move, formula)


def dependencies(formula: Column) -> Column:
    """Cells and ranges that a formula names."""
    return F.regexp_extract_all(formula, F.lit(r"([A-Z]{1,3}[0-9]+(?::[A-Z]{1,3}[0-9]+)?)"), F.lit(1))


def qualify(formula: Column, table: str) -> Column:
    """Structured references like [@Col] with the table's name before them."""
    return F.regexp_replace(formula, r"(?<![\w\]])\[", f"{table}[")
