"""Logical plans of the query layer: plain records that the compiler turns into DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any, Literal

OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "contains", "startsWith", "endsWith", "regex", "in", "notIn", "isNull", "notNull")
AGGREGATES = ("count", "sum", "avg", "min", "max", "first", "last")


@dataclass(frozen=True)
class Condition:
    """A test of one column, by name or position. Unknown operators keep every row."""

    column: str | int
    operator: str
    value: Any = None
    ignore_case: bool = False


@dataclass(frozen=True)
class Filter:
    conditions: Sequence[Condition] = ()
    logic: Literal["and", "or"] = "and"


@dataclass(frozen=True)
class Search:
    """Rows of which some column contains the text; all columns by default."""

    text: str
    columns: Sequence[str] | None = None
    ignore_case: bool = True


@dataclass(frozen=True)
class Sort:
    column: str | int
    order: Literal["asc", "desc"] = "asc"
    comparator: Literal["auto", "string", "number", "date"] = "auto"


@dataclass(frozen=True)
class Aggregate:
    column: str
    function: str
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or f"{self.column}_{self.function}"


@dataclass(frozen=True)
class GroupBy:
    columns: Sequence[str]
    aggregates: Sequence[Aggregate] = ()


@dataclass(frozen=True)
class Page:
    number: int
    size: int


@dataclass(frozen=True)
class Query:
    """Sort, filter, search, then groups or else aggregates, then a page. Aggregates are dropped if there are groups."""

    sort: Sequence[Sort] = ()
    filter: Filter | None = None
    search: Search | None = None
    group_by: GroupBy | None = None
    aggregate: Sequence[Aggregate] = field(default_factory=tuple)
    page: Page | None = None
