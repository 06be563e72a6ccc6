"""Queries compiled to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators import aggregates, ordering, predicates
from sheaf.plans.query import Query


def compile_query(df: DataFrame, query: Query, compat: bool = False) -> DataFrame:
    """The query's rows: sort, filter, search, groups or else aggregates, page.

    The sort is stable, so filters may go first; groups forget the order, unless compat keeps that of first appearance.
    """
    out = df
    if query.filter is not None:
        out = predicates.where(out, query.filter, compat)
    if query.search is not None:
        out = predicates.search(out, query.search)
    if query.group_by is not None:
        if compat and query.sort:  # groups appear, and rows come first and last, in sorted order
            out = ordering.sort(out, query.sort).withColumn(ordering.ROW, F.monotonically_increasing_id())
        out = aggregates.group_by(out, query.group_by, compat)
    elif query.aggregate:
        out = aggregates.global_aggregate(out, query.aggregate, compat)
    elif query.sort:
        out = ordering.sort(out, query.sort)
    return ordering.page(out, query.page) if query.page is not None else out


@dataclass
class Result:
    """A query's rows, and figures that are counted when asked for."""

    data: DataFrame
    base: DataFrame
    matched: DataFrame
    grouped: DataFrame | None
    query: Query

    def stats(self) -> dict[str, int]:
        total, matches = self.base.count(), self.matched.count()
        out = {"total_count": total, "match_count": matches}
        rows = self.grouped.count() if self.grouped is not None else matches
        if self.grouped is not None and self.query.group_by is not None:
            out["group_count"] = rows
        if self.query.page is not None:
            size = self.query.page.size
            out |= {"page": max(1, self.query.page.number), "page_size": size, "total_rows": rows, "total_pages": -(-rows // size) if size > 0 else 1}
        return out


def run_query(df: DataFrame, query: Query, compat: bool = False) -> Result:
    matched = compile_query(df, Query(filter=query.filter, search=query.search), compat)
    grouped = compile_query(df, Query(sort=query.sort, filter=query.filter, search=query.search, group_by=query.group_by, aggregate=query.aggregate), compat) if query.group_by or query.aggregate else None
    return Result(compile_query(df, query, compat), df, matched, grouped, query)
