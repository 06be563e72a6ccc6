"""Sessions: a base table and the current view of it, held between calls."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from sheaf.operators import aggregates, ordering, predicates
from sheaf.operators.compiler import Result, run_query
from sheaf.plans.query import Aggregate, Filter, GroupBy, Page, Query, Search, Sort


def frame_of(spark: SparkSession, rows: Sequence[Any], headers: Sequence[str] | None = None) -> DataFrame:
    """Records (columns are the union of their keys, in order of appearance) or arrays (the first is the header unless
    headers are given) as a table."""
    rows = list(rows)
    if rows and isinstance(rows[0], dict):
        names = list(headers or dict.fromkeys(k for r in rows for k in r))
        names = [n for n in names if n != "__proto__"]
        data = [tuple(r.get(n) for n in names) for r in rows]
    else:
        names = [str(h) for h in (headers or (rows[0] if rows else []))]
        data = [tuple([*r, *[None] * len(names)][: len(names)]) for r in (rows if headers else rows[1:])]
    if not names:
        raise ValueError("no columns")
    mixed = [len({type(v) for v in c if v is not None} - {int, float}) > 1 or {str} < {type(v) for v in c if v is not None} for c in zip(*data, strict=True)] if data else [True] * len(names)
    floats = [any(isinstance(v, float) for v in c) for c in zip(*data, strict=True)] if data else [False] * len(names)
    shaped = [tuple(None if v is None else str(v) if m else float(v) if f and isinstance(v, int) and not isinstance(v, bool) else v for v, m, f in zip(r, mixed, floats, strict=True)) for r in data]
    from pyspark.sql import types as T

    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    fields = []
    for i, n in enumerate(names):
        value = next((r[i] for r in shaped if r[i] is not None), "")
        fields.append(T.StructField(n, kinds.get(type(value)) or T._infer_type(value)))
    return spark.createDataFrame(shaped, T.StructType(fields))


class Session:
    """Filter and search start from the base and replace the view; groups, aggregates and pages read the view; query reads
    the base. Sorting orders the view; with compat it also becomes the base."""

    def __init__(self, spark: SparkSession, compat: bool = False) -> None:
        self.spark, self.compat = spark, compat
        self._base: DataFrame | None = None
        self._view: DataFrame | None = None

    def load(self, data: DataFrame | Sequence[Any], headers: Sequence[str] | None = None) -> Session:
        self.dispose()
        df = data if isinstance(data, DataFrame) else frame_of(self.spark, data, headers)
        self._base = ordering.with_row(df).persist(StorageLevel.MEMORY_AND_DISK)
        self._view = self._base
        return self

    def read_csv(self, path: str, **options: Any) -> Session:
        from sheaf.sources.csv import read_csv

        return self.load(read_csv(self.spark, path, **options).rows)

    @property
    def base(self) -> DataFrame:
        if self._base is None:
            raise RuntimeError("the session holds no data")
        return self._base

    @property
    def view(self) -> DataFrame:
        if self._view is None:
            raise RuntimeError("the session holds no data")
        return self._view

    def data(self) -> DataFrame:
        return self.view.drop(ordering.ROW)

    def sort(self, sorts: Sort | Sequence[Sort]) -> DataFrame:
        self._view = ordering.sort(self.view, [sorts] if isinstance(sorts, Sort) else list(sorts))
        if self.compat:
            self._base = self._view
        return self.data()

    def filter(self, f: Filter) -> DataFrame:
        self._view = predicates.where(self.base, f, self.compat)
        return self.data()

    def search(self, s: Search) -> DataFrame:
        columns = s.columns or [c for c in self.base.columns if c != ordering.ROW]
        self._view = predicates.search(self.base, Search(s.text, columns, s.ignore_case))
        return self.data()

    def counts(self) -> dict[str, int]:
        return {"match_count": self.view.count(), "total_count": self.base.count()}

    def group_by(self, g: GroupBy) -> DataFrame:
        return aggregates.group_by(ordering.with_row(self.view), g, self.compat)

    def aggregate(self, many: Sequence[Aggregate]) -> DataFrame:
        return aggregates.global_aggregate(ordering.with_row(self.view), many, self.compat)

    def page(self, p: Page) -> DataFrame:
        return ordering.page(self.data(), p)

    def page_stats(self, p: Page) -> dict[str, int]:
        return ordering.page_stats(self.data(), p).first().asDict()

    def query(self, q: Query) -> Result:
        return run_query(self.base.drop(ordering.ROW), q, self.compat)

    def clear(self) -> None:
        self.dispose()

    def dispose(self) -> None:
        if self._base is not None:
            self._base.unpersist()
        self._base = self._view = None


class Pool:
    """Named sessions on one SparkSession. Jobs run in a scheduler pool by priority and can be cancelled by session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.sessions: dict[str, Session] = {}

    def session(self, name: str, priority: str = "normal", compat: bool = False) -> Session:
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", priority)
        self.spark.sparkContext.setJobGroup(name, f"session {name}", interruptOnCancel=True)
        return self.sessions.setdefault(name, Session(self.spark, compat))

    def cancel(self, name: str) -> None:
        self.spark.sparkContext.cancelJobGroup(name)

    def stats(self) -> dict[str, int]:
        tracker = self.spark.sparkContext.statusTracker()
        return {"sessions": len(self.sessions), "active_jobs": len(tracker.getActiveJobsIds()), "active_stages": len(tracker.getActiveStageIds())}

    def terminate(self) -> None:
        for s in self.sessions.values():
            s.dispose()
        self.sessions.clear()


_default: Pool | None = None


def default_pool(spark: SparkSession) -> Pool:
    global _default
    if _default is None or _default.spark is not spark:
        _default = Pool(spark)
    return _default


def terminate_default_pool() -> None:
    global _default
    if _default is not None:
        _default.terminate()
    _default = None


