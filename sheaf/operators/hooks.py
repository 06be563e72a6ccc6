"""Python hooks over rows: the slow path, in Arrow batches, for what columns can't say."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def map_rows(df: DataFrame, each: Callable[[dict[str, Any]], dict[str, Any] | None], schema: T.StructType | str) -> DataFrame:
    """Rows that a function makes of df's rows; None drops a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [r for r in map(each, batch.to_dict("records")) if r is not None]
            yield pd.DataFrame(made, columns=names)

    names = [f.name for f in (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)).fields]
    return df.mapInPandas(run, schema)


def validate_rows(df: DataFrame, test: Callable[[dict[str, Any]], bool | tuple[bool, str]]) -> tuple[DataFrame, DataFrame]:
    """df split by a function that says whether a row is good, or that and why not: good rows, and rejects with _reason."""
    schema = T.StructType([*df.schema.fields, T.StructField("_ok", T.BooleanType()), T.StructField("_reason", T.StringType())])

    def judged(row: dict[str, Any]) -> dict[str, Any]:
        said = test(row)
        ok, reason = said if isinstance(said, tuple) else (said, "validation failed")
        return row | {"_ok": bool(ok), "_reason": None if ok else reason}

    both = map_rows(df, judged, schema)
    return both.where("_ok").drop("_ok", "_reason"), both.where(~F.col("_ok")).drop("_ok")


def converter(each: Callable[[Any], Any], kind: str) -> Callable[[Column], Column]:
    """A function of values as a function of columns; null is passed to it too."""

    @F.pandas_udf(kind)
    def run(s):  # noqa: ANN001, ANN202
        return s.map(each)

    return run


def observed(df: DataFrame, name: str = "progress", **measures: Column) -> tuple[DataFrame, Any]:
    """df, and an observation whose get gives row counts and other measures once an action on df has ended."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in measures.items())), seen


def iterate(df: DataFrame) -> Iterator[dict[str, Any]]:
    """Rows one by one, a partition at a time on the driver; leaving the loop leaves the rest unread."""
    for r in df.toLocalIterator(prefetchPartitions=False):
        yield r.asDict()
