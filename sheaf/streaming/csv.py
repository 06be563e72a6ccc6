"""Streams of delimited files, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema: T.StructType | str, delimiter: str = ",", header: bool = True, files_per_trigger: int = 100) -> DataFrame:
    """Files of a folder as they appear. Empty fields are empty texts."""
    df = (
        spark.readStream.schema(schema).option("header", header).option("sep", delimiter).option("escape", '"').option("multiLine", True)
        .option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    )
    texts = {f.name: F.coalesce(F.col(f"`{f.name}`"), F.lit("")) for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.withColumns(texts) if texts else df


def transform(df: DataFrame, columns: dict[str, Column] | None = None, keep: Column | None = None) -> DataFrame:
    """Rows mapped and filtered."""
    df = df.withColumns(columns) if columns else df
    return df.where(keep) if keep is not None else df


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def in_chunks(df: DataFrame, each: Callable[[DataFrame, int], bool | None], checkpoint: str, rejects: tuple[Column, Callable[[DataFrame, int], None]] | None = None, limit: int | None = None) -> StreamingQuery:
    """Calls each(batch, number) for every micro-batch of what is there now; False ends the query. rejects takes the rows that fail
    a condition to another function; limit ends the query after so many rows."""
    state = {"rows": 0, "query": None, "stop": False}

    def run(batch: DataFrame, number: int) -> None:
        if state["stop"]:
            return
        batch.persist()
        try:
            good = batch
            if rejects is not None:
                ok = F.coalesce(rejects[0], F.lit(False))
                rejects[1](batch.where(~ok), number)
                good = batch.where(ok)
            if limit is not None:
                good = good.limit(limit - state["rows"])
                state["rows"] += good.count()
            state["stop"] = each(good, number) is False or (limit is not None and state["rows"] >= limit)
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_stream(df: DataFrame, folder: str, checkpoint: str, header: bool = True) -> StreamingQuery:
    return df.writeStream.format("csv").option("header", header).option("escape", '"').option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(df: DataFrame, time: str, width: str, aggregates: list[Column], by: list[str] | None = None, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Extension: aggregates of event-time windows, late rows beyond the watermark dropped. Works on streams and tables."""
    marked = df.withWatermark(time, late) if df.isStreaming else df
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return marked.groupBy(w.alias("window"), *(by or [])).agg(*aggregates).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "*").drop("window")


def sessions(df: DataFrame, time: str, gap: str, by: list[str], aggregates: list[Column], late: str = "10 minutes") -> DataFrame:
    """Extension: aggregates of sessions, runs of rows of a key without a gap."""
    marked = df.withWatermark(time, late) if df.isStreaming else df
    out = marked.groupBy(F.session_window(time, gap).alias("window"), *by).agg(*aggregates)
    return out.select(F.col("window.start").alias("session_start"), F.col("window.end").alias("session_end"), "*").drop("window")
