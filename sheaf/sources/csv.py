"""Delimited files as DataFrames.

Options that Spark's own reader covers go to it; without quoted line ends files are split there and read in parallel. All
others are read by the scanner, a file in each task at least.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.coerce import convert_value, value_kind
from sheaf.functions.dates import cast_date
from sheaf.operators.reshape import group_columns
from sheaf.sources.csv_scan import CsvOptions, decode, detect_delimiter, headers_of, scan

HEAD_BYTES = 1 << 20  # of the first file that are read for the delimiter and the headers; more, if no line ends within
RECORD = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("index", T.LongType()),
        T.StructField("line", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("quoted", T.ArrayType(T.BooleanType())),
        T.StructField("raw", T.StringType()),
        T.StructField("fields", T.ArrayType(T.StringType())),
        T.StructField("extra", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("kept", T.BooleanType()),
    ]
)
#: Options that Spark's reader understands alike; any other value than the default sends a file to the scanner.
NATIVE = {"delimiter", "quote", "headers", "encoding", "trim", "ltrim", "rtrim", "skip_empty_lines"}
INFO = "_info"
EXTRA = "_extra"


@dataclass
class CsvResult:
    """Rows, rejected records with their reasons, headers (None without), headers that were renamed, and the delimiter."""

    rows: DataFrame
    rejects: DataFrame
    headers: list[str] | None
    renamed: dict[str, str]
    delimiter: str


def _head(spark: SparkSession, path: str, o: CsvOptions) -> str:
    """The beginning of the first file by path. Files are listed without being read, and one range of one is."""
    row = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").first()
    if row is None:
        return ""
    jvm, n = spark._jvm, HEAD_BYTES
    at = jvm.org.apache.hadoop.fs.Path(row["path"])
    while True:
        stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
        try:
            content = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
        finally:
            stream.close()
        if n >= row["length"] or b"\n" in content or b"\r" in content:
            break
        n *= 8
    return decode(content, dataclasses.replace(o, before_first_chunk=None) if len(content) < row["length"] else o)


def native(o: CsvOptions) -> bool:
    """Whether Spark's reader gives the same rows: blank lines skipped, one quote sign that escapes itself, no policies."""
    default = CsvOptions()
    plain = all(getattr(o, f.name) == getattr(default, f.name) for f in dataclasses.fields(o) if f.name not in NATIVE)
    return plain and o.skip_empty_lines is True and o.headers is True and o.quote == '"' and o.delimiter != ""


def records(spark: SparkSession, path: str, o: CsvOptions, width: int | None) -> DataFrame:
    """The scanner's records of all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                held: list[dict[str, Any]] = []
                for r in scan(decode(content.as_py(), o), o, width):
                    held.append(vars(r) | {"file": file})
                    if len(held) == 4096:
                        yield _batch(held)
                        held = []
                yield _batch(held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)


def _batch(rows: list[dict[str, Any]]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(RECORD)
    return pa.RecordBatch.from_pylist([{n: r[n] for n in schema.names} for r in rows], schema=schema)


def read_csv(
    spark: SparkSession,
    path: str,
    info: bool = False,
    dynamic_typing: bool | Sequence[str] | dict[str, bool | Callable[[Column], Column]] = False,
    cast_dates: bool | Sequence[str] = False,
    group_columns_by_name: bool = False,
    key: str | None = None,
    row_transform: Callable[[DataFrame], DataFrame] | None = None,
    validate: Column | None = None,
    quoted_line_ends: bool = True,
    **options: Any,
) -> CsvResult:
    """Rows of delimited files, all text unless typed.

    info adds _info (index, line, offset, quoted, raw). dynamic_typing types all columns, those listed, or as a dict says.
    key keeps the last row of each value of a column. row_transform maps the table; validate is a condition, rows that
    fail it are rejects. Records with a wrong number of columns are rejects unless less or more say otherwise. Without
    quoted_line_ends Spark's reader may split files; quoted fields must hold no line end then.
    """
    o = CsvOptions(**options)
    head = _head(spark, path, o)
    o = dataclasses.replace(o, delimiter=o.delimiter or detect_delimiter(head, o.quote, o.comment))
    names, renamed = headers_of(head, o)
    if native(o) and not info and names and None not in names:
        rows, rejects = _native(spark, path, o, names, quoted_line_ends)
    else:
        rows, rejects, names = _scanned(spark, path, o, names, info)
    shown = [n for n in rows.columns if n not in (INFO, EXTRA)]
    if cast_dates:
        for n in shown if cast_dates is True else cast_dates:
            rows = rows.withColumn(n, cast_date(F.col(f"`{n}`")))
    if dynamic_typing:
        rows = type_columns(rows, [n for n in shown if isinstance(rows.schema[n].dataType, T.StringType)], dynamic_typing)
    if group_columns_by_name:
        rows = group_columns(rows, renamed)
    if row_transform is not None:
        rows = row_transform(rows)
    if validate is not None:
        good = F.coalesce(validate, F.lit(False))
        bad = rows.where(~good).select(F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"), F.lit("Invalid").alias("error"), F.lit("validation failed").alias("message"), F.to_json(F.struct(*rows.columns)).alias("raw"))
        rows, rejects = rows.where(good), rejects.unionByName(bad)
    if key is not None:
        from sheaf.operators.ordering import ROW, with_row
        from sheaf.operators.reshape import last_by_key

        rows = last_by_key(with_row(rows), key, ROW)
    return CsvResult(rows, rejects, [n for n in names if n is not None] if names is not None else None, renamed, o.delimiter)


def _native(spark: SparkSession, path: str, o: CsvOptions, names: list[str], quoted_line_ends: bool) -> tuple[DataFrame, DataFrame]:
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("__bad", T.StringType())])
    df = (
        spark.read.schema(schema)
        .option("header", True).option("enforceSchema", True).option("sep", o.delimiter).option("quote", o.quote).option("escape", o.quote).option("multiLine", quoted_line_ends)
        .option("encoding", o.encoding).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").option("maxCharsPerColumn", -1).option("columnPruning", False)
        .option("ignoreLeadingWhiteSpace", o.trim or o.ltrim).option("ignoreTrailingWhiteSpace", o.trim or o.rtrim)
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias("__file"))
    )
    some = F.length(F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))) >= 0  # a query may not read the fault column alone
    rows = df.where(some & F.col("__bad").isNull()).select(*(F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names))
    wide = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)])
    cells = F.from_csv("__bad", wide.simpleString()[7:-1].replace(":", " "), {"sep": o.delimiter, "quote": o.quote, "escape": o.quote, "nullValue": "\u0001"})
    many = cells[f"c{len(names)}"].isNotNull()
    message = F.when(many, f"more than {len(names)} columns").otherwise(f"fewer than {len(names)} columns")
    bad = df.where(some & F.col("__bad").isNotNull()).select(F.col("__file").alias("file"), F.lit(None).cast("long").alias("line"), F.when(many, "TooManyFields").otherwise("TooFewFields").alias("error"), message.alias("message"), F.col("__bad").alias("raw"))
    return rows, bad


def _scanned(spark: SparkSession, path: str, o: CsvOptions, names: list[str | None] | None, info: bool) -> tuple[DataFrame, DataFrame, list[str | None] | None]:
    found = records(spark, path, o, len(names) if names else None)
    good = found.where("kept")
    if names is None:
        n = good.agg(F.max(F.size("fields"))).first()[0] or 0
        names_ = [f"_c{i}" for i in range(n)]
    else:
        names_ = names
    cells = [F.get("fields", i).alias(n) for i, n in enumerate(names_) if n is not None and n != "__proto__"]
    more = [F.col("extra").alias(EXTRA)] if o.more == "keep" else []
    if info:
        more.append(F.struct("index", "line", "offset", "quoted", "raw").alias(INFO))
    rejects = found.where("error is not null and not kept").select("file", "line", "error", "message", "raw")
    return good.select(*cells, *more), rejects, names


def type_columns(df: DataFrame, columns: Sequence[str], how: bool | Sequence[str] | dict[str, Any] = True) -> DataFrame:
    """Text columns as the narrowest of boolean, double and text that fits all their values; one aggregation for all.

    A column of nothing but empty texts stays text; a callable in a dict maps its column."""
    chosen = {c: True for c in columns} if how is True else {c: True for c in how} if not isinstance(how, dict) else {c: how[c] for c in columns if how.get(c)}
    plain = [c for c, v in chosen.items() if v is True]
    if plain:
        kinds = df.agg(*(F.collect_set(value_kind(F.col(f"`{c}`"))).alias(c) for c in plain)).first()
    out = {}
    for c, v in chosen.items():
        col = F.col(f"`{c}`")
        if callable(v):
            out[c] = v(col)
            continue
        found = set(kinds[c]) - {"null"}
        out[c] = convert_value(col, "boolean" if found == {"boolean"} else "number" if found == {"number"} else "text")
    return df.withColumns(out)


def read_fast(spark: SparkSession, path: str, delimiter: str = ",", headers: bool = True) -> DataFrame:
    """Files without quotes, split at any line end. The first line of each file is its header, if it has headers; no other."""
    head = _head(spark, path, CsvOptions(delimiter=delimiter)).splitlines()
    first = next((x for x in head if x), "")
    names = first.split(delimiter) if first else []
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    df = (
        spark.read.schema(schema).option("header", headers).option("enforceSchema", True).option("sep", delimiter).option("quote", "").option("escape", "")
        .option("maxCharsPerColumn", -1).option("maxColumns", max(20480, len(names) + 1)).csv(path)
    )
    return df.select(*(F.coalesce(F.col(f"c{i}"), F.lit("")).alias(n if headers else f"_c{i}") for i, n in enumerate(names)))
