"""Entries of ZIP and TAR archives, and compressed files, as rows."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.text import decompress_auto, glob_regex

FIELDS = "archive string, path string, is_dir boolean, size long, content binary"


def entries(spark: SparkSession, path: str, pattern: str | None = None, contents: bool = True) -> DataFrame:
    """A row for each entry of the archives at a path, of those that match a glob. A task for each archive."""
    wanted = re.compile(glob_regex(pattern)) if pattern else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                for name, is_dir, size, data in _entries(content.as_py(), contents):
                    if wanted is None or wanted.search(name):
                        cols = [pa.array([file]), pa.array([name]), pa.array([is_dir]), pa.array([size], pa.int64()), pa.array([data], pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols, names=["archive", "path", "is_dir", "size", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FIELDS)


def _entries(data: bytes, contents: bool) -> Iterator[tuple[str, bool, int, bytes | None]]:
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                yield i.filename, i.is_dir(), i.file_size, z.read(i) if contents and not i.is_dir() else None
    else:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            for m in t:
                held = t.extractfile(m) if contents and m.isfile() else None
                yield m.name, m.isdir(), m.size, held.read() if held else None


def decompressed(spark: SparkSession, path: str) -> DataFrame:
    """Files that are gzip, zlib or raw deflate, told by their bytes: (path, content)."""
    return spark.read.format("binaryFile").load(path).select("path", decompress_auto(F.col("content")).alias("content"))


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files below a folder whose names match: (path, length, modified)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))
