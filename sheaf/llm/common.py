"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and characters that one call of a text function sees at most (a single longer text goes alone).
CHUNK_ROWS, CHUNK_CHARS = 512, 1_000_000

#: Bits of an id filter: 16 for each id, at most 2^28 (32 MB); from some 10^8 ids on it passes more and more others.
FILTER_BITS = 1 << 28

#: White space and words as the contracts define them: ASCII space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where unset (tests, local mode) a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    made = tempfile.mkdtemp(prefix="sheaf-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def settle(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and rows stay as they are
    if executors are lost. The files go when the table is released, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sheaf-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _settled[path] = spark
    found = spark.read.schema(df.schema).parquet(path)
    found._sheaf_path = path  # noqa: SLF001
    return found


#: Paths of settled tables that are still there.
_settled: dict[str, SparkSession] = {}


def release(*tables: DataFrame, collect: bool | SparkSession = False) -> None:
    """Deletes the files of settled tables that nothing reads any more. collect (true, or a session): has the driver drop
    the shuffle files of finished queries too, which otherwise stay until its heap happens to be collected."""
    for df in tables:
        path = getattr(df, "_sheaf_path", None)
        if path in _settled:
            _remove(_settled.pop(path), path)
    if collect:
        gc.collect()
        spark = tables[0].sparkSession if collect is True else collect
        for _ in range(2):  # what the first finds goes only after its references have been cleared
            spark._jvm.System.gc()
            time.sleep(0.3)


@atexit.register
def _release_all() -> None:
    while _settled:
        path, spark = _settled.popitem()
        _remove(spark, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like names that df has not, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def id_filter(ids: DataFrame, name: str) -> Callable[[Column], Column]:
    """A test that is true for every id in a column, and for few others: a hash filter of 16 bits for each id, FILTER_BITS at
    most, gathered as words of 64. What passes it still has to be joined, or must do no harm."""
    n = ids.agg(F.count(F.col(name))).first()[0]
    size = min(FILTER_BITS, 1 << max(16, int(16 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    at = ids.select(place(F.col(name)).alias("p"))
    words = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 64))")).alias("bits")).where("w is not null").toArrow()
    bits = np.zeros(size // 64, dtype=np.int64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy()
    held = ids.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def hit(p):  # noqa: ANN001, ANN202
        at = p.fillna(0).to_numpy().astype(np.int64)
        return type(p)(((held.value[at // 64] >> (at % 64)) & 1 == 1) & p.notna().to_numpy())

    return lambda c: hit(F.when(c.isNotNull(), place(c)))


@contextmanager
def bucketed(df: DataFrame, key: str, unique: bool = False) -> Iterator[DataFrame]:
    """df as a table in the shared folder, in buckets by key: joins on key don't shuffle it. It goes at the end. unique: one
    row for each key."""
    spark = df.sparkSession
    name = f"sheaf_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, key)
    dealt = dealt.dropDuplicates([key]) if unique else dealt
    dealt.write.option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(name)
    atexit.register(_remove, spark, path)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"drop table {name}")
        _remove(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns of df that do not clash (in any case) with names."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def q(name: str) -> str:
    """A column name in backticks."""
    return "`" + name.replace("`", "``") + "`"


def _chunks(batch: pa.RecordBatch, col: str) -> Iterator[pa.RecordBatch]:
    lengths = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (size + n > CHUNK_CHARS or i - start >= CHUNK_ROWS):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


def map_column(df: DataFrame, col: str, fields: T.StructType, make: Callable[[], Callable[[list], Sequence]]) -> DataFrame:
    """df with more columns computed in Python from one text or binary column.

    make() runs once in each task and gives a function from a list of values (None for null) to one sequence
    or Arrow array for each field. Columns of df whose names equal a new one's (in any case) are replaced. Values
    are handed over in small chunks, so that memory doesn't follow the size of an Arrow batch.
    """
    keep = without(df, fields.fieldNames())
    (hidden,) = fresh(df.select(*(F.col(q(c)) for c in keep)), "__value")
    base = df.select(*(F.col(q(c)) for c in keep), F.col(q(col)).alias(hidden))
    out = T.StructType([*(df.schema[c] for c in keep), *fields.fields])
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in fields.fields]
    names = [*keep, *fields.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in _chunks(batch, hidden):
                got = f(part.column(hidden).to_pylist())
                new = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(got, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *new], names=names)

    return base.mapInArrow(run, out)
