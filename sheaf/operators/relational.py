"""Joins, lookups and set operations. All but the lookups are extensions of this library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.address import Range


def lookup(df: DataFrame, dictionary: DataFrame, key: str, index: str, value: str, out: str) -> DataFrame:
    """df with the dictionary's value for each key (shared strings, styles, hyperlinks). The planner broadcasts the
    dictionary if it is small."""
    side = dictionary.select(F.col(f"`{index}`").alias("__index"), F.col(f"`{value}`").alias(out))
    return df.join(side, F.col(f"`{key}`") == F.col("__index"), "left").drop("__index")


def range_lookup(df: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Rows joined with the ranges [low, high] that hold their value.

    Both sides are cut into bins of a width: a range stands in each bin that it touches, so the join is on equal bins
    and then tested exactly.
    """
    bins = lambda c: F.floor(c / F.lit(width)).cast("long")
    wide = ranges.withColumn("__bin", F.explode(F.sequence(bins(F.col(low)), bins(F.col(high)))))
    keyed = df.withColumn("__bin", bins(F.col(value)))
    hit = (keyed["__bin"] == wide["__bin"]) & F.col(value).between(F.col(low), F.col(high))
    return keyed.join(wide, hit, how).drop("__bin")


def fill_merges(cells: DataFrame, merges: Sequence[Range], value: str = "value") -> DataFrame:
    """(row, col, value) cells with each merged cell's master value."""
    spark = cells.sparkSession
    corners = spark.createDataFrame([(m.top, m.left, m.bottom, m.right) for m in merges], "__top int, __left int, bottom int, right int")
    slaves = corners.withColumn("row", F.explode(F.sequence("__top", "bottom"))).withColumn("col", F.explode(F.sequence("__left", "right"))).drop("bottom", "right")
    masters = cells.select(F.col("row").alias("__top"), F.col("col").alias("__left"), F.col(value).alias("__master"))
    filled = slaves.join(masters, ["__top", "__left"], "left").select("row", "col", "__master")
    both = cells.join(filled, ["row", "col"], "full")
    return both.withColumn(value, F.coalesce("__master", value)).drop("__master")


def overlapping(ranges: Sequence[Range]) -> list[tuple[Range, Range]]:
    return [(a, b) for i, a in enumerate(ranges) for b in ranges[i + 1 :] if a.intersects(b)]


def join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    return left.join(right, list(on), how)


def as_of_join(left: DataFrame, right: DataFrame, time: str, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """left with right's columns as they were last at or before each row's time, within by: one union, one sort by key and
    time, the last values carried on."""
    carried = F.struct(*(F.col(f"`{c}`") for c in columns))
    a = left.withColumns({"__side": F.lit(1), "__seen": F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType)})
    b = right.select(*by, time, F.lit(0).alias("__side"), carried.alias("__seen"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.col(time), F.col("__side")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__seen", F.last("__seen", ignorenulls=True).over(w)).where("__side = 1")
    return out.select(*left.columns, *(F.col(f"__seen.`{c}`").alias(c) for c in columns))


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are spread over salts tasks; the other side is repeated for each salt."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the repeated side can't be kept whole")
    # a hash of the row, not chance: a task that is run again deals its rows as before
    whole = [F.col(f"`{c}`") for c in big.columns if "map<" not in big.schema[c].dataType.simpleString()]
    a = big.withColumn("__salt", F.pmod(F.xxhash64(*whole), F.lit(salts)).cast("int"))
    b = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, "__salt"], how).drop("__salt")


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def intersect(a: DataFrame, b: DataFrame, all_: bool = False) -> DataFrame:
    return a.intersectAll(b) if all_ else a.intersect(b)


def subtract(a: DataFrame, b: DataFrame, all_: bool = False) -> DataFrame:
    return a.exceptAll(b) if all_ else a.subtract(b)


def grouping_sets(df: DataFrame, sets: str, columns: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """rollup or cube over columns."""
    return getattr(df, sets)(*columns).agg(*aggregates)
