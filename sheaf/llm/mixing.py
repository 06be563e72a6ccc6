"""Mixing sources to target weights by systematic sampling.

Within a source every document expects target / source size copies. Documents are put in an order (by size, so that
the words taken stay near the target; then by a hash), expected copies are summed up along it from one random offset,
and a document is emitted once for each integer that its share of the sum crosses.

The prefix sum needs only ranks, and those are built from counts: a source's documents of one size start after its
smaller ones, and within a size after those of lower hash bucket. So no task ever holds a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import fresh, q, settle, without, WORD

BUCKETS = 512  # parts of the documents of one source and size
ADDED = ("size", "source_size", "target", "copies")


def word_count(text: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(q(text)), F.lit(WORD)), F.lit(0)).cast("long")


def global_rank(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """df with out: its rank from 0 by keys, over all rows. Ranges are numbered apart; the driver sees one count for
    each range."""
    parts = settle(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()))
    counts = sorted((r["__range"], r["n"]) for r in parts.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect())
    before, firsts = 0, []
    for part, n in counts:
        firsts += [F.lit(part), F.lit(before)]
        before += n
    if not firsts:
        return parts.withColumn(out, F.lit(0).cast("long")).drop("__range")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return parts.withColumn(out, inside - 1 + F.create_map(*firsts)[F.col("__range")]).drop("__range")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """From (__null, __source, source_size), a row for each source, the same with target.

    Sources by code point, null last, weigh weights in turn and share the sum of all sizes. No target exceeds most
    times its source's size: the excess is shared again by weight until none is above.
    """
    ranked = global_rank(sizes, ["__null", "__source"], "__rank")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = settle(ranked.withColumn("__weight", weight).drop("__rank"))
    cap = F.lit(most) * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        full = cap <= F.lit(level) * F.col("__weight") if capped >= 0 else F.lit(False)
        got = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("held"),
            F.sum(F.when(~full, F.col("__weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if got["n"] == capped or not got["open"]:
            break
        capped, level = got["n"], (total - most * got["held"]) / got["open"]
    return ranked.withColumn("target", F.least(cap, F.lit(level) * F.col("__weight")).cast("double")).drop("__weight")


def mix(df: DataFrame, size: str = "size", source: str = "source", doc_id: str = "doc_id", weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 0) -> DataFrame:
    """df with source_size, target (double) and copies (long): how often the mix takes each row.

    Null sources are one source, the last; null sizes count as 0. Rows of equal id are told apart by chance only if
    their sizes agree too: then the hash of all their columns orders them, and rows that are equal are alike. Reruns
    agree: the offset is a hash of seed and source. A source of
    size 0 has target 0 and no copies. An empty table gives an empty one. Columns of df with a new name are replaced.
    """
    keep = without(df, ADDED[1:])
    kept = [f"__keep{i}" for i in range(len(keep))]  # no name of the caller's meets one of ours
    hashable = [F.col(q(c)) for c in keep if "map<" not in df.schema[c].dataType.simpleString()]
    base = df.select(
        *(F.col(q(c)).alias(k) for c, k in zip(keep, kept, strict=True)),
        F.col(q(source)).isNull().alias("__null"),
        F.coalesce(F.col(q(source)).cast("string"), F.lit("")).alias("__source"),
        F.coalesce(F.col(q(size)).cast("long"), F.lit(0)).alias("__size"),
        F.pmod(F.xxhash64(F.col(q(doc_id)), F.lit(seed)), F.lit(BUCKETS)).cast("int").alias("__bucket"),
        F.col(q(doc_id)).alias("__id"),
        F.xxhash64(*hashable).alias("__hash"),
    )
    own = ["__null", "__source"]
    cells = settle(base.groupBy(*own, "__size", "__bucket").agg(F.count(F.lit(1)).alias("__n")))
    by_size = cells.groupBy(*own, "__size").agg(F.sum("__n").alias("__n"))
    targets = source_targets(by_size.groupBy(*own).agg(F.sum(F.col("__n") * F.col("__size")).alias("source_size")), weights, most)

    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = by_size.withColumn("__smaller", F.coalesce(F.sum("__n").over(before(*own, "__size")), F.lit(0))).drop("__n")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), *own), F.lit(1 << 52)) / F.lit(float(1 << 52))
    sizes = sizes.join(targets.withColumns({"__share": share, "__offset": offset}), own)
    inside = F.coalesce(F.sum("__n").over(before(*own, "__size", "__bucket")), F.lit(0))
    starts = cells.withColumn("__lower", inside).drop("__n").join(sizes, [*own, "__size"])

    rank = F.row_number().over(Window.partitionBy(*own, "__size", "__bucket").orderBy("__id", "__hash")) + F.col("__smaller") + F.col("__lower")
    crossed = lambda r: F.floor(F.col("__offset") + F.col("__share") * r)
    copies = F.least(crossed(rank) - crossed(rank - 1), F.ceil(F.col("__share"))).cast("long")
    placed = base.join(starts, [*own, "__size", "__bucket"]).withColumn("copies", copies)
    return placed.select(*(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), "source_size", "target", "copies")


def emit(mixed: DataFrame) -> DataFrame:
    """Rows of mix(), each as many times as its copies say, without the columns that mix() added."""
    rest = without(mixed, ADDED[1:])
    (copy,) = fresh(mixed, "copy")
    taken = mixed.where(F.col("copies") > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*(F.col(q(c)) for c in rest))
