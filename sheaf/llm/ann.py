"""Nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order. Blocks of vectors post themselves in one inverted file
for each pivot, with the place that the pivot has for them. A query reads the files of its own nearest pivots, ranks
the block's vectors by the footrule distance of the two orders, and scores the best share of them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import q, settle

PIVOTS = 256  # vectors that the pivots are sampled from: these many, by hash of the id
PLACES = 64  # nearest pivots that represent a vector
SHARE = 0.15  # of a block's vectors that are scored exactly, by footrule distance, whatever the block's size
BLOCK = 4096  # vectors that share inverted files
QUERIES = 16_384  # queries that are sent to all blocks at once


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


@dataclass
class Index:
    """Inverted files of one block."""

    ids: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    starts: np.ndarray  # of each pivot's file
    rows: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray) -> Index:
        order = nearest_pivots(vectors, pivots)
        n, length = order.shape
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        starts = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))
        return cls(ids, vectors, norms(vectors), starts, by_pivot // length, by_pivot % length)

    def ranked(self, order: np.ndarray, least: int) -> np.ndarray:
        """Rows of smallest footrule distance to an order of pivots, those that will be scored: at least so many, if there are."""
        n, length = len(self.ids), len(order)
        take = min(n, max(least, int(np.ceil(SHARE * n))))
        # pivots that only one of the two orders has stand at place length; what a shared pivot saves of that distance:
        rows, saved = [], []
        for place, pivot in enumerate(order):
            part = slice(self.starts[pivot], self.starts[pivot + 1])
            rows.append(self.rows[part])
            saved.append(2 * (length - np.maximum(self.places[part], place)))
        score = np.bincount(np.concatenate(rows), weights=np.concatenate(saved), minlength=n)
        return np.argpartition(-score, take - 1)[:take]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that the largest component is about 1: cosines stay the same, to the last bit unless
    components vanish beside it, and squares neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1][:, None])


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The PLACES nearest pivots of each vector, nearest first. pivots have length 1."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :PLACES]


def search(df: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine found for each query, a row whose id is divisible
    by every, among all rows but those of its own id; ties go to the smaller id.

    Rows with a null id, vectors that are null or zero, or that hold null or non-finite components take no part, nor do
    those of another length than the most common one (of several, the smallest). Repeated rows count once. Of equal
    vectors only the k + 1 of smallest id can be among the results, so no more are indexed. With fewer than k
    candidates all are returned; an empty table gives an empty result. Other columns don't matter.
    """
    spark = df.sparkSession
    rows = df.select(F.col(q(vec_id)).cast("long").alias("vec_id"), F.col(q(vector)).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vector") == (length["n"] if length else 0)).distinct()
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    kept = settle(rows.withColumn("place", place).where(F.col("place") <= k + 1))
    sample = kept.where("place = 1").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    pivots = np.array([r["vector"] for r in sample]).reshape(len(sample), length["n"] if length else 0)
    pivots = scaled(pivots)
    pivots = pivots / norms(pivots)[:, None]
    asked = rows.where(F.col("vec_id") % every == 0)
    asked = settle(asked)
    blocks = -(-asked.count() // QUERIES)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks)))
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for b in range(blocks):  # the driver holds one bounded block at a time
        found = found.union(_scan(kept, pivots, asked.where(part == b), k))
    return found


def _scan(kept: DataFrame, pivots: np.ndarray, queries: DataFrame, k: int) -> DataFrame:
    """The results of a block of queries, as a table of its own."""
    t = queries.select("vec_id", "vector").toArrow()
    ids, vectors = t["vec_id"].to_numpy(), scaled(_matrix(t["vector"]))
    held = kept.sparkSession.sparkContext.broadcast((pivots, ids, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, asked, vectors = held.value
        orders, sizes = nearest_pivots(vectors, pivots), norms(vectors)
        best: list[list[tuple[float, int]]] = [[] for _ in asked]

        def meet(index: Index) -> None:
            for i, (own, order) in enumerate(zip(asked, orders, strict=True)):
                near = index.ranked(order, k + 1)  # one may be the query itself
                near = near[index.ids[near] != own]
                # summed row by row, so that equal vectors get equal scores
                score = (index.vectors[near] * vectors[i]).sum(axis=1) / (index.norms[near] * sizes[i])
                if len(near) > k:
                    least = np.partition(score, -k)[-k]
                    near, score = near[score >= least], score[score >= least]
                new = sorted(zip((-score).tolist(), index.ids[near].tolist(), strict=True))[:k]
                best[i] = sorted({*best[i], *new})[:k]

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            for j in range(0, len(batch), BLOCK):
                waiting.append(batch.slice(j, BLOCK))
                if sum(map(len, waiting)) >= BLOCK:
                    meet(_index(waiting, pivots))
                    waiting = []
        if waiting and sum(map(len, waiting)):
            meet(_index(waiting, pivots))
        out = [(int(own), v, -s) for own, found in zip(asked, best, strict=True) for s, v in found]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = kept.select("vec_id", "vector").mapInArrow(run, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    done = settle(found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    held.destroy()
    return done


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    parts = [b.flatten().to_numpy().reshape(len(b), -1) for b in vectors.chunks if len(b)]
    return np.concatenate(parts) if parts else np.zeros((0, 0))


def _index(batches: list[pa.RecordBatch], pivots: np.ndarray) -> Index:
    t = pa.Table.from_batches(batches)
    return Index.of(t["vec_id"].to_numpy(), scaled(_matrix(t["vector"])), pivots)
