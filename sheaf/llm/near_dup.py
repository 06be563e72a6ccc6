"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents of equal shingle sets form a class; classes are what is compared. Each tree of the forest is the order of
all classes by a permutation of their signatures; classes of a region share the shallowest prefix of a tree. A pair at
the threshold is in no common region once in 1.7 million. Links are found in three steps, all confirmed on full sets:

1. Each class meets those of its neighbours of longest common prefix, over all trees, that agree in most hashes. A row
   has two neighbours, so no class is in more than 2 * TREES pairs however crowded its region.
2. In regions of at most REGION classes, all pairs of different components that may be similar enough.
3. Classes in larger regions that still hold several components are compared completely, in blocks: those
   outside the largest component of their cluster of regions with each other and with that component. Full sets are
   compared within a task, which emits the links that connect components, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import bucketed, fresh, id_filter, map_column, q, release, settle

HASHES = 64  # of a signature
TREES = 20
LEAST = 3  # hashes that candidates share at least: the shallowest prefix of a region
FIRST = 2  # neighbours of each class that the first step confirms
REGION = 32  # classes of a region whose pairs are listed; larger regions are compared in blocks
LEAST_EQUAL = 37  # of HASHES; at a similarity of 0.8 fewer are equal once in 500,000 pairs
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 250_000  # expected size of a block of the third step, at most

_rng = np.random.default_rng(20_240_607)
_WORD_FACTORS = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64)
_ORDERS = [_rng.permutation(HASHES).tolist() for _ in range(TREES)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of size words, A-Z lower-cased; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    size = min(size, len(words))
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    n = len(h) - size + 1
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total = _mix(total + h[k : k + n] * _WORD_FACTORS[k % 8])
    return np.unique(total)


def signature(found: np.ndarray) -> bytes:
    """The MinHash signature of a non-empty set, HASHES 16-bit numbers."""
    low = np.full(HASHES, 2**32 - 1, dtype=np.uint64)
    for i in range(0, len(found), 4096):  # bounded memory for very long texts
        h = found[i : i + 4096, None] * _FACTORS + _TERMS
        np.minimum(low, (h >> np.uint64(32)).min(axis=0), out=low)
    return low.astype("<u2").tobytes()


SETS = T.StructType([T.StructField("n_shingles", T.LongType(), False), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.BinaryType())])
FULL = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("shingles", T.BinaryType())])


def _digest(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def add_signatures(df: DataFrame, col: str, size: int) -> DataFrame:
    """df with n_shingles, digest (equal for equal sets; null for an empty one) and signature (null for an empty one)."""

    def make():
        def run(texts):
            sets = [shingles(t, size) for t in texts]
            return [len(s) for s in sets], [_digest(s) for s in sets], [signature(s) if len(s) else None for s in sets]

        return run

    return map_column(df, col, SETS, make)


def add_sets(df: DataFrame, col: str, size: int) -> DataFrame:
    """df with digest and shingles, the sorted 64-bit hashes of the whole set."""

    def make():
        def run(texts):
            sets = [shingles(t, size) for t in texts]
            return [_digest(s) for s in sets], [s.tobytes() for s in sets]

        return run

    return map_column(df, col, FULL, make)


def _bits() -> Column:
    """An array of (tree, region) of a class: hashes of the tree's number and the shallowest prefix."""
    cut = lambda p: F.substring("signature", 2 * p + 1, 2)
    return F.array(*(F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), *(cut(p) for p in order[:LEAST])).alias("region")) for t, order in enumerate(_ORDERS)))


def _regions(busy: DataFrame, *more: str) -> DataFrame:
    """(id, tree, region, *more): the regions of a class that it may share."""
    rows = busy.select("id", "mask", *more, F.explode(_bits()).alias("r")).where(F.expr("shiftright(mask, r.tree) & 1 = 1"))
    return rows.select("id", "r.tree", "r.region", *more)


def _shared(classes: DataFrame) -> DataFrame:
    """(id, mask) of the classes that share a region with another one, with a bit for each tree where they do. Only hashes of
    regions are sorted for this; a row at the end of a batch counts as shared."""
    rows = classes.select("id", F.explode(_bits()).alias("r")).select("id", "r.tree", "r.region")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                region = batch["region"].to_numpy()
                same = region[1:] == region[:-1]
                keep = pa.array(np.concatenate([[True], same]) | np.concatenate([same, [True]]))
                yield batch.select(["id", "tree"]).filter(keep)

    ordered = rows.repartitionByRange("region", "id").sortWithinPartitions("region", "id")
    return ordered.mapInArrow(run, "id long, tree int").groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, tree)")).alias("mask"))


def _bytes(column: pa.Array) -> np.ndarray:
    """The low bytes of signatures."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), HASHES, 2)[:, :, 0]


def _neighbours(busy: DataFrame) -> DataFrame:
    """(a, b), a < b: for each class FIRST of its neighbours in the orders of all trees, those of most agreeing hashes.
    Ranges end between neighbours now and then; the later steps don't depend on these pairs."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 5000):
                part = batch.slice(i, 5000)
                if not len(part):
                    continue
                low, tree = _bytes(part["signature"]), part["tree"].to_numpy()
                keys = np.take_along_axis(low, np.array(_ORDERS)[tree], axis=1)
                yield pa.RecordBatch.from_arrays([part["region"], _binary(keys), part["id"]], names=["region", "key", "id"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            last = pa.RecordBatch.from_arrays([t[c].chunk(0).slice(len(t) - 1) for c in t.column_names], names=t.column_names)
            region, ids = t["region"].to_numpy(), t["id"].to_numpy()
            keys = np.frombuffer(b"".join(t["key"].to_pylist()), dtype=np.uint8).reshape(len(t), HASHES)
            agree = (keys[1:] == keys[:-1]).sum(axis=1)
            at = np.flatnonzero((region[1:] == region[:-1]) & (agree >= LEAST_EQUAL) & (ids[1:] != ids[:-1]))
            both = lambda x, y: pa.array(np.concatenate([x, y]))
            yield pa.RecordBatch.from_arrays([both(ids[at], ids[at + 1]), both(ids[at + 1], ids[at]), both(agree[at], agree[at])], names=["id", "other", "agree"])

    rows = _regions(busy, "signature").mapInArrow(spread, "region long, key binary, id long")
    ordered = rows.repartitionByRange("region", "key", "id").sortWithinPartitions("region", "key", "id")
    found = ordered.mapInArrow(meet, "id long, other long, agree long")
    best = found.groupBy("id").agg(F.slice(F.sort_array(F.collect_set(F.struct("agree", "other")), asc=False), 1, FIRST).alias("near"))
    pairs = best.select("id", F.explode("near").alias("n")).select(F.least("id", "n.other").alias("a"), F.greatest("id", "n.other").alias("b"))
    return pairs.distinct()


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _listed(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of different components in regions of at most REGION classes that agree in enough hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            new = 0 if held is None else len(held)
            t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
            held = t.slice(max(0, len(t) - REGION))
            region, ids, comp = (t[c].to_numpy() for c in ("region", "id", "comp"))
            low = _bytes(t["signature"])
            found = [np.zeros((0, 2), dtype=np.int64)]
            for step in range(1, REGION):
                i = np.arange(max(0, new - step), len(t) - step)  # pairs with a new row
                i = i[(region[i] == region[i + step]) & (comp[i] != comp[i + step])]
                i = i[(low[i] == low[i + step]).sum(axis=1) >= LEAST_EQUAL]
                found.append(np.stack([ids[i], ids[i + step]], axis=1))
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    ordered = rows.select("region", "id", "comp", "signature").repartition("region").sortWithinPartitions("region", "id")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two sets."""

    @F.pandas_udf("long")
    def run(x, y):  # noqa: ANN001, ANN202
        sets = ((np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)) for s, t in zip(x, y, strict=True))
        return type(x)([len(np.intersect1d(u, v, assume_unique=True)) for u, v in sets], dtype="int64")

    return run(a, b)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs whose full sets are similar enough."""
    side = lambda k: sets.select(F.col("id").alias(k), F.col("shingles").alias(f"s{k}"))
    size = lambda k: F.octet_length(f"s{k}") / 8
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where((100 * size("a") >= percent * size("b")) & (100 * size("b") >= percent * size("a")))
    sure = both.withColumn("both", _overlap(F.col("sa"), F.col("sb")))
    return settle(sure.where(100 * F.col("both") >= percent * (size("a") + size("b") - F.col("both"))).select("a", "b"))


def common_counts(a: list[np.ndarray], b: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """len(a) x len(b) sizes of the intersections of sets, by products of their incidence matrices, width elements at a time.
    Elements that only one side has add nothing and are left out."""
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (a, b)]
    flat = [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (a, b)]
    shared = np.intersect1d(*flat)
    places = []
    for r, f in zip(rows, flat, strict=True):
        at = np.minimum(np.searchsorted(shared, f), max(0, len(shared) - 1))
        hit = shared[at] == f if len(shared) else np.zeros(len(f), bool)
        r, at = r[hit], at[hit]
        order = np.argsort(at, kind="stable")
        places.append((r[order], at[order]))
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for start in range(0, len(shared), width):
        part = []
        for (r, at), n in zip(places, (len(a), len(b)), strict=True):
            lo, hi = np.searchsorted(at, (start, start + width))
            m = np.zeros((n, min(width, len(shared) - start)), dtype=np.float32)
            m[r[lo:hi], at[lo:hi] - start] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out.astype(np.int64)


def _block_links(percent: int):  # noqa: ANN202
    """A function from the rows of two blocks (ids, components, sides, sets) to the links that connect their components."""

    def run(t: pa.Table) -> pa.Table:
        ids, comp, side = (t[c].to_numpy() for c in ("id", "comp", "side"))
        sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
        left = np.flatnonzero(side != 1)  # side 2: a block with itself
        right = np.flatnonzero(side != 0)
        size = np.array([len(x) for x in sets])
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        found = []
        for i in range(0, len(left), 256):
            l = left[i : i + 256]
            both = common_counts([sets[k] for k in l], [sets[k] for k in right])
            linked = 100 * both >= percent * (size[l][:, None] + size[right][None] - both)
            linked &= comp[l][:, None] != comp[right][None]
            for x, y in zip(*np.nonzero(linked), strict=True):
                p, o = l[x], right[y]
                u, v = top(int(comp[p])), top(int(comp[o]))
                if u != v:
                    up[u] = v
                    found.append((ids[p], ids[o]))
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})

    return run


def _in_blocks(crowded: DataFrame, busy: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect the components of each cluster of crowded regions. crowded: (region, id, comp, least_comp)."""
    edges = crowded.select(F.col("comp").alias("a"), F.col("least_comp").alias("b")).where("a <> b").distinct()
    clusters = components(edges).select(F.col("id").alias("comp"), F.col("comp").alias("__to"))
    members = crowded.select("id", "comp").distinct().join(busy.select("id", "n_shingles"), "id").join(clusters, "comp", "left")
    members = settle(members.select("id", "comp", "n_shingles", F.coalesce("__to", "comp").alias("cluster")))
    sized = members.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    top = sized.groupBy("cluster").agg(F.max(F.struct("n", "comp", "w")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    parts = lambda n, w: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(w / BLOCK_SHINGLES))
    top = top.select("cluster", F.col("top.comp").alias("main"), parts(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("rest"), parts(F.col("top.n"), F.col("top.w")).alias("mains"))
    rows = members.join(top, "cluster").where("rest > 0")
    pick = lambda n: F.pmod(F.xxhash64("id", F.lit(1)), n).cast("int")
    rows = rows.withColumn("inner", F.col("comp") == F.col("main")).withColumn("k", F.when(F.col("inner"), pick(F.col("mains"))).otherwise(pick(F.col("rest"))))
    # blocks of two kinds meet: of the rest with each other (x <= y), and with those of the largest component (y from rest on)
    cell = lambda x, y, s: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), s.cast("int").alias("side"))
    k, rest = F.col("k"), F.col("rest")
    to_rest = F.transform(F.sequence(F.lit(0).cast("long"), rest - 1), lambda j: cell(F.least(k, j), F.greatest(k, j), F.when(j == k, 2).otherwise((k > j).cast("int"))))
    to_main = F.transform(F.sequence(rest, rest + F.col("mains") - 1), lambda j: cell(k, j, F.lit(0)))
    from_main = F.transform(F.sequence(F.lit(0).cast("long"), rest - 1), lambda j: cell(j, rest + k, F.lit(1)))
    rows = rows.select("cluster", "id", "comp", F.explode(F.when(F.col("inner"), from_main).otherwise(F.concat(to_rest, to_main))).alias("c"))
    full = rows.select("cluster", "c.x", "c.y", "c.side", "id", "comp").join(sets, "id")
    return settle(full.groupBy("cluster", "x", "y").applyInArrow(_block_links(percent), "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(id, comp): for each id that links (a, b) name, the smallest id reachable. Large and small stars alternate, so the
    rounds grow with the logarithm of the longest path; all steps are aggregations and joins that can be split."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = settle(edges), None
    while True:
        # large star: every larger neighbour of u moves to the least of u and its neighbours
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours of u, and u itself, move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        seen = Observation()
        new = settle(small.where("u <> v").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")))
        release(edges)
        edges, now = new, seen.get
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def _merge(comps: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) with components that new links connect made one: only components are compared, not their members."""
    of = lambda k: comps.select(F.col("id").alias(k), F.col("comp").alias(f"c{k}"))
    across = links.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    found = components(across).select(F.col("id").alias("comp"), F.col("comp").alias("__to"))
    return settle(comps.join(found, "comp", "left").select("id", F.coalesce("__to", "comp").alias("comp")))


def _link(busy: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, comp) of the classes of busy (id, mask, signature, n_shingles)."""
    pairs = settle(_neighbours(busy))
    new = _confirm(pairs, sets, percent)
    comps = settle(busy.select("id").join(components(new), "id", "left").select("id", F.coalesce("comp", "id").alias("comp")))
    release(new, collect=True)
    placed = settle(busy.join(comps, "id"))
    rows = _regions(placed, "comp", "signature")
    stats = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("least_comp"), F.max("comp").alias("most"))
    open_ = settle(stats.where("least_comp <> most").select("region", "n", "least_comp"))
    more = _listed(rows.join(open_.where(F.col("n") <= REGION), "region")).join(pairs, ["a", "b"], "left_anti")
    found = _confirm(more, sets, percent)
    release(pairs)
    crowded = settle(rows.drop("signature").join(open_.where(F.col("n") > REGION), "region").select("region", "id", "comp", "least_comp"))
    links = found if crowded.isEmpty() else found.union(_in_blocks(crowded, placed, sets, percent))
    merged = _merge(comps, links)
    release(comps, placed, open_, found, crowded, collect=True)
    return merged


def near_duplicates(df: DataFrame, col: str = "text", doc_id: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of df.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of size-word shingles; a
    component is what links connect, named by its smallest doc_id. Texts that are null or have no word have an empty
    set and are linked with nothing; a text of fewer words is one shingle. Rows of one id and different texts link
    their components. A null doc_id stays alone: component_id null, kept true. An empty table gives an empty one.
    Prefixes and the least number of agreeing hashes suit a percent of 80 or more.
    """
    texts = df.select(F.col(q(doc_id)).cast("long").alias("doc_id"), F.col(q(col)).alias("__text"))
    signed = settle(add_signatures(texts, "__text", size))
    docs = signed.select("doc_id", "n_shingles", "digest")
    member = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    # an id may stand for several classes, so classes have their own number
    classes = signed.where(member).groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = settle(classes.withColumn("id", F.xxhash64("digest")))
    busy = settle(classes.join(_shared(classes), "id"))
    # sets are made again from one text of each class that shares a region; they name their class themselves
    again = texts.where(id_filter(busy, "least")(F.col("doc_id")))
    sets = add_sets(again, "__text", size).select(F.xxhash64("digest").alias("id"), "shingles").where(F.col("shingles") != F.lit(b""))
    with bucketed(sets, "id", unique=True) as sets:
        comps = _link(busy, sets, percent)
    release(busy, collect=True)
    comps = classes.select("id").join(comps.withColumnRenamed("comp", "__comp"), "id", "left").select("id", F.coalesce("__comp", "id").alias("comp"))
    named = comps.join(classes.select("id", "least", "digest"), "id")
    # components by smallest doc_id; an id in several classes ties their components together
    several = docs.where(member).groupBy("doc_id").agg(*(f(F.xxhash64("digest")).alias(n) for f, n in ((F.min, "d"), (F.max, "e")))).where("d <> e").select("doc_id")
    ties = docs.where(member).join(several, "doc_id", "left_semi").distinct().join(named.select("digest", "comp"), "digest")
    tied = settle(ties.select("doc_id", "comp").distinct())
    if not tied.isEmpty():
        first = tied.groupBy("doc_id").agg(F.min("comp").alias("a"))
        more = components(tied.join(first, "doc_id").select("a", F.col("comp").alias("b")).where("a <> b")).select(F.col("id").alias("comp"), F.col("comp").alias("__to"))
        named = named.join(more, "comp", "left").withColumn("comp", F.coalesce("__to", "comp")).drop("__to")
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_class = settle(named.select("digest", "comp").join(names, "comp").select("digest", "component_id"))
    release(classes, tied)
    out = docs.join(by_class, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(df: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row of df for each component: rows whose document isn't kept go, and of rows that share a kept id the one of
    least hash of all its columns stays. Rows with a null id stay."""
    key, gone, many = fresh(df, "key", "gone", "many")
    marks = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((~F.max("kept")).alias(gone), (F.count(F.lit(1)) > 1).alias(many))
    marks = settle(marks.where(F.col(gone) | F.col(many)).withColumnRenamed("doc_id", key))
    marked = df.join(marks, F.col(q(doc_id)) == F.col(key), "left")
    columns = [F.col(q(c)) for c in df.columns]
    alone = marked.where(F.col(key).isNull()).select(*columns)
    repeated = marked.where(F.col(many) & ~F.col(gone))
    if marks.where(F.col(many) & ~F.col(gone)).isEmpty():
        return alone
    row = F.struct(*columns)
    picked = repeated.groupBy(key).agg(F.min_by(row, F.xxhash64(*columns)).alias(gone)).select(f"{gone}.*")
    return alone.union(picked)
