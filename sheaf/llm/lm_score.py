"""Language-model scores by cross-entropy difference.

Two bigram models, of target documents and of the background (by default all documents), share one vocabulary and one
smoothing. A document's score is the mean over its tokens of the target's loss less the background's: lower means nearer
to the target. Every word and every bigram counts, however rare, so the models grow with the corpus.

The probability of a word after another one (or a document's start) is MIX parts of its share of what followed there,
and the rest of the words' own shares, counts increased by one and one more entry for unseen words; after a word that the
model never saw, the words' own shares alone. It sums to one over words, the unseen entry and the end.

The models are never in one place. Documents are dealt into batches; each sends its distinct words and bigrams, as sorted
hashes with their counts, to the range of hashes that they fall in, and gets the totals back in the same order. A
key is in a batch once, so frequent words and bigrams are no more work for a range than rare ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import fresh, q, release, settle, without

MIX = 0.7  # weight of the bigram estimate
BATCH_CHARS, BATCH_ROWS = 4_000_000, 50_000  # of a batch, unless one text is longer
RANGE_CHARS = 4_000_000  # of all texts for each range of hashes
BITS = 56  # of a hash that are sent
MASK = np.uint64(2**BITS - 1)
START = np.uint64(2)  # stands before a document's first word


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def encode(text: str | None) -> np.ndarray:
    """Even hashes of a text's tokens."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words(text)], dtype=np.uint64) & MASK & ~np.uint64(1)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Odd hashes of bigrams of two tokens each."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) & MASK) | np.uint64(1)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, the words before them or START, number of words of each text), the texts one after another."""
    parts = [encode(t) for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    cur = np.concatenate([*parts, np.zeros(0, np.uint64)])
    prev = np.concatenate([[START], cur[:-1]]) if len(cur) else cur
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    prev[starts] = START
    return cur, prev, sizes


def counts(texts: list[str | None], marked: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of the texts' words, bigrams and starts, how often each occurs, and how often in marked texts."""
    cur, prev, sizes = tokens(texts)
    every = np.concatenate([cur, np.full(int((sizes > 0).sum()), START), pair_keys(prev, cur)])
    keys, place, n = np.unique(every, return_inverse=True, return_counts=True)
    if marked is None or not any(marked):
        return keys, n, np.zeros(len(keys), np.int64)
    text = np.array(marked, dtype=bool)
    token = np.repeat(text, sizes)
    return keys, n, np.bincount(place[np.concatenate([token, text[sizes > 0], token])], minlength=len(keys))


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers, compressed with all first bytes first, then all second ones."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(planes), np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def _cut(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal ranges of hashes begins among sorted keys, and the end."""
    borders = np.array([i * 2**BITS // ranges for i in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, borders), [len(keys)]]).astype(np.int64)


PART = "part int, batch long, keys binary, base binary, target binary"


def _parts(batch: int, keys: np.ndarray, base: np.ndarray, target: np.ndarray, ranges: int) -> pa.RecordBatch:
    """A row for each range: differences of the sorted keys there, and their counts."""
    cut = _cut(keys, ranges)
    rows = [(i, *map(_planes, (np.diff(keys[a:b], prepend=np.uint64(0)), base[a:b], target[a:b]))) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
    column = lambda k: pa.array([x[k] for x in rows], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([batch] * len(rows), pa.int64()), column(1), column(2), column(3)], names=["part", "batch", "keys", "base", "target"])


def _chunks(batches: Iterator[pa.RecordBatch], col: str) -> Iterator[pa.Table]:
    """Rows of a task in pieces of bounded size."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for batch in batches:
        lengths = [len(x) if x else 0 for x in batch.column(col).to_pylist()]
        first = 0
        for i, n in enumerate(lengths):
            if rows and (size + n > BATCH_CHARS or rows >= BATCH_ROWS):
                yield pa.Table.from_batches([*held, batch.slice(first, i - first)])
                held, first, size, rows = [], i, 0, 0
            size, rows = size + n, rows + 1
        if len(batch) > first:
            held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _dealt(df: DataFrame, text: str) -> DataFrame:
    """(batch, chars, docs): df in batches, as Arrow streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, t in enumerate(_chunks(batches, text)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(t)
            chars = sum(len(x) for x in t.column(text).to_pylist() if x)
            yield pa.RecordBatch.from_pydict({"batch": [first + i], "chars": [chars], "docs": [sink.getvalue().to_pybytes()]})

    return df.mapInArrow(run, "batch long, chars long, docs binary")


def _sent(texts: DataFrame, ranges: int, target: bool) -> DataFrame:
    """Counts of a column text for one of the models, whose totals nobody waits for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, "text"):
            keys, n, none = counts(t.column("text").to_pylist())
            yield _parts(-1, keys, none if target else n, n if target else none, ranges)

    return texts.select("text").mapInArrow(run, PART)


def _totals(t: pa.Table) -> pa.Table:
    """For each batch of a range its keys' totals in both models, in its order; and with batch -1 the range's sums."""
    keys = [np.cumsum(_numbers(x), dtype=np.uint64) for x in t["keys"].to_pylist()]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([len(k) for k in keys])
    total = []
    for side in ("base", "target"):
        given = [_numbers(x) for x in t[side].to_pylist()]
        total.append(np.bincount(place, weights=np.concatenate(given).astype(float), minlength=len(every)).astype(np.uint64))
    rows = []
    for batch, a, b in zip(t["batch"].to_pylist(), np.append(0, ends[:-1]), ends, strict=True):
        if batch >= 0:
            rows.append((batch, _planes(total[0][place[a:b]]), _planes(total[1][place[a:b]]), None, None, None))
    word = (every & np.uint64(1) == 0) & (every != START)
    seen = word & (total[0] + total[1] > 0)
    rows.append((-1, None, None, int(seen.sum()), int(total[0][word].sum()), int(total[1][word].sum())))
    part = t["part"][0].as_py()
    names = ["batch", "base", "target", "words", "base_tokens", "target_tokens"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    columns = {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, types, strict=True))}
    return pa.table({"part": pa.array([part] * len(rows), pa.int32()), **columns})


TOTALS = "part int, batch long, base binary, target binary, words long, base_tokens long, target_tokens long"


def losses(texts: list[str | None], totals: list[np.ndarray], sums: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Token x 2 losses in nats (background, target) of texts one after another, and the number of tokens of each.

    totals: for both models the totals of counts(texts)' keys. sums: tokens and entries of each model's vocabulary."""
    cur, prev, sizes = tokens(texts)
    keys = counts(texts)[0]
    at = [np.searchsorted(keys, k) for k in (cur, prev, pair_keys(prev, cur))]
    out = np.zeros((len(cur), 2))
    for k, (n, all_) in enumerate(zip(totals, sums, strict=True)):
        word, first, both = (n[i].astype(float) for i in at)
        own = (word + 1) / all_
        out[:, k] = -np.log(np.where(first > 0, (1 - MIX) * own + MIX * both / np.maximum(first, 1), own))
    return out, sizes


SCORED = T.StructType([T.StructField("n_tokens", T.LongType(), False), T.StructField("target_loss", T.DoubleType()), T.StructField("background_loss", T.DoubleType()), T.StructField("score", T.DoubleType())])


def _means(loss: np.ndarray, sizes: np.ndarray) -> list[list[float] | None]:
    out, start = [], 0
    for n in sizes:
        part = loss[start : start + n]
        out.append([*part.mean(axis=0).tolist(), float((part[:, 1] - part[:, 0]).mean())] if n else None)
        start += n
    return out


def score(df: DataFrame, mark: str | None = None, target: DataFrame | None = None, background: DataFrame | None = None, col: str = "text") -> DataFrame:
    """df with n_tokens, target_loss, background_loss (means for each token, in nats) and score, their difference.

    The target are the texts of df's rows with a true column mark, and those of target; target and background have
    a column text. Without background the texts of df are it. All new columns but n_tokens are null for texts that are null
    or have no word. Equal texts get equal scores. Without target texts the target model gives each word the
    same share; null texts and null marks count nothing. An empty table gives an empty one. Columns of df with one
    of the new names, in any case, are replaced.
    """
    keep = without(df, SCORED.fieldNames())
    rest = df.select(*(F.col(q(c)) for c in keep))
    text, marked = fresh(rest, "text", "marked")
    flag = F.coalesce(F.col(q(mark)).cast("boolean"), F.lit(False)) if mark else F.lit(False)
    base = settle(_dealt(df.select(*(F.col(q(c)) for c in keep), F.col(q(col)).alias(text), flag.alias(marked)), text))
    release(collect=df.sparkSession)
    chars = base.agg(F.sum("chars")).first()[0] or 0
    if background is not None:
        chars += background.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(1, math.ceil(chars / RANGE_CHARS))
    alone = background is None

    def read(stream: bytes) -> pa.Table:
        return pa.ipc.open_stream(stream).read_all()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, stream in zip(batch["batch"], batch["docs"], strict=True):
                docs = read(stream.as_py())
                keys, n, t = counts(docs.column(text).to_pylist(), docs.column(marked).to_pylist())
                yield _parts(number.as_py(), keys, n if alone else 0 * n, t, ranges)

    parts = base.select("batch", "docs").mapInArrow(send, PART)
    for more, is_target in ((target, True), (background, False)):
        if more is not None:
            parts = parts.union(_sent(more, ranges, is_target))
    found = settle(parts.groupBy("part").applyInArrow(_totals, TOTALS))
    release(collect=df.sparkSession)
    size, *all_ = (x or 0 for x in found.agg(F.sum("words"), F.sum("base_tokens"), F.sum("target_tokens")).first())
    sums = [float(n + size + 1) for n in all_]
    fields = T.StructType([*(df.schema[c] for c in keep), *SCORED.fields])
    names = fields.fieldNames()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = read(left["docs"][0].as_py())
        texts = docs.column(text).to_pylist()
        right = right.sort_by("part")
        totals = [np.concatenate([np.zeros(0, np.uint64), *map(_numbers, right[c].to_pylist())]) for c in ("base", "target")]
        got, sizes = losses(texts, totals, sums)
        means = _means(got, sizes)
        side = lambda k: pa.array([m[k] if m else None for m in means], pa.float64())
        new = [pa.array(sizes, pa.int64()), side(1), side(0), side(2)]
        return pa.Table.from_arrays([*(docs.column(i) for i in range(len(keep))), *new], names=names)

    totals = found.where("batch >= 0").select("batch", "part", "base", "target")
    return base.groupBy("batch").cogroup(totals.groupBy("batch")).applyInArrow(finish, fields)


def mark_target(docs: DataFrame, labels: DataFrame, name: str = "target", doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """docs with a boolean column of that name: whether the document has a label of 1 for its id. A null id has none."""
    (key,) = fresh(docs, "key")
    good = labels.where((F.col(q(label)) == 1) & F.col(q(doc_id)).isNotNull()).select(F.col(q(doc_id)).alias(key)).distinct()
    rest = [F.col(q(c)) for c in without(docs, [name])]
    return docs.join(good.hint("merge"), F.col(q(doc_id)) == F.col(key), "left").select(*rest, F.col(key).isNotNull().alias(name))
