import math
from collections import Counter

import numpy as np
import pytest

from sheaf.llm import lm_score, queries


def split(text):
    return (text or "").encode().lower().split()


def plain_model(texts, vocabulary):
    """p(word, previous word) of a model, by counting words and pairs of words one by one."""
    docs = [split(t) for t in texts]
    one = Counter(w for d in docs for w in d)
    two = Counter(p for d in docs for p in zip([None, *d], d, strict=False))
    first = Counter(w for d in docs if d for w in [None, *d])
    size = sum(one.values()) + len(vocabulary) + 1

    def p(w, before):
        own = (one[w] + 1) / size
        return 0.3 * own + 0.7 * two[before, w] / first[before] if first[before] else own

    return p, two, first


def plain(background, target, texts):
    """(tokens, target loss, background loss, score) of each text."""
    vocabulary = {w for t in [*background, *target] for w in split(t)}
    models = [plain_model(x, vocabulary)[0] for x in (target, background)]
    out = []
    for t in texts:
        d = split(t)
        both = [[-math.log(p(w, b)) for b, w in zip([None, *d], d, strict=False)] for p in models]
        means = [sum(x) / len(d) for x in both] if d else [None, None]
        out.append((len(d), *means, means[0] - means[1] if d else None))
    return out


TEXTS = [f"the cat number {i % 3} sat on The mat x{i}" if i % 2 else f"stocks fell {i % 5} percent on the market x{i} y{i}" for i in range(40)] + ["", "lonely", None, "two lonely"]


def same(rows, want):
    assert len(rows) == len(want)
    for r, w in zip(sorted(rows, key=lambda r: r["doc_id"]), want, strict=True):
        got = (r["n_tokens"], r["target_loss"], r["background_loss"], r["score"])
        assert got == tuple(x if x is None else pytest.approx(x, rel=1e-9, abs=1e-12) for x in w)


def test_same_as_counting(spark, make_docs, monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH_CHARS", 200)  # many batches and ranges
    monkeypatch.setattr(lm_score, "RANGE_CHARS", 150)
    labels = spark.createDataFrame([(i, int(i % 2 == 1), 0) for i in range(40)] + [(None, 1, 0), (1, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = make_docs([(i, t, "s") for i, t in enumerate(TEXTS)])
    marked = lm_score.mark_target(docs, labels)
    good = [t for i, t in enumerate(TEXTS) if i % 2 == 1 and i < 40]
    assert sorted(r["text"] for r in marked.where("target").collect()) == sorted(good) and marked.count() == len(TEXTS)
    got = lm_score.score(marked, "target").collect()
    same(got, plain(TEXTS, good, TEXTS))
    assert got[0].asDict().keys() == {*docs.columns, "target", "n_tokens", "target_loss", "background_loss", "score"}
    same(lm_score.score(docs, target=marked.where("target")).collect(), plain(TEXTS, good, TEXTS))


def test_other_background(make_docs):
    more = ["the cat unseen sat", "the mat new words"]
    got = lm_score.score(make_docs(more), target=make_docs(TEXTS[:5]), background=make_docs(TEXTS)).collect()
    same(got, plain(TEXTS, TEXTS[:5], more))


def test_sums_to_one():
    vocabulary = {w for t in TEXTS for w in split(t)}
    p, two, first = plain_model(TEXTS, vocabulary)
    for before in (None, b"the", b"lonely"):
        end = 0.7 * (first[before] - sum(n for (a, _), n in two.items() if a == before)) / first[before]
        assert sum(p(w, before) for w in vocabulary) + p(b"never seen", before) + end == pytest.approx(1)


def test_numbers_survive_planes():
    n = np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64)
    assert (lm_score._numbers(lm_score._planes(n)) == n).all() and len(lm_score._numbers(lm_score._planes(n[:0]))) == 0
    keys = np.sort(n & lm_score.MASK)
    cut = lm_score._cut(keys, 7)
    assert cut[0] == 0 and cut[-1] == 1000 and all((int(k) * 7) >> lm_score.BITS == i for i in range(7) for k in keys[cut[i] : cut[i + 1]])


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = lm_score.score(lm_score.mark_target(odd_docs, labels, "LABEL"), "LABEL").collect()
    assert len(rows) == 8 and all((r["score"] is None) == (r["n_tokens"] == 0) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
    empty = odd_docs.limit(0)
    assert lm_score.score(lm_score.mark_target(empty, labels), "target").count() == 0


def test_query_same_as_counting(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    texts = [t for _, t in docs]
    same(queries.op4_lm_score(spark, sf_dir).collect(), plain(texts, [t for i, t in docs if i in good], texts))


def test_query_tells_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_lm_score(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas().dropna()
    assert got[got.quality == 1].score.mean() < got[got.quality == 0].score.mean()
