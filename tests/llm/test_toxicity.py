import zlib

import numpy as np
from pyspark.sql import functions as F

from sheaf.llm import queries, toxicity


def test_features_see_hidden_insults():
    names = toxicity.NAMES
    get = lambda t, n: toxicity.features(t)[names.index(n)]
    assert get("you are an idiot", "log_hits") > 0 and get("you are an idiot", "near_you") == 1
    for hidden in ("an 1d10t here", "an id*ot here", "an i.d.i.o.t here", "an idiooooot here", "s t u p i d thing"):
        assert get(hidden, "log_hidden") > 0, hidden
    assert get("a fine day moron### indeed", "log_hits") > 0
    assert toxicity.features(None) == toxicity.features("")
    assert get("WHY", "capitals") == 1


def test_isotonic_pools():
    knots, means = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert list(means) == [0.0, 0.5, 1.0] and np.all(np.diff(knots) > 0)


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    p = toxicity.sigmoid(3 * np.sign(x[:, 0] * x[:, 1]) - 1)
    y = (rng.random(4000) < p).astype(float)
    model = toxicity.fit(x[:3000], y[:3000])
    s = model.score(x[3000:])
    assert np.mean((s >= 0.5) == (p[3000:] >= 0.5)) > 0.95 and abs(s.mean() - p[3000:].mean()) < 0.03


def test_trees_and_scores_as_by_walking_each_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)).round(1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.3).astype(float)
    model = toxicity.fit(x, y)

    def walk(row):
        z = model.trees.start
        for column, cut, leaf in zip(model.trees.column, model.trees.cut, model.trees.leaf, strict=True):
            at = 0
            while at < len(column):
                at = 2 * at + (2 if row[column[at]] > cut[at] else 1)
            z += leaf[at - len(column)]
        p = 1 / (1 + np.exp(-z))
        k = int(np.searchsorted(model.knots, p))
        if k == 0 or k == len(model.knots):
            mean = model.means[min(k, len(model.means) - 1)]
        else:
            part = (p - model.knots[k - 1]) / (model.knots[k] - model.knots[k - 1])
            mean = model.means[k - 1] + part * (model.means[k] - model.means[k - 1])
        return min(1.0, max(0.0, 0.999 * mean + 0.001 * p))

    np.testing.assert_allclose(model.score(x), [walk(r) for r in x], atol=1e-9)
    assert np.all(np.diff(model.means) >= 0)


def test_first_split_is_the_best_one():
    x = np.array([[0, 5], [1, 1], [2, 4], [3, 2], [4, 6], [5, 3], [6, 0], [7, 7]], dtype=float).repeat(8, axis=0)
    y = (x[:, 0] > 3).astype(float)
    one = toxicity.fit_trees(x, y, trees=1, depth=1, bins=64)

    def gain(j, cut):
        p = y.mean()
        part = lambda m: (y[m] - p).sum() ** 2 / (m.sum() * p * (1 - p) + 2)
        return part(x[:, j] <= cut) + part(x[:, j] > cut)

    best = max(gain(j, c) for j in (0, 1) for c in range(7))
    assert abs(gain(one.column[0, 0], one.cut[0, 0]) - best) < 1e-9 and one.column[0, 0] == 0


def _invented(n, seed):
    """Texts of made-up words; a fifth holds made-up insults that no fixed lexicon has, in any spelling of case and signs."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("bdfgklmnprstv")) + rng.choice(list("aeiou")) for _ in range(3))
    insults = ["zuxozax", "qaxqix", "wyxowy"]
    out = []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.integers(5, 60))], i % 5 == 0
        for _ in range(3 * toxic):
            words.insert(rng.integers(len(words)), rng.choice(["{}", "{}!!", "({})"]).format(rng.choice(insults)))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_learns_words_of_unknown_languages(spark, make_docs):
    rows = _invented(600, 2)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    docs = make_docs([(i, t, "s") for i, t, _ in rows])
    model = toxicity.train(docs, labels)
    assert {"zuxozax", "qaxqix", "wyxowy"} <= set(model.lexicon)
    held = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).where(toxicity.held_out(F.col("doc_id"))).collect()}
    truth = {i: y for i, _, y in rows}
    caught = [held[i] for i in held if truth[i]]
    left = [1 - held[i] for i in held if not truth[i]]
    assert np.mean(caught) > 0.95 and np.mean(left) > 0.95


def test_learnt_words_as_by_counting(spark, make_docs):
    rows = _invented(200, 3)
    texts = spark.createDataFrame([(t, float(y)) for _, t, y in rows], "__text string, __y double")
    every, others = toxicity.learn_words(texts)
    for lexicon, kept in [(every, rows), *((o, [r for r in rows if toxicity.fold_of(r[1]) != k]) for k, o in enumerate(others))]:
        bags = [(set(toxicity.plain_words(t)), y) for _, t, y in kept]
        n = [sum(y == v for _, y in bags) for v in (0, 1)]
        want = {}
        for w in set().union(*(b for b, _ in bags)):
            clean, toxic = (sum(w in b for b, y in bags if y == v) for v in (0, 1))
            share = n[1] / sum(n)
            chance = (toxic + clean) * share
            if toxic >= 3 and toxic - chance >= 4 * (chance * (1 - share)) ** 0.5:
                want[w] = (np.log((toxic + 0.5) / (n[1] + 1)) - np.log((clean + 0.5) / (n[0] + 1))) * toxic / (toxic + 3)
        assert lexicon.keys() == want.keys() and all(abs(lexicon[w] - v) < 1e-9 for w, v in want.items())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))
    out = got[got.held_out]
    assert (out.predicted == out.toxic).mean() > 0.9 and out.score.between(0, 1).all()
    assert out[out.toxic == 1].score.mean() > 3 * out[out.toxic == 0].score.mean()


def test_odd_rows(spark, odd_docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd_docs, empty)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == 8 and all(r["score"] == 0.0 and r["predicted"] == 0 for r in rows)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(7)] + [(None, 1, 1), (3, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(odd_docs, toxicity.train(odd_docs, labels)).collect()
    assert len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
    assert toxicity.score(odd_docs.limit(0), model).count() == 0
    assert odd_docs.select(toxicity.held_out(F.col("doc_id")).alias("h")).where("h is null").count() == 0
