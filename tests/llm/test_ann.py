import numpy as np
import pytest

from sheaf.llm import ann, queries


def plain(rows, every, k=5):
    """The nearest by comparing each query with all."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % every == 0:
            s = (x * v).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((v * v).sum()))
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=32).astype(np.float32).tolist()) for i in range(3000)]
    got = found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    want = plain(rows, 50)
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    exact = {q: dict(plain([r for r in rows if r[0] == q or r[0] in dict(got[q])], 50)[q]) for q in got}
    assert all(abs(exact[q][v] - s) < 1e-12 for q in got for v, s in got[q])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_query_recall(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = found(queries.op2_ann(spark, sf_dir)), plain(rows, 50)
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    exact = {q: dict(want[q]) for q in want}
    assert all(abs(exact[q][v] - s) < 1e-12 for q in got for v, s in got[q] if v in exact[q])
    assert sum(v in exact[q] for q in got for v, _ in got[q]) >= 0.9 * sum(map(len, want.values()))


def test_very_large_and_small_components(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [1e-200, 1e-200]), (50, [1e-200, 0.0]), (51, [3e-310, 1e-310])]
    got = found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert [v for v, _ in got[0]] == [50, 1, 51, 2] and [v for v, _ in got[50]] == [0, 1, 51, 2]
    assert got[0][0][1] == 1.0 and abs(got[0][3][1] - 0.5**0.5) < 1e-15


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES", 20)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(0, 5000, 50)]
    got, want = found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))), plain(rows, 50)
    assert got.keys() == want.keys() and np.mean([v in dict(want[q]) for q in got for v, _ in got[q]]) >= 0.5


def test_odd_rows(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(0, 40)] + [(i, same) for i in range(0, 5)]  # repeated rows count once
    rows += [(100, [1.0, None]), (150, [float("nan"), 1.0]), (200, [float("inf"), 0.0]), (250, [0.0, 0.0]), (300, None), (None, same), (350, [1.0]), (400, []), (450, [-1.0, 0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = found(ann.search(df))
    assert {q: [v for v, _ in r] for q, r in got.items()} == {0: [1, 2, 3, 4, 5], 450: [0, 1, 2, 3, 4]}
    assert all(s == got[0][0][1] for _, s in got[0])
    assert ann.search(df.limit(0)).count() == 0
    assert found(ann.search(df.where("vec_id in (0, 7)"))) == {0: [(7, got[0][0][1])]}
