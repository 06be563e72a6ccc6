import random

import numpy as np

from sheaf.llm import near_dup, queries


def plain(rows, size, percent):
    """Components by comparing all pairs of whole word shingles."""
    def cut(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()

    sets = [(i, cut(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and top(i) != top(j) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in sets}


def test_same_as_all_pairs(make_docs):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 80]))]
        for _ in range(rng.choice([1, 2, 6])):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows) + 10, rng.choice([" ", "\n"]).join(words)))
    rows += [(1, "A b C"), (2, "a B c"), (3, ""), (4, None), (5, " \t")]
    got = near_dup.near_duplicates(make_docs([(i, t, "s") for i, t in rows]), size=4)
    want = plain(rows, 4, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_dense_group(make_docs):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 2])):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = near_dup.near_duplicates(make_docs([(i, t, "s") for i, t in rows]))
    want = plain(rows, 5, 80)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: c for i, (_, c) in want.items()}


def test_crowded_regions_are_compared_completely(spark, make_docs, monkeypatch):
    """Hundreds of copies whose changes leave most pairs just below the threshold, and far more of them than a region lists."""
    rng = random.Random(9)
    rows = []
    for g in range(2):
        base = [f"g{g}w{i}" for i in range(57)]
        for _ in range(220):
            words = list(base)
            for _ in range(rng.choice([1, 2, 2, 3])):
                words[rng.randrange(57)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join(base)))
    monkeypatch.setattr(near_dup, "REGION", 8)
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 50)
    seen = []
    real = near_dup._in_blocks
    monkeypatch.setattr(near_dup, "_in_blocks", lambda *a: seen.append(1) or real(*a))
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(make_docs([(i, t, "s") for i, t in rows]), size=4).collect()}
    want = {i: c for i, (_, c) in plain(rows, 4, 80).items()}
    assert seen and len(set(want.values())) > 20 and got == want


def test_common_counts():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(30)]
    got = near_dup.common_counts(sets[:12], sets[12:], width=7)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[12:]] for x in sets[:12]]
    assert near_dup.common_counts(sets[:2], []).shape == (2, 0)


def test_query_on_a_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op10_minhash_dedup(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain(rows, 4, 80)


def test_one_of_each_keeps_one_row(spark, make_docs):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "t"), (1, "a b c d e f", "t"), (2, "A B c d e f", "s"), (3, "other words", "s"), (3, "else", "s"), (4, None, "s"), (4, None, "s"), (None, "a b c d e f", "s"), (None, "a b c d e f", "s")]
    docs = make_docs(rows).selectExpr("*", "'x' as key", "'y' as GONE")
    got = near_dup.one_of_each(docs, near_dup.near_duplicates(docs))
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"] or 0) for r in got.collect())) == [0, 0, 1, 3, 4]
    again = near_dup.one_of_each(docs.orderBy("source", ascending=False), near_dup.near_duplicates(docs))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (200, 201)]
    got = {r["id"]: r["comp"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 51)) and got[101] == got[102] == 100 and got[201] == 200


def test_odd_rows(odd_docs, make_docs):
    got = near_dup.near_duplicates(odd_docs)
    rows = got.collect()
    assert len(rows) == 8
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["doc_id"] is not None) and all(r["kept"] for r in rows)
    assert [r["doc_id"] for r in near_dup.one_of_each(odd_docs, got).orderBy("doc_id").collect()] == [None, 1, 2, 3, 4, 5, 6]
    assert near_dup.near_duplicates(odd_docs.limit(0)).count() == 0
    # an id with two texts ties their components
    tied = make_docs([(7, "a b c d e f", "s"), (7, "u v w x y z", "s"), (9, "u v w x y z", "s")])
    assert {(r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(tied).collect()} == {(7, 7), (9, 7)}
