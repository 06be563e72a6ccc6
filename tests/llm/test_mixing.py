import re
from collections import defaultdict

from sheaf.llm import mixing, queries


def plain_targets(sizes):
    """By the words of the contract: shares by weight, what is above a cap is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, total, open_ = {s: 0.0 for s in order}, float(sum(sizes.values())), set(order)
    left = total
    while left > 1e-6 and open_:
        w = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / w
        left = sum(max(0, target[s] - 3 * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= 3 * sizes[s]:
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def check(rows, docs):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        source = docs[r["doc_id"]][1]
        sizes[source] += r["size"]
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]][0] or "")) and r["taken"] <= 3 * r["size"]
    want = plain_targets(sizes)
    for r in rows:
        source = docs[r["doc_id"]][1]
        assert r["source_size"] == sizes[source] and abs(r["target"] - want[source]) < 1e-6 * max(1, want[source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1.5 * largest[s] + 1, s


def test_query(spark, sf_dir):
    for d in (sf_dir, "/root/testdata/sf0.01"):
        docs = {r["doc_id"]: (r["text"], r["source"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        rows = queries.op7_mixing(spark, d).collect()
        assert len(rows) == len(docs)
        check(rows, docs)
    again = queries.op7_mixing(spark, "/root/testdata/sf0.01").collect()
    assert sorted(rows) == sorted(again)


def test_caps_nulls_and_emission(spark, make_docs):
    rows = [(i, "w " * (1 + i % 7), ["a", "b", "c", None][min(3, i // 60)]) for i in range(200)]
    rows[0] = (0, "w " * 5, "tiny")
    docs = make_docs(rows)
    sized = docs.withColumn("size", mixing.word_count())
    mixed = mixing.mix(sized)
    got = mixed.withColumn("taken", mixed["copies"] * mixed["size"]).collect()
    check(got, {r[0]: (r[1], r[2]) for r in rows})
    out = mixing.emit(mixed)
    assert out.columns == sized.columns and out.count() == sum(r["copies"] for r in got)


def test_odd_rows(odd_docs):
    sized = odd_docs.withColumn("size", mixing.word_count())
    rows = mixing.mix(sized).collect()
    assert len(rows) == 8 and all(0 <= r["copies"] <= 3 for r in rows)
    assert {r["target"] for r in rows if r["source"] == "b"} and mixing.mix(sized.limit(0)).count() == 0
    assert mixing.emit(mixing.mix(sized.limit(0))).count() == 0
