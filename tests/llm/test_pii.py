import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.llm import pii, queries

#: The contract's patterns, as it states them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), rank, m.end(), k) for rank, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(k, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def base_of(make_docs, texts):
    df = pii.find_personal(make_docs([(i, t, "s") for i, t in enumerate(texts)]))
    return {r["doc_id"]: r["v"] for r in df.select("doc_id", pii.shown("base_spans").alias("v")).collect()}


TEXTS = [
    "a@b.c_d@e.f x.y@z.w@q.r @a.b a@b a@b. a@b.c.d-e", "1.2.3.4.5.6.7.8 1.2.3.256 001.002.003.004 999.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1111 4111  1111 1111 1111 4111111111111112", "+1 (555) 010-9999. +1 2 +123456789012345678 ++49 30 1234567",
    "😀 mail é@x.yz 😀 +49 (30) 12345-67", None, "", "+" * 50 + "1" * 5000, "a" * 20_000, "1." * 20_000, "x@" + "y." * 20_000 + "z", "1 " * 20_000, "no data here",
]


def test_base_is_the_contract(spark, make_docs):
    got = base_of(make_docs, TEXTS)
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="a1@.+-() _25é", max_size=40), min_size=30, max_size=60))
def test_base_on_any_text(make_docs, texts):
    assert base_of(make_docs, texts) == {i: plain(t) for i, t in enumerate(texts)}


def test_contexts_find_unseen_identifiers(spark, make_docs):
    seeds = [f"please call me at +1 (555) 010-{1000 + i} today" for i in range(8)] + [f"paid with card number 4111 1111 1111 1111 and {i}" for i in range(2)]
    unseen = ["please call me at 555.0100.2288, today", "see order 20240101999 there", "the code is 123456789012 of"]
    df = pii.find_personal(make_docs([(i, t, "s") for i, t in enumerate(seeds + unseen)]))
    added = {r["doc_id"]: [s for s in r["spans"] if s not in r["base_spans"]] for r in df.collect()}
    assert {k: [(s["kind"], s["start"], s["end"]) for s in v] for k, v in added.items() if v} == {10: [("phone", 18, 31)]}
    shown = {r["doc_id"]: r["t"] for r in df.select("doc_id", pii.redact().alias("t")).collect()}
    assert shown[10] == "please call me at [PHONE], today" and shown[0] == "please call me at [PHONE] today" and shown[11] == unseen[1]


def test_odd_rows(odd_docs):
    rows = pii.find_personal(odd_docs)
    assert rows.count() == 8 and [c.lower() for c in rows.columns].count("spans") == 1
    long = [r for r in rows.collect() if r["doc_id"] == 3][0]
    assert [(s["kind"], s["start"]) for s in long["spans"]] == [("email", 300_000)]
    assert pii.find_personal(odd_docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    import hashlib

    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op1_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in BASE] == [want.count(f"{k}:") for k in BASE]


def test_words_around_are_whole(spark, make_docs):
    long = "w" * 300
    docs = make_docs([f"{long} {long} a.b{i}@mail.example.org, {long}" for i in range(2)])
    rows = pii.base_spans(docs.select(F.col("text")), "text").select(F.explode("__base").alias("s")).select("s.before", "s.after").collect()
    assert {r["before"] for r in rows} == {f"{long} {long}"} and {r["after"] for r in rows} == {","}
    one = spark.createDataFrame([(x,) for x in ("", "  ", "one", " one ", "a b c ", "mail:")], "gap string").select(pii._last_words(F.col("gap")).alias("w"))
    assert [r["w"].strip() for r in one.collect()] == ["", "", "one", "one", "b c", "mail:"]


def test_names_of_the_caller_stay(make_docs):
    docs = make_docs(["write to a.b@c.example now"]).selectExpr("*", "'p' as __text", "'q' as __base", "'r' as __keep0", "'s' as __unknown")
    row = pii.find_personal(docs).first()
    assert (row["__text"], row["__base"], row["__keep0"], row["__unknown"]) == ("p", "q", "r", "s") and len(row["spans"]) == 1
