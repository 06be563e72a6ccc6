"""Micro-fixtures of the query layer and its coercions."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import coerce
from sheaf.operators import aggregates, ordering, predicates
from sheaf.operators.compiler import run_query
from sheaf.operators.session import Pool, Session, frame_of
from sheaf.plans.query import Aggregate, Condition, Filter, GroupBy, Page, Query, Search, Sort

PEOPLE = [{"name": "Alice", "age": 30, "status": "active"}, {"name": "Bob", "age": 25, "status": "inactive"}, {"name": "Charlie", "age": 35, "status": "active"}]
STAFF = [["dept", "name", "salary"], ["IT", "Alice", 100], ["HR", "Bob", 80], ["IT", "Charlie", 120], ["HR", "David", 90]]


@pytest.fixture(scope="module")
def people(spark):
    return frame_of(spark, PEOPLE)


def names(df):
    return [r["name"] for r in df.collect()]


@pytest.mark.parametrize(
    ("condition", "n"),
    [
        (("status", "eq", "active"), 2), (("age", "gt", 28), 2), (("name", "contains", "li"), 2), (("name", "in", ["Alice", "Bob"]), 2), (("status", "neq", "active"), 1), (("age", "lt", 30), 1),
        (("age", "lte", 30), 2), (("age", "gte", 30), 2), (("name", "startsWith", "A"), 1), (("name", "endsWith", "e"), 2), (("name", "regex", "^[AB]"), 2), (("name", "notIn", ["Alice", "Bob"]), 1),
        (("age", "eq", "30"), 0), (("name", "in", "Alice"), 0), (("name", "notIn", "Alice"), 3), (("age", "contains", "3"), 2), (("age", "gt", "28"), 2), (("age", "gt", "x"), 0), ((0, "eq", "Bob"), 1),
    ],
)
def test_filters(people, condition, n):
    assert predicates.where(people, Filter([Condition(*condition)])).count() == n


def test_logic_and_case(people):
    both = [Condition("status", "eq", "active"), Condition("age", "gt", 32)]
    assert names(predicates.where(people, Filter(both))) == ["Charlie"]
    assert predicates.where(people, Filter(both, "or")).count() == 2
    assert predicates.where(people, Filter([Condition("name", "eq", "ALICE", ignore_case=True)])).count() == 1
    assert predicates.where(people, Filter([])).count() == 3 and predicates.where(people, Filter([], "or")).count() == 0


def test_nulls(spark):
    df = spark.createDataFrame([("Alice", "30"), ("Bob", ""), ("Eve", None), ("Dan", "x")], "name string, age string")
    keep = lambda *c, compat=False: names(predicates.where(df, Filter([Condition(*c)]), compat))
    assert keep("age", "isNull") == ["Bob", "Eve"] and keep("age", "notNull") == ["Alice", "Dan"]
    assert keep("age", "neq", "x") == ["Alice", "Bob", "Eve"]
    assert keep("age", "gt", -1, compat=True) == ["Alice", "Bob", "Eve"] and keep("age", "gt", -1) == ["Alice", "Bob"]
    assert keep("age", "contains", "ul", compat=True) == ["Eve"] and keep("age", "contains", "ul") == []
    assert keep("age", "eq", None) == ["Eve"] and keep("age", "eq", float("nan")) == []


def test_search(spark):
    df = spark.createDataFrame([("Alice", "alice@example.com"), ("Bob", "bob@test.com")], "name string, email string")
    assert [predicates.search(df, s).count() for s in (Search("alice"), Search("ALICE"), Search("alice", ["name"]), Search("ALICE", ignore_case=False), Search(""))] == [1, 1, 1, 0, 2]


def test_sorts(spark):
    df = frame_of(spark, [["dept", "name", "age"], ["IT", "Alice", 30], ["HR", "Bob", 25], ["IT", "Charlie", 35], ["HR", "David", 40]])
    assert names(ordering.sort(df, [Sort("dept"), Sort("age", "desc", "number")])) == ["David", "Bob", "Charlie", "Alice"]
    assert names(ordering.sort(df, [Sort("dept", "desc")])) == ["Alice", "Charlie", "Bob", "David"]
    text = spark.createDataFrame([(x,) for x in ["b", "A", "a", "B", "é", "10", "9"]], "name string")
    assert names(ordering.sort(text, [Sort("name")])) == ["10", "9", "a", "A", "b", "B", "é"]
    numbers = spark.createDataFrame([("10",), ("9",), ("1e1",), (None,)], "name string")
    assert names(ordering.sort(numbers, [Sort("name")])) == [None, "9", "10", "1e1"]


def test_groups(spark):
    df = frame_of(spark, STAFF)
    all_ = [Aggregate("salary", f) for f in ("sum", "avg", "min", "max", "count")] + [Aggregate("name", "first"), Aggregate("name", "last", "")]
    it = {r["dept"]: r for r in aggregates.group_by(ordering.with_row(df.coalesce(1)), GroupBy(["dept"], all_), compat=True).collect()}["IT"]
    assert (it["salary_count"], it["salary_sum"], it["salary_avg"], it["salary_min"], it["salary_max"], it["name_first"], it["name_last"]) == (2, 220, 110, 100, 120, "Alice", "Charlie")
    null = spark.createDataFrame([(None, 1), ("", 2), ("a", 3)], "k string, v int")
    rows = aggregates.group_by(null.coalesce(1), GroupBy(["k"], [Aggregate("v", "sum")]), compat=True).collect()
    assert [(r["k"], r["v_sum"]) for r in rows] == [(None, 3.0), ("a", 3.0)]
    none = spark.createDataFrame([("x",)], "v string")
    row = aggregates.global_aggregate(none, [Aggregate("v", f) for f in ("sum", "avg", "min", "count")]).first()
    assert tuple(row) == (None, 0.0, None, 1)


def test_pages(spark):
    df = spark.range(100)
    assert [ordering.page(df, Page(*p)).count() for p in ((1, 10), (4, 30), (11, 10), (0, 0), (0, 7))] == [10, 10, 0, 100, 7]
    stats = lambda n, p: tuple(ordering.page_stats(spark.range(n), p).first())
    assert stats(100, Page(4, 30)) == (4, 30, 100, 4) and stats(7, Page(0, 0)) == (1, 7, 7, 1) and stats(0, Page(1, 5)) == (1, 5, 0, 0)


def test_batch_query(spark):
    rows = PEOPLE + [{"name": "David", "age": 40, "status": "active"}, {"name": "Eve", "age": 28, "status": "inactive"}]
    session = Session(spark).load(rows)
    got = session.query(Query(sort=[Sort("age", "desc", "number")], filter=Filter([Condition("status", "eq", "active")]), page=Page(1, 2)))
    assert names(got.data) == ["David", "Charlie"] and got.stats()["match_count"] == 3 and got.stats()["total_pages"] == 2
    total = session.query(Query(aggregate=[Aggregate("age", "sum"), Aggregate("age", "avg")])).data.first()
    assert tuple(total) == (158, 31.6)
    got = session.query(Query(sort=[Sort("age")], filter=Filter([Condition("age", "gte", 28)]), page=Page(1, 3)))
    assert names(got.data) == ["Eve", "Alice", "Charlie"] and got.stats()["match_count"] == 4
    session.filter(Filter([Condition("age", "gt", 28)]))
    assert session.counts() == {"match_count": 3, "total_count": 5} and session.aggregate([Aggregate("age", "min")]).first()[0] == 30
    assert names(session.sort(Sort("name", "desc"))) == ["David", "Charlie", "Alice"]
    assert names(session.search(Search("EVE"))) == ["Eve"]
    session.dispose()
    with pytest.raises(RuntimeError):
        session.data()
    compat = Session(spark, compat=True).load(rows)
    compat.filter(Filter([Condition("age", "gt", 28)]))
    compat.sort(Sort("name"))
    assert compat.base.count() == 3
    pool = Pool(spark)
    pool.session("a", "high").load(PEOPLE)
    assert pool.stats()["sessions"] == 1
    pool.terminate()


def test_query_without_compat_pushes_filters(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = run_query(df, Query(filter=Filter([Condition("l_quantity", "gte", 25)]), group_by=GroupBy(["l_returnflag"], [Aggregate("l_tax", "max")]))).data._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,25.0)]" in plan and "partial_max" in plan and "l_comment" not in plan


@pytest.mark.parametrize(
    ("s", "n"),
    [("", 0), (None, None), (" 12 ", 12), ("0x10", 16), ("0o17", 15), ("0b11", 3), ("1e3", 1000), (".5", 0.5), ("5.", 5), ("+5", 5), ("-Infinity", float("-inf")), ("abc", None), ("1d", None), ("NaN", None), ("-0x10", None), (" 7﻿", 7)],
)
def test_js_number(spark, s, n):
    df = spark.createDataFrame([(s,)], "s string")
    assert df.select(coerce.js_number(F.col("s"), T.StringType())).first()[0] == n
    if s is None:
        assert df.select(coerce.js_number(F.col("s"), T.StringType(), True)).first()[0] == 0


def test_values_and_text(spark):
    df = spark.createDataFrame([(x,) for x in ["true", "TrUe", "NULL", "", "trueish", "007", "-007", "1 ", "+1", "-.5", "1e5", "Infinity"]], "s string")
    kinds = [r[0] for r in df.select(coerce.value_kind(F.col("s"))).collect()]
    assert kinds == ["boolean", "boolean", "null", "text", "text", "text", "text", "text", "text", "number", "number", "number"]
    sheet = [r[0] for r in spark.createDataFrame([(x,) for x in ["", "007", "0x1F", "Infinity", "2019-11-04T10:17:55", "00210PRG1", "1234-5thisisnotadate", "true", "#N/A"]], "s string").select(coerce.sheet_value_kind(F.col("s"))).collect()]
    assert sheet == ["null", "number", "number", "text", "date", "text", "text", "boolean", "error"]
    row = spark.sql("select 1.0D a, 1.5D b, true c, null d, timestamp '2020-01-02 03:04:05' e")
    assert [row.select(coerce.js_string(F.col(c), row.schema[c].dataType, True)).first()[0] for c in "abcde"] == ["1", "1.5", "true", "null", "2020-01-02T03:04:05.000Z"]
    assert [r[0] for r in spark.createDataFrame([(-2.5,), (2.5,)], "x double").select(coerce.round_half_up(F.col("x"))).collect()] == [-2, 3]
