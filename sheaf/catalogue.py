"""Queries of the library's own operators over the test tables, each with SQL that says the same where SQL can."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import address, cellformat, coerce, dates, text
from sheaf.operators import aggregates, ordering, pivot, predicates, relational, reshape, rules
from sheaf.operators.compiler import compile_query
from sheaf.plans.query import Aggregate, Condition, Filter, GroupBy, Page, Query, Search, Sort

Run = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Run, str | None]] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, sql: str | None) -> Callable[[Run], Run]:
    def keep(run: Run) -> Run:
        _QUERIES[name] = (run, sql)
        return run

    return keep


def _on(name: str, table: str, make: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    _QUERIES[name] = (lambda spark, sf_dir: make(_table(spark, sf_dir, table)), sql)


def _filtered(name: str, table: str, columns: str, f: Filter, where: str, compat: bool = False) -> None:
    """Which rows a filter keeps, by their key columns."""
    _on(name, table, lambda df: predicates.where(df, f, compat).select(*columns.split(", ")), f"select {columns} from {table} where {where}")


# The flagship: a filtered and grouped scan.
FLAGSHIP = Query(
    filter=Filter([Condition("l_quantity", "gte", 25)]),
    group_by=GroupBy(["l_returnflag", "l_linestatus"], [Aggregate("l_orderkey", "count", "n"), Aggregate("l_quantity", "sum", "sum_qty"), Aggregate("l_discount", "avg", "avg_disc"), Aggregate("l_extendedprice", "max", "max_price")]),
)


@_add(
    "query_flagship",
    """select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as sum_qty, round(avg(l_discount), 6) as avg_disc, max(l_extendedprice) as max_price
    from lineitem where l_quantity >= 25 and l_shipdate < timestamp '1998-01-01' group by all""",
)
def query_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return compile_query(lines, FLAGSHIP).withColumn("avg_disc", F.round("avg_disc", 6))


# Filters.
_KEY = "l_orderkey, l_linenumber"
_one = lambda *c, **k: Filter([Condition(*c, **k)])
_filtered("filter_eq", "orders", "o_orderkey", _one("o_orderstatus", "eq", "F"), "o_orderstatus = 'F'")
_filtered("filter_eq_no_coercion", "part", "p_partkey", _one("p_size", "eq", "10"), "false")
_filtered("filter_neq", "customer", "c_custkey", _one("c_mktsegment", "neq", "BUILDING"), "c_mktsegment is distinct from 'BUILDING'")
_filtered("filter_gt", "lineitem", _KEY, _one("l_quantity", "gt", 45), "l_quantity > 45")
_filtered("filter_gte", "lineitem", _KEY, _one("l_quantity", "gte", 45), "l_quantity >= 45")
_filtered("filter_lt", "lineitem", _KEY, _one("l_extendedprice", "lt", 2000.5), "l_extendedprice < 2000.5")
_filtered("filter_lte", "part", "p_partkey", _one("p_size", "lte", 5), "p_size <= 5")
_filtered("filter_contains_ic", "part", "p_partkey, p_name", _one("p_name", "contains", "A", ignore_case=True), "contains(lower(p_name), 'a')")
_filtered("filter_starts", "part", "p_partkey, p_type", _one("p_type", "startsWith", "S"), "starts_with(p_type, 'S')")
_filtered("filter_ends", "part", "p_partkey, p_brand", _one("p_brand", "endsWith", "1"), "ends_with(p_brand, '1')")
_filtered("filter_regex", "customer", "c_custkey, c_name", _one("c_name", "regex", "[02468]$"), "regexp_matches(c_name, '[02468]$')")
_filtered("filter_in", "nation", "n_nationkey, n_name", _one("n_regionkey", "in", [1, 3]), "n_regionkey in (1, 3)")
_filtered("filter_notin", "orders", "o_orderkey", _one("o_orderpriority", "notIn", ["1-URGENT", "2-HIGH"]), "coalesce(o_orderpriority not in ('1-URGENT', '2-HIGH'), true)")
_filtered("filter_unknown_operator", "region", "r_regionkey", _one("r_name", "like", "x"), "true")
_filtered("filter_or_empty", "region", "r_regionkey", Filter([], "or"), "false")
_filtered(
    "filter_and_or", "lineitem", _KEY, Filter([Condition("l_returnflag", "eq", "R"), Condition("l_quantity", "gt", 49), Condition("l_linestatus", "eq", "O")], "or"),
    "l_returnflag = 'R' or l_quantity > 49 or l_linestatus = 'O'",
)
_nulled = lambda df: df.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
_NULLED = "(select c_custkey, nullif(c_mktsegment, 'BUILDING') as seg from customer)"
for _name, _f, _where, _compat in [
    ("filter_isnull", _one("seg", "isNull"), "seg is null or seg = ''", False),
    ("filter_notnull", _one("seg", "notNull"), "not (seg is null or seg = '')", False),
    ("filter_neq_null", _one("seg", "neq", "MACHINERY"), "seg is distinct from 'MACHINERY'", False),
    ("filter_contains_null_compat", _one("seg", "contains", "ul"), "contains(coalesce(seg, 'null'), 'ul')", True),
]:
    _on(_name, "customer", lambda df, f=_f, c=_compat: predicates.where(_nulled(df), f, c).select("c_custkey"), f"select c_custkey from {_NULLED} where {_where}")
_on(
    "search_all", "customer", lambda df: predicates.search(df, Search("ER")).select("c_custkey"),
    """select c_custkey from customer where contains(lower(coalesce(c_custkey::varchar, '')), 'er') or contains(lower(coalesce(c_name, '')), 'er')
    or contains(lower(coalesce(c_mktsegment, '')), 'er')""",
)
_on("search_columns", "part", lambda df: predicates.search(df, Search("Brand#1", ["p_brand"], ignore_case=False)).select("p_partkey"), "select p_partkey from part where contains(p_brand, 'Brand#1')")
_on(
    "match_counts", "orders", lambda df: df.agg(F.count(F.when(predicates.filter_column(df, _one("o_orderstatus", "eq", "F")), 1)).alias("match_count"), F.count(F.lit(1)).alias("total_count")),
    "select count(*) filter (o_orderstatus = 'F') as match_count, count(*) as total_count from orders",
)
_on("projection", "nation", lambda df: reshape.project(df, [("n_name", "nation"), "n_regionkey"]), "select n_name as nation, n_regionkey from nation")
_on("drop_null_header", "region", lambda df: reshape.rename(df, ["a", None]), "select r_regionkey as a from region")


# Sorts and pages.
_on(
    "sort_page", "orders", lambda df: ordering.page(ordering.sort(df, [Sort("o_totalprice", "desc"), Sort("o_orderkey")], stable=False), Page(3, 10)).select("o_orderkey", "o_totalprice"),
    "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 20",
)
_on(
    "sort_collated_topk", "customer", lambda df: df.orderBy(*ordering.sort_keys(df, [Sort("c_mktsegment"), Sort("c_custkey")])).limit(25).select("c_custkey", "c_mktsegment"),
    "select c_custkey, c_mktsegment from customer order by c_mktsegment, c_custkey limit 25",
)
_on(
    "sort_date", "orders", lambda df: df.orderBy(*ordering.sort_keys(df, [Sort("o_orderdate", "desc", "date"), Sort("o_orderkey")])).limit(15).select("o_orderkey", "o_orderdate"),
    "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 15",
)
_on(
    "sort_number_text", "part",
    lambda df: (lambda d: d.orderBy(*ordering.sort_keys(d, [Sort("size", "desc", "number"), Sort("p_partkey")])).limit(20))(df.select("p_partkey", F.col("p_size").cast("string").alias("size"))),
    "select p_partkey, p_size::varchar as size from part order by p_size desc, p_partkey limit 20",
)
_on("page_stats", "orders", lambda df: ordering.page_stats(df, Page(4, 30)), "select 4::bigint as page, 30::bigint as page_size, count(*) as total_rows, ceil(count(*) / 30.0)::bigint as total_pages from orders")
_on("page_zero", "region", lambda df: ordering.page_stats(df, Page(0, 0)), "select 1::bigint as page, count(*) as page_size, count(*) as total_rows, 1::bigint as total_pages from region")
_on(
    "mixed_order", "region", lambda df: (lambda d: d.orderBy(*ordering.mixed_keys(d, "v")).limit(4))(df.select(F.when(F.col("r_regionkey") < 2, F.col("r_regionkey").cast("string")).when(F.col("r_regionkey") == 2, "2020-01-01").when(F.col("r_regionkey") == 3, F.col("r_name")).alias("v"))),
    "select * from (values ('0'), ('1'), ('2020-01-01'), ((select r_name from region where r_regionkey = 3))) t(v)",
)


# Aggregates.
def _grouped(name: str, table: str, keys: list[str], many: list[Aggregate], sql: str, rounded: tuple[str, ...] = ()) -> None:
    def make(df: DataFrame) -> DataFrame:
        return aggregates.group_by(df, GroupBy(keys, many)).withColumns({c: F.round(c, 4) for c in rounded}) if rounded else aggregates.group_by(df, GroupBy(keys, many))

    _on(name, table, make, sql)


_grouped("group_count", "orders", ["o_orderpriority"], [Aggregate("o_orderkey", "count")], "select o_orderpriority, count(*) as o_orderkey_count from orders group by 1")
_grouped("group_sum", "lineitem", ["l_suppkey"], [Aggregate("l_quantity", "sum")], "select l_suppkey, sum(l_quantity) as l_quantity_sum from lineitem group by 1")
_grouped("group_avg", "lineitem", ["l_returnflag"], [Aggregate("l_extendedprice", "avg")], "select l_returnflag, round(avg(l_extendedprice), 4) as l_extendedprice_avg from lineitem group by 1", ("l_extendedprice_avg",))
_grouped("group_minmax", "part", ["p_brand"], [Aggregate("p_retailprice", "min"), Aggregate("p_retailprice", "max", "top")], "select p_brand, min(p_retailprice) as p_retailprice_min, max(p_retailprice) as top from part group by 1")
_grouped("group_multi", "orders", ["o_orderstatus", "o_orderpriority"], [Aggregate("o_totalprice", "max"), Aggregate("o_custkey", "count", "n")], "select o_orderstatus, o_orderpriority, max(o_totalprice) as o_totalprice_max, count(*) as n from orders group by 1, 2")
_on(
    "group_first_last", "events",
    lambda df: aggregates.group_by(df.withColumn(ordering.ROW, F.col("event_id")), GroupBy(["event_type"], [Aggregate("value", "first"), Aggregate("value", "last")])),
    "select event_type, arg_min(value, event_id) as value_first, arg_max(value, event_id) as value_last from events group by 1",
)
_on(
    "group_null_keys_compat", "customer", lambda df: aggregates.group_by(_nulled(df).orderBy("c_custkey").withColumn(ordering.ROW, F.col("c_custkey")), GroupBy(["seg"], [Aggregate("c_custkey", "count", "n")]), compat=True),
    f"select seg, count(*) as n from {_NULLED} group by 1",
)
_on(
    "agg_global", "lineitem", lambda df: aggregates.global_aggregate(df, [Aggregate("l_quantity", "sum"), Aggregate("l_tax", "max"), Aggregate("l_orderkey", "count", "n")]),
    "select sum(l_quantity) as l_quantity_sum, max(l_tax) as l_tax_max, count(*) as n from lineitem",
)
_on(
    "agg_empty", "lineitem", lambda df: aggregates.global_aggregate(df.where("l_quantity < 0"), [Aggregate("l_quantity", "sum"), Aggregate("l_quantity", "avg"), Aggregate("l_quantity", "count")]),
    "select sum(l_quantity) as l_quantity_sum, coalesce(avg(l_quantity), 0) as l_quantity_avg, count(*) as l_quantity_count from lineitem where l_quantity < 0",
)
_on(
    "agg_text_numbers_compat", "customer",
    lambda df: aggregates.global_aggregate(df.select(F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).when(F.col("c_custkey") % 3 == 1, F.lit("x")).otherwise(F.lit(" 2 ")).alias("v")), [Aggregate("v", "sum"), Aggregate("v", "min"), Aggregate("v", "count")], compat=True),
    "select sum(case c_custkey % 3 when 0 then 0.0 when 2 then 2.0 end)::double as v_sum, min(case c_custkey % 3 when 0 then 0.0 when 2 then 2.0 end)::double as v_min, count(*) as v_count from customer",
)
_on(
    "query_batch", "orders",
    lambda df: compile_query(df, Query(sort=[Sort("o_orderpriority")], filter=Filter([Condition("o_totalprice", "gt", 100000)]), search=Search("F", ["o_orderstatus"]), group_by=GroupBy(["o_orderpriority"], [Aggregate("o_totalprice", "max"), Aggregate("o_orderkey", "count", "n")]))),
    "select o_orderpriority, max(o_totalprice) as o_totalprice_max, count(*) as n from orders where o_totalprice > 100000 and contains(lower(o_orderstatus), 'f') group by 1",
)
_on(
    "query_page", "orders", lambda df: compile_query(df.select("o_orderkey", "o_totalprice", "o_orderstatus"), Query(sort=[Sort("o_totalprice", "desc"), Sort("o_orderkey")], filter=_one("o_orderstatus", "in", ["F", "O"]), page=Page(2, 50))),
    "select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderstatus in ('F', 'O') order by o_totalprice desc, o_orderkey limit 50 offset 50",
)


# Cross tables.
_lines = lambda df: df.withColumn("yr", F.year("l_shipdate"))
_on(
    "pivot_sum", "lineitem", lambda df: pivot.pivot(df, pivot.Pivot(["l_returnflag"], [pivot.Value("l_quantity")], ["l_linestatus"], column_values=["F", "O"])),
    "select l_returnflag, sum(l_quantity) filter (l_linestatus = 'F') as F, sum(l_quantity) filter (l_linestatus = 'O') as O from lineitem group by 1",
)
_METRICS = [pivot.Value("p_retailprice", m, m) for m in ("sum", "count", "average", "max", "min", "countNums", "stdDev", "stdDevP", "var", "varP")]
_on(
    "pivot_metrics", "part", lambda df: (lambda d: d.select("p_brand", "count", "countNums", "max", "min", *(F.round(c, 3).alias(c) for c in ("sum", "average", "stdDev", "stdDevP", "var", "varP"))))(pivot.pivot(df, pivot.Pivot(["p_brand"], _METRICS))),
    """select p_brand, round(sum(p_retailprice), 3) as sum, count(p_retailprice) as count, round(avg(p_retailprice), 3) as average, max(p_retailprice) as max, min(p_retailprice) as min,
    count(p_retailprice) as "countNums", round(stddev_samp(p_retailprice), 3) as "stdDev", round(stddev_pop(p_retailprice), 3) as "stdDevP", round(var_samp(p_retailprice), 3) as "var",
    round(var_pop(p_retailprice), 3) as "varP" from part group by 1""",
)
_on(
    "pivot_product", "nation", lambda df: pivot.pivot(df.withColumn("v", F.col("n_nationkey") + 1), pivot.Pivot(["n_regionkey"], [pivot.Value("v", "product", "product")])),
    "select n_regionkey, product((n_nationkey + 1)::double) as product from nation group by 1",
)
_on(
    "pivot_totals", "orders", lambda df: pivot.pivot(df, pivot.Pivot(["o_orderstatus", "o_orderpriority"], [pivot.Value("o_orderkey", "count", "n")], totals=True)).withColumnRenamed("__level", "level").withColumn("level", F.col("level").cast("int")),
    "select o_orderstatus, o_orderpriority, (grouping(o_orderstatus) + grouping(o_orderpriority))::int as level, count(o_orderkey) as n from orders group by rollup (o_orderstatus, o_orderpriority)",
)
_on(
    "pivot_cross_totals", "lineitem", lambda df: pivot.pivot(df, pivot.Pivot(["l_returnflag"], [pivot.Value("l_quantity", "max", "v")], ["l_linestatus"], column_values=["F", "O"], totals=True)).drop("__level"),
    "select l_returnflag, max(l_quantity) filter (l_linestatus = 'F') as F, max(l_quantity) filter (l_linestatus = 'O') as O, max(l_quantity) as total from lineitem group by rollup (l_returnflag)",
)
_on(
    "pivot_pages", "orders", lambda df: pivot.pivot(df, pivot.Pivot(["o_orderpriority"], [pivot.Value("o_totalprice", "max", "v")], pages={"o_orderstatus": "F"})),
    "select o_orderpriority, max(o_totalprice) as v from orders where o_orderstatus = 'F' group by 1",
)
_on(
    "totals_row", "nation", lambda df: pivot.totals_row(df.select("n_name", "n_regionkey"), {"n_regionkey": "sum"}),
    "select n_name, n_regionkey from nation union all select 'Total', sum(n_regionkey)::int from nation",
)
_on("shared_items", "customer", lambda df: pivot.shared_items(_nulled(df), "seg"), f"select distinct seg from {_NULLED}")
_on(
    "field_profile", "part", lambda df: pivot.field_profile(df, "p_size"),
    """select min(p_size)::double as min_value, max(p_size)::double as max_value, true as all_integer, false as contains_string, true as contains_number, false as contains_date,
    false as contains_blank, false as contains_mixed, count(distinct p_size) as distinct_values from part""",
)
_on(
    "encode_records", "customer", lambda df: pivot.encode_records(df, "c_mktsegment").select("c_custkey", "c_mktsegment_index"),
    "select c_custkey, dense_rank() over (order by c_mktsegment) - 1 as c_mktsegment_index from customer",
)


# Row edits and reshaping.
_on(
    "objname_last_wins", "orders", lambda df: reshape.last_by_key(df.select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderkey").alias(ordering.ROW)), "o_custkey"),
    "select o_custkey, max(o_orderkey) as o_orderkey, arg_max(o_totalprice, o_orderkey) as o_totalprice from orders group by 1",
)
_on(
    "append_rows", "region", lambda df: reshape.append(df, df.select(F.col("r_regionkey") + 10).toDF("r_regionkey"), df.withColumn("extra", F.lit(1))),
    """select r_regionkey, r_name, null::int as extra from region union all select r_regionkey + 10, null, null from region union all select r_regionkey, r_name, 1 from region""",
)
_numbered = lambda df: df.select((F.col("n_nationkey") + 1).alias(ordering.ROW), "n_name")
_on(
    "splice_rows", "nation", lambda df: reshape.splice_rows(_numbered(df), 3, 2, df.sparkSession.createDataFrame([(1, "new")], f"{ordering.ROW} int, n_name string")).withColumnRenamed(ordering.ROW, "pos"),
    """select case when n_nationkey + 1 >= 5 then n_nationkey + 1 - 2 + 1 else n_nationkey + 1 end::int as pos, n_name from nation where n_nationkey + 1 not in (3, 4) union all select 3, 'new'""",
)
_on(
    "duplicate_row", "nation", lambda df: reshape.duplicate_row(_numbered(df), 2, 2).withColumnRenamed(ordering.ROW, "pos"),
    """select case when n_nationkey + 1 > 2 then n_nationkey + 3 else n_nationkey + 1 end as pos, n_name from nation
    union all select 3, n_name from nation where n_nationkey = 1 union all select 4, n_name from nation where n_nationkey = 1""",
)
_on("splice_columns", "nation", lambda df: reshape.splice_columns(df, 2, 1, {"flag": F.lit(True)}), "select n_nationkey, true as flag, n_regionkey from nation")
_on(
    "tuple_to_map", "nation", lambda df: reshape.to_pairs(df.select("n_nationkey", "n_name")).select(F.element_at(reshape.pairs_to_map(F.col("pairs")), "n_name").alias("name"), F.array_join(reshape.pair_keys(F.col("pairs")), ",").alias("keys")),
    "select n_name as name, 'n_nationkey,n_name' as keys from nation",
)
_on("row_text", "nation", lambda df: reshape.row_text(df), "select n_nationkey::varchar || ',' || n_name || ',' || n_regionkey::varchar as line from nation")
_on(
    "group_columns", "nation", lambda df: reshape.group_columns(df.select("n_name", F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("k_1")), {"k_1": "k"}).select("n_name", F.array_join("k", "-").alias("k")),
    "select n_name, n_nationkey::varchar || '-' || n_regionkey::varchar as k from nation",
)
_on(
    "sheet_records", "region",
    lambda df: reshape.records(df.select((F.col("r_regionkey") + 2).alias(ordering.ROW), F.col("r_regionkey").cast("string").alias("c1"), F.col("r_name").alias("c2")).unionByName(df.sparkSession.createDataFrame([(1, "id", "name")], f"{ordering.ROW} int, c1 string, c2 string"))).drop(ordering.ROW),
    "select r_regionkey::varchar as id, r_name as name from region",
)
_on("extents", "lineitem", lambda df: reshape.extents(df.select(F.col("l_linenumber").alias("row"), F.col("l_suppkey").alias("col"))), "select max(l_linenumber) as row_count, max(l_suppkey) as column_count, count(distinct l_linenumber) as actual_row_count, count(distinct l_suppkey) as actual_column_count from lineitem")


# Scalar functions.
_SAMPLES = ["", " 12 ", "0x10", "1e3", ".5", "5.", "+5", "abc", "1d", "NaN", "-0x10", "Infinity", "007", "true", "TrUe", "null", "-0.5", "1 "]
_samples = lambda spark, extra=None: spark.createDataFrame([(i, s) for i, s in enumerate([*_SAMPLES, *(extra or [])])], "k int, s string")
_values = lambda extra=(): "(values " + ", ".join(f"({i}, '{s}')" for i, s in enumerate([*_SAMPLES, *extra])) + ") t(k, s)"


@_add(
    "js_number",
    f"""select k, case when trim(s) = '' then 0 when regexp_matches(s, '^0x[0-9a-f]+$') then 16 when trim(s) = 'Infinity' then 'inf'::double
    when regexp_matches(trim(s), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') then trim(s)::double end as n from {_values()}""",
)
def js_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark).select("k", coerce.js_number(F.col("s"), T.StringType()).alias("n"))


@_add(
    "convert_value",
    f"""select k, case when lower(s) = 'null' then 'null' when lower(s) in ('true', 'false') then 'boolean' when s in ('Infinity', '-Infinity', 'NaN') then 'number'
    when regexp_matches(s, '^-?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$') and not regexp_matches(s, '^-?0[0-9]') then 'number' else 'text' end as kind from {_values()}""",
)
def convert_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark).select("k", coerce.value_kind(F.col("s")).alias("kind"))


_on(
    "parse_dates", "orders", lambda df: df.select("o_orderkey", dates.parse_dates(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss"), ["DD/MM/YYYY HH:mm:ss"]).cast("timestamp_ntz").alias("t")),
    "select o_orderkey, date_trunc('second', o_orderdate) as t from orders",
)
_on("excel_serial", "orders", lambda df: df.select("o_orderkey", F.round(dates.to_serial(F.col("o_orderdate")), 6).alias("serial")), "select o_orderkey, round(epoch_ms(o_orderdate) / 86400000.0 + 25569, 6) as serial from orders")
_on("serial_round_trip", "orders", lambda df: df.select("o_orderkey", dates.from_serial(dates.to_serial(F.col("o_orderdate"))).cast("timestamp_ntz").alias("t")), "select o_orderkey, date_trunc('millisecond', o_orderdate) as t from orders")
_on("format_date", "orders", lambda df: df.select("o_orderkey", dates.format_date(F.col("o_orderdate"), "DD/MM/YYYY[ at ]HH:mm").alias("shown")), "select o_orderkey, strftime(o_orderdate, '%d/%m/%Y at %H:%M') as shown from orders")
_on(
    "formula_escape", "customer", lambda df: df.select("c_custkey", text.escape_formula(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("="), F.col("c_name"))).otherwise(F.col("c_name"))).alias("v")),
    "select c_custkey, case when c_custkey % 2 = 0 then '''=' || c_name else c_name end as v from customer",
)
_on("quote_field", "part", lambda df: df.select("p_partkey", text.quote_field(F.concat(F.lit('a"'), F.col("p_name"))).alias("v")), "select p_partkey, '\"a\"\"' || p_name || '\"' as v from part")
_on("utf8_len", "documents", lambda df: df.select("doc_id", text.utf8_length(F.col("text")).alias("bytes")), "select doc_id, octet_length(encode(text))::int as bytes from documents")
_on("json_prop", "events", lambda df: df.select("event_id", F.get_json_object("props", "$.k").alias("k")), "select event_id, props->>'$.k' as k from events")
_on(
    "a1_address", "events", lambda df: df.select("event_id", address.encode_cell(F.col("event_id"), F.col("event_id") % 700 + 1).alias("a")),
    "select event_id, (case when event_id % 700 >= 26 then chr((65 + (event_id % 700) // 26 - 1)::int) else '' end) || chr((65 + (event_id % 700) % 26)::int) || event_id::varchar as a from events",
)
_on("a1_decode", "nation", lambda df: df.select("n_nationkey", address.decode_cell(F.concat(F.lit("Sheet!$AB$"), F.col("n_nationkey") + 1)).alias("d")).select("n_nationkey", "d.row", "d.col"), "select n_nationkey, n_nationkey + 1 as row, 28 as col from nation")
_on("number_text", "part", lambda df: df.select("p_partkey", coerce.format_number(F.col("p_retailprice"), T.DoubleType(), ",").alias("v")).select("p_partkey", coerce.parse_number(F.col("v"), ",").alias("n")), "select p_partkey, p_retailprice as n from part")
_on("round_half_up", "lineitem", lambda df: df.select("l_orderkey", "l_linenumber", coerce.round_half_up(F.col("l_quantity") / 4 - 5).cast("double").alias("r")), "select l_orderkey, l_linenumber, floor(l_quantity / 4 - 5 + 0.5)::double as r from lineitem")
_on("xml_encode", "part", lambda df: df.select("p_partkey", text.xml_encode(F.concat(F.lit("<&"), F.col("p_name"))).alias("x")), "select p_partkey, '&lt;&amp;' || p_name as x from part")
_on("glob_match", "part", lambda df: df.where(text.glob_match(F.col("p_brand"), "Brand#[12]{1,3}")).select("p_partkey"), "select p_partkey from part where regexp_matches(p_brand, '^Brand#[12](1|3)$')")
_on("base64", "documents", lambda df: df.select("doc_id", F.regexp_replace(F.base64(F.col("text").cast("binary")), "\r\n", "").alias("b")), "select doc_id, base64(encode(text)) as b from documents")
_on("crc32", "documents", lambda df: df.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("c")), None)
_on("checksums", "documents", lambda df: df.select("doc_id", text.adler32(F.col("text").cast("binary")).alias("adler"), F.round(text.entropy(F.col("text").cast("binary")), 4).alias("entropy")), None)
_on("cell_format", "lineitem", lambda df: df.select("l_orderkey", "l_linenumber", cellformat.format_column(F.col("l_extendedprice"), "#,##0.00;(#,##0.00)").alias("v")), "select l_orderkey, l_linenumber, format('{:,.2f}', round(l_extendedprice, 2)) as v from lineitem")


# Rules.
_on("cf_top10", "orders", lambda df: rules.top_n(df, "o_totalprice", 10).where("in_top").select("o_orderkey"), "select o_orderkey from orders qualify rank() over (order by o_totalprice desc) <= 10")
_on("cf_bottom_percent", "part", lambda df: rules.top_n(df, "p_retailprice", 5, percent=True, bottom=True).where("in_top").select("p_partkey"), "select p_partkey from part where p_retailprice <= (select max(v) from (select p_retailprice as v from part order by v limit (select greatest(1, count(*) * 5 // 100) from part)))")
_on("cf_above_avg", "orders", lambda df: rules.above_average(df, "o_totalprice").where("above_average").select("o_orderkey"), "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) from orders)")
_on("cf_between", "part", lambda df: df.select("p_partkey", rules.cell_is(F.col("p_size"), "between", 10, 20).alias("hit")), "select p_partkey, p_size between 10 and 20 as hit from part")
_on("cf_text", "part", lambda df: df.select("p_partkey", rules.contains_text(F.col("p_type"), "containsText", "STEEL").alias("hit"), rules.contains_text(F.col("p_name"), "containsBlanks").alias("blank")), "select p_partkey, contains(lower(p_type), 'steel') as hit, length(trim(p_name)) = 0 as blank from part")
_on("cf_time_period", "orders", lambda df: df.select("o_orderkey", rules.time_period(F.col("o_orderdate"), "lastMonth", F.lit("1996-03-15").cast("date")).alias("hit")), "select o_orderkey, o_orderdate >= timestamp '1996-02-01' and o_orderdate < timestamp '1996-03-01' as hit from orders")
_on("cf_color_scale", "part", lambda df: rules.color_scale(df, "p_size", [("min", None), ("max", None)]).select("p_partkey", F.round("scale", 6).alias("scale")), "select p_partkey, round((p_size - (select min(p_size) from part)) / ((select max(p_size) - min(p_size) from part))::double, 6) as scale from part")
_on("cf_icon_set", "part", lambda df: rules.icon_set(df, "p_size", [("num", 0), ("num", 15), ("num", 35)]).select("p_partkey", "icon"), "select p_partkey, (p_size >= 15)::int + (p_size >= 35)::int as icon from part")
_on(
    "validation_flags", "lineitem", lambda df: df.select("l_orderkey", "l_linenumber", rules.validation(F.col("l_quantity"), "whole", "between", [1, 30]).alias("qty_ok"), rules.validation(F.col("l_returnflag"), "list", values=["A", "N"]).alias("flag_ok"), rules.validation(F.col("l_returnflag"), "textLength", "equal", [1]).alias("len_ok")),
    "select l_orderkey, l_linenumber, l_quantity between 1 and 30 and l_quantity = floor(l_quantity) as qty_ok, l_returnflag in ('A', 'N') as flag_ok, length(l_returnflag) = 1 as len_ok from lineitem",
)
_on("autofilter_custom", "part", lambda df: df.where(rules.custom_filter(F.col("p_name"), [("equal", "*a?e*")])).select("p_partkey"), "select p_partkey from part where regexp_matches(lower(p_name), 'a.e')")
_on("autofilter_values", "part", lambda df: df.where(rules.value_filter(F.col("p_size"), [1, 2, 3])).select("p_partkey"), "select p_partkey from part where p_size in (1, 2, 3)")


# Lookups, joins, sets, windows.
@_add("lookup_decode", "select c_custkey, n_name as nation from customer left join nation on c_nationkey = n_nationkey")
def lookup_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.lookup(_table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


_BANDS = [("low", 0.0, 49999.99), ("mid", 50000.0, 199999.99), ("high", 200000.0, 1000000.0), ("wide", 100000.0, 300000.0)]


@_add("range_lookup", "select o_orderkey, band from orders join (values " + ", ".join(f"('{b}', {lo}, {hi})" for b, lo, hi in _BANDS) + ") t(band, lo, hi) on o_totalprice between lo and hi")
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame(_BANDS, "band string, lo double, hi double")
    return relational.range_lookup(_table(spark, sf_dir, "orders"), bands, "o_totalprice", "lo", "hi", 50_000).select("o_orderkey", "band")


@_add("join_inner", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.join(_table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"]).select("o_orderkey", "c_name")


@_add("join_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.join(_table(spark, sf_dir, "customer"), orders, ["c_custkey"], "left_semi").select("c_custkey")


@_add("join_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relational.join(_table(spark, sf_dir, "customer"), orders, ["c_custkey"], "left_anti").select("c_custkey")


@_add("join_salted", "select l_orderkey, l_linenumber, s_name from lineitem join supplier on l_suppkey = s_suppkey")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return relational.salted_join(_table(spark, sf_dir, "lineitem"), suppliers, ["l_suppkey"], 4).select("l_orderkey", "l_linenumber", "s_name")


@_add(
    "join_as_of",
    """select a.event_id, b.value as bought from (select * from events where event_type <> 'purchase') a asof left join (select user_id, ts, max(value) as value from events where event_type = 'purchase' group by all) b
    on a.user_id = b.user_id and a.ts >= b.ts""",
)
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("bought"))
    return relational.as_of_join(events.where("event_type <> 'purchase'"), bought, "ts", ["user_id"], ["bought"]).select("event_id", "bought")


@_add("set_union", "select n_name as name from nation union all select r_name from region")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.union(_table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), _table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))


@_add("set_intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.intersect(_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@_add("set_except", "select n_nationkey as k from nation except select s_nationkey from supplier")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.subtract(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


_on("set_distinct", "orders", lambda df: df.select("o_orderstatus", "o_orderpriority").distinct(), "select distinct o_orderstatus, o_orderpriority from orders")
_on("group_cube", "orders", lambda df: relational.grouping_sets(df, "cube", ["o_orderstatus", "o_orderpriority"], [F.count(F.lit(1)).alias("n")]), "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
_on("window_rank", "orders", lambda df: rules.rank_within(df, ["o_custkey"], [F.col("o_totalprice").desc()]).where("rank <= 3").select("o_orderkey", "rank"), "select o_orderkey, (rank() over (partition by o_custkey order by o_totalprice desc))::int as rank from orders qualify rank <= 3")
_on(
    "window_running", "events", lambda df: df.select("event_id", F.count("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("n")),
    "select event_id, count(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as n from events",
)


def _event_windows(df: DataFrame) -> DataFrame:
    from sheaf.streaming.csv import windowed

    return windowed(df, "ts", "1 hour", [F.count(F.lit(1)).alias("n")], ["event_type"])


_on("event_windows", "events", _event_windows, "select time_bucket(interval '1 hour', ts) as window_start, time_bucket(interval '1 hour', ts) + interval '1 hour' as window_end, event_type, count(*) as n from events group by all")


def _event_sessions(df: DataFrame) -> DataFrame:
    from sheaf.streaming.csv import sessions

    return sessions(df, "ts", "6 hours", ["user_id"], [F.count(F.lit(1)).alias("n")])


_on(
    "event_sessions", "events", _event_sessions,
    """with e as (select user_id, ts, case when ts < lag(ts) over w + interval '6 hours' then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
    s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e)
    select user_id, min(ts) as session_start, max(ts) + interval '6 hours' as session_end, count(*) as n from s group by user_id, k""",
)


# Python hooks.
def _mapped(df: DataFrame) -> DataFrame:
    from sheaf.operators.hooks import map_rows

    return map_rows(df.select("n_nationkey", "n_name"), lambda r: {"k": r["n_nationkey"], "v": r["n_name"][::-1]} if r["n_nationkey"] % 2 else None, "k int, v string")


_on("udf_row_transform", "nation", _mapped, "select n_nationkey as k, reverse(n_name) as v from nation where n_nationkey % 2 = 1")


def _validated(df: DataFrame) -> DataFrame:
    from sheaf.operators.hooks import validate_rows

    return validate_rows(df.select("r_regionkey", "r_name"), lambda r: (len(r["r_name"]) > 4, "short"))[1]


_on("udf_validate", "region", _validated, "select r_regionkey, r_name, 'short' as _reason from region where length(r_name) <= 4")
_on(
    "unpivot", "nation", lambda df: reshape.unpivot(df.select("n_name", "n_nationkey", "n_regionkey"), ["n_name"], ["n_nationkey", "n_regionkey"]),
    "select n_name, 'n_nationkey' as field, n_nationkey as value from nation union all select n_name, 'n_regionkey', n_regionkey from nation",
)
_on("type_transform", "customer", lambda df: _formatted(df), "select c_custkey::varchar || ',' || case when c_acctbal < 0 then 'neg' else 'pos' end as value from customer")


def _formatted(df: DataFrame) -> DataFrame:
    from sheaf.sinks.csv import FormatOptions, lines

    shown = {"double": lambda c: F.when(c < 0, "neg").otherwise("pos")}
    return lines(df.select("c_custkey", "c_acctbal"), FormatOptions(type_transform=shown))


# Files: written to, and read from, a folder of their own.
def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared}/files-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    made = tempfile.mkdtemp(prefix="sheaf-files-")
    import atexit

    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"{made}/t"


@_add("csv_roundtrip", "select c_custkey::varchar as c_custkey, c_name, c_mktsegment from customer")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.sinks.csv import write_csv
    from sheaf.sources.csv import read_csv

    at = _folder(spark)
    write_csv(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), at)
    return read_csv(spark, f"{at}/*.csv", skip_empty_lines=True).rows


@_add("csv_advanced", "select n_nationkey::double as n_nationkey, n_name, n_regionkey::double as n_regionkey from nation")
def csv_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.sinks.csv import write_csv
    from sheaf.sources.csv import read_csv

    at = _folder(spark)
    write_csv(_table(spark, sf_dir, "nation").coalesce(1), at, delimiter=";")
    return read_csv(spark, f"{at}/*.csv", delimiter="", dynamic_typing=True).rows


@_add("csv_fast", "select s_suppkey::varchar as s_suppkey, s_name from supplier")
def csv_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.sinks.csv import write_csv
    from sheaf.sources.csv import read_fast

    at = _folder(spark)
    write_csv(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").coalesce(1), at)
    return read_fast(spark, f"{at}/*.csv")


@_add("sheet_roundtrip", "select n_nationkey::varchar as n_nationkey, n_name from nation")
def sheet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.sinks.sheet import write_sheet
    from sheaf.sources.sheet import sheet

    at = f"{_folder(spark)}.xlsx"
    write_sheet(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), at)
    return reshape.records(sheet(spark, at, "Sheet1")).drop(ordering.ROW)


@_add("stream_csv", "select r_regionkey, r_name from region where r_regionkey > 1")
def stream_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.sinks.csv import write_csv
    from sheaf.streaming import csv as stream

    at, to = _folder(spark), _folder(spark)
    write_csv(_table(spark, sf_dir, "region"), at)
    source = stream.read_stream(spark, at, "r_regionkey int, r_name string")
    kept = stream.transform(source, keep=F.col("r_regionkey") > 1)
    stream.write_stream(kept, to, f"{to}-state").awaitTermination()
    return spark.read.schema("r_regionkey int, r_name string").option("header", True).csv(to)


@_add("generated", None)
def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.sources.generate import generate

    return generate(spark, 1000, ["index", "int", "name", "email", "date", "uuid"])


@_add("generated_profile", "select 1000 as n, 1000 as indexes, 1000 as uuids, 1000 as mails")
def generated_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generated(spark, sf_dir)
    four = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("index_0")).alias("indexes"), F.count_distinct(F.when(F.col("uuid_5").rlike(four), F.col("uuid_5"))).alias("uuids"), F.count_if(F.col("email_3").contains("@")).alias("mails"))


# Literals of comparisons, and NaN, as a loosely typed host compares them.
_filtered("filter_lt_nan", "part", "p_partkey", Filter([Condition("p_size", "lt", "NaN")]), "false")
_filtered("filter_gt_nan", "part", "p_partkey", Filter([Condition("p_size", "gt", "NaN")]), "false")
_filtered("filter_lt_hex", "part", "p_partkey", Filter([Condition("p_size", "lt", " 0x10 ")]), "p_size < 16")
_filtered("filter_gt_underscore", "part", "p_partkey", Filter([Condition("p_size", "gt", "1_0")]), "false")
_filtered("filter_lte_blank", "customer", "c_custkey", Filter([Condition("c_acctbal", "lte", "  ")]), "c_acctbal <= 0")
_on(
    "filter_nan_column", "part", lambda df: predicates.where(df.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("p_size")).alias("v")), Filter([Condition("v", "gt", 10)])).select("p_partkey"),
    "select p_partkey from part where p_size % 2 = 1 and p_size > 10",
)


# Whole sorts, by the place that each row gets.
_on(
    "sort_all_date", "orders", lambda df: _placed(df.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")), [Sort("d", "desc", "date"), Sort("o_orderkey", "asc", "number")], "o_orderkey"),
    "select o_orderkey, row_number() over (order by o_orderdate::date desc, o_orderkey) - 1 as place from orders",
)
_on(
    "sort_all_auto", "part", lambda df: _placed(df.select("p_partkey", F.col("p_size").cast("string").alias("s")), [Sort("s", "desc", "auto"), Sort("p_partkey", "asc", "number")], "p_partkey"),
    "select p_partkey, row_number() over (order by p_size desc, p_partkey) - 1 as place from part",
)


def _placed(df: DataFrame, sorts: list[Sort], key: str) -> DataFrame:
    """The place of each row of a whole sort."""
    rows = ordering.sort(df, sorts).rdd.zipWithIndex().map(lambda x: (x[0][key], x[1]))
    return df.sparkSession.createDataFrame(rows, f"{key} long, place long")


# Coercions, dates, texts and addresses over fixed samples or whole columns.
_on("parse_boolean", "part", lambda df: df.select("p_partkey", coerce.parse_boolean(F.element_at(F.array(*map(F.lit, ["TRUE", "t", "1", "yes", "0"])), F.col("p_size") % 5 + 1)).alias("b")), "select p_partkey, p_size % 5 < 3 as b from part")
_on(
    "parse_iso", "orders", lambda df: df.select("o_orderkey", dates.parse_iso(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("timestamp_ntz").alias("t")),
    "select o_orderkey, date_trunc('second', o_orderdate) as t from orders",
)
_on("xml_decode", "part", lambda df: df.select("p_partkey", text.xml_decode(text.xml_encode(F.concat(F.lit("<&\"'>"), F.col("p_name")))).alias("x")), "select p_partkey, '<&\"''>' || p_name as x from part")
_on("letters_round_trip", "events", lambda df: df.select("event_id", address.decode_cell(address.encode_cell(F.lit(7), F.col("event_id") % 16384 + 1)).alias("d")).select("event_id", "d.row", "d.col"), "select event_id, 7 as row, (event_id % 16384 + 1)::int as col from events")
_sheet = lambda df: df.select((F.col("r_regionkey") + 1).alias(ordering.ROW), F.col("r_regionkey").cast("string").alias("c1"), F.when(F.col("r_regionkey") != 2, F.col("r_name")).alias("c2"))
_on("sheet_letters", "region", lambda df: reshape.records(_sheet(df), "A").drop(ordering.ROW), "select r_regionkey::varchar as A, case when r_regionkey <> 2 then r_name end as B from region")
_on("sheet_own_keys", "region", lambda df: reshape.records(_sheet(df), ["id", "name"], default="none").drop(ordering.ROW), "select r_regionkey::varchar as id, case when r_regionkey <> 2 then r_name else 'none' end as name from region")
_on("sheet_arrays", "region", lambda df: reshape.records(_sheet(df), 1).select(F.array_join("values", "|", "-").alias("v")), "select r_regionkey::varchar || '|' || case when r_regionkey <> 2 then r_name else '-' end as v from region")
_on("project_headers", "nation", lambda df: reshape.project(df, ["n_name", ("n_regionkey", "Region")]), 'select n_name, n_regionkey as "Region" from nation')


# Scanner options: a file that the query writes, and the rows that it must give.
def _scanned(name: str, content: str, rows: list[tuple], names: str, **options: object) -> None:
    """A query that reads content with options; rows are what SQL says of it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from sheaf.sources.csv import read_csv

        at = _folder(spark)
        spark.createDataFrame([(content,)], "value string").coalesce(1).write.option("lineSep", "\n").text(at)
        return read_csv(spark, f"{at}/part-*", **options).rows

    shown = lambda v: "null" if v is None else "'" + str(v).replace("'", "''") + "'"
    _QUERIES[name] = (run, "select * from (values " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + f") t({names})")


_scanned("csv_pad_truncate", "a,b\n1\n2,3,4\n5,6", [("1", ""), ("2", "3"), ("5", "6")], "a, b", less="pad", more="truncate")
_scanned("csv_rejects", "a,b\n1\n2,3,4\n5,6", [("5", "6")], "a, b")
_scanned("csv_comments", "a,b\n#1,2\n3,4\n\n5,#6", [("3", "4"), ("5", "#6")], "a, b", comment="#", skip_empty_lines=True)
_scanned("csv_window", "x\na,b\n1,2\n3,4\n5,6\n7,8", [("3", "4"), ("5", "6")], "a, b", skip_lines=1, skip_rows=1, max_rows=2)
_scanned("csv_header_repeat", "a,b\n1,2\na,b\n3,4", [("1", "2"), ("a", "b"), ("3", "4")], "a, b", skip_empty_lines=True)
_scanned("csv_trim", "a , b\n 1 , 2 ", [("1", "2")], "a, b", trim=True)
_scanned("csv_quotes", "a;b\n'x;y';'it''s'\n'1\n2';z", [("x;y", "it's"), ("1\n2", "z")], "a, b", delimiter=";", quote="'")
_scanned("csv_no_quotes", 'a,b\n"x",y', [('"x"', "y")], "a, b", quote=None)
_scanned("csv_multi_delimiter", "a||b\n1||2|3", [("1", "2|3")], "a, b", delimiter="||")
_scanned("csv_own_headers", "1,2\n3,4", [("1", "2"), ("3", "4")], "x, y", headers=["x", "y"])
_scanned("csv_header_dedupe", "k,v,v\n1,2,3", [("1", "2", "3")], "k, v, v_1")
_scanned("csv_empty_values", "a,b\n,\n1,2", [("1", "2")], "a, b", skip_records_with_empty_values=True)


def queries() -> dict[str, Run]:
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}
