"""Delimited text, worksheets, archives, generated tables, sinks, streams, rules and reshaping."""

import io
import tarfile
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sheaf.functions.address import Range
from sheaf.operators import pivot, relational, reshape, rules
from sheaf.sinks.csv import FormatOptions, to_text, write_csv
from sheaf.sinks.sheet import workbook_bytes, workbooks, write_sheet
from sheaf.sources import csv_scan
from sheaf.sources.archive import decompressed, entries, files
from sheaf.sources.csv import read_csv, read_fast
from sheaf.sources.csv_scan import CsvOptions
from sheaf.sources.generate import Field, generate
from sheaf.sources.sheet import cells, sheet
from sheaf.streaming import csv as stream


def rows_of(text, **o):
    options = CsvOptions(**o)
    names, _ = csv_scan.headers_of(text, options)
    return [r.fields for r in csv_scan.scan(text, options, len(names) if names else None) if r.kept]


def test_scanner():
    assert rows_of("name,age\nAlice,30\nBob,25") == [["Alice", "30"], ["Bob", "25"]]
    assert rows_of('a,b\r\n"x, ""y""","1\r\n2"\r\n') == [['x, "y"', "1\n2"]]
    assert rows_of("a||b\n1||2", delimiter="||") == [["1", "2"]]
    assert rows_of('a,b\n"p" q",2', relax_quotes=True) == [['p" q', "2"]]
    assert rows_of("a,b\n'x,y',\\'", quote="'", escape="\\") == [["x,y", "\\'"]]
    assert rows_of('a,b\n"x",y', quote=None) == [['"x"', "y"]]
    assert rows_of("a,b\n#c\n1,2\n\n3,4", comment="#", skip_empty_lines=True) == [["1", "2"], ["3", "4"]]
    assert rows_of("junk\na,b\n1,2\n3,4\n5,6", skip_lines=1, skip_rows=1, max_rows=1) == [["3", "4"]]
    assert rows_of("a,b\n1,2\n3,4", to_line=2) == [["1", "2"]]
    assert rows_of("a,b\n1\n1,2,3", less="pad", more="truncate") == [["1", ""], ["1", "2"]]
    assert rows_of("a,b\n1\n1,2,3\n4,5") == [["4", "5"]]
    assert rows_of("a , b\n 1 , 2 ", trim=True) == [["1", "2"]]
    assert rows_of("1,2\n3,4", headers=["x", None]) == [["1", "2"], ["3", "4"]]
    assert rows_of("a,b\n,\n1,2", skip_records_with_empty_values=True) == [["1", "2"]]
    assert rows_of("") == [] and rows_of("a,b") == []
    with pytest.raises(ValueError):
        rows_of("a,b\nxxxxxxxxxx,1", max_row_bytes=5)
    with pytest.raises(ValueError):
        rows_of("a,b\n1,2", headers=lambda h: h[:1])
    got = list(csv_scan.scan('a,b\n1,2\n"open', CsvOptions(), 2))
    assert (got[1].error, got[1].kept, got[0].line, got[0].offset, got[0].raw, got[0].quoted) == ("TooFewFields", False, 2, 4, "1,2", [False, False])


def test_detection():
    for d in (",", ";", "\t", "|"):
        assert csv_scan.detect_delimiter(f"a{d}b{d}c\n1{d}2{d}3") == d
    assert csv_scan.detect_delimiter("") == "," and csv_scan.detect_delimiter('"a;b;c",d\n"e;f",g') == ","
    assert csv_scan.detect_line_end('"a\nb",c\r\nd') == "\r\n" and csv_scan.detect_line_end("a") == "\n" and csv_scan.detect_line_end("a\rb") == "\r"
    assert csv_scan.distinct_headers(["id", "name", "name", "name", "", None, "name_1"])[0] == ["id", "name", "name_2", "name_3", "_column_4", None, "name_1"]
    assert csv_scan.distinct_headers(["a", "a"]) == (["a", "a_1"], {"a_1": "a"})


def test_read_csv(spark, tmp_path):
    at = tmp_path / "x.csv"
    at.write_bytes("﻿id,name,name,flag\n1,a,b,true\n2,\"c\nd\",e,FALSE\n3,x\n2,z,z,true\n".encode())
    got = read_csv(spark, str(at), info=True, dynamic_typing=True)
    assert got.headers == ["id", "name", "name_1", "flag"] and got.renamed == {"name_1": "name"}
    first, second, third = got.rows.collect()
    assert (first["id"], first["flag"], first["_info"]["line"]) == (1.0, True, 2) and second["name"] == "c\nd" and third["_info"]["line"] == 6
    assert [(r["line"], r["error"]) for r in got.rejects.collect()] == [(5, "TooFewFields")]
    last = read_csv(spark, str(at), key="id", less="pad").rows
    assert {r["id"]: r["name"] for r in last.collect()} == {"1": "a", "2": "z", "3": "x"}
    grouped = read_csv(spark, str(at), group_columns_by_name=True).rows
    assert grouped.columns == ["id", "name", "flag"] and grouped.first()["name"] == ["a", "b"]
    checked = read_csv(spark, str(at), validate=F.col("flag") == "true")
    assert checked.rows.count() == 2 and checked.rejects.count() == 2
    keep = read_csv(spark, str(at), headers=False, more="keep", row_transform=lambda df: df.where("_c0 <> '1'"))
    assert keep.rows.count() == 4 and keep.headers is None
    fast = tmp_path / "fast.csv"
    fast.write_text("a;b\n1;2\n;3\n")
    assert [tuple(r) for r in read_fast(spark, str(fast), ";").collect()] == [("1", "2"), ("", "3")]


def test_native_and_scanner_agree(spark, tmp_path):
    at = tmp_path / "n.csv"
    at.write_text('a,b\n1,"x ""q"""\n,\n"l1\nl2",z\n1,2,3\n')
    fast, slow = (read_csv(spark, str(at), skip_empty_lines=how) for how in (True, "greedy"))
    assert sorted(map(tuple, fast.rows.collect())) == [("", ""), ("1", 'x "q"'), ("l1\nl2", "z")]
    assert sorted(map(tuple, slow.rows.collect())) == [("1", 'x "q"'), ("l1\nl2", "z")] and fast.rows.count() == 3  # greedily, blank fields are an empty line
    assert fast.rejects.count() == slow.rejects.count() == 1


def test_dates_and_ids(spark, tmp_path):
    at = tmp_path / "d.csv"
    at.write_text("date,value,id\n2024-01-15,100,007\n2024-06-30,200,008\n")
    rows = read_csv(spark, str(at), cast_dates=["date"], dynamic_typing=["value", "id"]).rows
    assert dict(rows.dtypes) == {"date": "timestamp", "value": "double", "id": "string"}
    assert rows.first()["date"] == datetime(2024, 1, 15)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a,b", True, None), (2.5, "=x", False, "q")], "n double, s string, b boolean, z string")
    assert to_text(df, escape_formulae=True, decimal=",", delimiter=";") == "n;s;b;z\n1;a,b;true;\n2,5;'=x;false;q"
    assert to_text(df, columns=[("s", "S")], bom=True, trailing_newline=True, quote_columns=True) == '﻿S\n"a,b"\n"=x"\n'
    with pytest.raises(ValueError):
        FormatOptions(decimal=",", delimiter=",")
    write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, read_csv(spark, f"{tmp_path}/out/*.csv", dynamic_typing=True).rows.collect())) == [(1.0, "a,b", True, ""), (2.5, "=x", False, "q")]


def test_sheets(spark, tmp_path):
    df = spark.createDataFrame([(1, "a <&> b", True, datetime(2020, 1, 2, 3, 4, 5)), (2, None, False, None)], "k int, s string, b boolean, t timestamp")
    at = str(tmp_path / "x.xlsx")
    write_sheet(df, at, "Data")
    got = {(r["row"], r["col"]): (r["type"], r["text"]) for r in cells(spark, at).collect()}
    assert got[(1, 1)] == ("string", "k") and got[(2, 1)] == ("number", "1") and got[(2, 2)] == ("string", "a <&> b") and got[(2, 3)] == ("boolean", "true")
    assert got[(2, 4)] == ("date", "2020-01-02T03:04:05.000") and (3, 2) not in got
    wide = reshape.records(sheet(spark, at, "Data"))
    assert wide.columns == ["__row", "k", "s", "b", "t"] and [r["k"] for r in wide.orderBy("__row").collect()] == ["1", "2"]
    assert reshape.records(sheet(spark, at, "Data"), header="A").columns[1:] == ["A", "B", "C", "D"]
    assert reshape.records(sheet(spark, at, "Data"), header=1).orderBy("__row").first()["values"][0] == "k"
    assert workbooks(df).agg(F.sum("rows")).first()[0] == 2 and workbook_bytes({"a": (["x"], [])})[:2] == b"PK"
    assert reshape.sheet_headers(["h", "h", None, ""]) == ["h", "h_1", "__EMPTY", "__EMPTY_1"]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.csv", "1")
        z.writestr("y.txt", "22")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("z.csv")
        info.size = 3
        t.addfile(info, io.BytesIO(b"333"))
    got = {r["path"]: bytes(r["content"]) for r in entries(spark, f"{tmp_path}/*.[zg]*", "**/*.csv").collect()}
    assert got == {"d/x.csv": b"1", "z.csv": b"333"}
    import gzip

    (tmp_path / "c.gzip").write_bytes(gzip.compress(b"data"))
    assert bytes(decompressed(spark, f"{tmp_path}/c.gzip").first()["content"]) == b"data"
    assert files(spark, str(tmp_path), "*.zip").count() == 1


def test_generate(spark):
    types = "string int float bool date datetime uuid email name firstName lastName word sentence paragraph phone url ip ipv6 hex index company country currency percent timestamp city zipCode color username slug".split()
    df = generate(spark, 50, [*types, Field("int", min=5, max=7, nullable=0.5, name="few"), Field(values=["x", "y"], name="v")])
    rows = df.collect()
    assert len(rows) == 50 and df.columns[:2] == ["string_0", "int_1"] and rows == generate(spark, 50, [*types, Field("int", min=5, max=7, nullable=0.5, name="few"), Field(values=["x", "y"], name="v")], partitions=3).collect()
    few = [r["few"] for r in rows]
    assert 5 < few.count(None) < 45 and {x for x in few if x} <= {5, 6, 7} and {r["v"] for r in rows} == {"x", "y"}
    with pytest.raises(ValueError):
        generate(spark, 1, ["lorem"])


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text("k,v\n1,a\n2,\n3,c\n")
    df = stream.read_stream(spark, str(source), "k int, v string")
    good, bad = [], []
    query = stream.in_chunks(df, lambda b, n: good.extend(map(tuple, b.collect())), str(tmp_path / "s"), rejects=(F.col("v") != "", lambda b, n: bad.extend(map(tuple, b.collect()))), limit=1)
    query.awaitTermination()
    assert len(good) == 1 and bad == [(2, "")]
    assert stream.json_rows(spark.createDataFrame([(1, "a")], "k int, v string")).first()[0] == '{"k":1,"v":"a"}'


SALES = [("north", "jan", "tea", 3, 10), ("north", "feb", "tea", 1, 7), ("south", "jan", "rye", 8, 20), ("south", "feb", "rye", 6, 31), ("west", "jan", "oat", 2, 12), ("west", "feb", "oat", 9, 4)]


def test_pivot(spark):
    df = spark.createDataFrame(SALES, "A string, B string, C string, D long, E long")
    got = {(r["A"], r["B"]): (r["tea"], r["rye"], r["oat"]) for r in pivot.pivot(df, pivot.Pivot(["A", "B"], [pivot.Value("E")], ["C"])).collect()}
    assert got[("north", "jan")] == (10, None, None) and got[("west", "feb")] == (None, None, 4)
    total = pivot.pivot(df, pivot.Pivot(["A"], [pivot.Value("E", "average")], ["C"], totals=True)).where("__level = 1").first()
    assert total["total"] == pytest.approx(84 / 6) and total["rye"] == 25.5
    assert pivot.Value("E").name == "Sum of E"
    for bad in (pivot.Pivot([], [pivot.Value("E")]), pivot.Pivot(["A"], []), pivot.Pivot(["A"], [pivot.Value("E")], ["A"]), pivot.Pivot(["A"], [pivot.Value("Z")])):
        with pytest.raises(ValueError):
            pivot.pivot(df, bad)
    assert [r[0] for r in pivot.shared_items(spark.createDataFrame([("10",), ("b",), ("9",), (None,), ("2020-01-01",), ("a",), ("9",)], "v string"), "v").collect()] == ["9", "10", "2020-01-01", "a", "b", None]


def test_rules_and_ranges(spark):
    df = spark.range(1, 11).select(F.col("id").cast("int").alias("v"))
    assert rules.top_n(df, "v", 3).where("in_top").count() == 3 and rules.top_n(df, "v", 20, percent=True, bottom=True).where("in_top").count() == 2
    assert rules.above_average(df, "v").where("above_average").count() == 5
    assert [r["icon"] for r in rules.icon_set(df, "v", [("min", None), ("percent", 50), ("percentile", 90)]).orderBy("v").collect()] == [0] * 5 + [1] * 4 + [2]
    texts = spark.createDataFrame([("#N/A",), (" ",), ("Abc",), (None,)], "t string")
    flags = lambda k, x="": [r[0] for r in texts.select(rules.contains_text(F.col("t"), k, x)).collect()]
    assert flags("containsErrors") == [True, False, False, False] and flags("containsBlanks") == [False, True, False, True] and flags("containsText", "B") == [False, False, True, False]
    assert texts.where(rules.custom_filter(F.col("t"), [("equal", "a?c"), ("equal", "#*")])).count() == 2
    grid = spark.createDataFrame([(1, 1, "m"), (3, 3, "x")], "row int, col int, value string")
    filled = {(r["row"], r["col"]): r["value"] for r in relational.fill_merges(grid, [Range.of("A1:B2")]).collect()}
    assert filled == {(1, 1): "m", (1, 2): "m", (2, 1): "m", (2, 2): "m", (3, 3): "x"}
    assert relational.overlapping([Range.of("A1:B2"), Range.of("B2:C3"), Range.of("D4")]) == [(Range.of("A1:B2"), Range.of("B2:C3"))]


def test_workbook_and_rows(spark):
    book = reshape.Workbook(spark)
    book.add("a", spark.range(3))
    assert [(n, d.count()) for n, d in book.each()] == [("a", 3)]
    book.remove("a")
    assert book.names == []
    pairs = reshape.to_pairs(spark.createDataFrame([(1, "x")], "k int, v string"))
    assert pairs.select(reshape.pair_values(F.col("pairs"))).first()[0] == ["1", "x"]


def test_shares_and_indexes_without_one_task(spark):
    values = spark.range(1, 5001).select((F.col("id") * 7919 % 1000).cast("double").alias("v"))
    ordered = sorted(r["v"] for r in values.collect())
    assert all(rules.nth_value(values, n, 5000, few=100) == ordered[n - 1] for n in (1, 7, 2500, 4999, 5000))
    assert rules.nth_value(values.limit(3), 4, 3) is None
    got = {r["v"]: r["v_index"] for r in pivot.encode_records(values, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(ordered)))}


def test_salted_join_is_the_same_every_time(spark):
    big = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, t string")
    plan = relational.salted_join(big, small, ["k"])._jdf.queryExecution().toString()
    assert "rand(" not in plan
    assert sorted(map(tuple, relational.salted_join(big, small, ["k"]).collect())) == sorted(map(tuple, big.join(small, "k").collect()))


def test_native_rejects_and_heads(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x,1"\n2\n3,4,5\n6,\n')
    (tmp_path / "b.csv").write_text("k,v\n7,8\nk,v\n")
    got = read_csv(spark, str(tmp_path), skip_empty_lines=True, quoted_line_ends=False)
    assert sorted(map(tuple, got.rows.collect())) == [("1", "x,1"), ("6", ""), ("7", "8"), ("k", "v")]
    bad = sorted((r["error"], r["raw"], r["file"].rsplit("/", 1)[1]) for r in got.rejects.collect())
    assert bad == [("TooFewFields", "2", "a.csv"), ("TooManyFields", "3,4,5", "a.csv")]
    fast = read_fast(spark, str(tmp_path / "b.csv"))
    assert sorted(map(tuple, fast.collect())) == [("7", "8"), ("k", "v")] and fast.columns == ["k", "v"]
    (tmp_path / "long.csv").write_text("x" * 3_000_000 + ",y\n1,2\n")
    assert len(read_csv(spark, str(tmp_path / "long.csv"), skip_empty_lines=True).headers[0]) == 3_000_000
