import zlib

import pytest
from pyspark.sql import functions as F

from sheaf.functions import address, dates, text
from sheaf.functions.cellformat import format_value, number_format


def one(spark, c, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(c(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("fmt", "s", "want"),
    [
        ("YYYY-MM-DD", "2024-01-15", "2024-01-15 00:00:00"), ("MM/DD/YYYY HH:mm:ss", "01/15/2024 10:20:30", "2024-01-15 10:20:30"), ("DD-MM-YYYY", "15-01-2024", "2024-01-15 00:00:00"),
        ("YYYY-MM-DD[T]HH:mm:ssZ", "2024-01-15T10:30:00+02:00", "2024-01-15 08:30:00"), ("YYYY-MM-DD[T]HH:mm:ss.SSSZ", "2024-01-15T10:30:00.250Z", "2024-01-15 10:30:00.250000"),
        ("YYYY-MM-DD", "2024-02-30", None), ("YYYY-MM-DD", "2024-1-5", None),
    ],
)
def test_parse(spark, fmt, s, want):
    got = one(spark, lambda c: dates.parse_dates(c, [fmt]), s)
    assert (str(got) if got else None) == want


def test_dates(spark):
    assert str(one(spark, dates.parse_iso, "2024-01-15T10:30:00Z")) == "2024-01-15 10:30:00"
    assert str(one(spark, lambda c: dates.parse_iso(c, compat=True), "2024-01-15T10:30:00")) == "2024-01-15 00:00:00"
    assert one(spark, dates.cast_date, "100") is None
    assert one(spark, lambda c: dates.format_date(c.cast("timestamp"), "YYYY[year]MM"), "2024-03-01 00:00:00") == "2024year03"
    assert one(spark, lambda c: dates.format_date(c.cast("timestamp")), None) == ""
    assert one(spark, lambda c: dates.to_serial(c.cast("timestamp")), "2020-01-01 12:00:00") == 43831.5
    assert one(spark, lambda c: dates.to_serial(c.cast("timestamp"), True), "2020-01-01 00:00:00") == 42369
    assert str(one(spark, dates.from_serial, 43831.5, "double")) == "2020-01-01 12:00:00"
    with pytest.raises(ValueError):
        dates.parse_dates(F.lit("x"), ["YY"])


@pytest.mark.parametrize(("fmt", "is_date"), [("m/d/yy", True), ("General", False), ("0.00", False), ("[h]:mm:ss", True), ("[Red]0", False), ('0 "days"', False), ("@", False), ("yyyy-mm-dd", True), ("0.00E+00", False), (None, False), ("mmss.0", True)])
def test_date_formats(fmt, is_date):
    assert dates.is_date_format(fmt) == is_date


@pytest.mark.parametrize(
    ("fmt", "value", "want"),
    [
        ("General", 1234.5, "1234.5"), ("General", 1e20, "1E+20"), ("General", 0.1 + 0.2, "0.3"), ("0.00", 1234.567, "1234.57"), ("#,##0", 1234567, "1,234,567"), ("#,##0.00", -1234.5, "-1,234.50"), ("0%", 0.256, "26%"),
        ("0.00E+00", 12345, "1.23E+04"), ("##0.0E+0", 12345, "12.3E+3"), ("# ?/?", 1.5, "1 1/2"), ("m/d/yy", 43831, "1/1/20"), ("h:mm AM/PM", 0.75, "6:00 PM"),
        ("[h]:mm:ss", 1.5, "36:00:00"), ("#,##0 ;(#,##0)", -5, "(5)"), ("yyyy-mm-dd hh:mm:ss", 43831.5, "2020-01-01 12:00:00"), ('[>100]"big";0', 150, "big"), ("@", "x", "x"), ("0.0,,", 12345678, "12.3"),
        ("mmss.0", 0.0007, "0100.4"), ("000-00", 12345, "123-45"), ("d-mmm-yy", 43831, "1-Jan-20"), ("0.00", None, ""), ("0", True, "TRUE"), ("0;-0;zero", 0, "zero"), ("0.0#", 1.5, "1.5"), ("0.5 \\k", 2, "2.5 k"), ("# ??/??", 0.333, "  1/3 "),
    ],
)
def test_cell_formats(fmt, value, want):
    assert format_value(fmt, value) == want


def test_built_in():
    assert number_format(14) == "m/d/yy" and number_format(999) == "General"


def test_text(spark):
    assert one(spark, text.escape_formula, "=1+1") == "'=1+1" and one(spark, text.escape_formula, "＝x") == "'＝x" and one(spark, text.escape_formula, "a=1") == "a=1"
    assert one(spark, text.quote_field, 'a"b') == '"a""b"' and one(spark, text.quote_field, "a,b") == '"a,b"' and one(spark, text.quote_field, "ab") == "ab" and one(spark, text.quote_field, None) == ""
    assert one(spark, text.utf8_length, "é😀") == 6
    assert one(spark, lambda c: text.xml_decode(text.xml_encode(c)), "<a b='1'>&\"") == "<a b='1'>&\"" and one(spark, text.xml_decode, "&#65;&#x42;&zz;") == "AB&zz;"
    assert text.decode_ooxml(text.encode_ooxml("a\x01_x0041_")) == "a\x01_x0041_"
    assert one(spark, lambda c: text.glob_match(c, "**/*.{csv,tsv}"), "a/b/c.tsv") and not one(spark, lambda c: text.glob_match(c, "*.csv"), "a/b.csv")
    assert one(spark, text.table_name, "A1") == "_A1" and one(spark, text.table_name, "my table") == "my_table" and one(spark, text.table_name, "1x") == "_1x"
    data = b"hello" * 50
    deflate = zlib.compressobj(wbits=-15)
    for packed in (zlib.compress(data), zlib.compress(data, wbits=31), deflate.compress(data) + deflate.flush()):
        assert text.decompress(packed) == data
    assert one(spark, text.adler32, bytearray(data), "binary") == zlib.adler32(data)
    assert one(spark, text.entropy, bytearray(range(256)), "binary") == 8.0


def test_addresses(spark):
    for n, letters in [(1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA"), (16384, "XFD")]:
        assert one(spark, address.column_letters, n, "int") == letters == address.to_letters(n)
        assert one(spark, address.column_number, letters) == n == address.to_number(letters)
    assert one(spark, address.decode_cell, "$B$3").asDict() == {"row": 3, "col": 2}
    r = address.Range.of("Sheet1!$B$2:D9")
    assert (r.top, r.left, r.bottom, r.right, r.count, str(r)) == (2, 2, 9, 4, 24, "B2:D9")
    assert r.intersects(address.Range.of("D9")) and not r.intersects(address.Range.of("E1:F20")) and str(r.expand(1, 5)) == "B1:E9"
    assert address.slide_formula("A1+$B$2+C$3*SUM(D4)", 1, 1) == "B2+$B$2+D$3*SUM(E5)"
    assert one(spark, address.dependencies, "SUM(A1:B2)+C3") == ["A1:B2", "C3"]


def test_base64_of_whole_texts(spark, sf_dir):
    import base64

    from sheaf import catalogue

    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in catalogue.queries()["base64"](spark, sf_dir).collect():
        assert base64.b64decode(r["b"]).decode() == texts[r["doc_id"]]
