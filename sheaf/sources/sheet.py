"""XLSX worksheets as DataFrames: a task for each file, all its sheets as cells in one long table."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.address import to_number
from sheaf.functions.dates import is_date_format
from sheaf.functions.text import decode_ooxml

CELL = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("sheet", T.StringType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("number", T.DoubleType()),
        T.StructField("formula", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("hyperlink", T.StringType()),
    ]
)
#: Number formats by id.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm",
    17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)",
    40: "#,##0.00;[Red](#,##0.00)", 41: '_(* #,##0_);_(* (#,##0);_(* "-"_);_(@_)', 42: '_($* #,##0_);_($* (#,##0);_($* "-"_);_(@_)', 43: '_(* #,##0.00_);_(* (#,##0.00);_(* "-"??_);_(@_)',
    44: '_($* #,##0.00_);_($* (#,##0.00);_($* "-"??_);_(@_)', 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
SERIAL_EPOCH, SERIAL_1904 = 25569, 1462


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _text(e: ElementTree.Element) -> str:
    """Plain or rich text: phonetic runs don't count."""
    out = []
    for child in e:
        if _local(child.tag) == "t":
            out.append(child.text or "")
        elif _local(child.tag) == "r":
            out += [t.text or "" for t in child if _local(t.tag) == "t"]
    return decode_ooxml("".join(out))


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, bool]]:
    folder, _, name = part.rpartition("/")
    root = _part(z, f"{folder}/_rels/{name}.rels")
    found = {}
    for r in root if root is not None else []:
        target, outside = r.attrib["Target"], r.attrib.get("TargetMode") == "External"
        if not outside:
            parts: list[str] = [] if target.startswith("/") else folder.split("/")
            for p in target.strip("/").split("/"):
                parts = parts[:-1] if p == ".." else [*parts, p]
            target = "/".join(parts)
        found[r.attrib["Id"]] = (target, outside)
    return found


def read_cells(data: bytes, sheets: set[str] | None = None) -> Iterator[dict[str, Any]]:
    """Cells of a workbook's sheets, row by row. Formulas give their stored result; dates are told by number formats."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = _part(z, "xl/workbook.xml")
        relations = _relations(z, "xl/workbook.xml")
        date1904 = any(_local(e.tag) == "workbookPr" and e.attrib.get("date1904") in ("1", "true") for e in book)
        strings_root = _part(z, "xl/sharedStrings.xml")
        strings = [_text(si) for si in strings_root] if strings_root is not None else []
        formats = _formats(_part(z, "xl/styles.xml"))
        listed = [(s.attrib["name"], _attribute(s, "id")) for e in book if _local(e.tag) == "sheets" for s in e]
        for name, rid in listed:
            part = relations.get(rid, (None, False))[0]
            if (sheets is None or name in sheets) and part in z.namelist():
                yield from _sheet(z, name, part, strings, formats, date1904)


def _formats(styles: ElementTree.Element | None) -> list[str]:
    custom: dict[int, str] = dict(BUILT_IN)
    found: list[str] = []
    for e in styles if styles is not None else []:
        if _local(e.tag) == "numFmts":
            custom |= {int(n.attrib["numFmtId"]): n.attrib["formatCode"] for n in e}
        if _local(e.tag) == "cellXfs":
            found = [custom.get(int(x.attrib.get("numFmtId", 0)), "General") for x in e]
    return found


def _sheet(z: zipfile.ZipFile, name: str, part: str, strings: list[str], formats: list[str], date1904: bool) -> Iterator[dict[str, Any]]:
    links = _links(z, part)
    row_number = 0
    with z.open(part) as f:
        for _, e in ElementTree.iterparse(f):
            if _local(e.tag) != "row":
                continue
            row_number = int(e.attrib.get("r", row_number + 1))
            col = 0
            for c in e:
                if _local(c.tag) != "c":
                    continue
                address = c.attrib.get("r", "")
                letters = re.match("[A-Za-z]+", address)
                col = to_number(letters.group()) if letters else col + 1
                cell = _cell(c, strings, formats, date1904)
                if cell is not None:
                    yield {"sheet": name, "row": row_number, "col": col, "hyperlink": links.get(address), **cell}
            e.clear()


def _links(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    relations = {k: t for k, (t, outside) in _relations(z, part).items() if outside}
    if not relations:
        return {}
    return {h.attrib["ref"]: relations[rid] for h in ElementTree.fromstring(z.read(part)).iter() if _local(h.tag) == "hyperlink" and (rid := _attribute(h, "id")) in relations}


def _cell(c: ElementTree.Element, strings: list[str], formats: list[str], date1904: bool) -> dict[str, Any] | None:
    kind = c.attrib.get("t", "n")
    style = int(c.attrib.get("s", 0))
    fmt = formats[style] if style < len(formats) else "General"
    value = formula = None
    for e in c:
        tag = _local(e.tag)
        if tag == "v":
            value = e.text or ""
        elif tag == "f":
            formula = e.text or ""
        elif tag == "is":
            value = _text(e)
    if value is None and formula is None:
        return None
    out = {"type": "null", "text": value, "number": None, "formula": formula, "format": fmt}
    if value is None:
        return out
    if kind == "s":
        return out | {"type": "string", "text": strings[int(value)] if int(value) < len(strings) else None}
    if kind in ("str", "inlineStr"):
        return out | {"type": "string", "text": decode_ooxml(value)}
    if kind == "b":
        return out | {"type": "boolean", "text": "true" if value in ("1", "true") else "false"}
    if kind == "e":
        return out | {"type": "error"}
    if kind == "d":
        return out | {"type": "date"}
    number = float(value)
    if is_date_format(fmt):
        from datetime import datetime, timedelta

        days = number - SERIAL_EPOCH + (SERIAL_1904 if date1904 else 0)
        stamp = datetime(1970, 1, 1) + timedelta(milliseconds=int(days * 86_400_000 + 0.5))
        return out | {"type": "date", "text": stamp.isoformat(timespec="milliseconds"), "number": number}
    return out | {"type": "number", "text": str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number), "number": number}


def cells(spark: SparkSession, path: str, sheets: list[str] | None = None) -> DataFrame:
    """All cells of the workbooks at a path."""
    wanted = set(sheets) if sheets else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(CELL)
        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                held = []
                for c in read_cells(content.as_py(), wanted):
                    held.append(c | {"file": file})
                    if len(held) == 8192:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CELL)


def sheet(spark: SparkSession, path: str, name: str, width: int | None = None) -> DataFrame:
    """One sheet as a wide table of text columns c1, c2, ... and __row, its row number."""
    found = cells(spark, path, [name])
    n = width or found.agg(F.max("col")).first()[0] or 0
    return found.groupBy(F.col("row").alias("__row")).pivot("col", list(range(1, n + 1))).agg(F.first("text")).toDF("__row", *(f"c{i}" for i in range(1, n + 1)))
