"""XLSX sink: values and a header row, a file for each partition."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import date, datetime
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame

from sheaf.functions.address import to_letters
from sheaf.functions.text import encode_ooxml

MOST_ROWS = 1_048_575  # that a sheet holds below its header
_NS = "http://schemas.openxmlformats.org"


def _cell(address: str, v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{address}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{address}"><v>{v!r}</v></c>' if v == v and abs(v) != float("inf") else ""
    if isinstance(v, (datetime, date)):
        stamp = v if isinstance(v, datetime) else datetime(v.year, v.month, v.day)
        days = (stamp.replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds() / 86400 + 25569
        return f'<c r="{address}" s="1"><v>{days!r}</v></c>'
    return f'<c r="{address}" t="inlineStr"><is><t xml:space="preserve">{escape(encode_ooxml(str(v)))}</t></is></c>'


def workbook_bytes(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """A workbook of sheets: name to (header, rows)."""
    out = io.BytesIO()
    names = list(sheets)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{_NS}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
        rels = lambda body: f'<?xml version="1.0"?><Relationships xmlns="{_NS}/package/2006/relationships">{body}</Relationships>'
        rel = lambda i, kind, target: f'<Relationship Id="rId{i}" Type="{_NS}/officeDocument/2006/relationships/{kind}" Target="{target}"/>'
        z.writestr("_rels/.rels", rels(rel(1, "officeDocument", "xl/workbook.xml")))
        z.writestr("xl/_rels/workbook.xml.rels", rels("".join(rel(i, "worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(names) + 1)) + rel(len(names) + 1, "styles", "styles.xml")))
        listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS}/spreadsheetml/2006/main" xmlns:r="{_NS}/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0"?><styleSheet xmlns="{_NS}/spreadsheetml/2006/main"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm:ss"/></numFmts><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>')
        for i, (header, rows) in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<?xml version="1.0"?><worksheet xmlns="{_NS}/spreadsheetml/2006/main"><sheetData>'.encode())
                for r, row in enumerate([tuple(header), *rows], 1):
                    cells = "".join(_cell(f"{to_letters(c)}{r}", v) for c, v in enumerate(row, 1))
                    f.write(f'<row r="{r}">{cells}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def workbooks(df: DataFrame, name: str = "Sheet1", rows_per_file: int = MOST_ROWS) -> DataFrame:
    """Workbooks of the rows of each partition: (part, rows, content). Tasks hold one workbook at a time."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def put() -> pa.RecordBatch:
            cols = [pa.array([len(held)], pa.int64()), pa.array([workbook_bytes({name: (names, held)})], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["rows", "content"])

        for batch in batches:
            held += list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            while len(held) >= rows_per_file:
                rest, held = held[rows_per_file:], held[:rows_per_file]
                yield put()
                held = rest
        if held:
            yield put()

    return df.mapInArrow(run, "rows long, content binary")


def write_sheet(df: DataFrame, path: str, name: str = "Sheet1") -> None:
    """One workbook file at a path of Spark's file systems, for tables that fit a sheet."""
    spark = df.sparkSession
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("too many rows for one sheet; use workbooks()")
    data = workbook_bytes({name: (df.columns, [tuple(r) for r in rows])})
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    stream.write(bytearray(data))
    stream.close()
