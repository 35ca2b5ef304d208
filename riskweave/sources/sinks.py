"""Exports: CSV with a header, and a minimal spreadsheet file."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

from riskweave.session import work_folder

#: Rows of one workbook.
SHEET_ROWS = 100_000
#: Rows that are Python objects at a time.
SLICE = 1_000


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').option("emptyValue", '""').mode("overwrite").csv(path)


def export_csv(spark: SparkSession, df: DataFrame, path: str | None = None) -> str | None:
    """The folder of ``df`` as CSV with a header; None, and nothing written, where there is no row."""
    if df.limit(1).count() == 0:
        return None
    path = path or work_folder(spark, "csv")
    write_csv(df, path)
    return path


def read_csv(spark: SparkSession, path: str | None, columns: list[str]) -> DataFrame:
    """Exported rows as strings; empty strings stay empty."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("emptyValue", "").option("nullValue", "\0").csv(path)


class Book:
    """A spreadsheet of one sheet, cells as inline strings; rows are packed as they come, so only the packed ones are held."""

    def __init__(self, columns: list[str]) -> None:
        self.rows = 0
        self._out = io.BytesIO()
        self._zip = zipfile.ZipFile(self._out, "w", zipfile.ZIP_DEFLATED)
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        self._zip.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/book.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/sheet.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        self._zip.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="book.xml"/></Relationships>')
        self._zip.writestr("book.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Filings" sheetId="1" r:id="r1"/></sheets></workbook>')
        self._zip.writestr("_rels/book.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="sheet.xml"/></Relationships>')
        self._sheet = self._zip.open("sheet.xml", "w", force_zip64=True)  # its size isn't known yet
        self._sheet.write(f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetData>'.encode())
        self._write(columns)

    def _write(self, row: Iterable) -> None:
        cells = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for v in row)
        self._sheet.write(f"<row>{cells}</row>".encode())

    def add(self, rows: Iterable[tuple]) -> None:
        for row in rows:
            self._write(row)
            self.rows += 1

    def done(self) -> bytes:
        self._sheet.write(b"</sheetData></worksheet>")
        self._sheet.close()
        self._zip.close()
        return self._out.getvalue()


def workbook(rows: Iterable[tuple], columns: list[str]) -> bytes:
    """The workbook of ``rows``."""
    book = Book(columns)
    book.add(rows)
    return book.done()


def sheet_rows(data: bytes) -> Iterator[list[str]]:
    """The cells of a workbook's sheet, header first; a row's elements go before the next one is read."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z, z.open("sheet.xml") as sheet:
        for event, at in ElementTree.iterparse(sheet, ("start", "end")):
            if event == "start" and at.tag == f"{space}sheetData":
                held = at
            elif event == "end" and at.tag == f"{space}row":
                yield ["".join(t.text or "" for t in cell.iter(f"{space}t")) for cell in at.iter(f"{space}c")]
                held.clear()


def workbook_rows(data: bytes) -> list[list[str]]:
    """All rows of ``sheet_rows``."""
    return list(sheet_rows(data))


def export_workbooks(spark: SparkSession, df: DataFrame, path: str | None = None, rows: int = SHEET_ROWS) -> str | None:
    """The folder of ``df`` as workbooks of ``rows`` rows at most, made by the tasks; None where there is no row.

    A sheet holds 1,048,576 rows, so a long listing is several files, one row of a
    Parquet table (file, book) each.
    """
    if df.limit(1).count() == 0:
        return None
    path = path or work_folder(spark, "workbooks")
    columns = df.columns

    def books(batches):
        book = None
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                book = book or Book(columns)
                part = batch.slice(at, min(SLICE, rows - book.rows))
                book.add(zip(*(part.column(c).to_pylist() for c in columns), strict=True))
                at += part.num_rows
                if book.rows == rows:
                    yield pa.RecordBatch.from_pydict({"book": [book.done()]})
                    book = None
        if book:
            yield pa.RecordBatch.from_pydict({"book": [book.done()]})

    df.mapInArrow(books, "book binary").write.parquet(path)
    return path


def read_workbooks(spark: SparkSession, path: str | None, columns: list[str]) -> DataFrame:
    """The rows of exported workbooks as strings."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    if path is None:
        return spark.createDataFrame([], schema)

    def cells(batches):
        for batch in batches:
            for raw in batch.column("book"):
                lines = sheet_rows(raw.as_py())
                head = next(lines)
                while part := list(itertools.islice(lines, SLICE)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.string()) for i in range(len(head))], head)

    return spark.read.schema("book binary").parquet(path).mapInArrow(cells, schema)
