"""Export to Excel workbooks, and reading them back, as a data source.

``df.write.format("xlsx").save(path)`` writes a workbook a task; rows beyond what a sheet holds go on in the
next sheet. Rows are streamed into the file and out of it, so a task holds a few at a time. Files get their names when
the write is committed; what failed tasks leave has other names and is not read. Whole and real
numbers and truth values are cells of their kind, all else is text (times as ISO 8601); nulls are missing
cells, and an empty text is a cell. Characters that XML cannot hold are written as ``_xHHHH_``, as Excel does.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from typing import Any
from xml.parsers import expat
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Rows of a sheet, with its header.
SHEET_ROWS = 1_048_576
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
ROW, CELL, SHOWN = f"{MAIN} row", f"{MAIN} c", frozenset((f"{MAIN} v", f"{MAIN} t"))
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Not in XML 1.0, or taken for an escape.
ODD = re.compile("[\x00-\x08\x0b\x0c\r\x0e-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")
ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")
#: Rows that are written at once, and bytes that are read at once.
ROWS_AT_ONCE, READ_BYTES = 256, 1 << 16


def use(spark: SparkSession) -> None:
    spark.dataSource.register(Xlsx)


def column_name(i: int) -> str:
    """A, B, ..., Z, AA, ..."""
    name = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def column_number(cell: str) -> int:
    n = 0
    for c in cell:
        if not c.isalpha():
            break
        n = n * 26 + ord(c) - 64
    return n - 1


def cell(at: str, value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float | Decimal) and abs(value) < float("inf"):
        return f'<c r="{at}"><v>{value!r}</v></c>' if isinstance(value, float) else f'<c r="{at}"><v>{value}</v></c>'
    text = value.isoformat() if isinstance(value, date | datetime) else str(value)
    shown = escape(ODD.sub(lambda m: f"_x{ord(m[0]):04X}_", text) if ODD.search(text) else text)
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{shown}</t></is></c>'


def readers(schema: T.StructType) -> list[Callable[[str], Any]]:
    """From a cell's text to a value of each column."""
    kinds: dict[type, Callable[[str], Any]] = {
        **dict.fromkeys((T.ByteType, T.ShortType, T.IntegerType, T.LongType), int),
        **dict.fromkeys((T.FloatType, T.DoubleType), float),
        T.BooleanType: lambda x: x in ("1", "true", "True"),
        T.DecimalType: Decimal,
        T.DateType: date.fromisoformat,
        **dict.fromkeys((T.TimestampType, T.TimestampNTZType), datetime.fromisoformat),
    }
    return [kinds.get(type(f.dataType), str) for f in schema]


class Sheet:
    """The rows of a sheet but its header, parsed as its bytes come; no tree is kept."""

    def __init__(self, make: list[Callable[[str], Any]]):
        self.make, self.rows, self.head = make, [], True
        self.row: list[Any] = []
        self.at, self.kind, self.text, self.inside = "", None, [], 0
        self.columns: dict[str, int] = {}
        self.parser = expat.ParserCreate(namespace_separator=" ")
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.start, self.end, self.chars

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == CELL:
            self.at, self.kind, self.text = attrs["r"], attrs.get("t"), []
        elif tag in SHOWN:
            self.inside += 1
        elif tag == ROW:
            self.row = [None] * len(self.make)

    def chars(self, text: str) -> None:
        if self.inside:
            self.text.append(text)

    def end(self, tag: str) -> None:
        if tag in SHOWN:
            self.inside -= 1
        elif tag == CELL and not self.head:
            text = "".join(self.text)
            if self.kind == "inlineStr" and "_x" in text:
                text = ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)
            name = self.at.rstrip("0123456789")
            i = self.columns.get(name)
            if i is None:
                i = self.columns[name] = column_number(name)
            self.row[i] = self.make[i](text)
        elif tag == ROW:
            if not self.head:
                self.rows.append(tuple(self.row))
            self.head = False

    def read(self, raw: bytes, last: bool) -> list[tuple]:
        """The rows that end in these bytes."""
        self.parser.Parse(raw, last)
        done, self.rows = self.rows, []
        return done


class Xlsx(DataSource):
    """Options: ``path``, ``sheetRows``. Reading needs a schema."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def reader(self, schema: T.StructType) -> XlsxReader:
        return XlsxReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(self.options["path"], schema, overwrite, int(self.options.get("sheetRows", SHEET_ROWS)))


@dataclass
class Book(InputPartition):
    path: str


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[Book]:
        system, root = fs.FileSystem.from_uri(self.path)
        return [Book(x.path) for x in system.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("part-") and x.base_name.endswith(".xlsx")]

    def read(self, partition: Book) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.path)
        make = readers(self.schema)
        with system.open_input_file(partition.path) as raw, zipfile.ZipFile(raw) as book:
            for name in sorted((n for n in book.namelist() if n.startswith("xl/worksheets/")), key=lambda n: (len(n), n)):
                with book.open(name) as raw_sheet:
                    sheet = Sheet(make)
                    while some := raw_sheet.read(READ_BYTES):
                        yield from sheet.read(some, False)
                    yield from sheet.read(b"", True)


@dataclass
class Written(WriterCommitMessage):
    name: str


class XlsxWriter(DataSourceWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, sheet_rows: int):
        self.path, self.names, self.overwrite, self.sheet_rows = path, schema.fieldNames(), overwrite, sheet_rows
        self.letters = [column_name(i) for i in range(len(self.names))]

    def row(self, n: int, values: list) -> bytes:
        cells = "".join([cell(f"{c}{n}", v) for c, v in zip(self.letters, values, strict=True)])
        return f'<row r="{n}">{cells}</row>'.encode()

    def write(self, iterator: Iterator) -> Written:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        name, sheets, left = uuid.uuid4().hex, 0, next(iterator, None)
        with system.open_output_stream(f"{root}/_{name}.tmp") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
            while left is not None or not sheets:
                sheets += 1
                with book.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as sheet:
                    sheet.write(f'<worksheet xmlns="{MAIN}"><sheetData>'.encode() + self.row(1, self.names))
                    n, held = 1, []
                    while left is not None and n < self.sheet_rows:
                        n += 1
                        held.append(self.row(n, list(left)))
                        if len(held) == ROWS_AT_ONCE:
                            sheet.write(b"".join(held))
                            held = []
                        left = next(iterator, None)
                    sheet.write(b"".join(held) + b"</sheetData></worksheet>")
            self.frame(book, sheets)
        return Written(name)

    @staticmethod
    def frame(book: zipfile.ZipFile, sheets: int) -> None:
        """The parts of a workbook that name its sheets."""
        each = range(1, sheets + 1)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in each)
        book.writestr("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>{"".join(f"""<sheet name="Sheet{i}" sheetId="{i}" r:id="r{i}"/>""" for i in each)}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">{"".join(f"""<Relationship Id="r{i}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>""" for i in each)}</Relationships>')

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        old = [x.path for x in system.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("part-")] if self.overwrite else []
        for m in messages:
            if m is not None:
                system.move(f"{root}/_{m.name}.tmp", f"{root}/part-{m.name}.xlsx")
        for path in old:
            system.delete_file(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(f"{root}/_{m.name}.tmp")
