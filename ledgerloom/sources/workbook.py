"""Spreadsheets as a source and sink, from the standard library alone.

Workbooks are read as binary files, one workbook a row, so that thousands of them are read in parallel; a sheet holds at most
1,048,576 rows by the format.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from xml.etree import ElementTree
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_REF = re.compile(r"([A-Z]+)(\d+)")


def is_workbook(name: Column) -> Column:
    """Names that may be uploaded."""
    return F.lower(name).rlike(r"\.(xlsx|xlsm|xls)$")


def is_readable(name: Column) -> Column:
    """Names of the zipped formats; the binary one of old has to be saved anew before it is read."""
    return F.lower(name).rlike(r"\.(xlsx|xlsm)$")


def dated_name(name: Column, day: Column) -> Column:
    """``name-YYYY-MM-DD.ext`` without folders."""
    pattern = r"([^/]*?)(\.[^./]*)?$"
    return F.concat(F.regexp_extract(name, pattern, 1), F.lit("-"), F.date_format(day, "yyyy-MM-dd"), F.regexp_extract(name, pattern, 2))


def filtered_name(name: str) -> str:
    return name.replace(".xlsx", "_filtered_private.xlsx")


def _place(ref: str) -> tuple[int, int]:
    letters, number = _REF.match(ref).groups()
    column = 0
    for ch in letters:
        column = column * 26 + ord(ch) - 64
    return int(number) - 1, column - 1


def _letters(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def read_workbook(content: bytes, sheet: int = 0, fill_merged: bool = True) -> list[list[str | None]]:
    """Cells of one sheet as text; cells of a merged range all take its top-left value. Empty cells are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")))
        listed = ElementTree.fromstring(book.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = targets[listed[sheet].get(f"{{{_NS['r']}}}id")].lstrip("/")
        root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
    cells: dict[tuple[int, int], str | None] = {}
    width = height = 0
    for c in root.iter(f"{{{_NS['m']}}}c"):
        at = _place(c.get("r"))
        kind, value = c.get("t"), c.find("m:v", _NS)
        if kind == "inlineStr":
            text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
        elif value is None:
            text = None
        elif kind == "s":
            text = shared[int(value.text)]
        elif kind == "b":
            text = "TRUE" if value.text == "1" else "FALSE"
        else:
            text = value.text
        cells[at] = text
        height, width = max(height, at[0] + 1), max(width, at[1] + 1)
    if fill_merged:
        for merged in root.iter(f"{{{_NS['m']}}}mergeCell"):
            first, _, last = merged.get("ref").partition(":")
            (top, left), (bottom, right) = _place(first), _place(last or first)
            for i in range(top, bottom + 1):
                for j in range(left, right + 1):
                    cells[i, j] = cells.get((top, left))
            height, width = max(height, bottom + 1), max(width, right + 1)
    return [[cells.get((i, j)) for j in range(width)] for i in range(height)]


def write_workbook(sheets: Sequence[tuple[str, Sequence[Sequence[object]], Sequence[str]]]) -> bytes:
    """A workbook of (name, rows, merged ranges); numbers stay numbers, nulls stay empty."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(sheets)))
        book.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        book.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        links = "".join(f'<Relationship Id="r{i + 1}" Type="{office}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, (n, _, _) in enumerate(sheets))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}"><sheets>{listed}</sheets></workbook>')
        for k, (_, rows, merges) in enumerate(sheets):
            body = []
            for i, row in enumerate(rows):
                cells = []
                for j, value in enumerate(row):
                    ref = f"{_letters(j)}{i + 1}"
                    if value is None:
                        continue
                    if isinstance(value, (int, float)) and not isinstance(value, bool):
                        cells.append(f'<c r="{ref}"><v>{value}</v></c>')
                    else:
                        cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>')
                body.append(f'<row r="{i + 1}">{"".join(cells)}</row>')
            merged = f'<mergeCells>{"".join(f"""<mergeCell ref="{m}"/>""" for m in merges)}</mergeCells>' if merges else ""
            book.writestr(f"xl/worksheets/sheet{k + 1}.xml", f'<?xml version="1.0"?><worksheet xmlns="{_NS["m"]}"><sheetData>{"".join(body)}</sheetData>{merged}</worksheet>')
    return out.getvalue()


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of the workbooks under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(is_readable(F.col("path"))).select("path", "content")


def scan(files: DataFrame, columns: Sequence[str], skip_rows: int = 0, sheet: int = 0) -> DataFrame:
    """Rows of workbooks ``files(path, content)`` below the header row, which comes after ``skip_rows`` rows.

    Columns are taken by header name, all as text, with ``path`` and the sheet's ``row_no``; absent ones are
    null, and of repeated headers the first counts. Unreadable workbooks raise.
    """
    wanted = list(columns)

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                cells = read_workbook(bytes(content), sheet)
                header = cells[skip_rows] if len(cells) > skip_rows else []
                at = {name: header.index(name) for name in wanted if name in header}
                rows = cells[skip_rows + 1 :]
                out = {name: [r[at[name]] if name in at else None for r in rows] for name in wanted}
                yield pd.DataFrame({"path": [path] * len(rows), "row_no": range(skip_rows + 2, skip_rows + 2 + len(rows)), **out})

    schema = "path string, row_no int, " + ", ".join(f"`{c}` string" for c in wanted)
    return files.mapInPandas(read, schema)


ROWS_PER_BOOK = 100_000


@dataclass
class _Books(WriterCommitMessage):
    names: list[str]


class _BookWriter(DataSourceWriter):
    """Each task writes its rows as books of a bounded size under names of its own; they get their final names when all tasks are done."""

    def __init__(self, folder: str, columns: list[str], rows: int, overwrite: bool):
        self.folder, self.columns, self.rows, self.overwrite = folder, columns, rows, overwrite

    def write(self, iterator: Iterator) -> _Books:
        task = TaskContext.get()
        names: list[str] = []
        rows: list[list[object]] = []

        def close() -> None:
            name = f"part-{task.partitionId():05d}-{len(names):04d}-{task.taskAttemptId()}.xlsx"
            with open(os.path.join(self.folder, f".{name}"), "wb") as out:
                out.write(write_workbook([("Sheet1", [self.columns, *rows], [])]))
            names.append(name)
            rows.clear()

        os.makedirs(self.folder, exist_ok=True)
        for row in iterator:
            rows.append([None if v is None else v if isinstance(v, (int, float)) else str(v) for v in (None if isinstance(v, float) and v != v else v for v in row)])
            if len(rows) == self.rows:
                close()
        if rows:
            close()
        return _Books(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        written = {n for m in messages if m is not None for n in m.names}
        os.makedirs(self.folder, exist_ok=True)
        if self.overwrite:
            for old in os.listdir(self.folder):
                if old.endswith(".xlsx") and not old.startswith("."):
                    os.remove(os.path.join(self.folder, old))
        for name in written:
            os.replace(os.path.join(self.folder, f".{name}"), os.path.join(self.folder, name))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            for name in m.names if m is not None else ():
                if os.path.exists(os.path.join(self.folder, f".{name}")):
                    os.remove(os.path.join(self.folder, f".{name}"))


class WorkbookSink(DataSource):
    """``df.write.format("workbooks").save(folder)``: books of at most ``rowsPerBook`` rows below a header row, in a folder all workers see."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _BookWriter(self.options["path"].removeprefix("file://"), schema.names, int(self.options.get("rowsPerBook", ROWS_PER_BOOK)), overwrite)


def write_books(df: DataFrame, folder: str, rows_per_book: int = ROWS_PER_BOOK, mode: str = "overwrite") -> None:
    """Writes a table as workbooks; numbers stay numbers, nulls and NaN stay empty, other values are text."""
    if not 0 < rows_per_book < 1_048_576:
        raise ValueError("a sheet holds up to 1,048,576 rows with its header")
    df.sparkSession.dataSource.register(WorkbookSink)
    df.write.format("workbooks").option("rowsPerBook", rows_per_book).mode(mode).save(folder)
