"""Sheets of many .xlsx workbooks, one task per workbook."""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
BATCH_ROWS = 10_000
# Number formats of the file format that show dates or times without naming a pattern.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
#: Texts that stand for an error in a cell, such as #DIV/0!, come with this mark in front.
ERROR = "\x00error:"


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _part(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _sheet_part(book: zipfile.ZipFile, sheet: str | int) -> tuple[str, bool]:
    """Part of a sheet by its name or place in the workbook, and whether days count from 1904."""
    root, rels = _part(book, "xl/workbook.xml"), _part(book, "xl/_rels/workbook.xml.rels")
    if root is None or rels is None:
        return "xl/worksheets/sheet1.xml", False
    targets = {r.get("Id"): r.get("Target") for r in rels}
    sheets = [(s.get("name"), targets[s.get(f"{_REL}id")]) for s in root.iter(f"{_NS}sheet")]
    chosen = sheets[sheet][1] if isinstance(sheet, int) else dict(sheets)[sheet]
    base = root.find(f"{_NS}workbookPr")
    return posixpath.normpath(posixpath.join("xl", chosen)).lstrip("/") if not chosen.startswith("/") else chosen[1:], base is not None and base.get("date1904") in ("1", "true")


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates or times."""
    root = _part(book, "xl/styles.xml")
    if root is None or root.find(f"{_NS}cellXfs") is None:
        return set()
    own = {int(f.get("numFmtId")): f.get("formatCode") for f in root.iter(f"{_NS}numFmt")}

    def shows_dates(number: int) -> bool:
        bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", own.get(number, "")).lower()  # literals and colours say nothing
        return number in DATE_FORMATS or bool(re.search("[ymdhs]", bare))

    return {i for i, xf in enumerate(root.find(f"{_NS}cellXfs")) if shows_dates(int(xf.get("numFmtId", 0)))}


def _moment(serial: str, from_1904: bool) -> str:
    """ISO text of a day number; day 60 of the older count, a 29 February that never was, is left as it is."""
    days = float(serial)
    start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 31) if days < 60 else dt.datetime(1899, 12, 30)
    at = start + dt.timedelta(milliseconds=round(days * 86_400_000))
    return at.isoformat(sep=" ") if at.time() != dt.time() else at.date().isoformat()


def sheet_rows(content: bytes, sheet: str | int = 0) -> Iterator[list]:
    """Cell texts of one sheet, row by row, parsed as a stream: dates as ISO texts, booleans as true and false, errors marked with ``ERROR``."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        root = _part(book, "xl/sharedStrings.xml")
        shared = [] if root is None else ["".join(t.text or "" for t in item.iter(f"{_NS}t")) for item in root.iter(f"{_NS}si")]
        part, from_1904 = _sheet_part(book, sheet)
        dates = _date_styles(book)

        def text_of(cell) -> str | None:
            kind, value = cell.get("t", "n"), cell.find(f"{_NS}v")
            if kind == "inlineStr":
                return "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
            if value is None or value.text is None:
                return None
            if kind == "s":
                return shared[int(value.text)]
            if kind == "b":
                return "true" if value.text == "1" else "false"
            if kind == "e":
                return ERROR + value.text
            if kind == "n" and int(cell.get("s", 0)) in dates:
                return _moment(value.text, from_1904)
            return value.text

        with book.open(part) as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != f"{_NS}row":
                    continue
                cells: list = []
                for cell in row.iter(f"{_NS}c"):
                    at = _column_index(cell.get("r")) if cell.get("r") else len(cells)
                    cells.extend([None] * (at - len(cells)))
                    cells.append(text_of(cell))
                row.clear()
                yield cells


def read_excel(spark: SparkSession, path: str, schema: str | T.StructType, view: str | None = None, sheet: str | int = 0, on_fault: str = "raise") -> DataFrame:
    """Rows of one sheet (by place or name, the first by default) of every workbook below ``path`` under a declared schema, matched by header names.

    A sheet holds at most about a million rows, so a workbook fits a task; rows leave in batches. Error cells are NULL. A cell that its
    column's type can't hold ends the job, or is NULL with ``on_fault="null"``; ``on_fault="list"`` adds ``faults``, the names of such columns.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path)
    df = parse_workbooks(files.select("content"), schema, sheet, on_fault)
    if view:
        df.createOrReplaceTempView(view)
    return df


def parse_workbooks(books: DataFrame, schema: str | T.StructType, sheet: str | int = 0, on_fault: str = "raise") -> DataFrame:
    """Rows of workbooks given as a ``content`` column; see :func:`read_excel`."""
    if on_fault not in ("raise", "null", "list"):
        raise ValueError("on_fault is raise, null or list")
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = [f.name for f in wanted.fields]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = sheet_rows(content, sheet)
                header = {h: i for i, h in enumerate(next(rows, []))}
                at = [header.get(n) for n in names]
                batch = []
                for cells in rows:
                    batch.append([cells[i] if i is not None and i < len(cells) else None for i in at])
                    if len(batch) == BATCH_ROWS:
                        yield pd.DataFrame(batch, columns=names, dtype=object)
                        batch = []
                if batch:
                    yield pd.DataFrame(batch, columns=names, dtype=object)

    texts = books.mapInPandas(parse, ", ".join(f"`{n}` string" for n in names))
    clean = texts.select(*[F.when(~F.startswith(F.col(f"`{n}`"), F.lit(ERROR)), F.col(f"`{n}`")).alias(n) for n in names])
    if on_fault == "raise":
        return clean.select(*[F.when(_fits(f), _typed(f)).otherwise(F.raise_error(F.concat(F.lit(f"column {f.name} can't hold "), F.col(f"`{f.name}`")))).alias(f.name)
                              if not isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in wanted.fields])
    typed = [_typed(f).alias(f.name) for f in wanted.fields]
    if on_fault == "list":
        typed.append(F.array_compact(F.array(*[F.when(~_fits(f), F.lit(f.name)) for f in wanted.fields])).alias("faults"))
    return clean.select(*typed)


def _typed(field: T.StructField) -> Column:
    """Whole numbers exactly as they are written; those in floating notation through a double, if they are whole."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return col
    if isinstance(field.dataType, T.IntegralType):
        real = col.try_cast("double")
        return F.coalesce(F.when(F.rlike(col, F.lit(r"^[+-]?[0-9]+$")), col.try_cast(field.dataType)), F.when(real == F.floor(real), real.try_cast(field.dataType)))
    if isinstance(field.dataType, T.BooleanType):
        return F.when(F.lower(col).isin("true", "1"), True).when(F.lower(col).isin("false", "0"), False)
    return col.try_cast(field.dataType)


def _fits(field: T.StructField) -> Column:
    return F.col(f"`{field.name}`").isNull() | _typed(field).isNotNull()
