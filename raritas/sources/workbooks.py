"""XLSX workbooks as a Spark source: one task per file, rows streamed out of the sheet's XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raritas.functions.runtime import ship_package

# Fixed values of the Office Open XML format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_BATCH = 10_000


def read_workbooks(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """First sheet of every workbook under ``path``; the first row names the columns.

    Without a schema all rows of all workbooks are read once more for it: a column is a double if all its cells are
    numbers, a boolean if all are booleans, else a string.
    """
    return parse_workbooks(spark.read.format("binaryFile").load(path).select("path", "content"), schema)


def parse_workbooks(files: DataFrame, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of the workbooks held in the binary column ``content``."""
    if schema is None:
        schema = _infer(files)
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = schema.fieldNames()
    ship_package(files.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                cells = _sheet_rows(content)
                header = next(cells, [])
                where = [header.index(n) if n in header else None for n in names]
                buffer = []
                for row in cells:
                    buffer.append([_text(row[i]) if i is not None and i < len(row) else None for i in where])
                    if len(buffer) == _BATCH:
                        yield pd.DataFrame(buffer, columns=names, dtype=object)
                        buffer = []
                if buffer:
                    yield pd.DataFrame(buffer, columns=names, dtype=object)

    as_text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    parsed = files.select("content").mapInPandas(rows, as_text)
    return parsed.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def _infer(files: DataFrame) -> T.StructType:
    """Names in the order of their first places, and types by all cells; one row per file and column is gathered."""
    ship_package(files.sparkSession)

    def kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                cells = _sheet_rows(content)
                header = [str(name) for name in next(cells, [])]
                seen = [set() for _ in header]
                for row in cells:
                    for kind, value in zip(seen, row):
                        if value is not None:
                            kind.add("boolean" if isinstance(value, bool) else "double" if isinstance(value, float) else "string")
                lines = [(name, place, "string" if len(kind) > 1 else "".join(kind)) for place, (name, kind) in enumerate(zip(header, seen))]
                yield pd.DataFrame(lines, columns=["name", "place", "kind"])

    found = files.select("content").mapInPandas(kinds, "name string, place int, kind string")
    columns = found.groupBy("name").agg(F.min("place").alias("place"), F.collect_set(F.when(F.col("kind") != "", F.col("kind"))).alias("kinds"))
    rows = sorted(columns.collect(), key=lambda r: (r["place"], r["name"]))  # as many rows as columns
    names = {"double": T.DoubleType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(r["name"], names.get(r["kinds"][0], T.StringType()) if len(r["kinds"]) == 1 else T.StringType()) for r in rows])


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return str(value).lower()
    return repr(int(value)) if float(value).is_integer() else repr(value)


def _sheet_rows(content: bytes) -> Iterator[list]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(_MAIN + "t")))
        with book.open(_first_sheet(book)) as sheet:
            for _, element in ElementTree.iterparse(sheet):
                if element.tag == _MAIN + "row":
                    yield _row_values(element, shared)
                    element.clear()


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet")
    for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if link.get("Id") == sheet.get(_RELATION):
            target = link.get("Target")
            return target.lstrip("/") if target.startswith("/") else "xl/" + target
    raise ValueError("the workbook names no sheet")


def _row_values(row, shared: list[str]) -> list:
    values = []
    for cell in row.iter(_MAIN + "c"):
        place = cell.get("r")
        column = _column_number(place) if place else len(values)
        values.extend([None] * (column - len(values)))
        values.append(_cell_value(cell, shared))
    return values


def _column_number(place: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", place).group():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _cell_value(cell, shared: list[str]):
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(_MAIN + "t"))
    raw = cell.findtext(_MAIN + "v")
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return raw == "1"
    return float(raw) if kind == "n" else raw
