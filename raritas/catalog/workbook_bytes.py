"""Minimal XLSX workbooks made from rows, as input for the workbook query."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

from raritas.functions.runtime import ship_package

# Fixed values of the Office Open XML format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def workbook_bytes(rows: pd.DataFrame) -> bytes:
    """One workbook whose only sheet holds a header and the rows."""

    def line(values) -> str:
        cells = []
        for v in values:
            if isinstance(v, str):
                cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')
            elif v is None or v != v:
                cells.append("<c/>")
            else:
                cells.append(f"<c><v>{v!r}</v></c>")
        return "<row>" + "".join(cells) + "</row>"

    body = "".join(line(v) for v in [list(rows.columns), *rows.astype(object).itertuples(index=False)])
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>')
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOCUMENT}"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        )
    return buffer.getvalue()


def as_workbooks(df: DataFrame) -> DataFrame:
    """One workbook per Arrow batch of ``df``, in a binary column ``content``."""
    ship_package(df.sparkSession)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"content": [workbook_bytes(batch)]})

    return df.mapInPandas(pack, "content binary")
