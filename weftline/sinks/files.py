"""File sinks. Rows are made into text on executors; the one file that a format asks for is written from an iterator.

``distributed`` on the CSV and JSON sinks lets the tasks write a folder of part files instead.
"""

from __future__ import annotations

import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.values import ORD, c, geometry_field, invariant_text, is_blank, is_geometry, is_number
from weftline.geo import functions as g
from weftline.plans.registry import BlockContext, Char, block
from weftline.sinks.modes import Writer, opened, ordered, rows_of, write_mode


def shown(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name != ORD]


def text_cells(df: DataFrame) -> list[Column]:
    return [invariant_text(c(f.name), f) for f in shown(df)]


@block("SinkCsv", "sink")
def csv(ctx: BlockContext, path: str, includeHeader: bool = True, delimiter: Char = Char(","), writeMode: str | None = None, distributed: bool = False) -> Writer:
    """Invariant texts without quotes; no header, and so an empty file, for an empty input."""
    df, mode = ctx.input, write_mode(writeMode)
    names = [f.name for f in shown(df)]
    order = [c(ORD)] if ORD in df.columns else []
    lines = df.select(F.concat_ws(str(delimiter), *text_cells(df)).alias("line"), *order)

    def write() -> int:
        if distributed:
            lines.select("line").write.mode("overwrite").text(path)
            return ctx.spark.read.text(path).count()
        n = 0
        with opened(path, mode) as f:
            for n, row in enumerate(rows_of(ordered(lines)), 1):
                if n == 1 and includeHeader:
                    f.write(delimiter.join(names) + "\n")
                f.write(row[0] + "\n")
        return n

    return write


def _value(f: T.StructField, keep_blank: bool) -> Column:
    """A field of a JSON object: numbers and booleans typed, blank texts null."""
    x = c(f.name)
    if isinstance(f.dataType, T.BooleanType) or is_number(f.dataType):
        return x
    text = invariant_text(x, f)
    return F.when(~is_blank(text), text)


def objects(df: DataFrame, fields: list[T.StructField], keep_blank: bool) -> Column:
    """A JSON object of the fields; blank values are left out, or null."""
    if not fields:
        return F.lit("{}")
    made = F.to_json(F.struct(*[_value(f, keep_blank).alias(f.name) for f in fields]), {"ignoreNullFields": str(not keep_blank).lower()})
    return made


@block("SinkJson", "sink")
def json_sink(ctx: BlockContext, path: str, includeNullAndEmpty: bool = False, writeMode: str | None = None, distributed: bool = False) -> Writer:
    """An indented array of objects; geometries have no text and count as blank."""
    df, mode = ctx.input, write_mode(writeMode)
    order = [c(ORD)] if ORD in df.columns else []
    lines = df.select(objects(df, shown(df), includeNullAndEmpty).alias("line"), *order)

    def write() -> int:
        if distributed:
            lines.select("line").write.mode("overwrite").text(path)
            return ctx.spark.read.text(path).count()
        n = 0
        with opened(path, mode) as f:
            f.write("[")
            for n, row in enumerate(rows_of(ordered(lines)), 1):
                body = json.dumps(json.loads(row[0]), ensure_ascii=False, indent=2).replace("\n", "\n  ")
                f.write((",\n  " if n > 1 else "\n  ") + body)
            f.write("\n]\n" if n else "]\n")
        return n

    return write


@block("SinkGeoJson", "sink")
def geojson(ctx: BlockContext, path: str, includeProperties: bool = True, includeNullAndEmptyProperties: bool = False, writeMode: str | None = None) -> Writer:
    """A FeatureCollection; a null geometry is null, blank properties are left out or null."""
    df, mode, field = ctx.input, write_mode(writeMode), geometry_field(ctx.input.schema)
    if field is None:
        raise ValueError("SinkGeoJson needs a geometry field")
    plain = [f for f in shown(df) if not is_geometry(f)]
    properties = objects(df, plain, includeNullAndEmptyProperties) if includeProperties else F.lit("{}")
    order = [c(ORD)] if ORD in df.columns else []
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(g.words(c(field.name), "json"), F.lit("null")), F.lit(',"properties":'), properties, F.lit("}"))
    lines = df.select(feature.alias("line"), *order)

    def write() -> int:
        n = 0
        with opened(path, mode) as f:
            f.write('{"type":"FeatureCollection","features":[')
            for n, row in enumerate(rows_of(ordered(lines)), 1):
                f.write((",\n" if n > 1 else "\n") + row[0])
            f.write("\n]}\n")
        return n

    return write


def column_letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


#: The smallest parts of a workbook.
_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def sheet_row(n: int, cells: list[str]) -> str:
    return f'<row r="{n}">' + "".join(f'<c r="{column_letters(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>' for i, x in enumerate(cells)) + "</row>"


@block("SinkExcel", "sink")
def excel(ctx: BlockContext, path: str, writeMode: str | None = None) -> Writer:
    """One sheet with a header row and every cell as an inline text."""
    df, mode = ctx.input, write_mode(writeMode)
    names = [f.name for f in shown(df)]
    order = [c(ORD)] if ORD in df.columns else []
    cells = df.select(F.array(*text_cells(df)).alias("cells"), *order)

    def write() -> int:
        n = 0
        with opened(path, mode, binary=True) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as book:
            for name, text in _PARTS.items():
                book.writestr(name, text)
            with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                sheet.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                sheet.write(sheet_row(1, names).encode())
                for n, row in enumerate(rows_of(ordered(cells)), 1):
                    sheet.write(sheet_row(n + 1, list(row[0])).encode())
                sheet.write(b"</sheetData></worksheet>")
        return n

    return write
