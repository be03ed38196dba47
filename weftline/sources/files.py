"""File sources. Line files are scanned by Spark; document and container formats are read by record range on executors."""

from __future__ import annotations

import io
import json
import re
import sqlite3
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.values import ORD, c, is_blank, lenient
from weftline.functions.values import parse as parse_text
from weftline.geo import functions as g
from weftline.geo import wkb
from weftline.plans.registry import BlockContext, Char, block
from weftline.sources.checkpoints import read_token, write_token
from weftline.sources.inference import CATALOG, PLAIN, infer

GEOM = {"geometry": True, "srid": 4326}


# --- CSV -------------------------------------------------------------------------------------------------------------


@block("SourceCsv", "source")
def csv(ctx: BlockContext, path: str, columns: str | None = None, hasHeader: bool = True, delimiter: Char = Char(","), inferTypes: bool = True, inferenceSampleRows: int = 256, batchSize: int = 1000, checkpointPath: str | None = None, checkpointEvery: int = 100_000) -> DataFrame:
    """Lines cut at the delimiter, without quotes. Short rows are padded and long ones cut; a blank line is a row.

    With a checkpoint the lines counted by its token are left out; the token is written after the sinks have committed.
    """
    lines = ctx.spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.monotonically_increasing_id().alias(ORD))
    head = [r[0] for r in lines.limit(inferenceSampleRows + 1).collect()]
    named = [x.strip() for x in columns.split(",")] if columns else None
    if not head:
        names = named or ["value"]
        return ctx.spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(ORD, T.LongType())]))
    first = head[0].lstrip("﻿").split(delimiter)
    names = named or ([x.strip() for x in first] if hasHeader else [f"col{i + 1}" for i in range(len(first))])
    sample = [x.split(delimiter) for x in head[1 if hasHeader else 0 :]][:inferenceSampleRows]
    types = [infer((r[i] if i < len(r) else "" for r in sample), PLAIN) if inferTypes else T.StringType() for i in range(len(names))]
    rows = lines.where(c(ORD) != 0) if hasHeader else lines  # the header is the first line of the first split
    skip = int(read_token(checkpointPath) or 0)
    if skip:
        rows = _after(rows, skip)
    if checkpointPath:
        ctx.after_commit.append(lambda: write_token(checkpointPath, lines.count() - int(hasHeader)))
    cut = rows.select(F.split("value", re.escape(delimiter), -1).alias("p"), c(ORD))
    text = lambda i: F.coalesce(F.get("p", F.lit(i)), F.lit(""))
    return cut.select(*[(lenient(text(i), t) if not isinstance(t, T.StringType) else text(i)).alias(n) for i, (n, t) in enumerate(zip(names, types, strict=True))], c(ORD))


def _after(rows: DataFrame, skip: int) -> DataFrame:
    """Rows but the first so many: whole partitions are counted, and only the one that the limit falls into is ranked."""
    part = F.shiftright(c(ORD), 33)
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a split
    least, left = 0, skip
    for p, n in counts:
        if left < n:
            base = rows.where(part == p).agg(F.min(c(ORD))).first()[0]
            least = base + left
            break
        left -= n
        least = (p + 1) << 33
    return rows.where(c(ORD) >= least)


# --- documents -------------------------------------------------------------------------------------------------------


def whole_text(spark: SparkSession, path: str) -> bytes:
    """A document's bytes, by any path that Spark reads."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def json_text(x) -> str | None:
    """A JSON value as field text: raw numbers, true/false, nested values as JSON."""
    if x is None:
        return None
    if isinstance(x, bool):
        return "true" if x else "false"
    return _compact(x) if isinstance(x, (dict, list)) else str(x)


class _Raw(str):
    """A number's own text."""


def _compact(x) -> str:
    if isinstance(x, _Raw):
        return str(x)
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_compact(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_compact, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


def parse_json(text: str):
    """JSON whose numbers keep their text."""
    return json.loads(text, parse_int=_Raw, parse_float=_Raw, parse_constant=_Raw)


def _keys(rows: Iterable[dict]) -> list[str]:
    return list(dict.fromkeys(k for r in rows for k in r))


def text_frame(spark: SparkSession, names: list[str], rows: list[dict], ladder=PLAIN, sample: int | None = None, geometry: str | None = None) -> DataFrame:
    """Rows of texts as typed columns, each with its place; the geometry field, if any, is last."""
    types = {n: infer((r.get(n) for r in rows[:sample]), ladder) for n in names}
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + ([T.StructField(geometry, T.BinaryType())] if geometry else []) + [T.StructField(ORD, T.LongType())])
    data = [(*[None if r.get(n) is None else str(r[n]) for n in names], *([r.get("\0geometry")] if geometry else []), i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, schema)
    fields = [lenient(c(n), types[n]).alias(n) if not isinstance(types[n], T.StringType) else F.coalesce(c(n), F.lit("")).alias(n) for n in names]
    return df.select(*fields, *([c(geometry).alias(geometry, metadata=GEOM)] if geometry else []), c(ORD))


def catalog_frame(spark: SparkSession, names: list[str], rows: list[dict], geometry: str, sample: int | None) -> DataFrame:
    """Alphabetical fields by the catalog ladder, the geometry last."""
    ordered = sorted((n for n in names if n.lower() != geometry.lower()), key=str.lower)
    clean = [{k: (v.strip() if isinstance(v, str) else v) for k, v in r.items()} for r in rows]
    return text_frame(spark, ordered, clean, CATALOG, sample, geometry)


def parsed_frame(ctx: BlockContext, path: str, parse: Callable[[bytes], Iterable[dict]], ladder=PLAIN, sample: int | None = None, geometry: str | None = None, alphabetical: bool = False) -> DataFrame:
    """Documents of a path, folder or pattern, each parsed by a task of its own into rows of texts; then typed columns.

    Fields come in the order in which they are first seen, or by name. Their types fit all values, or those of the first
    ``sample`` rows of each document. What reaches the driver is one row a field.
    """

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                held = []
                for i, row in enumerate(parse(bytes(content))):
                    shape = row.pop("\0geometry", None)
                    held.append((name, i, list(row), list(row.values()), shape))
                    if len(held) >= 5000:
                        yield pd.DataFrame(held, columns=["path", "i", "keys", "vals", "shape"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["path", "i", "keys", "vals", "shape"])

    documents = ctx.spark.read.format("binaryFile").load(path).select("path", "content")
    rows = documents.mapInPandas(read, "path string, i long, keys array<string>, vals array<string>, shape binary")
    cells = (rows if sample is None else rows.where(F.col("i") < sample)).select("path", "i", F.posexplode(F.arrays_zip("keys", "vals")).alias("at", "cell")).select("path", "i", "at", "cell.keys", "cell.vals")
    filled = ~is_blank(c("vals"))
    fits = {kind: F.bool_and(F.when(filled, parse_text(c("vals"), kind).isNotNull())) for kind, _ in CATALOG}
    known = cells.groupBy("keys").agg(F.min(F.struct("path", "i", "at")).alias("first"), F.count(F.when(filled, 1)).alias("n"), *[F.coalesce(x, F.lit(False)).alias(k.simpleString()) for k, x in fits.items()]).collect()
    known.sort(key=(lambda r: r["keys"].lower()) if alphabetical else (lambda r: r["first"]))
    types = {r["keys"]: next((t for t, _ in ladder if r["n"] and r[t.simpleString()]), T.StringType()) for r in known if not geometry or r["keys"].lower() != geometry.lower()}
    numbered_rows = rows.select(F.map_from_arrays("keys", "vals").alias("m"), "shape", F.monotonically_increasing_id().alias(ORD))
    text = lambda n: F.try_element_at("m", F.lit(n))
    fields = [(lenient(text(n), t) if not isinstance(t, T.StringType) else F.coalesce(text(n), F.lit(""))).alias(n) for n, t in types.items()]
    return numbered_rows.select(*fields, *([c("shape").alias(geometry, metadata=GEOM)] if geometry else []), c(ORD))


def json_rows(data: bytes) -> Iterator[dict]:
    found = parse_json(data.decode("utf-8-sig"))
    if not isinstance(found, list):
        raise ValueError("the JSON document must be an array")
    return ({k: json_text(v) for k, v in x.items()} for x in found if isinstance(x, dict))


@block("SourceJson", "source")
def json_source(ctx: BlockContext, path: str, batchSize: int = 1000) -> DataFrame:
    """A top-level array; elements that are no objects are skipped."""
    return parsed_frame(ctx, path, json_rows)


def geojson_rows(text: str) -> tuple[list[str], list[dict]]:
    found = parse_json(text)
    if not isinstance(found, dict) or found.get("type") != "FeatureCollection" or not isinstance(found.get("features"), list):
        raise ValueError("the document must be a FeatureCollection")
    rows = []
    for feature in found["features"]:
        row = {k: json_text(v) for k, v in (feature.get("properties") or {}).items()}
        shape = feature.get("geometry")
        row["\0geometry"] = wkb.from_geojson(shape) if isinstance(shape, dict) else None
        rows.append(row)
    return [k for k in _keys(rows) if k != "\0geometry"], rows


@block("SourceGeoJson", "source")
def geojson(ctx: BlockContext, path: str, geometryColumn: str = "geom", batchSize: int = 1000) -> DataFrame:
    """A FeatureCollection of any of the six simple types; a geometry that is no object is null."""
    return parsed_frame(ctx, path, lambda data: geojson_rows(data.decode("utf-8-sig"))[1], geometry=geometryColumn)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def gml_rows(data: bytes, more: tuple[str, ...] = ()) -> tuple[list[str], list[dict]]:
    """Features under featureMember (its first child) or featureMembers (all children)."""
    rows = []
    for _, element in ET.iterparse(io.BytesIO(data)):
        name = _local(element.tag)
        if name == "featureMember" or name in more:
            features = list(element)[:1]
        elif name == "featureMembers":
            features = list(element)
        else:
            continue
        for feature in features:
            row: dict = {"\0geometry": None}
            for child in feature:
                shape = next((x for x in child.iter() if _local(x.tag) in wkb.GML_TYPES), None)
                if shape is None:
                    if not len(child):
                        row[_local(child.tag)] = (child.text or "").strip()
                elif row["\0geometry"] is None:
                    row["\0geometry"] = wkb.from_gml(shape)
            rows.append(row)
        element.clear()
    return [k for k in _keys(rows) if k != "\0geometry"], rows


@block("SourceGml", "source")
def gml(ctx: BlockContext, path: str, geometryColumn: str = "geom", batchSize: int = 1000, schemaSampleRows: int = 256) -> DataFrame:
    return parsed_frame(ctx, path, lambda data: gml_rows(data)[1], CATALOG, schemaSampleRows, geometryColumn, alphabetical=True)


# --- shapefiles ------------------------------------------------------------------------------------------------------


def dbf_fields(data: bytes) -> tuple[list[tuple[str, str, int, int]], int, int, int]:
    """(name, type, length, decimals) of fields; record count, header and record size."""
    count, header, size = struct.unpack("<IHH", data[4:12])
    out, at = [], 32
    while data[at] != 0x0D:
        raw = data[at : at + 32]
        out.append((raw[:11].split(b"\0")[0].decode("cp1252").strip(), chr(raw[11]), raw[16], raw[17]))
        at += 32
    return out, count, header, size


def _dbf_type(kind: str, decimals: int) -> T.DataType:
    if kind == "L":
        return T.BooleanType()
    if kind in "NFBI":
        return T.LongType() if decimals == 0 else T.DoubleType()
    return T.StringType()


def _dbf_value(raw: bytes, t: T.DataType):
    text = raw.decode("cp1252", "replace").strip("\0 ").strip()
    if isinstance(t, T.BooleanType):
        return text.upper() in ("T", "Y")
    try:
        if isinstance(t, T.LongType):
            return int(float(text)) if text else 0
        if isinstance(t, T.DoubleType):
            return float(text) if text else 0.0
    except ValueError:
        return 0 if isinstance(t, T.LongType) else 0.0
    return text


@block("SourceShapefile", "source")
def shapefile(ctx: BlockContext, path: str, srid: int = 4326, geometryColumn: str = "geom", batchSize: int = 1000) -> DataFrame:
    """.shp, .shx and .dbf side by side; shapes and attributes are matched by record number, and deleted records go with their shapes."""
    stem = re.sub(r"\.shp$", "", path, flags=re.IGNORECASE)
    shp, shx, dbf = (whole_text(ctx.spark, f"{stem}.{x}") for x in ("shp", "shx", "dbf"))
    fields, count, header, size = dbf_fields(dbf)
    types = [_dbf_type(k, d) for _, k, _, d in fields]
    rows = []
    for i in range(min(count, (len(shx) - 100) // 8)):
        record = dbf[header + i * size : header + (i + 1) * size]
        if record[:1] == b"*":
            continue
        offset, length = struct.unpack(">II", shx[100 + 8 * i : 108 + 8 * i])
        values, at = [], 1
        for (_, _, n, _), t in zip(fields, types, strict=True):
            values.append(_dbf_value(record[at : at + n], t))
            at += n
        rows.append((*values, wkb.from_shape(shp[2 * offset + 8 : 2 * offset + 8 + 2 * length]), i))
    names = [n for n, *_ in fields]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)] + [T.StructField(geometryColumn, T.BinaryType()), T.StructField(ORD, T.LongType())])
    df = ctx.spark.createDataFrame(rows, schema)
    return df.select(*[c(n) for n in names], c(geometryColumn).alias(geometryColumn, metadata={"geometry": True, "srid": srid}), c(ORD))


# --- GeoPackage ------------------------------------------------------------------------------------------------------


def gpkg_wkb(blob: bytes | None) -> bytes | None:
    """The WKB in a GeoPackage blob: a header with an envelope of a size by its code, or bare WKB."""
    if blob is None:
        return None
    if blob[:2] != b"GP":
        return bytes(blob)
    sizes = (0, 32, 48, 48, 64)
    code = blob[3] >> 1 & 7
    return None if blob[3] >> 4 & 1 or code >= len(sizes) else bytes(blob[8 + sizes[code] :])


def _affinity(declared: str) -> T.DataType:
    up = (declared or "").upper()
    if "BOOL" in up:
        return T.BooleanType()
    if "INT" in up:
        return T.LongType()
    if any(x in up for x in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return T.DoubleType()
    return T.StringType()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@block("SourceGeoPackage", "source")
def geopackage(ctx: BlockContext, path: str, table: str | None = None, batchSize: int = 1000, geometryColumn: str = "geom") -> DataFrame:
    """A feature table of an SQLite file that all executors can open, read by ranges of its row ids."""
    local = re.sub(r"^file:(//)?", "", path)
    db = sqlite3.connect(f"file:{local}?mode=ro", uri=True)
    try:
        if not table:
            found = db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY rowid LIMIT 1").fetchone()
            if not found:
                raise ValueError("the file has no feature table")
            table = found[0]
        geom = db.execute("SELECT column_name, srs_id FROM gpkg_geometry_columns WHERE lower(table_name) = lower(?)", (table,)).fetchone()
        info = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
        if not info:
            raise ValueError(f"table '{table}' does not exist")
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()  # noqa: S608
    finally:
        db.close()
    geom_name, srid = (geom[0], geom[1]) if geom else (None, 4326)
    plain = [(r[1], _affinity(r[2])) for r in info if r[1] != geom_name]
    names = [n for n, _ in plain]
    schema = T.StructType([T.StructField(n, t) for n, t in plain] + [T.StructField(geometryColumn, T.BinaryType()), T.StructField(ORD, T.LongType())])
    select = f"SELECT rowid, {', '.join(map(_quoted, [*names, *([geom_name] if geom_name else [])]))} FROM {_quoted(table)} WHERE rowid >= ? AND rowid < ? ORDER BY rowid"  # noqa: S608

    def read(bounds: Iterator) -> Iterator:
        import pandas as pd

        for pdf in bounds:
            for begin, end in zip(pdf["a"], pdf["b"], strict=True):
                own = sqlite3.connect(f"file:{local}?mode=ro", uri=True)
                try:
                    cursor = own.execute(select, (int(begin), int(end)))
                    while chunk := cursor.fetchmany(5000):
                        rows = [(*[_gpkg_value(v, t) for v, (_, t) in zip(r[1:], plain, strict=False)], gpkg_wkb(r[-1]) if geom_name else None, r[0]) for r in chunk]
                        yield pd.DataFrame(rows, columns=[*names, geometryColumn, ORD])
                finally:
                    own.close()

    if low is None:
        df = ctx.spark.createDataFrame([], schema)
    else:
        step = max(50_000, -(-(high - low + 1) // 1000))
        ranges = [(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]
        df = ctx.spark.createDataFrame(ranges, "a long, b long").repartition(len(ranges), "a").mapInPandas(read, schema)
    return df.select(*[c(n) for n in names], c(geometryColumn).alias(geometryColumn, metadata={"geometry": True, "srid": srid}), c(ORD))


def _gpkg_value(v, t: T.DataType):
    """SQLite's value as the column's type; blobs in text columns as hexadecimal, what can't be read as the default."""
    try:
        if isinstance(t, T.BooleanType):
            return str(v).strip().lower() in ("1", "true")
        if isinstance(t, T.LongType):
            return 0 if v is None else int(v)
        if isinstance(t, T.DoubleType):
            return 0.0 if v is None else float(v)
    except (TypeError, ValueError):
        return 0 if isinstance(t, T.LongType) else 0.0
    return "" if v is None else bytes(v).hex().upper() if isinstance(v, bytes) else str(v)


# --- Excel -----------------------------------------------------------------------------------------------------------


def column_number(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Za-z]*", reference)[0].upper():
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheet_rows(data: bytes, sheet: str | None) -> list[list[str]]:
    """The texts of a sheet's cells, by row."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = book.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ET.fromstring(book.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
    sheets = [(x.attrib.get("name", ""), next((v for k, v in x.attrib.items() if k.endswith("}id")), "")) for x in ET.fromstring(book.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"]
    chosen = next((s for s in sheets if sheet and s[0].lower() == sheet.strip().lower()), None) if sheet else (sheets or [None])[0]
    if chosen is None:
        raise ValueError(f"the workbook has no sheet '{sheet or ''}'")
    links = {x.attrib["Id"]: x.attrib["Target"] for x in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[chosen[1]].lstrip("/")
    rows = []
    for row in ET.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter():
        if _local(row.tag) != "row":
            continue
        cells: dict[int, str] = {}
        for i, cell in enumerate(row):
            at = column_number(cell.attrib["r"]) if "r" in cell.attrib else i
            kind, texts = cell.attrib.get("t"), {_local(x.tag): "".join(y.text or "" for y in x.iter()) for x in cell}
            value = texts.get("v", "")
            cells[at] = texts.get("is", "") if kind == "inlineStr" else shared[int(value)] if kind == "s" else {"1": "true", "0": "false"}.get(value, value) if kind == "b" else value
        rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return rows


@block("SourceExcel", "source")
def excel(ctx: BlockContext, path: str, sheetName: str | None = None, hasHeader: bool = True, batchSize: int = 1000, schemaSampleRows: int = 256, geometryColumn: str = "geom") -> DataFrame:
    """A sheet of an .xlsx file; the column named as the geometry holds WKT. A geometry field is always last."""
    rows = sheet_rows(whole_text(ctx.spark, path), sheetName)
    width = max(map(len, rows), default=0)
    head = rows[0] if rows and hasHeader else []
    names = [(head[i].strip() if i < len(head) else "") or f"col{i + 1}" for i in range(width)]
    records = [{n: (r[i] if i < len(r) else "") for i, n in enumerate(names)} for r in rows[1 if hasHeader else 0 :]]
    wkt = next((n for n in names if n.lower() == geometryColumn.lower()), None)
    for r in records:
        r["\0wkt"] = r.get(wkt, "") if wkt else ""
    df = catalog_frame(ctx.spark, [*names, "\0wkt"], records, geometryColumn, schemaSampleRows)
    shape = g.from_wkt(F.when(F.length(F.trim(c("\0wkt").cast("string"))) > 0, c("\0wkt").cast("string")))
    return df.select(*[shape.alias(x, metadata=GEOM) if x == geometryColumn else c(x) for x in df.columns if x != "\0wkt"])


