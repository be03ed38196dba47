"""Database and feature-service sinks."""

from __future__ import annotations

import itertools
import re
import urllib.request
import uuid
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.values import ORD, c, geometry_field, invariant_text, is_blank, is_geometry
from weftline.geo import functions as g
from weftline.plans.registry import BlockContext, block
from weftline.sinks.files import shown
from weftline.sinks.modes import Writer, ordered, rows_of, write_mode
from weftline.sources.remote import jdbc_options

_TABLE = re.compile(r'[A-Za-z_"][\w"]*(\.[A-Za-z_"][\w"]*)?$')


def database_frame(df: DataFrame) -> DataFrame:
    """Blank texts as nulls, geometries as WKB."""
    return df.select(*[F.when(~is_blank(c(f.name)), c(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else c(f.name) for f in shown(df)])


@block("SinkPostGis", "sink")
def postgis(ctx: BlockContext, connectionString: str, table: str, writeMode: str | None = None) -> Writer:
    """Rows appended through JDBC from all tasks.

    Transactional: tasks fill a staging table, and one INSERT ... SELECT on one connection makes its rows appear
    together. BatchCommit(n): tasks append to the target and commit every n batches.
    """
    df, mode, options = database_frame(ctx.input), write_mode(writeMode), jdbc_options(connectionString)
    if not _TABLE.match(table):
        raise ValueError(f"table '{table}' is no identifier")

    def write() -> int:
        if not mode.transactional:
            df.write.format("jdbc").options(**options).option("dbtable", table).option("batchsize", 1000 * mode.batches).mode("append").save()
            return df.count()
        stage = f"weftline_stage_{uuid.uuid4().hex[:12]}"
        jvm = ctx.spark._jvm
        if "driver" in options:
            jvm.java.lang.Class.forName(options["driver"])
        link = jvm.java.sql.DriverManager.getConnection(options["url"], options.get("user"), options.get("password"))
        try:
            df.write.format("jdbc").options(**options).option("dbtable", stage).mode("overwrite").save()
            names = ", ".join('"' + x.replace('"', '""') + '"' for x in df.columns)
            link.setAutoCommit(False)
            n = link.createStatement().executeUpdate(f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage}")  # noqa: S608
            link.commit()
            return n
        except Exception:
            link.rollback() if not link.getAutoCommit() else None
            raise
        finally:
            link.setAutoCommit(True)
            link.createStatement().executeUpdate(f"DROP TABLE IF EXISTS {stage}")
            link.close()

    return write


def _gml(kind: str, shape: dict) -> str:
    flat = lambda cs: " ".join(f"{x[0]!r} {x[1]!r}" for x in cs)
    cs = shape["coordinates"]
    if kind == "Point":
        return f"<gml:Point><gml:pos>{flat([cs])}</gml:pos></gml:Point>"
    if kind == "LineString":
        return f"<gml:LineString><gml:posList>{flat(cs)}</gml:posList></gml:LineString>"
    rings = [f"<gml:LinearRing><gml:posList>{flat(r)}</gml:posList></gml:LinearRing>" for r in cs]
    return "<gml:Polygon>" + f"<gml:exterior>{rings[0]}</gml:exterior>" + "".join(f"<gml:interior>{r}</gml:interior>" for r in rings[1:]) + "</gml:Polygon>"


def transaction(rows: list[dict], feature_type: str, namespace: str, geometry_field_name: str) -> str:
    """A WFS 1.1.0 transaction that inserts rows; each has its texts and the GeoJSON of its geometry under an empty name."""
    import json

    features = []
    for r in rows:
        inner = "".join(f"<f:{k}>{escape(v)}</f:{k}>" for k, v in r.items() if k and v is not None and v != "")
        if r.get(""):
            shape = json.loads(r[""])
            inner += f"<f:{geometry_field_name}>{_gml(shape['type'], shape)}</f:{geometry_field_name}>"
        features.append(f"<wfs:Insert><f:{feature_type}>{inner}</f:{feature_type}></wfs:Insert>")
    return f'<?xml version="1.0" encoding="UTF-8"?><wfs:Transaction service="WFS" version="1.1.0" xmlns:wfs="http://www.opengis.net/wfs" xmlns:gml="http://www.opengis.net/gml" xmlns:f="{escape(namespace)}">' + "".join(features) + "</wfs:Transaction>"


@block("SinkWfsT", "sink")
def wfs_t(ctx: BlockContext, url: str, featureType: str = "feature", featureNamespace: str = "urn:weftline:wfs", geometryField: str = "geom", writeMode: str | None = None) -> Writer:
    """Inserts by POST: all rows in one transaction, or one for each batch of 1000 n rows. Other shapes go as their centroid."""
    df, mode, field = ctx.input, write_mode(writeMode), geometry_field(ctx.input.schema)
    order = [c(ORD)] if ORD in df.columns else []
    shape = []
    if field is not None:
        simple = g.words(c(field.name), "type").isin("Point", "LineString", "Polygon")
        shape = [g.words(F.when(simple, c(field.name)).otherwise(g.unary(c(field.name), "centroid")), "json").alias("")]
    texts = df.select(*[invariant_text(c(f.name), f).alias(f.name) for f in shown(df) if not is_geometry(f)], *shape, *order)

    def post(rows: list[dict]) -> None:
        body = transaction(rows, featureType, featureNamespace, geometryField).encode()
        with urllib.request.urlopen(urllib.request.Request(url, data=body, headers={"Content-Type": "text/xml; charset=utf-8"}), timeout=60) as answer:  # noqa: S310
            if b"ExceptionReport" in answer.read():
                raise RuntimeError("the service refused the transaction")

    def write() -> int:
        rows = (r.asDict() for r in rows_of(ordered(texts)))
        if mode.transactional:
            all_rows = list(rows)  # one transaction holds every row by definition
            if all_rows:
                post(all_rows)
            return len(all_rows)
        n = 0
        while chunk := list(itertools.islice(rows, 1000 * mode.batches)):
            post(chunk)
            n += len(chunk)
        return n

    return write
