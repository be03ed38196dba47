"""Databases through JDBC, and feature services through HTTP."""

from __future__ import annotations

import re
import urllib.request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.values import c, filled, numbered
from weftline.plans.registry import BlockContext, block
from weftline.sources import files
from weftline.sources.checkpoints import read_token, write_token

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*$")


def jdbc_options(connection: str) -> dict[str, str]:
    """Spark's JDBC options from a ``Host=..;Port=..`` text or a JDBC URL."""
    if connection.strip().lower().startswith("jdbc:"):
        return {"url": connection.strip()}
    pairs = {k.strip().lower(): v.strip() for k, _, v in (x.partition("=") for x in connection.split(";")) if v}
    host, port = pairs.get("host") or pairs.get("server") or "localhost", pairs.get("port", "5432")
    out = {"url": f"jdbc:postgresql://{host}:{port}/{pairs.get('database') or pairs.get('initial catalog') or 'postgres'}", "driver": "org.postgresql.Driver"}
    for key, names in (("user", ("username", "user id", "user", "uid")), ("password", ("password", "pwd"))):
        if value := next((pairs[n] for n in names if n in pairs), None):
            out[key] = value
    return out


def literal(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def _named(column: str, role: str = "checkpointColumn") -> str:
    if not _IDENTIFIER.match(column):
        raise ValueError(f"{role} '{column}' is no identifier")
    return f'"{column}"'


def resume_query(query: str, column: str, token, until=None) -> str:
    """The query's rows after a token and up to another, in the order of the column."""
    name = _named(column)
    bounds = [f"{name} {sign} {literal(x)}" for sign, x in ((">", token), ("<=", until)) if x is not None]
    where = f" WHERE {' AND '.join(bounds)}" if bounds else ""
    return f'SELECT * FROM ({query.strip().rstrip(";")}) AS weftline_source{where} ORDER BY {name}'


def range_query(query: str, column: str, token=None) -> str:
    """The least and the largest value of a column, after a token."""
    name = _named(column, "column")
    where = "" if token is None else f" WHERE {name} > {literal(token)}"
    return f"SELECT min({name}) AS low, max({name}) AS high FROM ({query.strip().rstrip(';')}) AS weftline_range{where}"


def _query(ctx: BlockContext, connectionString: str, query: str, checkpointPath: str | None, checkpointColumn: str | None, partitionColumn: str | None, numPartitions: int) -> DataFrame:
    """With a checkpoint, the largest value is asked for first: it bounds what is read and is the token that is saved, so
    rows that arrive meanwhile are left to the next run. With a partition column the range is read by so many tasks."""
    query = query.strip().rstrip(";")

    def read(**options) -> DataFrame:
        return ctx.spark.read.format("jdbc").options(**jdbc_options(connectionString), **options).load()

    def span(column: str, token=None):
        return read(query=range_query(query, column, token)).first()

    if checkpointPath:
        if not checkpointColumn:
            raise ValueError("checkpointPath needs checkpointColumn")
        token = read_token(checkpointPath)
        last = span(checkpointColumn, token)[1]
        query = resume_query(query, checkpointColumn, token, token if last is None else last)
        if last is not None:
            ctx.after_commit.append(lambda: write_token(checkpointPath, last))
    low, high = span(partitionColumn) if partitionColumn else (None, None)
    if low is None:
        df = read(query=query)
    else:
        bounds = {"partitionColumn": partitionColumn, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(numPartitions)}
        df = read(dbtable=f"({query}) weftline_parts", **bounds)
    fields = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BinaryType):  # geometries come as ST_AsBinary
            fields.append(c(f.name).alias(f.name, metadata={"geometry": True, "srid": 4326}))
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            fields.append(c(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, T.ShortType):
            fields.append(c(f.name).cast("int").alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            fields.append(F.to_json(c(f.name)).alias(f.name))
        else:
            fields.append(c(f.name))
    return numbered(filled(df.select(*fields)))


@block("SourcePostGresQL", "source")
def postgresql(ctx: BlockContext, connectionString: str, query: str, batchSize: int = 1000, checkpointPath: str | None = None, checkpointEvery: int = 10_000, checkpointColumn: str | None = None, partitionColumn: str | None = None, numPartitions: int = 8) -> DataFrame:
    """Any query; with a checkpoint only rows after the last token, and the next is written after the sinks have committed.

    partitionColumn names a column of numbers, dates or times by whose range numPartitions tasks read.
    """
    return _query(ctx, connectionString, query, checkpointPath, checkpointColumn, partitionColumn, numPartitions)


@block("SourcePostGis", "source")
def postgis(ctx: BlockContext, connectionString: str, query: str, batchSize: int = 1000, checkpointPath: str | None = None, checkpointEvery: int = 10_000, checkpointColumn: str | None = None, partitionColumn: str | None = None, numPartitions: int = 8) -> DataFrame:
    return _query(ctx, connectionString, query, checkpointPath, checkpointColumn, partitionColumn, numPartitions)


@block("SourceWfs", "source")
def wfs(ctx: BlockContext, url: str, geometryColumn: str = "geom", batchSize: int = 1000, accept: str | None = None) -> DataFrame:
    """One GET: GeoJSON if the answer says JSON, else GML with the boundary ``member`` besides the usual ones."""
    request = urllib.request.Request(url, headers={"Accept": accept} if accept else {})
    with urllib.request.urlopen(request, timeout=60) as answer:  # noqa: S310
        kind, text = answer.headers.get("Content-Type", ""), answer.read().decode("utf-8")
    if "json" in kind.lower():
        names, rows = files.geojson_rows(text)
    else:
        names, rows = files.gml_rows(text.encode(), ("member",))
    return files.catalog_frame(ctx.spark, names, rows, geometryColumn, None)
