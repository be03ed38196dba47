"""Geometry transforms: JVM functions on the first geometry field; null stays null and rows keep their order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.values import c, find_field, geometry_field, hidden, is_geometry, visible, with_field
from weftline.geo import functions as g
from weftline.operators.attributes import numeric
from weftline.plans.registry import BlockContext, block


def first_geometry(df: DataFrame) -> T.StructField:
    f = geometry_field(df.schema)
    if f is None:
        raise ValueError("the input has no geometry field")
    return f


def mapped(df: DataFrame, f, **metadata) -> DataFrame:
    """The first geometry field replaced by f(column); its metadata stays, but for what is given."""
    field = first_geometry(df)
    return with_field(df, field.name, f(c(field.name)), {**field.metadata, **metadata})


@block("TransformCreateGeometry")
def create_geometry(ctx: BlockContext, xField: str, yField: str, geometryFieldName: str = "geom", srid: int = 4326) -> DataFrame:
    """A point from two numbers, null where one can't be read."""
    df = ctx.input
    return with_field(df, geometryFieldName, g.point(numeric(find_field(df.schema, xField)), numeric(find_field(df.schema, yField))), {"geometry": True, "srid": srid})


@block("TransformRemoveGeometry")
def remove_geometry(ctx: BlockContext) -> DataFrame:
    f = geometry_field(ctx.input.schema)
    return ctx.input.drop(f.name) if f else ctx.input


@block("TransformAffine")
def affine(ctx: BlockContext, m00: float = 1, m01: float = 0, m02: float = 0, m10: float = 0, m11: float = 1, m12: float = 0) -> DataFrame:
    numbers = [F.lit(float(x)) for x in (m00, m01, m02, m10, m11, m12)]
    return mapped(ctx.input, lambda x: g.call("affine", x, *numbers))


@block("TransformBuffer")
def buffer(ctx: BlockContext, distance: float) -> DataFrame:
    return mapped(ctx.input, lambda x: g.unary(x, "buffer", distance))


@block("TransformCentroid")
def centroid(ctx: BlockContext) -> DataFrame:
    return mapped(ctx.input, lambda x: g.unary(x, "centroid"))


@block("TransformEnvelope")
def envelope(ctx: BlockContext) -> DataFrame:
    return mapped(ctx.input, lambda x: g.unary(x, "envelope"))


@block("TransformConvexHull")
def convex_hull(ctx: BlockContext) -> DataFrame:
    return mapped(ctx.input, lambda x: g.unary(x, "hull"))


@block("TransformDensify")
def densify(ctx: BlockContext, distanceTolerance: float) -> DataFrame:
    if distanceTolerance <= 0:
        raise ValueError("distanceTolerance must be positive")
    return mapped(ctx.input, lambda x: g.unary(x, "densify", distanceTolerance))


def crs_code(text: str) -> int:
    m = re.fullmatch(r"\s*(?:EPSG:)?(\d+)\s*", text, re.IGNORECASE)
    code = int(m[1]) if m else 0
    if not (code in (4326, 3857, 28992) or 32601 <= code <= 32660 or 32701 <= code <= 32760):
        raise ValueError(f"CRS '{text}' is not supported; supported: EPSG 4326, 3857, 28992, 32601-32660, 32701-32760")
    return code


@block("TransformReproject")
def reproject(ctx: BlockContext, sourceCrs: str, targetCrs: str, gridShiftDirectory: str | None = None) -> DataFrame:
    """Closed forms between the supported systems, with x as longitude; none needs grid files, so a directory is optional."""
    a, b = crs_code(sourceCrs), crs_code(targetCrs)
    if a == b:
        return mapped(ctx.input, lambda x: x, srid=b)
    return mapped(ctx.input, lambda x: g.call("project", x, F.lit(a), F.lit(b)), srid=b)


@block("TransformSplitGeometry")
def split_geometry(ctx: BlockContext, splitterWkt: str | None = None, splitterField: str | None = None) -> DataFrame:
    """A row for each piece of a polygon or line cut by a geometry, given as WKT or in a field; other rows stay as they are."""
    df, field = ctx.input, first_geometry(ctx.input)
    if splitterWkt:
        by: Column = g.from_wkt(F.lit(splitterWkt))
        if df.sparkSession.range(1).select(by.isNull()).first()[0]:
            raise ValueError("splitterWkt is no geometry")
    elif splitterField:
        f = find_field(df.schema, splitterField)
        by = c(f.name) if is_geometry(f) else g.from_wkt(c(f.name).cast("string"))
    else:
        raise ValueError("splitterWkt or splitterField is required")
    pieces = df.select(*[c(x) for x in visible(df)], *hidden(df), F.explode(g.call("split", c(field.name), by)).alias("__piece"))
    return pieces.select(*[F.col("__piece").alias(x, metadata=field.metadata) if x == field.name else c(x) for x in visible(df)], *hidden(df))


@block("TransformDissolve")
def dissolve(ctx: BlockContext, groupBy: str | None = None) -> DataFrame:
    """The union of the geometries of each key; unions are built up in partial aggregation, so no group is gathered whole."""
    df, field = ctx.input, first_geometry(ctx.input)
    union = g.union_all(c(field.name)).alias(field.name, metadata=field.metadata)
    if groupBy:
        key = find_field(df.schema, groupBy)
        return df.where(c(field.name).isNotNull()).groupBy(c(key.name)).agg(union)
    return df.agg(union).where(c(field.name).isNotNull())


@block("TransformLineMerger")
def line_merger(ctx: BlockContext) -> DataFrame:
    """Touching lines joined; lines that share no end with others never meet in one task.

    Lines are grouped by the connected component of their end points, so each group is merged by itself.
    """
    from weftline.functions.graph import line_components

    df, field = ctx.input, first_geometry(ctx.input)
    grouped = line_components(df.select(c(field.name).alias("wkb")))
    merged = grouped.groupBy("c").agg(F.collect_list("wkb").alias("all")).select(F.explode(g.call("mergelines", F.col("all"))).alias(field.name))
    return merged.select(c(field.name).alias(field.name, metadata=field.metadata))
