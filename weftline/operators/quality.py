"""Quality transforms on the first geometry field."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weftline.functions.values import c
from weftline.geo import functions as g
from weftline.operators.geometry import first_geometry, mapped
from weftline.plans.registry import BlockContext, block


@block("TransformSimplify")
def simplify(ctx: BlockContext, tolerance: float, preserveTopology: bool = True) -> DataFrame:
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    return mapped(ctx.input, lambda x: g.unary(x, "simplify", tolerance, float(preserveTopology)))


@block("TransformRemoveDuplicateVertices")
def remove_duplicate_vertices(ctx: BlockContext) -> DataFrame:
    """Lines and polygons without vertices equal to the one before."""
    return mapped(ctx.input, lambda x: g.unary(x, "distinct_vertices"))


@block("TransformValidateGeometry")
def validate_geometry(ctx: BlockContext, dropInvalid: bool = True) -> DataFrame:
    """Invalid geometries are dropped, if so asked, and each gets a line in the error log; null geometries stay."""
    df, field = ctx.input, first_geometry(ctx.input)
    problem = g.words(c(field.name), "invalid")
    ctx.rejects.append(("invalid geometry: {problem}", df.select(problem.alias("problem")).where("problem IS NOT NULL")))
    return df.where(problem.isNull()) if dropInvalid else df
