"""Two-input spatial blocks.

Joins use a grid of many levels: a geometry lies in at most four cells of the level whose cells are at least as large as
it is. Two geometries are compared at the coarser of their levels, so both are dealt by (level, level, cell) in a hash
join; a pair that shares several cells counts in the first. Boxes are compared before geometries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.values import ORD, c, default_of, find_field, hidden, is_geometry, visible
from weftline.geo import functions as g
from weftline.operators.attributes import parts
from weftline.operators.geometry import first_geometry
from weftline.plans.registry import BlockContext, block

#: Rows of a lookup side up to which it may be broadcast.
BROADCAST_ROWS = 100_000
#: Levels: cells of 2**level; smaller and larger extents take the ends of the range.
LEAST, MOST = -24, 40


def predicate_name(text: str) -> str:
    low = text.strip().lower()
    return low if low in ("contains", "within") else "intersects"


def _boxed(df: DataFrame, field: str, tag: str) -> DataFrame:
    """df with its box and level, both null without an extent."""
    out = df.withColumn(f"__{tag}b", g.call("bounds", c(field)))
    box = F.col(f"__{tag}b")
    extent = F.greatest(box[2] - box[0], box[3] - box[1])
    level = F.when(extent > 0, F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.ceil(F.log2(extent)).cast("int")))).otherwise(LEAST)
    level = F.when(box.isNotNull(), level)
    return out.withColumn(f"__{tag}l", level)


def _cells(df: DataFrame, tag: str, levels: list[int]) -> DataFrame:
    """A row for each level of the other side and cell at the coarser level; one row without an extent."""
    box = F.col(f"__{tag}b")
    others = df.withColumn("__other", F.explode_outer(F.when(box.isNotNull(), F.array(*[F.lit(x) for x in levels]))))
    size = F.pow(F.lit(2.0), F.greatest(F.col(f"__{tag}l"), F.col("__other")).cast("double"))
    at = lambda i: F.floor(box[i] / size)
    return others.withColumn("__x", F.explode_outer(F.sequence(at(0), at(2)))).withColumn("__y", F.explode_outer(F.sequence(at(1), at(3)))).withColumn("__s", size)


def _levels(df: DataFrame, tag: str) -> list[int]:
    return [r[0] for r in df.select(f"__{tag}l").where(F.col(f"__{tag}l").isNotNull()).distinct().collect()]  # at most MOST - LEAST + 1


def candidates(left: DataFrame, left_geom: str, right: DataFrame, right_geom: str, op: str) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides dealt to cells, and the condition of the join; right has the columns __rb and __geom_r."""
    a, b = _boxed(left, left_geom, "a"), _boxed(right.withColumnRenamed(right_geom, "__geom_r"), "__geom_r", "r")
    la, lb = _levels(a, "a"), _levels(b, "r")
    a = _cells(a, "a", lb or [LEAST])
    b = _cells(b, "r", la or [LEAST]).select("*", F.col("__x").alias("__rx"), F.col("__y").alias("__ry"), F.col("__other").alias("__rother")).drop("__x", "__y", "__other", "__s")
    x, y = F.col("__ab"), F.col("__rb")
    same = (F.col("__al") == F.col("__rother")) & (F.col("__other") == F.col("__rl")) & (F.col("__x") == F.col("__rx")) & (F.col("__y") == F.col("__ry"))
    meet = (x[0] <= y[2]) & (y[0] <= x[2]) & (x[1] <= y[3]) & (y[1] <= x[3])
    first = (F.floor(F.greatest(x[0], y[0]) / F.col("__s")) == F.col("__x")) & (F.floor(F.greatest(x[1], y[1]) / F.col("__s")) == F.col("__y"))
    return a, b, same & meet & first & g.related(c(left_geom), F.col("__geom_r"), op)


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


@block("TransformSpatialFilter", inputs=("in", "lookup"))
def spatial_filter(ctx: BlockContext, predicate: str = "Intersects") -> DataFrame:
    """Rows whose geometry stands in the relation to some geometry of the lookup; null geometries go."""
    df, lookup = ctx.input, ctx.inputs["lookup"]
    geom, other = first_geometry(df).name, first_geometry(lookup).name
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    a, b, on = candidates(rows, geom, lookup.select(c(other)), other, predicate_name(predicate))
    met = a.join(_sized(b), on, "left_semi").dropDuplicates(["__row"])
    return met.select(*[c(x) for x in df.columns])


@block("TransformSpatialEnrich", inputs=("in", "lookup"))
def spatial_enrich(ctx: BlockContext, attributes: str = "*", joinType: str = "left", predicate: str = "Intersects") -> DataFrame:
    """The attributes of the first lookup row that matches, in the lookup's order; without any, defaults or no row."""
    df, lookup = ctx.input, ctx.inputs["lookup"]
    geom, other = first_geometry(df).name, first_geometry(lookup).name
    plain = [f for f in lookup.schema.fields if not is_geometry(f) and f.name != ORD]
    wanted = plain if attributes.strip() == "*" else [find_field(lookup.schema, x) for x in parts(attributes)]
    if any(is_geometry(f) for f in wanted):
        raise ValueError("attributes cannot hold a geometry")
    clash = {f.name.lower() for f in wanted} & {x.lower() for x in visible(df)}
    if clash:
        raise ValueError(f"fields exist on both sides: {', '.join(sorted(clash))}")
    order = c(ORD) if ORD in lookup.columns else F.monotonically_increasing_id()
    side = lookup.select(c(other), F.struct(order.alias("o"), *[c(f.name).alias(f"v{i}") for i, f in enumerate(wanted)]).alias("__match"))
    inner = joinType.strip().lower() == "inner"
    a, b, on = candidates(df.withColumn("__row", F.monotonically_increasing_id()), geom, side, other, predicate_name(predicate))
    met = a.join(_sized(b), on, "inner" if inner else "left")
    joined = met.groupBy("__row").agg(F.min("__match").alias("__match"), F.first(F.struct(*[c(x) for x in df.columns])).alias("__in"))
    fields = {f.name: f for f in df.schema.fields}
    return joined.select(
        *[F.col("__in")[x].alias(x, metadata=fields[x].metadata) for x in visible(df)],
        *[F.coalesce(F.col("__match")[f"v{i}"], default_of(f.dataType)).alias(f.name, metadata=f.metadata) for i, f in enumerate(wanted)],
        *[F.col("__in")[x].alias(x) for x in hidden(df)],
    )


@block("TransformDifference", inputs=("in", "subtract"))
def difference(ctx: BlockContext) -> DataFrame:
    """Each geometry without the union of those of subtract; rows that get empty stay.

    Only the subtracted geometries that meet a row's box are united for it.
    """
    df, sub = ctx.input, ctx.inputs["subtract"]
    field, other = first_geometry(df), first_geometry(sub).name
    a, b, on = candidates(df.withColumn("__row", F.monotonically_increasing_id()), field.name, sub.select(c(other)), other, "intersects")
    met = a.join(_sized(b), on, "left")
    cut = met.groupBy("__row").agg(F.first(F.struct(*[c(x) for x in df.columns])).alias("__in"), g.union_all(F.col("__geom_r")).alias("__cut"))
    fields = {f.name: f for f in df.schema.fields}
    value = lambda x: g.call("binary", F.col("__in")[x], F.col("__cut"), F.lit("difference")) if x == field.name else F.col("__in")[x]
    return cut.select(*[value(x).alias(x, metadata=fields[x].metadata) for x in df.columns])


@block("TransformSnapGeometries", inputs=("in", "reference"))
def snap_geometries(ctx: BlockContext, tolerance: float = 0.001) -> DataFrame:
    """Geometries snapped to all references that come within the tolerance, in the references' order."""
    df, ref = ctx.input, ctx.inputs["reference"]
    field, other = first_geometry(df), first_geometry(ref).name
    order = c(ORD) if ORD in ref.columns else F.monotonically_increasing_id()
    side = ref.select(c(other), order.alias("__o"))
    # references far from a geometry leave it as it is: their boxes, widened, are joined
    wide = side.withColumn("__wide", g.unary(g.unary(c(other), "envelope"), "buffer", max(tolerance, 1e-12) * 2))
    a, b, on = candidates(df.withColumn("__row", F.monotonically_increasing_id()), field.name, wide.select("__wide", "__o", c(other).alias("__ref")), "__wide", "intersects")
    met = a.join(_sized(b), on, "left")
    gathered = met.groupBy("__row").agg(F.first(F.struct(*[c(x) for x in df.columns])).alias("__in"), F.sort_array(F.collect_list(F.when(F.col("__o").isNotNull(), F.struct(F.col("__o").alias("o"), F.col("__ref").alias("r"))))).alias("__to"))
    fields = {f.name: f for f in df.schema.fields}
    value = lambda x: g.call("snap", F.col("__in")[x], F.transform("__to", lambda t: t["r"]), F.lit(float(tolerance))) if x == field.name else F.col("__in")[x]
    return gathered.select(*[value(x).alias(x, metadata=fields[x].metadata) for x in df.columns])


