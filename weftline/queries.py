"""Registered queries: every block over the driver's tables, beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scratch import scratch_path
from weftline.functions.values import ORD
from weftline.geo import functions as g
from weftline.plans.registry import BlockContext, block_type
from weftline.plans.workflow import Settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def apply(spark: SparkSession, block: str, df: DataFrame | None, second: DataFrame | None = None, port: str = "lookup", **params):
    """Run one block as a workflow would."""
    t = block_type(block)
    inputs = ({"in": df} if df is not None else {}) | ({port: second} if second is not None else {})
    out = t.build(BlockContext(spark, block, inputs, Settings()), **t.bind(params))
    return out.drop(ORD) if isinstance(out, DataFrame) else out


def simple(name: str, tab: str, columns: str, block: str, sql: str, **params) -> None:
    """A query that applies one block to some columns of a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apply(spark, block, table(spark, sf_dir, tab, *columns.split()), **params)

    query(name, sql)(run)


# --- filters, splitter, calculator, mapping ---------------------------------------------------------------------------

simple("filter_numeric", "lineitem", "l_orderkey l_linenumber l_quantity", "TransformFilter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40", when="l_quantity > 40")
simple("filter_logical", "orders", "o_orderkey o_orderstatus o_totalprice", "TransformFilter", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE (lower(o_orderstatus) = 'f' AND o_totalprice >= 150000) OR (NOT lower(o_orderstatus) = 'o' AND o_orderkey <= 100)", when="(o_orderstatus == 'f' && o_totalprice >= 150000) || (!o_orderstatus == O && o_orderkey <= 100)")
simple("filter_string_ops", "customer", "c_custkey c_name c_mktsegment", "TransformFilter", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE (contains(lower(c_mktsegment), 'build') OR starts_with(lower(c_mktsegment), 'auto')) AND ends_with(lower(c_name), '7')", when="(c_mktsegment contains BUILD || c_mktsegment startsWith auto) && c_name endsWith 7")
simple("filter_matches", "part", "p_partkey p_type p_brand", "TransformFilter", "SELECT p_partkey, p_type, p_brand FROM part WHERE regexp_matches(p_brand, 'brand#[12]', 'i')", when="p_brand matches 'BRAND#[12]'")


@query("splitter_ports", "SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice >= 200000 THEN 'high' ELSE 'out' END AS port, o_orderkey, o_totalprice FROM orders")
def splitter_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    ports = apply(spark, "TransformConditionalSplitter", table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), branches="low:o_totalprice < 50000;high:o_totalprice >= 200000")
    rows = [df.select(F.lit(port).alias("port"), *df.columns) for port, df in ports.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


simple("calculator_mul", "lineitem", "l_orderkey l_linenumber l_extendedprice", "TransformCalculator", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice * 2.5 AS gross FROM lineitem", expression="l_extendedprice * 2.5", outputField="gross")
simple("calculator_div_zero", "lineitem", "l_orderkey l_linenumber l_quantity", "TransformCalculator", "SELECT l_orderkey, l_linenumber, 0.0::DOUBLE AS l_quantity FROM lineitem", expression="l_quantity / 0", outputField="l_quantity")
simple("calculator_text", "customer", "c_custkey c_name", "TransformCalculator", "SELECT c_custkey, c_name, 0.0::DOUBLE AS n FROM customer", expression="c_name + 1", outputField="n")
simple("schema_mapper", "customer", "c_custkey c_name c_nationkey c_acctbal", "TransformSchemaMapper", "SELECT c_acctbal AS balance, c_custkey AS id, c_name FROM customer", fields="c_acctbal,c_custkey,c_name", rename="c_custkey:id;c_acctbal:balance")
for _op, _sql in (("trim", "trim(p_type)"), ("upper", "upper(p_type)"), ("lower", "lower(p_type)"), ("prefix", "'x-' || p_type"), ("suffix", "p_type || 'x-'")):
    simple(f"string_{_op}", "part", "p_partkey p_type", "TransformStringManipulator", f"SELECT p_partkey, {_sql} AS p_type FROM part", field="p_type", operation=_op, argument="x-")
simple("null_handler", "documents", "doc_id lang", "TransformNullHandler", "SELECT doc_id, CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'none' ELSE lang END AS lang FROM documents", field="lang", defaultValue="none")
simple("regex_extract", "pages", "page_id url", "TransformRegexExtractor", "SELECT page_id, url, coalesce(regexp_extract(url, 'https?://([^/]+)', 1, 'i'), '') AS host FROM pages", field="url", pattern="HTTPS?://([^/]+)", outputField="host")
simple("regex_extract_no_group", "supplier", "s_suppkey s_name", "TransformRegexExtractor", "SELECT s_suppkey, s_name, '' AS g FROM supplier", field="s_name", pattern="[0-9]+", outputField="g", groupIndex=3)
simple("value_lookup", "orders", "o_orderkey o_orderstatus", "TransformValueLookup", "SELECT o_orderkey, o_orderstatus, CASE lower(o_orderstatus) WHEN 'f' THEN 'filled' WHEN 'o' THEN 'open' ELSE o_orderstatus END AS status FROM orders", field="o_orderstatus", mappings="F=filled;o=open", outputField="status")
simple("noop", "region", "r_regionkey r_name", "TransformNoop", "SELECT r_regionkey, r_name FROM region")


@query("datetime_utc", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t FROM events")
def datetime_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("text"))
    return apply(spark, "TransformDateTime", df, field="text", outputField="when").select("event_id", F.date_format("when", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))


# --- aggregation and duplicates -----------------------------------------------------------------------------------------


@query("agg_count_sum_avg_min_max", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 2)::DOUBLE AS qty, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS low, max(l_tax) AS high FROM lineitem GROUP BY 1, 2")
def agg_count_sum_avg_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply(spark, "TransformAggregator", table(spark, sf_dir, "lineitem"), groupBy="l_returnflag,l_linestatus", aggregates="count:*:n;sum:l_quantity:qty;avg:l_extendedprice:price;min:l_discount:low;max:l_tax:high")
    return out.withColumn("qty", F.round("qty", 2)).withColumn("price", F.round("price", 4))


simple("agg_count_nonblank", "documents", "source lang", "TransformAggregator", "SELECT source, count(*)::BIGINT AS rows, (count(lang) FILTER (WHERE trim(lang) <> ''))::BIGINT AS count_lang FROM documents GROUP BY 1", groupBy="source", aggregates="count:*:rows;count:lang")
simple("agg_global", "orders", "o_totalprice", "TransformAggregator", "SELECT count(*)::BIGINT AS count_a, max(o_totalprice) AS max_o_totalprice FROM orders", groupBy=",", aggregates="count:*;max:o_totalprice")


@query("agg_empty", "SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders WHERE o_totalprice < 0 GROUP BY 1")
def agg_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = apply(spark, "TransformFilter", table(spark, sf_dir, "orders"), when="o_totalprice < 0")
    return apply(spark, "TransformAggregator", none, groupBy="o_orderstatus", aggregates="count:*:n")


@query("dedup_keep_first", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events", "user_id", "event_type", "event_id").withColumn(ORD, F.col("event_id"))
    return apply(spark, "TransformDeduplicateRecords", df, keyFields="user_id,event_type")


simple("dedup_all", "conversations", "role text", "TransformDeduplicateRecords", "SELECT DISTINCT role, text FROM conversations")


# --- geometry --------------------------------------------------------------------------------------------------------------


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points: x and y in the range of longitudes and latitudes, off every whole number."""
    df = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") * 37 % 3600) / 20.0 - 90 + 0.013).alias("x"), ((F.col("c_custkey") * 53 % 1600) / 20.0 - 40 + 0.017).alias("y"))
    return apply(spark, "TransformCreateGeometry", df, xField="x", yField="y")


_POINTS = "(SELECT c_custkey, (c_custkey * 37 % 3600) / 20.0 - 90 + 0.013 AS x, (c_custkey * 53 % 1600) / 20.0 - 40 + 0.017 AS y FROM customer)"


def xy(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.round(g.measure(F.col("geom"), "x"), 6).alias("gx"), F.round(g.measure(F.col("geom"), "y"), 6).alias("gy"))


def boxes(spark: SparkSession, sf_dir: str, width: str = "5") -> DataFrame:
    """A box per nation on a line, five wide; neighbours keep a gap of one."""
    x = (F.col("n_nationkey") * 6 - 80).cast("string")
    far = (F.col("n_nationkey") * 6 - 80 + F.expr(width)).cast("string")
    ring = F.concat(F.lit("POLYGON(("), x, F.lit(" -30,"), far, F.lit(" -30,"), far, F.lit(" 30,"), x, F.lit(" 30,"), x, F.lit(" -30))"))
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", g.from_wkt(ring).alias("geom"))
    return df.select("n_nationkey", "n_name", "n_regionkey", F.col("geom").alias("geom", metadata={"geometry": True}))


def shapes(df: DataFrame, wkt) -> DataFrame:
    return df.withColumn("geom", g.from_wkt(wkt)).select(*df.columns, F.col("geom").alias("geom", metadata={"geometry": True, "srid": 4326}))


query("create_geometry", f"SELECT c_custkey, round(x, 6)::DOUBLE AS gx, round(y, 6)::DOUBLE AS gy FROM {_POINTS}")(lambda spark, sf: xy(points(spark, sf), "c_custkey"))
query("affine", f"SELECT c_custkey, round(2 * x + 0.5 * y + 1, 6)::DOUBLE AS gx, round(-y + 3, 6)::DOUBLE AS gy FROM {_POINTS}")(lambda spark, sf: xy(apply(spark, "TransformAffine", points(spark, sf), m00=2, m01=0.5, m02=1, m11=-1, m12=3), "c_custkey"))
query("reproject_3857", f"SELECT c_custkey, round(6378137 * radians(x), 4)::DOUBLE AS gx, round(6378137 * ln(tan(pi() / 4 + radians(y) / 2)), 4)::DOUBLE AS gy FROM {_POINTS}")(
    lambda spark, sf: apply(spark, "TransformReproject", points(spark, sf), sourceCrs="EPSG:4326", targetCrs="3857").select("c_custkey", F.round(g.measure(F.col("geom"), "x"), 4).alias("gx"), F.round(g.measure(F.col("geom"), "y"), 4).alias("gy"))
)
query("remove_geometry", f"SELECT c_custkey, x::DOUBLE AS x, y::DOUBLE AS y FROM {_POINTS}")(lambda spark, sf: apply(spark, "TransformRemoveGeometry", points(spark, sf)))
query("buffer_area", f"SELECT c_custkey, round(0.5 * 32 * 4 * sin(2 * pi() / 32), 6)::DOUBLE AS area FROM {_POINTS}")(lambda spark, sf: apply(spark, "TransformBuffer", points(spark, sf), distance=2).select("c_custkey", F.round(g.measure(F.col("geom"), "area"), 6).alias("area")))
query("envelope", f"SELECT c_custkey, round(x - 2, 6)::DOUBLE AS minx, round(y + 2, 6)::DOUBLE AS maxy, 16.0::DOUBLE AS area FROM {_POINTS}")(
    lambda spark, sf: apply(spark, "TransformEnvelope", apply(spark, "TransformBuffer", points(spark, sf), distance=2)).select("c_custkey", F.round(g.measure(F.col("geom"), "minx"), 6).alias("minx"), F.round(g.measure(F.col("geom"), "maxy"), 6).alias("maxy"), F.round(g.measure(F.col("geom"), "area"), 6).alias("area"))
)
query("centroid", "SELECT n_nationkey, (n_nationkey * 6 - 77.5)::DOUBLE AS gx, 0.0::DOUBLE AS gy FROM nation")(lambda spark, sf: xy(apply(spark, "TransformCentroid", boxes(spark, sf)), "n_nationkey"))


@query("convex_hull", "SELECT n_nationkey, 12.5::DOUBLE AS area, 4 AS points FROM nation")
def convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    df = shapes(table(spark, sf_dir, "nation", "n_nationkey"), F.concat(F.lit("LINESTRING("), k, F.lit(" 0,"), (F.col("n_nationkey") + 5).cast("string"), F.lit(" 0,"), k, F.lit(" 5)")))
    return apply(spark, "TransformConvexHull", df).select("n_nationkey", g.measure(F.col("geom"), "area").alias("area"), g.measure(F.col("geom"), "points").cast("int").alias("points"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line per nation that goes right and stays in its own row, with one vertex twice."""
    y = F.col("n_nationkey").cast("string")
    return shapes(table(spark, sf_dir, "nation", "n_nationkey"), F.concat(F.lit("LINESTRING(0 "), y, F.lit(",4 "), y, F.lit(",4 "), y, F.lit(",10 "), y, F.lit(")")))


def sized(df: DataFrame, *measures: str, keep: tuple[str, ...] = ("n_nationkey",)) -> DataFrame:
    return df.select(*keep, *[F.round(g.measure(F.col("geom"), m), 6).alias(m) for m in measures])


query("densify", "SELECT n_nationkey, 6.0::DOUBLE AS points, 10.0::DOUBLE AS length FROM nation")(lambda spark, sf: sized(apply(spark, "TransformDensify", apply(spark, "TransformRemoveDuplicateVertices", lines(spark, sf)), distanceTolerance=2.5), "points", "length"))
query("remove_duplicate_vertices", "SELECT n_nationkey, 3.0::DOUBLE AS points, 10.0::DOUBLE AS length FROM nation")(lambda spark, sf: sized(apply(spark, "TransformRemoveDuplicateVertices", lines(spark, sf)), "points", "length"))
query("simplify", "SELECT n_nationkey, 2.0::DOUBLE AS points, 10.0::DOUBLE AS length FROM nation")(lambda spark, sf: sized(apply(spark, "TransformSimplify", lines(spark, sf), tolerance=0.1), "points", "length"))
query("simplify_dp", "SELECT n_nationkey, 2.0::DOUBLE AS points, 10.0::DOUBLE AS length FROM nation")(lambda spark, sf: sized(apply(spark, "TransformSimplify", lines(spark, sf), tolerance=0.1, preserveTopology="false"), "points", "length"))
query("split_polygon", "SELECT n_nationkey, 150.0::DOUBLE AS area FROM nation UNION ALL SELECT n_nationkey, 150.0 FROM nation")(lambda spark, sf: sized(apply(spark, "TransformSplitGeometry", boxes(spark, sf), splitterWkt="LINESTRING(-100 0, 100 0)"), "area"))
query("split_line", "SELECT n_nationkey, unnest([3.0, 7.0])::DOUBLE AS length FROM nation")(lambda spark, sf: sized(apply(spark, "TransformSplitGeometry", lines(spark, sf), splitterWkt="LINESTRING(3 -1, 3 100)"), "length"))
query("dissolve", "SELECT n_regionkey, count(*) * 300.0::DOUBLE AS area FROM nation GROUP BY 1")(lambda spark, sf: sized(apply(spark, "TransformDissolve", boxes(spark, sf), groupBy="n_regionkey"), "area", keep=("n_regionkey",)))
query("dissolve_all", "SELECT (6 * (count(*) - 1) + 7) * 60.0::DOUBLE AS area FROM nation")(lambda spark, sf: sized(apply(spark, "TransformDissolve", boxes(spark, sf, "7")), "area", keep=()))


@query("line_merger", "SELECT count(*) * 2.0::DOUBLE AS length FROM nation GROUP BY n_regionkey")
def line_merger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of segments for each region, in the order of its nations."""
    nation = table(spark, sf_dir, "nation")
    before = nation.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("k")).join(nation.groupBy(F.col("n_regionkey").alias("r")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("all")), "r")
    at = F.array_position("all", F.col("k"))
    p = lambda i: F.concat((i * 2).cast("string"), F.lit(" "), F.col("r").cast("string"))
    df = shapes(before, F.concat(F.lit("LINESTRING("), p(at), F.lit(","), p(at + 1), F.lit(")"))).select("geom")
    return sized(apply(spark, "TransformLineMerger", df), "length", keep=())


@query("validate_geometry", "SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0")
def validate_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    wkt = F.when(F.col("n_nationkey") % 2 == 0, "POLYGON((0 0,4 0,4 4,0 4,0 0))").otherwise("POLYGON((0 0,4 4,4 0,0 4,0 0))")
    return apply(spark, "TransformValidateGeometry", shapes(table(spark, sf_dir, "nation", "n_nationkey"), wkt)).select("n_nationkey")


@query("difference", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 150.0 ELSE 300.0 END::DOUBLE AS area FROM nation")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = boxes(spark, sf_dir).where("n_nationkey % 2 = 0")
    x = F.col("n_nationkey") * 6 - 80
    lower = shapes(half.select("n_nationkey"), F.concat(F.lit("POLYGON(("), x.cast("string"), F.lit(" -30,"), (x + 5).cast("string"), F.lit(" -30,"), (x + 5).cast("string"), F.lit(" 0,"), x.cast("string"), F.lit(" 0,"), x.cast("string"), F.lit(" -30))")))
    return sized(apply(spark, "TransformDifference", boxes(spark, sf_dir), lower, "subtract"), "area")


@query("snap", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE n_nationkey + 0.4 END::DOUBLE AS gx, 0.0::DOUBLE AS gy FROM nation")
def snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    df = shapes(table(spark, sf_dir, "nation", "n_nationkey"), F.concat(F.lit("POINT("), F.when(k % 2 == 0, k + 0.05).otherwise(k + 0.4).cast("string"), F.lit(" 0)")))
    ref = shapes(table(spark, sf_dir, "nation", "n_nationkey"), F.concat(F.lit("POINT("), k.cast("string"), F.lit(" 0)"))).select("geom")
    return xy(apply(spark, "TransformSnapGeometries", df, ref, "reference", tolerance=0.1), "n_nationkey")


_IN_BOX = "x BETWEEN n_nationkey * 6 - 80 AND n_nationkey * 6 - 75 AND y BETWEEN -30 AND 30"
query("spatial_filter", f"SELECT c_custkey FROM {_POINTS} p WHERE EXISTS (SELECT 1 FROM nation WHERE {_IN_BOX})")(lambda spark, sf: apply(spark, "TransformSpatialFilter", points(spark, sf), boxes(spark, sf)).select("c_custkey"))
query("spatial_filter_within", f"SELECT c_custkey FROM {_POINTS} p WHERE EXISTS (SELECT 1 FROM nation WHERE {_IN_BOX})")(lambda spark, sf: apply(spark, "TransformSpatialFilter", points(spark, sf), boxes(spark, sf), predicate="within").select("c_custkey"))
query("spatial_filter_contains", f"SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM {_POINTS} p WHERE {_IN_BOX})")(lambda spark, sf: apply(spark, "TransformSpatialFilter", boxes(spark, sf), points(spark, sf), predicate="contains").select("n_nationkey"))
query("spatial_enrich_left", f"SELECT c_custkey, coalesce(n_nationkey, 0)::INTEGER AS n_nationkey, coalesce(n_name, '') AS n_name FROM {_POINTS} p LEFT JOIN nation ON {_IN_BOX}")(lambda spark, sf: apply(spark, "TransformSpatialEnrich", points(spark, sf), boxes(spark, sf), attributes="n_nationkey,n_name").select("c_custkey", "n_nationkey", "n_name"))
query("spatial_enrich_inner", f"SELECT c_custkey, n_name FROM {_POINTS} p JOIN nation ON {_IN_BOX}")(lambda spark, sf: apply(spark, "TransformSpatialEnrich", points(spark, sf), boxes(spark, sf), attributes="n_name", joinType="inner").select("c_custkey", "n_name"))


# --- connectors ---------------------------------------------------------------------------------------------------------------


query("data_generator", "SELECT range AS id, true AS inside FROM range(100000)")(lambda spark, sf: apply(spark, "SourceDataGenerator", None).select("id", (F.col("longitude").between(6.4, 6.6) & F.col("latitude").between(52.2, 52.4)).alias("inside")))


def round_trip(spark: SparkSession, df: DataFrame, sink: str, source: str, suffix: str, order: str, **params) -> DataFrame:
    """Write with a sink and read with a source, through one file in the shared folder."""
    path = f"{scratch_path(spark, 'trip')}/t.{suffix}"
    t = block_type(sink)
    t.build(BlockContext(spark, sink, {"in": df.withColumn(ORD, F.col(order).cast("long"))}, Settings()), **t.bind({"path": path}))()
    return apply(spark, source, None, path=path, **params)


query("csv_round_trip", "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")(lambda spark, sf: round_trip(spark, table(spark, sf, "supplier"), "SinkCsv", "SourceCsv", "csv", "s_suppkey"))
query("json_round_trip", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")(lambda spark, sf: round_trip(spark, table(spark, sf, "nation"), "SinkJson", "SourceJson", "json", "n_nationkey"))
query("excel_round_trip", "SELECT n_nationkey::INTEGER AS n_nationkey, n_name, n_regionkey::INTEGER AS n_regionkey FROM nation")(lambda spark, sf: apply(spark, "TransformRemoveGeometry", round_trip(spark, table(spark, sf, "nation"), "SinkExcel", "SourceExcel", "xlsx", "n_nationkey")))
query("geojson_round_trip", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, 300.0::DOUBLE AS area FROM nation")(lambda spark, sf: sized(round_trip(spark, boxes(spark, sf), "SinkGeoJson", "SourceGeoJson", "geojson", "n_nationkey"), "area", keep=("n_nationkey", "n_name")))


# --- headline -------------------------------------------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, calculate and aggregate lineitem as one workflow would."""
    kept = apply(spark, "TransformFilter", table(spark, sf_dir, "lineitem"), when="l_quantity >= 10 && l_returnflag != N")
    priced = apply(spark, "TransformCalculator", kept, expression="l_extendedprice * 0.9", outputField="net")
    out = apply(spark, "TransformAggregator", priced, groupBy="l_returnflag,l_linestatus", aggregates="count:*:n;sum:net:net")
    return out.withColumn("net", F.round("net", 2))


query("flagship", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_extendedprice * 0.9::DOUBLE), 2) AS net FROM lineitem WHERE l_quantity >= 10 AND lower(l_returnflag) <> 'n' GROUP BY 1, 2")(flagship)

