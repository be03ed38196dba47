"""Registered queries of file formats, checkpoints and whole workflow runs, beside SQL that gives the same rows.

Each writes a small file of the driver's tables into the shared folder and reads it with the block. Rows that the driver
writes are those of `nation` and `region`, 25 and 5 whatever the scale.
"""

from __future__ import annotations

import glob
import http.server
import json
import os
import sqlite3
import struct
import threading
import zipfile
from datetime import UTC, date, datetime
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scratch import scratch_path
from weftline.functions.values import ORD
from weftline.geo import functions as g
from weftline.geo import wkb
from weftline.plans.planner import check
from weftline.plans.registry import BlockContext, block_type
from weftline.plans.runner import run_workflow
from weftline.plans.workflow import Settings, WorkflowError, parse_workflow
from weftline.queries import _POINTS, apply, points, query, simple, table
from weftline.sinks.modes import write_mode
from weftline.sources.checkpoints import read_token, write_token
from weftline.streaming import StreamPipeline

#: SQL of the place that the written files give each nation.
_PLACED = "n_nationkey::BIGINT AS key, n_name AS name, (n_nationkey + 0.5)::DOUBLE AS gx, (50 - n_nationkey)::DOUBLE AS gy FROM nation"


def folder(spark: SparkSession) -> str:
    path = scratch_path(spark, "files").removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    return path


def nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, str, float, float]]:
    return [(r.n_nationkey, r.n_name, r.n_nationkey + 0.5, 50.0 - r.n_nationkey) for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]


def put(path: str, data: str | bytes) -> str:
    with open(path, "wb") as f:
        f.write(data.encode() if isinstance(data, str) else data)
    return path


def placed(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("long").alias("key"), "name", g.measure(F.col("geom"), "x").alias("gx"), g.measure(F.col("geom"), "y").alias("gy"))


def gml(rows: list[tuple[int, str, float, float]]) -> str:
    one = '<gml:featureMember><r><key>{}</key><name>{}</name><shape><gml:Point srsName="EPSG:4326"><gml:pos>{} {}</gml:pos></gml:Point></shape></r></gml:featureMember>'
    return '<c xmlns:gml="http://www.opengis.net/gml">' + "".join(one.format(*r) for r in rows) + "</c>"


def served(found: dict[str, str], posted: list[str]) -> str:
    """The address of a server on this machine that gives texts by path and keeps what is posted."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            self.answer(found[self.path.split("?")[0]])

        def do_POST(self) -> None:
            posted.append(self.rfile.read(int(self.headers["Content-Length"])).decode())
            self.answer("<ok/>")

        def answer(self, text: str) -> None:
            self.send_response(200)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *args) -> None:
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://127.0.0.1:{server.server_address[1]}"


# --- formats ------------------------------------------------------------------------------------------------------------


@query("gml_source", f"SELECT {_PLACED}")
def gml_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(apply(spark, "SourceGml", None, path=put(f"{folder(spark)}/a.gml", gml(nations(spark, sf_dir)))))


@query("wfs_source", f"SELECT {_PLACED}")
def wfs_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(apply(spark, "SourceWfs", None, url=served({"/gml": gml(nations(spark, sf_dir))}, []) + "/gml"))


@query("wfs_sink", "SELECT 25::BIGINT AS inserted, 'true' AS complete")
def wfs_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, posted = nations(spark, sf_dir), []
    base = served({"/gml": gml(rows)}, posted)
    t = block_type("SinkWfsT")
    t.build(BlockContext(spark, "w", {"in": apply(spark, "SourceWfs", None, url=f"{base}/gml")}, Settings()), **t.bind({"url": base}))()
    text = "".join(posted)
    return spark.createDataFrame([(text.count("<wfs:Insert>"), str(all(f">{r[1]}<" in text for r in rows)).lower())], "inserted long, complete string")


@query("geopackage_source", f"SELECT {_PLACED}")
def geopackage_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/a.gpkg"
    db = sqlite3.connect(path)
    db.executescript(
        "CREATE TABLE gpkg_contents(table_name TEXT, data_type TEXT); CREATE TABLE gpkg_geometry_columns(table_name TEXT, column_name TEXT, srs_id INT);"
        "CREATE TABLE features(key INTEGER, name TEXT, shape BLOB); INSERT INTO gpkg_contents VALUES('features', 'features');"
        "INSERT INTO gpkg_geometry_columns VALUES('features', 'shape', 4326);"
    )
    header = b"GP\0" + bytes([1]) + struct.pack("<i", 4326)
    db.executemany("INSERT INTO features VALUES(?, ?, ?)", [(k, n, header + wkb.point(x, y)) for k, n, x, y in nations(spark, sf_dir)])
    db.commit()
    db.close()
    return placed(apply(spark, "SourceGeoPackage", None, path=path))


@query("shapefile_source", f"SELECT {_PLACED}")
def shapefile_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, base = nations(spark, sf_dir), folder(spark)
    records = [struct.pack("<i2d", 1, x, y) for _, _, x, y in rows]
    places = [50 + i * (4 + len(records[0]) // 2) for i in range(len(records))]
    put(f"{base}/a.shx", b"\0" * 100 + b"".join(struct.pack(">2i", at, len(r) // 2) for at, r in zip(places, records, strict=True)))
    put(f"{base}/a.shp", b"\0" * 100 + b"".join(struct.pack(">2i", i + 1, len(r) // 2) + r for i, r in enumerate(records)))

    def named(name: str, kind: str, size: int) -> bytes:
        return name.encode().ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([size, 0]) + b"\0" * 14

    fields = named("key", "N", 6) + named("name", "C", 30)
    cells = b"".join(b" " + str(k).rjust(6).encode() + n.encode().ljust(30) for k, n, *_ in rows)
    put(f"{base}/a.dbf", struct.pack("<4BIHH", 3, 0, 0, 0, len(rows), 32 + len(fields) + 1, 37) + b"\0" * 20 + fields + b"\r" + cells)
    return placed(apply(spark, "SourceShapefile", None, path=f"{base}/a.shp"))


def database(spark: SparkSession, sf_dir: str) -> str:
    """Orders in a database that is one read-only file of the shared folder, so each executor opens it in its own process.

    The driver loads it from text files that executors write, a file at a time, so no table is held in memory."""
    base, texts = folder(spark), scratch_path(spark, "texts")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    orders = orders.select(*[F.col(c).alias(c.upper()) for c in orders.columns])
    cells = [F.coalesce(F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")) for c in orders.columns]
    orders.select(F.concat_ws(",", *cells)).write.text(texts)
    url, connect = f"jdbc:derby:{base}/db", spark._jvm.java.sql.DriverManager.getConnection
    # no partition, so no task: Spark only makes the table, with its own types
    spark.createDataFrame(spark.sparkContext.emptyRDD(), orders.schema).write.format("jdbc").options(url=f"{url};create=true", dbtable="ORDERS").save()
    db = connect(url)
    load = db.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'ORDERS', ?, ',', '\"', 'UTF-8', 0)")
    for part in sorted(glob.glob(f"{texts.removeprefix('file://')}/part-*")):
        load.setString(1, part)
        load.execute()
        os.remove(part)
    db.close()
    try:
        connect(f"{url};shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # what a database says when it has been shut down
            raise
    with zipfile.ZipFile(f"{base}/db.jar", "w") as jar:  # stored, so that a page is read by its place
        for path in sorted(p for p in glob.glob(f"{base}/db/**", recursive=True) if os.path.isfile(p)):
            jar.write(path, os.path.relpath(path, base))
            os.remove(path)
    return f"jdbc:derby:jar:({base}/db.jar)db"


def lowered(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(c.lower()) for c in df.columns])


@query("database_source", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def database_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table read by ranges of its key."""
    return lowered(apply(spark, "SourcePostGresQL", None, connectionString=database(spark, sf_dir), query="SELECT * FROM ORDERS", partitionColumn="O_ORDERKEY", numPartitions=4))


@query("database_resume", "SELECT o_orderkey, o_totalprice, (SELECT max(o_orderkey) FROM orders)::VARCHAR AS token FROM orders WHERE o_orderkey > 1000")
def database_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after the token of a run before; the token is then the last key that was read."""
    path, params = put(f"{folder(spark)}/token", "1000"), {"checkpointColumn": "O_ORDERKEY", "query": "SELECT O_ORDERKEY, O_TOTALPRICE FROM ORDERS;"}
    t = block_type("SourcePostGresQL")
    ctx = BlockContext(spark, "s", {}, Settings())
    out = t.build(ctx, **t.bind({"connectionString": database(spark, sf_dir), "checkpointPath": path, **params}))
    for f in ctx.after_commit:
        f()
    return lowered(out.drop(ORD)).withColumn("token", F.lit(str(read_token(path))))


# --- checkpoints ------------------------------------------------------------------------------------------------------------


@query("csv_resume", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_nationkey >= 10")
def csv_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows were taken by a run before."""
    base = folder(spark)
    src = put(f"{base}/n.csv", "n_nationkey,n_name\n" + "".join(f"{k},{n}\n" for k, n, *_ in nations(spark, sf_dir)))
    return apply(spark, "SourceCsv", None, path=src, checkpointPath=put(f"{base}/token", "10"))


@query(
    "typed_tokens",
    "SELECT * FROM (VALUES ('long', '42'), ('datetimeoffset', '2026-07-08T12:00:00+00:00'), ('date', '2026-07-08'), ('decimal', '1.50'), ('bool', 'True'), ('string', 'x y'), ('double', '0.25')) t(kind, value)",
)
def typed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = [42, datetime(2026, 7, 8, 12, tzinfo=UTC), date(2026, 7, 8), Decimal("1.50"), True, "x y", 0.25]
    path, out = f"{folder(spark)}/token", []
    for v in values:
        write_token(path, v)
        with open(path) as f:
            kind = json.load(f)["Type"]
        back = read_token(path)
        out.append((kind, back.isoformat() if isinstance(back, date) else str(back)))
    return spark.createDataFrame(out, "kind string, value string")


@query("write_modes", "SELECT * FROM (VALUES ('BatchCommit', 1::BIGINT), ('batchcommit(5)', 5), ('BatchCommit:7', 7)) t(mode, batches)")
def write_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(m, write_mode(m).batches) for m in ("BatchCommit", "batchcommit(5)", "BatchCommit:7")], "mode string, batches long")


# --- runs ----------------------------------------------------------------------------------------------------------------------


def _source(path: str, name: str = "s") -> str:
    return f'  - {{id: {name}, type: SourceCsv, params: {{path: "{path}"}}}}\n'


@query("run_stop_branch", "SELECT 'errors' AS sink, 'bad' AS line UNION ALL SELECT 'healthy', r_regionkey || ',' || r_name FROM region UNION ALL SELECT 'healthy', 'id,name'")
def run_stop_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch that fails is rolled back and logged; the other is written whole."""
    base = folder(spark)
    put(f"{base}/b.csv", "id,name\n" + "".join(f"{r.r_regionkey},{r.r_name}\n" for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()))
    text = f'version: "1"\nname: t\nsettings: {{errorLog: "{base}/errors.ndjson"}}\nnodes:\n' + _source(f"{base}/b.csv") + _source(f"{base}/b.csv", "a")
    text += '  - {id: bad, type: TransformCalculator, errorPolicy: StopBranch, inputs: {in: a}, params: {expression: "missing + 1", outputField: x}}\nsinks:\n'
    text += "".join(f'  - {{id: {k}, type: SinkCsv, inputs: {{in: {n}}}, params: {{path: "{base}/{k}.csv"}}}}\n' for k, n in (("broken", "bad"), ("healthy", "s")))
    run_workflow(spark, parse_workflow(text))
    lines = [("broken", "there")] if os.path.exists(f"{base}/broken.csv") else []
    with open(f"{base}/healthy.csv") as f:
        lines += [("healthy", x) for x in f.read().splitlines()]
    with open(f"{base}/errors.ndjson") as f:
        lines += [("errors", json.loads(x)["NodeId"]) for x in f]
    return spark.createDataFrame(lines, "sink string, line string")


@query(
    "run_fan_out",
    "SELECT CASE WHEN n_nationkey < 5 THEN 'low' WHEN n_nationkey >= 20 THEN 'high' ELSE 'out' END AS port, count(*)::BIGINT AS counted, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1",
)
def run_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sink for each port of a splitter; counted are the rows that the run reports."""
    base, ports = folder(spark), ("low", "high", "out")
    put(f"{base}/n.csv", "id,name\n" + "".join(f"{k},{n}\n" for k, n, *_ in nations(spark, sf_dir)))
    text = 'version: "1"\nname: t\nnodes:\n' + _source(f"{base}/n.csv")
    text += '  - {id: c, type: TransformConditionalSplitter, inputs: {in: s}, params: {branches: "low:id < 5;high:id >= 20"}}\nsinks:\n'
    text += "".join(f'  - {{id: {p}, type: SinkCsv, inputs: {{in: "c:{p}"}}, params: {{path: "{base}/{p}.csv", includeHeader: "false"}}}}\n' for p in ports)
    result = run_workflow(spark, parse_workflow(text))
    out = []
    for p in ports:
        with open(f"{base}/{p}.csv") as f:
            out.append((p, result.sinks[p].rows, ",".join(x.split(",")[1] for x in f.read().splitlines())))
    return spark.createDataFrame(out, "port string, counted long, names string")


@query("run_checks", "SELECT * FROM (VALUES ('cycle', 'cycle'), ('no input', 'nope'), ('no type', 'Nope')) t(fault, told)")
def run_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a graph are told before any work starts."""
    top, end = 'version: "1"\nname: t\nnodes:\n' + _source("x"), "sinks:\n  - {id: k, type: SinkCsv, inputs: {in: f}, params: {path: y}}\n"
    filtered = '  - {{id: f, type: {}, inputs: {{in: {}}}, params: {{when: "id > 1"}}}}\n'
    loop = filtered.format("TransformFilter", "g") + "  - {id: g, type: TransformNoop, inputs: {in: f}}\n"
    faults = [("cycle", "cycle", loop), ("no input", "nope", filtered.format("TransformFilter", "nope")), ("no type", "Nope", filtered.format("Nope", "s"))]
    out = []
    for fault, word, nodes in faults:
        try:
            check(parse_workflow(top + nodes + end))
            said = "nothing"
        except WorkflowError as e:
            said = word if word in str(e) else str(e)
        out.append((fault, said))
    return spark.createDataFrame(out, "fault string, told string")


@query(
    "streaming_aggregate",
    "SELECT event_type, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1",
)
def streaming_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed groups of a stream; over all windows they are those of the batch."""
    path = scratch_path(spark, "stream")
    table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("event_id long, event_type string, ts timestamp").parquet(f"{path}/in")
    windows = StreamPipeline(stream).watermark("ts", "1 day").aggregate("event_type", "count:*:n;sum:event_id:ids", window="1 day", time_field="ts")
    name = "windows_" + path.rsplit("-", 1)[1]
    run = windows.df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    run.start().awaitTermination()
    return spark.table(name).groupBy("event_type").agg(F.sum("n").cast("long").alias("n"), F.sum("ids").cast("long").alias("ids"))


# --- transforms ------------------------------------------------------------------------------------------------------------------

simple("calculator_add", "lineitem", "l_orderkey l_linenumber l_quantity", "TransformCalculator", "SELECT l_orderkey, l_linenumber, l_quantity, l_quantity + 2.5::DOUBLE AS more FROM lineitem", expression="l_quantity + 2.5", outputField="more")
simple("calculator_subtract", "lineitem", "l_orderkey l_linenumber l_quantity", "TransformCalculator", "SELECT l_orderkey, l_linenumber, l_quantity, l_quantity - 2.5::DOUBLE AS less FROM lineitem", expression="l_quantity - 2.5", outputField="less")


def there_and_back(code: str, x: float, y: float):
    """Points near a system's origin, into it and back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        near = apply(spark, "TransformAffine", points(spark, sf_dir), m00=0.01, m02=x, m11=0.01, m12=y)
        there = apply(spark, "TransformReproject", near, sourceCrs="EPSG:4326", targetCrs=code)
        back = apply(spark, "TransformReproject", there, sourceCrs=code, targetCrs="EPSG:4326")
        return back.select("c_custkey", F.round(g.measure(F.col("geom"), "x"), 5).alias("gx"), F.round(g.measure(F.col("geom"), "y"), 5).alias("gy"))

    query(f"reproject_{code[5:]}", f"SELECT c_custkey, round(0.01 * x + {x}, 5)::DOUBLE AS gx, round(0.01 * y + {y}, 5)::DOUBLE AS gy FROM {_POINTS}")(run)


there_and_back("EPSG:28992", 5.4, 52.1)
there_and_back("EPSG:32631", 3.2, 51.3)
