import http.server
import json
import os
import sqlite3
import struct
import subprocess
import sys
import threading
from datetime import UTC, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline import queries as q
from weftline.functions.values import ORD, geometry_field
from weftline.geo import functions as g
from weftline.geo import wkb
from weftline.plans.registry import BindError, BlockContext, block, block_type
from weftline import run_queries
from weftline.queries import apply, shapes
from weftline.sinks.modes import WriteMode, write_mode
from weftline.sources.checkpoints import read_token, write_token
from weftline.sources.remote import jdbc_options, resume_query

from .conftest import SF, same_as_sql


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_against_sql(spark, db, name):
    same_as_sql(spark, db, q.QUERIES[name], q.ORACLES[name])


def wkt_frame(spark, rows, columns="id long, w string"):
    return shapes(spark.createDataFrame(rows, columns), F.col("w")).drop("w")


def texts(df):
    f = geometry_field(df.schema).name
    return [r[0] for r in df.select(g.words(F.col(f), "wkt")).collect()]


def test_null_geometries_stay(spark):
    df = wkt_frame(spark, [(1, None), (2, "POINT (1 2)")])
    for kind, params in (("TransformBuffer", {"distance": 1}), ("TransformCentroid", {}), ("TransformAffine", {}), ("TransformReproject", {"sourceCrs": "4326", "targetCrs": "3857"}), ("TransformSplitGeometry", {"splitterWkt": "LINESTRING(0 0,1 1)"}), ("TransformValidateGeometry", {})):
        out = apply(spark, kind, df, **params)
        assert {r.id: r.geom is None for r in out.collect()} == {1: True, 2: False}, kind
        assert geometry_field(out.schema).name == "geom"


def test_reproject_round_trip(spark):
    df = wkt_frame(spark, [(1, "POINT (4.895168 52.370216)")])
    for code in ("3857", "28992", "32631"):
        back = apply(spark, "TransformReproject", apply(spark, "TransformReproject", df, sourceCrs="4326", targetCrs=code), sourceCrs=code, targetCrs="EPSG:4326")
        x, y = back.select(g.measure(F.col("geom"), "x"), g.measure(F.col("geom"), "y")).first()
        assert abs(x - 4.895168) < 1e-6 and abs(y - 52.370216) < 1e-6
    with pytest.raises(ValueError, match="999999"):
        apply(spark, "TransformReproject", df, sourceCrs="4326", targetCrs="EPSG:999999")


def test_split_keeps_area(spark):
    df = wkt_frame(spark, [(42, "POLYGON ((0 0,10 0,10 10,0 10,0 0))")])
    out = apply(spark, "TransformSplitGeometry", df, splitterWkt="LINESTRING (5 -1, 5 11)")
    assert [(r.id, r.a) for r in out.select("id", g.measure(F.col("geom"), "area").alias("a")).collect()] == [(42, 50.0), (42, 50.0)]
    assert apply(spark, "TransformSplitGeometry", df, splitterWkt="LINESTRING (50 0, 51 1)").count() == 1
    both = df.withColumn("by", F.lit("LINESTRING (2 -1, 2 11)"))
    assert apply(spark, "TransformSplitGeometry", both, splitterField="by").count() == 2


def test_spatial_edges(spark):
    pts = wkt_frame(spark, [(i + 1, f"POINT ({i} {i})") for i in range(40)] + [(99, None)])
    box = wkt_frame(spark, [(1, "POLYGON ((10 10,30 10,30 30,10 30,10 10))"), (2, "POLYGON ((10 10,12 10,12 12,10 12,10 10))")])
    assert sorted(r.id for r in apply(spark, "TransformSpatialFilter", pts, box.drop("id")).collect()) == list(range(11, 32))
    assert apply(spark, "TransformSpatialFilter", pts, box.limit(0)).count() == 0
    left = apply(spark, "TransformSpatialEnrich", pts, box.withColumnRenamed("id", "zone").withColumn(ORD, F.col("zone")))
    got = {r.id: r.zone for r in left.collect()}
    assert got[11] == 1 and got[1] == 0 and got[99] == 0 and len(got) == 41
    empty = apply(spark, "TransformSpatialEnrich", pts, box.withColumnRenamed("id", "zone").limit(0))
    assert empty.count() == 41 and "zone" in empty.columns
    assert apply(spark, "TransformSpatialEnrich", pts, box.withColumnRenamed("id", "zone").limit(0), joinType="inner").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        apply(spark, "TransformSpatialEnrich", pts, box)


def test_difference_and_snap_edges(spark):
    df = wkt_frame(spark, [(1, "POLYGON ((0 0,4 0,4 4,0 4,0 0))"), (2, None), (3, "POINT (9 9)")])
    cut = wkt_frame(spark, [(1, "POLYGON ((-1 -1,5 -1,5 5,-1 5,-1 -1))")])
    out = {r.id: r.w for r in apply(spark, "TransformDifference", df, cut, "subtract").select("id", g.words(F.col("geom"), "wkt").alias("w")).collect()}
    assert out == {1: "POLYGON EMPTY", 2: None, 3: "POINT (9 9)"}
    assert texts(apply(spark, "TransformDifference", df, cut.limit(0), "subtract").orderBy("id"))[0].startswith("POLYGON ((0 0")
    assert texts(apply(spark, "TransformSnapGeometries", wkt_frame(spark, [(1, "LINESTRING (0 0, 10 0)")]), wkt_frame(spark, [(1, "POINT (0.0005 0)")]), "reference")) == ["LINESTRING (0.0005 0, 10 0)"]


def test_dissolve_empty_and_types(spark):
    df = wkt_frame(spark, [(1, None)])
    assert apply(spark, "TransformDissolve", df).count() == 0 and apply(spark, "TransformDissolve", df, groupBy="id").count() == 0
    with pytest.raises(ValueError, match="no geometry"):
        apply(spark, "TransformBuffer", spark.range(1), distance=1)


def test_attribute_edges(spark):
    df = wkt_frame(spark, [(1, "POINT (1 2)")]).withColumn("s", F.lit("  x  "))
    assert apply(spark, "TransformStringManipulator", df, field="S", operation="TRIM").first().s == "x"
    assert apply(spark, "TransformStringManipulator", df, field="s", operation="pad").first().s == df.first().s
    assert apply(spark, "TransformStringManipulator", df, field="id", operation="upper").first().id == 1
    assert apply(spark, "TransformCalculator", df, expression="id / 4", outputField="q").first().q == 0.25
    assert geometry_field(apply(spark, "TransformCalculator", df, expression="s + 1", outputField="q").schema) is not None
    mapped = apply(spark, "TransformSchemaMapper", df, fields="geom,id,id", rename="id:a")
    assert mapped.columns == ["geom", "a", "a"] and geometry_field(mapped.schema).name == "geom"
    looked = apply(spark, "TransformValueLookup", df, field="id", mappings="1=7")
    assert looked.first().id == 7 and dict(looked.dtypes)["id"] == "bigint"
    assert apply(spark, "TransformRegexExtractor", df, field="s", pattern="(?<n>X)", outputField="id").first().id == 0
    for kind, params, match in (("TransformCalculator", {"expression": "id ^ 2", "outputField": "x"}, "form"), ("TransformAggregator", {"groupBy": "id", "aggregates": "sum:s"}, "number"), ("TransformAggregator", {"groupBy": "id", "aggregates": "count:*:id"}, "twice"), ("TransformAggregator", {"groupBy": "id", "aggregates": "median:id"}, "unknown"), ("TransformSchemaMapper", {"fields": "zz"}, "zz")):
        with pytest.raises(ValueError, match=match):
            apply(spark, kind, df, **params)


def test_aggregate_empty_and_blank(spark):
    df = spark.createDataFrame([("a", " "), ("a", "x"), ("b", None)], "k string, v string")
    out = {r.k: r.count_v for r in apply(spark, "TransformAggregator", df, groupBy="k", aggregates="count:v").collect()}
    assert out == {"a": 1, "b": 0}
    assert apply(spark, "TransformAggregator", df.limit(0), groupBy=",", aggregates="count:*").count() == 0


def test_dedup_keeps_first_and_geometry(spark):
    df = wkt_frame(spark, [(1, "POINT (1 1)"), (1, "POINT (2 2)"), (2, None)]).coalesce(1).withColumn(ORD, F.monotonically_increasing_id())
    t = block_type("TransformDeduplicateRecords")
    out = t.build(BlockContext(spark, "d", {"in": df}), keyFields="id").orderBy(ORD)
    assert texts(out) == ["POINT (1 1)", None]


def test_binding():
    with pytest.raises(BindError, match="when"):
        block_type("transformfilter").bind({})
    assert block_type("SourceCsv").bind({"PATH": "x", "Delimiter": ";;", "hasHeader": "FALSE"}) == {"path": "x", "delimiter": ";", "hasHeader": False}

    @block("TestDouble")
    def double(ctx: BlockContext, field: str, times: float = 2):
        return ctx.input.withColumn(field, F.col(field) * times)

    assert block_type("TestDouble").bind({"field": "a", "times": "1,000.5"})["times"] == 1000.5


def test_registered_types():
    names = "SourceCsv SourceJson SourceGeoJson SourceGml SourceShapefile SourceGeoPackage SourceExcel SourcePostGresQL SourcePostGis SourceWfs SourceDataGenerator SinkCsv SinkJson SinkGeoJson SinkExcel SinkPostGis SinkWfsT TransformFilter TransformConditionalSplitter TransformCalculator TransformSchemaMapper TransformStringManipulator TransformNullHandler TransformRegexExtractor TransformDateTime TransformValueLookup TransformNoop TransformRemoveGeometry TransformSpatialFilter TransformSpatialEnrich TransformDifference TransformSnapGeometries TransformAggregator TransformDissolve TransformLineMerger TransformDeduplicateRecords TransformCreateGeometry TransformAffine TransformBuffer TransformCentroid TransformEnvelope TransformConvexHull TransformDensify TransformReproject TransformSplitGeometry TransformSimplify TransformRemoveDuplicateVertices TransformValidateGeometry"
    assert len(names.split()) == 48
    for n in names.split():
        block_type(n)


def test_write_modes():
    assert write_mode(None) == WriteMode() and write_mode("BatchCommit") == WriteMode(False, 1) and write_mode("batchcommit(5)").batches == 5 and write_mode("BatchCommit:7").batches == 7
    for bad in ("Sometimes", "BatchCommit(0)"):
        with pytest.raises(ValueError):
            write_mode(bad)


def test_tokens(tmp_path):
    path = str(tmp_path / "t")
    for value in (42, "x", True, 1.5, datetime(2026, 7, 8, 12, tzinfo=UTC)):
        write_token(path, value)
        assert read_token(path) == value and type(read_token(path)) is type(value)
    (tmp_path / "t").write_text("17")
    assert read_token(path) == 17 and read_token(str(tmp_path / "none")) is None


def test_jdbc_texts():
    assert jdbc_options("Host=h;Port=1;Database=d;Username=u;Password=p") == {"url": "jdbc:postgresql://h:1/d", "driver": "org.postgresql.Driver", "user": "u", "password": "p"}
    assert resume_query("SELECT 1;", "id", None) == 'SELECT * FROM (SELECT 1) AS weftline_source ORDER BY "id"'
    assert 'WHERE "id" > 5 ' in resume_query("q", "id", 5) and "> 'a''b'" in resume_query("q", "id", "a'b")
    assert 'WHERE "id" > 5 AND "id" <= 9 ' in resume_query("q", "id", 5, 9)
    with pytest.raises(ValueError):
        resume_query("q", "id; drop", 1)


def test_database_resume_leaves_later_rows(spark, tmp_path):
    """Rows that arrive between reading and the commit are read by the next run."""
    url, token = f"jdbc:derby:memory:late{os.getpid()}", str(tmp_path / "token")
    insert = lambda ids, **o: spark.createDataFrame([(i,) for i in ids], "ID long").write.format("jdbc").options(url=f"{url};create=true", dbtable="T", **o).mode("append").save()
    insert([1, 2, 3])
    t = block_type("SourcePostGresQL")

    def read():
        ctx = BlockContext(spark, "s", {})
        df = t.build(ctx, **t.bind({"connectionString": url, "query": "SELECT * FROM T", "checkpointPath": token, "checkpointColumn": "ID"}))
        return df, ctx

    df, ctx = read()
    insert([4, 5])
    assert sorted(r.ID for r in df.collect()) == [1, 2, 3]
    ctx.after_commit[0]()
    assert read_token(token) == 3
    df, ctx = read()
    assert sorted(r.ID for r in df.collect()) == [4, 5]
    ctx.after_commit[0]()
    df, ctx = read()
    assert df.count() == 0 and not ctx.after_commit and read_token(token) == 5


@pytest.mark.parametrize("name", ["database_resume", "database_source"])
def test_database_is_reached_by_executors(db, tmp_path, name):
    """Executors are processes of their own, so a database within one of them has no table in the others."""
    code = """
import sys
import __spark_entry__ as e
from pyspark.sql import SparkSession
name, sf, out = sys.argv[1:]
conf = {"spark.ui.enabled": "false", "spark.executor.memory": "512m", "spark.checkpoint.dir": f"file://{out}/shared"}
e.queries()[name](SparkSession.builder.master("local-cluster[2,1,512]").config(map=conf).getOrCreate(), sf).write.parquet(f"{out}/rows")
"""
    env = os.environ | {"PYTHONPATH": str(Path(__file__).parent.parent), "PYSPARK_SUBMIT_ARGS": "pyspark-shell"}
    said = subprocess.run([sys.executable, "-c", code, name, SF, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert not said.returncode, said.stderr[-2000:]
    rows = db.sql(f"SELECT * FROM '{tmp_path}/rows/*.parquet'")
    assert sorted(rows.fetchall()) == sorted(db.sql(f"SELECT {', '.join(rows.columns)} FROM ({q.ORACLES[name]})").fetchall())


def test_database_holds_every_text(spark, tmp_path):
    """The files by which the driver loads it keep quotes, line ends, blanks and nulls apart; no row is a table too."""
    words = ['a"b', '""', '"', "x,y", "a\nb", "a\r\nb", "\r", "\\", '\\"', " lead", "trail ", " ", "", None, "NULL", "é😀\u0085", "'", "x" * 40_000, '"\n\n,"']
    numbers = [1e300, 5e-324, 0.1, 1 / 3, 1e7, None]
    rows = [(None if i == 3 else i, (1 << 63) - 1 - i, numbers[i % 6], w) for i, w in enumerate(words)]
    for name, found in (("some", rows), ("none", [])):
        spark.createDataFrame(found, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/{name}/orders.parquet")
        df = spark.read.format("jdbc").options(url=run_queries.database(spark, f"{tmp_path}/{name}"), dbtable="ORDERS").load()
        assert df.columns == ["O_ORDERKEY", "O_CUSTKEY", "O_TOTALPRICE", "O_ORDERPRIORITY"] and sorted((tuple(r) for r in df.collect()), key=repr) == sorted(found, key=repr)


def sink(spark, kind, df, path, **params):
    t = block_type(kind)
    return t.build(BlockContext(spark, kind, {"in": df}), **t.bind({"path": str(path), **params}))()


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "x": {"y": [1, 2]}, "n": 1.50}, 7, {"id": 2, "b": true, "n": null}]')
    df = apply(spark, "SourceJson", None, path=str(tmp_path / "a.json"))
    assert df.columns == ["id", "x", "n", "b"] and [tuple(r) for r in df.collect()] == [(1, '{"y":[1,2]}', 1.5, False), (2, "", 0.0, True)]
    sink(spark, "SinkJson", df, tmp_path / "o.json")
    assert json.loads((tmp_path / "o.json").read_text())[1] == {"id": 2, "n": 0.0, "b": True}
    sink(spark, "SinkJson", df, tmp_path / "o.json", includeNullAndEmpty="true")
    assert json.loads((tmp_path / "o.json").read_text())[1]["x"] is None
    sink(spark, "SinkJson", df.limit(0), tmp_path / "o.json")
    assert json.loads((tmp_path / "o.json").read_text()) == []


def test_geojson_files(spark, tmp_path):
    feature = lambda i, geom: {"type": "Feature", "properties": {"id": i, "name": "" if i == 2 else "a"}, "geometry": geom}
    shapes_ = [{"type": "Point", "coordinates": [4, 52]}, {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}, None]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(i + 1, s) for i, s in enumerate(shapes_)]}))
    df = apply(spark, "SourceGeoJson", None, path=str(tmp_path / "a.geojson"))
    assert df.columns == ["id", "name", "geom"] and texts(df) == ["POINT (4 52)", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", None]
    sink(spark, "SinkGeoJson", df, tmp_path / "o.geojson")
    out = json.loads((tmp_path / "o.geojson").read_text())["features"]
    assert out[0]["geometry"] == shapes_[0] and out[1]["properties"] == {"id": 2} and out[2]["geometry"] is None
    sink(spark, "SinkGeoJson", df, tmp_path / "o.geojson", includeNullAndEmptyProperties="true")
    assert json.loads((tmp_path / "o.geojson").read_text())["features"][1]["properties"] == {"id": 2, "name": None}
    with pytest.raises(ValueError, match="geometry"):
        sink(spark, "SinkGeoJson", spark.range(1), tmp_path / "x")


GML = """<c xmlns:gml="http://www.opengis.net/gml"><gml:featureMember><r><name>a</name><size>3</size><shape><gml:Point srsName="EPSG:4326"><gml:pos>5 52</gml:pos></gml:Point></shape></r></gml:featureMember>
<gml:featureMembers><r><name>b</name><size>4</size><shape><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>0 0 4 0 4 4 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></shape></r>
<r><name>c</name><shape><gml:MultiPoint><gml:pointMember><gml:Point><gml:coordinates>1,2</gml:coordinates></gml:Point></gml:pointMember></gml:MultiPoint></shape></r></gml:featureMembers></c>"""


def test_gml_and_wfs(spark, tmp_path):
    (tmp_path / "a.gml").write_text(GML)
    df = apply(spark, "SourceGml", None, path=str(tmp_path / "a.gml"))
    assert df.columns == ["name", "size", "geom"] and dict(df.dtypes)["size"] == "int" and texts(df) == ["POINT (5 52)", "POLYGON ((0 0, 4 0, 4 4, 0 0))", "POINT (1 2)"]
    posted = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            as_json = self.path == "/json"
            body = (json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"k": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}) if as_json else GML).encode()
            self.send_response(200)
            self.send_header("Content-Type", "application/json" if as_json else "text/xml")
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):  # noqa: N802
            posted.append(self.rfile.read(int(self.headers["Content-Length"])).decode())
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"<ok/>")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        assert texts(apply(spark, "SourceWfs", None, url=f"{base}/json")) == ["POINT (1 2)"]
        found = apply(spark, "SourceWfs", None, url=f"{base}/gml")
        assert found.count() == 3
        t = block_type("SinkWfsT")
        assert t.build(BlockContext(spark, "w", {"in": found}), **t.bind({"url": base, "featureType": "road"}))() == 3
        assert len(posted) == 1 and posted[0].count("<wfs:Insert>") == 3 and "<f:name>a</f:name>" in posted[0] and "<gml:pos>5 52</gml:pos>" in posted[0].replace("5.0", "5").replace("52.0", "52")
        assert t.build(BlockContext(spark, "w", {"in": found}), **t.bind({"url": base, "writeMode": "BatchCommit(1)"}))() == 3
    finally:
        server.shutdown()


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE gpkg_contents(table_name TEXT, data_type TEXT); CREATE TABLE gpkg_geometry_columns(table_name TEXT, column_name TEXT, srs_id INT); CREATE TABLE features(id INTEGER, name TEXT, w REAL, shape BLOB); INSERT INTO gpkg_contents VALUES('features','features'); INSERT INTO gpkg_geometry_columns VALUES('features','shape',28992);")
    raw = wkb.point(4.9, 52.3)
    header = b"GP\0" + bytes([0b00000011]) + struct.pack("<i", 28992) + struct.pack("<4d", 4.9, 4.9, 52.3, 52.3)
    db.executemany("INSERT INTO features VALUES(?,?,?,?)", [(1, "a", 1.5, raw), (2, None, None, header + raw), (3, "c", 2, None)])
    db.commit()
    db.close()
    df = apply(spark, "SourceGeoPackage", None, path=path)
    assert [(r.id, r.name, r.w) for r in df.collect()] == [(1, "a", 1.5), (2, "", 0.0), (3, "c", 2.0)] and texts(df) == ["POINT (4.9 52.3)", "POINT (4.9 52.3)", None]
    assert df.schema["geom"].metadata["srid"] == 28992
    with pytest.raises(ValueError, match="nope"):
        apply(spark, "SourceGeoPackage", None, path=path, table="nope")


def test_shapefile(spark, tmp_path):
    square = [(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (9.0, 0.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]
    area = struct.pack("<i4d2i2i", 5, 0, 0, 9, 9, 2, 9, 0, 5) + b"".join(struct.pack("<2d", *p) for p in square + hole)
    records = [area, struct.pack("<i", 0), area]
    shp, shx, at = b"", b"", 50
    for i, r in enumerate(records):
        shx += struct.pack(">2i", at, len(r) // 2)
        shp += struct.pack(">2i", i + 1, len(r) // 2) + r
        at += 4 + len(r) // 2
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + shp)
    (tmp_path / "a.shx").write_bytes(b"\0" * 100 + shx)
    field = lambda n, k, size, d: n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([size, d]) + b"\0" * 14
    fields = field("NAME", "C", 5, 0) + field("N", "N", 4, 0) + field("X", "N", 6, 2) + field("OK", "L", 1, 0)
    rows = [b" " + "é".encode("cp1252").ljust(5) + b"   7" + b"  1.50" + b"T", b"*" + b"gone " + b"   8" + b"  2.50" + b"F", b" " + b"last " + b"    " + b"  3.00" + b"F"]
    (tmp_path / "a.dbf").write_bytes(struct.pack("<4BIHH", 3, 0, 0, 0, 3, 32 + len(fields) + 1, 17) + b"\0" * 20 + fields + b"\r" + b"".join(rows))
    df = apply(spark, "SourceShapefile", None, path=str(tmp_path / "a.shp"))
    assert [(r.NAME, r.N, r.X, r.OK) for r in df.collect()] == [("é", 7, 1.5, True), ("last", 0, 3.0, False)]
    assert df.select(g.measure(F.col("geom"), "area")).first()[0] == 80.5


def test_excel_wkt(spark, tmp_path):
    df = spark.createDataFrame([(7, "POINT (5.1 52.1)"), (8, "")], "id long, geom string")
    sink(spark, "SinkExcel", df, tmp_path / "a.xlsx")
    out = apply(spark, "SourceExcel", None, path=str(tmp_path / "a.xlsx"), sheetName="sheet1")
    assert out.columns == ["id", "geom"] and texts(out) == ["POINT (5.1 52.1)", None]
    with pytest.raises(ValueError, match="other"):
        apply(spark, "SourceExcel", None, path=str(tmp_path / "a.xlsx"), sheetName="other")


def test_streaming(spark, tmp_path):
    from weftline.streaming import StreamPipeline

    rows = [(i, f"2026-01-01 00:{i % 60:02d}:00", i % 3) for i in range(60)] + [(0, "2026-01-01 00:00:00", 0)]
    spark.createDataFrame(rows, "id long, at string, k int").select("id", F.to_timestamp("at").alias("at"), "k").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, at timestamp, k int").parquet(str(tmp_path / "in"))
    pipe = StreamPipeline(stream).then("TransformFilter", when="id < 30").watermark("at", "2 hours").deduplicate("id")
    pipe.to_sink("SinkCsv", str(tmp_path / "cp"), path=str(tmp_path / "out-{batch}.csv")).awaitTermination()
    assert len((tmp_path / "out-0.csv").read_text().splitlines()) == 31
    agg = StreamPipeline(stream).watermark("at", "1 minute").aggregate("k", "count:*:n;sum:id:s", window="10 minutes", time_field="at")
    query = agg.df.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == 61
    with pytest.raises(ValueError):
        StreamPipeline(stream).then("TransformAggregator", groupBy="k", aggregates="count:*")


def test_json_folder(spark, tmp_path):
    """Several documents: fields of all, types that fit all values."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('[{"id": 1, "v": "1"}, {"id": 2}]')
    (tmp_path / "in" / "b.json").write_text('[{"id": 3, "v": "x", "w": true}]')
    df = apply(spark, "SourceJson", None, path=str(tmp_path / "in"))
    assert df.dtypes == [("id", "bigint"), ("v", "string"), ("w", "boolean")]
    assert sorted(tuple(r) for r in df.collect()) == [(1, "1", False), (2, "", False), (3, "x", True)]
    (tmp_path / "none.json").write_text("[]")
    assert apply(spark, "SourceJson", None, path=str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="array"):
        apply(spark, "SourceJson", None, path=str(tmp_path / "bad.json"))


def test_scratch_tables_go(spark):
    import os

    from weftline.functions.scratch import materialize, release

    df = materialize(spark.range(3), "t")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 3 and os.path.exists(path)
    release(spark)
    assert not os.path.exists(path)
