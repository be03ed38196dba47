"""JVM functions over WKB.

One Java source is compiled by the compiler that Spark itself ships, packed into a jar and added to the session, so
geometry work stays in executors' JVMs without Python. Geometries travel as WKB in binary columns; a null stays null.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKAGE = "weftline_geo"

_HEAD = """
package weftline_geo;
import org.locationtech.jts.geom.*;
import org.locationtech.jts.geom.util.*;
import org.locationtech.jts.io.*;
import org.locationtech.jts.operation.buffer.BufferOp;
import org.locationtech.jts.operation.linemerge.LineMerger;
import org.locationtech.jts.operation.overlay.snap.GeometrySnapper;
import org.locationtech.jts.operation.polygonize.Polygonizer;
import org.locationtech.jts.operation.union.UnaryUnionOp;
import org.locationtech.jts.operation.valid.IsValidOp;
import org.locationtech.jts.simplify.*;
import org.locationtech.jts.densify.Densifier;
import org.locationtech.jts.linearref.LengthIndexedLine;
import java.util.*;
import org.apache.spark.sql.api.java.*;
import org.apache.spark.sql.Encoder;
import org.apache.spark.sql.Encoders;
import org.apache.spark.sql.expressions.Aggregator;
"""

#: Each entry becomes a class of its own; the number is that of its arguments.
_CLASSES = {
    "Wkb": """
public class Wkb {
  public static final GeometryFactory FACTORY = new GeometryFactory();
  public static Geometry read(Object bytes) throws Exception { return new WKBReader(FACTORY).read((byte[]) bytes); }
  public static byte[] write(Geometry g) {
    if (g == null) return null;
    Coordinate[] cs = g.getCoordinates();
    boolean z = cs.length > 0;
    for (int i = 0; i < cs.length && z; i++) z = !Double.isNaN(cs[i].getZ());
    return new WKBWriter(z ? 3 : 2).write(g);
  }
}""",
    "Make": """
public class Make implements UDF2 {
  public Object call(Object x, Object y) throws Exception {
    if (x == null || y == null) return null;
    return Wkb.write(Wkb.FACTORY.createPoint(new Coordinate(((Double) x).doubleValue(), ((Double) y).doubleValue())));
  }
}""",
    "Unary": """
public class Unary implements UDF4 {
  public Object call(Object bytes, Object op, Object a, Object b) throws Exception {
    if (bytes == null) return null;
    Geometry g = Wkb.read(bytes);
    String name = (String) op;
    double x = ((Double) a).doubleValue();
    Geometry out;
    if (name.equals("buffer")) out = BufferOp.bufferOp(g, x);
    else if (name.equals("centroid")) out = g.getCentroid();
    else if (name.equals("envelope")) out = g.getEnvelope();
    else if (name.equals("hull")) out = g.convexHull();
    else if (name.equals("densify")) out = Densifier.densify(g, x);
    else if (name.equals("simplify")) out = ((Double) b).doubleValue() != 0 ? TopologyPreservingSimplifier.simplify(g, x) : DouglasPeuckerSimplifier.simplify(g, x);
    else if (name.equals("distinct_vertices")) out = distinct(g);
    else throw new IllegalArgumentException("unknown geometry function " + name);
    return Wkb.write(out);
  }
  private static Geometry distinct(Geometry g) {
    if (g instanceof LineString && !(g instanceof LinearRing)) return Wkb.FACTORY.createLineString(line(g.getCoordinates(), 2));
    if (!(g instanceof Polygon)) return g;
    Polygon p = (Polygon) g;
    LinearRing[] holes = new LinearRing[p.getNumInteriorRing()];
    for (int i = 0; i < holes.length; i++) holes[i] = Wkb.FACTORY.createLinearRing(line(p.getInteriorRingN(i).getCoordinates(), 4));
    return Wkb.FACTORY.createPolygon(Wkb.FACTORY.createLinearRing(line(p.getExteriorRing().getCoordinates(), 4)), holes);
  }
  private static Coordinate[] line(Coordinate[] cs, int least) {
    ArrayList kept = new ArrayList();
    for (int i = 0; i < cs.length; i++) if (i == 0 || !cs[i].equals2D(cs[i - 1])) kept.add(cs[i]);
    if (kept.size() < least) return cs;
    return (Coordinate[]) kept.toArray(new Coordinate[0]);
  }
}""",
    "Affine": """
public class Affine implements UDF7 {
  public Object call(Object bytes, Object a, Object b, Object c, Object d, Object e, Object f) throws Exception {
    if (bytes == null) return null;
    AffineTransformation t = new AffineTransformation(n(a), n(b), n(c), n(d), n(e), n(f));
    return Wkb.write(t.transform(Wkb.read(bytes)));
  }
  private static double n(Object x) { return ((Double) x).doubleValue(); }
}""",
    "Binary": """
public class Binary implements UDF3 {
  public Object call(Object a, Object b, Object op) throws Exception {
    if (a == null) return null;
    if (b == null) return a;
    if (((String) op).equals("difference")) return Wkb.write(Wkb.read(a).difference(Wkb.read(b)));
    if (((String) op).equals("intersection")) return Wkb.write(Wkb.read(a).intersection(Wkb.read(b)));
    return Wkb.write(Wkb.read(a).union(Wkb.read(b)));
  }
}""",
    "Related": """
public class Related implements UDF3 {
  public Object call(Object a, Object b, Object op) throws Exception {
    if (a == null || b == null) return Boolean.FALSE;
    Geometry g = Wkb.read(a), h = Wkb.read(b);
    String name = (String) op;
    if (name.equals("contains")) return Boolean.valueOf(g.contains(h));
    if (name.equals("within")) return Boolean.valueOf(g.within(h));
    return Boolean.valueOf(g.intersects(h));
  }
}""",
    "Snap": """
public class Snap implements UDF3 {
  public Object call(Object bytes, Object refs, Object tolerance) throws Exception {
    if (bytes == null || refs == null) return bytes;
    Geometry g = Wkb.read(bytes);
    scala.collection.Iterator it = ((scala.collection.Iterable) refs).iterator();
    while (it.hasNext()) {
      Object r = it.next();
      if (r != null) g = GeometrySnapper.snap(g, Wkb.read(r), ((Double) tolerance).doubleValue())[0];
    }
    return Wkb.write(g);
  }
}""",
    "Split": """
public class Split implements UDF2 {
  public Object call(Object bytes, Object by) throws Exception {
    if (bytes == null) return new byte[][] { null };
    if (by == null) return new byte[][] { (byte[]) bytes };
    Geometry g = Wkb.read(bytes), s = Wkb.read(by);
    ArrayList out = new ArrayList();
    if (g.isEmpty() || s.isEmpty() || !g.getEnvelopeInternal().intersects(s.getEnvelopeInternal())) out.add(g);
    else if (g instanceof Polygon || g instanceof MultiPolygon) areas(g, s, out);
    else if (g instanceof LineString || g instanceof MultiLineString) for (int i = 0; i < g.getNumGeometries(); i++) lines((LineString) g.getGeometryN(i), s, out);
    else out.add(g);
    if (out.isEmpty()) out.add(g);
    byte[][] w = new byte[out.size()][];
    for (int i = 0; i < w.length; i++) w[i] = Wkb.write((Geometry) out.get(i));
    return w;
  }
  private static void areas(Geometry g, Geometry s, ArrayList out) {
    Geometry cut = s.getDimension() == 2 ? s.getBoundary() : s;
    Polygonizer p = new Polygonizer();
    p.add(g.getBoundary().union(cut));
    Iterator it = p.getPolygons().iterator();
    while (it.hasNext()) {
      Geometry piece = (Geometry) it.next();
      if (piece.getArea() > 0 && g.covers(piece.getInteriorPoint())) out.add(piece);
    }
  }
  private static void lines(LineString g, Geometry s, ArrayList out) {
    Geometry cut = s.getDimension() == 2 ? s.getBoundary() : s;
    Coordinate[] met = g.intersection(cut).getCoordinates();
    LengthIndexedLine index = new LengthIndexedLine(g);
    TreeSet at = new TreeSet();
    for (int i = 0; i < met.length; i++) at.add(Double.valueOf(index.project(met[i])));
    double from = 0, end = g.getLength();
    Iterator it = at.iterator();
    while (it.hasNext()) {
      double d = ((Double) it.next()).doubleValue();
      if (d > from + 1e-9 && d < end - 1e-9) { out.add(index.extractLine(from, d)); from = d; }
    }
    if (end > from + 1e-9) out.add(index.extractLine(from, end));
  }
}""",
    "Measure": """
public class Measure implements UDF2 {
  public Object call(Object bytes, Object op) throws Exception {
    if (bytes == null) return null;
    Geometry g = Wkb.read(bytes);
    String name = (String) op;
    Envelope e = g.getEnvelopeInternal();
    double out;
    if (name.equals("area")) out = g.getArea();
    else if (name.equals("length")) out = g.getLength();
    else if (name.equals("points")) out = g.getNumPoints();
    else if (name.equals("parts")) out = g.getNumGeometries();
    else if (name.equals("valid")) out = new IsValidOp(g).isValid() ? 1 : 0;
    else if (g.isEmpty()) return null;
    else if (name.equals("minx")) out = e.getMinX();
    else if (name.equals("miny")) out = e.getMinY();
    else if (name.equals("maxx")) out = e.getMaxX();
    else if (name.equals("maxy")) out = e.getMaxY();
    else if (name.equals("x")) out = g.getCoordinate().getX();
    else if (name.equals("y")) out = g.getCoordinate().getY();
    else throw new IllegalArgumentException("unknown measure " + name);
    return Double.valueOf(out);
  }
}""",
    "Bounds": """
public class Bounds implements UDF1 {
  public Object call(Object bytes) throws Exception {
    if (bytes == null) return null;
    Geometry g = Wkb.read(bytes);
    if (g.isEmpty()) return null;
    Envelope e = g.getEnvelopeInternal();
    return new Double[] { Double.valueOf(e.getMinX()), Double.valueOf(e.getMinY()), Double.valueOf(e.getMaxX()), Double.valueOf(e.getMaxY()) };
  }
}""",
    "Words": """
public class Words implements UDF2 {
  public Object call(Object bytes, Object op) throws Exception {
    if (bytes == null) return null;
    Geometry g = Wkb.read(bytes);
    String name = (String) op;
    if (name.equals("type")) return g.getGeometryType();
    if (name.equals("invalid")) { IsValidOp v = new IsValidOp(g); return v.isValid() ? null : v.getValidationError().getMessage(); }
    if (name.equals("wkt")) return new WKTWriter().write(g);
    StringBuffer b = new StringBuffer();
    json(g, b);
    return b.toString();
  }
  private static void json(Geometry g, StringBuffer b) {
    b.append("{\\"type\\":\\"").append(g.getGeometryType()).append("\\",");
    if (g.getClass() == GeometryCollection.class) {
      b.append("\\"geometries\\":[");
      for (int i = 0; i < g.getNumGeometries(); i++) { if (i > 0) b.append(','); json(g.getGeometryN(i), b); }
    } else {
      b.append("\\"coordinates\\":");
      coordinates(g, b);
      b.append('}');
      return;
    }
    b.append("]}");
  }
  private static void coordinates(Geometry g, StringBuffer b) {
    if (g instanceof Point) { if (g.isEmpty()) b.append("[]"); else one(g.getCoordinate(), b); }
    else if (g instanceof LineString) all(g.getCoordinates(), b);
    else if (g instanceof Polygon) {
      Polygon p = (Polygon) g;
      b.append('[');
      if (!p.isEmpty()) all(p.getExteriorRing().getCoordinates(), b);
      for (int i = 0; i < p.getNumInteriorRing(); i++) { b.append(','); all(p.getInteriorRingN(i).getCoordinates(), b); }
      b.append(']');
    } else {
      b.append('[');
      for (int i = 0; i < g.getNumGeometries(); i++) { if (i > 0) b.append(','); coordinates(g.getGeometryN(i), b); }
      b.append(']');
    }
  }
  private static void all(Coordinate[] cs, StringBuffer b) {
    b.append('[');
    for (int i = 0; i < cs.length; i++) { if (i > 0) b.append(','); one(cs[i], b); }
    b.append(']');
  }
  private static void one(Coordinate c, StringBuffer b) {
    b.append('[').append(number(c.getX())).append(',').append(number(c.getY()));
    if (!Double.isNaN(c.getZ())) b.append(',').append(number(c.getZ()));
    b.append(']');
  }
  private static String number(double d) {
    return d == Math.rint(d) && Math.abs(d) < 1e15 ? Long.toString((long) d) : Double.toString(d);
  }
}""",
    "Ends": """
public class Ends implements UDF1 {
  public Object call(Object bytes) throws Exception {
    if (bytes == null) return null;
    Geometry g = Wkb.read(bytes);
    ArrayList out = new ArrayList();
    for (int i = 0; i < g.getNumGeometries(); i++) {
      Geometry part = g.getGeometryN(i);
      if (!(part instanceof LineString) || part.isEmpty()) continue;
      LineString l = (LineString) part;
      out.add(key(l.getCoordinateN(0)));
      out.add(key(l.getCoordinateN(l.getNumPoints() - 1)));
    }
    return (String[]) out.toArray(new String[0]);
  }
  private static String key(Coordinate c) { return (c.getX() + 0.0) + " " + (c.getY() + 0.0); }
}""",
    "Parse": """
public class Parse implements UDF1 {
  public Object call(Object text) throws Exception {
    if (text == null) return null;
    try { return Wkb.write(new WKTReader(Wkb.FACTORY).read((String) text)); } catch (ParseException e) { return null; } catch (IllegalArgumentException e) { return null; }
  }
}""",
    "Project": """
public class Project implements UDF3 {
  public Object call(Object bytes, Object from, Object to) throws Exception {
    if (bytes == null) return null;
    final int a = ((Integer) from).intValue(), b = ((Integer) to).intValue();
    Geometry g = Wkb.read(bytes);
    g.apply(new Mover(a, b));
    g.geometryChanged();
    return Wkb.write(g);
  }
}""",
    "Mover": """
public class Mover implements CoordinateFilter {
  private final int from, to;
  public Mover(int from, int to) { this.from = from; this.to = to; }
  public void filter(Coordinate c) {
    if (from == to) return;
    double[] lonlat = inverse(from, c.getX(), c.getY());
    double[] xy = forward(to, lonlat[0], lonlat[1]);
    c.setX(xy[0]);
    c.setY(xy[1]);
  }
  static final double R = 6378137.0, F = 1 / 298.257223563, E2 = F * (2 - F), K0 = 0.9996;
  static boolean utm(int code) { return code > 32600 && code <= 32660 || code > 32700 && code <= 32760; }
  static double[] forward(int code, double lon, double lat) {
    if (code == 4326) return new double[] { lon, lat };
    if (code == 3857) return new double[] { R * Math.toRadians(lon), R * Math.log(Math.tan(Math.PI / 4 + Math.toRadians(lat) / 2)) };
    if (code == 28992) return rd(lon, lat);
    return transverse(code, lon, lat);
  }
  static double[] inverse(int code, double x, double y) {
    if (code == 4326) return new double[] { x, y };
    if (code == 3857) return new double[] { Math.toDegrees(x / R), Math.toDegrees(2 * Math.atan(Math.exp(y / R)) - Math.PI / 2) };
    // forward is smooth: Newton steps from the middle of the zone
    double lon = code == 28992 ? 5.38763888888889 : (code % 100) * 6 - 183, lat = code == 28992 ? 52.15616055555555 : 0;
    if (code != 28992) lat = (code > 32700 ? y - 1e7 : y) / 110574.0;
    for (int i = 0; i < 30; i++) {
      double h = 1e-6;
      double[] p = forward(code, lon, lat), px = forward(code, lon + h, lat), py = forward(code, lon, lat + h);
      double a = (px[0] - p[0]) / h, b = (py[0] - p[0]) / h, c = (px[1] - p[1]) / h, d = (py[1] - p[1]) / h;
      double dx = x - p[0], dy = y - p[1], det = a * d - b * c;
      double sl = (d * dx - b * dy) / det, sp = (a * dy - c * dx) / det;
      lon += sl;
      lat += sp;
      if (Math.abs(sl) + Math.abs(sp) < 1e-13) break;
    }
    return new double[] { lon, lat };
  }
  static double[] transverse(int code, double lon, double lat) {
    // Krueger's series to the sixth power of the third flattening
    double n = F / (2 - F), n2 = n * n, n3 = n2 * n, n4 = n3 * n;
    double A = R / (1 + n) * (1 + n2 / 4 + n4 / 64);
    double[] al = { n / 2 - 2 * n2 / 3 + 5 * n3 / 16 + 41 * n4 / 180, 13 * n2 / 48 - 3 * n3 / 5 + 557 * n4 / 1440, 61 * n3 / 240 - 103 * n4 / 140, 49561 * n4 / 161280 };
    double phi = Math.toRadians(lat), lam = Math.toRadians(lon - ((code % 100) * 6 - 183));
    double s = Math.sin(phi), q = 2 * Math.sqrt(n) / (1 + n);
    double t = Math.sinh(atanh(s) - q * atanh(q * s));
    double xi = Math.atan2(t, Math.cos(lam)), eta = atanh(Math.sin(lam) / Math.sqrt(1 + t * t));
    double e = eta, k = xi;
    for (int j = 1; j <= 4; j++) {
      e += al[j - 1] * Math.cos(2 * j * xi) * Math.sinh(2 * j * eta);
      k += al[j - 1] * Math.sin(2 * j * xi) * Math.cosh(2 * j * eta);
    }
    return new double[] { 500000 + K0 * A * e, (code > 32700 ? 1e7 : 0) + K0 * A * k };
  }
  static double atanh(double x) { return 0.5 * Math.log((1 + x) / (1 - x)); }
  // Fixed values: the published polynomial between WGS 84 and the Dutch grid around Amersfoort.
  static final double[][] RX = { { 0, 1, 190094.945 }, { 1, 1, -11832.228 }, { 2, 1, -114.221 }, { 0, 3, -32.391 }, { 1, 0, -0.705 }, { 3, 1, -2.340 }, { 1, 3, -0.608 }, { 0, 2, -0.008 }, { 2, 3, 0.148 } };
  static final double[][] RY = { { 1, 0, 309056.544 }, { 0, 2, 3638.893 }, { 2, 0, 73.077 }, { 1, 2, -157.984 }, { 3, 0, 59.788 }, { 0, 1, 0.433 }, { 2, 2, -6.439 }, { 1, 1, -0.032 }, { 0, 4, 0.092 }, { 1, 4, -0.054 } };
  static double[] rd(double lon, double lat) {
    double p = 0.36 * (lat - 52.15517440), l = 0.36 * (lon - 5.38720621), x = 155000, y = 463000;
    for (int i = 0; i < RX.length; i++) x += RX[i][2] * Math.pow(p, RX[i][0]) * Math.pow(l, RX[i][1]);
    for (int i = 0; i < RY.length; i++) y += RY[i][2] * Math.pow(p, RY[i][0]) * Math.pow(l, RY[i][1]);
    return new double[] { x, y };
  }
}""",
    "Held": """
public class Held implements java.io.Serializable {
  public ArrayList wkb = new ArrayList();
}""",
    "UnionAll": """
public class UnionAll extends Aggregator {
  public Object zero() { return new Held(); }
  public Object reduce(Object b, Object a) { if (a != null) { ((Held) b).wkb.add(a); if (((Held) b).wkb.size() >= 256) shrink((Held) b); } return b; }
  public Object merge(Object a, Object b) { ((Held) a).wkb.addAll(((Held) b).wkb); if (((Held) a).wkb.size() >= 256) shrink((Held) a); return a; }
  public Object finish(Object b) { if (((Held) b).wkb.isEmpty()) return null; shrink((Held) b); return ((Held) b).wkb.get(0); }
  private static void shrink(Held b) {
    try {
      ArrayList all = new ArrayList();
      for (int i = 0; i < b.wkb.size(); i++) all.add(Wkb.read(b.wkb.get(i)));
      Geometry g = UnaryUnionOp.union(all);
      b.wkb = new ArrayList();
      if (g != null) b.wkb.add(Wkb.write(g));
    } catch (Exception e) { throw new RuntimeException(e); }
  }
  public Encoder bufferEncoder() { return Encoders.javaSerialization(Held.class); }
  public Encoder outputEncoder() { return Encoders.BINARY(); }
}""",
    "MergeLines": """
public class MergeLines implements UDF1 {
  public Object call(Object many) throws Exception {
    if (many == null) return null;
    LineMerger m = new LineMerger();
    scala.collection.Iterator it = ((scala.collection.Iterable) many).iterator();
    while (it.hasNext()) { Object o = it.next(); if (o != null) m.add(Wkb.read(o)); }
    ArrayList out = new ArrayList(m.getMergedLineStrings());
    byte[][] w = new byte[out.size()][];
    for (int i = 0; i < w.length; i++) w[i] = Wkb.write((Geometry) out.get(i));
    return w;
  }
}""",
}

_WKB, _TEXT, _NUMBER = T.BinaryType(), T.StringType(), T.DoubleType()
_FUNCTIONS = {
    "Make": _WKB, "Unary": _WKB, "Affine": _WKB, "Binary": _WKB, "Related": T.BooleanType(), "Snap": _WKB, "Split": T.ArrayType(_WKB), "Measure": _NUMBER,
    "Bounds": T.ArrayType(_NUMBER), "Ends": T.ArrayType(_TEXT), "Words": _TEXT, "Parse": _WKB, "Project": _WKB, "MergeLines": T.ArrayType(_WKB),
}


def install(spark: SparkSession) -> None:
    """Compile and register the functions, once a session."""
    jvm, session = spark._jvm, spark._jsparkSession
    if session.catalog().functionExists("weftline_measure"):
        return
    loader = jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader()
    try:
        loader.loadClass(f"{PACKAGE}.Wkb")
    except Exception:  # noqa: BLE001 - not added yet
        spark._jsparkSession.sql(f"ADD JAR '{_jar(jvm, loader)}'")
        loader = jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader()
    for name, kind in _FUNCTIONS.items():
        made = loader.loadClass(f"{PACKAGE}.{name}").getDeclaredConstructor(spark.sparkContext._gateway.new_array(jvm.java.lang.Class, 0)).newInstance(spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 0))
        session.udf().register(f"weftline_{name.lower()}", made, jvm.org.apache.spark.sql.types.DataType.fromJson(kind.json()))
    union = loader.loadClass(f"{PACKAGE}.UnionAll").getDeclaredConstructor(spark.sparkContext._gateway.new_array(jvm.java.lang.Class, 0)).newInstance(spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 0))
    session.udf().register("weftline_unionall", jvm.org.apache.spark.sql.functions.udaf(union, jvm.org.apache.spark.sql.Encoders.BINARY()))


def _jar(jvm, loader) -> str:
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(loader)
    compiler.setTargetVersion(8)
    compiler.cook(_HEAD + "\n".join(_CLASSES.values()))
    path = os.path.join(tempfile.mkdtemp(prefix="weftline-jar-"), "weftline-geo.jar")
    with zipfile.ZipFile(path, "w") as out:
        for entry in compiler.getBytecodes().entrySet():
            out.writestr(entry.getKey().replace(".", "/") + ".class", bytes(entry.getValue()))
    return path


def call(name: str, *args: Column) -> Column:
    install(SparkSession.getActiveSession())
    return F.call_function(f"weftline_{name}", *args)


def point(x: Column, y: Column) -> Column:
    return call("make", x.cast("double"), y.cast("double"))


def unary(g: Column, op: str, a: float = 0.0, b: float = 0.0) -> Column:
    return call("unary", g, F.lit(op), F.lit(float(a)), F.lit(float(b)))


def measure(g: Column, op: str) -> Column:
    return call("measure", g, F.lit(op))


def words(g: Column, op: str) -> Column:
    return call("words", g, F.lit(op))


def from_wkt(text: Column) -> Column:
    return call("parse", text)


def related(a: Column, b: Column, op: str) -> Column:
    return call("related", a, b, F.lit(op))


def union_all(g: Column) -> Column:
    return call("unionall", g)
