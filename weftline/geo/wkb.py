"""WKB written on the driver or in readers: from GeoJSON, GML and shapefile records."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET

CODES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}
#: GML elements that are geometries.
GML_TYPES = frozenset("Point LineString Polygon MultiPoint MultiLineString MultiPolygon MultiCurve MultiSurface Curve Surface".split())

Ring = list[tuple[float, float]]


def _ring(cs: Ring) -> bytes:
    return struct.pack("<I", len(cs)) + b"".join(struct.pack("<dd", *c) for c in cs)


def point(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, x, y)


def line(cs: Ring) -> bytes:
    return struct.pack("<BI", 1, 2) + _ring(cs)


def polygon(rings: list[Ring]) -> bytes:
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(map(_ring, rings))


def multi(code: int, parts: list[bytes]) -> bytes:
    return struct.pack("<BII", 1, code, len(parts)) + b"".join(parts)


def _pair(c) -> tuple[float, float]:
    return float(c[0]), float(c[1])


def from_geojson(shape: dict) -> bytes:
    """Two dimensions of one of the six simple types."""
    kind, cs = shape.get("type"), shape.get("coordinates")
    if kind not in CODES or not isinstance(cs, list):
        raise ValueError(f"geometry type '{kind}' is not supported")
    if kind == "Point":
        return point(*_pair(cs))
    if kind == "LineString":
        return line([_pair(x) for x in cs])
    if kind == "Polygon":
        return polygon([[_pair(x) for x in ring] for ring in cs])
    single = kind[5:]
    return multi(CODES[kind], [from_geojson({"type": single, "coordinates": x}) for x in cs])


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _numbers(text: str | None) -> list[float]:
    return [float(x) for x in (text or "").replace(",", " ").split()]


def _coordinates(e: ET.Element) -> Ring:
    """posList, else pos elements, else coordinates; x and y as written."""
    for x in e.iter():
        if _name(x) == "posList":
            size = int(x.attrib.get("srsDimension", e.attrib.get("srsDimension", "2")))
            n = _numbers(x.text)
            return [(n[i], n[i + 1]) for i in range(0, len(n) - 1, size)]
    if at := [_numbers(x.text) for x in e.iter() if _name(x) == "pos"]:
        return [(n[0], n[1]) for n in at]
    for x in e.iter():
        if _name(x) == "coordinates":
            return [_pair(t.split(x.attrib.get("cs", ","))) for t in (x.text or "").split(x.attrib.get("ts"))]
    return []


def _rings(e: ET.Element) -> list[Ring]:
    shells = [_coordinates(x) for x in e.iter() if _name(x) in ("exterior", "outerBoundaryIs")]
    return shells[:1] + [_coordinates(x) for x in e.iter() if _name(x) in ("interior", "innerBoundaryIs")]


def from_gml(e: ET.Element) -> bytes | None:
    """A geometry element; a multi geometry of one member is that member."""
    kind = _name(e)
    if kind == "Point":
        cs = _coordinates(e)
        return point(*cs[0]) if cs else None
    if kind in ("LineString", "Curve"):
        cs = _coordinates(e)
        return line(cs) if cs else None
    if kind in ("Polygon", "Surface"):
        rings = [r for r in _rings(e) if r]
        return polygon(rings) if rings else None
    single = {"MultiPoint": ("Point",), "MultiLineString": ("LineString", "Curve"), "MultiCurve": ("LineString", "Curve")}.get(kind, ("Polygon", "Surface"))
    parts = [p for x in e.iter() if _name(x) in single and (p := from_gml(x))]
    if len(parts) < 2:
        return parts[0] if parts else None
    return multi({"Point": 4, "LineString": 5, "Polygon": 6}[single[0]], parts)


def _area(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def _covers(ring: Ring, p: tuple[float, float]) -> bool:
    """Inside or on the ring."""
    inside, (x, y) = False, p
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def from_shape(record: bytes) -> bytes | None:
    """A shapefile record's content in two dimensions. Clockwise rings are shells; a hole goes to the shell around its first vertex."""
    if len(record) < 4:
        return None
    kind = struct.unpack("<i", record[:4])[0] % 10
    if kind == 1:
        return point(*struct.unpack("<dd", record[4:20]))
    if kind == 8:
        n = struct.unpack("<i", record[36:40])[0]
        parts = [point(*struct.unpack_from("<dd", record, 40 + 16 * i)) for i in range(n)]
        return multi(4, parts)
    if kind not in (3, 5):
        return None
    n_parts, n = struct.unpack("<ii", record[36:44])
    starts = [*struct.unpack_from(f"<{n_parts}i", record, 44), n]
    at = 44 + 4 * n_parts
    cs = [struct.unpack_from("<dd", record, at + 16 * i) for i in range(n)]
    pieces = [cs[a:b] for a, b in zip(starts, starts[1:]) if b > a]
    if not pieces:
        return None
    if kind == 3:
        return line(pieces[0]) if len(pieces) == 1 else multi(5, [line(p) for p in pieces])
    shells = [[r] for r in pieces if _area(r) <= 0] or [[pieces[0]]]
    for hole in (r for r in pieces if _area(r) > 0 and not any(r is s[0] for s in shells)):
        owner = next((s for s in shells if _covers(s[0], hole[0])), None)
        (owner if owner is not None else shells.append([hole]) or shells[-1]).extend([hole] if owner is not None else [])
    return polygon(shells[0]) if len(shells) == 1 else multi(6, [polygon(s) for s in shells])
