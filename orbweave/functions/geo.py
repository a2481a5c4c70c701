"""Spherical geometry as Catalyst expressions.

Geometries are ``struct<lng,lat>`` points in degrees inside rings
(``array<array<struct>>``); radians and unit vectors exist only inside
expressions.  Distances are metres on a sphere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in metres; one constant for all distances.
EARTH_RADIUS = 6_371_008.8
POINT = "struct<lng:double,lat:double>"
RINGS = f"array<array<{POINT}>>"


def haversine_m(lng1, lat1, lng2, lat2, radius: float = EARTH_RADIUS) -> Column:
    """Great-circle distance of two points in metres."""
    lng1, lat1, lng2, lat2 = (F.col(x) if isinstance(x, str) else x for x in (lng1, lat1, lng2, lat2))
    a = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    b = F.sin((F.radians(lng2) - F.radians(lng1)) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def haversine_sql(lng1: str, lat1: str, lng2: str, lat2: str, radius: float = EARTH_RADIUS) -> str:
    """The same in ANSI SQL, for oracles."""
    a, b = f"sin((radians({lat2}) - radians({lat1})) / 2)", f"sin((radians({lng2}) - radians({lng1})) / 2)"
    return f"({2 * radius} * asin(least(1.0, sqrt({a} * {a} + cos(radians({lat1})) * cos(radians({lat2})) * {b} * {b}))))"


def unit_vector(lng: Column, lat: Column) -> list[Column]:
    """(x, y, z) on the unit sphere."""
    return [F.cos(F.radians(lat)) * F.cos(F.radians(lng)), F.cos(F.radians(lat)) * F.sin(F.radians(lng)), F.sin(F.radians(lat))]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def segment_m(lng: Column, lat: Column, a: Column, b: Column, radius: float = EARTH_RADIUS) -> Column:
    """Distance from a point to a great-circle segment.

    Inside the segment's lune it is the distance to its great circle, else to
    the nearer end; a segment without length is its end.
    """
    p, va, vb = unit_vector(lng, lat), unit_vector(a["lng"], a["lat"]), unit_vector(b["lng"], b["lat"])
    n = _cross(va, vb)
    within = (_dot(_cross(n, va), p) >= 0) & (_dot(_cross(vb, n), p) >= 0) & (_dot(n, n) > 0)
    c = _cross(n, p)
    arc = F.lit(radius) * F.atan2(F.abs(_dot(n, p)), F.sqrt(_dot(c, c)))
    ends = F.least(haversine_m(lng, lat, a["lng"], a["lat"], radius), haversine_m(lng, lat, b["lng"], b["lat"], radius))
    return F.when(within, arc).otherwise(ends)


def segments(ring: Column) -> Column:
    """Consecutive vertex pairs ``struct<a,b>`` of a ring or line."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.coalesce(F.get(ring, i), F.get(ring, i - 1)).alias("b")))


def segment_columns(a: Column, b: Column) -> dict[str, Column]:
    """What ``segment_pair_m`` needs of a segment, computed once for each."""
    va, vb = unit_vector(a["lng"], a["lat"]), unit_vector(b["lng"], b["lat"])
    n = _cross(va, vb)
    out = {f"{name}{c}": x for name, v in (("n", n), ("u", _cross(n, va)), ("w", _cross(vb, n))) for c, x in zip("xyz", v)}
    for name, end in (("a", a), ("b", b)):
        out |= {f"{name}_lng": end["lng"], f"{name}_lat": end["lat"], f"{name}_rlng": F.radians(end["lng"]), f"{name}_rlat": F.radians(end["lat"]), f"{name}_cos": F.cos(F.radians(end["lat"]))}
    return out


def point_columns(lng: Column, lat: Column) -> dict[str, Column]:
    """What the pair distances need of a query point."""
    return {"q_rlng": F.radians(lng), "q_rlat": F.radians(lat), "q_cos": F.cos(F.radians(lat))} | {f"p{c}": x for c, x in zip("xyz", unit_vector(lng, lat))}


def pair_haversine_m(end: str = "a", radius: float = EARTH_RADIUS) -> Column:
    """``haversine_m`` of a query point and a segment's end, from their columns."""
    a = F.sin((F.col(f"{end}_rlat") - F.col("q_rlat")) / 2)
    b = F.sin((F.col(f"{end}_rlng") - F.col("q_rlng")) / 2)
    h = a * a + F.col("q_cos") * F.col(f"{end}_cos") * b * b
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def segment_pair_m(radius: float = EARTH_RADIUS) -> Column:
    """``segment_m`` of a query point and a segment, from their columns."""
    v = lambda name: [F.col(f"{name}{c}") for c in "xyz"]
    p, n = v("p"), v("n")
    within = (_dot(v("u"), p) >= 0) & (_dot(v("w"), p) >= 0) & (_dot(n, n) > 0)
    c = _cross(n, p)
    arc = F.lit(radius) * F.atan2(F.abs(_dot(n, p)), F.sqrt(_dot(c, c)))
    return F.when(within, arc).otherwise(F.least(pair_haversine_m("a", radius), pair_haversine_m("b", radius)))


def crossing(lng: Column, lat: Column) -> Column:
    """1 if the segment's columns cross the parallel east of the point."""
    spans = (F.col("a_lat") > lat) != (F.col("b_lat") > lat)
    at = (F.col("b_lng") - F.col("a_lng")) * (lat - F.col("a_lat")) / (F.col("b_lat") - F.col("a_lat")) + F.col("a_lng")
    return F.when(spans & (lng < at), 1).otherwise(0)


def closed(ring: Column) -> Column:
    """The ring with its first vertex at the end."""
    return F.when(F.get(ring, F.lit(0)) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def inside(lng: Column, lat: Column, rings: Column) -> Column:
    """Even-odd rule over all rings, so holes are outside."""

    def crossed(s: Column) -> Column:
        a, b = s["a"], s["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lng"] - a["lng"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lng"]
        return F.when(spans, F.when(lng < at, 1).otherwise(0)).otherwise(0)

    counts = F.transform(rings, lambda r: F.aggregate(segments(closed(r)), F.lit(0), lambda n, s: n + crossed(s)))
    return F.aggregate(counts, F.lit(0), lambda n, c: n + c) % 2 == 1


def part_m(kind: Column, rings: Column, lng: Column, lat: Column, radius: float = EARTH_RADIUS, points_only: bool = False) -> Column:
    """Distance from a point to a part; 0 inside a polygon."""
    first = F.get(F.get(rings, F.lit(0)), F.lit(0))
    point = haversine_m(lng, lat, first["lng"], first["lat"], radius)
    if points_only:
        return point
    least = lambda close: F.array_min(F.transform(rings, lambda r: F.array_min(F.transform(segments(closed(r) if close else r), lambda s: segment_m(lng, lat, s["a"], s["b"], radius)))))
    return F.when(kind == "Point", point).when(kind == "LineString", least(False)).when(inside(lng, lat, rings), F.lit(0.0)).otherwise(least(True))


def bounds(rings: Column) -> Column:
    """``struct<west,south,east,north>`` of a part."""
    flat = F.flatten(rings)
    pick = lambda f, c: f(F.transform(flat, lambda p: p[c]))
    return F.struct(pick(F.array_min, "lng").alias("west"), pick(F.array_min, "lat").alias("south"), pick(F.array_max, "lng").alias("east"), pick(F.array_max, "lat").alias("north"))


def as_point(lng: Column, lat: Column) -> Column:
    return F.struct(lng.cast("double").alias("lng"), lat.cast("double").alias("lat"))


def point_rings(lng: Column, lat: Column) -> Column:
    return F.array(F.array(as_point(lng, lat)))


def number(text: Column) -> Column:
    """A decimal number as the whole text, else null (no trimming, no suffix)."""
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), text.try_cast("double"))
