"""Geometry as column expressions: they stay inside whole-stage code and can be pushed around by the optimizer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingmill.functions.cover import within  # noqa: F401  point in polygon, over adaptive covers of the areas

EARTH_KM = 6371.0
POINT = "struct<lon:double,lat:double>"


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance; the sine's argument is held to 1, so antipodes are no NaN."""
    d_lat, d_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(d_lat) * F.sin(d_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(d_lon) * F.sin(d_lon)
    root = F.sqrt(a)  # least() would turn a null into 1
    return F.lit(2 * EARTH_KM) * F.asin(F.when(root > 1, F.lit(1.0)).otherwise(root))


def in_box(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.element_at(ring, ((i + 1) % n + 1).cast("int")).alias("b")))


def on_edge(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether the point lies on an edge or a corner of the ring."""

    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])
        near = lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))
        return (cross == 0) & near

    return F.exists(_edges(ring), touches)


def _crossings(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule: how many edges of the ring (array of lon/lat, open or closed) a ray to the east crosses."""
    crossed = F.filter(
        _edges(ring),
        lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat))
        & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / F.nullif(e["b"]["lat"] - e["a"]["lat"], F.lit(0.0)) + e["a"]["lon"]),
    )
    return F.size(crossed)


def inside(lon: Column, lat: Column, ring: Column) -> Column:
    """Strictly inside the ring: points on its edges and corners are outside."""
    return (_crossings(lon, lat, ring) % 2 == 1) & ~on_edge(lon, lat, ring)


def inside_area(lon: Column, lat: Column, ring: Column, holes: Column | None = None) -> Column:
    """Strictly inside the ring and outside all holes (array of rings), whose edges count as holes."""
    found = inside(lon, lat, ring)
    if holes is None:
        return found
    return found & ~F.exists(F.coalesce(holes, F.array()), lambda h: (_crossings(lon, lat, h) % 2 == 1) | on_edge(lon, lat, h))


def clip(areas: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Areas whose bounding box meets the given one."""
    edge = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    return areas.filter((edge(F.array_max, "lon") >= west) & (edge(F.array_min, "lon") <= east) & (edge(F.array_max, "lat") >= south) & (edge(F.array_min, "lat") <= north))


def _thin(points: list, tolerance: float) -> list:
    """Keeps the ends of a line and, again and again, the point farthest from its chord while that is over the tolerance."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        (ax, ay), (bx, by) = points[a], points[b]
        length = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5

        def away(k, ax=ax, ay=ay, bx=bx, by=by, length=length):
            x, y = points[k]
            return abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / length if length else ((x - ax) ** 2 + (y - ay) ** 2) ** 0.5

        far = max(range(a + 1, b), key=away)
        if away(far) > tolerance:
            keep.add(far)
            todo += [(a, far), (far, b)]
    return [points[k] for k in sorted(keep)]


def simplify(ring: Column, tolerance: float = 0.0008) -> Column:
    """Fewer vertices, none of the dropped ones farther than the tolerance from what is left; a ring that would collapse stays whole.

    Python loops over the vertices of each ring, in Arrow batches: for outlines of areas, of which there are few.
    """

    @F.pandas_udf(f"array<{POINT}>")
    def run(rings: pd.Series) -> pd.Series:
        def one(r):
            if r is None:
                return None
            pts = [(p["lon"], p["lat"]) for p in r]
            half = len(pts) // 2
            done = _thin(pts[: half + 1], tolerance)[:-1] + _thin(pts[half:], tolerance) if len(pts) > 4 else pts
            return [{"lon": x, "lat": y} for x, y in (done if len(done) >= 4 else pts)]

        return rings.map(one)

    return run(ring)


def register(spark: SparkSession) -> None:
    """haversine_km for SQL text, as an expression that the optimizer sees through."""
    root = "sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE) RETURNS DOUBLE RETURN "
        f"2 * {EARTH_KM}D * asin(CASE WHEN {root} > 1 THEN 1D ELSE {root} END)"
    )
