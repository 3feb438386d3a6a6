"""Shapes from files: areas of GeoJSON, points and areas of GeoParquet (well-known binary)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingmill.functions.geo import POINT

AREA = f"struct<ring:array<{POINT}>,holes:array<array<{POINT}>>>"
_GEOJSON = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def _area(rings: Column) -> Column:
    """(ring, holes) of an array of rings of [lon, lat] pairs; the first ring is the outline."""
    named = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    return F.struct(named[0].alias("ring"), F.slice(named, 2, F.greatest(F.size(named) - 1, F.lit(0))).alias("holes"))


def read_geojson(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """name, ring, holes of the polygons in FeatureCollection files; a MultiPolygon has a row for each part, other shapes none."""
    rows = spark.read.schema(_GEOJSON).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    shape, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one = F.array(_area(F.from_json(text, "array<array<array<double>>>")))
    many = F.transform(F.from_json(text, "array<array<array<array<double>>>>"), _area)
    parts = F.when(shape == "Polygon", one).when(shape == "MultiPolygon", many)
    return rows.select(F.col("f.properties")[name].alias(name), F.explode(parts).alias("p")).select(name, "p.ring", "p.holes")


def _rings(data: bytes) -> list | None:
    """(ring, holes) of each polygon of a binary shape, by its own byte order; None for shapes without an area."""

    def shape(at: int) -> tuple[list, int]:
        order = "<" if data[at] else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5 + (4 if kind & 0x20000000 else 0)  # an SRID may follow
        wide = 2 + bool(kind & 0x80000000 or 1000 <= kind & 0xFFFF < 2000) + bool(kind & 0x40000000 or 2000 <= kind & 0xFFFF < 3000) + 2 * (kind & 0xFFFF >= 3000)
        kind = (kind & 0xFFFF) % 1000
        if kind not in (3, 6):
            raise ValueError(kind)
        (n,), at, out = struct.unpack_from(order + "I", data, at), at + 4, []
        for _ in range(n):
            if kind == 6:
                part, at = shape(at)
                out += part
                continue
            (k,), at = struct.unpack_from(order + "I", data, at), at + 4
            flat = np.frombuffer(data, order + "f8", k * wide, at).reshape(k, wide)
            out.append([{"lon": float(x), "lat": float(y)} for x, y in flat[:, :2]])
            at += 8 * k * wide
        return (out, at) if kind == 6 else ([{"ring": out[0], "holes": out[1:]}] if out else [], at)

    try:
        return shape(0)[0]
    except ValueError:
        return None


def wkb_areas(shape: Column) -> Column:
    """Array of (ring, holes) of a binary polygon or multipolygon; null for other shapes."""

    @F.pandas_udf(f"array<{AREA}>")
    def run(shapes: pd.Series) -> pd.Series:
        return shapes.map(lambda b: None if b is None else _rings(bytes(b)))

    return run(shape)


def wkb_point(shape: Column) -> Column:
    """(lon, lat) of a binary point; null for other shapes and empty points."""

    @F.pandas_udf(POINT)
    def run(shapes: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in shapes:
            out = np.full((len(batch), 2), np.nan)
            for order, flag in (("<", 1), (">", 0)):
                # kind 1 is a point; the upper half tells of more coordinates and an SRID, which come after or before the two
                mine = np.array([b is not None and len(b) >= 21 and b[0] == flag and b[1 if flag else 4] == 1 and not b[2 if flag else 3] for b in batch], bool)
                if mine.any():
                    skip = [9 if b[4 if flag else 1] & 0x20 else 5 for b in batch[mine]]
                    out[mine] = np.frombuffer(b"".join(bytes(b[k : k + 16]) for b, k in zip(batch[mine], skip, strict=True)), order + "f8").reshape(-1, 2)
            frame = pd.DataFrame(out, columns=["lon", "lat"]).astype(object)
            yield frame.where(~np.isnan(out), None)

    return run(shape)


def read_geoparquet(spark: SparkSession, paths: str | list[str], geometry: str = "geometry", areas: bool = False) -> DataFrame:
    """The table with its geometry as (lon, lat), or with `areas` a row for each polygon with ring and holes in its place."""
    rows = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    if not areas:
        return rows.withColumn(geometry, wkb_point(F.col(geometry)))
    rest = [F.col(c) for c in rows.columns if c != geometry]
    return rows.select(*rest, F.explode(wkb_areas(F.col(geometry))).alias("_area")).select(*rest, "_area.ring", "_area.holes")
