"""Cell indexes: every operator takes cells as a string column, whichever index made them.

`Square` names cells g<column>_<row> of a grid in degrees; `Hexagon` names cells x<q>_<r> of a planar hexagon grid in degrees
(axial coordinates, pointy tops). Both are native expressions, and both give a cell's centre and outline from its name alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pair(cell: Column) -> tuple[Column, Column]:
    parts = F.split(F.substring(cell, 2, 64), "_")
    return parts[0].try_cast("long"), parts[1].try_cast("long")


@dataclass(frozen=True)
class Square:
    degrees: float = 0.05

    def cell(self, lon: Column, lat: Column) -> Column:
        at = lambda c: F.floor(c / F.lit(self.degrees)).cast("long")
        return F.concat(F.lit("g"), at(lon).cast("string"), F.lit("_"), at(lat).cast("string"))

    def centre(self, cell: Column) -> tuple[Column, Column]:
        x, y = _pair(cell)
        return (x + 0.5) * self.degrees, (y + 0.5) * self.degrees

    def sql(self) -> dict[str, str]:
        """Bodies of the SQL functions of `register`."""
        d, x, y = f"{self.degrees!r}D", *(f"try_cast(split(substring(cell, 2), '_')[{k}] AS BIGINT)" for k in (0, 1))
        corners = ", ".join(f"named_struct('lon', ({x} + {a}) * {d}, 'lat', ({y} + {b}) * {d})" for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)))
        return {
            "ping_cell": f"concat('g', CAST(CAST(floor(lon / {d}) AS BIGINT) AS STRING), '_', CAST(CAST(floor(lat / {d}) AS BIGINT) AS STRING))",
            "cell_centroid_lon": f"({x} + 0.5D) * {d}",
            "cell_centroid_lat": f"({y} + 0.5D) * {d}",
            "cell_boundary": f"array({corners})",
        }

    def outline(self, cell: Column) -> Column:
        x, y = _pair(cell)
        corner = lambda a, b: F.struct(((x + a) * self.degrees).alias("lon"), ((y + b) * self.degrees).alias("lat"))
        return F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))


@dataclass(frozen=True)
class Hexagon:
    #: From the centre to a corner.
    degrees: float = 0.03

    def cell(self, lon: Column, lat: Column) -> Column:
        """Rounds cube coordinates and mends the one that was rounded most, so that the three still add up to 0."""
        q = (lon * (3**0.5 / 3) - lat / 3) / self.degrees
        r = lat * (2 / 3) / self.degrees
        s = -q - r
        a, b, c = F.round(q), F.round(r), F.round(s)
        da, db, dc = F.abs(a - q), F.abs(b - r), F.abs(c - s)
        x = F.when((da > db) & (da > dc), -b - c).otherwise(a).cast("long")
        y = F.when((da > db) & (da > dc), b).when(db > dc, -a - c).otherwise(b).cast("long")
        return F.concat(F.lit("x"), x.cast("string"), F.lit("_"), y.cast("string"))

    def centre(self, cell: Column) -> tuple[Column, Column]:
        q, r = _pair(cell)
        return self.degrees * (3**0.5) * (q + r / 2), self.degrees * 1.5 * r

    def sql(self) -> dict[str, str]:
        """Bodies of the SQL functions of `register`."""
        d = f"{self.degrees!r}D"
        q, r = f"((lon * {3**0.5 / 3!r}D - lat / 3) / {d})", f"(lat * {2 / 3!r}D / {d})"
        a, b, c = f"round({q})", f"round({r})", f"round(-{q} - {r})"
        da, db, dc = f"abs({a} - {q})", f"abs({b} - {r})", f"abs({c} - (-{q} - {r}))"
        x = f"CAST(CASE WHEN {da} > {db} AND {da} > {dc} THEN -{b} - {c} ELSE {a} END AS BIGINT)"
        y = f"CAST(CASE WHEN {da} > {db} AND {da} > {dc} THEN {b} WHEN {db} > {dc} THEN -{a} - {c} ELSE {b} END AS BIGINT)"
        i, j = (f"try_cast(split(substring(cell, 2), '_')[{k}] AS BIGINT)" for k in (0, 1))
        lon, lat = f"({self.degrees * 3**0.5!r}D * ({i} + {j} / 2))", f"({self.degrees * 1.5!r}D * {j})"
        half, size = self.degrees * 3**0.5 / 2, self.degrees
        corners = ", ".join(f"named_struct('lon', {lon} + {p!r}D, 'lat', {lat} + {s!r}D)" for p, s in ((0.0, size), (half, size / 2), (half, -size / 2), (0.0, -size), (-half, -size / 2), (-half, size / 2)))
        return {"ping_cell": f"concat('x', CAST({x} AS STRING), '_', CAST({y} AS STRING))", "cell_centroid_lon": lon, "cell_centroid_lat": lat, "cell_boundary": f"array({corners})"}

    def outline(self, cell: Column) -> Column:
        lon, lat = self.centre(cell)
        half, size = self.degrees * 3**0.5 / 2, self.degrees
        corner = lambda a, b: F.struct((lon + a).alias("lon"), (lat + b).alias("lat"))
        return F.array(corner(0, size), corner(half, size / 2), corner(half, -size / 2), corner(0, -size), corner(-half, -size / 2), corner(-half, size / 2))


DEFAULT = Square()


def with_cells(pings: DataFrame, index=DEFAULT, out: str = "cell") -> DataFrame:
    return pings.withColumn(out, index.cell(F.col("longitude"), F.col("latitude")))


def register(spark: SparkSession, index=DEFAULT) -> None:
    """ping_cell(lon, lat), cell_centroid_lon(cell), cell_centroid_lat(cell) and cell_boundary(cell) for SQL text, as expressions."""
    takes = {"ping_cell": "lon DOUBLE, lat DOUBLE"}
    gives = {"ping_cell": "STRING", "cell_boundary": "ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>"}
    for name, body in index.sql().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes.get(name, 'cell STRING')}) RETURNS {gives.get(name, 'DOUBLE')} RETURN {body}")


def centroids(cells: DataFrame, index=DEFAULT, cell: str = "cell") -> DataFrame:
    """cell, lat, lon of the distinct cells."""
    lon, lat = index.centre(F.col(cell))
    return cells.select(cell).distinct().select(cell, lat.alias("lat"), lon.alias("lon"))


def boundaries(cells: DataFrame, index=DEFAULT, cell: str = "cell") -> DataFrame:
    return cells.select(cell).distinct().select(cell, index.outline(F.col(cell)).alias("ring"))
