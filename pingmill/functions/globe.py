"""A hexagon index of the whole sphere, as column expressions.

An icosahedron (two vertices at the poles) is laid around the sphere. A point belongs to the face whose centre is nearest; its gnomonic
projection onto that face has three barycentric coordinates, which times the frequency are rounded to integers of the same sum. That
is rounding to hexagons whose centres divide each edge of the icosahedron into `frequency` parts: 10 frequency^2 + 2 cells, twelve of
them pentagons at the vertices, without a seam at the date line or a gap at the poles.

A cell is named by the vertices with a share in it, in ascending order: `s0x5.3x2.4x1` has 5 parts of vertex 0, 2 of 3 and 1 of 4.
So a cell on an edge has one name whichever face a point of it was found on, and the name alone gives the cell's centre, outline and
the cell that holds it at another frequency.

The ids are this library's own, not those of any published index. Cells are larger at the middle of a face than at its corners.
Points with a null, NaN, infinite or impossible coordinate (|lat| over 90) have no cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[float, float, float]


def vertices() -> list[Vector]:
    """The poles and two rings of five, the lower one turned by half a step."""
    ring = lambda lat, turn: [(math.cos(lat) * math.cos(math.radians(72 * k + turn)), math.cos(lat) * math.sin(math.radians(72 * k + turn)), math.sin(lat)) for k in range(5)]
    return [(0.0, 0.0, 1.0), *ring(math.atan(0.5), 0), *ring(-math.atan(0.5), 36), (0.0, 0.0, -1.0)]


def faces() -> list[tuple[int, int, int]]:
    """The three vertices of each face, ascending."""
    up, down = [(1 + k, 1 + (k + 1) % 5) for k in range(5)], [(6 + k, 6 + (k + 1) % 5) for k in range(5)]
    both = [(*up[k], 6 + k) for k in range(5)] + [(up[k][1], *down[k]) for k in range(5)]
    return [tuple(sorted(f)) for f in [(0, *e) for e in up] + both + [(*e, 11) for e in down]]


def _cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _dot(a: Sequence, b: Sequence):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def shares(face: tuple[int, int, int]) -> list[Vector]:
    """Vectors whose products with a point are in proportion to its barycentric coordinates on the face."""
    a, b, c = (vertices()[k] for k in face)
    whole = _dot(a, _cross(b, c))
    return [tuple(x / whole for x in _cross(*pair)) for pair in ((b, c), (c, a), (a, b))]


def middle(face: tuple[int, int, int]) -> Vector:
    return tuple(sum(vertices()[k][i] for k in face) / 3 for i in range(3))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _numbers(rows: Sequence[Sequence]) -> Column:
    return F.array(*(F.array(*map(F.lit, row)) for row in rows))


def _name(v: Sequence[Column], w: Sequence[Column], unit: float = 1.0) -> Column:
    """The cell of coordinates w / unit on vertices v: rounded, and the one that was rounded most mended so that the sum stays.

    Of coordinates that were rounded alike the last is mended.
    """

    def mended(c: Column) -> Column:
        near = [F.round(c[k] / unit) for k in ("a", "b", "d")]
        off = [F.abs(n * unit - c[k]) for n, k in zip(near, ("a", "b", "d"), strict=True)]
        whole = F.round((c["a"] + c["b"] + c["d"]) / unit)
        first = (off[0] > off[1]) & (off[0] > off[2])
        i = F.when(first, whole - near[1] - near[2]).otherwise(near[0])
        j = F.when(~first & (off[1] > off[2]), whole - near[0] - near[2]).otherwise(near[1])
        return F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), (whole - i - j).cast("long").alias("k"))

    def named(r: Column) -> Column:
        parts = [F.when(r[k] > 0, F.concat(x.cast("string"), F.lit("x"), r[k].cast("string"))) for x, k in zip(v, "ijk", strict=True)]
        return F.concat(F.lit("s"), F.concat_ws(".", *parts))

    return _let(F.struct(*(x.alias(n) for x, n in zip(w, ("a", "b", "d"), strict=True))), lambda c: _let(mended(c), named))


def _parts(cell: Column) -> Column:
    """Array of (v, w) from a name."""
    return F.transform(F.split(F.substring(cell, 2, 200), r"\."), lambda p: F.struct(F.split(p, "x")[0].try_cast("int").alias("v"), F.split(p, "x")[1].try_cast("long").alias("w")))


def _place(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


@dataclass(frozen=True)
class Globe:
    #: Parts of an edge of the icosahedron (some 7,054 km); 1,500 gives cells of about 23 square km.
    frequency: int = 1500

    def cell(self, lon: Column, lat: Column) -> Column:
        lam, phi = F.radians(F.when(lon <= -180, lon + 360).otherwise(lon)), F.radians(lat)
        point = F.array(F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))
        known = faces()
        table = _numbers([[x for row in shares(f) for x in row] for f in known])
        names = _numbers(known)

        def on_face(p: Column, at: Column) -> Column:
            def scaled(c: Column) -> Column:
                total = c[0] + c[1] + c[2]
                v = [F.element_at(names, at)[k] for k in range(3)]
                return _name(v, [c[k] * float(self.frequency) / total for k in range(3)])

            return _let(F.element_at(table, at), lambda t: _let(F.array(*(p[0] * t[3 * k] + p[1] * t[3 * k + 1] + p[2] * t[3 * k + 2] for k in range(3))), scaled))

        def nearest(p: Column) -> Column:
            dots = F.array(*(p[0] * F.lit(m[0]) + p[1] * F.lit(m[1]) + p[2] * F.lit(m[2]) for m in map(middle, known)))
            return _let(_let(dots, lambda d: F.array_position(d, F.array_max(d)).cast("int")), lambda at: on_face(p, at))

        possible = (F.abs(lat) <= 90) & (F.abs(lon) < float("inf"))
        return F.when(possible, _let(point, nearest))

    def _sum(self, shared: Column) -> Column:
        """Array x, y, z of the weighted vertices."""
        table = _numbers(vertices())

        def along(k: int) -> Column:
            return F.aggregate(shared, F.lit(0.0), lambda acc, p: acc + p["w"] * F.element_at(table, p["v"] + 1)[k])

        return F.array(along(0), along(1), along(2))

    def centre(self, cell: Column) -> tuple[Column, Column]:
        at = _let(self._sum(_parts(cell)), lambda p: F.struct(*(c.alias(n) for c, n in zip(_place(p[0], p[1], p[2]), ("lon", "lat"), strict=True))))
        return at["lon"], at["lat"]

    def outline(self, cell: Column) -> Column:
        """Corners in order around the centre, counter-clockwise from the south: six, at a vertex of the icosahedron five.

        Corners are the middles of the small triangles around a centre; on an edge or a vertex each face gives those that lie on it.
        """
        steps = [(2, -1, -1), (-1, 2, -1), (-1, -1, 2), (-2, 1, 1), (1, -2, 1), (1, 1, -2)]

        def on_face(parts: Column, f: Column) -> Column:
            weight = lambda k: F.coalesce(F.get(F.filter(parts, lambda p: p["v"] == f[k]), F.lit(0))["w"], F.lit(0))
            corner = lambda s: F.array(*(F.struct(f[k].alias("v"), (weight(k) * 3 + s[k]).alias("w")) for k in range(3)))
            return F.filter(F.array(*map(corner, steps)), lambda c: F.forall(c, lambda p: p["w"] >= 0))

        def turned(parts: Column) -> Column:
            mine = F.filter(_numbers(faces()), lambda f: F.forall(parts, lambda p: F.array_contains(f, p["v"])))
            points = F.transform(F.flatten(F.transform(mine, lambda f: on_face(parts, f))), self._sum)

            def around(c: Column) -> Column:
                lam, flat = F.atan2(c[1], c[0]), F.sqrt(c[0] * c[0] + c[1] * c[1])
                phi = F.atan2(c[2], flat)

                def seen(p: Column) -> Column:
                    east = p[1] * F.cos(lam) - p[0] * F.sin(lam)
                    north = p[2] * F.cos(phi) - F.sin(phi) * (p[0] * F.cos(lam) + p[1] * F.sin(lam))
                    lon, lat = _place(p[0], p[1], p[2])
                    return F.struct(F.atan2(east, -north).alias("turn"), lon.alias("lon"), lat.alias("lat"))

                return F.transform(F.array_sort(F.transform(points, seen)), lambda s: F.struct(s["lon"].alias("lon"), s["lat"].alias("lat")))

            return _let(self._sum(parts), around)

        return _let(_parts(cell), turned)

    def coarser(self, cell: Column, frequency: int) -> Column:
        """The cell of another frequency that holds the centre of this one: what finer counts roll up to."""

        def named(parts: Column) -> Column:
            part = lambda k: F.get(parts, F.lit(k))
            scaled = lambda k: F.coalesce(part(k)["w"], F.lit(0)) * float(frequency)
            return _name([F.coalesce(part(k)["v"], F.lit(-1)) for k in range(3)], [scaled(k) for k in range(3)], float(self.frequency))

        return F.when(cell.isNotNull(), _let(_parts(cell), named))
