import math
import random

import pytest
from pyspark.sql import functions as F

from pingmill.functions import cells, globe
from pingmill.functions.globe import Globe


def unit(lon, lat):
    lon, lat = math.radians(lon), math.radians(lat)
    return math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)


def plain_cells(lon, lat, n):
    """The nearest lattice point on the face, or more where the distance is the same, by trying those around."""
    p = unit(lon, lat)
    face = max(globe.faces(), key=lambda f: sum(x * y for x, y in zip(globe.middle(f), p)))
    c = [sum(x * y for x, y in zip(s, p)) for s in globe.shares(face)]
    a, b, d = (x * n / sum(c) for x in c)
    tries = [(i, j, n - i - j) for i in range(int(a) - 1, int(a) + 3) for j in range(int(b) - 1, int(b) + 3)]
    far = [(t[0] - a) ** 2 + (t[1] - b) ** 2 + (t[2] - d) ** 2 for t in tries]
    return ["s" + ".".join(f"{v}x{w}" for v, w in zip(face, t) if w) for t, x in zip(tries, far) if x < min(far) + 1e-7]


@pytest.fixture(scope="module")
def points():
    rng = random.Random(4)
    rows = [(math.degrees(rng.uniform(-math.pi, math.pi)), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(1500)]
    return rows + [(0.0, 90.0), (123.0, -90.0), (180.0, 0.3), (-180.0, 0.3), (179.999999, -17.2), (0.0, math.degrees(math.atan(0.5)))]


def test_there_are_twenty_faces_and_each_point_is_on_one():
    v = globe.vertices()
    assert len(set(globe.faces())) == 20 and all(abs(sum(x * x for x in p) - 1) < 1e-12 for p in v)
    assert {round(sum(x * y for x, y in zip(v[f[i]], v[f[j]])), 9) for f in globe.faces() for i, j in ((0, 1), (1, 2), (0, 2))} == {round(1 / math.sqrt(5), 9)}


@pytest.mark.parametrize("n", [1, 7, 1500])
def test_cells_are_the_nearest_centres_and_come_back_from_their_centres(spark, points, n):
    index = Globe(n)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i long, lon double, lat double")
    named = df.withColumn("cell", index.cell(F.col("lon"), F.col("lat")))
    lon, lat = index.centre(F.col("cell"))
    rows = named.withColumn("clon", lon).withColumn("clat", lat).withColumn("again", index.cell(F.col("clon"), F.col("clat"))).collect()
    assert all(r.cell == r.again for r in rows)
    assert [r.cell for r in rows if r.cell not in plain_cells(r.lon, r.lat, n)] == []
    assert rows[-6].cell == f"s0x{n}" and rows[-5].cell == f"s11x{n}" and rows[-4].cell == rows[-3].cell  # poles, the date line
    if n == 1:
        assert len({r.cell for r in rows}) == 12
    if n == 7:
        assert len({r.cell for r in rows}) <= 10 * 49 + 2


def test_outlines_close_around_their_points(spark, points):
    """Corners: six, or five at a vertex; neighbours share them; every cell's points lie inside its outline; areas sum to the sphere."""
    n = 3
    index = Globe(n)
    every = {"s" + ".".join(f"{v}x{w}" for v, w in zip(f, (i, j, n - i - j)) if w) for f in globe.faces() for i in range(n + 1) for j in range(n + 1 - i)}
    assert len(every) == 10 * n * n + 2
    rings = {r.cell: [unit(p.lon, p.lat) for p in r.ring] for r in cells.boundaries(spark.createDataFrame([(c,) for c in every], "cell string"), index).collect()}
    assert sorted({len(r) for r in rings.values()}) == [5, 6] and sum(len(r) == 5 for r in rings.values()) == 12
    uses = {}
    for ring in rings.values():
        for p in ring:
            key = tuple(round(x, 6) + 0.0 for x in p)
            uses[key] = uses.get(key, 0) + 1
    assert set(uses.values()) == {3} and len(uses) == 20 * n * n

    def area(ring):
        total = 0.0
        for k in range(1, len(ring) - 1):
            a, b, c = ring[0], ring[k], ring[k + 1]
            dot = lambda x, y: sum(p * q for p, q in zip(x, y))
            total += 2 * math.atan2(dot(a, globe._cross(b, c)), 1 + dot(a, b) + dot(b, c) + dot(c, a))
        return total

    assert abs(sum(map(area, rings.values())) - 4 * math.pi) < 1e-6 and min(map(area, rings.values())) > 0


def test_finer_cells_roll_up(spark, points):
    fine, n = Globe(300), 60
    df = spark.createDataFrame(points, "lon double, lat double").withColumn("cell", fine.cell(F.col("lon"), F.col("lat")))
    lon, lat = fine.centre(F.col("cell"))
    got = df.select("cell", fine.coarser(F.col("cell"), n).alias("up"), lon.alias("clon"), lat.alias("clat")).collect()
    shifted = [r for r in got if r.up not in plain_cells(r.clon, r.clat, n)]
    assert len(shifted) == 0 and all(sum(int(p.split("x")[1]) for p in r.up[1:].split(".")) == n for r in got)


def test_points_without_a_cell(spark):
    rows = [(None, 1.0), (1.0, None), (float("nan"), 1.0), (1.0, float("nan")), (1.0, 90.5), (float("inf"), 1.0), (1.0, 1.0)]
    df = spark.createDataFrame(rows, "lon double, lat double").select(Globe(9).cell(F.col("lon"), F.col("lat")).alias("cell"))
    got = df.select("cell", Globe(9).coarser(F.col("cell"), 3).alias("up"), Globe(9).centre(F.col("cell"))[0].alias("lon")).collect()
    assert [r.cell is None for r in got] == [True] * 6 + [False] and [r.up is None for r in got] == [True] * 6 + [False] and got[0].lon is None
