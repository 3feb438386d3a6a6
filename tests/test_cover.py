"""Adaptive covers: few cells, inner ones wholly inside, and the same points within as by the plain test."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pingmill.functions import cover, geo

AREA = f"name string, ring array<{geo.POINT}>, holes array<array<{geo.POINT}>>"


def ring(points):
    return [{"lon": float(x), "lat": float(y)} for x, y in points]


def star(n, x, y, r, seed):
    rng = np.random.default_rng(seed)
    return ring((x + r * (0.4 + rng.random()) * math.cos(2 * math.pi * k / n), y + r * (0.4 + rng.random()) * math.sin(2 * math.pi * k / n)) for k in range(n))


def square(x, y, r):
    return ring([(x, y), (x + r, y), (x + r, y + r), (x, y + r), (x, y)])


@pytest.fixture(scope="module")
def areas(spark):
    rows = [("star", star(40, 110.3, -7.9, 0.3, 1), None), ("spikes", star(300, 110.5, -8.0, 0.2, 2), [square(110.48, -8.02, 0.04), star(9, 110.6, -7.95, 0.02, 3)])]
    rows += [("grid", square(110.25, -8.125, 0.25), [square(110.3125, -8.0625, 0.0625)]), ("small", square(110.4, -7.9, 0.0005), None)]
    rows += [("odd hole", square(110.0, -8.0, 0.1), [square(110.05, -7.95, 0.2)]), ("world", square(-180, -90, 360), None), ("point", ring([(110.5, -8.0)]), None), ("none", None, None), ("empty", [], None)]
    return spark.createDataFrame(rows, AREA)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    some = np.stack([rng.uniform(109.9, 110.9, 3000), rng.uniform(-8.4, -7.6, 3000)], 1).tolist()
    some += [[110.25 + i / 32, -8.125 + j / 32] for i in range(10) for j in range(10)]  # corners and edges of squares and cells
    some += [[110.4, -7.9], [110.4002, -7.8998], [110.5, -8.0], [-180.0, 0.0], [179.0, 89.0], [500.0, 0.0]]
    rows = [(i, x, y) for i, (x, y) in enumerate(some)] + [(10_000, None, 1.0), (10_001, 110.3, None)]
    return spark.createDataFrame(rows, "seq long, longitude double, latitude double")


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"depth": 1, "deepest": 1}, {"depth": 7, "deepest": 7}])
def test_within_is_the_plain_test(spark, areas, points, options):
    plain = points.join(areas, geo.inside_area(F.col("longitude"), F.col("latitude"), F.col("ring"), F.col("holes")), "left").select("seq", F.coalesce("name", F.lit("")).alias("name"))
    got = sorted(map(tuple, cover.within(points.withColumn("Name", F.lit("mine")).drop("Name"), areas, **options).select("seq", "name").collect()))
    want = sorted(map(tuple, plain.collect()))
    assert got == want and {n for _, n in want} >= {"star", "spikes", "grid", "small", "odd hole", "world", ""}


def test_no_areas(spark, areas, points):
    assert {r.name for r in cover.within(points, areas.limit(0)).collect()} == {""}
    assert cover.within(points.limit(0), areas).count() == 0


def test_a_country_has_hundreds_of_cells(spark):
    """A ring of 20,000 corners over 10 degrees; tiles of 0.05 degrees would be 40,000 with 20,000 corners in each."""
    outline = ring((100 + 5 * math.cos(t / 10_000 * math.pi) * (1 + 0.05 * math.sin(t / 40)), 5 * math.sin(t / 10_000 * math.pi)) for t in range(20_000))
    cells = cover.cover(spark.createDataFrame([("c", outline, None)], AREA)).collect()
    assert 50 < len(cells) < 5000 and all(not r.edges for r in cells if r.kind == "inner")
    assert len(cover.cover(spark.createDataFrame([("c", outline, None)], AREA), few=10**6).collect()) < 300
    assert max(len(r.edges) for r in cells) < 200


def test_cells_of_an_area_are_disjoint_and_hold_it(spark, areas):
    cells = [r for r in cover.cover(areas).collect() if r.name == "grid"]
    box = lambda r: (r.x * 2.0 ** (8 - r.level), r.y * 2.0 ** (8 - r.level), 2.0 ** (8 - r.level))
    inner = sum(box(r)[2] ** 2 for r in cells if r.kind == "inner")
    every = sum(box(r)[2] ** 2 for r in cells)
    assert inner <= 0.25**2 - 0.0625**2 <= every
    rng = np.random.default_rng(5)
    for x, y in rng.uniform((110.2, -8.2), (110.6, -7.8), (2000, 2)):
        assert sum(1 for r in cells if box(r)[0] <= x < box(r)[0] + box(r)[2] and box(r)[1] <= y < box(r)[1] + box(r)[2]) <= 1
