"""Simplification of areas that share borders, without gaps, overlaps or crossings.

1. Rings are taken apart into edges. A vertex is a node where other than two edges meet or where the edges' owners change; nodes stay.
   Owners and degrees come from aggregates over edges and vertices, so neighbours meet wherever their rows lie.
2. Between nodes a ring consists of arcs. An arc that two rings share has the same vertices in both, in one of two directions; it is
   known by its vertices in the lesser direction (a ring without a node is one arc from its least vertex) and thinned once.
3. Thinned arcs are checked for crossings and touches, with themselves and with each other, by a join on tiles; those in conflict get
   all their vertices back, and the check is repeated until nothing changes. At worst every arc is as it was.

A ring is handled by one task at a time; nothing else is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "struct<lon:double,lat:double>"


def thin(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Keeps the ends of a line and, again and again, the point farthest from its chord while that is over the tolerance. A closed line
    is thinned in two halves, which meet at the point farthest from its end."""
    ends = [0, len(points) - 1]
    if points[0] == points[-1] and len(points) > 3:
        x, y = points[0]
        ends.insert(1, max(range(1, len(points) - 1), key=lambda k: ((points[k][0] - x) ** 2 + (points[k][1] - y) ** 2, -k)))
    keep, todo = set(ends), list(zip(ends, ends[1:], strict=False))
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        (ax, ay), (bx, by) = points[a], points[b]
        length = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        away = [abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / length if length else ((x - ax) ** 2 + (y - ay) ** 2) ** 0.5 for x, y in points[a + 1 : b]]
        far = max(range(len(away)), key=away.__getitem__)
        if away[far] > tolerance:
            keep.add(a + 1 + far)
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return [points[k] for k in sorted(keep)]


def arcs_of(points: list[tuple[float, float]], nodes: list[bool]) -> list[tuple[bool, list[tuple[float, float]]]]:
    """(forward, vertices in the arc's own direction) of a ring given without its closing vertex."""
    if not any(nodes):
        start = points.index(min(points))
        line = points[start:] + points[: start + 1]
        return [(True, line) if line <= line[::-1] else (False, line[::-1])]
    start = nodes.index(True)
    points, nodes = points[start:] + points[: start + 1], nodes[start:] + nodes[: start + 1]
    out, begun = [], 0
    for k in range(1, len(points)):
        if nodes[k]:
            line = points[begun : k + 1]
            out.append((True, line) if line <= line[::-1] else (False, line[::-1]))
            begun = k
    return out


def _rings(areas: DataFrame, name: str) -> DataFrame:
    """name, part (0: ring, k: k-th hole), points without a closing vertex."""
    every = F.array(F.col("ring"))
    if "holes" in areas.columns:
        every = F.concat(every, F.coalesce("holes", F.array().cast(f"array<array<{POINT}>>")))
    rows = areas.filter(F.size("ring") > 0).select(F.col(name).alias("name"), F.posexplode(every).alias("part", "points"))
    closed = F.element_at("points", 1) == F.element_at("points", -1)
    return rows.withColumn("points", F.when(closed & (F.size("points") > 1), F.slice("points", F.lit(1), F.size("points") - 1)).otherwise(F.col("points")))


def _pieces(rings: DataFrame) -> DataFrame:
    """name, part, k, forward, arc, line: the arcs of each ring in order."""
    n = F.size("points")
    corners = rings.select("name", "part", "points", F.posexplode("points").alias("i", "v")).withColumn("w", F.element_at("points", ((F.col("i") + 1) % n + 1).cast("int"))).drop("points")
    edges = corners.filter("v != w").groupBy(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).agg(F.array_sort(F.collect_set(F.struct("name", "part"))).alias("owners"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("v"), "owners")
    nodes = ends.groupBy("v").agg(F.count("*").alias("n"), F.min("owners").alias("p"), F.max("owners").alias("q")).select("v", ((F.col("n") != 2) | (F.col("p") != F.col("q"))).alias("node"))
    marked = corners.join(nodes, "v", "left").groupBy("name", "part").agg(F.array_sort(F.collect_list(F.struct("i", "v", F.coalesce("node", F.lit(False)).alias("node")))).alias("corners"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows = []
            for name, part, found in zip(*(batch.column(c).to_pylist() for c in ("name", "part", "corners")), strict=True):
                points = [(c["v"]["lon"], c["v"]["lat"]) for c in found]
                for k, (forward, line) in enumerate(arcs_of(points, [c["node"] for c in found])):
                    rows.append((name, part, k, forward, hashlib.sha256(repr(line).encode()).hexdigest(), [{"lon": x, "lat": y} for x, y in line]))
            point = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
            kinds = (batch.schema.field("name").type, pa.int32(), pa.int32(), pa.bool_(), pa.string(), point)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=["name", "part", "k", "forward", "arc", "line"])

    return marked.mapInArrow(cut, f"name {dict(rings.dtypes)['name']}, part int, k int, forward boolean, arc string, line array<{POINT}>")


def _thinned(arcs: DataFrame, tolerance: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [[{"lon": x, "lat": y} for x, y in thin([(p["lon"], p["lat"]) for p in line], tolerance)] for line in batch.column("line").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, batch.column("line").type)], names=[*batch.schema.names, "now"])

    return arcs.mapInArrow(run, f"arc string, line array<{POINT}>, now array<{POINT}>")


def _turn(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["lon"] - a["lon"]) * (c["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (c["lon"] - a["lon"]))


def _on(a: Column, b: Column, c: Column) -> Column:
    """Whether c, in line with a and b, lies between them."""
    return (_turn(a, b, c) == 0) & c["lon"].between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & c["lat"].between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))


def conflicts(arcs: DataFrame, tile: float) -> DataFrame:
    """The arcs (column arc) of arcs(arc, now) that meet themselves or another anywhere but at a common vertex."""
    size = F.size("now")
    rows = arcs.filter(size > 1).select("arc", size.alias("n"), F.posexplode(F.slice("now", F.lit(1), size - 1)).alias("i", "a"), "now").withColumn("b", F.element_at("now", F.col("i") + 2)).drop("now")
    at = lambda f, c: F.floor(f(F.col(f"a.{c}"), F.col(f"b.{c}")) / F.lit(tile)).cast("long")
    rows = rows.withColumn("x", F.explode(F.sequence(at(F.least, "lon"), at(F.greatest, "lon")))).withColumn("y", F.explode(F.sequence(at(F.least, "lat"), at(F.greatest, "lat"))))
    other = rows.select(*(F.col(c).alias(f"_{c}") for c in rows.columns))
    met = rows.join(other, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")) & (F.struct("arc", "i") < F.struct("_arc", "_i")))
    a, b, c, d = (F.col(k) for k in ("a", "b", "_a", "_b"))
    # At a common vertex two segments may meet, unless one runs along the other.
    shared = ((a == c) & ~_on(a, b, d) & ~_on(c, d, b)) | ((a == d) & ~_on(a, b, c) & ~_on(c, d, b)) | ((b == c) & ~_on(a, b, d) & ~_on(c, d, a)) | ((b == d) & ~_on(a, b, c) & ~_on(c, d, a))
    crossing = (_turn(a, b, c) != _turn(a, b, d)) & (_turn(c, d, a) != _turn(c, d, b))
    touching = _on(a, b, c) | _on(a, b, d) | _on(c, d, a) | _on(c, d, b)
    return met.filter((crossing | touching) & ~shared).select(F.explode(F.array("arc", "_arc")).alias("arc")).distinct()


def simplify(areas: DataFrame, tolerance: float = 0.0008, name: str = "name", tile: float = 0.05) -> DataFrame:
    """areas(name, ring[, holes]) with fewer vertices: shared borders stay shared, nodes stay, and nothing crosses that did not before.

    No dropped vertex is farther than the tolerance from its arc. Names must be distinct; rings come back closed; areas without a ring
    are left out. The rounds of checks are driven from here; each ends with one number.
    """
    pieces = _pieces(_rings(areas, name)).persist()
    arcs = _thinned(pieces.select("arc", "line").dropDuplicates(["arc"]), tolerance).persist()
    while True:
        bad = conflicts(arcs, tile).join(arcs.filter(F.size("now") < F.size("line")).select("arc"), "arc", "left_semi").persist()
        if not bad.count():
            break
        restored = arcs.join(bad.withColumn("bad", F.lit(True)), "arc", "left").select("arc", "line", F.when(F.col("bad"), F.col("line")).otherwise(F.col("now")).alias("now")).persist()
        restored.count()
        arcs.unpersist()
        bad.unpersist()
        arcs = restored
    path = F.when(F.col("forward"), F.col("now")).otherwise(F.reverse("now"))
    rows = pieces.join(arcs.select("arc", "now"), "arc").groupBy("name", "part").agg(F.array_sort(F.collect_list(F.struct("k", path.alias("path")))).alias("paths"))
    inner = F.flatten(F.transform("paths", lambda p: F.slice(p["path"], F.lit(1), F.size(p["path"]) - 1)))
    rings = rows.select("name", "part", F.concat(inner, F.array(F.element_at(inner, 1))).alias("ring"))
    out = rings.groupBy("name").agg(F.max(F.when(F.col("part") == 0, F.col("ring"))).alias("ring"), F.array_sort(F.collect_list(F.when(F.col("part") > 0, F.struct("part", "ring")))).alias("h"))
    return out.select(F.col("name").alias(name), "ring", F.transform("h", lambda h: h["ring"]).alias("holes"))
