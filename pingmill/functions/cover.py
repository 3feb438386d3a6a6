"""Adaptive covers of areas: quadtrees of cells that are split only where an outline passes.

A cell of level l is a square of 2 ** (8 - l) degrees (sides are powers of two, so which cell holds a point is exact). A cell that
no outline touches is all inside an area (`inner`: points in it need no test) or all outside (dropped). A touched cell is split
`depth` times, and on while more than `few` edges touch it, at most `deepest` times; what is still touched then is an `edge` cell and
carries only the edges beside it and, of those to the east, what a ray from inside it can tell apart, so the exact test there gives
what it gives with all edges.

An area of any size has a few hundred cells. Cells are cut in numpy, those of many areas at a time; all that touches points is column
expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH, DEEPEST, FEW = 4, 8, 12
LEAST_LEVEL, MOST_LEVEL = 0, 28
#: Degrees by which a cell is widened in all tests, far above the rounding of the exact test and below any cell.
MARGIN = 1e-9
#: Stands for a coordinate beyond all others.
BIG = 1e9
#: Pairs of a cell and an edge that a task looks at in one go, some 100 bytes each.
PAIRS = 2**16
EDGE = "struct<ax:double,ay:double,bx:double,by:double,part:int>"
_FIELDS = ("ax", "ay", "bx", "by", "part")


def _edges(ring: Column, part: Column) -> Column:
    n = F.size(ring)

    def edge(p: Column, i: Column) -> Column:
        q = F.element_at(ring, ((i + 1) % n + 1).cast("int"))
        return F.struct(p["lon"].alias("ax"), p["lat"].alias("ay"), q["lon"].alias("bx"), q["lat"].alias("by"), part.cast("int").alias("part"))

    return F.transform(ring, edge)


def edges(ring: Column, holes: Column | None = None) -> Column:
    """All edges of an area; part 0 is the ring, the others are the holes."""
    own = _edges(ring, F.lit(0))
    return own if holes is None else F.concat(own, F.flatten(F.transform(F.coalesce(holes, F.array()), lambda h, i: _edges(h, i + 1))))


def crossings(lon: Column, lat: Column, found: Column) -> Column:
    """How many of the edges a ray to the east crosses."""
    crossed = F.filter(
        found,
        lambda e: ((e["ay"] > lat) != (e["by"] > lat)) & (lon < (e["bx"] - e["ax"]) * (lat - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]),
    )
    return F.size(crossed)


def touched(lon: Column, lat: Column, found: Column) -> Column:
    """Whether the point lies on one of the edges."""

    def on(e: Column) -> Column:
        cross = (e["bx"] - e["ax"]) * (lat - e["ay"]) - (e["by"] - e["ay"]) * (lon - e["ax"])
        return (cross == 0) & lon.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & lat.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))

    return F.exists(found, on)


def inside(lon: Column, lat: Column, found: Column) -> Column:
    """Strictly inside the ring and strictly outside every hole, by the edges of both."""
    ring = F.filter(found, lambda e: e["part"] == 0)
    parts = F.array_distinct(F.filter(F.transform(found, lambda e: e["part"]), lambda p: p > 0))

    def in_hole(p: Column) -> Column:
        mine = F.filter(found, lambda e: e["part"] == p)
        return (crossings(lon, lat, mine) % 2 == 1) | touched(lon, lat, mine)

    return (crossings(lon, lat, ring) % 2 == 1) & ~touched(lon, lat, ring) & ~F.exists(parts, in_hole)


def side(level: Column) -> Column:
    return F.pow(F.lit(2.0), F.lit(8) - level)


def root_level(found: Column) -> Column:
    """Level of the smallest cells that are no smaller than the edges' box."""
    span = lambda a, b: F.array_max(F.transform(found, lambda e: F.greatest(e[a], e[b]))) - F.array_min(F.transform(found, lambda e: F.least(e[a], e[b])))
    level = F.floor(F.lit(8) - F.log2(F.greatest(span("ax", "bx"), span("ay", "by"))))
    return F.greatest(F.least(F.coalesce(level, F.lit(MOST_LEVEL)), F.lit(MOST_LEVEL)), F.lit(LEAST_LEVEL)).cast("int")


def _runs(counts: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each count n, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _roots(low: np.ndarray, high: np.ndarray, first: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, ...]:
    """area, level, x, y of the cells that meet the areas' boxes, and all pairs (cell, edge) of an area's cells and edges."""
    s = np.ldexp(1.0, 8 - level)[:, None]
    start, end = (np.floor(f.reduceat(v, first[:-1]) / s).astype(int) for f, v in ((np.minimum, low), (np.maximum, high)))
    wide, tall = np.where(end >= start, end - start + 1, 0).T
    area = np.repeat(np.arange(len(level)), wide * tall)
    k = _runs(wide * tall)
    n = np.diff(first)[area]
    cell = np.repeat(np.arange(len(area)), n)
    return area, level[area], start[area, 0] + k // tall[area], start[area, 1] + k % tall[area], cell, first[area][cell] + _runs(n)


def split(e: np.ndarray, first: np.ndarray, level: np.ndarray, depth: int, deepest: int, few: int, most: int = PAIRS) -> Iterator[tuple[np.ndarray, ...]]:
    """The cells of many areas, some at a time: area, level, x, y, whether inner, where each one's edges end, and those edges.

    `e` has rows ax, ay, bx, by, part; those of area k are rows first[k] to first[k + 1] (at least one), `level` is that of its roots.
    All cells that are at hand are cut at once, as long as they have at most `most` pairs of a cell and an edge.
    """
    low, high = np.minimum(e[:, :2], e[:, 2:4]), np.maximum(e[:, :2], e[:, 2:4])
    todo = [_roots(low, high, first, level)]
    while todo:
        area, at, x, y, cell, edge = todo.pop()
        if len(edge) > most and len(area) > 1:
            half = len(area) // 2
            k = np.searchsorted(cell, half)  # pairs are in the order of their cells
            todo += [(area[:half], at[:half], x[:half], y[:half], cell[:k], edge[:k]), (area[half:], at[half:], x[half:], y[half:], cell[k:] - half, edge[k:])]
            continue
        s = np.ldexp(1.0, 8 - at)
        west, south, east, north = x * s - MARGIN, y * s - MARGIN, (x + 1) * s + MARGIN, (y + 1) * s + MARGIN
        keep = (high[edge, 1] >= south[cell]) & (low[edge, 1] <= north[cell]) & (high[edge, 0] >= west[cell])  # what a ray to the east can meet
        cell, edge = cell[keep], edge[keep]
        far = low[edge, 0] > east[cell]
        near, by = e[edge[~far]], cell[~far]
        # An edge passes unless all corners lie on one side of it.
        dx, dy = near[:, 2] - near[:, 0], near[:, 3] - near[:, 1]
        corners = np.stack([dx * (q[by] - near[:, 1]) - dy * (p[by] - near[:, 0]) for p in (west, east) for q in (south, north)])
        passing = np.bincount(by[(corners.min(0) <= 0) & (corners.max(0) >= 0)], minlength=len(area))
        k = at - level[area]
        cut = (k == 0) | ((passing > 0) & (at < MOST_LEVEL) & ((k < depth) | ((passing > few) & (k < deepest))))
        if cut.any():
            number, n, mine = np.cumsum(cut) - 1, int(cut.sum()), cut[cell]
            fours = [(i, j) for i in (0, 1) for j in (0, 1)]
            xs, ys = (np.concatenate([2 * v[cut] + ij[d] for ij in fours]) for d, v in enumerate((x, y)))
            cells = np.concatenate([number[cell[mine]] + q * n for q in range(4)])
            todo.append((np.tile(area[cut], 4), np.tile(at[cut] + 1, 4), xs, ys, cells, np.tile(edge[mine], 4)))
        edges_of, inner = (passing > 0) & ~cut, (passing == 0) & ~cut
        mine = inner[cell]
        inner[inner] = _inside((west + east) / 2, (south + north) / 2, cell[mine], e[edge[mine]])[inner]
        done = np.flatnonzero(edges_of | inner)
        if len(done):
            a, b = edges_of[by], edges_of[cell] & far
            beyond, of = _far(cell[b], e[edge[b]], south, north)
            owner = np.concatenate([by[a], of])
            flat = np.concatenate([near[a], beyond])[np.argsort(owner, kind="stable")]
            yield area[done], at[done], x[done], y[done], inner[done], np.cumsum(np.bincount(owner, minlength=len(area))[done]), flat


def _far(cell: np.ndarray, e: np.ndarray, south: np.ndarray, north: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges with the same effect on rays that start between two latitudes, for edges that lie east of all those rays' starts.

    Such a ray crosses an edge if one end is above it and the other is not, so only the ends count: two at one latitude cancel (as they
    do at each corner between two such edges), and those outside the latitudes are always or never above. Row k of `e` belongs to
    cell[k], whose latitudes south and north hold; the second result says to which cell an edge belongs.
    """
    owner, part, lat = np.tile(cell, 2), np.tile(e[:, 4], 2), np.concatenate([e[:, 1], e[:, 3]])
    ends, n = _counted(owner, part, lat)
    owner, part, lat = (v[n % 2 == 1] for v in ends)
    (group, of), inverse = _groups(owner, part)
    always = np.bincount(inverse[lat > north[owner]], minlength=len(group))
    here = (lat >= south[owner]) & (lat <= north[owner])
    odd = np.bincount(inverse[here], minlength=len(group)) % 2 == 1
    both = (always + odd) % 2 == 1
    rows = [(owner[here], part[here], np.zeros(int(here.sum())), lat[here])]
    rows += [(group[m], of[m], np.full(int(m.sum()), order), np.full(int(m.sum()), value)) for m, order, value in ((odd, 1.0, BIG), (both, 2.0, -BIG), (both, 3.0, BIG))]
    owner, part, order, lat = (np.concatenate(c) for c in zip(*rows, strict=True))
    by = np.lexsort((lat, order, part, owner))
    owner, part, lat = owner[by][::2], part[by][::2], lat[by].reshape(-1, 2)
    big = np.full(len(owner), BIG)
    return np.stack([big, lat[:, 0], big, lat[:, 1], part], axis=1), owner


def _counted(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The different combinations in order, and how often each occurs."""
    by = np.lexsort(keys[::-1])
    keys = [k[by] for k in keys]
    new = np.ones(len(by), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    start = np.flatnonzero(new)
    return [k[start] for k in keys], np.diff(np.append(start, len(by)))


def _groups(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The different combinations of keys that are in order, and the place of each row's among them."""
    found, n = _counted(*keys)
    return found, np.repeat(np.arange(len(n)), n)


def _inside(lon: np.ndarray, lat: np.ndarray, cell: np.ndarray, e: np.ndarray) -> np.ndarray:
    """For a point of each cell that lies on no edge; row k of `e` belongs to cell[k]."""
    met = (e[:, 1] > lat[cell]) != (e[:, 3] > lat[cell])
    cell, e = cell[met], e[met]
    crossed = lon[cell] < (e[:, 2] - e[:, 0]) * (lat[cell] - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0]
    (cell, part), n = _counted(cell[crossed], e[crossed, 4])
    odd = n % 2 == 1
    found = np.zeros(len(lon), bool)
    found[cell[odd & (part == 0)]] = True
    found[cell[odd & (part > 0)]] = False
    return found


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of areas whose edges, but for the last area's, are at most PAIRS."""
    n = np.asarray(batch.column("edges").value_lengths())
    ends = np.append(np.unique((np.cumsum(n) - n) // PAIRS, return_index=True)[1], len(n))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield batch.slice(a, b - a)


def cover(areas: DataFrame, name: str = "name", depth: int = DEPTH, deepest: int = DEEPEST, few: int = FEW) -> DataFrame:
    """areas(name, ring[, holes]) to cells: name, level, x, y, kind ('inner' or 'edge'), edges. Areas without a ring have none.

    Vertices must not be null; an area's cells are disjoint, those of different areas may overlap. Areas are dealt over all tasks, as
    files of areas are small.
    """
    found = edges(F.col("ring"), F.col("holes") if "holes" in areas.columns else None)
    rows = areas.filter(F.size("ring") > 0).select(F.col(name).alias("name"), found.alias("edges")).withColumn("level", root_level(F.col("edges")))
    rows = rows.repartition(int(areas.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            names, lists = batch.column("name"), batch.column("edges")
            e = np.stack([np.asarray(lists.flatten().field(f), np.float64) for f in _FIELDS], axis=1)
            first = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            for area, level, x, y, inner, ends, flat in split(e, first, np.asarray(batch.column("level")), depth, deepest, few):
                parts = [pa.array(flat[:, k] if k < 4 else flat[:, k].astype(np.int32)) for k in range(5)]
                found = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.StructArray.from_arrays(parts, list(_FIELDS)))
                columns = [names.take(pa.array(area)), pa.array(level, pa.int32()), pa.array(x), pa.array(y), pa.array(np.where(inner, "inner", "edge")), found]
                yield pa.RecordBatch.from_arrays(columns, names=["name", "level", "x", "y", "kind", "edges"])

    return rows.mapInArrow(run, f"name {dict(rows.dtypes)['name']}, level int, x long, y long, kind string, edges array<{EDGE}>")


def _sizes(cells: DataFrame) -> tuple[list[int], int]:
    """The levels of the cells, and about how many bytes all cells take in memory."""
    per = cells.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.size("edges")).alias("edges")).collect()  # one row a level
    return sorted(r.level for r in per), sum(100 * r.n + 48 * r.edges for r in per)


def within(points: DataFrame, areas: DataFrame, name: str = "name", depth: int = DEPTH, deepest: int = DEEPEST, few: int = FEW, broadcast_bytes: int | None = None) -> DataFrame:
    """Left join of points(longitude, latitude) to areas(name, ring[, holes]) that strictly contain them; '' where none does.

    A point looks up its cell of each level that there is. While all cells, as counted, fit into Spark's broadcast threshold (or
    `broadcast_bytes`) that is one lookup table for all levels and points do not move. Beyond it, distinct places are exploded by
    level, meet the cells in one exchange, and the areas found are joined back to the points by place.
    """
    cells = cover(areas, name, depth, deepest, few)
    levels, size = _sizes(cells)
    if broadcast_bytes is None:
        broadcast_bytes = points.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if not levels:
        return points.withColumn(name, F.lit(""))
    lon, lat = F.col("longitude"), F.col("latitude")
    x, y = (lambda level: F.floor(lon / side(level)).cast("long")), (lambda level: F.floor(lat / side(level)).cast("long"))
    rest = [c for c in points.columns if c != name]
    hit = lambda c: (c["kind"] == "inner") | inside(lon, lat, c["edges"])
    if size <= broadcast_bytes:
        found = cells.groupBy("level", "x", "y").agg(F.collect_list(F.struct("name", "kind", "edges")).alias("_cells"))
        rows = points.select(*rest)
        for level in levels:
            here = found.select(F.col("level").alias("_l"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("_cells").alias(f"_c{level}"))
            here = F.broadcast(here)  # its size was counted above
            rows = rows.join(here, (F.col("_l") == level) & (F.col("_x") == x(F.lit(level))) & (F.col("_y") == y(F.lit(level))), "left").drop("_l", "_x", "_y")
        none = F.array().cast(f"array<struct<name:{dict(cells.dtypes)['name']},kind:string,edges:array<{EDGE}>>>")
        names = F.transform(F.filter(F.concat(*(F.coalesce(F.col(f"_c{k}"), none) for k in levels)), hit), lambda c: c["name"])
        return rows.select(*rest, F.explode_outer(names).alias("_found")).select(*rest, F.coalesce("_found", F.lit("")).alias(name))
    places = points.select("longitude", "latitude").distinct().withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    places = places.withColumns({"x": x(F.col("level")), "y": y(F.col("level"))})
    met = places.join(cells, ["level", "x", "y"]).filter((F.col("kind") == "inner") | inside(lon, lat, F.col("edges")))
    met = met.select(F.col("longitude").alias("_x"), F.col("latitude").alias("_y"), F.col("name").alias("_found"))
    rows = points.select(*rest).join(met, (lon == F.col("_x")) & (lat == F.col("_y")), "left")
    return rows.select(*rest, F.coalesce("_found", F.lit("")).alias(name))
