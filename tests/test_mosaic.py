"""Simplified mosaics: borders stay shared, areas still tile the whole, nothing crosses."""

import math

import pytest

from pingmill.functions import geo, mosaic

AREA = f"name string, ring array<{geo.POINT}>, holes array<array<{geo.POINT}>>"


def pts(line):
    return [{"lon": float(x), "lat": float(y)} for x, y in line]


def wavy(a, b, n=24, size=0.004, phase=0.0):
    """A wavy line from a to b, without b."""
    (ax, ay), (bx, by) = a, b
    s = size if (ax, ay) < (bx, by) else -size
    out = []
    for k in range(n):
        t = k / n
        u = t if s > 0 else 1 - t
        off = 0 if k == 0 else s * math.sin(u * 9 + phase) * math.sin(math.pi * u)
        out.append((ax + (bx - ax) * t - off * (by - ay), ay + (by - ay) * t + off * (bx - ax)))
    return [(round(x, 9), round(y, 9)) for x, y in out]


def mosaic_rows(m=3):
    """m by m cells whose borders are wavy lines that neighbours share in opposite directions, and an enclave in the first one's hole."""
    rows = []
    for i in range(m):
        for j in range(m):
            c = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            ring = [p for k in range(4) for p in wavy(c[k], c[(k + 1) % 4])]
            rows.append((f"c{i}{j}", pts(ring if (i + j) % 2 else ring + ring[:1]), None))
    circle = [(round(0.5 + 0.2 * math.cos(2 * math.pi * k / 60), 9), round(0.5 + 0.2 * math.sin(2 * math.pi * k / 60), 9)) for k in range(60)]
    rows[0] = (rows[0][0], rows[0][1], [pts(circle[::-1])])
    return rows + [("enclave", pts(circle[17:] + circle[:17]), None)]


def area(ring):
    p = [(q.lon, q.lat) for q in ring]
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2


def test_a_mosaic_stays_a_mosaic(spark):
    rows = mosaic_rows()
    got = {r.name: r for r in mosaic.simplify(spark.createDataFrame(rows, AREA), 0.002).collect()}
    assert set(got) == {r[0] for r in rows}
    before, after = sum(len(r[1]) for r in rows), sum(len(r.ring) for r in got.values())
    assert after < before / 2
    total = sum(area(r.ring) - sum(abs(area(h)) for h in r.holes) for r in got.values())
    edges = {}
    for r in got.values():
        for ring in (r.ring, *r.holes):
            assert ring[0] == ring[-1]
            for p, q in zip(ring, ring[1:], strict=False):
                edges.setdefault(frozenset([tuple(p), tuple(q)]), []).append(r.name)
    outer = [e for e, names in edges.items() if len(names) == 1]
    assert all(len(names) <= 2 for names in edges.values())  # no overlap
    # What only one area has is the outline of the whole: closed, and around all areas together.
    ends = {}
    for e in outer:
        for p in e:
            ends.setdefault(p, []).append(e)
    assert all(len(x) == 2 for x in ends.values())
    p, last, path = next(iter(ends)), None, []
    while not path or p != path[0]:
        path.append(p)
        last = next(e for e in ends[p] if e != last)
        (p,) = last - {p}
    around = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(path, path[1:] + path[:1], strict=True)) / 2)
    assert len(path) == len(outer) and total == pytest.approx(around)
    hole, enclave = got["c00"].holes[0], got["enclave"].ring
    assert {tuple(p) for p in hole} == {tuple(p) for p in enclave}


def test_conflicting_arcs_get_their_vertices_back(spark):
    """A narrow inlet around a spike of the neighbour: thinning both roughly would make them cross."""
    lower = [(0, 0), (4, 0), (4, 1), (2.1, 1), (2, 1.9), (1.9, 1), (0, 1)]
    upper = [(0, 3), (0, 1.5), (1.85, 1.5), (1.95, 2.2), (2.05, 2.2), (2.15, 1.5), (4, 1.5), (4, 3)]
    df = spark.createDataFrame([("lower", pts(lower), None), ("upper", pts(upper), None)], AREA)
    for tolerance in (0.05, 0.8, 5.0):
        got = mosaic.simplify(df, tolerance, tile=1.0).collect()
        lines = spark.createDataFrame([(r.name, [p.asDict() for p in r.ring]) for r in got], f"arc string, now array<{geo.POINT}>")
        inside = [x for x in mosaic.conflicts(lines, 1.0).collect()]
        assert len(got) == 2 and not inside, tolerance


def test_thinning():
    line = [(0, 0), (1, 0.1), (2, -0.1), (3, 5), (4, 6), (5, 7), (6, 8.1), (7, 9)]
    done = mosaic.thin(line, 0.5)
    assert done[0] == line[0] and done[-1] == line[-1] and len(done) < len(line) and mosaic.thin(line, 0) != done
    assert mosaic.thin([(0, 0), (1, 1)], 1) == [(0, 0), (1, 1)]
    ring = [(0, 0), (1, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    assert mosaic.thin(ring, 0.1) == [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]


def test_no_areas(spark):
    df = spark.createDataFrame([("none", None, None), ("empty", [], None)], AREA)
    assert mosaic.simplify(df).collect() == []
