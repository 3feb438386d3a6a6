"""Hard negatives against all pairs."""

import math

import numpy as np
import pyarrow as pa
import pytest

from pingmill.llm import negatives


def plain(rows):
    """rows (vec_id, vector, label) to what the query returns, by scoring all pairs with Python's integers."""
    usable = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    held = lambda x: max(negatives.LEAST, min(negatives.MOST, x))
    out = []
    for k, (a, v, label) in enumerate(usable):
        if a % 50:
            continue
        scored = [(-held(sum(x * y for x, y in zip(v, w, strict=False))), i, m) for j, (i, w, m) in enumerate(usable) if j != k]
        for minus, p, _ in sorted(x for x in scored if x[2] == label)[:5]:
            inside = sorted(x for x in scored if x[2] != label and -50 * minus <= -100 * x[0] <= -95 * minus)[:3]
            out += [(a, p, rank + 1, n, -minus, -s) for rank, (s, n, _) in enumerate(inside)]
    return out


def odd_rows():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(420):
        v = rng.normal(size=6) * (3 if i % 11 == 0 else 1)
        if i % 5 == 0:
            v = np.round(v)  # many ties
        rows.append((i, v.tolist(), i % 4 if i % 3 else 2))
    twin = [0.5, 0.5, -0.25, 0.0, 0.0, 0.0]
    rows += [(1000 + i, twin, 1 + i % 2) for i in range(120)]  # one vector many times
    rows += [(50, twin, 1), (50, twin, 1), (50, [1.0] * 6, 2), (100, twin, 1)]  # repeated ids
    rows += [(None, twin, 1), (2000, None, 1), (2050, twin, None), (2100, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (2150, [math.nan] * 6, 1), (2200, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0], 1)]
    rows += [(2250, [], 1), (2300, [1.0, 2.0], 2), (2350, [0.0] * 6, 1), (2400, [-1.0] * 6, 77), (-50, twin, -3)]
    return rows


@pytest.mark.parametrize("cells, batch, step", [(1 << 21, 1 << 20, 16), (150, 40, 1)])
def test_query_12(spark, folder, monkeypatch, cells, batch, step):
    for name, value in (("SHARD_CELLS", cells), ("BATCH_CELLS", batch), ("STEP", step)):
        monkeypatch.setattr(negatives, name, value)
    df = spark.createDataFrame([(i, v, k, 0) for i, v, k in odd_rows()], "vec_id long, embedding array<double>, label int, SHARD int")
    got = [tuple(r) for r in negatives.op12(spark, folder(embeddings=df)).collect()]
    assert sorted(got) == sorted(plain(odd_rows()))


def test_huge_components_and_no_rows(spark, folder, tmp_path):
    rows = [(50, [1e300, 1.0], 1), (51, [1.0, 1.0], 1), (52, [2.0**40, 0.0], 2), (53, [1.0, -2.0], 2), (100, [2.0**20, 3.0], 1), (101, [2.0**20, 1.0], 1), (102, [2.0**19, 7.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {tuple(r) for r in negatives.op12(spark, folder(embeddings=df)).collect()}
    held = [(i, [max(negatives.LEAST / 256, min(negatives.MOST / 256, x)) for x in v], k) for i, v, k in rows]
    assert {r for r in got if r[0] == 100} == {r for r in plain(held) if r[0] == 100} and len(got) >= 1
    df.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert negatives.op12(spark, f"{tmp_path}/none").collect() == []


def test_the_threshold_stops_the_search():
    """Where a few rows stand out, an anchor scores few rows; the result is that of all rows."""
    rng = np.random.default_rng(1)
    n, d = 5000, 4
    v = rng.integers(-50, 50, (n, d))
    v[:40] += 400
    ids = rng.permutation(n).astype(np.int64)
    lists = negatives.Lists(np.arange(n), ids, np.zeros(n, np.int64), v)
    for anchor in (np.array([3, 0, 5, 1]), np.array([-2, -1, 0, 0]), np.array([0, 0, 0, 0])):
        scores = v @ anchor
        windows = [(negatives.LEAST, negatives.MOST), (int(scores.max()) // 2, int(scores.max()) * 95 // 100)]
        count: list[int] = []
        got = lists.search(anchor, np.ones(n, bool), windows, 3, count)
        for (least, most), best in zip(windows, got, strict=True):
            inside = [x for x in range(n) if least <= scores[x] <= most]
            want = sorted(inside, key=lambda x: (-scores[x], ids[x]))[:3]
            assert [x for _, x in best] == want
        if anchor[0] == 3:
            lists.search(anchor, np.ones(n, bool), windows[:1], 3, few := [])
            assert sum(few) < n / 5


def test_lists_of_other_lengths():
    got = negatives.matrix(pa.chunked_array([[[1, 2, 3], [], [4]]], pa.list_(pa.int64())), 3)
    assert got.tolist() == [[1, 2, 3], [0, 0, 0], [4, 0, 0]]
