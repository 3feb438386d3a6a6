"""Embedding near-dedup by spherical-cap filters.

Filter directions are structured random product codes: a table is a random rotation and, for each of a few blocks of coordinates,
some random code vectors; its directions are all sums of one code vector a block, so that millions of directions need a few hundred
vectors. A vector is list-decoded to every direction whose product with it exceeds the threshold: partial sums that cannot reach it
with the best remaining blocks are dropped, so the work follows the output. Vectors meet in the filters that both exceed; their
cosine is then verified in double precision, so no link under the bound is returned.

The threshold is chosen from the number of vectors so that about `CROWD` unrelated ones share a filter. Tables are added until pairs
of random vectors exactly at the bound meet with a share of `RECALL` (measured on such pairs, which closer ones exceed); recall
therefore depends neither on the number of vectors nor on their length.

Equal vectors are one class (an aggregate), so copies never multiply. The join on filters has three steps, so that vectors do not
travel once for each of their filters. First, filters get (class, sketch) rows only: a sketch is the vector in at most `SKETCH`
numbers of one byte. A class stays in the filters where some sketch is near enough for a link. Second, the classes that stay
somewhere go there again with the list of those filters. A pair that meets in several filters counts in the least of them, which both
lists tell, and a class stays in the filters that own one of its pairs. Third, vectors go to those filters, which for most are none
or one, and are verified. Sketches of up to `SKETCH` components allow for all that rounding can do; those of longer vectors are
projections, and allow for six standard deviations beside. Filters with more than `SLAB` classes are cut into slabs, and all pairs of
slabs are compared in tasks of their own. Tasks return sums of links and the edges of a spanning forest, never the pairs.

Defined results: null, empty and zero vectors and those with null, NaN or infinite components link with nothing (0 links, a
component of their own); vectors of different length do not link; rows of equal vec_id are vectors of their own, each with its own
links and component; a null vec_id links with nothing and has a null component; an empty table gives an empty result; columns other
than vec_id and v are not read, so none can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingmill.llm.common import discard, ship, table, written
from pingmill.llm.graph import components

BOUND, RECALL, CROWD, SLAB, RUN = 0.9, 0.96, 64.0, 4096, 4096
#: Filters that a pair at the bound shares in one table on average, code vectors of a block at most, components of a sketch at most.
SHARED, MOST_CODE, SKETCH = 0.35, 2048, 128
#: Pairs on which recall is measured, and cells compared at once.
TRIALS, CELLS = 1000, 1 << 22
SEED = 11


def cap(d: int, a: float) -> float:
    """Share of the unit sphere in d dimensions whose product with a given direction is at least a."""
    if d == 1:
        return 0.5
    x = np.linspace(-1, 1, 20001)[1:-1]
    w = (1 - x * x) ** ((d - 3) / 2)
    return float(w[x >= a].sum() / w.sum())


def both_caps(d: int, a: float, cosine: float) -> float:
    """Share of directions that exceed `a` for both of two vectors at the given cosine."""
    x = np.linspace(-1, 1, 4001)[1:-1]
    w = (1 - x * x) ** ((d - 3) / 2) if d > 2 else np.ones_like(x)
    w /= w.sum()
    total, sine = 0.0, math.sqrt(1 - cosine * cosine)
    for value, weight in zip(x[x >= a], w[x >= a], strict=True):
        need = (a - cosine * value) / (sine * math.sqrt(max(1e-12, 1 - value * value)))
        total += weight * (1.0 if need <= -1 else 0.0 if need >= 1 else cap_table(max(1, d - 1), need))
    return total


_tables: dict[int, np.ndarray] = {}


def cap_table(d: int, a: float) -> float:
    if d not in _tables:
        _tables[d] = np.array([cap(d, b) for b in np.linspace(-1, 1, 401)])
    return float(np.interp(a, np.linspace(-1, 1, 401), _tables[d]))


class CapFilters:
    """Tables of product codes and the threshold for n vectors of d components."""

    def __init__(self, d: int, n: int, bound: float = BOUND, recall: float = RECALL, crowd: float = CROWD):
        a = 0.02
        while a < 0.9 and n * cap(d, a) > crowd:
            a += 0.01
        directions = max(4.0, SHARED / max(both_caps(d, a, bound), 1e-300))
        blocks = min(d, max(2, math.ceil(math.log(directions) / math.log(MOST_CODE))))
        self._shape(d, a, blocks, math.ceil(directions ** (1 / blocks)))
        one, two = self._pairs_at(d, bound)
        met = np.zeros(TRIALS, bool)
        while met.mean() < recall:
            self._add()
            (i, x), (j, y) = self._table(len(self.tables) - 1, one), self._table(len(self.tables) - 1, two)
            met[np.intersect1d(i * self.each + x, j * self.each + y) // self.each] = True

    def _shape(self, d: int, threshold: float, blocks: int, size: int) -> None:
        self.d, self.threshold, self.blocks, self.size, self.each = d, threshold, blocks, size, size**blocks
        self.parts = np.array_split(np.arange(d), blocks)
        self.tables: list[tuple[np.ndarray, list[np.ndarray]]] = []

    @classmethod
    def again(cls, d: int, threshold: float, blocks: int, size: int, tables: int) -> CapFilters:
        code = cls.__new__(cls)
        code._shape(d, threshold, blocks, size)
        for _ in range(tables):
            code._add()
        return code

    def __reduce__(self):
        """Tasks get five numbers and draw the same tables again."""
        return CapFilters.again, (self.d, self.threshold, self.blocks, self.size, len(self.tables))

    @staticmethod
    def _pairs_at(d: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([SEED, d])
        u, w = (_unit(rng.standard_normal((TRIALS, d))) for _ in range(2))
        if d == 1:
            return u, u
        w = _unit(w - (w * u).sum(axis=1, keepdims=True) * u)
        return u, bound * u + math.sqrt(1 - bound * bound) * w

    def _add(self) -> None:
        rng = np.random.default_rng([SEED, self.d, len(self.tables)])
        turn, _ = np.linalg.qr(rng.standard_normal((self.d, self.d)))
        codes = [_unit(rng.standard_normal((self.size, len(p)))) / math.sqrt(self.blocks) for p in self.parts]
        self.tables.append((turn, codes))

    def _table(self, number: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) of all directions of one table that unit vectors exceed."""
        turn, codes = self.tables[number]
        turned = vectors @ turn
        scores = [turned[:, p] @ c.T for p, c in zip(self.parts, codes, strict=True)]
        best = np.cumsum([s.max(axis=1) for s in reversed(scores)], axis=0)[::-1]
        row, total, found = np.arange(len(vectors)), np.zeros(len(vectors)), np.zeros(len(vectors), np.int64)
        for b, s in enumerate(scores):
            need = self.threshold - (best[b + 1][row] if b + 1 < self.blocks else 0.0) - total
            step = max(1, CELLS // self.size)
            hits = [np.nonzero(s[row[at : at + step]] >= need[at : at + step, None]) for at in range(0, len(row), step)]
            i = np.concatenate([x + k * step for k, (x, _) in enumerate(hits)]) if hits else row
            code = np.concatenate([y for _, y in hits]) if hits else row
            total, found, row = total[i] + s[row[i], code], found[i] * self.size + code, row[i]
        return row, found

    def decode(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the numbers of all directions that exceed the threshold, ascending."""
        pairs = [(row, k * self.each + found) for k in range(len(self.tables)) for row, found in [self._table(k, vectors)]]
        row, found = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        order = np.lexsort((found, row))
        return np.split(found[order], np.cumsum(np.bincount(row, minlength=len(vectors)))[:-1])


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, k1, k2), (classes: cid, k1, k2, least, n, v) of the vectors that can link. Keys are 128 bits of hashes."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", "v").withColumns({"k1": F.when(usable, F.xxhash64("v")), "k2": F.when(usable, F.xxhash64(F.lit(1), "v"))})
    rows, _ = written(rows, "vectors")
    classes = rows.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes, _ = written(classes.select(F.monotonically_increasing_id().alias("cid"), "*"), "vector-classes")
    return rows.select("vec_id", "k1", "k2"), classes


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(vectors: pa.Array, d: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def sketches(u: np.ndarray) -> np.ndarray:
    """Unit vectors as rows of one-byte numbers, longer ones projected to `SKETCH` components."""
    d = u.shape[1]
    if d > SKETCH:
        turn, _ = np.linalg.qr(np.random.default_rng([SEED, d, SKETCH]).standard_normal((d, SKETCH)))
        u = u @ turn
    most = np.maximum(np.abs(u).max(axis=1, keepdims=True), 1e-300)
    return np.rint(u * (127 / most)).astype(np.int8)


def sketch_bound(k: int, bound: float) -> float:
    """The least cosine that sketches of k components can have for vectors at the bound."""
    if k == SKETCH:
        bound -= 6 * (1 - bound * bound) / math.sqrt(k)
    # Rounding moves a vector by at most half a unit a component, while its length is at least 127 units.
    return math.cos(min(math.pi, math.acos(max(-1.0, bound)) + 2 * math.asin(min(1.0, math.sqrt(k) / 254)))) - 1e-5


def listed(classes: DataFrame, codes: dict[int, CapFilters]) -> DataFrame:
    """cid, the numbers of the filters that each class exceeds (those of different vector lengths never agree), and its sketch."""
    first, start = {}, 0
    for d, code in sorted(codes.items()):
        first[d], start = start, start + len(code.tables) * code.each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes = np.array([len(x) for x in part.column("v")])
                for d in np.unique(sizes).tolist():
                    mine = part.filter(pa.array(sizes == d))
                    u = _unit(_matrix(mine.column("v"), d))
                    found = codes[d].decode(u)
                    lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), pa.array(np.concatenate(found) + first[d]))
                    small = pa.array([x.tobytes() for x in sketches(u)], pa.binary())
                    yield pa.RecordBatch.from_arrays([mine.column("cid"), lists, small], names=["cid", "filters", "sketch"])

    return classes.select("cid", "v").mapInArrow(run, "cid long, filters array<long>, sketch binary")


PLACE = ["filter", "x", "y", "slab"]


def dealt(lists: DataFrame, slab: int) -> DataFrame:
    """One row for each class and filter it exceeds: filter, x, y (slabs; 0, 0 where there is one), slab, cid, sketch.

    Filters with more than `slab` classes are found from ids alone.
    """
    met = lists.select("cid", F.explode("filters").alias("filter"))
    sizes, _ = written(met.groupBy("filter").agg(F.count("*").alias("size")).filter(F.col("size") > slab), "crowded-filters")
    parts = F.ceil(F.col("size") / slab).cast("int").alias("parts")
    crowded = met.join(sizes.select("filter", parts), "filter").groupBy("cid").agg(F.map_from_entries(F.collect_list(F.struct("filter", "parts"))).alias("crowded"))
    rows = lists.join(crowded, "cid", "left").select("cid", "sketch", F.explode("filters").alias("filter"), "crowded")
    rows = rows.select("cid", "sketch", "filter", F.coalesce(F.try_element_at("crowded", "filter"), F.lit(1)).alias("parts"))
    own = F.pmod(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)), F.col("parts")).cast("int")
    rows = rows.select("cid", "sketch", "filter", own.alias("slab"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return rows.select("filter", F.least("slab", "other").alias("x"), F.greatest("slab", "other").alias("y"), "slab", "cid", "sketch")


def _pairs(u: np.ndarray, starts: np.ndarray, ends: np.ndarray, bound: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of rows of the same group whose product reaches the bound."""
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        for low in range(a, b, 512):
            i, j = np.nonzero(u[low : min(low + 512, b)] @ u[low:b].T >= bound)
            keep = i < j
            if keep.any():
                yield i[keep] + low, j[keep] + low


def _owns(filters: np.ndarray, a: np.ndarray, b: np.ndarray, shared: np.ndarray, starts: np.ndarray, ends: np.ndarray, owned: np.ndarray, span: int) -> np.ndarray:
    """Whether no lesser filter than the pair's own is exceeded by both. Filters of `a` are tried in ascending order; near pairs end at once."""
    out = np.zeros(len(a), bool)
    left, at = np.arange(len(a)), starts[a]
    while len(left):
        value = shared[np.minimum(at, len(shared) - 1)]
        over = (at >= ends[a[left]]) | (value >= filters[left])
        out[left[over]] = True
        left, at, value = left[~over], at[~over], value[~over]
        key = b[left] * span + value
        miss = owned[np.minimum(np.searchsorted(owned, key), len(owned) - 1)] != key
        left, at = left[miss], at[miss] + 1
    return out


def _changes(t: pa.RecordBatch) -> np.ndarray:
    """Where groups (filter, x, y) begin, but for the first."""
    f, x, y = (t.column(c).to_numpy() for c in ("filter", "x", "y"))
    return np.flatnonzero((f[1:] != f[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1


def _grouped(solve):
    """An Arrow function that calls solve with whole groups (filter, x, y), about `RUN` rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in batches:
            rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            cuts, start = _changes(rows), 0
            for k, cut in enumerate(cuts):
                if cut - start >= RUN or k == len(cuts) - 1:
                    if (out := solve(rows.slice(start, cut - start))) is not None:
                        yield out
                    start = int(cut)
            rest = rows.slice(start)
        if rest is not None and rest.num_rows and (out := solve(rest)) is not None:
            yield out

    return run


def _near_in_groups(t: pa.RecordBatch, sizes: np.ndarray, unit, bound) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one group whose cosine reaches bound(size); unit(at, size) gives the rows' unit vectors."""
    x, y, slab = (t.column(c).to_numpy() for c in ("x", "y", "slab"))
    groups = np.cumsum(np.bincount(_changes(t), minlength=t.num_rows))
    pairs = []
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        mine = groups[at]
        ends = np.append(np.flatnonzero(mine[1:] != mine[:-1]) + 1, len(at))
        for i, j in _pairs(unit(at, d), np.concatenate([[0], ends[:-1]]), ends, bound(d)):
            i, j = at[i], at[j]
            # In a group of two slabs only pairs across them count: each slab has a group of its own.
            keep = (x[i] == y[i]) | (slab[i] != slab[j])
            pairs.append((i[keep], j[keep]))
    return tuple(np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))


def _near_sketches(t: pa.RecordBatch, bound: float) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x.as_buffer()) for x in t.column("sketch")])

    def unit(at: np.ndarray, k: int) -> np.ndarray:
        rows = b"".join(memoryview(t.column("sketch")[int(i)].as_buffer()) for i in at)
        u = np.frombuffer(rows, np.int8).reshape(-1, k).astype(np.float32)
        return u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1)

    return _near_in_groups(t, sizes, unit, lambda k: sketch_bound(k, bound))


def _owned(t: pa.RecordBatch, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that meet here first, i and j, with the numbers of their classes, a and b, and the ids that those stand for."""
    cid, group = t.column("cid").to_numpy(), t.column("filter").to_numpy()
    # Filter lists are unpacked for the classes with pairs only.
    ids, first, where = np.unique(cid, return_index=True, return_inverse=True)
    linked = np.unique(np.concatenate([where[i], where[j]]))
    number = np.full(len(ids), -1)
    number[linked] = np.arange(len(linked))
    lists = [t.column("filters")[int(first[k])].values.to_numpy(zero_copy_only=False) for k in linked]
    ends = np.cumsum([len(x) for x in lists])
    starts = np.concatenate([[0], ends[:-1]])
    shared = np.concatenate(lists)
    span = int(shared.max()) + 1
    owned = np.repeat(np.arange(len(linked)), ends - starts) * span + shared  # ascending, since each list is
    a, b = number[where[i]], number[where[j]]
    own = _owns(group[i], a, b, shared, starts, ends, owned, span)
    return i[own], j[own], a[own], b[own], ids[linked]


def _stay(bound: float, owners: bool):
    """Rows (filter, x, y, slab, cid) that have a near sketch in their group, with `owners` in the first that both stay in."""

    def solve(t: pa.RecordBatch) -> pa.RecordBatch | None:
        i, j = _near_sketches(t, bound)
        if owners and len(i):
            i, j, *_ = _owned(t, i, j)
        return t.select([*PLACE, "cid"]).take(pa.array(np.unique(np.concatenate([i, j])))) if len(i) else None

    return _grouped(solve)


def _verify(bound: float):
    from pingmill.llm.simhash import unite

    def solve(t: pa.RecordBatch) -> pa.RecordBatch | None:
        n = t.column("n").to_numpy()
        sizes = np.array([len(v) for v in t.column("v")])
        i, j = _near_in_groups(t, sizes, lambda at, d: _unit(_matrix(t.column("v").take(pa.array(at)), d)), lambda d: bound)
        if not len(i):
            return None
        i, j, a, b, names = _owned(t, i, j)
        links = np.bincount(a, n[j], len(names)) + np.bincount(b, n[i], len(names))
        parent = unite(np.arange(len(names)), a, b)
        touched = np.flatnonzero(links)
        if not len(touched):
            return None
        return pa.RecordBatch.from_arrays([pa.array(names[touched]), pa.array(names[parent[touched]]), pa.array(links[touched].astype(np.int64))], names=["a", "b", "links"])

    return _grouped(solve)


def _placed(places: DataFrame, by_class: DataFrame) -> DataFrame:
    """Rows of by_class (cid, ...) in all their places (filter, x, y, slab, cid); each row meets its places once, before they are dealt."""
    held = places.groupBy("cid").agg(F.collect_list(F.struct(*PLACE)).alias("places"))
    return by_class.join(held, "cid").select(F.explode("places").alias("p"), *by_class.columns).select("p.*", *by_class.columns)


def links_between(lists: DataFrame, classes: DataFrame, bound: float = BOUND, slab: int = SLAB) -> DataFrame:
    """a, b (an edge of a forest) and the links that a counts, of classes that meet in a filter and reach the bound."""
    spark = lists.sparkSession
    keys, count = ["filter", "x", "y"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    apart = lambda rows: rows.repartition(count, *keys).sortWithinPartitions(*keys)
    kind = "filter long, x int, y int, slab int, cid long"
    stay, first = written(apart(dealt(lists, slab)).mapInArrow(_stay(bound, False), kind), "near-sketches")
    shared = stay.groupBy("cid").agg(F.array_sort(F.collect_set("filter")).alias("filters"))
    shared, held = written(shared.join(lists.select("cid", "sketch"), "cid"), "near-lists")
    own, second = written(apart(_placed(stay, shared)).mapInArrow(_stay(bound, True), kind), "owned-places")
    whole = shared.select("cid", "filters").join(classes.select("cid", "n", "v"), "cid")
    found, _ = written(apart(_placed(own, whole)).mapInArrow(_verify(bound), "a long, b long, links long"), "links")
    for path in (first, held, second):
        discard(spark, path)
    return found


def near(vectors: DataFrame, bound: float = BOUND, recall: float = RECALL, slab: int = SLAB) -> DataFrame:
    """vec_id, n_links, component_id for every row of vectors(vec_id, v)."""
    spark = vectors.sparkSession
    ship(spark)
    rows, classes = classes_of(vectors)
    lengths = classes.groupBy(F.size("v").alias("d")).count().collect()  # one row for each vector length
    codes = {r["d"]: CapFilters(r["d"], r["count"], bound, recall) for r in lengths}
    lists, held = written(listed(classes, codes), "filter-lists")
    found = links_between(lists, classes, bound, slab)
    discard(spark, held)
    links = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    labels = components(found.filter("a <> b").select("a", "b")).withColumnRenamed("node", "cid")
    by_class = classes.select("cid", "k1", "k2", "n", "least").join(links, "cid", "left").join(labels, "cid", "left")
    by_class, _ = written(by_class.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "cid").alias("label"), "least"), "linked-classes")
    tops = by_class.groupBy("label").agg(F.min("least").alias("component_id"))
    by_key, _ = written(by_class.join(tops, "label").select("k1", "k2", "n_links", "component_id"), "vector-results")
    # Vectors that link with nothing have no key; they stay out of the join, as would any null.
    linked = rows.filter("k1 IS NOT NULL").join(by_key, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("k1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone)


def op7(spark, sf_dir: str) -> DataFrame:
    out = near(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")) & F.col("vec_id").isNotNull())


#: All pairs, for small tables: exact links, and components by walking them. Recall of the operator is measured against this in the tests.
ORACLE = """
WITH RECURSIVE u AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND list_count(embedding) = len(embedding) AND isfinite(list_sum(CAST(embedding AS DOUBLE[]))) AND list_min(embedding) > '-infinity'::FLOAT
    AND list_max(embedding) < 'infinity'::FLOAT AND (list_min(embedding) <> 0 OR list_max(embedding) <> 0)),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.c),
k AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT k.vec_id, coalesce(n_links, 0) AS n_links, component_id, k.vec_id = component_id AS kept FROM k LEFT JOIN n ON n.vec_id = k.vec_id
"""
