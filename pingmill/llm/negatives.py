"""Hard-negative mining by Fagin's threshold algorithm.

Vectors become integers (floor of 256 times each component), so scores are exact. Each anchor searches all rows twice: for its
positives (the best rows of its label), then, for each of those, for the best rows of other labels whose score lies in the window
that the positive's score spans. Both searches are the same algorithm:

1. Rows are range-sorted by label into shards of bounded size, and anchors are dealt into batches of bounded size; a task holds one
   shard and one batch, so a label with a third of all rows lies over many shards and no task grows with the table. The anchors are
   a stated set that meets all rows in blocks; nothing else is paired. Anchors look for positives only in shards of their label.
2. A shard keeps a candidate list sorted by value for every dimension (`Lists`). An anchor reads the lists side by side, from the top
   where its component is positive and from the bottom where it is negative; every row met is scored whole by random access.
3. The sum of the anchor's components times the values reached in the lists bounds the score of all rows not met. An anchor stops once
   that threshold is strictly below the k-th best score of each of its windows (rows not met cannot even tie, and ties go by id), or
   below the least score that a window admits. Scores above a window's upper end are met and passed over.
4. The best k of each shard meet by anchor and window, and the best k of those are the result.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite component take no part; shorter vectors
count as if zeros followed; rows of equal id are rows of their own (each may be another's positive, and as anchors each has its own
result); ties go to the smaller id; a negative positive score has an empty window, and a zero one admits only zero; a label without
other rows has no positives and no result; an empty table gives an empty result; components beyond 64 bits are held to them, and so
are scores; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pingmill.llm.common import ship, table, written

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score is at least and at most this many hundredths of the positive's.
LOWER, UPPER = 50, 95
#: Components of a task's shard, and of its anchors (these bound the rows), and how far the lists are read at first.
SHARD_CELLS, BATCH_CELLS, STEP = 1 << 21, 1 << 20, 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def scaled(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))


def usable(vectors: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """id, label, v (integers) of the rows that take part."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), scaled(F.col(vector)).alias("v"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as rows of `width`, zeros behind the shorter ones."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width) < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Lists:
    """A shard: rows with ids and labels, and for each dimension the rows in the order of their values."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.row, self.ids, self.labels, self.v = row, ids, labels, v
        self.order = np.argsort(v, axis=0, kind="stable").T.astype(np.int32)
        self.largest = int(np.abs(v.astype(np.float64)).max(initial=0))
        self.exact = v.astype(np.float64)  # used while sums stay exact in it

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int, count: list[int] | None = None) -> list[list[tuple[int, int]]]:
        """For each window (least, most score) the best k allowed rows as (score, index), ties by id. count: gets the rows scored."""
        n, dims = len(self.ids), np.flatnonzero(anchor)
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        if not windows or not allowed.any():
            return best
        small = self.largest * float(np.abs(anchor.astype(np.float64)).max(initial=0)) * anchor.size < 2**53
        v, a = (self.exact, anchor.astype(np.float64)) if small else (self.v.astype(object), anchor.astype(object))
        up, order = anchor[dims] > 0, self.order[dims]
        met = np.zeros(n, bool)
        depth, step = 0, STEP
        while True:
            upto = min(n, depth + step) if len(dims) else n
            new = ~met
            if upto < n:
                reached = np.zeros(n, bool)
                reached[order[up, n - upto : n - depth]] = True
                reached[order[~up, depth:upto]] = True
                new &= reached
            met |= new
            if count is not None:
                count.append(int(new.sum()))
            at = np.flatnonzero(new & allowed)
            scores = v[at] @ a
            scores = np.minimum(np.maximum(scores, LEAST), MOST) if not small else scores.astype(np.int64)
            last = order[np.arange(len(dims)), np.where(up, n - upto, upto - 1)]
            threshold = int(v[last, dims] @ a[dims]) if len(dims) else 0
            done = upto == n
            going = False
            for w, (least, most) in enumerate(windows):
                inside = np.flatnonzero((scores >= least) & (scores <= most))
                if len(best[w]) == k and len(inside):  # only what can still enter
                    inside = inside[scores[inside] >= best[w][-1][0]]
                if len(inside) > k:
                    inside = inside[np.lexsort((self.row[at[inside]], self.ids[at[inside]], -scores[inside] if small else np.array([-x for x in scores[inside]], object)))[:k]]
                if len(inside):
                    both = best[w] + [(int(scores[x]), int(at[x])) for x in inside]
                    best[w] = sorted(both, key=lambda x: (-x[0], self.ids[x[1]], self.row[x[1]]))[:k]
                going = going or not (threshold < least or (len(best[w]) == k and threshold < best[w][-1][0]))
            if done or not going:
                return best
            depth, step = upto, 2 * step


def _meet(rows: DataFrame, anchors: DataFrame, batches: int, width: int, found: Callable, schema: str) -> DataFrame:
    """Runs found(Lists, anchors) in a task for each shard and batch of anchors(shard, row, ...)."""
    left = rows.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    right = anchors.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int"))

    def run(shard: pa.Table, mine: pa.Table) -> pa.Table:
        n = lambda t, c: t.column(c).to_numpy()
        out = []
        if shard.num_rows and mine.num_rows:
            lists = Lists(n(shard, "row"), n(shard, "id"), n(shard, "label"), matrix(shard.column("v"), width))
            out = list(found(lists, mine, matrix(mine.column("_v"), width)))
        columns = list(zip(*out, strict=True)) if out else [[] for _ in schema.split(",")]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in schema.split(",")])

    right = right.select(*(F.col(c).alias(f"_{c}") for c in right.columns))  # both sides stem from one table
    return left.groupBy("shard", "batch").cogroup(right.groupBy("_shard", "_batch")).applyInArrow(run, schema)


def _best(rows: DataFrame, keys: list[str], score: str, order: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(score).desc(), *order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER) -> DataFrame:
    """rows(id, label, v) to anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor: a condition on id."""
    spark = rows.sparkSession
    ship(spark)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)
    shards = max(1, -(-n * width // SHARD_CELLS))
    sorted_rows = rows.repartitionByRange(shards, "label", F.xxhash64("id")).sortWithinPartitions("label", "id").withColumn("row", F.monotonically_increasing_id())
    rows, _ = written(sorted_rows.withColumn("shard", F.shiftright("row", 33)), "vectors")
    anchors = rows.filter(is_anchor).drop("shard")
    batches, shards = rows.agg(F.count_if(is_anchor), F.coalesce(F.max("shard"), F.lit(0)) + 1).first()
    batches = max(1, -(-batches * width // BATCH_CELLS))

    def find_positives(lists: Lists, mine: pa.Table, v: np.ndarray):
        for row, label, vector in zip(mine.column("_row").to_pylist(), mine.column("_label").to_pylist(), v, strict=True):
            allowed = (lists.labels == label) & (lists.row != row)
            for score, at in lists.search(vector, allowed, [(LEAST, MOST)], positives)[0]:
                yield row, int(lists.row[at]), int(lists.ids[at]), score

    where = rows.select("label", "shard").distinct()
    found = _meet(rows, anchors.join(where, "label"), batches, width, find_positives, "row long, positive_row long, positive_id long, positive_score long")
    found = _best(found, ["row"], "positive_score", ["positive_id", "positive_row"], positives)
    windows = found.groupBy("row").agg(F.collect_list(F.struct("rank", "positive_id", "positive_score")).alias("positives"))

    def find_negatives(lists: Lists, mine: pa.Table, v: np.ndarray):
        for row, label, group, vector in zip(*(mine.column(f"_{c}").to_pylist() for c in ("row", "label", "positives")), v, strict=True):
            spans = [(-(-lower * p["positive_score"] // 100), upper * p["positive_score"] // 100) for p in group]
            kept = [w for w, (least, most) in enumerate(spans) if least <= most]
            got = lists.search(vector, lists.labels != label, [spans[w] for w in kept], negatives)
            for w, best in zip(kept, got, strict=True):
                for score, at in best:
                    yield row, group[w]["rank"], int(lists.row[at]), int(lists.ids[at]), score

    asking, _ = written(anchors.join(windows, "row"), "anchors")
    everywhere = asking.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = _meet(rows, everywhere, batches, width, find_negatives, "row long, window long, negative_row long, negative_id long, negative_score long")
    found = _best(found, ["row", "window"], "negative_score", ["negative_id", "negative_row"], negatives)
    names = asking.select("row", F.col("id").alias("anchor_id"), F.explode("positives").alias("p")).select("row", "anchor_id", F.col("p.rank").cast("long").alias("window"), "p.positive_id", "p.positive_score")
    return found.join(names, ["row", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(rows.withColumn("label", noisy)), F.col("id") % 50 == 0)


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
