"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Each source has a share of all words (its target) and a weight schedule that tells how fast its share is spent over curriculum time
0..1. The schedule's integral is the source's cumulative demand; inverting it at a document's place in its source's cumulative words
gives the time at which the document is due. The demand of all sources together is not even in time either, so its own integral
turns the time into the training position: the share of the mix's words that come before. Sorting by position range-partitions the
whole mix, and any stretch of positions holds its share of all words.

Defined results: a null or empty text has size 0, is given no words and never crashes a share; null sources are one source, sorted
last; equal (source, doc_id) rows are all kept, each with its own places (ordered among themselves by a hash of their texts); an
empty table gives an empty mix; columns of any other name, also ones that clash with names used here, pass through `schedule`
untouched; very long texts are counted where they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pingmill.llm.common import fresh, table, words, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_PASSES = 3
#: Slope of a source's schedule, by its rank: the first kind is front-loaded, the second even, the third back-loaded.
SLOPES = (-0.5, 0.0, 0.5)
#: Documents for each cell of the running sum, and cells for each block of cells.
CELL, BLOCK = 128, 1024
HASH_RANGE = 2**32


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = MOST_PASSES) -> DataFrame:
    """source, n_docs, source_size, rank, target, slope, drift for sizes(source, size); drift is the slope of all demand together.

    Capped water filling in closed form: with caps c and weights w, the level L solves sum(min(c, L w)) = total; sources in order
    of c / w are capped up to the first k at which (total - caps so far) / (weights left) fits below the next ratio.
    One row a source: the windows without keys below see the table of sources only, never documents.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    n = len(weights)
    per = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % n + 1).cast("int"))
    slope = F.element_at(F.array(*map(F.lit, SLOPES)), (F.col("rank") % len(SLOPES) + 1).cast("int"))
    per = per.withColumns({"w": weight, "slope": slope, "cap": F.col("source_size") * F.lit(float(cap))})
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), "rank")
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    caps = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("level", (total - caps) / rest)
    ratio = F.col("cap") / F.col("w")
    first = F.min(F.when(F.col("level") <= ratio, F.struct(ratio.alias("ratio"), "rank", "level"))).over(W.partitionBy())
    per = per.withColumn("level", first["level"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    per = per.withColumn("target", target)
    every = W.partitionBy()
    drift = F.coalesce(F.sum(F.col("target") * F.col("slope")).over(every) / F.nullif(F.sum("target").over(every), F.lit(0.0)), F.lit(0.0))
    return per.select("source", "n_docs", "source_size", "rank", "slope", "target", drift.alias("drift"))


def demand_inverse(place: Column, target: Column, slope: Column) -> Column:
    """Training time at which a source with weight schedule target * (1 + slope * (2t - 1)) has spent `place` words.

    The integral is target * ((1 - slope) t + slope t^2); its root in 0..1 is the answer.
    """
    x = F.when(target > 0, F.least(place / target, F.lit(1.0))).otherwise(0.0)
    root = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * x) - (1 - slope)) / F.when(slope != 0, 2 * slope)
    return F.coalesce(root, x)


def position(time: Column, drift: Column) -> Column:
    """Share of all words demanded before a time: the integral of the summed schedules, 1 + drift * (2t - 1)."""
    return F.abs(time + drift * (time * time - time))  # no negative zero


def order_key(doc_id: Column, text: Column) -> Column:
    """A hash in 0..2^32 of the id's text (of the document's, where there is no id): the order within a source, equal on every run
    and in any SQL engine with md5."""
    name = F.coalesce(doc_id.cast("string"), F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")


PLACE = "struct<pass:int,position:double>"


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = MOST_PASSES, row_id: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, placements array<struct<pass, position>>, h, row.

    A source at rate r = target / size takes all its documents floor(r) times, and once more those whose middle lies within the
    remaining words, so that it misses its target by half a document at most. The running sum has three levels (blocks of cells,
    cells, documents), so no task ever orders a whole source. row is docs' column `row_id`, if given.
    """
    row = F.col(row_id) if row_id else F.lit(None).cast("long")
    columns = [row.alias("row"), F.col("doc_id"), F.col("source"), words(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text")).alias("h"), F.xxhash64("text").alias("tie")]
    # Written once: the texts are read and counted a single time, and a lost executor costs a small table's partition.
    sizes, _ = written(docs.select(*columns), "sizes")
    goals, _ = written(source_targets(sizes, weights, cap), "targets")  # a plain table: the join's hot source can be split
    # A few dozen bytes a source: Spark broadcasts them by their measured size, or joins by key and splits the hot side.
    s, g = sizes.alias("s"), goals.alias("g")
    rows = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source")), "inner").select("s.*", "g.n_docs", "g.source_size", "g.target", "g.slope", "g.drift")
    cell = F.floor(F.col("h") * F.ceil(F.col("n_docs") / CELL) / HASH_RANGE)
    rows = rows.withColumn("cell", cell.cast("long")).withColumn("block", F.floor(F.col("cell") / BLOCK).cast("long"))
    cells = rows.groupBy("source", "block", "cell").agg(F.sum("size").alias("n"))
    blocks = cells.groupBy("source", "block").agg(F.sum("n").alias("n"))
    up_to = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("source", "block", F.coalesce(F.sum("n").over(up_to(W.partitionBy("source").orderBy("block"))), F.lit(0)).alias("before"))
    cells = cells.select("source", "block", "cell", F.coalesce(F.sum("n").over(up_to(W.partitionBy("source", "block").orderBy("cell"))), F.lit(0)).alias("before"))
    b, c = blocks.alias("b"), cells.alias("c")
    cells = c.join(b, F.col("c.source").eqNullSafe(F.col("b.source")) & (F.col("c.block") == F.col("b.block"))).select("c.source", "c.cell", (F.col("c.before") + F.col("b.before")).alias("before"))
    inside = F.coalesce(F.sum("size").over(up_to(W.partitionBy("source", "cell").orderBy("h", "doc_id", "size", "tie", "row"))), F.lit(0))
    rows = rows.withColumn("inside", inside)
    r, c = rows.alias("r"), cells.alias("c")
    rows = r.join(c, F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.cell") == F.col("c.cell"))).select("r.*", (F.col("r.inside") + F.col("c.before")).alias("place"))
    rate = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    full = F.floor(rate)
    more = (F.col("target") - full * F.col("source_size")) > F.col("place") + F.col("size") / 2.0
    rows = rows.withColumn("passes", F.when(F.col("size") > 0, F.least(full + more.cast("int"), F.lit(int(cap)))).otherwise(0).cast("int"))
    due = lambda k: demand_inverse((k - 1) * F.col("source_size") + F.col("place"), F.col("target"), F.col("slope"))
    places = F.transform(F.sequence(F.lit(1), F.greatest("passes", F.lit(1))), lambda k: F.struct(k.alias("pass"), position(due(k), F.col("drift")).alias("position")))
    places = F.when(F.col("passes") > 0, places).otherwise(F.array().cast(f"array<{PLACE}>"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), places.alias("placements"), "h", "row")


def schedule(docs: DataFrame, weights=WEIGHTS, cap: float = MOST_PASSES) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, range-sorted by training position over the whole output.

    The rows are numbered in a written copy, so that places are matched to rows by number and the texts move twice only: to their
    places, and into the order of the mix.
    """
    number, at, h = fresh(docs, "mix_row", "mix_at", "mix_h")
    numbered, _ = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    placed = mix(numbered, weights, cap, number).select(F.col("row").alias(number), F.explode("placements.position").alias(at), F.col("h").alias(h))
    joined = numbered.join(placed, number)
    return joined.repartitionByRange(at, h).sortWithinPartitions(at, h).select(*docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents, sorted by the training position of each one's first pass (documents not taken come last).

    positions names the position of every pass, to 9 digits, in order.
    """
    out = mix(table(spark, sf_dir, "documents")).withColumn("first_position", F.get("placements", F.lit(0))["position"])
    first = F.col("first_position").asc_nulls_last()
    named = F.array_join(F.transform("placements", lambda p: F.format_string("%.9f", p["position"])), " ")
    columns = ["doc_id", "size", "source_size", "target", "taken", F.round("first_position", 9).alias("first_position"), named.alias("positions")]
    return out.repartitionByRange(first, "h").sortWithinPartitions(first, "h").select(*columns)


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 8) AS BIGINT) AS h
  FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rnk FROM s GROUP BY source),
w AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
        CASE rnk % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope, source_size * 3.0::DOUBLE AS cap FROM p),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(w) OVER (ORDER BY cap / w, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
g AS (SELECT source, source_size, slope, least(cap, coalesce((SELECT lv FROM l WHERE lv <= cap / w ORDER BY cap / w, rnk LIMIT 1) * w, cap)) AS target FROM l),
d AS (SELECT coalesce(sum(target * slope) / nullif(sum(target), 0.0), 0.0) AS drift FROM g),
r AS (SELECT s.doc_id, s.size, g.source_size, g.target, g.slope, (SELECT drift FROM d) AS drift,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
      FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
n AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE CAST(least(3, floor(target / source_size)
         + CASE WHEN target - floor(target / source_size) * source_size > place + size / 2.0::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) END AS passes FROM r),
x AS (SELECT *, place / target AS x1, (source_size + place) / target AS x2, (2 * source_size + place) / target AS x3 FROM n),
t AS (SELECT * REPLACE (
        CASE WHEN passes < 1 THEN NULL WHEN slope = 0 THEN least(x1, 1.0) ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * least(x1, 1.0)) - (1 - slope)) / (2 * slope) END AS x1,
        CASE WHEN passes < 2 THEN NULL WHEN slope = 0 THEN least(x2, 1.0) ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * least(x2, 1.0)) - (1 - slope)) / (2 * slope) END AS x2,
        CASE WHEN passes < 3 THEN NULL WHEN slope = 0 THEN least(x3, 1.0) ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * least(x3, 1.0)) - (1 - slope)) / (2 * slope) END AS x3) FROM x),
o AS (SELECT * REPLACE (abs(x1 + drift * (x1 * x1 - x1)) AS x1, abs(x2 + drift * (x2 * x2 - x2)) AS x2, abs(x3 + drift * (x3 * x3 - x3)) AS x3) FROM t)
SELECT doc_id, size, source_size, target, size * passes AS taken, round(x1, 9) AS first_position,
       concat_ws(' ', CASE WHEN x1 IS NOT NULL THEN printf('%.9f', x1) END, CASE WHEN x2 IS NOT NULL THEN printf('%.9f', x2) END, CASE WHEN x3 IS NOT NULL THEN printf('%.9f', x3) END) AS positions
FROM o
"""
