"""Merkle dataset manifest with octopus multiproofs.

The manifest. Every row is a leaf; leaves of one group (here: source) ascend in a tree in which every `ARITY` consecutive nodes
become the hash of their concatenated digests (as hex text; the last run of a level may be shorter), and the groups' roots, in the
groups' order, are the leaves of one more tree. Leaves are range-sorted once, so a group of any size lies over many tasks and small
groups share one; positions come from counts by file and group. Trees are built in blocks of `ARITY ** LEVELS` nodes: one exchange
climbs LEVELS levels. All nodes are kept as a table (tree, level, place, digest), so any later session proves rows from it.

The proofs. Wanted leaves are dealt into parts of bounded size. Each part works out the least set of node coordinates that it can
neither hash from its own leaves nor do without (`missing`); all parts' coordinates meet the node table in one join, so a part
fetches each node once; it then derives the shared inner nodes and expands the proofs of its leaves one by one (`Octopus`). What a
part derives as root must equal the manifest's root, else a ValueError says so.

Defined results: a null field is hashed as `-`, so it differs from an empty one; null groups and null ids come first; rows of equal
id follow each other by digest, and equal rows give equal results at neighbouring places (they share a row's digest, not its proof);
texts are hashed by the JVM where they lie, whole and never moved; a group of one leaf has that leaf as its root; an empty table has
no root and gives an empty result; extra columns are not read, so none can clash. Digests are strings of lowercase hex where they
are returned, and 32 bytes where they travel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pingmill.llm.common import ship, table, union_all, written

ARITY, LEVELS, PART = 3, 6, 2048
#: Number of the tree over the groups' roots.
TOP = -1
_NODE = "tree long, level int, place long, size long, digest binary"


def digest(fields: list[Column]) -> Column:
    """SHA-256 (32 bytes) of fields, each as `-` for null, else its length in UTF-8 bytes, a colon and the value."""
    said = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.unhex(F.sha2(F.concat(*said).cast("binary"), 256))


def _hash(parts: list[bytes]) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


# ---- places


def number(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, int, int]:
    """rows with tree (its group's number, null first), size (rows of the group), position in the group and rank among all rows;
    then the number of groups and the size of the largest.

    Rows (digests, not texts) are written first, since range-sorting reads its input twice, and range-sorted into files once. The rest needs only one count a file and group: sums over the files of a group (at most
    the number of range partitions) and over the files (as many).
    """
    keys = [group, *order]
    narrow, _ = written(rows.withColumn("_tie", F.monotonically_increasing_id()), "digests")
    dealt = narrow.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    held, _ = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "leaves")
    file = F.shiftright("_at", 33)
    runs = held.groupBy(file.alias("_file"), F.col(group).alias("_group")).agg(F.count("*").alias("_k"), F.min("_at").alias("_first"))
    earlier = W.partitionBy("_group").orderBy("_file")
    runs = runs.withColumns({
        "_before": F.coalesce(F.sum("_k").over(earlier.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "size": F.sum("_k").over(W.partitionBy("_group")),
        "_starts": (F.row_number().over(earlier) == 1).cast("long"),
    })
    runs, _ = written(runs, "runs")
    last = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)  # a row a range partition
    files = runs.groupBy("_file").agg(F.sum("_k").alias("_rows"), F.sum("_starts").alias("_trees"))
    files = files.select("_file", *(F.coalesce(F.sum(c).over(last), F.lit(0)).alias(c) for c in ("_rows", "_trees")))
    in_file = W.partitionBy("_file").orderBy("_group").rowsBetween(W.unboundedPreceding, 0)
    numbers = runs.join(files, "_file").withColumn("tree", F.col("_trees") + F.sum("_starts").over(in_file) - 1)
    numbers, _ = written(numbers.select("_file", "_group", "_first", "_before", "_rows", "size", "tree"), "numbers")
    trees, largest = numbers.agg(F.coalesce(F.max("tree") + 1, F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    out = held.join(numbers, (file == F.col("_file")) & F.col(group).eqNullSafe(F.col("_group")))
    rank = F.col("_at") - F.shiftleft("_file", 33) + F.col("_rows")
    return out.select(*rows.columns, "tree", "size", (F.col("_at") - F.col("_first") + F.col("_before")).alias("position"), rank.alias("rank")), trees, largest


# ---- trees


def _climb(level: int):
    """Blocks of a level's nodes, each sorted by place, to all nodes of the next LEVELS levels, up to a tree's last."""

    def block_nodes(tree: int, block: int, size: int, nodes: list[bytes]) -> Iterator[tuple]:
        nodes = [x.hex().encode() for x in nodes]
        for k in range(1, LEVELS + 1):
            if size == 1:
                return
            nodes = [_hash(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
            size = -(-size // ARITY)
            first = block * ARITY ** (LEVELS - k)
            for i, x in enumerate(nodes):
                yield tree, level + k, first + i, size, bytes.fromhex(x.decode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        key = None
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        made: list[tuple] = []

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["tree", "level", "place", "size", "digest"])
            made.clear()
            return got

        for batch in batches:
            tree, block, size = (batch.column(c).to_numpy() for c in ("tree", "block", "size"))
            digests = batch.column("digest")
            cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tree)], strict=True):
                if a == b:
                    continue
                now = int(tree[a]), int(block[a]), int(size[a])
                if key is not None and now != key:
                    made.extend(block_nodes(*key, held))
                    held = []
                key = now
                held += digests.slice(a, b - a).to_pylist()
                if len(made) > 20_000:
                    yield out()
        if key is not None:
            made.extend(block_nodes(*key, held))
        if made:
            yield out()

    return run


def _levels(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """All nodes above nodes(tree, level 0, place, size, digest) of trees of at most `largest` leaves: one written table a LEVELS levels."""
    found, level = [], 0
    while largest > 1:
        blocks = nodes.withColumn("block", F.expr(f"place div {ARITY**LEVELS}")).select("tree", "block", "size", "place", "digest")
        above = blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "place").mapInArrow(_climb(level), _NODE)
        above, _ = written(above, "nodes")
        found.append(above)
        level, largest = level + LEVELS, -(-largest // ARITY**LEVELS)
        nodes = above.filter((F.col("level") == level) & (F.col("size") > 1))
    return found


@dataclass
class Manifest:
    """leaves: the given rows with tree, size, position, rank; nodes(tree, level, place, digest) of all trees, leaves included; the
    tree over `trees` groups is number -1; root: hex, None without rows."""

    leaves: DataFrame
    nodes: DataFrame
    trees: int
    root: str | None


def build(rows: DataFrame, group: str, order: list[str], leaf: str = "leaf") -> Manifest:
    """The manifest of rows with a digest column of 32 bytes. rows must not have columns tree, size, position or rank."""
    ship(rows.sparkSession)
    leaves, trees, largest = number(rows, group, [*order, leaf])
    base = leaves.select("tree", F.lit(0).alias("level"), F.col("position").alias("place"), "size", F.col(leaf).alias("digest"))
    inner = _levels(base, largest)
    roots = union_all([x.filter("size = 1") for x in (base, *inner)])
    roots, _ = written(roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("place"), F.lit(trees).cast("long").alias("size"), "digest"), "subroots")
    upper = _levels(roots, trees)
    nodes = union_all([base, *inner, roots, *upper])
    top = (upper[-1] if upper else roots).filter("size = 1").select("digest").first()
    return Manifest(leaves, nodes.select("tree", "level", "place", "digest"), trees, top and bytes(top[0]).hex())


# ---- proofs


def missing(places: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, places) of the nodes that the proofs of the given leaves of a tree need and that those leaves do not give: at every
    level the other members of the runs that hold a known node."""
    level, known = 0, np.unique(places)
    while size > 1:
        runs = np.unique(known // ARITY)
        members = (runs[:, None] * ARITY + np.arange(ARITY)).ravel()
        yield level, np.setdiff1d(members[members < size], known, assume_unique=True)
        level, known, size = level + 1, runs, -(-size // ARITY)


class Octopus:
    """One part's nodes of one tree: shared inner nodes from its leaves and the fetched nodes, and each leaf's way to the root."""

    def __init__(self, leaves: dict[int, bytes], size: int, fetched: dict[tuple[int, int], bytes]):
        known, levels, level = leaves, [], 0
        while size > 1:
            have = lambda p: known[p] if p in known else fetched[level, p]  # noqa: B023, E731
            above: dict[int, bytes] = {}
            beside: dict[int, tuple[bytes, bytes]] = {}
            for run in {p // ARITY for p in known}:
                members = range(run * ARITY, min(run * ARITY + ARITY, size))
                digests = [have(p) for p in members]
                above[run] = _hash(digests)
                for k, p in enumerate(members):
                    if p in known:
                        beside[p] = b"".join(digests[:k]), b"".join(digests[k + 1 :])
            levels.append(beside)
            known, size, level = above, -(-size // ARITY), level + 1
        (self.root,) = known.values()
        #: By level: place -> siblings to the left and to the right.
        self.levels = levels

    def ways(self, end: tuple = ()) -> dict[int, tuple]:
        """leaf -> ((left, right), ...) up to the root, then `end`; the upper parts are shared."""
        above: dict[int, tuple] | None = None
        for beside in reversed(self.levels):
            above = {p: ((pair,) + (above[p // ARITY] if above is not None else end)) for p, pair in beside.items()}
        return above if above is not None else {0: end}


def fold(leaf: bytes, way: tuple) -> bytes:
    for left, right in way:
        leaf = _hash([left, leaf, right])
    return leaf


def prove(manifest: Manifest, wanted: DataFrame, leaf: str = "leaf", shown: str | None = None, part: int = PART) -> DataFrame:
    """wanted (rows of manifest.leaves, all or some) with leaf (hex), subroot, root, proof_sha256 (of the siblings' digests, level by
    level, left to right), folded_root and verified: whether the digest in column `shown` (leaf, where that is null), folded with the
    leaf's true siblings, gives the root. The manifest's own columns are left out."""
    root, trees = (manifest.root or "").encode(), manifest.trees
    rest = [c for c in wanted.columns if c not in ("tree", "size", "position", "rank", leaf, shown)]
    rows = wanted.withColumn("_part", F.expr(f"rank div {part}"))
    ask = rows.select("_part", "tree", "size", "position")

    def coordinates(group: pa.Table) -> pa.Table:
        tree, size, place = (group.column(c).to_numpy() for c in ("tree", "size", "position"))
        out: list[tuple[int, int, np.ndarray]] = []
        numbers = np.unique(tree)
        for t in numbers.tolist():
            mine = tree == t
            out += [(t, level, x) for level, x in missing(place[mine], int(size[mine][0]))]
        out += [(TOP, level, x) for level, x in missing(numbers, trees)]
        n = [len(x) for _, _, x in out]
        return pa.table({
            "_part": pa.array(np.full(sum(n), group.column("_part")[0].as_py())),
            "tree": pa.array(np.repeat([t for t, _, _ in out], n).astype(np.int64)),
            "level": pa.array(np.repeat([k for _, k, _ in out], n).astype(np.int32)),
            "place": pa.array(np.concatenate([x for _, _, x in out]).astype(np.int64) if out else np.zeros(0, np.int64)),
        })

    asked = ask.groupBy("_part").applyInArrow(coordinates, "_part long, tree long, level int, place long")
    fetched = asked.join(manifest.nodes, ["tree", "level", "place"]).select("_part", "tree", "level", "place", "digest")
    texts = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = rows.select(*rest, *(F.lit("").alias(c) for c in texts), F.lit(True).alias("verified")).schema

    def expand(group: pa.Table, nodes: pa.Table) -> pa.Table:
        got: dict[int, dict] = {}
        for t, level, place, x in zip(*(nodes.column(c).to_pylist() for c in ("tree", "level", "place", "digest")), strict=True):
            got.setdefault(t, {})[level, place] = x.hex().encode()
        own: dict[int, dict[int, bytes]] = {}
        sizes: dict[int, int] = {}
        tree, size, place, digests = (group.column(c).to_pylist() for c in ("tree", "size", "position", leaf))
        for t, n, p, x in zip(tree, size, place, digests, strict=True):
            own.setdefault(t, {})[p] = x.hex().encode()
            sizes[t] = n
        made = {t: Octopus(mine, sizes[t], got.get(t, {})) for t, mine in own.items()}
        top = Octopus({t: x.root for t, x in made.items()}, trees, got.get(TOP, {}))
        if top.root != root:
            raise ValueError(f"the nodes of this part give the root {top.root.decode()}, not the manifest's")
        end = top.ways()
        ways = {t: x.ways(end[t]) for t, x in made.items()}
        tampered = group.column(shown).to_pylist() if shown else [None] * len(tree)
        out: list[list] = [[] for _ in texts]
        for t, p, x in zip(tree, place, tampered, strict=True):
            mine, way = own[t][p], ways[t][p]
            for column, value in zip(out, (mine, made[t].root, root, _hash([y for pair in way for y in pair]), fold(x.hex().encode() if x is not None else mine, way)), strict=True):
                column.append(value.decode())
        return pa.table([*(group.column(c) for c in rest), *(pa.array(c, pa.string()) for c in out), pa.array([x.encode() == root for x in out[-1]], pa.bool_())], names=[*rest, *texts, "verified"])

    return rows.groupBy("_part").cogroup(fetched.groupBy("_part")).applyInArrow(expand, schema)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    leaf, stripped = (digest([text if c == "text" else F.col(c) for c in FIELDS]) for text in (F.col("text"), F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, stripped)
    manifest = build(docs.select("doc_id", "source", leaf.alias("leaf"), tampered.alias("shown")), "source", ["doc_id"])
    return prove(manifest, manifest.leaves, shown="shown").drop("source")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT *, (list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384)))) AS c FROM documents),
h AS (
  SELECT doc_id, source, CASE WHEN xor(c, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shown_text,
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head, text FROM d),
l AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(octet_length(encode(shown_text)) || ':' || shown_text, '-')) AS shown FROM h),
p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
t AS (
  SELECT source, 0 AS level, pos AS place, leaf AS digest, n FROM p
  UNION ALL
  SELECT source, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY source, level, place // 3, n),
s AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, pos AS place, subroot AS digest, n FROM s
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY level, place // 3, n),
f AS (
  SELECT row_number() OVER () AS k, doc_id, source, leaf, pos, 0 AS level, n, shown AS cur, '' AS sibs FROM p
  UNION ALL
  SELECT f.k, f.doc_id, f.source, f.leaf, f.pos // 3, f.level + 1, (f.n + 2) // 3,
         sha256(string_agg(CASE WHEN t.place = f.pos THEN f.cur ELSE t.digest END, '' ORDER BY t.place)),
         f.sibs || coalesce(string_agg(CASE WHEN t.place <> f.pos THEN t.digest END, '' ORDER BY t.place), '')
  FROM f JOIN t ON t.source IS NOT DISTINCT FROM f.source AND t.level = f.level AND t.place // 3 = f.pos // 3
  WHERE f.n > 1 GROUP BY f.k, f.doc_id, f.source, f.leaf, f.pos, f.level, f.n, f.cur, f.sibs),
g AS (
  SELECT f.k, f.doc_id, f.leaf, s.subroot, s.pos, 0 AS level, s.n, f.cur, f.sibs FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source WHERE f.n = 1
  UNION ALL
  SELECT g.k, g.doc_id, g.leaf, g.subroot, g.pos // 3, g.level + 1, (g.n + 2) // 3,
         sha256(string_agg(CASE WHEN u.place = g.pos THEN g.cur ELSE u.digest END, '' ORDER BY u.place)),
         g.sibs || coalesce(string_agg(CASE WHEN u.place <> g.pos THEN u.digest END, '' ORDER BY u.place), '')
  FROM g JOIN u ON u.level = g.level AND u.place // 3 = g.pos // 3
  WHERE g.n > 1 GROUP BY g.k, g.doc_id, g.leaf, g.subroot, g.pos, g.level, g.n, g.cur, g.sibs)
SELECT doc_id, leaf, subroot, (SELECT digest FROM u WHERE n = 1) AS root, sha256(sibs) AS proof_sha256, cur AS folded_root,
       cur = (SELECT digest FROM u WHERE n = 1) AS verified
FROM g WHERE n = 1
"""
