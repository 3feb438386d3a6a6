"""SimHash near-dedup by a Gray-order hierarchical index.

Fingerprints are taken once each (exact copies meet in an aggregate) and sorted by Gray rank, which puts those with long common bit
patterns side by side. The sorted list is cut into `NODES` ranges of about equal size. Each range is a node of the index: a mask of
the bits on which all its fingerprints agree, and their pattern. Upper nodes stand for `FAN` lower ones and factor out the bits that
all of those share, so that a node keeps only the bits not told above it. Below a range its task builds the same tree down to single
fingerprints.

Every fingerprint descends the upper nodes with the sum of its differences so far; a whole group is pruned as soon as the sum
exceeds 3. It is sent to the ranges that it reaches beyond its own (a pair is met in the later range of the two), and descends their
trees in turn. So the index is exact for any data: what is sent and visited follows from the nodes reached, which are a few dozen
ranges for a fingerprint (1 + 10 + 45 + 120 of 1,024 at most where bits are random, half of them beyond its own).

The upper nodes are a table of at most `NODES` rows, which is all that every task gets. A range holds n / `NODES` fingerprints, and
a fingerprint has at most 43,744 others within 3 bits, so no hot group makes a task quadratic in n. Only spanning forests of links
leave a task, never all pairs.

Defined results: texts without a word (null, empty, white space) have fingerprint 0 and link like any other; rows of equal doc_id
are all kept and share a component; a component's id is its least non-null doc_id; null ids link but name no component unless
all are null; an empty table gives an empty result; very long texts are hashed in runs of bounded size; extra columns are not read
by near_groups and pass through keep_one, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingmill.llm.common import discard, fresh, ship, spread, table, turn_to, written
from pingmill.llm.graph import components

SHINGLE, SEED, NEAR = 3, 42, 3
#: Ranges of the index (fewer only where they would hold under LEAF fingerprints), and children of a node.
NODES, LEAF, FAN = 1024, 16, 8
#: Fingerprints that search at once.
AT_ONCE = 512
#: Shingles hashed at once, and words split at once.
HASHES, WORDS_AT_ONCE = 1 << 17, 1 << 20


def shingle_bits(text: str, size: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, int]:
    """How often each of the 64 hash bits is set over all shingles, most significant first, and the number of shingles."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    counts = np.zeros(64, np.int64)
    if not words:
        return counts, 0
    if len(words) < size:
        words = [b" ".join(words)]
        size = 1
    digest = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    for at in range(0, n, HASHES):
        part = words[at : at + HASHES + size - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        k = len(part) - size + 1
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:k].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, k)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(k, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return counts, n


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    counts, n = shingle_bits(text or "", size, seed)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """docs without its text, with the signed 64-bit fingerprint."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    (out,) = fresh(docs, out)
    schema = docs.select(*rest, F.lit(0).cast("long").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("simhash")
        for batch in batches:
            got = np.fromiter((fingerprint(x.as_py()) for x in batch.column(text)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(got.view(np.int64))], names=[*rest, out])

    return docs.mapInArrow(run, schema)


def gray_rank(fp: Column) -> Column:
    """Place in Gray order, as a long that sorts the same way."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(2**63)))


# ---- the index


def ranks(fps: np.ndarray) -> np.ndarray:
    """gray_rank of unsigned fingerprints, as the same signed longs."""
    x = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return (x ^ np.uint64(1 << 63)).view(np.int64)


class Tree:
    """An index over nodes (pattern, mask) in Gray order. levels go from the top down; each node keeps only the bits of its pattern
    that its parent does not tell. visited and pruned count the nodes met by searches."""

    def __init__(self, patterns: np.ndarray, masks: np.ndarray):
        levels = [(patterns & masks, masks)]
        while len(levels[-1][0]) > FAN:
            pattern, mask = levels[-1]
            at = np.arange(0, len(pattern), FAN)
            common = np.bitwise_and.reduceat(mask, at) & ~(np.bitwise_or.reduceat(pattern, at) ^ np.bitwise_and.reduceat(pattern, at))
            levels.append((np.bitwise_and.reduceat(pattern, at) & common, common))
        levels.reverse()
        self.levels = [levels[0]]
        for (_, above), (pattern, mask) in zip(levels, levels[1:], strict=False):
            own = mask & ~above[np.arange(len(mask)) // FAN]
            self.levels.append((pattern & own, own))
        self.visited = self.pruned = 0

    @classmethod
    def of(cls, fps: np.ndarray) -> Tree:
        """Over single fingerprints."""
        return cls(fps, np.full(len(fps), 0xFFFFFFFFFFFFFFFF, np.uint64))

    def search(self, queries: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) numbers of all leaves whose pattern differs from the query in at most `near` bits of its mask."""
        top = len(self.levels[0][0])
        q = np.repeat(np.arange(len(queries), dtype=np.int32), top)
        node = np.tile(np.arange(top, dtype=np.int32), len(queries))
        far = np.zeros(len(q), np.uint8)
        for depth, (pattern, mask) in enumerate(self.levels):
            far = far + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            keep = far <= near
            self.visited += len(q)
            q, node, far = q[keep], node[keep], far[keep]
            self.pruned += len(keep) - len(q)
            if depth + 1 < len(self.levels):
                q, far = np.repeat(q, FAN), np.repeat(far, FAN)
                node = (node[:, None] * FAN + np.arange(FAN, dtype=np.int32)).ravel()
                inside = node < len(self.levels[depth + 1][0])
                q, node, far = q[inside], node[inside], far[inside]
        return q, node

    def chunks(self, queries: np.ndarray, near: int = NEAR) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same, AT_ONCE queries at a time."""
        for at in range(0, len(queries), AT_ONCE):
            q, leaf = self.search(queries[at : at + AT_ONCE], near)
            yield q + at, leaf


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the sets of a[i] and b[i] for all i; roots are least members."""
    while True:
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


class Range:
    """One range of the index in its task: its tree, and the sets of its fingerprints that links join."""

    def __init__(self, fps: np.ndarray, near: int = NEAR):
        self.fps, self.near = fps[np.argsort(ranks(fps))], near
        self.tree = Tree.of(self.fps)
        self.parent = np.arange(len(fps))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        for q, leaf in self.tree.chunks(self.fps, near):
            self._join(q[leaf < q], leaf[leaf < q])

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.waiting.append((a, b))
            self.held += len(a)
        if self.held > max(1 << 16, len(self.fps)):
            self._flush()

    def _flush(self) -> None:
        if self.waiting:
            self.parent = unite(self.parent, *(np.concatenate([x[k] for x in self.waiting]) for k in (0, 1)))
            self.waiting, self.held = [], 0

    def meet(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """An edge to the first partner here of each query that has any; its other partners here are joined with that one."""
        for q, leaf in self.tree.chunks(queries, self.near):
            if len(q):
                order = np.argsort(q, kind="stable")
                q, leaf = q[order], leaf[order]
                first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
                of = np.repeat(leaf[first], np.diff([*first, len(q)]))
                self._join(leaf, of)
                yield queries[q[first]], self.fps[leaf[first]]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        self._flush()
        child = np.flatnonzero(self.parent != np.arange(len(self.fps)))
        return self.fps[child], self.fps[self.parent[child]]


def _packed(nodes: np.ndarray, fps: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    """(node, kind, fingerprints as bytes) for each node."""
    order = np.argsort(nodes, kind="stable")
    nodes, fps = nodes[order], fps[order]
    ends = (np.flatnonzero(nodes[1:] != nodes[:-1]) + 1).tolist() + [len(nodes)]
    return [(int(nodes[a]), kind, fps[a:b].tobytes()) for a, b in zip([0, *ends], ends, strict=False) if b > a]


def route(top: Tree, cuts: np.ndarray, fps: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Where fingerprints go: each to its own range (kind 0), and as a query (kind 1) to all ranges beyond it that it reaches."""
    own = np.searchsorted(cuts, ranks(fps), side="right").astype(np.int32)
    found = [(node[node > own[q]], q[node > own[q]]) for q, node in top.chunks(fps)]
    node, q = (np.concatenate([x[k] for x in found]) for k in (0, 1)) if found else (own[:0], own[:0])
    return _packed(own, fps, 0) + _packed(node, fps[q], 1)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, kind, fps), sorted: builds each range's tree, then lets its queries descend."""

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    none = np.zeros(0, np.uint64)
    node, own, here = None, [none], None
    for batch in batches:
        for number, kind, blob in zip(batch.column("node").to_pylist(), batch.column("kind").to_pylist(), batch.column("fps"), strict=True):
            if number != node:
                if node is not None:
                    yield edges(*(here or Range(np.concatenate(own))).forest())
                node, own, here = number, [none], None
            fps = np.frombuffer(blob.as_buffer(), np.uint64)
            if kind == 0:
                own.append(fps)
            else:
                here = here or Range(np.concatenate(own))
                for a, b in here.meet(fps):
                    yield edges(a, b)
    if node is not None:
        yield edges(*(here or Range(np.concatenate(own))).forest())


def upper_nodes(fps: DataFrame, nodes: int = NODES) -> tuple[Tree, np.ndarray]:
    """The index above the ranges, and where the ranges begin. At most `nodes` rows come to the driver, whatever the corpus."""
    rank = gray_rank(F.col("fp"))
    count = max(1, min(nodes, fps.count() // LEAF))
    steps = [i / count for i in range(1, count)]
    cuts = np.unique(np.array(fps.agg(F.percentile_approx(rank, F.array(*map(F.lit, steps)), F.lit(20 * nodes))).first()[0] if steps else [], np.int64))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, any_ = np.full(len(cuts) + 1, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(len(cuts) + 1, np.uint64)
        seen = np.zeros(len(cuts) + 1, bool)
        for batch in batches:
            x = batch.column("fp").to_numpy().view(np.uint64)
            own = np.searchsorted(cuts, ranks(x), side="right")
            np.bitwise_and.at(every, own, x)
            np.bitwise_or.at(any_, own, x)
            seen[own] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at].view(np.int64)), pa.array(any_[at].view(np.int64))], names=["node", "every", "any"])

    parts = fps.select("fp").mapInArrow(heads, "node long, every long, any long")
    table_of, path = written(parts.groupBy("node").agg(F.expr("bit_and(every)").alias("every"), F.expr("bit_or(any)").alias("any")), "upper-nodes")
    rows = table_of.orderBy("node").collect()
    discard(fps.sparkSession, path)
    # A range without fingerprints has the pattern of its neighbour: whoever reaches it finds nothing there.
    every, any_ = np.zeros(len(cuts) + 1, np.uint64), np.zeros(len(cuts) + 1, np.uint64)
    last = None
    held = {r.node: r for r in rows}
    for k in range(len(every)):
        last = held.get(k, last) or rows[0] if rows else None
        if last is not None:
            every[k], any_[k] = last["every"] % 2**64, last["any"] % 2**64
    return Tree(every, ~(every ^ any_)), cuts


def links(fps: DataFrame, nodes: int = NODES) -> DataFrame:
    """Edges (a, b) among distinct fingerprints fps(fp) whose components are those of all pairs within NEAR bits."""
    ship(fps.sparkSession)
    top, cuts = upper_nodes(fps, nodes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = route(top, cuts, batch.column("fp").to_numpy().view(np.uint64))
            kinds = (pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 3, kinds, strict=True)], names=["node", "kind", "fps"])

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Eight bytes a fingerprint make few splits of a long search: they are dealt over more tasks first.
    dealt = fps.select("fp").repartition(n, "fp").mapInArrow(deal, "node int, kind int, fps binary")
    return dealt.repartition(n, "node").sortWithinPartitions("node", "kind").mapInArrow(_search, "a long, b long")


def classes(prints: DataFrame) -> DataFrame:
    """fp, label for every distinct fingerprint: the label is one fingerprint of its component."""
    distinct, _ = written(prints.select("fp").distinct(), "fps")
    labels, _ = written(components(links(distinct)), "labels")
    return distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp, component_id for every row of docs."""
    prints, _ = written(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))), "prints")
    # Copies and groups may hold a third of all rows: ids are pre-aggregated by fingerprint, then by component.
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes(prints), "fp")
    least, path = written(least, "labelled")
    tops, _ = written(least.groupBy("label").agg(F.min("least").alias("component_id")), "tops")
    by_fp, _ = written(least.join(tops, "label").select("fp", "component_id"), "fp-components")
    discard(docs.sparkSession, path)
    return prints.join(by_fp, "fp").select(F.col("doc_id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One whole row of docs for each group: that of its least doc_id (ids before nulls), and of the least digest of a text among
    rows of that id. Equal rows count as one."""
    (key,) = fresh(docs, "near_key")
    name = F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    keyed = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), name)
    prints, _ = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), keyed.alias("key"), "text")), "prints")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    first = prints.groupBy("fp").agg(F.min(order).alias("first")).join(classes(prints), "fp")
    winners = first.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.key").alias(key))
    winners, _ = written(winners, "winners")
    # The rows move once, for the join and for the equal rows.
    return docs.withColumn(key, keyed).join(winners, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def op4(spark, sf_dir: str) -> DataFrame:
    out = near_groups(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
