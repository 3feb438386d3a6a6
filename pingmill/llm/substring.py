"""Substring dedup by content-defined chunking.

A gear hash (each byte shifts the hash left by one bit and adds that byte's random number) runs over the UTF-8 bytes of each word. A
chunk begins at every word whose mixed hash (its own and that of the word before) is the least of any `SPAN` words in a row, so
borders depend on nothing but the words near them, however short those are. Chunks of over `MOST` bytes are cut within by `borders`.

1. A stretch is a chunk and the next ones up to `STRETCH` words; its digest is made of theirs. Stretches whose digest occurs in two
   documents or more are candidates. A shared passage of n words has n - 1 hashes in common (the first needs the word before). Its
   first and last `SPAN` of them each name a border that all its documents have, and so do all borders between, so at least
   n - 2 * SPAN words lie in whole shared chunks: 25 of 51. Every shared passage of `WORDS` words therefore holds a candidate.
2. Overlapping candidates that overlap in the same way in one other place (the first or the last that holds them) are shared with
   that one document; from `WORDS` words on they are a repeated passage.
3. All other candidates, and their equals in other documents, are checked exactly: every `WORDS` words in a row that contain them
   are hashed and looked up among those of the other documents. So a passage is never pieced together from shorter shared stretches.

A passage of step 2 begins and ends with whole chunks: of a shared stretch, up to `SPAN` + a chunk's words at either end may be left out
of its extent (4 % of the repeated words in mixed documents); that it is repeated is never missed. Those of step 3 have exact ends.

Digests are 64 bits: at 10^12 chunks one in 10^7 meets another's by accident, and a passage needs several such neighbours.

Defined results: null and empty texts have no chunks; rows of equal doc_id are one document, so a passage that only they share is not
repeated; rows equal in id and text give one row a passage; a null doc_id is a document of its own kind, equal to other nulls; a
passage repeated inside one document only is left alone; words repeated in step (a stretch that overlaps its own equal) count once;
the document of the least id keeps the passage; an empty table gives no passages; long texts are hashed in windows; columns other than doc_id and the text are not read by `passages` and pass through
`remove_copies`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pingmill.llm.common import discard, fresh, ship, spread, table, written

BITS, LEAST, MOST, STRETCH, WORDS, SPAN, WINDOW = 5, 16, 160, 25, 51, 13, 1 << 22
#: Chunks that a document can have (some 700 MB of text; more is an error, never a wrong place); rows that are emitted at once.
NUMBERS, AT_ONCE = 1 << 24, 50_000
GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256, dtype=np.uint16)
BASE = 0x9E3779B97F4A7C15


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash at every byte: sums of windows of 1, 2, 4, 8 and 16 bytes, each from two of the half length."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        up = h.copy()
        up[k:] += h[:-k] << np.uint16(k)
        h = up
    return h


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The same, of any number of bytes in windows."""
    if len(raw) <= WINDOW:
        return gear_hash(raw)
    h = np.empty(len(raw), np.uint16)
    for at in range(0, len(raw), WINDOW):
        low = max(0, at - 15)
        h[at : at + WINDOW] = gear_hash(raw[low : at + WINDOW])[at - low :]
    return h


def borders(data: bytes) -> list[int]:
    """Where chunks end. Where no border comes within MOST bytes the least hash there is one, so repetitive text is cut in step too."""
    ends, last, n = [], 0, len(data)
    h = gear_hashes(np.frombuffer(data, np.uint8))
    for end in [*(np.flatnonzero(h < (1 << (16 - BITS))) + 1).tolist(), n]:
        while end - last > MOST:
            last += LEAST + int(h[last + LEAST - 1 : last + MOST].argmin())
            ends.append(last)
        if end - last >= LEAST or (end == n and end > last):
            ends.append(end)
            last = end
    return ends


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end."""
    raw = np.frombuffer(data, np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
    return np.flatnonzero(space[:-2] & ~space[1:-1]), np.flatnonzero(~space[1:-1] & space[2:]) + 1


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash of each word's last 16 bytes, mixed with that of the word before."""
    h = gear_hashes(np.frombuffer(data, np.uint8))
    g, n = h[ends - 1], ends - starts
    # What the bytes before a word have left of themselves in its hash: theirs, shifted by the word's bytes.
    before = h[np.maximum(starts - 1, 0)] << np.minimum(n, 15).astype(np.uint16)
    g -= np.where((n < 16) & (starts > 0), before, np.uint16(0))
    mixed = g * np.uint16(0x9E3B)
    mixed[1:] += (g[:-1] ^ (g[:-1] >> np.uint16(7))) * np.uint16(0x6A4D)
    return mixed ^ (mixed >> np.uint16(8))


def cuts(data: bytes, starts: np.ndarray, stops: np.ndarray) -> list[int]:
    """Where chunks end: before each word whose hash is the least of SPAN words in a row (the last of equals), and within long chunks."""
    n = len(starts)
    ends = [len(data)]
    if n >= SPAN:
        least = (word_hashes(data, starts, stops).astype(np.int64) << 40) | (n - np.arange(n))
        width = 1
        while width < SPAN:
            step = min(width, SPAN - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        at = n - (least & ((1 << 40) - 1))
        at = starts[at[np.concatenate([[True], at[1:] != at[:-1]])]]
        ends = [*at[at > 0].tolist(), len(data)]
    if max(b - a for a, b in zip([0, *ends], ends, strict=False)) <= MOST:
        return ends
    out, last = [], 0
    for end in ends:
        out += [end] if end - last <= MOST else [last + e for e in borders(data[last:end])]
        last = end
    return out


def chunk_words(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many words begin in each chunk."""
    return np.diff(np.searchsorted(starts, ends), prepend=0)


INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; those of short documents are kept."""
    kept = _powers.get(base)
    if kept is not None and n <= len(kept):
        return kept[:n]
    out = np.full(max(n, 4096), base, np.uint64)
    out[0] = 1
    out = np.cumprod(out, dtype=np.uint64)
    if len(out) <= 1 << 16:
        _powers[base] = out
    return out[:n]


def run_digests(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit digest of values[first:last] for each pair: a polynomial of the values, free of their place, and mixed."""
    n = len(values)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(n, BASE), dtype=np.uint64)])
    back = powers(n + 1, INVERSE)
    x = (sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def once(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows (.., word, end word, digest) without those that overlap the row before with the same digest: words repeated in step."""
    word, end_word, digest = columns[3:]
    order = np.lexsort((word, digest))
    again = (digest[order][1:] == digest[order][:-1]) & (end_word[order][:-1] > word[order][1:])
    keep = np.ones(len(word), bool)
    keep[order[1:][again]] = False
    return columns if keep.all() else [c[keep] for c in columns]


def stretches(data: bytes, words: int = STRETCH) -> list[np.ndarray]:
    """chunk number, start and end (bytes), first and end word, digest of every stretch of whole chunks with `words` words."""
    starts, stops = word_bounds(data)
    ends = np.array(cuts(data, starts, stops))
    count = np.concatenate([[0], np.cumsum(chunk_words(starts, ends))])
    last = np.searchsorted(count, count[:-1] + words)
    first = np.flatnonzero(last <= len(ends))
    last = last[first]
    begins = np.concatenate([[0], ends[:-1]])
    bounds = zip(begins[: int(last.max(initial=0))].tolist(), ends.tolist(), strict=False)
    digests = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in bounds), np.uint64)
    return once([first, begins[first], ends[last - 1], count[first], count[last], run_digests(digests, first, last)])


def key_of(doc_id: Column, text: Column) -> Column:
    """Names a row among those of its doc_id: 43 bits of a hash, above room for a chunk's number (and far from the ends of longs)."""
    return F.shiftright(F.xxhash64(doc_id, text), 1).bitwiseAND(F.lit(-NUMBERS))


_PLACES = "doc_id long, place long, start long, end long, word long, end_word long, digest long"


def _rows(held: list[tuple]) -> pa.RecordBatch:
    """(doc_id, key, [columns]) of several documents as one batch."""
    counts = [len(x[2][0]) for x in held]
    ids = pa.array([x[0] for x in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), counts)))
    columns = [np.concatenate([x[2][k] for x in held]).astype(np.uint64 if k == 5 else np.int64).view(np.int64) for k in range(6)]
    if len(columns[0]) and columns[0].max() >= NUMBERS:
        raise ValueError(f"a document has over {NUMBERS} chunks")
    columns[0] = np.repeat(np.array([x[1] for x in held], np.int64), counts) + columns[0]
    return pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], names=[c.split()[0] for c in _PLACES.split(", ")])


def _emit(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for x in found:
        held.append(x)
        size += len(x[2][0])
        if size >= AT_ONCE:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), key_of(doc_id, F.col(text)).alias("key"), F.col(text).alias("text"))


def chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (doc_id, place, start, end, word, end_word, digest) of all stretches of docs(doc_id, text)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for doc_id, key, body in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), strict=True):
                    if body.is_valid and len(body.as_buffer()):
                        yield doc_id, key, stretches(body.as_buffer().to_pybytes())

        yield from _emit(found())

    return _keyed(docs, text).mapInArrow(run, _PLACES)


def _shared(rows: DataFrame) -> DataFrame:
    """digest, least (document), first and last (place) of the digests that two documents or more hold."""
    # Ids are compared through counts that tell nulls too, so that all nulls are one document.
    of = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"), F.count("doc_id").alias("with_id"), F.min("place").alias("first"), F.max("place").alias("last"))
    return of.filter((F.col("least") != F.col("most")) | ((F.col("with_id") > 0) & (F.col("with_id") < F.col("n")))).select("digest", "least", "first", "last")


def _exact(docs: DataFrame, regions: DataFrame, text: str) -> DataFrame:
    """All runs of WORDS words that contain a span of the regions(doc_id, key, spans), as rows like those of `chunks`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                columns = (batch.column(c) for c in ("text", "spans"))
                for doc_id, key, body, spans in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), *columns, strict=True):
                    data = body.as_buffer().to_pybytes()
                    starts, stops = word_bounds(data)
                    flat = spans.values.flatten()
                    low = np.maximum(np.searchsorted(starts, flat[1].to_numpy()) - WORDS, 0)
                    high = np.minimum(np.searchsorted(starts, flat[0].to_numpy()) + WORDS, len(starts))
                    low, high = np.minimum(low, high), np.maximum(low, high)
                    near = np.zeros(len(starts) + 1, np.int64)
                    np.add.at(near, low, 1)
                    np.add.at(near, high, -1)
                    at = np.flatnonzero(np.cumsum(near)[:-1])
                    hashes = np.zeros(len(starts), np.uint64)
                    hashes[at] = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)), np.uint64, len(at))
                    inside = np.cumsum(near)[:-1] > 0
                    total = np.concatenate([[0], np.cumsum(inside)])
                    first = np.arange(max(0, len(starts) - WORDS + 1))
                    first = first[total[first + WORDS] - total[first] == WORDS]
                    if len(first):
                        last = first + WORDS
                        yield doc_id, key, once([first, starts[first], stops[last - 1], first, last, run_digests(hashes, first, last)])

        yield from _emit(found())

    a, b = _keyed(docs, text).filter("text IS NOT NULL").alias("a"), regions.alias("b")
    # Spark broadcasts the regions by their measured size, or joins by key.
    joined = a.join(b, (F.col("a.key") == F.col("b.key")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))).select("a.*", "b.spans")
    return joined.mapInArrow(run, _PLACES)


def passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """Repeated passages: doc_id, key, start and n_bytes (in UTF-8 bytes), n_words, first_doc_id, is_copy, copies, kept.

    first_doc_id is the least document that holds a part of it, is_copy whether a lesser document than this one holds a part. copies
    are the bytes of shared parts that a lesser document holds, kept those of which this one is the least holder.
    """
    spark = docs.sparkSession
    every, held = written(chunks(docs, text), "chunks")
    shared, held_too = written(_shared(every), "shared-chunks")  # a plain table: the join's hot side can be split
    key = F.col("place").bitwiseAND(F.lit(-NUMBERS))
    repeated = every.join(shared, "digest").withColumn("key", key)
    order = W.partitionBy("doc_id", "key").orderBy("place")
    back = lambda c: F.lag(c).over(order)
    alike = lambda c: (F.col("word") <= back("end_word")) & (F.col(c) == back(c) + (F.col("place") - back("place")))
    turns = {f"turn_{c}": F.sum(F.when(alike(c), 0).otherwise(1)).over(order) for c in ("first", "last")}
    runs = repeated.withColumns(turns)
    n_words = lambda c: F.max("end_word").over(W.partitionBy("doc_id", "key", f"turn_{c}")) - F.min("word").over(W.partitionBy("doc_id", "key", f"turn_{c}"))
    alone = lambda c: F.col(c).bitwiseAND(F.lit(-NUMBERS)) != F.col("key")
    sure = (alone("first") & (n_words("first") >= WORDS)) | (alone("last") & (n_words("last") >= WORDS))
    runs, held_runs = written(runs.withColumn("sure", sure).select("doc_id", "key", "start", "end", "word", "end_word", "digest", "least", "sure"), "candidates")
    discard(spark, held, held_too)
    doubtful, _ = written(runs.filter(~F.col("sure")).select("digest").distinct(), "doubtful")
    near = runs.join(doubtful, "digest", "left_semi").groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    near, held_near = written(near, "regions")
    exact, held_exact = written(_exact(docs, near, text), "exact")
    known, _ = written(_shared(exact).select("digest", "least"), "shared-exact")
    columns = ["doc_id", "key", "start", "end", "word", "end_word", "least"]
    found = runs.filter("sure").select(*columns).union(exact.join(known, "digest").withColumn("key", key).select(*columns))
    # Overlapping parts are one passage. Parts with and without a lesser holder are merged by themselves first.
    found = found.withColumn("own", F.col("least").eqNullSafe(F.col("doc_id")))

    def merged(rows: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
        w = W.partitionBy(*keys).orderBy("start")
        before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
        part = F.sum(F.when(F.col("start") < before, 0).otherwise(1)).over(w)
        ends = [F.min("start").alias("start"), F.max("end").alias("end"), F.min("word").alias("word"), F.max("end_word").alias("end_word"), F.min("least").alias("least")]
        return rows.withColumn("part", part).groupBy(*keys, "part").agg(*ends, *aggregates).drop("part")

    spans = merged(found, ["doc_id", "key", "own"])
    span = F.struct("start", (F.col("end") - F.col("start")).alias("n_bytes"))
    lists = [F.collect_list(F.when(~F.col("own"), span)).alias("copies"), F.collect_list(F.when(F.col("own"), span)).alias("kept")]
    out, _ = written(merged(spans, ["doc_id", "key"], *lists), "passages")
    discard(spark, held_runs, held_near, held_exact)
    return out.select("doc_id", "key", "start", (F.col("end") - F.col("start")).alias("n_bytes"), (F.col("end_word") - F.col("word")).alias("n_words"), F.col("least").alias("first_doc_id"), (F.size("copies") > 0).alias("is_copy"), "copies", "kept")


def remove_copies(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """docs without the parts that documents of lesser ids hold already; found as `passages` returns it for the same docs.

    A part that a document is the least to hold stays whole in it, so every shared stretch survives in one document at least.
    """
    ship(docs.sparkSession)
    key, cuts_, keep = fresh(docs, "copy_key", "copy_spans", "copy_kept")
    spans = found.groupBy("doc_id", "key").agg(F.sort_array(F.flatten(F.collect_list("copies"))).alias(cuts_), F.sort_array(F.flatten(F.collect_list("kept"))).alias(keep))
    doc_id = F.col("doc_id").cast("long")
    a, b = docs.withColumn(key, key_of(doc_id, F.col(text))).alias("a"), spans.alias("b")
    joined = a.join(b, (F.col(f"a.{key}") == F.col("b.key")) & F.col("a.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")), "left").select("a.*", f"b.{cuts_}", f"b.{keep}").drop(key)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for body, gone, stay in zip(batch.column(text), batch.column(cuts_).to_pylist(), batch.column(keep).to_pylist(), strict=True):
                if not gone or not body.is_valid:
                    bodies.append(body.as_py())
                    continue
                data = body.as_buffer().to_pybytes()
                keeps = np.ones(len(data), bool)
                for spans, value in ((gone, False), (stay, True)):
                    for x in spans:
                        keeps[x["start"] : x["start"] + x["n_bytes"]] = value
                inner = (np.frombuffer(data, np.uint8) & 0xC0) == 0x80  # bytes after a character's first one share its fate
                lead = np.maximum.accumulate(np.where(inner, 0, np.arange(len(data))))
                bodies.append(np.frombuffer(data, np.uint8)[keeps[lead]].tobytes().decode())
            columns = {**{c: batch.column(c) for c in names}, text: pa.array(bodies, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return joined.mapInArrow(run, docs.schema)


def op2(spark, sf_dir: str) -> DataFrame:
    return passages(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("key", "copies", "kept")
