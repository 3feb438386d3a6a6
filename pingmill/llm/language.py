"""Language ID by language-bitmask n-gram filters.

One table of bit masks holds Bloom filters for every language side by side (bit l of each slot belongs to plane l). Probing an
n-gram ANDs the masks of its slots and so returns all languages that hold it at once. Each language has two planes: one holds every
n-gram that occurs in it, so that no language of an n-gram is ever missed; the other its typical ones, whose frequency is at least
`MIN_FREQUENCY` and at least `RATIO` times that in any language (stray words of other languages make the first planes alike as a
corpus grows, the second ones stay apart). For each text the bits are counted by plane, each count is corrected for that plane's
false-positive rate, and the mean of both shares decides.

N-grams are three lower-case letters (outside a word: 0), so a key is exact in 63 bits. Slots are dealt from the largest plane's
distinct n-grams, up to `MOST_SLOTS`: that bounds what is sent to the executors (32 MB a plane of 8 languages). Beyond it nothing is
dropped; the false-positive rates rise and are corrected for. The planes are filled on the executors, one block of slots a task.

Defined results: a null text, or one without a letter, is `und` with score 0; texts with letters but no known n-gram get the first
language with score 0; without any training row everything is `und`; ties go to the first language in code-point order; equal rows
are predicted alike; very long texts are read in pieces of bounded size with two letters of overlap; an empty table gives an empty
result; columns named like the new ones stay, and the new ones get leading underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingmill.llm.common import fresh, ship, table, text_slices, turn_to, written
from pingmill.llm.common import spread as dealt

N, PROBES, SLOTS_PER_GRAM = 3, 4, 12
MIN_FREQUENCY, RATIO = 1e-5, 0.2
LEAST_SLOTS, MOST_SLOTS, BLOCK = 1 << 10, 1 << 25, 1 << 16
PIECE = 1 << 19
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Code point -> is it a letter, built once a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def pieces(texts: list[str | None], most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, owners) of n-grams for runs of texts of about `most` characters; owners are row numbers."""
    letters = letter_table()
    held: list[np.ndarray] = []
    rows: list[int] = []
    total = 0

    def out():
        lengths = np.array([len(x) for x in held])
        c = np.concatenate(held).astype(np.uint64)
        owner = np.repeat(np.array(rows), lengths)
        c[~letters[c.astype(np.int64)]] = 0
        keep = c[1:-1] > 0
        keep &= (owner[:-2] == owner[2:])
        keys = ((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[keep]
        return keys, owner[1:-1][keep]

    edge = np.zeros(1, np.uint32)
    for row, text in enumerate(texts):
        if not text:
            continue
        for at in range(0, len(text), most):
            before = text[at - 1 : at] if at else ""
            part = codes(before + text[at : at + most + 1])
            ends = at + most >= len(text)
            held += [part] if at else [edge, part]
            rows += [row] if at else [row, row]
            if ends:
                held.append(edge)
                rows.append(row)
            total += len(part)
            if total >= most:
                yield out()
                held, rows, total = [], [], 0
    if held:
        yield out()


def spread(keys: np.ndarray, slots: int) -> list[np.ndarray]:
    """The PROBES slots of each key, by double hashing of a multiplicative mix."""
    h = keys * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    m = np.uint64(slots - 1)
    return [((a + np.uint64(i) * b) & m).astype(np.int64) for i in range(PROBES)]


class BitFilters:
    """Bit-sliced Bloom filters: `masks` has a row of 8-bit words for each slot. Bit l tells of language l's n-grams, bit
    len(languages) + l of its typical ones; `false_rate` is each bit's false-positive rate."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks, self.slots = languages, masks, len(masks)
        ones = [((masks[:, b // 8] >> (b % 8)) & 1).mean() for b in range(2 * len(languages))]
        self.false_rate = np.array(ones) ** PROBES

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """The bits of each n-gram: all languages that hold it, and those of which it is typical."""
        at = spread(keys, self.slots)
        found = self.masks[at[0]]
        for x in at[1:]:
            found &= self.masks[x]
        return found

    def languages_of(self, keys: np.ndarray) -> list[list[str]]:
        """All languages that contain each n-gram (and, seldom, one that does not; never one too few)."""
        found = self.probe(keys)
        return [[name for l, name in enumerate(self.languages) if row[l // 8] >> (l % 8) & 1] for row in found]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n = np.zeros(len(texts))
        hits = np.zeros((2 * len(self.languages), len(texts)))
        for keys, owner in pieces(texts):
            n += np.bincount(owner, minlength=len(texts))
            found = self.probe(keys)
            for b in range(len(hits)):
                hits[b] += np.bincount(owner, weights=(found[:, b // 8] >> (b % 8)) & 1, minlength=len(texts))
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        share = hits / np.maximum(n, 1)
        rate = np.minimum(self.false_rate, 0.99)[:, None]
        share = np.clip((share - rate) / (1 - rate), 0, 1)
        share = (share[: len(self.languages)] + share[len(self.languages) :]) / 2
        best = share.argmax(axis=0)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)]
        return names, [float(share[b, i]) if n[i] else 0.0 for i, b in enumerate(best)]


def fill(grams: DataFrame, languages: list[str], slots: int) -> BitFilters:
    """The filters of grams(gram, bit). One row a block of slots comes to the driver: `slots` bounds them, not the corpus."""
    width, block = max(1, (2 * len(languages) + 7) // 8), min(slots, BLOCK)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(spread(batch.column("gram").to_numpy().astype(np.uint64), slots))
            bit = np.tile(batch.column("bit").to_numpy(), PROBES)
            yield pa.RecordBatch.from_arrays([pa.array(at // block), pa.array(at % block), pa.array(bit)], names=["block", "slot", "bit"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        last = None
        for batch in batches:
            number, slot, bit = (batch.column(c).to_numpy() for c in ("block", "slot", "bit"))
            for k in np.unique(number).tolist():
                if last is not None and k != last:
                    yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([held.pop(last).tobytes()], pa.binary())], names=["block", "masks"])
                last = k
                mine = held.setdefault(k, np.zeros((block, width), np.uint8))
                rows = number == k
                np.bitwise_or.at(mine, (slot[rows], bit[rows] // 8), np.left_shift(1, bit[rows] % 8).astype(np.uint8))
        for k, mine in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([mine.tobytes()], pa.binary())], names=["block", "masks"])

    placed = grams.mapInArrow(place, "block long, slot long, bit long")
    blocks = placed.repartition("block").sortWithinPartitions("block").mapInArrow(gather, "block long, masks binary").collect()
    masks = np.zeros((slots, width), np.uint8)
    for r in blocks:
        masks[r.block * block : (r.block + 1) * block] = np.frombuffer(r.masks, np.uint8).reshape(block, width)
    return BitFilters(languages, masks)


def learn(docs: DataFrame, min_frequency: float = MIN_FREQUENCY, ratio: float = RATIO) -> BitFilters:
    """Counts the n-grams of every row of docs(text, lang) with both values, and builds the filters from all of them."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("language")
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, keys: np.ndarray, n: np.ndarray) -> None:
            if lang in sums:
                keys, n = np.concatenate([sums[lang][0], keys]), np.concatenate([sums[lang][1], n])
            got, at = np.unique(keys, return_inverse=True)
            sums[lang] = got, np.bincount(at, weights=n, minlength=len(got)).astype(np.int64)

        for batch in batches:
            for a, b in text_slices(batch, "text", 4 * PIECE):
                part = batch.slice(a, b - a)
                texts = part.column("text").to_pylist()
                names, number = np.unique(np.array(part.column("lang").to_pylist(), str), return_inverse=True)
                for keys, owner in pieces(texts):
                    by = number[owner]
                    for k in np.unique(by):
                        add(str(names[k]), *np.unique(keys[by == k], return_counts=True))
        for lang, (keys, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    counts, _ = written(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("grams")).orderBy("lang").collect()  # one row a language
    languages = [r.lang for r in totals]
    if not languages:
        return BitFilters([], np.zeros((LEAST_SLOTS, 1), np.uint8))
    slots = min(MOST_SLOTS, 1 << max(10, int(np.ceil(np.log2(max(r.grams for r in totals) * SLOTS_PER_GRAM)))))
    known = docs.sparkSession.createDataFrame([(r.lang, i, r.total) for i, r in enumerate(totals)], "lang string, number long, total long")
    rows = counts.join(known, "lang").withColumn("p", F.col("n") / F.col("total"))
    top = rows.groupBy("gram").agg(F.max("p").alias("top"))
    typical = rows.join(top, "gram").filter((F.col("p") >= min_frequency) & (F.col("p") >= ratio * F.col("top")))
    return fill(rows.select("gram", F.col("number").alias("bit")).union(typical.select("gram", F.col("number") + len(languages))), languages, slots)


def identify(docs: DataFrame, filters: BitFilters, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with two more columns: predicted language, and the mean of the corrected shares of its n-grams that the language holds
    and that are typical of it."""
    ship(docs.sparkSession)
    lang_out, score_out = fresh(docs, lang_out, score_out)
    schema = docs.select("*", F.lit("").alias(lang_out), F.lit(0.0).alias(score_out)).schema

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("language")
        for batch in batches:
            for a, b in text_slices(batch, text, 16 * PIECE):
                part = batch.slice(a, b - a)
                names, scores = filters.predict(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, lang_out, score_out])

    return docs.mapInArrow(label, schema)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    filters = learn(training_rows(docs))
    out = identify(docs.select("doc_id", "text"), filters)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
