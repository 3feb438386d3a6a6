"""Byte-level BPE with reuse of content-defined chunks.

1. Texts are cut where a gear hash of the last 32 bytes has its upper bits zero (`borders`), so equal passages give equal chunks
   wherever they stand. A first scan counts the chunks' digests over all documents; digests met twice or more set bits of a filter
   of fixed size (`FILTER_BITS`), all that is ever sent to every task. A bit set by chance only sends a chunk the longer way.
2. A second scan encodes at once what no other document shares: documents without a shared chunk are done; of others it leaves the
   ids of the stretches between shared chunks, and references to those.
3. Every distinct shared chunk is encoded once, and its ids are joined to the references by digest. Spark splits the join where one
   chunk has a large share of the references.
4. A document's pieces meet by row (`repair`). Tokens at a join of two pieces can differ from those of the whole text. An anchor is a
   place where a space stands between two other characters: no match of the byte-level pattern goes on over it, so it is a border of
   matches in every text that has it. Joins are repaired between the anchors beside them: the stretch, wider by a word on both sides,
   is encoded anew until its first and last words have exactly the ids that the pieces have there; if not, it is widened twofold, up to
   the whole text.

The ids are decoded with the vocabulary's bytes, special tokens as their text. Encoding itself is the tokenizers library's, with
truncation and padding off; strings of special tokens become special ids, as its default is, also where a chunk's border cuts one
(a special token holds no anchor). A vocabulary must have a byte-level pattern of that kind and special tokens without spaces.

Defined results: null and empty texts have no tokens; equal texts have equal ids; texts of any length are cut in bounded steps (a
document's ids must fit into a task); repeated rows and null ids are kept as rows of their own; an empty table gives an empty
result; columns other than doc_id and the text are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
import os
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingmill.llm.common import ship, spread, table, text_slices, turn_to, written
from pingmill.llm.huffman import Encoder

#: Least and largest bytes of a chunk; a border has this many zero bits in its hash (so 1,024 bytes more than the least, as a mean).
LEAST, MOST, ZEROS, SEED = 256, 1 << 14, 10, 13
#: Bits of the filter (8 MB): the bound of what is broadcast, whatever the input.
FILTER_BITS = 1 << 26
AT_ONCE = 4 << 20
DONE, OWN, SHARED = 0, 1, 2
_GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, np.uint32)
_ROWS = "row long, doc_id long, piece int, kind int, key binary, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


# ---- chunks


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of it and the 31 bytes before it."""
    h, w = _GEAR[data], 1
    while w < 32 and w < len(h):
        h[w:] = h[w:] + (h[:-w] << np.uint32(w))
        w *= 2
    return h


def borders(texts: list[bytes]) -> Iterator[list[int]]:
    """For each text the ends of its chunks, the text's end included. A chunk's least size exceeds the hash's window, so a border
    depends on the text alone; borders never cut a character."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    zero = np.flatnonzero((gear(data) >> np.uint32(32 - ZEROS)) == 0) + 1
    ends = zero[(zero < len(data)) & ((data[np.minimum(zero, max(len(data) - 1, 0))] & 0xC0) != 0x80)] if len(data) else zero
    start = 0
    for text in texts:
        n = len(text)
        a, b = np.searchsorted(ends, (start, start + n))
        mine, at, out = (ends[a:b] - start).tolist(), 0, []
        while n - at > LEAST:
            k = bisect_left(mine, at + LEAST)
            end = mine[k] if k < len(mine) else n
            if end - at > MOST:
                end = at + MOST
                while text[end] & 0xC0 == 0x80:
                    end -= 1
            if end >= n:
                break
            out.append(end)
            at = end
        yield [*out, n] if n else []
        start += n


def key_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def bit_of(keys: list[bytes]) -> np.ndarray:
    """Numbers of keys: where they fall in the filter, before the remainder."""
    return np.frombuffer(b"".join(keys), "<i8")[::2] >> 1 & 0x3FFFFFFFFFFFFFFF


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for a, b in text_slices(batch, text, AT_ONCE):
            part = batch.slice(a, b - a)
            yield part, [x or b"" for x in part.column(text).cast(pa.binary()).to_pylist()]


def shared_filter(docs: DataFrame, text: str = "text", bits: int = FILTER_BITS) -> np.ndarray:
    """The bits (one byte for eight) of all chunks that occur at least twice. At most bits / 8 bytes come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("chunks", _codecs.clear)
        for _, texts in _slices(batches, text):
            keys = [key_of(t[a:b]) for t, ends in zip(texts, borders(texts), strict=True) for a, b in zip([0, *ends], ends, strict=False)]
            found, n = np.unique(bit_of(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["key", "n"])

    counted = docs.select(text).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    place = F.pmod("key", F.lit(bits))
    parts = counted.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    width = 1 << 12  # bytes of one of Spark's bitmaps, whose first number is 1
    out = np.zeros((max(1, bits // 8 // width) + 1, width), np.uint8)
    for r in parts:
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def is_shared(held: np.ndarray, keys: list[bytes], bits: int = FILTER_BITS) -> np.ndarray:
    place = bit_of(keys) % bits
    # Spark counts bits from 1: numbers 1 to 32,768 are bitmap 1; 0 is the last of bitmap 0.
    at = np.where(place == 0, 0, place - 1 + (1 << 15))
    return (held[at >> 3] >> (at & 7)) & 1 == 1


# ---- ids


class Codec:
    """Ids of pieces by the library (each distinct word once), repairs, and decoding by the vocabulary's bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encoder = Encoder(path)
        self.kind, self.library = self.encoder.kind, self.encoder.library
        self.library.no_truncation()
        self.library.no_padding()
        # Byte-level vocabularies spell a byte as a character: printable ones as themselves, the others as the next from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        tokens = [self.library.id_to_token(i) or "" for i in range(self.encoder.size)]
        self.bytes_of = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens]
        special = {i for i, t in self.library.get_added_tokens_decoder().items()}
        # Bytes that are surely no white space: as a token's first after a space, and as the last of a token.
        first = {*range(33, 127), *range(0xC3, 0xF5)} - {0xE1, 0xE2, 0xE3}
        last = {*range(33, 127), *range(0x81, 0xC0)} - {*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF}
        self.opens = np.array([len(t) > 1 and t[0] == 32 and t[1] in first and i not in special for i, t in enumerate(self.bytes_of)])
        self.closes = np.array([len(t) > 0 and t[-1] in last for t in self.bytes_of])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(x, self.kind) for x in self.encoder.encode(pa.array(texts, pa.binary()).cast(pa.string()))]

    def decode(self, ids: np.ndarray) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()])

    def result(self, ids: np.ndarray) -> tuple[int, str, str]:
        back = self.decode(ids).decode("utf-8", "replace").encode()
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()

    def _anew(self, ids: np.ndarray) -> np.ndarray:
        return np.array(self.library.encode(self.decode(ids).decode(), add_special_tokens=False).ids, self.kind)

    def repair(self, pieces: list[np.ndarray]) -> np.ndarray:
        """The ids of the joined text from those of its pieces."""
        pieces = [p for p in pieces if len(p)]
        if len(pieces) < 2:
            return pieces[0] if pieces else np.zeros(0, self.kind)
        ids = np.concatenate(pieces)
        joins = np.cumsum([len(p) for p in pieces])[:-1]
        anchor = np.zeros(len(ids) + 1, bool)
        anchor[1:-1] = self.opens[ids[1:]] & self.closes[ids[:-1]]
        anchor[joins] = False  # what is beside a join is what is in doubt
        at = np.concatenate([[0], np.flatnonzero(anchor), [len(ids)]])
        out, done, k = [], 0, 0
        while k < len(joins):
            reach = 1
            while True:
                # From `reach` words before the join to `reach` words behind the last join that this stretch takes in.
                low = max(int(np.searchsorted(at, joins[k], "left")) - 1 - reach, 0)
                low = max(low, int(np.searchsorted(at, done, "left")))
                last = k
                while True:
                    high = min(int(np.searchsorted(at, joins[last], "right")) + reach, len(at) - 1)
                    if last + 1 < len(joins) and joins[last + 1] <= at[high]:
                        last += 1
                    else:
                        break
                a, b = int(at[low]), int(at[high])
                new = self._anew(ids[a:b])
                # The words at both ends must come out as the pieces have them, unless the text itself ends there.
                x, y = (int(at[low + 1]) - a if a > done else 0), (b - int(at[high - 1]) if b < len(ids) else 0)
                if (a == 0 or a == done or np.array_equal(new[:x], ids[a : a + x])) and (not y or np.array_equal(new[len(new) - y :], ids[b - y : b])):
                    break
                reach *= 2
            out += [ids[done:a], new]
            done, k = b, last + 1
        return np.concatenate([*out, ids[done:]])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    turn_to("chunks", _codecs.clear)
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


# ---- Spark


def first_pass(docs: DataFrame, path: str, held, bits: int = FILTER_BITS, text: str = "text") -> DataFrame:
    """Results of documents without a shared chunk; of others, the ids of what they do not share, and references to what they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part, texts in _slices(batches, text):
            rows: list[tuple] = []
            spans: list[tuple[int, bytes]] = []  # (row of `rows`, text to encode)
            ends = list(borders(texts))
            keys = [key_of(t[a:b]) for t, e in zip(texts, ends, strict=True) for a, b in zip([0, *e], e, strict=False)]
            flags, at = is_shared(held.value, keys, bits).tolist(), 0
            for row, doc, t, e in zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), texts, ends, strict=True):
                mine, names = flags[at : at + len(e)], keys[at : at + len(e)]
                at += len(e)
                if not any(mine):
                    spans.append((len(rows), t))
                    rows.append((row, doc, 0, DONE, None))
                    continue
                begun = 0
                for k, (a, b) in enumerate(zip([0, *e], e, strict=False)):
                    if mine[k]:
                        if begun < a:
                            spans.append((len(rows), t[begun:a]))
                            rows.append((row, doc, k - 1, OWN, None))
                        rows.append((row, doc, k, SHARED, names[k]))
                        begun = b
                if begun < len(t):
                    spans.append((len(rows), t[begun:]))
                    rows.append((row, doc, len(e), OWN, None))
            ids: list[bytes | None] = [None] * len(rows)
            results: list[tuple] = [(None, None, None)] * len(rows)
            for (k, _), found in zip(spans, c.encode([t for _, t in spans]), strict=True):
                if rows[k][3] == DONE:
                    results[k] = c.result(found)
                else:
                    ids[k] = found.tobytes()
            columns = [*zip(*rows, strict=True)] if rows else [[]] * 5
            more = [*zip(*results, strict=True)] if rows else [[]] * 3
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([*columns, ids, *more], kinds, strict=True)], names=[x.split()[0] for x in _ROWS.split(", ")])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, _ROWS)


def dictionary(docs: DataFrame, path: str, held, bits: int = FILTER_BITS, text: str = "text") -> DataFrame:
    """key, ids of every distinct shared chunk, each encoded once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _slices(batches, text):
            chunks = {key_of(x): x for t, ends in zip(texts, borders(texts), strict=True) for x in (t[a:b] for a, b in zip([0, *ends], ends, strict=False))}
            keys = list(chunks)
            keys = [k for k, f in zip(keys, is_shared(held.value, keys, bits).tolist(), strict=True) if f]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([chunks[k] for k in keys], pa.binary())], names=["key", "chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [x.tobytes() for x in c.encode(batch.column("chunk").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.binary())], names=["key", "ids"])

    return docs.select(text).mapInArrow(cut, "key binary, chunk binary").dropDuplicates(["key"]).mapInArrow(encode, "key binary, ids binary")


def assemble(pieces: DataFrame, path: str) -> DataFrame:
    """Rows (row, doc_id, piece, ids) to one result a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        row, doc, held = None, None, []
        out: list[tuple] = []
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        ready = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        for batch in batches:
            for now, d, ids in zip(*(batch.column(x).to_pylist() for x in ("row", "doc_id", "ids")), strict=True):
                if now != row and row is not None:
                    out.append((doc, *c.result(c.repair(held))))
                    held = []
                row, doc = now, d
                held.append(np.frombuffer(ids, c.kind))
            if len(out) > 1000:
                yield ready()
                out = []
        if row is not None:
            out.append((doc, *c.result(c.repair(held))))
        if out:
            yield ready()

    return pieces.select("row", "doc_id", "piece", "ids").repartition("row").sortWithinPartitions("row", "piece").mapInArrow(run, _RESULT)


def round_trip(docs: DataFrame, path: str, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of docs(doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(shared_filter(docs, bits=bits))
    rows, _ = written(first_pass(docs, path, held, bits), "pieces")
    known = dictionary(docs, path, held, bits)
    shared = rows.filter(F.col("kind") == SHARED).select("row", "doc_id", "piece", "key").join(known, "key").select("row", "doc_id", "piece", "ids")
    own = rows.filter(F.col("kind") == OWN).select("row", "doc_id", "piece", "ids")
    done = rows.filter(F.col("kind") == DONE).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    return done.unionByName(assemble(own.unionByName(shared), path))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("byte_bpe_50k.json"))
