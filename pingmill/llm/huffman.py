"""Token ids as binary files: canonical length-limited Huffman coding with one code for the whole corpus.

1. Every text is encoded once, the ids are written to the shared folder, and each task adds its counts by id; the sums over all
   tasks (one row for each id of the vocabulary) give the code lengths by package-merge, at most `LIMIT` bits.
2. Documents are range-sorted by id and written as blocks. A block holds whole documents up to about `BLOCK` ids (a longer one has
   a block of its own) and is independent: payload, ids and lengths of its documents, the number of ids before it in its part, and
   the 64-bit bit offset of every `LANE`-th id. The files are Parquet, so that Spark's commit protocol covers them.
3. The code's lengths are stored beside the blocks (`code/`: id, bits), so any later session reads the files from their folder alone.
4. Reading looks up `LIMIT` bits at once in a table; all lanes of a block are decoded side by side from their checkpoints.

Defined results: null and empty texts have the end id only; strings of special tokens in a text are treated as the library treats
them by default (they become special ids; `special_as_text` makes them ordinary text); rows of equal doc_id follow each other by
number of ids and then by a hash of them, so reruns write the same order and such rows can be split over parts; a null doc_id comes
first; an empty table gives files without blocks; ids outside the counted ones cannot occur, since all are counted; columns other
than doc_id and the text are not read, so none can clash. A block is one binary value: a document's payload must stay under 2 GiB.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pingmill.llm.common import discard, encode_by_chunks, new_path, ship, spread, table, text_slices, turn_to, written

LIMIT, BLOCK, LANE, END = 18, 1 << 16, 256, 2
MEMO, MEMO_CHARS, TOGETHER = 300_000, 64, 200
AT_ONCE = 6 << 20
FIRST, MARKS = "\udc00", ".,;:!?"
_SPACES = r"\s\x1c-\x1f\x85"

_BLOCKS = "part int, block int, first long, n_ids long, doc_ids array<long>, doc_lengths array<long>, checkpoints array<long>, payload binary"


# ---- the code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids cannot have codes of {limit} bits")
    if n <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    packages, levels = np.zeros(0), []
    for _ in range(limit):
        items = np.concatenate([leaves, packages])
        at = np.argsort(items, kind="stable")
        levels.append(at < n)
        items = items[at]
        even = len(items) // 2 * 2
        packages = items[0:even:2] + items[1:even:2]
    take, lengths = 2 * (n - 1), np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        k = int(is_leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out[order] = lengths
    return out


@dataclass
class Code:
    lengths: np.ndarray
    limit: int = LIMIT

    def __post_init__(self):
        symbols = np.flatnonzero(self.lengths)
        order = symbols[np.lexsort((symbols, self.lengths[symbols]))]
        n = self.lengths[order]
        spans = np.int64(1) << (self.limit - n)
        starts = np.concatenate([[0], np.cumsum(spans)[:-1]]) if len(order) else spans
        self.codes = np.zeros(len(self.lengths), np.uint64)
        self.codes[order] = (starts >> (self.limit - n)).astype(np.uint64)
        self.symbol_at = np.zeros(1 << self.limit, np.uint32)
        self.length_at = np.ones(1 << self.limit, np.uint8)
        filled = int(spans.sum())
        self.symbol_at[:filled] = np.repeat(order, spans)
        self.length_at[:filled] = np.repeat(n, spans)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Payload and the bit offset of every LANE-th id."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = ends - n
        word, shift = at >> 5, (64 - n - (at & 31)).astype(np.uint64)
        value = self.codes[ids] << shift
        words = np.zeros(int(ends[-1] >> 5) + 2 if len(ids) else 1, np.uint64)
        if len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            # A 32-bit word gets the upper half of the codes that begin in it and the lower half of those that begin before it.
            words[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
            words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        size = (int(ends[-1]) + 7) // 8 if len(ids) else 0
        return words.astype(">u4").tobytes()[:size], at[::LANE].astype(np.int64)

    def unpack(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """Ids of several blocks (payload, checkpoints, number of ids); the lanes of all of them advance together."""
        bits, lanes, offset = [], [], 0
        for payload, checkpoints, n in blocks:
            bits.append(payload)
            lanes.append(np.asarray(checkpoints, np.int64) + 8 * offset)
            offset += len(payload)
        data = np.frombuffer(b"".join(bits) + bytes(8), np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        at = np.concatenate(lanes) if lanes else np.zeros(0, np.int64)
        out = np.empty((len(at), LANE), np.uint32)
        drop, last = np.uint32(32 - self.limit), len(window) - 1
        for k in range(LANE):
            code = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> drop
            out[:, k] = self.symbol_at[code]
            at += self.length_at[code]
        found, lane = [], 0
        for _, checkpoints, n in blocks:
            found.append(out[lane : lane + len(checkpoints)].ravel()[:n])
            lane += len(checkpoints)
        return found


# ---- text to ids, by the tokenizers library


def id_kind(size: int) -> tuple[str, int]:
    """How ids of a vocabulary travel: little-endian unsigned integers of two bytes where they fit, else four."""
    return ("<u2", 2) if size <= 1 << 16 else ("<u4", 4)


def vocabulary_kind(path: str) -> tuple[str, int]:
    from tokenizers import Tokenizer

    return id_kind(Tokenizer.from_file(path).get_vocab_size())


class Encoder:
    """Whole texts to ids with a byte-level vocabulary of the tokenizers library.

    The vocabulary's own pattern never joins two words over a single space between two other characters, so texts are cut there;
    the library encodes each distinct chunk once, and chunks are remembered in two generations of bounded size.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        size = self.library.get_vocab_size()
        self.size = size
        self.opens = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.cut = re.compile(f"(?<=[^{_SPACES}])(?= [^{_SPACES}])")
        self.kind, self.width = id_kind(size)
        self.marks = {m: np.array(self.library.encode(m, add_special_tokens=False).ids, self.kind).tobytes() for m in MARKS}
        self.new: dict[str, bytes] = {"": self._empty(), FIRST: b""}
        self.old: dict[str, bytes] = {}

    def _empty(self) -> bytes:
        """A space with nothing after it: only the end of a text has one."""
        return np.array(self.library.encode(" ", add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of new chunks. Plain words are encoded many in one text: only their first ids begin with a space."""
        found: dict[str, bytes] = {}
        plain = [k for k in keys if k and k[0] != FIRST and " " not in k and not k[0].isspace() and not k[-1].isspace()]
        parts = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        for part, e in zip(parts, self.library.encode_batch_fast([" " + " ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(part):
                packed, at = ids.tobytes(), (self.width * starts).tolist()
                found.update(zip(part, [packed[x:y] for x, y in zip(at, [*at[1:], len(packed)], strict=True)], strict=True))
        odd = [k for k in keys if k not in found]
        for k, e in zip(odd, self.library.encode_batch_fast([k[1:] if k[:1] == FIRST else " " + k for k in odd], add_special_tokens=False), strict=True):
            found[k] = np.array(e.ids, self.kind).tobytes()
        return found

    def _codes(self, keys: list[str]) -> list[bytes]:
        """Codes of distinct keys, from memory or from the library."""
        new, old, todo, ended = self.new, self.old, set(), []
        for k in keys:
            if k not in new:
                packed = old.get(k)
                if packed is not None:
                    new[k] = packed
                elif k[-1:] in MARKS and k[:-1].isalpha():  # letters and a mark are two matches of the pattern
                    ended.append(k)
                    todo.add(k[:-1])
                else:
                    todo.add(k)
        for k in [k for k in todo if k in new or k in old]:
            new.setdefault(k, old.get(k))
            todo.discard(k)
        new.update(self._learn(list(todo)))
        for k in ended:
            new[k] = new[k[:-1]] + self.marks[k[-1]]
        found = [new[k] for k in keys]
        for k in todo:
            if len(k) > MEMO_CHARS:
                del new[k]
        if len(new) > MEMO:
            self.old, self.new = new, {}
        return found

    def _chunks(self, chunks: list[str], first: bool) -> list[bytes]:
        """A chunk stands for itself after a space; one without has a mark that no text can hold."""
        return self._codes([FIRST + c for c in chunks] if first else chunks)

    def _whole(self, text: str) -> bytes:
        first, *rest = self.cut.split(text)
        parts = [FIRST + first, *[x[1:] for x in rest]]
        code = dict(zip(distinct := list(dict.fromkeys(parts)), self._codes(distinct), strict=True))
        return b"".join(map(code.__getitem__, parts))

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Little-endian unsigned ids of each text, `width` bytes each."""
        return encode_by_chunks(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), self._chunks, self._whole)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder a worker process: its memory of chunks serves all of the worker's tasks."""
    turn_to("huffman", _encoders.clear)
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = Encoder(path, special_as_text)
    return _encoders[path, special_as_text]


# ---- Spark


def encode_ids(docs: DataFrame, vocabulary: str, text: str = "text", end: int | None = END, special_as_text: bool = False) -> DataFrame:
    """Rows (doc_id, n, ids) for documents, and rows (id, n, null) at the end of each task: how often it met each id."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, special_as_text)
        counts = np.zeros(max(enc.size, (end or 0) + 1), np.int64)
        tail = b"" if end is None else int(end).to_bytes(enc.width, "little")
        for batch in batches:
            for a, b in text_slices(batch, text, AT_ONCE):
                part = batch.slice(a, b - a)
                ids = [x + tail for x in enc.encode(part.column(text))]
                counts += np.bincount(np.frombuffer(b"".join(ids), enc.kind), minlength=len(counts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // enc.width for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n", "ids"])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used]), pa.nulls(len(used), pa.binary())], names=["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n long, ids binary")


def global_code(encoded: DataFrame, limit: int = LIMIT) -> Code:
    """The code for the ids' counts over all tasks; one row an id of the vocabulary comes to the driver."""
    rows = encoded.filter("ids IS NULL").groupBy("doc_id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["doc_id"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["doc_id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return Code(code_lengths(counts, limit), limit)


def write_blocks(encoded: DataFrame, code: Code, path: str, kind: str, width: int) -> None:
    """Blocks of all documents in ascending order of (doc_id, number of ids, hash of the ids), as files in `path`."""
    parts = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lengths = code.lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Code(lengths, code.limit)
        part, number, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        n = 0

        def close() -> pa.RecordBatch:
            nonlocal held, n, number, first
            payload, checkpoints = packer.pack(np.frombuffer(b"".join(x for _, x in held), kind).astype(np.int64))
            row = [part], [number], [first], [n], [[d for d, _ in held]], [[len(x) // width for _, x in held]], [checkpoints], [payload]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _BLOCKS.split(", ")])
            number, first, held, n = number + 1, first + n, [], 0
            return out

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = ids.as_py()
                if n and n + len(ids) // width > BLOCK:
                    yield close()
                held.append((doc, ids))
                n += len(ids) // width
        if held:
            yield close()

    rows = encoded.filter("ids IS NOT NULL").select("doc_id", "n", F.xxhash64("ids").alias("h"), "ids")
    order = ["doc_id", "n", "h"]
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, _BLOCKS).write.option("compression", "none").parquet(path)


def save_code(spark: SparkSession, code: Code, path: str) -> None:
    """The code as a table (limit, id, bits), at most one row an id of the vocabulary."""
    used = np.flatnonzero(code.lengths)
    rows = pd.DataFrame({"limit": np.full(len(used), code.limit, np.int32), "id": used.astype(np.int64), "bits": code.lengths[used].astype(np.int32)})
    spark.createDataFrame(rows, "limit int, id long, bits int").coalesce(1).write.parquet(path)


def load_code(spark: SparkSession, path: str) -> Code:
    rows = spark.read.parquet(path).toPandas()  # one row an id of the vocabulary at most
    lengths = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    lengths[rows["id"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return Code(lengths, int(rows["limit"].iloc[0]) if len(rows) else LIMIT)


def read_documents(blocks: DataFrame, code: Code, want_ids: bool = False) -> DataFrame:
    """part, start in the part, doc_id, n_tokens, ids_crc32 (and ids) of every document in the blocks."""
    lengths, limit = code.lengths, code.limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Code(lengths, limit)
        for batch in batches:
            for a in range(0, batch.num_rows, 16):
                rows = batch.slice(a, 16).to_pylist()
                parts, starts, docs, counts, crcs, all_ids = [], [], [], [], [], []
                for row, ids in zip(rows, reader.unpack([(r["payload"], r["checkpoints"], r["n_ids"]) for r in rows]), strict=True):
                    data, at = memoryview(ids.astype("<u4").tobytes()), 0
                    for doc, n in zip(row["doc_ids"], row["doc_lengths"], strict=True):
                        piece = data[4 * at : 4 * (at + n)]
                        parts.append(row["part"])
                        starts.append(row["first"] + at)
                        docs.append(doc)
                        counts.append(n)
                        crcs.append(zlib.crc32(piece))
                        all_ids.append(bytes(piece) if want_ids else None)
                        at += n
                columns = [pa.array(parts, pa.int32()), pa.array(starts, pa.int64()), pa.array(docs, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array(all_ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "at", "doc_id", "n_tokens", "ids_crc32", "ids"])

    return blocks.mapInArrow(run, "part int, at long, doc_id long, n_tokens long, ids_crc32 long, ids binary")


def token_files(docs: DataFrame, vocabulary: str, path: str, special_as_text: bool = False) -> None:
    """Encodes docs(doc_id, text) and writes the block files and their code under `path`."""
    encoded, held = written(encode_ids(docs, vocabulary, special_as_text=special_as_text), "ids")
    code = global_code(encoded)
    write_blocks(encoded, code, f"{path}/blocks", *vocabulary_kind(vocabulary))
    save_code(docs.sparkSession, code, f"{path}/code")
    discard(docs.sparkSession, held)


def read_files(spark: SparkSession, path: str, want_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (, ids) from the files under `path`."""
    code, blocks = load_code(spark, f"{path}/code"), spark.read.parquet(f"{path}/blocks")
    # One row a part: its window without keys sees as many rows as there are files.
    before = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    rows = read_documents(blocks, code, want_ids).join(F.broadcast(before), "part")
    out = rows.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if want_ids else out.drop("ids")


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    token_files(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_files(spark, path)
