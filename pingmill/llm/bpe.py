"""Byte-level BPE encoding and decoding.

Encoding compiles the ranks into a transducer that is determinised lazily. A hypothesis is (last token, node of the token trie,
tokens not yet sent): it says that the bytes so far are some tokens and the beginning of one more. On a byte each hypothesis walks
down the trie, and where it reaches a token that the merges would leave beside its last token, a new hypothesis starts at the root;
only one such token exists for each prefix. The set of hypotheses is a state; the tokens on which all of them agree are sent at
once, so lookahead ends after the longest token. States and transitions are made when first met and dropped when too many.

Two neighbours stay apart if no merge crosses their border: the pieces that stand at the border while each token is built are
compared in the order in which the merges happen.

Decoding joins the tokens' bytes and passes them through an incremental UTF-8 state machine. Its state is what may follow: how many
bytes are missing and the range of the next one. It gives out whole characters, holds back an unfinished one from step to step, and
takes a sequence as malformed at the first byte that cannot continue it (ids in any order may spell such bytes).

Defined results: null and empty texts have no tokens; every other text decodes to itself, byte for byte; equal texts have equal
ids; texts of any length are read in steps of bounded size (a run without white space is one piece, as the pattern has it); repeated
rows are all kept; an empty table gives an empty result; new columns whose names the table has already get leading underscores. A
vocabulary must hold all 256 bytes, else a ValueError names the missing ones.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingmill.llm.common import encode_by_chunks, fresh, ship, spread, table, text_slices, turn_to

#: White space as the Unicode property has it.
SPACE = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
MOST_STATES = 250_000
MOST_PAIRS = 500_000
#: Chunks remembered by each of two generations, and the longest chunk remembered.
MEMO, MEMO_CHARS = 160_000, 64
#: Bytes of text encoded at once.
AT_ONCE = 4 << 20
NEVER = 1 << 60


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        if lacking := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary has no token for the bytes {lacking}")
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.most_states = most_states
        #: The trie by node number: bytes to nodes, and the token that ends there (-1: none). Node 0 is the root.
        self.below: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        self.spines: dict[int, tuple[list, list]] = {}
        self.hopeful: dict[int, bool] = {}
        for token, i in ranks.items():
            node = 0
            for b in token:
                child = self.below[node].get(b)
                if child is None:
                    child = self.below[node][b] = len(self.below)
                    self.below.append({})
                    self.ends.append(-1)
                node = child
            self.ends[node] = i
        self._reset()

    def _reset(self) -> None:
        self.states: dict[bytes, dict] = {}
        if len(self.hopeful) > MOST_PAIRS:
            self.hopeful.clear()
        self.start = self._state([(-1, 0, ())])

    # -- the merges

    def merge(self, data: bytes) -> list[bytes]:
        """Plain merging: the least rank first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if best == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: int) -> tuple[list, list] | None:
        """(left, right): pieces at each end of the token while it is built, with the rank of the merge that takes each one up.

        None if the merges do not build the token from its bytes.
        """
        if token in self.spines:
            return self.spines[token]
        data = self.tokens[token]
        parts = [data[i : i + 1] for i in range(len(data))]
        left, right = [], []
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if best == NEVER:
                break
            if at == 0:
                left.append((parts[0], best))
            if at == len(parts) - 2:
                right.append((parts[-1], best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        found = ([*left, (data, NEVER)], [*right, (data, NEVER)]) if len(parts) == 1 else None
        self.spines[token] = found
        return found

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the merges leave token a beside token b. Both ends' pieces are compared in the order of the merges."""
        x, y = self.spine(a), self.spine(b)
        if x is None or y is None:
            return False
        rank = self.ranks.get
        lefts, rights = iter(x[1]), iter(y[0])
        left, taken_left = next(lefts)
        right, taken_right = next(rights)
        while True:
            across = rank(left + right)
            if across is not None and across < taken_left and across <= taken_right:
                return False
            if taken_left <= taken_right:
                if taken_left == NEVER:
                    return True
                left, taken_left = next(lefts)
            else:
                right, taken_right = next(rights)

    def alive(self, last: int, node: int) -> bool:
        """Whether any token below the node may stand beside `last`. Without this check dead hypotheses would multiply the states."""
        key = last << 32 | node
        known = self.hopeful.get(key)
        if known is None:
            known, todo = False, list(self.below[node].values())
            while todo and not known:
                x = todo.pop()
                known = self.ends[x] >= 0 and self.stay_apart(last, self.ends[x])
                todo += self.below[x].values()
            self.hopeful[key] = known
        return known

    # -- the automaton: a state maps a byte to (state, tokens sent); -1 holds the tokens owed at the end, -2 the packed hypotheses

    def _state(self, hypotheses: list[tuple]) -> dict:
        packed = array("i", [x for last, node, out in hypotheses for x in (last, node, len(out), *out)]).tobytes()
        state = self.states.get(packed)
        if state is None:
            owed = next((out for _, node, out in hypotheses if not node), None)
            state = self.states[packed] = {-1: owed, -2: packed}
        return state

    def _step(self, state: dict, byte: int) -> tuple[dict, tuple]:
        after, packed, at = [], array("i", state[-2]), 0
        while at < len(packed):
            last, node, n = packed[at : at + 3]
            out = tuple(packed[at + 3 : at + 3 + n])
            at += 3 + n
            node = self.below[node].get(byte)
            if node is None:
                continue
            token = self.ends[node]
            if token >= 0 and (self.spine(token) is not None if last < 0 else self.stay_apart(last, token)):
                after.append((token, 0, (*out, token)))
            if self.below[node] and (last < 0 or self.alive(last, node)):
                after.append((last, node, out))
        sent = after[0][2]
        for _, _, out in after[1:]:
            n = 0
            for x, y in zip(sent, out, strict=False):
                if x != y:
                    break
                n += 1
            sent = sent[:n]
        if len(self.states) >= self.most_states:
            self._reset()
        reached = self._state([(last, node, out[len(sent) :]) for last, node, out in after])
        state[byte] = found = (reached, sent)
        return found

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state = self.start
        for byte in data:
            found = state.get(byte)
            if found is None:
                found = self._step(state, byte)
            state, sent = found
            if sent:
                out += sent
        out += state[-1]
        return out


def _leads() -> dict[int, tuple[int, int, int]]:
    """First byte of a character of several bytes -> how many follow, and the range of the next one."""
    out = {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}
    out |= {b: (2, 0x80, 0xBF) for b in range(0xE0, 0xF0)} | {b: (3, 0x80, 0xBF) for b in range(0xF0, 0xF5)}
    # No overlong forms, no surrogates, nothing beyond U+10FFFF.
    return out | {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)}


LEADS = _leads()
HIGH = re.compile(rb"[\x80-\xff]+")
REPLACEMENT = "\ufffd".encode()


class Utf8Machine:
    """Incremental UTF-8: feed() gives the bytes of whole characters. A malformed sequence (the longest beginning of a character that
    cannot go on) is counted, and comes out as it is or, with `replace`, as one U+FFFD."""

    def __init__(self, replace: bool = False) -> None:
        self.replace, self.malformed = replace, 0
        self.held, self.missing, self.low, self.high = bytearray(), 0, 0, 0

    def _reject(self, out: bytearray, sequence: bytes) -> None:
        self.malformed += 1
        out += REPLACEMENT if self.replace else sequence
        self.held, self.missing = bytearray(), 0

    def _step(self, out: bytearray, byte: int) -> None:
        if self.missing:
            if self.low <= byte <= self.high:
                self.held.append(byte)
                self.missing, self.low, self.high = self.missing - 1, 0x80, 0xBF
                if not self.missing:
                    out += self.held
                    self.held = bytearray()
                return
            self._reject(out, self.held)
        if byte in LEADS:
            self.held.append(byte)
            self.missing, self.low, self.high = LEADS[byte]
        else:
            self._reject(out, bytes([byte]))

    def feed(self, data: bytes) -> bytes:
        if not self.missing and data.isascii():  # the machine stays in its first state
            return data
        out, at = bytearray(), 0
        for run in HIGH.finditer(data):
            self._ascii(out, data[at : run.start()])
            for byte in run[0]:
                self._step(out, byte)
            at = run.end()
        self._ascii(out, data[at:])
        return bytes(out)

    def _ascii(self, out: bytearray, data: bytes) -> None:
        if data and self.missing:
            self._reject(out, self.held)
        out += data

    def finish(self) -> bytes:
        out = bytearray()
        if self.missing:
            self._reject(out, self.held)
        return bytes(out)


class Codec:
    """Encodes whole texts to packed ids and back. Chunks between single spaces are remembered, in two generations of bounded size."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.fst = Transducer(ranks)
        self.bytes_of = [self.fst.tokens.get(i, b"") for i in range(max(self.fst.tokens) + 1)]
        pattern = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.pieces = regex.compile(pattern)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pack(self, chunk: str) -> bytes:
        if len(chunk) > MEMO_CHARS:
            return b"".join(self._whole(x) for x in self.pieces.findall(chunk))
        packed = self.old.get(chunk)
        if packed is None:
            # Letters with a space before them are one piece, and a last character of another kind is the next.
            body = chunk[1:] if chunk[0] == " " else chunk
            found = [chunk] if body.isalpha() else [chunk[:-1], chunk[-1]] if body[:-1].isalpha() and chunk[-1] in ".,;:!?" else self.pieces.findall(chunk)
            if len(found) == 1:
                packed = self._ids(chunk)
            else:
                packed = b"".join([self.new.get(x) or self._pack(x) for x in found])
        if len(self.new) >= MEMO:
            self.old, self.new = self.new, {}
        self.new[chunk] = packed
        return packed

    def _whole(self, piece: str) -> bytes:
        if len(piece) <= MEMO_CHARS:
            return self.new.get(piece) or self._pack(piece)
        return self._ids(piece)

    def _ids(self, piece: str) -> bytes:
        ids = array("I", self.fst.piece(piece.encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def steps(self, text: str, most: int = 1 << 20) -> Iterator[str]:
        """The text in parts that the pattern treats as it treats the whole: cut before a space between two other characters."""
        at = 0
        cut = regex.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
        while len(text) - at > most:
            found = cut.search(text, at + most)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def _chunks(self, chunks: list[str], first: bool) -> list[bytes]:
        get, out = self.new.get, []
        for c in chunks:
            if not first:
                c = " " + c
            packed = get(c)
            if packed is None:
                packed = self._pack(c) if c else b""
                get = self.new.get
            out.append(packed)
        return out

    def _text(self, text: str) -> bytes:
        return b"".join([self._whole(m[0]) for part in self.steps(text) for m in self.pieces.finditer(part)])

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return encode_by_chunks(texts, self._chunks, self._text)

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def decode(self, packed: bytes, ids_at_once: int = 1 << 16, replace: bool = False) -> Iterator[bytes]:
        """The text's bytes, cut between characters only. replace: always well-formed, with U+FFFD for malformed sequences."""
        stream, bytes_of = Utf8Machine(replace), self.bytes_of
        step = 4 * ids_at_once
        for at in range(0, len(packed), step):
            ids = memoryview(packed[at : at + step]).cast("I")
            yield stream.feed(b"".join([bytes_of[i] for i in ids]))
        if rest := stream.finish():
            yield rest


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process: its states and memory serve all of the worker's tasks."""
    turn_to("bpe", _codecs.clear)
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with a binary column of ids (little-endian unsigned 32-bit)."""
    ship(docs.sparkSession)
    (out,) = fresh(docs, out)
    schema = docs.select("*", F.lit(b"").alias(out)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for a, b in text_slices(batch, text, AT_ONCE):
                part = batch.slice(a, b - a)
                ids = pa.array(c.encode_all(part.column(text)), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, out])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the decoded bytes of a binary column of ids; null stays null."""
    ship(docs.sparkSession)
    (out,) = fresh(docs, out)
    schema = docs.select("*", F.lit(b"").alias(out)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            got = pa.array([b"".join(c.decode(x.as_py())) if x.is_valid else None for x in batch.column(ids)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs without its text, with n_tokens, ids_sha256 and decoded_sha256; one pass over slices of bounded size."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    names = fresh(docs, "n_tokens", "ids_sha256", "decoded_sha256")
    schema = docs.select(*rest, F.lit(0).cast("long").alias(names[0]), *(F.lit("").alias(n) for n in names[1:])).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for low, high in text_slices(batch, text, AT_ONCE):
                part = batch.slice(low, high - low)
                n, a, b = [], [], []
                for ids in c.encode_all(part.column(text)):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    back = hashlib.sha256()
                    for step in c.decode(ids):
                        back.update(step)
                    b.append(back.hexdigest())
                yield pa.RecordBatch.from_arrays([*(part.column(r) for r in rest), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[*rest, *names])

    return docs.mapInArrow(run, schema)


def vocabulary() -> tuple[str, str]:
    """(path, pattern) of the vocabulary that the queries use; the operators take any other."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1(spark, sf_dir: str) -> DataFrame:
    return round_trip(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), *vocabulary())
