import base64
import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pingmill.llm import bpe, huffman
from pingmill.llm.common import new_path

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n b", "don't", "\x1c\x1d x", "　漢字 仮名", "😀‍😀", "é", "x" * 300, "ab " * 3000, "<|endoftext|>", "\0 \0", "1²Ⅷ٣", "a  b", "​ \xa0 .", "Ünïcödé straße", "\r\n\r\n", "The The The"]


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(*bpe.vocabulary())


@pytest.fixture(scope="module")
def reference():
    path, pattern = bpe.vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_odd_texts(codec, reference):
    for text, packed in zip(ODD, codec.encode_all(pa.array(ODD)), strict=True):
        assert ids(packed) == reference.encode_ordinary(text), repr(text)
        assert b"".join(codec.decode(packed)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    c = bpe.codec(*bpe.vocabulary())
    assert b"".join(c.decode(c.encode(text), ids_at_once=2)) == text.encode()
    assert ids(c.encode(text)) == test_any_text.reference.encode_ordinary(text)


@pytest.fixture(autouse=True)
def _give_reference(reference):
    test_any_text.reference = reference


def test_transducer_against_plain_merging(codec):
    rnd = random.Random(3)
    fst = bpe.Transducer(codec.fst.ranks, most_states=500)  # states are dropped on the way
    for _ in range(3000):
        word = "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 18))).encode()
        want = [fst.ranks[word]] if word in fst.ranks else [fst.ranks[p] for p in fst.merge(word)]
        assert fst.piece(word) == want


def test_stream_never_cuts_a_character():
    data = "aé漢😀".encode() * 50
    s = bpe.Utf8Machine()
    parts = [s.feed(data[i : i + 3]) for i in range(0, len(data), 3)]
    assert b"".join(parts) + s.finish() == data and s.malformed == 0
    for p in parts:
        p.decode()
    s = bpe.Utf8Machine()
    assert s.feed(b"a\xf0\x9f") == b"a" and s.finish() == b"\xf0\x9f" and s.malformed == 1


def test_machine_on_all_malformed_prefixes():
    """Every sequence of up to four bytes from the borders of all ranges, fed byte by byte and whole, against the library's decoder."""
    edges = [0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC2, 0xDF, 0xE0, 0xE1, 0xED, 0xEF, 0xF0, 0xF1, 0xF4, 0xF5, 0xFF]
    for n in range(1, 5):
        for combo in itertools.product(edges, repeat=n):
            data = bytes(combo)
            one, raw, whole = bpe.Utf8Machine(replace=True), bpe.Utf8Machine(), bpe.Utf8Machine(replace=True)
            parts = [one.feed(bytes([b])) for b in data] + [one.finish()]
            assert "".join(p.decode() for p in parts) == data.decode("utf-8", "replace"), data
            assert (whole.feed(data) + whole.finish()).decode() == data.decode("utf-8", "replace"), data
            assert raw.feed(data) + raw.finish() == data and raw.malformed == one.malformed == whole.malformed


def test_ids_in_any_order_decode(codec):
    rnd = random.Random(9)
    for _ in range(200):
        picked = [rnd.randrange(50_000) for _ in range(30)]
        data = b"".join(codec.bytes_of[i] for i in picked)
        packed = struct.pack("<30I", *picked)
        assert b"".join(codec.decode(packed, ids_at_once=4)) == data
        assert b"".join(codec.decode(packed, ids_at_once=4, replace=True)).decode() == data.decode("utf-8", "replace")


def test_a_vocabulary_must_hold_all_bytes():
    with pytest.raises(ValueError, match="97"):
        bpe.Transducer({bytes([b]): b for b in range(256) if b != 97})


def test_a_worker_that_turns_to_another_operator_lets_go():
    from pingmill.llm import common

    bpe.codec(*bpe.vocabulary())
    common.turn_to("bpe")
    assert bpe._codecs
    common.turn_to("another")
    assert not bpe._codecs and not common._memories


def test_query_1(docs, folder, spark, reference):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(90, None), (None, "x"), (3, "a")]
    d = folder(documents=docs(rows))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op1(spark, d).collect())
    want = []
    for i, t in rows:
        x = reference.encode_ordinary(t or "")
        want.append((i is not None, i or 0, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.op1(spark, folder_empty(spark, d)).count() == 0


def folder_empty(spark, d):
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.mode("overwrite").parquet(f"{d}/empty/documents.parquet")
    return f"{d}/empty"


def test_encode_and_decode_columns(docs, spark):
    df = docs([(1, "a b"), (2, None)]).withColumn("IDS", F.lit("mine"))
    out = bpe.decode(bpe.encode(df, *bpe.vocabulary()), *bpe.vocabulary(), ids="_ids")
    assert {r.doc_id: bytes(r.decoded).decode() for r in out.collect()} == {1: "a b", 2: ""}
    assert "IDS" in out.columns


# ---- Huffman


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = rng.zipf(1.3, rng.integers(2, 200)).clip(max=10**9)
        free, tight = huffman.code_lengths(counts, 40), huffman.code_lengths(counts, 8)
        for n in (free, tight):
            assert sum(2.0**-x for x in n) <= 1 + 1e-12
        assert tight.max() <= 8
        assert (free * counts).sum() == plain_huffman_cost(counts.tolist()) <= (tight * counts).sum()
    assert huffman.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def plain_huffman_cost(counts):
    import heapq

    heapq.heapify(counts)
    cost = 0
    while len(counts) > 1:
        x = heapq.heappop(counts) + heapq.heappop(counts)
        cost += x
        heapq.heappush(counts, x)
    return cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=1200), st.integers(0, 5))
def test_blocks_round_trip(values, seed):
    ids = np.array(values, np.int64)
    counts = np.bincount(np.concatenate([ids, [7]]), minlength=401)
    code = huffman.Code(huffman.code_lengths(counts))
    cut = [ids[:seed], ids[seed:], np.zeros(0, np.int64)]
    back = code.unpack([(*code.pack(x), len(x)) for x in cut])
    assert all((a == b).all() for a, b in zip(cut, back, strict=True))


def library(special_as_text=False):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    if special_as_text:
        t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("special_as_text", [False, True])
def test_encoder_equals_the_library(special_as_text):
    enc, t = huffman.Encoder(public_tokenizers.path("byte_bpe_50k.json"), special_as_text), library(special_as_text)
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice(["a", "The", " ", " ", "  ", "\n", ",", "é", "’s", "'s", "12", "漢", "<|endoftext|>"]) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    for got, text in zip(enc.encode(texts + [None]), texts + [""], strict=True):
        assert np.frombuffer(got, enc.kind).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_query_3(docs, folder, spark):
    rows = [(i * 3 % 29, t) for i, t in enumerate(ODD)] + [(90, None), (3, "again"), (91, "word " * 40_000)]
    d = folder(documents=docs(rows))
    got = sorted(((r.start, r.n_tokens, r.doc_id, r.ids_crc32) for r in huffman.op3(spark, d).collect()))
    t = library()
    full = {(i, tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for i, x in rows}
    at, seen = 0, -1
    for start, n, doc, crc in got:
        assert start == at and doc >= seen
        at, seen = at + n, doc
        assert any(i == doc and len(x) == n and zlib.crc32(np.array(x, "<u4").tobytes()) == crc for i, x in full)
    assert len(got) == len(rows)
    assert huffman.op3(spark, folder_empty(spark, d)).count() == 0


def test_files_hold_the_ids(docs, spark):
    vocabulary, t = public_tokenizers.path("byte_bpe_50k.json"), library()
    texts = [(2, "b b"), (1, "a <|endoftext|> b"), (None, None), (2, "c"), (2, "b d")]
    df = docs(texts).withColumn("IDS", F.lit("mine"))
    paths = [new_path(spark, "test") for _ in range(2)]
    for path, rows in zip(paths, (df, df.repartition(3)), strict=True):
        huffman.token_files(rows, vocabulary, path)
    # Another session reads them: nothing but the folder's name is passed on.
    one, two = (huffman.read_files(spark.newSession(), path, want_ids=True).orderBy("start").collect() for path in paths)
    assert one == two and [r.doc_id for r in one] == [None, 1, 2, 2, 2]
    want = {(i, *t.encode(x or "", add_special_tokens=False).ids, 2) for i, x in texts}
    assert {(r.doc_id, *np.frombuffer(r.ids, "<u4").tolist()) for r in one} == want and (1, 64, 220, 50256, 275, 2) in want
    assert [r.n_tokens for r in one[2:]] == sorted(r.n_tokens for r in one[2:])
