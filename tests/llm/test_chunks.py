"""Encoding by shared chunks against the tokenizers library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pingmill.llm import chunks

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "The", " ", " ", "  ", "\n", ",", "é", "’s", "'s", "'", "re", "12", "漢", "　", "\xa0", "<|endoftext|>", " word", " другой", "ll'll", "<|end", "of"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return chunks.Codec(PATH)


def plain(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    back = t.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=40), st.lists(st.integers(0, 160), max_size=6))
def test_joins_are_repaired(codec, library, parts, cuts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    cuts = sorted({min(x, len(text)) for x in cuts})
    pieces = codec.encode([text[a:b].encode() for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)])
    got = codec.repair(pieces)
    assert got.tolist() == library.encode(text, add_special_tokens=False).ids
    assert codec.result(got) == plain(library, text)


def test_cuts_inside_special_tokens_and_runs(codec, library):
    for text in ("a<|endoftext|>b c<|endoftext|>", "x" * 300, " " * 90 + "y", "漢字" * 60, "I'll they're " * 8):
        for a in range(0, len(text), 7):
            for b in range(a, min(a + 40, len(text)), 5):
                got = codec.repair(codec.encode([text[:a].encode(), text[a:b].encode(), text[b:].encode()]))
                assert got.tolist() == library.encode(text, add_special_tokens=False).ids


def test_borders_depend_on_the_content_alone():
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdé漢 \n") for _ in range(60_000)).encode()
    (ends,) = chunks.borders([text])
    own = {text[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    assert ends[-1] == len(text) and len(ends) > 20 and max(map(len, own)) <= chunks.MOST
    assert all(x.decode() for x in own)
    later = "an insertion é ".encode() + text
    _, other = chunks.borders([b"before", later])
    shifted = {later[a:b] for a, b in zip([0, *other], other, strict=False)}
    assert len(own & shifted) >= len(own) - 3
    assert list(chunks.borders([b"", b"x", "é".encode() * 20_000]))[:2] == [[], [1]]


@pytest.mark.parametrize("least, zeros, bits", [(256, 10, 1 << 26), (40, 4, 1 << 26), (40, 4, 64)])
def test_query_13(docs, folder, spark, library, monkeypatch, least, zeros, bits):
    """Shared passages, shifted, in long and short documents; and with a filter so small that most chunks count as shared."""
    for name, value in (("LEAST", least), ("ZEROS", zeros)):
        monkeypatch.setattr(chunks, name, value)
    rnd = random.Random(7)
    some = lambda n: "".join(rnd.choice(PIECES) for _ in range(n))
    passages = [some(700) for _ in range(6)]
    rows = [(i, "".join(rnd.choice([some(rnd.randint(0, 200)), rnd.choice(passages)]) for _ in range(rnd.randint(1, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, passages[0]), (102, passages[0]), (None, passages[0]), (103, "word " * 30_000), (104, "word " * 30_000), (105, "x" * 50_000), (106, "x" * 50_000 + " y")]
    rows = [(i, t.encode("utf-8", "ignore").decode() if t else t) for i, t in rows]
    monkeypatch.setattr(chunks.round_trip, "__defaults__", (bits,))
    got = [tuple(r) for r in chunks.op13(spark, folder(documents=docs(rows))).collect()]
    assert sorted(got, key=str) == sorted([(i, *plain(library, t)) for i, t in rows], key=str)


def test_shared_chunks_are_encoded_once(docs, spark, library):
    """The dictionary holds each shared chunk once, and every chunk that occurs twice is in it."""
    rnd = random.Random(9)
    passage = "".join(rnd.choice(["word ", "other ", "and, ", "é "]) for _ in range(3000))
    df = docs([(i, f"{i} {passage}{i}") for i in range(8)] + [(9, None)]).select("doc_id", "text")
    chunks.ship(spark)
    held = spark.sparkContext.broadcast(chunks.shared_filter(df))
    found = {bytes(r.key): bytes(r.ids) for r in chunks.dictionary(df, PATH, held).collect()}
    seen: dict[bytes, int] = {}
    for i in range(8):
        text = f"{i} {passage}{i}".encode()
        (ends,) = chunks.borders([text])
        for a, b in zip([0, *ends], ends, strict=False):
            seen[text[a:b]] = seen.get(text[a:b], 0) + 1
    twice = {x for x, n in seen.items() if n > 1}
    assert len(twice) > 5 and {chunks.key_of(x) for x in twice} == set(found)
    assert all(np.frombuffer(found[chunks.key_of(x)], "<u2").tolist() == library.encode(x.decode(), add_special_tokens=False).ids for x in twice)


def test_no_documents(docs, folder, spark):
    assert chunks.op13(spark, folder(documents=docs([(1, "a")]).limit(0))).collect() == []
