"""The whole corpus pipeline against a plain version of every stage: sets, all pairs, re, loops and tiktoken."""

import base64
import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import tiktoken
from pyspark.ml.linalg import Vectors
from test_near import groups, plain_fingerprint
from test_rest import SMALL, plain_scan, water_fill

import corpus_pipeline
from pingmill.llm import bpe, language, secrets


def plain_languages(rows):
    """doc_id -> does the first stage keep it, by dictionaries of n-grams."""
    grams = {i: np.concatenate([k for k, _ in language.pieces([t])] or [np.zeros(0, np.uint64)]).tolist() for i, t, *_ in rows}
    counts = {}
    for i, _, lang, _ in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            counts.setdefault(lang, Counter()).update(grams[i])
    share = {x: {k: n / sum(c.values()) for k, n in c.items()} for x, c in counts.items()}
    top = Counter()
    for c in share.values():
        for k, p in c.items():
            top[k] = max(top[k], p)
    typical = {x: {k for k, p in c.items() if p >= language.MIN_FREQUENCY and p >= language.RATIO * top[k]} for x, c in share.items()}
    best = lambda keys: max((sum(k in share[x] for k in keys) + sum(k in typical[x] for k in keys)) / 2 / len(keys) for x in share)
    return {i for i, keys in grams.items() if keys and best(keys) >= corpus_pipeline.LEAST_LANGUAGE_SHARE}


def plain_mix(rows):
    """(doc_id, passes) by walking each source's documents in the order of their hash."""
    names = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    size = {i: len([w for w in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]) for i, t, *_ in rows}
    totals = [sum(size[i] for i, _, _, s in rows if s == name) for name in names]
    targets = water_fill(totals, [(5, 2, 1)[k % 3] for k in range(len(names))])
    out = {}
    for name, total, target in zip(names, totals, targets, strict=True):
        place = 0
        for _, i in sorted((int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), i) for i, _, _, s in rows if s == name):
            full = int(target / total)
            out[i] = min(3, full + (target - full * total > place + size[i] / 2)) if size[i] else 0
            place += size[i]
    return out


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.collect()]
    kept = plain_languages(rows)
    rows = [r for r in rows if r[0] in kept]
    fps = {i: plain_fingerprint(t) for i, t, *_ in rows}
    ids = sorted(fps)
    near = groups([(a, b) for k, a in enumerate(ids) for b in ids[:k] if (fps[a] ^ fps[b]).bit_count() <= 3], ids)
    rows = [r for r in rows if near[r[0]] == r[0]]
    model = secrets.train(secrets.labelled(spark))
    probability = lambda x: float(model.predictProbability(Vectors.dense(x))[1])
    clean = []
    for i, text, *rest in rows:
        for v in sorted((v for v, (_, _, p) in plain_scan(text, probability).items() if p >= secrets.THRESHOLD), key=len, reverse=True):
            text = text.replace(v, "[SECRET]")
        clean.append((i, text, *rest))
    passes = plain_mix(clean)
    path, pattern = bpe.vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, text, lang, source in clean:
        x = encoding.encode_ordinary(text)
        want[i, lang, source, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] = passes[i]
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, SMALL).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == +want and 100 < len(got)
