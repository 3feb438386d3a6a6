"""The manifest and its proofs against a plain tree in Python."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from pingmill.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        out.append(nodes)
    return out


def way(tree, at):
    out = []
    for nodes in tree[:-1]:
        run = at // 3 * 3
        out.append((nodes[run:at], nodes[at + 1 : run + 3]))
        at //= 3
    return out


def plain(rows):
    """rows (doc_id, source, lang, n_chars, text) to what the query returns."""
    key = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    trees = {s: levels([leaf_of(r) for r in sorted(mine, key=lambda r: (key(r[0]), leaf_of(r)))]) for s, mine in groups.items()}
    names = sorted(trees, key=key)
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for s, mine in groups.items():
        for at, r in enumerate(sorted(mine, key=lambda r: (key(r[0]), leaf_of(r)))):
            path = way(trees[s], at) + way(top, names.index(s))
            shown = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                shown = (*r[:4], r[4].replace("\n", ""))
            cur = leaf_of(shown)
            for left, right in path:
                cur = h(*left, cur, *right)
            root = top[-1][0]
            out.append((r[0], leaf_of(r), trees[s][-1][0], root, h(*(x for a, b in path for x in (*a, *b))), cur, cur == root))
    return out


ODD = [
    (None, None, None, None, None), (None, None, None, None, None), (7, "a", "en", 3, ""), (7, "a", "en", 3, ""), (7, "a", "en", 3, "other\n"),
    (8, "é", None, 0, "tab\tand\nline\n"), (9, "z", "en", 5, "no line"), (10, "Z", "", None, "\n"), (11, "", "x", 1, "a\r\nb"), (None, "a", "en", 1, "without id\n"),
]


@pytest.mark.parametrize("levels_a_block, part", [(6, 2048), (1, 4), (2, 7)])
def test_query_11(docs, folder, spark, monkeypatch, levels_a_block, part):
    monkeypatch.setattr(merkle, "LEVELS", levels_a_block)
    monkeypatch.setattr(merkle.prove, "__defaults__", ("leaf", None, part))
    rows = ODD + [(i, f"s{i % 2}" if i % 5 else "hot", "en", i, f"line {i}\nand more" if i % 3 else "word " * 40_000) for i in range(20, 150)]
    df = spark.createDataFrame([(i, t, lang, s, n, "x") for i, s, lang, n, t in rows], "doc_id long, text string, lang string, source string, n_chars long, SIZE string")
    got = [tuple(r) for r in merkle.op11(spark, folder(documents=df)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    assert {r[-1] for r in got} == {True, False}


def test_few_rows(docs, folder, spark, tmp_path):
    df = docs([(1, "a\nb", "en", "s", 3)])
    (r,) = merkle.op11(spark, folder(documents=df)).collect()
    assert tuple(r) == plain([(1, "s", "en", 3, "a\nb")])[0]
    df.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert merkle.op11(spark, f"{tmp_path}/empty").collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 100])
def test_missing_nodes_are_needed_and_enough(n):
    """The union is what plain proofs need less what the part can hash itself."""
    rng = np.random.default_rng(n)
    tree = [[x.encode() for x in level] for level in levels([h(str(i)) for i in range(n)])]
    for share in (0.05, 0.3, 1):
        mine = np.unique(np.append(np.flatnonzero(rng.random(n) < share), rng.integers(n)))
        union = {(level, int(p)) for level, places in merkle.missing(mine, n) for p in places}
        own = {(k, int(p) // 3**k) for p in mine for k in range(len(tree))}
        needed = {(k, p) for k, places in ((k, {q for _, o in own if _ == k for q in range(o // 3 * 3, min(o // 3 * 3 + 3, len(tree[k])))}) for k in range(len(tree) - 1)) for p in places}
        assert union == needed - own
        o = merkle.Octopus({int(p): tree[0][p] for p in mine}, n, {(k, p): tree[k][p] for k, p in union})
        assert o.root == tree[-1][0]
        ways = o.ways()
        for p in mine.tolist():
            assert [b"".join(x) for pair in way([[y for y in lv] for lv in tree], p) for x in pair] == [x for pair in ways[p] for x in pair]
            assert merkle.fold(tree[0][p], ways[p]) == o.root


def test_some_rows_prove_as_all_do(docs, folder, spark, monkeypatch):
    monkeypatch.setattr(merkle.prove, "__defaults__", ("leaf", None, 16))
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    made = merkle.build(df.select("doc_id", "source", merkle.digest([F.col(c) for c in merkle.FIELDS]).alias("leaf")), "source", ["doc_id"])
    want = {r[0]: r[4] for r in plain(rows)}
    some = merkle.prove(made, made.leaves.filter("doc_id % 7 = 3")).collect()
    assert {r.doc_id: r.proof_sha256 for r in some} == {k: v for k, v in want.items() if k % 7 == 3} and all(r.verified for r in some)
    forged = merkle.prove(made, made.leaves.filter("doc_id < 20").withColumn("shown", F.when(F.col("doc_id") == 5, F.unhex(F.lit("00" * 32)))), shown="shown").collect()
    assert [r.doc_id for r in forged if not r.verified] == [5]
    merkle_with_other_root = merkle.Manifest(made.leaves, made.nodes, made.trees, "0" * 64)
    with pytest.raises(Exception, match="not the manifest's"):
        merkle.prove(merkle_with_other_root, made.leaves).collect()
