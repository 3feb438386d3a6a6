import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pingmill.llm import capfilter, graph, simhash, substring


def groups(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [tuple(map(int, rng.integers(200, 300, 2))) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups(edges, {x for e in edges for x in e})
    assert all(want[k] == v for k, v in got.items())
    assert {k for k, v in want.items() if list(want.values()).count(v) > 1} == set(got)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- SimHash


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = [None, "", " \n", "One", "one two", "ONE two three", "é É Ü a\xa0b c d", "x " * 300_000, "a b c a b c a b c", "\x1c a \x85"]


def test_fingerprints():
    for t in TEXTS:
        assert simhash.fingerprint(t) == plain_fingerprint(t), repr(t)[:40]


def near_pairs(fps):
    return {(i, j) for i in range(len(fps)) for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 3}


def some_fingerprints(seed, bases, copies, bits=3):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, bases, dtype=np.uint64)
    noise = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (copies, bases, bits), dtype=np.uint64), axis=2)
    return np.unique(np.concatenate([base, (base ^ noise).ravel()]))


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 800])
def test_a_tree_finds_all_pairs(n):
    fps = some_fingerprints(4, 40, 20)[:n]
    fps = fps[np.argsort(simhash.ranks(fps))]
    q, leaf = simhash.Tree.of(fps).search(fps)
    assert set(zip(q.tolist(), leaf.tolist(), strict=True)) == near_pairs(fps)


def test_every_query_prunes_groups_of_the_index(spark):
    """The index over the fingerprints of sf0.1, as the tasks build it: nodes are visited and groups pruned for each query."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").repartition(8)
    prints = simhash.fingerprints(docs).select("fp").distinct().persist()
    top, cuts = simhash.upper_nodes(prints)
    fps = np.array([r.fp for r in prints.collect()], np.int64).view(np.uint64)
    assert len(cuts) + 1 == len(fps) // simhash.LEAF and len(top.levels) >= 3
    for k in range(0, len(fps), 50):
        top.visited = top.pruned = 0
        top.search(fps[k : k + 1])
        assert top.visited > top.pruned > 0
    own, ranges, work = {}, {}, 0
    for node, kind, blob in simhash.route(top, cuts, fps):
        own.setdefault((node, kind), []).append(np.frombuffer(blob, np.uint64))
    for (node, kind), blobs in own.items():
        if kind == 0:
            ranges[node] = simhash.Range(np.concatenate(blobs))
    for (node, kind), blobs in own.items():
        if kind == 1:
            list(ranges[node].meet(np.concatenate(blobs)))
    assert all(r.tree.visited > 0 for r in ranges.values()) and sum(r.tree.pruned for r in ranges.values()) > 0
    work = sum(r.tree.visited for r in ranges.values())
    assert work < 0.25 * len(fps) ** 2  # all pairs would be met twice
    prints.unpersist()


def test_gray_ranks(spark):
    fps = some_fingerprints(5, 30, 3)
    rows = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").select("fp", simhash.gray_rank(F.col("fp")).alias("r")).collect()
    assert simhash.ranks(np.array([r.fp for r in rows]).view(np.uint64)).tolist() == [r.r for r in rows]


@pytest.mark.parametrize("nodes", [1024, 5, 1])
def test_links_give_the_components_of_all_pairs(spark, nodes):
    rng = np.random.default_rng(7)
    fps = some_fingerprints(7, 30, 4, 2)
    hot = fps[0] ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))
    odd = np.array([0, 7, 1 << 63, (1 << 63) | 5, (1 << 40) | (1 << 20) | 1, 2**64 - 1], np.uint64)
    fps = np.unique(np.concatenate([fps, hot, odd]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(5)
    signed = fps.view(np.int64).tolist()
    found = [(r.a, r.b) for r in simhash.links(df, nodes).collect()]
    all_pairs = [(a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) % 2**64).bit_count() <= 3]
    assert groups(found, signed) == groups(all_pairs, signed)


def test_query_4(docs, folder, spark):
    copies = "alpha beta gamma delta epsilon zeta eta theta"
    rows = list(enumerate(TEXTS)) + [(20, copies), (11, copies), (30, copies.upper()), (3, "other words here now"), (3, "other words here now"), (None, copies)]
    got = simhash.op4(spark, folder(documents=docs(rows))).collect()
    assert len(got) == len(rows)
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    for r in got:
        assert (r.doc_id, int(r.fingerprint, 16)) in fps
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by[20] == by[11] == by[30] == 11 and by[0] == by[1] == by[2] == 0
    assert simhash.keep_one(docs(rows)).filter("doc_id in (11, 20, 30)").select("doc_id").collect()[0][0] == 11
    assert simhash.near_groups(docs(rows).limit(0)).count() == 0


def test_keep_one_of_odd_rows(docs):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(5, text), (5, "quite another text of five words"), (3, text.upper()), (None, text), (None, "a text without an id at all"), (None, "a text without an id at all"), (9, None), (8, "")]
    df = docs(rows).withColumn("near_key", F.lit("mine")).withColumn("FP", F.lit(1))
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(3, text.upper()), (5, rows[1][1]), (None, rows[4][1]), (8, "")]))
    assert simhash.keep_one(df.limit(0)).count() == 0


# ---- spherical caps


def test_decoding_lists_every_exceeding_direction():
    code = capfilter.CapFilters(12, 50)
    rng = np.random.default_rng(3)
    v = rng.standard_normal((20, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    from itertools import product

    for row, found in zip(v, code.decode(v), strict=True):
        want = []
        for k, (turn, codes) in enumerate(code.tables):
            for number, combo in enumerate(product(range(code.size), repeat=code.blocks)):
                s = sum(float((row @ turn)[p] @ c[i]) for p, c, i in zip(code.parts, codes, combo, strict=True))
                if s >= code.threshold:
                    want.append(k * code.each + number)
        assert found.tolist() == want


def test_tasks_draw_the_same_filters():
    import pickle

    code = capfilter.CapFilters(12, 50)
    data = pickle.dumps(code)
    again = pickle.loads(data)
    v = capfilter._unit(np.random.default_rng(1).standard_normal((40, 12)))
    assert len(data) < 300 and all((a == b).all() for a, b in zip(code.decode(v), again.decode(v), strict=True))


def links_by_brute_force(ids, vectors):
    m = np.array(vectors, np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    return dict(zip(ids, near.sum(axis=1).tolist(), strict=True)), near


@pytest.mark.parametrize("slab", [4096, 8])
def test_near_vectors(spark, slab):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 32))
    rows = [(i, (centres[i % 60] + 0.22 * rng.standard_normal(32)).astype("float32").tolist()) for i in range(400)]
    rows += [(500 + i, rows[0][1]) for i in range(30)]  # copies
    odd = [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] * 32), (904, [float("inf")] + [1.0] * 31), (905, [1.0, None]), (906, [3.0, 4.0]), (907, [6.0, 8.0]), (None, rows[0][1]), (7, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, v array<float>").withColumn("cid", F.lit("mine"))
    got = capfilter.near(df, slab=slab).collect()
    assert len(got) == len(rows + odd)
    want, near = links_by_brute_force([(i, 0) for i, _ in rows] + [(7, 1)], [v for _, v in rows] + [rows[0][1]])
    have = {}
    for r in got:
        if r.vec_id is not None and r.vec_id < 900:
            have.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
    least = want[0, 0]
    copy = next(x for x in have.pop(7) if x[0] == max(n for n, _ in have[0]))  # the second row of id 7 is a copy of row 0
    assert copy[1] == have[0][0][1] == have[515][0][1]
    assert all(x[0][0] <= want[i, 0] for i, x in have.items())
    assert sum(x[0][0] for x in have.values()) >= 0.95 * sum(n for (i, _), n in want.items() if i != 7) and least >= 31
    by = {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None}
    assert all(by[i] == (0, i) for i in range(900, 906)) and by[906] == (1, 906) and by[907] == (1, 906)
    assert [(r.n_links, r.component_id) for r in got if r.vec_id is None] == [(0, None)]
    assert capfilter.near(df.limit(0)).count() == 0


def test_recall_of_planted_pairs(spark):
    """Pairs planted at cosines from 0.88 to 1 among unrelated vectors: recall against brute force, also just above the bound."""
    rng = np.random.default_rng(17)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    one = unit(rng.standard_normal((1500, 64)))
    other = rng.standard_normal((1500, 64))
    other = unit(other - (other * one).sum(axis=1, keepdims=True) * one)
    cosine = np.concatenate([rng.uniform(0.9005, 0.91, 500), np.linspace(0.88, 1, 1000)])[:, None]
    m = np.concatenate([one, cosine * one + np.sqrt(1 - cosine**2) * other, unit(rng.standard_normal((1000, 64)))]).astype("float32")
    df = spark.createDataFrame([(i, row) for i, row in enumerate(m.tolist())], "vec_id long, v array<float>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in capfilter.near(df).collect()}
    want, near = links_by_brute_force(range(len(m)), m)
    assert all(got[i][0] <= n for i, n in want.items())  # no false link
    assert all(c == i or near[i].any() for i, (_, c) in got.items())
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(want.values()) > 2000
    tight = [i for i in range(500) if want[i] == 1 and want[1500 + i] == 1]
    assert len(tight) > 400 and sum(got[i] == (1, i) and got[1500 + i] == (1, i) for i in tight) >= 0.9 * len(tight)


@pytest.mark.parametrize("d", [2, 33, 64, 128, 129, 768])
def test_sketches_lose_no_pair_at_the_bound(d):
    one, two = capfilter.CapFilters._pairs_at(d, 0.9)
    one[:50], two[:50] = np.eye(d)[0], 0.9 * np.eye(d)[0] + np.sqrt(0.19) * np.eye(d)[1]  # uneven vectors round worst
    small = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (capfilter.sketches(v).astype(float) for v in (one, two))]
    low = capfilter.sketch_bound(min(d, capfilter.SKETCH), 0.9)
    assert small[0].shape[1] == min(d, capfilter.SKETCH) and ((small[0] * small[1]).sum(axis=1) >= low).all()
    assert d < 64 or (small[0] @ small[0][50:].T >= low).sum() <= 1000  # unrelated ones do not stay


def test_vectors_move_to_few_filters(spark):
    """Vectors of 300 components: those without neighbours go nowhere, pairs to one filter, and a close group to a few."""
    rng = np.random.default_rng(2)
    near = lambda x, n: x + 0.1 * rng.standard_normal((n, 300))
    m = rng.standard_normal((700, 300))
    m = np.concatenate([m, near(m[:100], 100), near(m[200], 40)]).astype("float32")
    df = spark.createDataFrame([(i, row) for i, row in enumerate(m.tolist())], "vec_id long, v array<float>")
    _, classes = capfilter.classes_of(df)
    lists = capfilter.listed(classes, {300: capfilter.CapFilters(300, len(m))}).persist()
    places = capfilter.dealt(lists, 4096).repartition(4, "filter", "x", "y").sortWithinPartitions("filter", "x", "y")
    stay = places.mapInArrow(capfilter._stay(0.9, False), "filter long, x int, y int, slab int, cid long")
    shared = stay.groupBy("cid").agg(F.array_sort(F.collect_set("filter")).alias("filters")).join(lists.select("cid", "sketch"), "cid")
    own = capfilter._placed(stay, shared).repartition(4, "filter", "x", "y").sortWithinPartitions("filter", "x", "y").mapInArrow(capfilter._stay(0.9, True), "filter long, x int, y int, slab int, cid long")
    goes = {r.vec_id: r["count"] for r in own.join(classes.select("cid", F.col("least").alias("vec_id")), "cid").groupBy("vec_id").count().collect()}
    assert all(goes.get(i, 0) == 0 for i in range(100, 700) if i != 200) and all(goes.get(i, 0) <= 1 for i in range(100))
    assert sum(i in goes for i in range(100)) >= 95  # a few exceed no filter, which is the method's loss
    assert max(goes.values()) < lists.select(F.max(F.size("filters"))).first()[0] / 2
    got = {r.vec_id: r.n_links for r in capfilter.near(df).collect()}
    want, _ = links_by_brute_force(range(len(m)), m)
    assert all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= 0.95 * sum(want.values())


def test_each_link_is_counted_once(spark):
    """Vectors so close that they meet in nearly all their filters, many of them in crowded ones."""
    rng = np.random.default_rng(3)
    m = (rng.standard_normal(16) + 0.03 * rng.standard_normal((90, 16))).astype("float32")
    df = spark.createDataFrame([(i, row) for i, row in enumerate(m.tolist())], "vec_id long, v array<float>")
    for slab in (4096, 16):
        assert {(r.n_links, r.component_id) for r in capfilter.near(df, slab=slab).collect()} == {(89, 0)}


# ---- substrings


def test_borders_survive_an_insertion():
    rng = np.random.default_rng(6)
    data = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))

    def cut(x):
        ends = substring.borders(x)
        return {x[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    one, two = cut(data), cut(data[:9000] + b"inserted" + data[9000:])
    assert len(one - two) <= 8
    ends = substring.borders(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= substring.MOST and sizes[:-1].min() >= substring.LEAST


def test_windows_do_not_move_borders(monkeypatch):
    data = bytes(np.random.default_rng(8).integers(97, 123, 5000, dtype=np.uint8))
    want = substring.borders(data)
    monkeypatch.setattr(substring, "WINDOW", 700)
    assert substring.borders(data) == want


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(n))


def test_query_2(docs, folder, spark):
    shared = passage(1, 60)
    rows = [(1, passage(2, 80) + " " + shared + " " + passage(3, 50)), (2, passage(4, 33) + " " + shared), (3, passage(5, 200)), (4, None), (5, ""), (6, passage(6, 60) + " " + passage(6, 60)), (7, passage(7, 70)), (7, passage(7, 70)), (None, passage(8, 70) + " " + shared), (9, "é" * 100)]
    df = docs(rows).withColumn("copy_spans", F.lit(1)).withColumn("Key", F.lit("k"))
    got = substring.op2(spark, folder(documents=df)).collect()
    assert {(r.doc_id, r.first_doc_id, r.is_copy) for r in got} == {(1, 1, False), (2, 1, True), (None, 1, True)} and len(got) == 3
    assert all(51 <= r.n_words <= 62 for r in got)
    clean = substring.remove_copies(df, substring.passages(df))
    assert clean.columns == df.columns
    by = {r.doc_id: r.text for r in clean.collect() if r.doc_id in (1, 2)}
    assert by[1] == rows[0][1] and len(by[2]) < len(rows[1][1]) - 200 and by[2].startswith(passage(4, 20))
    assert substring.passages(docs(rows).limit(0)).count() == 0


def test_only_passages_of_over_50_words_count(docs):
    """Exact at both sides of the border, and never pieced together from stretches that are shared with different documents."""
    a, b, c = passage(41, 20), passage(42, 20), passage(43, 20)
    short, long = passage(44, 50), passage(45, 51)
    rows = [(0, f"{a} {b} {c}"), (1, f"{passage(46, 60)} {a}"), (2, f"{b} {passage(47, 60)}"), (3, f"{passage(48, 30)} {c} {passage(49, 30)}")]
    rows += [(10, f"{passage(50, 40)} {short} {passage(51, 40)}"), (11, f"{passage(52, 40)} {short} {passage(53, 40)}")]
    rows += [(20, f"{passage(54, 40)} {long} {passage(55, 40)}"), (21, f"{passage(56, 40)} {long} {passage(57, 40)}")]
    found = {r.doc_id: r for r in substring.passages(docs(rows)).collect()}
    assert set(found) == {20, 21}
    text = rows[-1][1].encode()[found[21].start : found[21].start + found[21].n_bytes].decode()
    assert long in text or text.strip() in long


def test_overlapping_passages_keep_one_copy_of_each_part(docs):
    a, b, c = passage(31, 120), passage(32, 120), passage(33, 120)
    df = docs([(3, f"{a} {b}"), (5, f"{a} {b} {c}"), (9, f"{b} {c}")])
    found = substring.passages(df)
    assert {(r.doc_id, r.first_doc_id, r.is_copy) for r in found.collect()} == {(3, 3, False), (5, 3, True), (9, 3, True)}
    clean = {r.doc_id: r.text for r in substring.remove_copies(df, found).collect()}
    words = lambda text: set(text.split())
    assert clean[3] == f"{a} {b}" and len(words(c) - words(clean[5])) == 0
    assert len(words(clean[5]) & words(a)) <= 5 and len(words(clean[9])) <= 60


def test_the_end_of_one_passage_and_another(docs):
    p, q = passage(61, 80), passage(62, 80)
    tail = " ".join(p.split()[-30:])
    df = docs([(0, p), (1, f"{p} {q}"), (2, f"{tail} {q}")])
    clean = {r.doc_id: r.text for r in substring.remove_copies(df, substring.passages(df)).collect()}
    assert clean[0] == p and q in clean[1]


@pytest.mark.parametrize("seed", range(3))
def test_every_shared_stretch_survives(docs, seed):
    """Documents pieced together from shared parts: after removal each stretch of STRETCH words that two of them shared is whole in one."""
    rng = np.random.default_rng(seed)
    parts = [passage(100 * seed + k, int(rng.integers(20, 90))) for k in range(8)]
    texts = [" ".join(parts[k] if rng.random() < 0.8 else passage(1000 * seed + 10 * i + k, 40) for k in rng.integers(0, 8, rng.integers(1, 6))) for i in range(25)]
    df = docs(list(enumerate(texts)))
    found = substring.passages(df)
    clean = {r.doc_id: r.text for r in substring.remove_copies(df, found).collect()}
    assert sum(map(len, clean.values())) < 0.8 * sum(map(len, texts))
    kept = [re.sub(r"\s+", " ", t) for t in clean.values()]
    for r in found.collect():
        data = texts[r.doc_id].encode()
        for x in r.copies:
            w = data[x.start : x.start + x.n_bytes].decode().split()
            for k in range(0, len(w) - substring.STRETCH, 5):
                assert any(" ".join(w[k : k + 13]) in t for t in kept)


@pytest.mark.parametrize("longest", [1, 3, 8])
def test_each_passage_of_51_words_has_a_shared_stretch(longest):
    rng = np.random.default_rng(longest)

    def text(n):
        return [bytes(rng.integers(97, 123, rng.integers(1, longest + 1), dtype=np.uint8)) for _ in range(n)]

    for _ in range(200):
        shared = text(51)
        one, two = (substring.stretches(b" ".join(text(rng.integers(0, 60)) + shared + text(rng.integers(0, 60)))) for _ in range(2))
        assert np.isin(one[5], two[5]).any()
        assert all(x[4].min() >= 25 and (x[4] - x[3]).min() >= substring.STRETCH for x in (one, two))


def test_run_digests_do_not_depend_on_the_place():
    v = np.random.default_rng(1).integers(0, 2**64, 40, dtype=np.uint64)
    twice = np.concatenate([v[:3], v])
    one, two = substring.run_digests(v, np.array([0, 5, 5]), np.array([9, 9, 10])), substring.run_digests(twice, np.array([3, 8, 8]), np.array([12, 12, 13]))
    assert one.tolist() == two.tolist() and len(set(one.tolist())) == 3


def test_short_words_make_passages(docs):
    rng = np.random.default_rng(12)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(1, 4))) for _ in range(n))
    shared = [text(51) for _ in range(20)]
    rows = [(2 * i + k, f"{text(60)} {s} {text(60)}") for i, s in enumerate(shared) for k in range(2)]
    assert {r.doc_id for r in substring.passages(docs(rows)).collect()} == set(range(40))


def test_passages_of_the_given_documents(spark):
    """All documents that share over 50 words with another, by brute force over shingles, and no other."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen, want = {}, set()
    for r in df.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        for k in range(len(w) - 50):
            h = hash(tuple(w[k : k + 51]))
            if seen.setdefault(h, r.doc_id) != r.doc_id:
                want |= {r.doc_id, seen[h]}
    got = {r.doc_id for r in substring.passages(df).collect()}
    assert got - want == set() and len(want - got) <= 0.005 * len(want)


def test_long_documents_have_numbers_of_their_own():
    """Chunks beyond the millionth keep their place; what would not fit is refused."""
    base = 5 * substring.NUMBERS
    arrays = lambda first: [np.arange(first, first + 3)] + [np.arange(3)] * 5
    got = substring._rows([(7, base, arrays(0)), (7, base, arrays(1_100_000))])
    assert got.column("place").to_pylist() == [base, base + 1, base + 2, base + 1_100_000, base + 1_100_001, base + 1_100_002]
    with pytest.raises(ValueError, match="chunks"):
        substring._rows([(7, base, arrays(substring.NUMBERS - 1))])
