"""Near duplicates, components, shards and nearest vectors, against plain Python."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadflow.llm import kdtree, neardup, ring
from roadflow.llm.components import connected_components

from . import messy


def brute_groups(rows, words, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(k)
    out = Counter()
    for members in groups.values():
        known = [rows[k][0] for k in members if rows[k][0] is not None]
        name = min(known, default=None)
        for k in members:
            own = rows[k][0]
            name_k = name if sets[k] else own
            out[(own, len(sets[k]), name_k, own is not None and own == name_k)] += 1
    return out


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, words):
    docs = messy.documents(spark)
    got = neardup.groups(docs, words)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(map(tuple, got.drop("key").collect())) == brute_groups(rows, words, 80)
    assert neardup.groups(messy.empty(spark), words).collect() == []


def test_one_of_each_keeps_columns_and_repeats_once(spark):
    docs = messy.documents(spark)
    kept = neardup.one_of_each(docs, 4)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and not ids[2] and not ids[3] and not ids[4] and not ids[15]
    assert ids[5] == ids[6] == ids[7] == 1 and ids[None] == 2 and {r.key for r in kept.collect()} == {"k"}


def test_one_of_each_of_a_repeated_id(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text), (1, text.upper()), (1, text + " x"), (2, text), (3, "other words stand in this text here"), (3, "other")]
    kept = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 3]


def test_links_that_no_star_shows(spark):
    """A chain: neighbours are similar, ends are not; and many copies that differ a little from each other."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    chain, now = [], base[:]
    for step in range(12):
        chain.append(" ".join(now))
        now = now[:]
        for at in rng.sample(range(200), 2):
            now[at] = f"c{step}x{at}"
    cloud = []
    for k in range(60):
        own = base[::-1]
        for at in rng.sample(range(200), rng.choice([2, 3, 9, 14])):
            own[at] = f"d{k}x{at}"
        cloud.append(" ".join(own))
    rows = list(enumerate(chain + cloud))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert Counter(map(tuple, neardup.groups(docs, 4).drop("key").collect())) == brute_groups(rows, 4, 80)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40, 3000):
        items = rng.integers(0, 2**63, n).astype(np.uint64)
        assert neardup.sketch(items).max() != np.uint64(0xFFFFFFFFFFFFFFFF)
        assert (neardup.sketch(rng.permutation(items)) == neardup.sketch(items)).all()
    hits = []
    for _ in range(40):
        items = rng.integers(0, 2**63, 300).astype(np.uint64)
        hits.append((neardup.sketch(items[:240]) == neardup.sketch(items)).mean())
    assert abs(np.mean(hits) - 0.8) < 0.015


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, 2000 + k) for k in range(1, 50)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {x: root(x) for x in parent}


def test_shards(spark):
    docs = messy.documents(spark).unionByName(spark.range(500).select(
        F.col("id").alias("doc_id"), F.lit("copy").alias("text"), *[F.lit("z").alias(c) for c in ("lang", "key", "score", "scan")]))
    docs = docs.unionByName(docs.where("doc_id = 12").crossJoin(spark.range(300)).drop("id"))
    rows = ring.shard_documents(docs).collect()
    assert len(rows) == docs.count()
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r["size"]) for r in rows) == want
    assert ring.shard_documents(messy.empty(spark)).collect() == []


def test_overflow_walks_clockwise():
    points = ring.ring(4, 8)
    assert [p for p in ring.ring(5, 8) if p[1] < 4] == points
    given = ring.hand_out({0: 50, 9: 3, 20: 11}, points, 4)
    taken = Counter()
    for arc, shard, first, n, slot in given:
        taken[shard] += n
    assert sorted(taken.values()) == [16, 16, 16, 16]
    way = list(dict.fromkeys(points[k % len(points)][1] for k in range(len(points))))
    assert [s for arc, s, *_ in given if arc == 0] == [s for s in way if any(a == 0 and t == s for a, t, *_ in given)]


def test_top_k(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(20, 8))
    vectors = (centre[rng.integers(0, 20, 900)] + 0.1 * rng.normal(size=(900, 8))).astype(np.float32)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(vectors)]
    # Copies, repeated ids with the same and with other vectors, other lengths, and what takes no part.
    rows += [(1000 + k, rows[100][1], 0) for k in range(200)] + [(5, rows[5][1], 0), (5, rows[7][1], 0), (300, rows[8][1], 0), (400, rows[400][1], 0)]
    rows += [(3000 + k, [0.5 * k, -1.0, 0.25], 0) for k in range(110)] + [(100, [3.0, -2.0, 1.0], 0), (2500, [1.0], 0)]
    out = [(None, rows[1][1], 0), (2000, None, 0), (2100, [], 0), (2200, [1.0, None] + [0.0] * 6, 0), (2300, [float("nan")] * 8, 0), (2400, [float("inf")] * 8, 0)]
    df = spark.createDataFrame(rows + out, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, kdtree.top_k(df, F.col("id") % 100 == 0).collect()))
    points = [np.floor(1024 * np.array(r[1], np.float64)).astype(np.int64) for r in rows]
    want = []
    for q, (query_id, _, _) in enumerate(rows):
        if query_id % 100 == 0:
            best = sorted((-int(p @ points[q]), rows[c][0]) for c, p in enumerate(points) if c != q and len(p) == len(points[q]))[:10]
            want += [(query_id, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(want) and not [g for g in got if g[0] == 2500]
    assert kdtree.top_k(df.limit(0), F.col("id") % 100 == 0).collect() == []
    assert [tuple(r) for r in kdtree.top_k(df.where("vec_id in (0, 1)"), F.col("id") % 100 == 0).collect()][0][:3] == (0, 1, 1)


def test_packed_trees_are_the_same():
    rng = np.random.default_rng(5)
    for scale in (100, 40_000, 1 << 40):
        points = rng.integers(-scale, scale, (700, 5))
        tree = kdtree.Tree.build(np.arange(700), np.arange(700) + 9, points)
        same = kdtree.Tree.unpacked(tree.packed())
        assert same.nodes == tree.nodes and np.array_equal(same.points, tree.points) and np.array_equal(same.points[np.argsort(same.ids)], points)
        for start, end, a, b in same.nodes:
            assert end - start <= kdtree.LEAF if not a else (same.nodes[a][0], same.nodes[a][1], same.nodes[b][1]) == (start, same.nodes[b][0], end)
