"""Exact top-k, hard negatives and centroid clustering against brute force in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import ball_tree, centroids, hard_negatives, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int, cluster string, v int"


def whole(v, scale):
    return [math.floor(scale * x) for x in v]


def held(x):
    return max(min(x, 2**63 - 1), -(2**63))


def dot(a, b):
    return held(sum(x * y for x, y in zip(a, b, strict=True)))


@pytest.fixture(scope="module")
def rows():
    """Vectors with ties, a third of them alike, nulls, other widths, repeated ids and rows, and large components."""
    rng = random.Random(5)
    out = []
    for i in range(1_500):
        v = [1.0, -0.5, 0.25, 0.5, 0.0, 0.75] if i % 3 == 0 else [round(rng.gauss(0, 0.4), 1 if i % 2 else 3) for _ in range(6)]
        out.append((i - 40, v, rng.randrange(10)))
    out += [(2_000, None, 1), (2_050, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2_100, [float("nan")] * 6, 2), (2_150, [float("inf")] + [0.0] * 5, 2), (None, [0.5] * 6, 3), (2_200, [0.5] * 6, None), (2_300, [], 4), (2_301, [], 4), (2_400, [0.5, 0.25], 4)]
    out += [(2_401, [0.1, 0.2], 4), (2_402, [0.3, 0.1], 5), out[60], out[60], (100, [0.9] * 6, 7), (2_500, [3e9, -2.0, 0.0, 1.0, 0.0, 0.0], 8), (2_501, [2e9, 1.0, 0.0, 1.0, 0.0, 0.0], 8), (2_502, [1.7e9, 1.0, 0.0, 1.0, 0.0, 0.0], 9), (-3, [-0.5] * 6, 7)]
    return [(a, b, c, 7, 8, "x", 9) for a, b, c in out]


@pytest.fixture
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def taking_part(rows, scale):
    return [(r[0], tuple(whole(np.float32(r[1]).tolist(), scale)), r[2]) for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def tuples(df):
    return sorted(map(tuple, df.collect()))


def test_topk(df, rows, monkeypatch):
    monkeypatch.setattr(ball_tree, "SHARD_ROWS", 700)
    monkeypatch.setattr(ball_tree, "QUERY_BLOCK", 16)
    kept, want = taking_part(rows, 256), []
    for q in {r[:2] for r in kept if r[0] % 50 == 0}:
        scored = sorted((-dot(q[1], r[1]), r[0]) for r in kept if r[0] != q[0] and len(r[1]) == len(q[1]))
        want += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    assert tuples(ball_tree.topk(df.filter("vec_id % 50 = 0"), df)) == sorted(want)


def test_topk_of_nothing(spark, df):
    none = spark.createDataFrame([], SCHEMA)
    assert ball_tree.topk(none, none).collect() == ball_tree.topk(df.limit(0), df).collect() == ball_tree.topk(df.filter("vec_id = 0"), none).collect() == []
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert tuples(ball_tree.topk(two, two)) == [(0, 1, 1, 128 * 256), (1, 1, 0, 128 * 256)]


def test_a_search_leaves_out_what_cannot_win():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 3, (500, 8)) for c in (-200, 0, 200)]).round().astype(np.int64)
    nodes = ball_tree.split(x.astype(float))
    assert sorted(np.concatenate([n[4] for n in nodes if n[4] is not None])) == list(range(1_500)) and max(len(n[4]) for n in nodes if n[4] is not None) <= ball_tree.LEAF_ROWS
    seen = []

    class Held(list):
        def __getitem__(self, n):
            seen.append(n)
            return super().__getitem__(n)

    tree = {"left": [n[0] for n in nodes], "right": [n[1] for n in nodes], "centres": np.array([n[2] for n in nodes]), "radii": np.array([n[3] for n in nodes]), "ids": [n[4] for n in nodes], "held": Held(None if n[4] is None else x[n[4]] for n in nodes)}
    q = np.full((1, 8), 200)
    _, ids, scores = ball_tree.descend(tree, q, np.array([-1]), np.array([-(1 << 63)]), 5)
    brute = (x @ q[0]).argsort(kind="stable")[::-1]
    assert scores == sorted((x @ q[0]).tolist(), reverse=True)[:5] and set(ids) <= set(brute[:50].tolist())
    leaves = sum(n[4] is not None for n in nodes)
    assert len(seen) < leaves / 2
    seen.clear()
    assert ball_tree.descend(tree, q, np.array([-1]), np.array([10**9]), 5)[1] == [] and seen == []  # a score from elsewhere closes the tree
    up = ball_tree.bounds(x.astype(float), tree["centres"], tree["radii"])
    for n, node in enumerate(nodes):
        if node[4] is not None:
            assert (up[:, n] >= (x @ x[node[4]].T).max(1)).all()


def brute_negatives(rows):
    kept = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in taking_part(rows, 256) if label is not None]
    out = []
    for a in {r for r in kept if r[0] % 100 == 0}:
        scored = sorted((-dot(a[1], r[1]), r[0], r[2]) for r in kept if r[0] != a[0] and len(r[1]) == len(a[1]))
        for ps, p, _ in [s for s in scored if s[2] == a[2]][:5]:
            fits = [(s, n) for s, n, label in scored if label != a[2] and 80 * -ps <= 100 * -s <= 100 * -ps]
            out += [(a[0], p, k + 1, n, -ps, -s) for k, (s, n) in enumerate(fits[:5])]
    return sorted(out)


@pytest.mark.parametrize("fit_rows", [4_096, 40])
def test_hard_negatives(df, rows, monkeypatch, fit_rows):
    monkeypatch.setattr(hard_negatives, "FIT_ROWS", fit_rows)
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 400)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 9)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    want = brute_negatives(rows)
    assert len(want) > 100 and tuples(hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label)) == want


def test_hard_negatives_of_nothing(spark, df):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(none, F.col("vec_id") % 100 == 0, F.col("label")).collect() == hard_negatives.mine(df, F.lit(False), F.col("label")).collect() == []


def test_bounds_hold_the_score_and_rule_most_out():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 32, (3_000, 64)).round().astype(np.int64)
    book = hard_negatives.codebook(x[:1_000])
    codes, norms = hard_negatives.coded(hard_negatives.pieces(x), book)
    block = hard_negatives.Block.__new__(hard_negatives.Block)
    block.ids, block.x, block.book, block.codes, block.norms = np.arange(len(x)), x, book, codes, norms.astype(np.float64)
    low, high = block.ranges(x[:50])
    true = x[:50] @ x.T
    assert (low <= true).all() and (true <= high).all()
    kept = [(high[i] >= hard_negatives.highest(low[i], 5)).mean() for i in range(50)]
    assert np.mean(kept) < 0.05


def brute_clusters(rows, k, rounds, seed, width, scale):
    kept = [(i, v) for i, v, _ in taking_part(rows, scale) if len(v) == width]
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (away(v, centres[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for c in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                centres[c] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    own = [nearest(v) for _, v in kept]
    far = [held(away(v, centres[c])) for (_, v), c in zip(kept, own, strict=True)]
    sums = {c: held(sum(d for d, o in zip(far, own, strict=True) if o == c)) for c in set(own)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i, c, d, sums[c], held(sum(far)), sha[c]) for (i, _), c, d in zip(kept, own, far, strict=True))


@pytest.mark.parametrize(("k", "large"), [(8, False), (3, True), (1, False)])
def test_clusters(df, rows, k, large):
    rows = rows if large else [r for r in rows if r[0] is None or not 2_500 <= r[0] <= 2_502]
    df = df if large else df.filter("vec_id IS NULL OR NOT vec_id BETWEEN 2500 AND 2502")
    assert tuples(centroids.cluster(df, k=k, rounds=6, width=6)) == brute_clusters(rows, k, 6, 3, 6, 1024)


def test_bounds_spare_scans(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.05, (1_500, 6)) + rng.normal(0, 1, (12, 6))[rng.integers(0, 12, 1_500)]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))]
    scans: list = []
    got = tuples(centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), k=16, width=6, scans=scans))
    assert got == brute_clusters(rows, 16, 10, 3, 6, 1024)
    assert scans[0] == 1_500 and sum(scans[1:]) < 1_500 * len(scans[1:]) / 3


def test_clusters_of_few(spark, df, rows):
    none = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster(none).collect() == [] and centroids.cluster(none).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = rows[:5] + rows[:1]
    assert tuples(centroids.cluster(spark.createDataFrame(few, SCHEMA), width=6)) == brute_clusters(few, 8, 10, 3, 6, 1024)


def test_whole_numbers(spark):
    a = np.array([[3, -4], [1 << 40, 1], [-(1 << 62), 1 << 62]], dtype=np.int64)
    plain = a.tolist()
    assert vectors.products(a, a).tolist() == [[dot(x, y) for y in plain] for x in plain]
    assert vectors.distances(a, a).tolist() == [[held(sum((p - q) ** 2 for p, q in zip(x, y, strict=True))) for y in plain] for x in plain]
    for x in (a, a[:1], a[:2]):
        assert vectors.unpacked(vectors.packed(x), 2).tolist() == x.tolist()
