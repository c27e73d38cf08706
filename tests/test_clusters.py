"""Recursive clustering against the rule in plain Python, whatever runs in one task and whatever in many."""

import math
import random

import pytest
from pyspark.sql import functions as F

from annalist.operators import clusters


def brute(rows, largest, smallest, fanout, fit_rows):
    """``rows``: (hash, id, whole-number vector or None). Clusters by path."""
    out = {}

    def split(rows, path):
        with_x = [r for r in rows if r[2] is not None]
        if len(rows) <= largest or len(with_x) < smallest or len(path) > 64:
            out[path] = [r[1] for r in rows]
            return
        k = min(len(with_x), math.ceil(len(rows) / largest), fanout)
        near = lambda v, cs: min(range(k), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, cs[c], strict=True)), c))
        some = with_x[:fit_rows]
        centres = [r[2] for r in some[:k]]
        for _ in range(clusters.ROUNDS):
            own = [near(r[2], centres) for r in some]
            for c in range(k):
                mine = [r[2] for r, o in zip(some, own, strict=True) if o == c]
                if mine:
                    centres[c] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
        child = {r[1]: near(r[2], centres) for r in with_x}
        if len(set(child.values())) == 1:
            child = {r[1]: ((r[0] % 2**64) >> 4 * (len(path) % 16)) % 16 % k for r in with_x}
            child |= {r[1]: 0 for r in rows if r[2] is None}
        sizes = [list(child[r[1]] for r in with_x).count(c) for c in range(k)]
        for r in rows:
            child.setdefault(r[1], sizes.index(max(sizes)))
        for c in sorted(set(child.values())):
            split([r for r in rows if child[r[1]] == c], path + f"{c:x}")

    split(sorted(rows), "")
    return out


@pytest.mark.parametrize("fit_rows", [4_096, 60])
def test_partition(spark, monkeypatch, fit_rows):
    rng = random.Random(4)
    rows = [(i, "a", [rng.gauss(i % 5, 0.3) for _ in range(4)] if i % 17 else None, "x") for i in range(400)]
    rows += [(i, "b", [1.0, 2.0, 3.0, 4.0], "x") for i in range(150)] + [(i, None, [float(i), 0.0, 0.0, 0.0], "x") for i in range(12)]
    rows += [(i, "c", None, "x") for i in range(30)] + [rows[3], rows[3], (None, "a", [0.0] * 4, "x"), (5, "d", None, "x")]
    df = spark.createDataFrame(rows, "id long, user string, e array<double>, path string")
    monkeypatch.setattr(clusters, "FIT_ROWS", fit_rows)
    monkeypatch.setattr(clusters, "PART_ROWS", 50)
    got = {}
    for r in clusters.partition(df, "user", "id", "e").collect():
        got.setdefault((r["grp"], r["cluster"]), set()).add(r["id"])
        assert r["own"] is None or r["own"] <= r["other"]
    hashes = {r["id"]: r["h"] for r in df.select("id", F.xxhash64(F.lit(42), "id").alias("h")).collect()}
    want = {}
    for user in ("a", "b", None, "c", "d"):
        own = {i: (hashes[i], i, None if v is None else tuple(math.floor(1024 * x) for x in v)) for i, u, v, _ in rows if u == user and i is not None}
        for path, ids in brute(list(own.values()), 20, 10, 16, fit_rows).items():
            if len(ids) > 10 or path == "":
                want[user, path] = set(ids)
    assert got == want
    assert max(len(v) for (u, _), v in got.items() if u == "b") <= 20
    assert {u for u, _ in got} == {"a", "b", None, "c", "d"}


def test_partition_of_nothing(spark):
    none = spark.createDataFrame([], "id long, user string, e array<float>")
    assert clusters.partition(none, "user", "id", "e").collect() == []


def test_reorganized(spark):
    nodes = spark.createDataFrame([(i, "a" if i < 50 else "b", [float(i % 7), float(i % 3)]) for i in range(65)], "id long, user string, e array<double>")
    edges = spark.createDataFrame([(0, 1), (1, 2), (None, 3)], "src long, dst long")
    got = clusters.reorganized(nodes, edges, "user", "id", "e").collect()
    assert {r["grp"] for r in got} == {"a"} and not {0, 1, 2, 3} & {r["child"] for r in got}
    assert all(10 < r["n"] <= 20 for r in got) and len({r["parent"] for r in got}) == len({(r["parent"], r["n"]) for r in got})
