import random

import numpy as np
import pytest

from annalist.llm import ngram_join
from annalist.llm.components import components


def brute(rows, n, share):
    sets, root = [], {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    link = list(range(len(rows)))

    def find(x):
        while link[x] != x:
            x = link[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                link[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return sorted(((i is None, i or 0, len(sets[k]), (least[find(k)] if sets[k] else i)) for k, (i, _) in enumerate(rows)), key=str)


def got(df, words, share):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(df, words, share).collect()), key=str)


def texts(seed, groups=12, copies=14):
    """Groups of edited copies around the threshold, short and long, and unrelated texts."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"v{rng.randrange(5_000)}" for _ in range(rng.choice([3, 8, 20, 60, 150, 400]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 18) + 1)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out + [" ".join(f"u{rng.randrange(9_000)}" for _ in range(50)) for _ in range(40)]


@pytest.mark.parametrize("words,share", [(4, 85), (5, 80)])
def test_like_brute_force(spark, words, share):
    rows = list(enumerate(texts(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, words, share) == brute(rows, words, share)


def test_blocks_of_large_components(spark, monkeypatch):
    """Components beyond the block sizes are cut into pairs of blocks; nothing is lost."""
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 4)
    rows = list(enumerate(texts(9, groups=4, copies=20)))
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85) == brute(rows, 4, 85)


def test_repeated_ids(spark):
    """Rows of one id with different texts each keep their own links."""
    rng = random.Random(8)
    a, c = (" ".join(f"r{rng.randrange(9_000)}" for _ in range(200)) for _ in range(2))
    b = a.rsplit(" ", 2)[0] + " other end"
    rows = [(5, a), (5, c), (6, b), (7, c), (9, b), (9, a)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85) == brute(rows, 4, 85)


def test_odd_rows(odd, none, odd_rows):
    assert got(odd, 4, 85) == brute([r[:2] for r in odd_rows], 4, 85)
    assert ngram_join.join_components(none).collect() == []


def test_signatures_share():
    """Each pair of similar sets of any size shares a signature in a common band."""
    rng = np.random.default_rng(4)
    enum = ngram_join.PartEnum(85)
    for _ in range(1_500):
        n = int(rng.integers(1, 200))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        drop, add = int(rng.integers(0, 1 + n * 16 // 185)), int(rng.integers(0, 1 + n * 16 // 185))
        b = np.concatenate([a[drop:], rng.integers(0, 2**64, add, dtype=np.uint64)])
        if 100 * (n - drop) < 85 * (n + add) or not len(b):
            continue
        x, y = ({band: set(s.tolist()) for band, s in enum.signatures(np.unique(v))} for v in (a, b))
        assert any(x[k] & y[k] for k in x.keys() & y.keys())


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1_000, 1_060)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
