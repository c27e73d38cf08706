import random

import pandas as pd
from pyspark.sql import functions as F

from annalist.operators import dedup, stores, text, vectors
from annalist.streaming import memory


def test_first_wins(spark):
    """In a chain a - b - c only b goes; in a triangle the first stays."""
    pairs = [(1, 2), (2, 3), (3, 4), (10, 11), (10, 12), (11, 12)]
    got = dedup.first_wins(spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(r["id"] for r in got.collect()) == [2, 4, 11, 12]
    assert dedup.first_wins(spark.createDataFrame([], "a long, b long")).collect() == []


def test_numbered(spark):
    rows = [(i * 37 % 101, str(i)) for i in range(500)]
    got = dedup.numbered(spark.createDataFrame(rows, "k long, s string").repartition(7), "place", "k", "s").collect()
    assert [(r["k"], r["s"]) for r in sorted(got, key=lambda r: r["place"])] == sorted(rows)
    assert sorted(r["place"] for r in got) == list(range(500))


def test_compacted(spark):
    """The summary holds the evicted sessions in order, the recent ones fit beside it."""
    rows = [(u, i, f"w{u}_{i} " + "x" * (20 + 7 * i)) for u in (1, 2) for i in range(6 * u)]
    got = {r["user_id"]: r for r in memory.compacted(spark.createDataFrame(rows, "user_id long, session_index long, text string"), 60).collect()}
    for u in (1, 2):
        own = [t for v, _, t in rows if v == u]
        gone = len(own) - got[u]["n_recent"]
        assert got[u]["summary"].split() == [t.split()[0] for t in own[:gone]]
        assert len(got[u]["summary"]) // 3 + sum(len(t) // 3 for t in own[gone:]) <= 60


def test_overlaps_in_blocks(spark, monkeypatch):
    rows = pd.DataFrame({"o": [i // 4 for i in range(240)], "tag": [i * 7919 % 13 for i in range(240)]}).drop_duplicates()
    sets = rows.groupby("o")["tag"].agg(set).to_dict()
    want = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= 2)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 9)
    monkeypatch.setattr(vectors, "MEMORY_BLOCK", 11)
    df = spark.createDataFrame(rows)
    assert sorted(tuple(r) for r in vectors.overlap_topk(df, df, "o", "tag", 100, 2).select("a", "b", "n").collect()) == want


def test_store_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(12)], "id long, embedding array<double>")
    stores.VectorStore(rows).save(str(tmp_path / "s"))
    back = stores.VectorStore.load(spark, str(tmp_path / "s")).delete(spark.createDataFrame([(3,)], "x long"))
    assert sorted(r["id"] for r in back.list().collect()) == [i for i in range(12) if i != 3]
    assert [r["id"] for r in back.get(spark.createDataFrame([(4,), (3,)], "x long")).collect()] == [4]


def greedy(pairs):
    near, gone = {}, set()
    for a, b in pairs:
        near.setdefault(b, set()).add(a)
    for b in sorted(near):
        if near[b] - gone:
            gone.add(b)
    return gone


def test_chains_and_random_pairs(spark, monkeypatch):
    """A chain of thousands of versions is decided in few rounds, whatever the ranges."""
    rng = random.Random(11)
    chain = [(i, i + 1) for i in range(5_000)]
    for pairs, size in ((chain, 10**6), (chain, 1_500), ([tuple(sorted(rng.sample(range(300), 2))) for _ in range(900)], 100), ([(0, i) for i in range(1, 400)], 50)):
        monkeypatch.setattr(dedup, "RANGE_PAIRS", size)
        rng.shuffle(pairs)
        got = [r["id"] for r in dedup.first_wins(spark.createDataFrame(pairs, "a long, b long")).collect()]
        assert len(got) == len(set(got)) and set(got) == greedy(pairs)


def test_copies_make_no_pairs(spark):
    """A hundred thousand copies, some of them behind a text like theirs that comes first."""
    near = "a1 a2 a3 a4 a5 a6 a7 a8 a9 b1"
    docs = spark.range(100_000).selectExpr("id + 10 AS doc_id", "'a1 a2 a3 a4 a5 a6 a7 a8 a9 b2' AS text").union(spark.createDataFrame([(1, near), (2, ""), (3, None), (4, "z9 z8"), (5, "z8 z9")], "doc_id long, text string"))
    first, copies = dedup.collapsed(docs, "doc_id", text.same_tokens(F.col("text"), distinct=True))
    assert first.count() == 5 and copies.count() == 100_000
    kept = dedup.kept_first(docs, "doc_id", text.jaccard_pairs(first, "doc_id", "text", 60), copies)
    assert sorted(r["doc_id"] for r in kept.filter("kept").collect()) == [1, 2, 3, 4]
