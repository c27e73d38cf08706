"""Hand-worked scores: four probes of two users, five ranks."""

import random

import pytest
from pyspark.sql import functions as F

from annalist.operators import scoring

ROWS = [
    ("p1", "A", "A", ["a2", "a2", "zz", "a0", "a1", "a3", "a4"], ["a0", "a2"], [], [], ["zz"], [], []),
    ("p2", "C", "B", ["a1", "a0", "a2", "a3", "b0"], ["a1", "a3", "a4", "a5", "a6", "a7"], ["a0"], ["a2"], [], ["b0"], []),
    ("p3", "C", "C", ["b5", "b2", "b1"], ["b1"], [], ["b0"], [], [], ["b5"]),
    ("p4", "D", "D", [], ["b4"], ["b2"], [], [], [], []),
]
SCHEMA = "probe_id string, choice string, gold string, ranked array<string>, positives array<string>, temporal array<string>, nonbinding array<string>, unknown array<string>, wrong_user array<string>, after_cutoff array<string>"
WANT = {
    "attributed": [7, 5, 3, 0], "n_unique": [6, 5, 3, 0], "n_valid": [5, 4, 2, 0], "recall": [1, 0.333333, 1, 0], "coverage_eff": [1, 0.4, 1, 0], "precision": [0.4, 0.4, 0.2, 0], "returned_precision": [0.4, 0.4, 0.333333, 0],
    "mrr": [1, 1, 0.333333, 0], "ndcg": [0.919721, 0.485229, 0.5, 0], "graded_ndcg": [None, 0.556557, None, 0], "temporal_recall": [None, 1, None, 0], "intrusion": [None, 0.2, 0, None], "full": [True, False, True, False],
}


@pytest.fixture(scope="module")
def scored(spark):
    return scoring.score_probes(spark.createDataFrame(ROWS, SCHEMA)).cache()


def test_probes(scored):
    got = {r["probe_id"]: r for r in scored.collect()}
    for name, values in WANT.items():
        for probe, want in zip(("p1", "p2", "p3", "p4"), values):
            have = got[probe][name]
            assert have == want or have is not None and want is not None and abs(have - want) < 1e-6, (probe, name, have)


def test_totals(scored):
    r = scored.agg(*scoring.metric_columns()).first()
    want = {"accuracy": 0.75, "ci_low": 0.300642, "ci_high": 0.954413, "recall_macro": 0.583333, "recall_micro": 0.5, "coverage_eff": 0.6, "precision": 0.25, "mrr": 0.583333, "ndcg": 0.476237, "full_rate": 0.5, "invalid_rate": 0.214286, "intrusion": 0.1, "utility_gap": -0.333333}
    for name, value in want.items():
        assert abs(r[name] - value) < 1e-5, (name, r[name])


def test_context_mode_counts_all(spark):
    r = scoring.score_probes(spark.createDataFrame(ROWS, SCHEMA), mode="context").filter("probe_id = 'p1'").first()
    assert r["k"] == 6 and r["recall"] == 1


@pytest.mark.parametrize("k,n,low,high", [(0, 4, 0, 0.489891), (4, 4, 0.510109, 1), (50, 100, 0.403832, 0.596168), (0, 0, 0, 0)])
def test_wilson(spark, k, n, low, high):
    a, b = scoring.wilson(F.lit(k), F.lit(n))
    r = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert abs(r["a"] - low) < 1e-6 and abs(r["b"] - high) < 1e-6


def test_components(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [["a"], ["b", "x"], ["y"]]), (["a"], [["a"]]), (["a"], [])], "t array<string>, g array<array<string>>")
    got = [tuple(r) for r in df.select(*scoring.component_scores(F.col("t"), F.col("g"))).collect()]
    assert [(round(a, 4), round(b, 4), c) for a, b, c in got[:2]] == [(0.6667, 0.3333, False), (1.0, 1.0, True)] and got[2] == (None, None, None)


def test_means_do_not_depend_on_the_order(spark):
    """160 probes whose mean reciprocal rank is 33.15 / 160 = 0.2071875, half-way between two roundings."""
    places = [1] * 5 + [2] * 10 + [3] * 30 + [4] * 11 + [5] * 52 + [0] * 52
    rows = [("A", "A", ["x", "y", "z", "w", "v"][: k - 1] + ["p"] if k else ["x"], ["p"], [], []) for k in places]
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "choice string, gold string, ranked array<string>, positives array<string>, temporal array<string>, nonbinding array<string>").repartition(seed + 1)
        assert scoring.retrieval_aggregates(df, "ranked").first()["mrr"] == 0.2071875
