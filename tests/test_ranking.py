"""Running lists, ranked recall and attached keys against plain Python."""

import random
import statistics

from pyspark.sql import functions as F

from annalist.functions import text as texts
from annalist.operators import asof, graph, ranking, scoring


def test_running_top_against_all_earlier_rows(spark):
    dice = random.Random(7)
    rows = [(u, i, dice.choice([None, *range(40)])) for u, n in ((1, 700), (2, 1), (3, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "user_id int, i int, value int")
    got = {(r["user_id"], r["i"]): [(x["value"], x["i"]) for x in r["best"]] for r in asof.running_top(df, "user_id", ["i"], ["value", "i"], 8, "best").collect()}
    odd = {(r["user_id"], r["i"]): [x["i"] for x in r["best"]] for r in asof.running_top(df, "user_id", ["i"], ["i"], 3, "best", F.col("value") > 30).collect()}
    for u, i, _ in rows:
        seen = [(v, k) for w, k, v in rows if w == u and k <= i]
        order = lambda x: (x[0] is not None, x[0] or 0, x[1])
        assert got[u, i] == sorted(seen, key=order, reverse=True)[:8]
        assert odd[u, i] == sorted((k for v, k in seen if v is not None and v > 30), reverse=True)[:3]
    assert "SortMergeJoin" not in asof.running_top(df, "user_id", ["i"], ["value", "i"], 8, "b")._jdf.queryExecution().toString()


def test_blended(spark):
    rows = [(1, 0.1, 5.0), (1, 0.3, 1.0), (1, 0.3, 1000.0), (2, 0.2, 4.0), (3, 0.1, 2.0), (3, None, 2.0), (None, 0.1, 1.0), (4, 0.5, None)]
    rows += [(5, 0.0, 0.0)] * 40 + [(5, 0.0, 1e6)]
    got = ranking.blended(spark.createDataFrame(rows, "g int, s double, v double"), "g", "s", "v", 0.6, 0.4).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [v for g, _, v in rows if g == r["g"] and v is not None]
        if r["s"] is None or r["v"] is None:
            assert r["score"] is None
            continue
        std = statistics.pstdev(own)
        z = max(-3.0, min(3.0, (r["v"] - statistics.fmean(own)) / (std if std > 1e-9 else 1.0)))
        assert abs(r["score"] - (0.6 * (r["s"] - 0.1857) / 0.0941 + 0.4 * z)) < 1e-9


def test_select_valued(spark):
    df = spark.createDataFrame([(1, "a", None, 0.1, True), (1, "b", 0.9, 0.1, False), (1, "c", 0.9, 0.2, False), (1, "d", -1.0, 0.9, False), (2, "e", -1.0, 0.9, True)], "g int, id string, v double, s double, used boolean")
    q = ranking.valued(F.col("v"), 0.5, 0.0, 0.45, F.col("used"))
    got = {(r["g"], r["rank"]): (r["id"], round(r["q"], 6)) for r in ranking.select_valued(df, "g", q, "s", 2, ["id"], 0.1).collect()}
    assert got == {(1, 1): ("a", 0.95), (1, 2): ("c", 0.9), (2, 1): ("e", 0.45)}


def test_weighted_falls_back(spark):
    df = spark.createDataFrame([(1, 0, 0.5, 0.3), (1, 1, None, 0.9), (1, 2, 0.7, 0.1), (1, 3, None, 0.8), (2, 0, None, 0.0), (2, 1, None, 0.7), (2, 2, None, None)], "g int, at int, c double, r double")
    got = [(r["g"], r["at"], r["score"]) for r in ranking.weighted(df, "g", F.col("c"), F.lit(1.0), F.col("r"), ["at"], 3).orderBy("g", "rank").collect()]
    assert got == [(1, 2, 0.7), (1, 0, 0.5), (1, 1, -1.0), (2, 0, 0.5), (2, 1, 0.7), (2, 2, 0.5)]


def test_attached_takes_the_first_of_equals(spark):
    tasks = spark.createDataFrame([(1,), (2,), (3,)], "t int")
    recalled = spark.createDataFrame([(1, "late", 0.9, 2), (1, "first", 0.9, 1), (1, "low", 0.1, 0), (2, "low", 0.79, 0), (9, "nobody", 1.0, 0)], "t int, q string, s double, at int")
    assert {r["t"]: (r["key"], r["is_new"]) for r in ranking.attached(tasks, recalled, "t", "q", "s", ["at"], 0.8).collect()} == {1: ("first", False), 2: (None, True), 3: (None, True)}


def test_children_of_one_tenant(spark):
    edges = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 5), (1, 7)], "parent int, child int")
    nodes = spark.createDataFrame([(5, "a", [1.0]), (6, "b", [2.0])], "id int, tenant string, embedding array<double>")
    parents = spark.createDataFrame([(1, "a")], "id int, tenant string")
    assert [(r["parent"], r["child"], r["embedding"]) for r in ranking.children(edges, nodes, parents, "tenant").collect()] == [(1, 5, [1.0])]


def test_short_and_marked_texts(spark):
    said = {" ": False, None: False, "a " * 19: False, " " + "a " * 20: True, "é" * 19: False, "é" * 20: True, "a" * 500: False}
    df = spark.createDataFrame([(x,) for x in said], "x string")
    assert {r["x"]: r["ok"] for r in df.select("x", texts.long_enough(F.col("x")).alias("ok")).collect()} == said
    marked = df.union(spark.createDataFrame([("has KEY: in it",)], "x string")).select("x", texts.without_markers(F.col("x"), ("KEY:", "NO:")).alias("ok"))
    assert [r["x"] for r in marked.collect() if not r["ok"]] == ["has KEY: in it"]
    words = spark.createDataFrame([("ñno, Yes!",), ("nobody",), (None,)], "x string")
    assert [r["s"] for r in words.select(texts.yes_no(F.col("x")).alias("s")).collect()] == ["yes", None, None]


def test_rows_around_each_other(spark):
    dice = random.Random(3)
    rows = [(i, dice.choice([1, 1, 1, 2, None]), dice.choice([None, *range(0, 40_000)])) for i in range(400)] + [(1000, 1, 0), (1001, 1, 3600), (1002, 1, 7200), (1003, 1, 7201)]
    df = spark.createDataFrame(rows, "id int, u int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((r["a"], r["b"]) for r in asof.around(df, "u", "ts", "id", 3600).collect())
    assert got == sorted((i, j) for i, u, s in rows for j, v, t in rows if i != j and u is not None and u == v and s is not None and t is not None and abs(s - t) <= 3600)


def test_gold_violations(spark):
    sessions = spark.createDataFrame([("a", 1, 0), ("b", 1, 5), ("c", 2, 0), ("d", None, 0)], "session_id string, user_id int, session_index int")
    gold = spark.createDataFrame([("p", s, 1, 3) for s in ("a", "b", "c", "d", "x")], "probe_id string, session_id string, user_id int, cutoff int")
    assert {r["session_id"]: r["violation"] for r in scoring.gold_violations(gold, sessions).collect()} == {"b": "after cutoff", "c": "wrong user", "d": "wrong user", "x": "unknown"}


def test_walk_over_repeated_edges_ends(spark):
    edges = spark.createDataFrame([("a", "b")] * 50 + [("b", "c"), ("c", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",), ("z",)], "id string")
    got = {(r["id"], r["node"]): r["steps"] for r in graph.distances(edges, start, 9).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("z", "z"): 0}
