"""Linked notes, rows of one time, messages of facts and merged extractions on hand-made rows; recall by key or tags, batches of passages and of a graph."""

from pyspark.sql import functions as F

from annalist.operators import expansion, graph


def test_links_beyond_the_counter_and_to_unknown_notes(spark):
    notes = spark.createDataFrame([(1, [2, 9, 3, 4, 5]), (2, []), (3, None), (4, [1]), (5, [5])], "id long, links array<long>")
    found = spark.createDataFrame([("q", 1, 1), ("q", 2, 3), ("p", 1, 5), ("p", 2, 8)], "query string, rank long, id long")
    got = [tuple(r) for r in expansion.linked(found, notes, 2).orderBy("query", "rank", "pos").collect()]
    assert got == [("p", 1, 0, 5), ("p", 1, 1, 5), ("q", 1, 0, 1), ("q", 1, 1, 2), ("q", 1, 3, 3), ("q", 2, 0, 3)]
    assert not expansion.linked(found.limit(0), notes, 2).count()


def test_rows_of_a_stamp_come_once(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "x"), (4, "b", "x"), (5, "a", "x")], "id long, stamp string, who string")
    seeds = rows.filter("id IN (1, 3, 5)")
    assert sorted(r["id"] for r in expansion.same_time(rows, seeds, "stamp").collect()) == [1, 2, 5]
    assert sorted(r["id"] for r in expansion.same_time(rows, seeds, "stamp", "who").collect()) == [1, 5]


def test_facts_of_unknown_sources_are_left_out(spark):
    said = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(n)").alias("said")
    messages = spark.range(5).withColumnRenamed("id", "n").withColumn("n", F.col("n").cast("int")).select("n", said, F.lit("user").alias("speaker"), F.lit(None).cast("string").alias("topic"))
    facts = spark.createDataFrame([(10, 0), (11, 2), (12, 3), (13, None), (14, 2)], "fact long, source_id long")
    got = sorted((r["fact"], r["seq"], r["weekday"]) for r in expansion.entries(facts, messages, "n").collect())
    assert got == [(10, 0, "Mon"), (11, 4, "Fri"), (14, 4, "Fri")]


def test_two_extractions_place_by_place(spark):
    kind = "array<struct<items:array<string>,usage:bigint>>"
    df = spark.createDataFrame([([(["x"], 1), None, (None, 2), None], [(["y", "z"], None), None]), (None, [(["w"], 3)]), (None, None), ([], [])], f"a {kind}, b {kind}")
    got = [[None if m is None else (m["items"], m["usage"]) for m in r[0]] for r in df.select(expansion.merged_extracts(F.col("a"), F.col("b"))).collect()]
    assert got == [[(["x", "y", "z"], 1), None, ([], 2), None], [(["w"], 3)], [], []]


def test_recall_by_key_or_by_two_tags(spark):
    rows = spark.createDataFrame([(1, "a", ["x", "y", "x"]), (2, "b", ["x", "x"]), (3, None, [None, "y"]), (4, "c", None), (5, "d", ["x", "y", "z"])], "id long, key string, tags array<string>")
    asked = spark.createDataFrame([("q", ["b", "c", "b", None], ["x", "y", "y", None]), ("e", [], []), ("n", None, None)], "query string, keys array<string>, tags array<string>")
    got = sorted(tuple(r) for r in expansion.key_or_tags(asked, rows).select("query", "id", "by_key", "n_shared").collect())
    assert got == [("q", 1, False, 2), ("q", 2, True, 1), ("q", 4, True, 0), ("q", 5, False, 2)]


def test_passages_without_blanks_and_repeated_embeddings(spark):
    rows = [(i, "t" if i != 3 else "  ", [i % 4, 0]) for i in range(12)] + [(20, "t", None), (21, None, [9, 9]), (22, "t", [9, 9])]
    got = expansion.passages(spark.createDataFrame(rows, "id long, text string, embedding array<long>"), "id", 2).orderBy("id").collect()
    assert [(r["id"], r["batch"]) for r in got] == [(0, 0), (1, 0), (2, 1), (7, 1), (22, 2)]


def test_a_batch_into_a_graph(spark):
    node, edge = "id string, name string", "src string, dst string, kind string"
    nodes, edges = graph.added(
        spark.createDataFrame([("a", "A"), ("b", "B")], node), spark.createDataFrame([("a", "b", "k"), ("a", "gone", "k")], edge),
        spark.createDataFrame([("b", "B2"), ("c", None)], node), spark.createDataFrame([("a", "b", "k"), ("a", "b", "l"), ("c", "a", "k"), ("c", "z", "k"), (None, "a", "k")], edge),
    )
    assert sorted(map(tuple, nodes.collect())) == [("a", "A"), ("b", "B2"), ("c", None)]
    assert sorted(map(tuple, edges.collect())) == [("a", "b", "k"), ("a", "b", "l"), ("a", "gone", "k"), ("c", "a", "k")]
