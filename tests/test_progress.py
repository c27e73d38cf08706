"""Learned values, segments, expiry, resumed runs and pages, by hand and against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from annalist.operators import carried, paging, resume
from annalist.streaming import segments


def test_values_like_steps_in_turn(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.choice("abcdef"), rng.uniform(-1, 1)) for i in range(2000)]
    held = {}
    for u, _, m, r in rows:
        of = held.setdefault(u, {})
        q, n, mean, _ = of.get(m, (0.2, 0, 0.0, 0.0))
        best = max((x[0] for x in of.values()), default=0.0)
        of[m] = (max(-0.3, (1 - 0.3) * q + 0.3 * (r + 0.9 * best)), n + 1, (1 - 0.3) * mean + 0.3 * r, r)
    shuffled = rows + [(1, 5000, None, 1.0), (1, 5001, "a", None)]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "user_id long, ord long, memory_id string, reward double").withColumn("q", F.lit("clash"))
    got = {(r["user_id"], r["memory_id"]): tuple(r)[2:] for r in carried.learned_values(df, 0.3, 0.9, 0.2, -0.3).collect()}
    assert got == {(u, m): x for u, of in held.items() for m, x in of.items()}
    assert carried.learned_values(df.limit(0), 0.3, 0.9).count() == 0


def turns(spark):
    rng = random.Random(5)
    words = ["harbour", "lantern", "meadow", "granite", "orchard", "thunder", "velvet", "walnut", *(f"distinct{c * 3}" for c in "abcdefghijklmnop")]
    return [(k, t, " ".join(rng.sample(words, rng.randint(1, 4))) if rng.random() > 0.1 else None) for k in range(5) for t in range(40)]


def expected(rows):
    out, state = [], {}
    for k, t, text in sorted(rows, key=lambda r: r[:2]):
        words = set((text or "").split())
        number, held = state.get(k, (-1, set()))
        if number >= 0 and 100 * len(words & held) >= 20 * len(words):
            held |= words
        else:
            number, held = number + 1, words
        state[k] = number, held
        out.append((k, t, number))
    return out


def prepared(df):
    return df.select("key", "ord", segments.words_of(F.col("text")).alias("words"))


def test_segments_in_batch_and_as_a_stream_that_is_started_anew(spark, tmp_path):
    rows = turns(spark)
    df = spark.createDataFrame(rows, "key long, ord long, text string")
    want = expected(rows)
    assert sorted(map(tuple, segments.segmented(prepared(df)).collect())) == want
    assert max(n for *_, n in want) > 2
    for k in range(4):  # each start of the query sees one more file
        df.filter((F.col("ord") >= 10 * k) & (F.col("ord") < 10 * k + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        query = segments.segmented_stream(prepared(stream)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_lives_in_batch_and_as_a_stream_that_is_started_anew(spark, tmp_path):
    rng = random.Random(7)
    rows = sorted((rng.randint(0, 100_000), rng.randint(0, 9)) for _ in range(400)) + [(300_000, 99)]
    df = spark.createDataFrame([(k, t) for t, k in rows], "key long, t long").select("key", F.timestamp_seconds("t").alias("at"))
    batch = {tuple(r) for r in segments.lives(df, ["key"], "at", "3000 seconds").collect()}
    plain = {}
    for t, k in rows:
        of = plain.setdefault(k, [])
        if of and t < of[-1][1] + 3000:
            of[-1][1:] = [t, of[-1][2] + 1]
        else:
            of.append([t, t, 1])
    seconds = lambda x: x.timestamp()
    assert {(k, seconds(a), seconds(b), n) for k, a, b, n in batch} == {(k, a, b + 3000, n) for k, of in plain.items() for a, b, n in of}
    # batches overlap in time within the delay that the watermark allows
    parts = [rows[:150] + rows[160:170], rows[150:160] + rows[170:300], rows[300:]]
    for k, part in enumerate(parts):
        spark.createDataFrame([(b, a) for a, b in part], "key long, t long").select("key", F.timestamp_seconds("t").alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("at", "20000 seconds")
        query = segments.lives(stream, ["key"], "at", "3000 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {r for r in batch if r[0] != 99}


@pytest.mark.parametrize("text,same", [('{"b": [1, {"d": 2, "c": null}], "a": "x"}', '{"a":"x","b":[1,{"c":null,"d":2}]}'), ("[ 1 ]", "[1]"), ("plain", None), ('{"a": 1} []', None), ("1],[2", None), ('1},{"":2', None), ("1, 2", None), ("", None), (' {"a":1,"a":2}', None)])
def test_canonical(spark, text, same):
    got = spark.createDataFrame([(text,)], "t string").select(resume.canonical(F.col("t"))).first()[0]
    assert got == (text if same is None else same)


def test_identity_keeps_parts_and_nulls_apart(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("ab", None), ("-", "ab"), (None, None)], "x string, y string")
    assert df.select(resume.identity(F.col("x"), F.col("y"))).distinct().count() == 7


def test_only_affected_jobs_run_again(spark):
    config = lambda k: json.dumps({"model": {"seed": k, "name": "m"}})
    jobs = spark.createDataFrame([(i, i // 3, config(int(i == 4))) for i in range(9)] + [(None, 9, config(0)), (20, None, None)], "job long, user long, config string").withColumn("identity", resume.identity(F.col("config")))
    before = spark.createDataFrame([(i, i // 3, config(0), f"r{i}") for i in range(9)] * 2 + [(8, 2, "other", "old")], "job long, user long, config string, result string").withColumn("identity", resume.identity(F.col("config")))
    kept = resume.stored(before)
    single = {r["job"]: (r["reused"], r["result"]) for r in resume.resumed(jobs, kept.drop("config"), "job").collect()}
    assert single == {**{i: (i != 4, None if i == 4 else f"r{i}") for i in range(9)}, None: (False, None), 20: (False, None)}
    grouped = {r["job"]: r["reused"] for r in resume.resumed_groups(jobs, kept.drop("config"), "user", "job").collect()}
    assert grouped == {**{i: i // 3 != 1 for i in range(9)}, None: False, 20: False}
    assert not resume.resumed(jobs, kept.limit(0), "job").filter("reused").count()


def test_pages_read_both_ways_give_the_table_once(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", "é", "z\"q"]), i) for i in range(57)]
    df = spark.createDataFrame(rows, "name string, id long")
    pages = paging.paged(df, 10, "name", "id")
    index = paging.page_index(pages, "name", "id").orderBy("page").collect()
    assert [r["n_rows"] for r in index] == [10, 10, 10, 10, 10, 7]
    ordered = sorted(rows, key=lambda r: (r[0].encode(), r[1]))
    for backwards in (False, True):
        column = "first_cursor" if backwards else "last_cursor"
        marks = spark.createDataFrame([(r["page"], r[column]) for r in index] + [(90, "no cursor"), (91, None), (92, "W10=")], "cursor_id long, cursor string")
        got = paging.from_cursors(df, marks, 10, "name", "id", backwards=backwards).orderBy("cursor_id", "rank").collect()
        seen = [(r["name"], r["id"]) for r in got]
        assert sorted(seen, key=lambda r: (r[0].encode(), r[1])) == (ordered[:50] if backwards else ordered[10:])
        if not backwards:
            assert seen == ordered[10:]
        assert {r["cursor_id"]: r["has_more"] for r in got} == ({k: k > 1 for k in range(1, 6)} if backwards else {k: k < 4 for k in range(5)})
    # rows added and removed elsewhere, and the row of the cursor itself, leave the page that follows as it is
    changed = df.filter("id <> %d" % ordered[29][1]).unionByName(spark.createDataFrame([("a", 900)], df.schema))
    mark = spark.createDataFrame([(1, index[2]["last_cursor"])], "cursor_id long, cursor string")
    assert [(r["name"], r["id"]) for r in paging.from_cursors(changed, mark, 5, "name", "id").orderBy("rank").collect()] == ordered[30:35]


@pytest.mark.parametrize("size,want", [(3, range(12, 15)), (4, range(12, 16)), (50, range(11, 20))])
def test_between_takes_the_middle(spark, size, want):
    df = spark.range(40).select(F.col("id").alias("a"))
    got = sorted(r["a"] for r in paging.between(df, F.struct(F.lit(10).cast("long")), F.struct(F.lit(20).cast("long")), size, "a").collect())
    low = 11
    n = min(9, 2 * size)
    start = max(0, n // 2 - size // 2) if n > size else 0
    assert got == list(range(low, low + n))[start : start + size]
