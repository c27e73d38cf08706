"""Queries of store upkeep; each SQL is stated on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import maintenance
from annalist.registry import Registry, read

R = Registry()


@R.query("soft_delete", "SELECT event_id, EXISTS (SELECT 1 FROM events o WHERE o.user_id = e.user_id AND o.event_type = 'error' AND o.value > 100) AS is_deleted FROM events e")
def soft_delete(spark, sf_dir):
    """Users with an error of some size lose all their events."""
    e = read(spark, sf_dir, "events")
    owners = e.filter("event_type = 'error' AND value > 100").select("user_id")
    return maintenance.soft_delete(e.select("event_id", "user_id", F.lit(False).alias("is_deleted")), owners, "user_id").select("event_id", "is_deleted")


@R.query("delete_recover_cube", "SELECT c_custkey, c_mktsegment <> 'HOUSEHOLD' AND c_nationkey % 5 = 0 AS is_deleted, CASE WHEN c_mktsegment <> 'HOUSEHOLD' AND c_nationkey % 5 = 0 THEN 'r2' END AS record FROM customer")
def delete_recover_cube(spark, sf_dir):
    """Two cubes are flagged one after the other, the first is recovered: rows of both belong to the first."""
    store = read(spark, sf_dir, "customer").withColumns({"is_deleted": F.lit(False), "record": F.lit(None).cast("string")})
    store = maintenance.delete_cube(store, F.col("c_mktsegment") == "HOUSEHOLD", "r1")
    store = maintenance.delete_cube(store, F.col("c_nationkey") % 5 == 0, "r2")
    return maintenance.recover(store, "r1").select("c_custkey", "is_deleted", "record")


@R.query("delete_by_params", "SELECT o_orderkey FROM orders WHERE o_totalprice <= 400000 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.1)")
def delete_by_params(spark, sf_dir):
    ids = read(spark, sf_dir, "lineitem").filter("l_discount >= 0.1D").select(F.col("l_orderkey").alias("o_orderkey"))
    return maintenance.delete_by(read(spark, sf_dir, "orders"), "o_orderkey", ids, F.col("o_totalprice") > 400000).select("o_orderkey")


@R.query("event_update", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN upper(event_type) ELSE event_type END AS summary, CASE WHEN event_id % 3 <> 0 THEN 'd' || event_id WHEN event_id % 9 = 0 THEN 'n' || event_id ELSE 'd' || event_id || chr(10) || 'n' || event_id END AS details FROM events")
def event_update(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    text = lambda c: F.concat(F.lit(c), F.col("event_id").cast("string")).alias("details")
    mode = F.when(F.col("event_id") % 9 == 0, "replace").otherwise("append").alias("mode")
    changes = e.filter("event_id % 3 = 0").select("event_id", F.when(F.col("event_id") % 6 == 0, F.upper("event_type")).alias("summary"), text("n"), mode)
    return maintenance.update_events(e.select("event_id", F.col("event_type").alias("summary"), text("d")), changes, "event_id")


@R.query("event_replace", "SELECT CASE WHEN event_id % 7 = 0 THEN event_id + 90000000 ELSE event_id END AS event_id, CASE WHEN event_id % 7 = 0 THEN value * 2 ELSE value END AS value FROM events")
def event_replace(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "value")
    old = e.filter("event_id % 7 = 0")
    return maintenance.replace_rows(e, old, old.select(F.col("event_id") + 90000000, F.col("value") * 2).toDF("event_id", "value"), "event_id", must_exist=True)


@R.query("event_merge_missing", "SELECT event_id, 'd' || event_id AS details, 'kept' AS state FROM events WHERE event_id % 3 <> 0 AND event_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT doc_id, 'd' || doc_id || chr(10) || 'n' || doc_id, 'merged' FROM labels WHERE quality = 1 AND doc_id % 3 <> 0 AND doc_id IN (SELECT event_id FROM events) UNION ALL SELECT doc_id, 'n' || doc_id, 'inserted' FROM labels WHERE quality = 1 AND (doc_id % 3 = 0 OR doc_id NOT IN (SELECT event_id FROM events))")
def event_merge_missing(spark, sf_dir):
    store = read(spark, sf_dir, "events").filter("event_id % 3 <> 0").select("event_id", F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("details"))
    changes = read(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("event_id"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("details"))
    return maintenance.merge_events(store, changes, "event_id")


@R.query("typed_update", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_type <> 'ECONOMY' OR p_size > 5 UNION ALL SELECT p_partkey + 70000000, upper(p_name) FROM part WHERE p_type = 'ECONOMY' AND p_size <= 5")
def typed_update(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    old = part.filter("p_type = 'ECONOMY' AND p_size <= 5").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return maintenance.replace_rows(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), old, old.select((F.col("id") + 70000000).alias("id"), F.upper("name").alias("name")), "id")


@R.query("dual_write", "SELECT p_partkey, 'working' AS copy FROM part UNION ALL SELECT p_partkey, 'long term' FROM part WHERE p_type = 'ECONOMY' OR p_type = 'STANDARD'")
def dual_write(spark, sf_dir):
    return maintenance.dual_write(read(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("p_type").isin("ECONOMY", "STANDARD")).select("p_partkey", "copy")


@R.query("replace_working", "WITH n AS (SELECT p_partkey AS id FROM (SELECT p_partkey, ROW_NUMBER() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) x WHERE k <= 20), w AS (SELECT id, id + 90000000 AS made FROM n UNION ALL SELECT s_suppkey + 50000000, s_suppkey FROM supplier) SELECT id FROM (SELECT id, ROW_NUMBER() OVER (ORDER BY made DESC, id DESC) AS k FROM w) y WHERE k <= 25")
def replace_working(spark, sf_dir):
    """Twenty new working rows by price; of old and new the 25 newest stay."""
    working = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 50000000).alias("id"), F.col("s_suppkey").alias("at"))
    found = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 90000000).alias("at"), "p_retailprice")
    return maintenance.replace_working(working, found, 20, 25, F.col("p_retailprice"), "id", "at").select("id")


@R.query("ensure_parent", "SELECT w.text, w.kind, coalesce(CAST(min(n.p_partkey) AS VARCHAR), 'new-' || md5(w.text || '/' || w.kind)) AS parent, count(n.p_partkey) = 0 AS created FROM (SELECT p_brand AS text, p_type AS kind FROM part GROUP BY ALL) w LEFT JOIN part n ON n.p_brand = w.text AND n.p_type = w.kind AND n.p_size <= 3 GROUP BY w.text, w.kind")
def ensure_parent(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("text"), F.col("p_type").alias("kind"), "p_size")
    return maintenance.ensure_parents(part.filter("p_size <= 3"), part)


@R.query("segment_apply", "WITH p AS (SELECT conv_id, turn, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS pos FROM conversations) SELECT conv_id, CAST(pos // 2 AS BIGINT) AS segment, min(turn) AS first_turn, count(*) AS n FROM p GROUP BY conv_id, pos // 2")
def segment_apply(spark, sf_dir):
    """Turns cut by a list of lengths for each conversation: pairs, and a last one where the number is odd."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    pairs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 2))
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", F.transform(pairs, lambda i: F.least(F.lit(2).cast("long"), F.col("n") - 2 * i)).alias("lengths"))
    cut = maintenance.slices(turns, lengths, "conv_id", "turn", "role")
    return cut.groupBy("conv_id", F.col("slice").cast("long").alias("segment")).agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


@R.query("topk_per_type_truncate", "SELECT event_id, event_type FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY event_type, k) AS pos FROM (SELECT event_id, event_type, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) t WHERE k <= ceil(13 / 5.0)) c WHERE pos <= 13")
def topk_per_type_truncate(spark, sf_dir):
    return maintenance.spread_topk(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", F.col("value"), "event_id", 13).select("event_id", "event_type")


@R.query("epsilon_topk", "SELECT p_brand, p_partkey FROM part QUALIFY ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY CASE WHEN CAST('0x' || substr(md5('7:' || p_brand), 1, 4) AS INTEGER) < 16384 THEN md5('7:' || p_partkey) END, p_retailprice DESC, p_partkey) <= 4")
def epsilon_topk(spark, sf_dir):
    """A quarter of the brands explore."""
    return maintenance.epsilon_topk(read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_brand", F.col("p_retailprice"), "p_partkey", 4, 0.25, 7).select("p_brand", "p_partkey")


@R.query("partition_by_user", "SELECT user_id, CAST(1 AS BIGINT) AS parts, count(*) AS n FROM events GROUP BY user_id")
def partition_by_user(spark, sf_dir):
    """Events dealt by user: each user is in one partition."""
    dealt = maintenance.by_user(read(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id")
    return dealt.withColumn("part", F.spark_partition_id()).groupBy("user_id").agg(F.count_distinct("part").alias("parts"), F.count("*").alias("n"))
