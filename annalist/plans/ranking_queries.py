"""Queries of ranked recall, of keys and children, of length and marker filters, and of subsets; each SQL is stated on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import text as texts
from annalist.operators import dedup, ranking, vectors
from annalist.plans import history
from annalist.registry import Registry, read

R = Registry()
PLACE = ["l_linenumber", "l_partkey", "l_suppkey"]
#: Fixed values of these queries: weights of levels.
LEVELS = {"ECONOMY": 1.0, "STANDARD": 0.8, "PROMO": 0.5}


@R.query("sim_q_rank", """WITH n AS (SELECT *, avg(l_tax) OVER w AS m, stddev_pop(l_tax) OVER w AS s FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)),
z AS (SELECT *, round(0.7 * ((l_discount - 0.1857) / 0.0941) + 0.3 * greatest(-3.0, least(3.0, (l_tax - m) / CASE WHEN s > 1e-9 THEN s ELSE 1.0 END)), 6) + 0.0 AS score FROM n)
SELECT l_orderkey, l_linenumber, l_partkey, score, rank FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, l_partkey, l_suppkey) AS INT) AS rank FROM z) x WHERE rank <= 5""")  # fmt: skip
def sim_q_rank(spark, sf_dir):
    """Lines recalled for an order, by similarity (the discount) and learned value (the tax)."""
    scored = ranking.blended(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_discount", "l_tax", 0.7, 0.3)
    scored = scored.withColumn("score", F.round("score", 6) + 0.0)
    return ranking.best(scored, "l_orderkey", [F.col("score").desc(), *map(F.col, PLACE)], 5).select("l_orderkey", "l_linenumber", "l_partkey", "score", "rank")


@R.query("value_select", """WITH q AS (SELECT *, greatest(coalesce(CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_tax END, 0.04), 0.02) + CASE WHEN l_linestatus = 'F' THEN 0.01 ELSE 0.0 END AS q FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, round(q, 6) AS q, rank FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY q DESC, l_discount DESC, l_linenumber, l_partkey, l_suppkey) AS INT) AS rank FROM q WHERE q >= 0.03) x WHERE rank <= 2""")  # fmt: skip
def value_select(spark, sf_dir):
    """Two memories an order by value, then similarity: unknown values start at 0.04, none is below 0.02, used ones rise by 0.01, those below 0.03 are out."""
    known = F.when(F.col("l_returnflag") == "A", F.lit(None)).otherwise(F.col("l_tax"))
    value = ranking.valued(known, 0.04, 0.02, 0.01, F.col("l_linestatus") == "F")
    chosen = ranking.select_valued(read(spark, sf_dir, "lineitem"), "l_orderkey", value, "l_discount", 2, PLACE, 0.03)
    return chosen.select("l_orderkey", "l_partkey", "l_linenumber", F.round("q", 6).alias("q"), "rank")


@R.query("weighted_rerank", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT l.*, round(list_cosine_similarity(q.v, m.v) * CASE p_type WHEN 'ECONOMY' THEN 1.0 WHEN 'STANDARD' THEN 0.8 WHEN 'PROMO' THEN 0.5 ELSE 1.0 END, 6) AS own FROM lineitem l JOIN e q ON q.vec_id = l.l_orderkey JOIN part ON p_partkey = l.l_partkey LEFT JOIN e m ON m.vec_id = l.l_partkey),
r AS (SELECT *, count(own) OVER (PARTITION BY l_orderkey) AS n, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY own DESC NULLS LAST, l_linenumber, l_partkey, l_suppkey) AS INT) AS rank FROM c)
SELECT l_orderkey, l_partkey, rank, coalesce(own, CASE WHEN n > 0 THEN -1.0 ELSE coalesce(nullif(l_discount, 0.0), 0.5) END) AS score FROM r WHERE rank <= 3""")  # fmt: skip
def weighted_rerank(spark, sf_dir):
    """Parts recalled for an order that has a vector, by cosine times the weight of the part's type; parts may have no vector."""
    e = read(spark, sf_dir, "embeddings")
    lines = read(spark, sf_dir, "lineitem").join(e.select(F.col("vec_id").alias("l_orderkey"), F.col("embedding").alias("asked")), "l_orderkey")
    lines = lines.join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(e.select("vec_id", "embedding"), F.col("l_partkey") == F.col("vec_id"), "left")
    weight = F.coalesce(*(F.when(F.col("p_type") == level, F.lit(w)) for level, w in LEVELS.items()), F.lit(1.0))
    return ranking.weighted(lines, "l_orderkey", vectors.cosine(F.col("asked"), F.col("embedding")), weight, F.col("l_discount"), PLACE, 3).select("l_orderkey", "l_partkey", "rank", "score")


@R.query("attach_or_create_key", """WITH f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem WHERE l_discount >= 0.08)
SELECT o_orderkey AS memory, l_partkey AS key, l_partkey IS NULL AS is_new FROM orders LEFT JOIN f ON l_orderkey = o_orderkey AND k = 1""")  # fmt: skip
def attach_or_create_key(spark, sf_dir):
    """Orders as tasks whose memories are attached to the best of their parts, the discount being the score."""
    tasks = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    done = ranking.attached(tasks, read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_discount", PLACE, 0.08)
    return done.select(F.col("l_orderkey").alias("memory"), "key", "is_new")


@R.query("children_embeddings", """SELECT DISTINCT l_orderkey AS parent, l_partkey AS child, p_name AS memory, CAST(len(embedding) AS INT) AS width FROM lineitem JOIN part ON p_partkey = l_partkey JOIN embeddings ON vec_id = p_partkey WHERE l_orderkey % 20 = 0 AND l_orderkey % 3 = l_partkey % 3""")
def children_embeddings(spark, sf_dir):
    """Parts as children of every twentieth order (asked parents), of one tenant (ids modulo 3), with their vectors."""
    edges = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("child"))
    nodes = read(spark, sf_dir, "part").join(read(spark, sf_dir, "embeddings"), F.col("p_partkey") == F.col("vec_id"))
    nodes = nodes.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("tenant"), "p_name", "embedding")
    parents = read(spark, sf_dir, "orders").filter("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("tenant"))
    return ranking.children(edges, nodes, parents, "tenant").select("parent", "child", F.col("p_name").alias("memory"), F.size("embedding").alias("width"))


@R.query("filter_short_text", r"""WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, url FROM pages UNION ALL SELECT 'c' || conv_id || '-' || turn || '-' || role, text FROM conversations), s AS (SELECT id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS own FROM t)
SELECT id FROM s WHERE own <> '' AND CASE WHEN regexp_full_match(own, '[\x00-\x7F]*') THEN len(regexp_split_to_array(own, '\s+')) ELSE length(own) END >= 20""")  # fmt: skip
def filter_short_text(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id"), "url")
    said = read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn", F.lit("-"), "role"), "text")
    return docs.union(pages).union(said).filter(texts.long_enough(F.col("text"))).select("id")


@R.query("filter_intermediate", """SELECT doc_id FROM documents WHERE text IS NULL OR NOT (contains(text, 'GNU') OR contains(text, 'MIT License') OR contains(text, 'token = '))""")
def filter_intermediate(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter(texts.without_markers(F.col("text"), ("GNU", "MIT License", "token = "))).select("doc_id")


@R.query("restore_order", "WITH " + history.PROBES.replace("{events}", "events") + " SELECT probe_id, CAST(ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS BIGINT) AS probe_pos FROM probes")
def restore_order(spark, sf_dir):
    """Places of probes in the order of the input, numbered by ranges."""
    own = history.probes(history.lifelines(spark, sf_dir), "event_id").select("probe_id", "event_id")
    return dedup.numbered(own, "probe_pos", "event_id").select("probe_id", F.col("probe_pos").cast("long").alias("probe_pos"))


@R.query("subset_users_probes", "WITH " + history.PROBES + """, u AS (SELECT user_id, DENSE_RANK() OVER (ORDER BY CAST(user_id AS VARCHAR(20))) AS ur FROM (SELECT DISTINCT user_id FROM probes) d), kept AS (SELECT p.*, ROW_NUMBER() OVER (ORDER BY p.event_id) AS pr FROM probes p JOIN u USING (user_id) WHERE u.ur <= 60), few AS (SELECT * FROM kept WHERE pr <= 300), again AS (SELECT user_id, ROW_NUMBER() OVER (ORDER BY CAST(user_id AS VARCHAR(20))) - 1 AS i FROM (SELECT DISTINCT user_id FROM few) d)
SELECT f.probe_id, f.user_id FROM few f JOIN again a USING (user_id) WHERE a.i % 4 = 1""")  # fmt: skip
def subset_users_probes(spark, sf_dir):
    """The first 60 users, of these the first 300 probes, of the users left every fourth: limits are the feature, kept in each task before rows meet."""
    own = history.probes(history.lifelines(spark, sf_dir), "event_id").filter(F.col("user_id").isNotNull())
    users = own.select(F.col("user_id").alias("of"), F.col("user_id").cast("string").alias("name")).distinct().orderBy("name").limit(60)
    few = own.join(F.broadcast(users), F.col("user_id") == F.col("of")).orderBy("event_id").limit(300)
    again = dedup.numbered(few.select("of", "name").distinct(), "i", "name").filter("i % 4 = 1").select(F.col("of").alias("shard_user"))
    return few.join(again, F.col("user_id") == F.col("shard_user"), "left_semi").select("probe_id", "user_id")
