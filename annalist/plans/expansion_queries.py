"""Queries of rows that are added to found ones, and of merged extractions."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import expansion, graph, vectors
from annalist.plans import history
from annalist.plans.search_queries import PAIRS, TOP, asked
from annalist.registry import Registry, read

R = Registry()


@R.query("links_expand", "WITH " + PAIRS.format(more=" AND a.vec_id <> b.vec_id") + ", " + TOP + """, f AS (SELECT query, memory, CAST(rank AS BIGINT) AS rank FROM top WHERE rank <= 3),
l AS (SELECT l_orderkey AS note, l_partkey AS link, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos FROM lineitem)
SELECT query, rank, CAST(0 AS BIGINT) AS pos, memory AS id FROM f UNION ALL SELECT query, rank, pos, link FROM f JOIN l ON l.note = f.memory WHERE pos <= 4 AND link IN (SELECT vec_id FROM embeddings)""")  # fmt: skip
def links_expand(spark, sf_dir):
    """Each query's three nearest notes, each with up to four notes it links to: the parts of the order of its number."""
    found = vectors.topk(*asked(spark, sf_dir), 3, exclude_self=True).select("query", F.col("memory").alias("id"), F.col("rank").cast("long").alias("rank"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))["l_partkey"].alias("links"))
    notes = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")).join(lines, F.col("id") == F.col("l_orderkey"), "left").select("id", "links")
    return expansion.linked(found, notes, 3).select("query", "rank", F.col("pos").cast("long").alias("pos"), "id")


@R.query("event_expand", "SELECT e.event_id, date_trunc('minute', e.ts) AS stamp FROM events e WHERE EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'purchase' AND date_trunc('minute', s.ts) = date_trunc('minute', e.ts))")
def event_expand(spark, sf_dir):
    """All rows stamped with the minute of a purchase."""
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("stamp"))
    return expansion.same_time(rows, rows.filter("event_type = 'purchase'"), "stamp").select("event_id", "stamp")


@R.query("entries_from_facts", """WITH s AS (SELECT conv_id, role, ROW_NUMBER() OVER (ORDER BY conv_id, turn, role) - 1 AS seq, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 1000 + turn AS BIGINT)) AS said FROM conversations)
SELECT event_id AS fact, seq, said, strftime(said, '%a') AS weekday, role AS speaker, conv_id AS topic FROM events JOIN s ON seq = 2 * (event_id % 800)""")  # fmt: skip
def entries_from_facts(spark, sf_dir):
    minutes = F.col("conv_id") * 1000 + F.col("turn")
    said = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))).alias("said")
    messages = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", said, F.col("role").alias("speaker"), F.col("conv_id").alias("topic"))
    facts = read(spark, sf_dir, "events").select(F.col("event_id").alias("fact"), (F.col("event_id") % 800).alias("source_id"))
    return expansion.entries(facts, messages, "conv_id", "turn", "role").withColumn("seq", F.col("seq").cast("long"))


@R.query("dual_extract_merge", "WITH " + history.SESSIONS + """, n AS (SELECT user_id, count(*) AS n FROM sessions GROUP BY user_id), a AS (SELECT user_id, session_index AS pos, session_id AS item, CAST(floor(value) AS BIGINT) AS usage FROM sessions WHERE domain <> 'error'),
b AS (SELECT user_id, session_index AS pos, domain AS item, event_id % 5 AS usage FROM sessions JOIN n USING (user_id) WHERE session_index < n // 2 AND event_id % 3 <> 0)
SELECT s.user_id, s.session_index AS pos, CASE WHEN a.item IS NOT NULL OR b.item IS NOT NULL THEN concat_ws(',', a.item, b.item) END AS items, CASE WHEN a.item IS NOT NULL OR b.item IS NOT NULL THEN coalesce(a.usage, 0) + coalesce(b.usage, 0) END AS usage
FROM sessions s LEFT JOIN a ON a.user_id = s.user_id AND a.pos = s.session_index LEFT JOIN b ON b.user_id = s.user_id AND b.pos = s.session_index""")  # fmt: skip
def dual_extract_merge(spark, sf_dir):
    """Two extractions of a user's sessions: one gives nothing for errors, the other reads only the first half and loses a third of it."""
    result = lambda item, usage: F.struct(F.array(item).alias("items"), usage.cast("long").alias("usage"))
    rows = history.lifelines(spark, sf_dir)
    first = F.when(F.col("domain") != "error", result(F.col("session_id"), F.floor("value")))
    second = F.when(F.col("event_id") % 3 != 0, result(F.col("domain"), F.col("event_id") % 5))
    own = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("session_index", first.alias("a"), second.alias("b")))).alias("x"))
    half = F.slice(F.col("x")["b"], F.lit(1), F.floor(F.size("x") / 2).cast("int"))
    merged = own.select("user_id", F.posexplode(expansion.merged_extracts(F.col("x")["a"], half)).alias("pos", "m"))
    return merged.select("user_id", F.col("pos").cast("long").alias("pos"), F.when(F.col("m").isNotNull(), F.array_join("m.items", ",")).alias("items"), "m.usage")


@R.query("key_or_tag_recall", """WITH t AS (SELECT DISTINCT user_id, CAST(day(ts) AS VARCHAR) || '-' || regexp_extract(props, '[0-9]+') AS tag FROM events), u AS (SELECT DISTINCT user_id FROM events),
s AS (SELECT a.user_id AS query, b.user_id AS id, count(*) AS n FROM t a JOIN t b ON a.tag = b.tag WHERE a.user_id % 20 = 0 GROUP BY 1, 2)
SELECT q.user_id AS query, r.user_id AS id, r.user_id - q.user_id IN (1, 2) AS by_key, coalesce(n, 0) AS n_shared FROM u q JOIN u r ON true LEFT JOIN s ON s.query = q.user_id AND s.id = r.user_id WHERE q.user_id % 20 = 0 AND (r.user_id - q.user_id IN (1, 2) OR coalesce(n, 0) >= 2)""")  # fmt: skip
def key_or_tag_recall(spark, sf_dir):
    """Every twentieth user asks for the two users after it by name, and for all that share two tags of day and item."""
    tag = F.concat_ws("-", F.dayofmonth("ts"), F.get_json_object("props", "$.k"))
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(tag).alias("tags"))
    asked_ = rows.filter("user_id % 20 = 0").select(F.col("user_id").alias("query"), F.array(F.col("user_id") + 1, F.col("user_id") + 2).alias("keys"), "tags")
    return expansion.key_or_tags(asked_, rows.select(F.col("user_id").alias("id"), F.col("user_id").alias("key"), "tags"))


@R.query("load_passages", """WITH p AS (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN ' ' ELSE text END AS text, list_transform(embedding[1:3], lambda x: CAST(floor(x * 8) AS BIGINT)) AS e FROM embeddings JOIN documents ON doc_id = vec_id), w AS (SELECT * FROM p WHERE trim(text) <> ''), f AS (SELECT min(vec_id) AS vec_id FROM w GROUP BY e)
SELECT vec_id, (ROW_NUMBER() OVER (ORDER BY vec_id) - 1) // 100 AS batch FROM f""")  # fmt: skip
def load_passages(spark, sf_dir):
    """Texts with coarse embeddings of three places, of which many are equal; every ninth text is blank."""
    text = F.when(F.col("vec_id") % 9 == 0, " ").otherwise(F.col("text")).alias("text")
    coarse = F.transform(F.slice("embedding", 1, 3), lambda x: F.floor(x * 8)).alias("embedding")
    rows = read(spark, sf_dir, "embeddings").join(read(spark, sf_dir, "documents"), F.col("vec_id") == F.col("doc_id")).select("vec_id", text, coarse)
    return expansion.passages(rows, "vec_id").select("vec_id", "batch")


BATCH = """n AS (SELECT 'p' || p_partkey AS id, p_name AS name FROM part), b AS (SELECT 'p' || p_partkey AS id, 'new ' || p_name AS name FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0),
a AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT * FROM b)"""


def batch(spark, sf_dir):
    part, supplier, lines = (read(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    name = lambda letter, c: F.concat(F.lit(letter), c)
    nodes = part.select(name("p", "p_partkey").alias("id"), F.col("p_name").alias("name"))
    more = part.filter("p_partkey % 3 = 0").select(name("p", "p_partkey").alias("id"), F.concat(F.lit("new "), "p_name").alias("name"))
    new_nodes = more.unionByName(supplier.filter("s_suppkey % 2 = 0").select(name("s", "s_suppkey").alias("id"), F.col("s_name").alias("name")))
    edge = lambda flag: lines.filter(F.col("l_returnflag") == flag).select(name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst"), F.lit("supplied_by").alias("kind"))
    return graph.added(nodes, edge("A"), new_nodes, edge("R"))


@R.query("graph_add", "WITH " + BATCH + " SELECT id, name FROM a")
def graph_add(spark, sf_dir):
    """Nodes after a batch of changed parts and new suppliers."""
    return batch(spark, sf_dir)[0]


@R.query("graph_add_edges", "WITH " + BATCH + ", e AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_returnflag AS flag FROM lineitem) SELECT DISTINCT src, dst, 'supplied_by' AS kind FROM e WHERE flag = 'A' OR (flag = 'R' AND src IN (SELECT id FROM a) AND dst IN (SELECT id FROM a))")
def graph_add_edges(spark, sf_dir):
    """Edges after it: a new edge needs both its ends."""
    return batch(spark, sf_dir)[1]
