"""Queries of memory stores, rank fusion, value-aware recall and order-sensitive state; each SQL is stated on its own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.functions import text as texts
from annalist.operators import dedup, graph, stores, text, vectors
from annalist.plans import history
from annalist.plans.search_queries import BM25, COS, PAIRS, TOKENS, TOP, asked
from annalist.registry import Registry, read
from annalist.streaming import memory

R = Registry()
DENSE = "dq AS (SELECT item_id AS query, embedding AS qv FROM benchmark JOIN embeddings ON vec_id = item_id), dd AS (SELECT doc_id AS id, embedding AS dv FROM documents JOIN embeddings ON vec_id = doc_id), ds AS (SELECT query, id, round(list_dot_product(CAST(qv AS DOUBLE[]), CAST(dv AS DOUBLE[])) / (sqrt(list_dot_product(CAST(qv AS DOUBLE[]), CAST(qv AS DOUBLE[]))) * sqrt(list_dot_product(CAST(dv AS DOUBLE[]), CAST(dv AS DOUBLE[])))), 9) AS score FROM dq, dd), dr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM ds)"


def both_ways(spark, sf_dir, k):
    """Keyword and dense rankings of documents for the benchmark items; vectors are those of equal ids."""
    docs, items, e = (read(spark, sf_dir, t) for t in ("documents", "benchmark", "embeddings"))
    keyword = text.bm25(items, docs, k, "item_id", "text", "doc_id", "text").withColumnRenamed("doc", "id")
    q = items.select(F.col("item_id").alias("query_id")).join(e, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    m = docs.select("doc_id").join(e, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("memory_id"), "embedding")
    return keyword, vectors.topk(q, m, k).withColumnRenamed("memory", "id")


@R.query("milvus_hybrid", BM25 + ", " + DENSE + ", u AS (SELECT query, doc AS id, rank FROM r WHERE rank <= 10 UNION ALL SELECT query, id, rank FROM dr WHERE rank <= 10), f AS (SELECT query, id, round(sum(1.0 / (60 + rank)), 8) AS score FROM u GROUP BY query, id) SELECT query, id, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, id) AS k FROM f) x WHERE k <= 5")
def milvus_hybrid(spark, sf_dir):
    """Dense and sparse lists of ten, fused by reciprocal ranks."""
    return stores.fuse(list(both_ways(spark, sf_dir, 10)), 5).select("query", "id", "score")


@R.query("hybrid_alpha", BM25 + ", " + DENSE + ", b AS (SELECT query, doc AS id, score FROM r WHERE rank <= 10), mm AS (SELECT query, id, (score - min(score) OVER (PARTITION BY query)) / (max(score) OVER (PARTITION BY query) - min(score) OVER (PARTITION BY query) + 0.000001) AS kw FROM b), d10 AS (SELECT query, id, score AS cos FROM dr WHERE rank <= 10), f AS (SELECT coalesce(mm.query, d10.query) AS query, coalesce(mm.id, d10.id) AS id, round(0.5 * coalesce(kw, 0) + 0.5 * coalesce(cos, 0), 6) AS score FROM mm FULL OUTER JOIN d10 ON mm.query = d10.query AND mm.id = d10.id) SELECT query, id, round(score, 4) AS score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, id) AS k FROM f) x WHERE k <= 5")
def hybrid_alpha(spark, sf_dir):
    """Keyword scores scaled within a query, mixed half and half with cosines."""
    keyword, dense = both_ways(spark, sf_dir, 10)
    return stores.mixed(keyword, dense, 0.5, 5).select("query", "id", F.round("score", 4).alias("score"))


@R.query("bm25_tfidf_rerank", BM25 + """, nn AS (SELECT count(*) AS n FROM documents), ti AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS i FROM tf, nn GROUP BY term, n), dn AS (SELECT doc, sqrt(sum(tf * i * tf * i)) AS norm FROM tf JOIN ti USING (term) GROUP BY doc), qn AS (SELECT query, sqrt(sum(qtf * i * qtf * i)) AS norm FROM qt JOIN ti USING (term) GROUP BY query),
c AS (SELECT r.query, r.doc, r.score, sum(qtf * i * tf * i) / any_value(qn.norm * dn.norm) AS cos FROM r JOIN tf ON tf.doc = r.doc JOIN qt ON qt.query = r.query AND qt.term = tf.term JOIN ti ON ti.term = tf.term JOIN qn ON qn.query = r.query JOIN dn ON dn.doc = r.doc WHERE r.rank <= 10 GROUP BY r.query, r.doc, r.score)
SELECT query, doc, round(score, 3) AS score FROM (SELECT query, doc, round(0.7 * score + 0.3 * cos, 6) AS score, ROW_NUMBER() OVER (PARTITION BY query ORDER BY round(0.7 * score + 0.3 * cos, 6) DESC, doc) AS k FROM c) x WHERE k <= 5""")  # fmt: skip
def bm25_tfidf_rerank(spark, sf_dir):
    """The ten best by BM25, ranked anew by 0.7 BM25 + 0.3 TF-IDF cosine."""
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    first = text.bm25(items, docs, 10, "item_id", "text", "doc_id", "text").select("query", "doc", "score")
    return text.tfidf_rerank(first, items, docs, "item_id", "text", "doc_id", "text", 0.3, 5).select("query", "doc", F.round("score", 3).alias("score"))


@R.query("fulltext_rank", "WITH q AS (SELECT item_id AS query, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')[1:3]) AS t FROM benchmark), qt AS (SELECT query, len(t) AS n, unnest(t) AS term FROM q), w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS a, regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+') AS b FROM documents), f AS (SELECT query, n, id, term, CASE WHEN list_contains(a, term) THEN 1.0 WHEN list_contains(b, term) THEN 0.4 END AS wt FROM qt, w), s AS (SELECT query, id, count(wt) = any_value(n) AS whole, sum(wt) AS s FROM f WHERE wt IS NOT NULL GROUP BY query, id), o AS (SELECT *, sum(CASE WHEN whole THEN 1 ELSE 0 END) OVER (PARTITION BY query) < 10 AS few FROM s) SELECT query, id, CAST(score AS DOUBLE) AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT query, id, round(CAST(s AS DOUBLE) / (s + 1), 6) AS score, ROW_NUMBER() OVER (PARTITION BY query ORDER BY round(CAST(s AS DOUBLE) / (s + 1), 6) DESC, id) AS rank FROM o WHERE whole OR few) x WHERE rank <= 10")
def fulltext_rank(spark, sf_dir):
    """Weighted fields, all terms first, any term where those are few."""
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.slice(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)), 1, 3).alias("terms"))
    return stores.ranked_text(q, read(spark, sf_dir, "documents"), "doc_id", ["text", "source"], 10)


@R.query("cosine_matrix", "SELECT a.label, a.vec_id AS a, b.vec_id AS b, " + COS.format(d=6) + " AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 5 = 0 AND b.vec_id % 5 = 0")
def cosine_matrix(spark, sf_dir):
    """All cosines within each retrieved set (here every fifth vector of a label): a matrix product for each set."""
    return vectors.matrix(read(spark, sf_dir, "embeddings").filter("vec_id % 5 = 0"), "label", "vec_id")


@R.query("greedy_diverse", "WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND " + COS.format(d=9) + " > 0.35), n AS (SELECT label, vec_id AS id, ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), nb AS (SELECT b AS id, list(a) AS earlier FROM p GROUP BY b), walk AS (SELECT label, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken FROM embeddings GROUP BY label UNION ALL SELECT n.label, n.k, CASE WHEN nb.earlier IS NOT NULL AND list_has_any(walk.taken, nb.earlier) THEN walk.taken ELSE list_append(walk.taken, n.id) END FROM walk JOIN n ON n.label = walk.label AND n.k = walk.k + 1 LEFT JOIN nb ON nb.id = n.id) SELECT label, unnest(taken) AS vec_id FROM (SELECT label, taken, ROW_NUMBER() OVER (PARTITION BY label ORDER BY k DESC) AS r FROM walk) x WHERE r = 1")
def greedy_diverse(spark, sf_dir):
    """In order, a vector is taken unless its cosine with a taken one is above the bar."""
    return vectors.diverse(read(spark, sf_dir, "embeddings"), "label", "vec_id", 0.35)


@R.query("entity_merge", "WITH " + PAIRS.format(more=" AND b.vec_id < a.vec_id").replace("a.vec_id % 20 = 0", "TRUE") + ", " + TOP + " SELECT e.vec_id, coalesce(t.memory, e.vec_id) AS node FROM embeddings e LEFT JOIN top t ON t.query = e.vec_id AND t.rank = 1 AND round(t.score, 4) >= 0.6")
def entity_merge(spark, sf_dir):
    """An entity becomes its nearest earlier one if their cosine, to four places, reaches the threshold; else a node of its own."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    best = vectors.topk(e.withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "memory_id"), 1, exclude_self=True, not_later=True).filter(F.round("score", 4) >= 0.6)
    return e.join(best, F.col("vec_id") == F.col("query"), "left").select("vec_id", F.coalesce("memory", "vec_id").alias("node"))


VALUE = "mem AS (SELECT doc_id AS id, doc_id % 500 AS stored, CAST(n_chars % 100 AS DOUBLE) / 100 AS q FROM documents)"


@R.query("value_retrieve", "WITH " + PAIRS.format(more=" AND b.label <> 0") + ", " + TOP + ", " + VALUE + ", hit AS (SELECT query, memory AS stored, score FROM top WHERE rank <= 5 AND score >= 0.2), x AS (SELECT query, mem.id, round(0.7 * hit.score + 0.3 * q, 6) AS score FROM hit JOIN mem USING (stored)) SELECT query, id, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, id) AS k FROM x) y WHERE k <= 3")
def value_retrieve(spark, sf_dir):
    """The stored queries nearest to one, their memories, ranked by similarity and value."""
    q, m = asked(spark, sf_dir)
    near = vectors.topk(q, m.filter("label <> 0"), 5).filter("score >= 0.2").select("query", F.col("memory").alias("near"), F.col("score").alias("sim"))
    mem = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 500).alias("stored"), (F.col("n_chars") % 100).cast("double").alias("v"))
    rows = near.join(mem, F.col("near") == F.col("stored")).select("query", "id", F.round(0.7 * F.col("sim") + 0.3 * (F.col("v") / 100), 6).alias("score"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))).filter("k <= 3").drop("k")


@R.query("avg_key_retrieve", "WITH k AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE vec_id % 10 = 0), c AS (SELECT label, list(m ORDER BY i) AS cv FROM (SELECT label, i, avg(x) AS m FROM k GROUP BY label, i) y GROUP BY label), s AS (SELECT c.label AS query, e.vec_id AS memory, round(list_dot_product(cv, CAST(e.embedding AS DOUBLE[])) / (sqrt(list_dot_product(cv, cv)) * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))), 6) AS score FROM c, embeddings e WHERE e.vec_id % 10 <> 0), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, memory) AS k FROM s) SELECT query, memory, score FROM r WHERE k <= 5 AND score >= 0.2")
def avg_key_retrieve(spark, sf_dir):
    """The mean of a query's keyword vectors searches for twice as many; a threshold and a cut follow."""
    e = read(spark, sf_dir, "embeddings")
    keys = vectors.centroid(e.filter("vec_id % 10 = 0"), "label").withColumnRenamed("centroid", "embedding")
    found = vectors.topk(keys, e.filter("vec_id % 10 <> 0"), 10, "label", "vec_id")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "memory"))
    return found.withColumn("score", F.round("score", 6)).withColumn("k", rank).filter("score >= 0.2 AND k <= 5").select("query", "memory", "score")


@R.query("vector_store", "WITH s AS (SELECT vec_id AS id, label, embedding FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 7 <> 0 UNION ALL SELECT vec_id, label + 100, embedding FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 7 <> 0), sim AS (SELECT a.vec_id AS query, b.id AS memory, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 9) AS score FROM embeddings a, s b WHERE a.vec_id % 20 = 0 AND b.label >= 100), top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, memory) AS rank FROM sim) SELECT query, memory, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM top WHERE rank <= 4")
def vector_store(spark, sf_dir):
    """Insert over existing ids, delete, then a search behind a filter, through the store interface."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    store = stores.VectorStore(e).insert(e.filter("id % 3 = 0").withColumn("label", F.col("label") + 100)).delete(e.filter("id % 7 = 0").select("id"))
    q = e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return store.search(q, 4, {"label": {"gte": 100}}).select("query", "memory", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@R.query("vector_store_list", "SELECT vec_id AS id, label FROM embeddings WHERE label = 2 ORDER BY vec_id LIMIT 7")
def vector_store_list(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return stores.VectorStore(e).list({"label": 2}, 7).select("id", "label")


@R.query("memory_cap", "SELECT event_id, event_type FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= CASE event_type WHEN 'click' THEN 40 WHEN 'view' THEN 25 WHEN 'error' THEN 5 ELSE 1000000000 END")
def memory_cap(spark, sf_dir):
    """The newest rows of each kind up to its cap; the others are removed."""
    return stores.capped(read(spark, sf_dir, "events"), "event_type", {"click": 40, "view": 25, "error": 5}, F.col("ts"), "event_id").select("event_id", "event_type")


ACTED = "f AS (SELECT event_id, user_id, value >= 50 AS success, value FROM events), best AS (SELECT user_id, arg_max(event_id, (value, event_id)) AS target FROM events WHERE value < 50 GROUP BY user_id)"


@R.query("update_strategy", "WITH " + ACTED + " SELECT f.event_id AS id, 'ADD' AS action, CAST(1.0 AS DOUBLE) AS confidence FROM f WHERE success UNION ALL SELECT f.event_id + 10000000, 'ADD', 0.5 FROM f JOIN best USING (user_id) WHERE NOT success AND f.event_id = target UNION ALL SELECT target, 'APPEND', CAST(count(*) AS DOUBLE) FROM f JOIN best USING (user_id) WHERE NOT success AND f.event_id <> target GROUP BY target")
def update_strategy(spark, sf_dir):
    """The adjusting strategy: success adds a row; failure adds a reflection at half the confidence where it is the
    best related row itself, and else is appended to that row (how often, here as the confidence)."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    failed = rows.filter("value < 50")
    best = failed.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("target"))
    act = failed.join(best, "user_id").withColumn("own", F.col("event_id") == F.col("target"))
    added = rows.filter("value >= 50").select(F.col("event_id").alias("id"), F.lit("ADD").alias("action"), F.lit(1.0).alias("confidence"))
    reflected = act.filter("own").select((F.col("event_id") + 10_000_000).alias("id"), F.lit("ADD").alias("action"), F.lit(0.5).alias("confidence"))
    appended = act.filter("NOT own").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("confidence")).select("id", F.lit("APPEND").alias("action"), "confidence")
    return added.unionByName(reflected).unionByName(appended)


@R.query("lineage_join", "WITH m AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 's' || (event_id % 600) END AS sid, CASE event_id % 3 WHEN 1 THEN event_type || ':' || user_id END AS body, CASE event_id % 3 WHEN 2 THEN 's' || (event_id * 7 % 900) END AS mark FROM events), t AS (SELECT event_type || ':' || user_id AS body, min(event_id) AS first_id FROM events GROUP BY 1) SELECT m.event_id, coalesce('s' || a.event_id, 's' || t.first_id, 's' || c.event_id) AS session_id FROM m LEFT JOIN events a ON 's' || a.event_id = m.sid LEFT JOIN t ON t.body = m.body LEFT JOIN events c ON 's' || c.event_id = m.mark")
def lineage_join(spark, sf_dir):
    """A memory's session by its id, else by its exact text (the first such session), else by the marker in it."""
    rows = read(spark, sf_dir, "events")
    body, kind = F.concat("event_type", F.lit(":"), "user_id"), F.col("event_id") % 3
    memories = rows.select("event_id", F.when(kind == 0, F.concat(F.lit("s"), F.col("event_id") % 600)).alias("sid"), F.when(kind == 1, body).alias("body"), F.when(kind == 2, F.concat(F.lit("see [session:s"), F.col("event_id") * 7 % 900, F.lit("] for it"))).alias("said"))
    named = rows.select(F.concat(F.lit("s"), "event_id").alias("session_id"))
    by_text = rows.groupBy(body.alias("of_body")).agg(F.concat(F.lit("s"), F.min("event_id")).alias("text_id"))
    by_id, by_mark = named.select(F.col("session_id").alias("own_id")), named.select(F.col("session_id").alias("mark_id"))
    found = memories.join(by_id, F.col("sid") == F.col("own_id"), "left").join(by_text, F.col("body") == F.col("of_body"), "left").join(by_mark, F.get(texts.session_ids(F.col("said")), F.lit(0)) == F.col("mark_id"), "left")
    return found.select("event_id", F.coalesce("own_id", "text_id", "mark_id").alias("session_id"))


@R.query("graph_path", "WITH RECURSIVE edges AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem), walk(id, node, path, steps) AS (SELECT 'c' || c_custkey, 'c' || c_custkey, ['c' || c_custkey], 0 FROM customer WHERE c_custkey % 20 = 0 UNION ALL SELECT w.id, e.dst, list_append(w.path, e.dst), w.steps + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.steps < 2 AND NOT list_contains(w.path, e.dst)) SELECT id, node, array_to_string(path, '>') AS path FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id, node ORDER BY steps, array_to_string(path, '>')) AS k FROM walk) x WHERE k = 1")
def graph_path(spark, sf_dir):
    """Shortest paths of at most two steps from every twentieth customer over orders to parts, with the nodes on the way."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    name = lambda letter, c: F.concat(F.lit(letter), c)
    edges = orders.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")).union(lines.select(name("o", "l_orderkey"), name("p", "l_partkey"))).distinct()
    starts = read(spark, sf_dir, "customer").filter("c_custkey % 20 = 0").select(name("c", "c_custkey").alias("id"))
    return graph.paths(edges, starts, 2).select("id", "node", F.array_join("path", ">").alias("path"))


STATE = "c AS (SELECT conv_id, turn, role, CAST(length(coalesce(text, '')) // 3 AS BIGINT) AS w, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)"


@R.query("sensory_buffer", "WITH RECURSIVE " + STATE + ", s AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS segment FROM conversations GROUP BY conv_id UNION ALL SELECT c.conv_id, c.k, CASE WHEN s.used >= 64 AND c.role = 'user' THEN c.w ELSE s.used + c.w END, CASE WHEN s.used >= 64 AND c.role = 'user' THEN s.segment + 1 ELSE s.segment END FROM s JOIN c ON c.conv_id = s.conv_id AND c.k = s.k + 1) SELECT s.conv_id, c.turn, s.segment FROM s JOIN c ON c.conv_id = s.conv_id AND c.k = s.k")
def sensory_buffer(spark, sf_dir):
    """Turns gather until they weigh 64 tokens; the next user turn opens a new segment."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.floor(F.length(F.coalesce("text", F.lit(""))) / 3.0).cast("long").alias("w"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("turn")
        segment = memory.segments_by_weight(group["w"].tolist(), 64, (group["role"] == "user").tolist())
        return pd.DataFrame({"conv_id": group["conv_id"].to_numpy(), "turn": group["turn"].to_numpy(), "segment": segment})

    kinds = dict(rows.dtypes)
    return rows.groupBy("conv_id").applyInPandas(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, segment long")


@R.query("compact_chunks", "WITH RECURSIVE " + STATE + ", s AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used FROM conversations GROUP BY conv_id UNION ALL SELECT c.conv_id, c.k, CASE WHEN s.n > 0 AND s.used + c.w > 100 THEN s.chunk + 1 ELSE s.chunk END, CASE WHEN s.n > 0 AND s.used + c.w > 100 THEN 1 ELSE s.n + 1 END, CASE WHEN s.n > 0 AND s.used + c.w > 100 THEN c.w ELSE s.used + c.w END FROM s JOIN c ON c.conv_id = s.conv_id AND c.k = s.k + 1) SELECT conv_id, chunk, max(n) AS n_items, least(max(used), 100) AS cost, max(used) > 100 AS bounded FROM s WHERE k > 0 GROUP BY conv_id, chunk")
def compact_chunks(spark, sf_dir):
    """Evicted sessions packed to an input budget; one that is too large by itself goes through bounded."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("user_id"), F.col("turn").alias("ord"), F.floor(F.length(F.coalesce("text", F.lit(""))) / 3.0).cast("long").alias("cost"))
    packed = memory.short_buffer(rows, 100)
    return packed.select(F.col("user_id").alias("conv_id"), F.col("batch").alias("chunk"), "n_items", F.least("cost", F.lit(100).cast("long")).alias("cost"), (F.col("cost") > 100).alias("bounded"))


@R.query("online_compaction")
def online_compaction(spark, sf_dir):
    """A summary (here of stand-in lines) and the recent sessions of each user within a budget; tested against its rule in Python."""
    rows = history.lifelines(spark, sf_dir).select("user_id", "session_index", F.concat_ws(" ", "session_id", "domain", "props").alias("text"))
    return memory.compacted(rows, 60)


@R.query("retrieval_mode", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'none' WHEN 3 THEN 'ranked' ELSE 'context' END AS mode, CASE WHEN event_id % 2 = 0 THEN greatest(0, CAST(floor(value) AS BIGINT) - 20) ELSE 3 END AS n_reported FROM events")
def retrieval_mode(spark, sf_dir):
    """How a method is scored, and how many items it reports: a debug field, not below 0, else the ids it returned."""
    method = F.element_at(F.array(*map(F.lit, ("no_memory", "full_memory", "full_history", "mem"))), (F.col("event_id") % 4 + 1).cast("int"))
    debug = F.when(F.col("event_id") % 2 == 0, F.floor("value") - 20).cast("string")
    reported = F.coalesce(F.lit("many").try_cast("long"), debug.try_cast("long"))
    ids = F.array(*map(F.lit, "abc"))
    mode = F.when(method == "no_memory", "none").when(method.isin("full_memory", "full_history"), "context").otherwise("ranked")
    return read(spark, sf_dir, "events").select("event_id", mode.alias("mode"), F.coalesce(F.when(reported.isNotNull(), F.greatest(F.lit(0).cast("long"), reported)), F.size(ids).cast("long")).alias("n_reported"))


@R.query("nonbinding_exposure", "WITH " + history.SETS + " SELECT n.probe_id, round(count(r.session_id) / CAST(count(*) AS DOUBLE), 6) AS exposure FROM non n JOIN (SELECT DISTINCT probe_id FROM pos) p ON p.probe_id = n.probe_id LEFT JOIN raw r ON r.probe_id = n.probe_id AND r.session_id = n.session_id GROUP BY n.probe_id")
def nonbinding_exposure(spark, sf_dir):
    """Share of the nonbinding sessions that a context shows."""
    df = history.scored_input(spark, sf_dir).filter(F.size("nonbinding") > 0)
    return df.select("probe_id", F.round(F.size(F.array_intersect("nonbinding", "ranked")) / F.size("nonbinding"), 6).alias("exposure"))


@R.query("tokenize_simple", "SELECT doc_id, md5(array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'for')), ' ')) AS tokens_md5 FROM documents")
def tokenize_simple(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(texts.tokenize_simple(F.col("text"), ("the", "and", "for")), " ").cast("binary")).alias("tokens_md5"))


@R.query("chunk_sentence", "WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\x0B]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents) SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, '|')) AS sentences_md5 FROM s")
def chunk_sentence(spark, sf_dir):
    s = texts.sentences(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|").cast("binary")).alias("sentences_md5"))


@R.query("split_long_message", "SELECT conv_id, turn, role, b // 60 AS part, substr(text, b + 1, 60) AS piece FROM (SELECT conv_id, turn, role, text, unnest(range(0, CAST(length(text) AS BIGINT), 60)) AS b FROM conversations) x")
def split_long_message(spark, sf_dir):
    """Messages above 20 tokens in parts of the same role."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(texts.chunk_windows(F.col("text"), 20, 0)).alias("part", "piece"))
    return rows.withColumn("part", F.col("part").cast("long"))


@R.query("tz_convert", "SELECT event_id, ts + INTERVAL 9 HOUR AS tokyo FROM events")
def tz_convert(spark, sf_dir):
    """Times without a zone are UTC."""
    return read(spark, sf_dir, "events").select("event_id", F.convert_timezone(F.lit("UTC"), F.lit("Asia/Tokyo"), F.col("ts").cast("timestamp_ntz")).alias("tokyo"))


@R.query("digest", "SELECT event_id, sha256('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS digest FROM events")
def digest(spark, sf_dir):
    """SHA-256 of a payload as JSON with sorted keys."""
    return read(spark, sf_dir, "events").select("event_id", F.sha2(F.to_json(F.struct("event_id", "event_type", "user_id")).cast("binary"), 256).alias("digest"))


@R.query("render_bounded", "SELECT conv_id, '## assistant' || chr(10) || '- ' || substr(max(text) FILTER (WHERE turn = a), 1, 30) || ' [session:' || conv_id || ']' AS said FROM (SELECT *, min(turn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS a FROM conversations) x WHERE a IS NOT NULL GROUP BY conv_id")
def render_bounded(spark, sf_dir):
    """One fact of a section, cut to 30 characters, with at most one id."""
    fact = F.struct("turn", F.col("role").alias("section"), "text", F.array(F.col("conv_id").cast("string"), F.lit("more")).alias("ids"))
    rows = read(spark, sf_dir, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.sort_array(F.collect_list(fact)).alias("facts"))
    return rows.select("conv_id", texts.render_bounded(F.col("facts"), 1, 30, 1).alias("said"))


@R.query("build_prompt", "SELECT item_id, 'MEMORY' || chr(10) || 'm' || item_id || chr(10) || chr(10) || 'QUESTION' || chr(10) || text || chr(10) || chr(10) || 'CHOICES' || chr(10) || 'A. yes' || chr(10) || 'B. no' || CASE WHEN item_id % 2 = 0 THEN chr(10) || chr(10) || 'Reply with JSON.' ELSE '' END AS prompt FROM benchmark")
def build_prompt(spark, sf_dir):
    choices = F.array(*(F.struct(F.lit(c).alias("choice_id"), F.lit(t).alias("text")) for c, t in (("A", "yes"), ("B", "no"))))
    task = F.when(F.col("item_id") % 2 == 0, F.lit("Reply with JSON."))
    return read(spark, sf_dir, "benchmark").select("item_id", texts.build_prompt(F.concat(F.lit("m"), "item_id"), F.col("text"), choices, task).alias("prompt"))


@R.query("retrieve_concat", "WITH " + PAIRS.format(more=" AND a.vec_id <> b.vec_id") + ", " + TOP + " SELECT t.query, string_agg(d.source || ':' || d.doc_id, '; ' ORDER BY t.rank) AS context, CAST(sum(d.n_chars // 3) AS BIGINT) AS tokens, count(*) AS exchanges FROM top t JOIN documents d ON d.doc_id = t.memory WHERE t.rank <= 4 GROUP BY t.query")
def retrieve_concat(spark, sf_dir):
    """Contents of the hits in rank order, with totals of tokens and exchanges."""
    q, m = asked(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws(":", "source", "doc_id").alias("said"), F.floor(F.col("n_chars") / 3).cast("long").alias("n"))
    hits = vectors.topk(q, m, 4, exclude_self=True).join(docs, F.col("memory") == F.col("doc_id"))
    grouped = hits.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "said"))).alias("c"), F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("exchanges"))
    return grouped.select("query", F.array_join(F.transform("c", lambda x: x["said"]), "; ").alias("context"), "tokens", "exchanges")


@R.query("store_string_match", "SELECT store, id FROM (SELECT store, id, ROW_NUMBER() OVER (PARTITION BY store ORDER BY id) AS k FROM (SELECT 'semantic' AS store, p_partkey AS id, p_name AS field FROM part UNION ALL SELECT 'resource', doc_id, text FROM documents UNION ALL SELECT 'knowledge_vault', c_custkey, c_mktsegment FROM customer) a WHERE lower(field) LIKE '%ring%') b WHERE k <= 10")
def store_string_match(spark, sf_dir):
    """Substring search without case over the default fields of three typed stores, ten hits each."""
    stores_ = (("semantic", "part", "p_partkey", "p_name"), ("resource", "documents", "doc_id", "text"), ("knowledge_vault", "customer", "c_custkey", "c_mktsegment"))
    found = None
    for name, table, key, field in stores_:
        part = read(spark, sf_dir, table).filter(F.contains(F.lower(field), F.lit("ring"))).select(F.lit(name).alias("store"), F.col(key).alias("id")).orderBy("id").limit(10)
        found = part if found is None else found.unionByName(part)
    return found


@R.query("store_raw_list", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND (ts, event_id) < (SELECT (ts, event_id) FROM events WHERE event_id = 400) ORDER BY ts DESC, event_id DESC LIMIT 20")
def store_raw_list(spark, sf_dir):
    """The raw store: a filter, newest first, behind a cursor."""
    rows = read(spark, sf_dir, "events")
    at = rows.filter("event_id = 400").select(F.struct("ts", "event_id").alias("at"))
    before = rows.filter(F.col("event_type").isin("click", "view")).crossJoin(F.broadcast(at)).filter(F.struct("ts", "event_id") < F.col("at"))  # one row
    return before.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(20).select("event_id")


@R.query("store_episodic_filtered", "SELECT user_id, event_id FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'error') x WHERE k <= 2")
def store_episodic_filtered(spark, sf_dir):
    """The newest episodic events of a kind for each user."""
    rows = read(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("ts", "event_id")), False), 1, 2).alias("x"))
    return rows.select("user_id", F.explode("x").alias("x")).select("user_id", "x.event_id")


@R.query("store_knowledge_sensitivity", "SELECT c_custkey, 0.0 + round(1.0 * len(list_filter(['build', 'ing'], lambda t: contains(lower(c_mktsegment), t))) / 2, 4) AS score FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 5 = 0")
def store_knowledge_sensitivity(spark, sf_dir):
    """The vault honours its sensitivity filter before it scores."""
    rows = read(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & (F.col("c_custkey") % 5 == 0))
    terms = F.array(F.lit("build"), F.lit("ing"))
    return rows.select("c_custkey", F.round(F.size(F.filter(terms, lambda t: F.contains(F.lower("c_mktsegment"), t))) / 2.0, 4).alias("score"))


@R.query("note_evolution", "WITH " + PAIRS.format(more=" AND b.vec_id < a.vec_id").replace("a.vec_id % 20 = 0", "a.vec_id % 5 = 0") + ", " + TOP + ", l AS (SELECT t.memory AS id, e.label AS tag FROM top t JOIN embeddings e ON e.vec_id = t.query WHERE t.rank <= 3 AND t.score >= 0.3) SELECT e.vec_id, array_to_string(list_sort(list_distinct(list_append(coalesce(x.tags, []), e.label))), ',') AS tags FROM embeddings e LEFT JOIN (SELECT id, list(tag) AS tags FROM l GROUP BY id) x ON x.id = e.vec_id")
def note_evolution(spark, sf_dir):
    """A new note (every fifth) hands its tag to its three nearest earlier notes."""
    e = read(spark, sf_dir, "embeddings")
    new = e.filter("vec_id % 5 = 0")
    near = vectors.topk(new, e, 3, "vec_id", "vec_id", exclude_self=True, not_later=True).filter("score >= 0.3")
    tags = near.join(new.select(F.col("vec_id").alias("of"), "label"), F.col("query") == F.col("of")).groupBy("memory").agg(F.collect_set("label").alias("more"))
    both = F.array_sort(F.array_distinct(F.concat(F.array("label"), F.coalesce("more", F.array().cast("array<int>")))))
    return e.join(tags, F.col("vec_id") == F.col("memory"), "left").select("vec_id", F.array_join(F.transform(both, lambda x: x.cast("string")), ",").alias("tags"))


@R.query("search_pipeline", BM25 + ", " + DENSE + ", paths AS (SELECT query, doc AS id, rank FROM r WHERE rank <= 10 UNION ALL SELECT query, id, rank FROM dr WHERE rank <= 10), f AS (SELECT query, id, sum(1.0 / (60 + rank)) AS s FROM paths GROUP BY query, id), same_text AS (SELECT query, id, s, ROW_NUMBER() OVER (PARTITION BY query, d.text ORDER BY round(s, 8) DESC, id) AS same FROM f JOIN documents d ON d.doc_id = f.id), k AS (SELECT query, id, ROW_NUMBER() OVER (PARTITION BY query ORDER BY round(s, 8) DESC, id) AS rank FROM same_text WHERE same = 1) SELECT query, id, CAST(rank AS BIGINT) AS rank FROM k WHERE rank <= 4")
def search_pipeline(spark, sf_dir):
    """Paths, fusion, one hit for each text, sort and trim."""
    hits = stores.fuse(list(both_ways(spark, sf_dir, 10)), 20).join(read(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("h")), F.col("id") == F.col("doc_id"))
    order = [F.col("score").desc(), F.col("id")]
    one = hits.withColumn("same", F.row_number().over(Window.partitionBy("query", "h").orderBy(*order))).filter("same = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)).cast("long")).filter("rank <= 4").select("query", "id", "rank")
