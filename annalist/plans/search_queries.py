"""Queries of vector and keyword search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.operators import dedup, text, vectors
from annalist.registry import Registry, read

R = Registry()
DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
COS = "round(" + DOT.format(a="a.embedding", b="b.embedding") + " / (sqrt(" + DOT.format(a="a.embedding", b="a.embedding") + ") * sqrt(" + DOT.format(a="b.embedding", b="b.embedding") + ")), {d})"
PAIRS = "sim AS (SELECT a.vec_id AS query, b.vec_id AS memory, " + COS.format(d=9) + " AS score, b.label FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0{more})"
TOP = "top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, memory) AS rank FROM sim)"


def asked(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.withColumnRenamed("vec_id", "memory_id")


def shown(df):
    return df.select("query", "memory", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


SHOW = "SELECT query, memory, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM top"


@R.query("vector_topk", "WITH " + PAIRS.format(more=" AND a.vec_id <> b.vec_id") + ", " + TOP + " " + SHOW + " WHERE rank <= 5")
def vector_topk(spark, sf_dir):
    q, m = asked(spark, sf_dir)
    return shown(vectors.topk(q, m, 5, exclude_self=True))


@R.query("vector_range", "WITH " + PAIRS.format(more="") + ", " + TOP + " " + SHOW + " WHERE score >= 0.5 AND rank <= 10")
def vector_range(spark, sf_dir):
    q, m = asked(spark, sf_dir)
    return shown(vectors.topk(q, m, 10, threshold=0.5))


@R.query("vector_range_after_cut", "WITH " + PAIRS.format(more="") + ", " + TOP + ", cut AS (SELECT * FROM top WHERE rank <= 10) SELECT query, memory, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM cut WHERE 1 - score < 0.6")
def vector_range_after_cut(spark, sf_dir):
    q, m = asked(spark, sf_dir)
    return shown(vectors.topk(q, m, 10).filter(1 - F.col("score") < 0.6))


@R.query("payload_filter_topk", "WITH " + PAIRS.format(more=" AND b.label IN (1, 3)") + ", " + TOP + " " + SHOW + " WHERE rank <= 5")
def payload_filter_topk(spark, sf_dir):
    """The filter comes before the cut."""
    q, m = asked(spark, sf_dir)
    return shown(vectors.topk(q, m.filter(F.col("label").isin(1, 3)), 5))


@R.query("vector_asof_topk", "WITH " + PAIRS.format(more=" AND b.vec_id <= a.vec_id") + ", " + TOP + ", kept AS (SELECT query, memory, score, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, memory) AS rank FROM top WHERE rank <= 20 AND memory <> query) SELECT query, memory, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM kept WHERE rank <= 10")
def vector_asof_topk(spark, sf_dir):
    """Neighbours that are not later: the twenty best, without the row itself, then the ten best of those."""
    q, m = asked(spark, sf_dir)
    best = vectors.topk(q, m, 20, not_later=True).filter("memory <> query")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "memory")
    return shown(best.withColumn("rank", F.row_number().over(order)).filter("rank <= 10"))


@R.query("topk_per_type", "WITH " + PAIRS.format(more=" AND b.label < 4") + ", t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query, label ORDER BY score DESC, memory) AS r FROM sim) SELECT query, CAST(label AS INT) AS label, memory, CAST(r AS BIGINT) AS rank FROM t WHERE r <= CASE label WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END")
def topk_per_type(spark, sf_dir):
    q, m = asked(spark, sf_dir)
    found = None
    for label, k in ((0, 1), (1, 2), (2, 3), (3, 3)):
        part = vectors.topk(q, m.filter(F.col("label") == label), k).select("query", F.lit(label).alias("label"), "memory", F.col("rank").cast("long").alias("rank"))
        found = part if found is None else found.unionByName(part)
    return found


@R.query("reverse_candidates", "WITH " + PAIRS.format(more=" AND a.vec_id <> b.vec_id") + ", " + TOP + " SELECT memory, query, round(score, 6) AS score FROM top WHERE rank <= 10 AND score >= 0.3")
def reverse_candidates(spark, sf_dir):
    q, m = asked(spark, sf_dir)
    queue = vectors.topk(q, m, 10, exclude_self=True).groupBy("query").agg(F.collect_list(F.struct("memory", "score")).alias("queue"))
    return queue.select("query", F.explode("queue").alias("x")).filter("x.score >= 0.3").select("x.memory", "query", F.round("x.score", 6).alias("score"))


@R.query("cosine_1_to_n", "WITH " + PAIRS.format(more=" AND a.vec_id = 0") + " SELECT memory, round(score, 6) AS score FROM sim")
def cosine_1_to_n(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    one = e.filter("vec_id = 0").select(F.col("embedding").alias("qv"))
    return e.crossJoin(F.broadcast(one)).select(F.col("vec_id").alias("memory"), F.round(vectors.cosine(F.col("qv"), F.col("embedding")), 6).alias("score"))  # one query


@R.query("centroid", "WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings) SELECT label, pos - 1 AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM x GROUP BY 1, 2")
def centroid(spark, sf_dir):
    return vectors.centroid(read(spark, sf_dir, "embeddings"), "label").select("label", F.posexplode("centroid").alias("pos", "v")).select("label", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("x"))


@R.query("topk_backfill", "WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS score, p_brand FROM part), r AS (SELECT p_brand, p_partkey, coalesce(score, -1.0) AS score, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY coalesce(score, -1.0) DESC, p_partkey) AS k FROM s) SELECT p_brand, p_partkey, score FROM r WHERE k <= 40")
def topk_backfill(spark, sf_dir):
    score = F.coalesce(F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice")), F.lit(-1.0))
    rows = read(spark, sf_dir, "part").select("p_brand", "p_partkey", score.alias("score"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("score").desc(), "p_partkey"))).filter("k <= 40").drop("k")


TOKENS = "w AS (SELECT {id} AS doc, list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda x: length(x) >= 2) AS w FROM {table})"
BM25 = (
    "WITH " + TOKENS.format(id="doc_id", text="text", table="documents") + """, t AS (SELECT doc, len(w) AS len, unnest(w) AS term FROM w), tf AS (SELECT doc, len, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
d AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS i FROM tf, n GROUP BY term, n), m AS (SELECT avg(i) AS m FROM d), idf AS (SELECT term, CASE WHEN i < 0 THEN 0.25 * m ELSE i END AS idf FROM d, m),
q AS (SELECT item_id AS query, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 2)) AS term FROM benchmark), qt AS (SELECT query, term, count(*) AS qtf FROM q GROUP BY ALL),
s AS (SELECT query, doc, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM tf JOIN qt USING (term) JOIN idf USING (term), n GROUP BY query, doc),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s)"""
)


@R.query("bm25_okapi", BM25 + " SELECT query, doc, round(score, 3) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5")
def bm25_okapi(spark, sf_dir):
    found = text.bm25(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), 5, "item_id", "text", "doc_id", "text")
    return found.select("query", "doc", F.round("score", 3).alias("score"), F.col("rank").cast("long").alias("rank"))


@R.query("hybrid_rank", BM25 + ", b AS (SELECT query, doc, rank FROM r WHERE rank <= 10), v AS (SELECT query, doc, ROW_NUMBER() OVER (PARTITION BY query ORDER BY abs(length(text) - query * 10), doc_id) AS rank FROM b JOIN documents d ON d.doc_id = b.doc) SELECT b.query, b.doc, round(1.0 / (60 + b.rank) + 1.0 / (60 + v.rank), 8) AS score FROM b JOIN v ON v.query = b.query AND v.doc = b.doc")
def hybrid_rank(spark, sf_dir):
    """Two rankings of the same candidates fused by reciprocal ranks."""
    docs = read(spark, sf_dir, "documents")
    first = text.bm25(read(spark, sf_dir, "benchmark"), docs, 10, "item_id", "text", "doc_id", "text")
    lengths = docs.select("doc_id", F.length("text").alias("length"))  # no text is dealt out
    both = first.join(lengths, F.col("doc") == F.col("doc_id")).withColumn("other", F.row_number().over(Window.partitionBy("query").orderBy(F.abs(F.col("length") - F.col("query") * 10), "doc_id")))
    return both.select("query", "doc", F.round(1.0 / (60 + F.col("rank")) + 1.0 / (60 + F.col("other")), 8).alias("score"))


@R.query("tag_overlap_topk", "WITH t AS (SELECT DISTINCT l_orderkey AS o, l_partkey % 50 AS tag FROM lineitem), p AS (SELECT a.o AS a, b.o AS b, count(*) AS n FROM t a JOIN t b ON a.tag = b.tag AND a.o <> b.o WHERE a.o % 20 = 0 GROUP BY 1, 2 HAVING count(*) >= 2) SELECT a, b, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM p) x WHERE k <= 5")
def tag_overlap_topk(spark, sf_dir):
    tags = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_partkey") % 50).alias("tag"))
    return vectors.overlap_topk(tags.filter("o % 20 = 0"), tags, "o", "tag", 5, 2)


#: Of pairs p (a < b): which documents stay, decided one by one in the order of ids.
FIRST_WINS = """n2 AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT a AS id FROM p UNION SELECT b FROM p)), nb AS (SELECT b AS id, list(a) AS earlier FROM p GROUP BY b),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS stay UNION ALL SELECT n2.k, CASE WHEN nb.earlier IS NOT NULL AND list_has_any(walk.stay, nb.earlier) THEN walk.stay ELSE list_append(walk.stay, n2.id) END FROM walk JOIN n2 ON n2.k = walk.k + 1 LEFT JOIN nb ON nb.id = n2.id),
fin AS (SELECT stay FROM walk ORDER BY k DESC LIMIT 1) SELECT d.doc_id, n2.id IS NULL OR list_contains(fin.stay, n2.id) AS kept FROM documents d CROSS JOIN fin LEFT JOIN n2 ON n2.id = d.doc_id"""  # fmt: skip


@R.query("tfidf_neardup", "WITH RECURSIVE " + TOKENS.format(id="doc_id", text="text", table="documents") + """, t AS (SELECT doc, unnest(w) AS term FROM w), tf AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
d AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term, n), w2 AS (SELECT doc, term, tf * idf AS w FROM tf JOIN d USING (term)), nm AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM w2 GROUP BY doc), u AS (SELECT doc, term, w / norm AS w FROM w2 JOIN nm USING (doc)),
p AS (SELECT a, b FROM (SELECT a.doc AS a, b.doc AS b, round(sum(a.w * b.w), 6) AS score FROM u a JOIN u b ON a.term = b.term AND a.doc < b.doc GROUP BY 1, 2) x WHERE score >= 0.75), """ + FIRST_WINS)  # fmt: skip
def tfidf_neardup(spark, sf_dir):
    """Documents in the order of ids; one that is similar to an earlier kept one is dropped."""
    docs = read(spark, sf_dir, "documents")
    first, copies = dedup.collapsed(docs.select("doc_id", "text"), "doc_id", text.same_tokens(F.col("text"), distinct=False))
    return dedup.kept_first(docs, "doc_id", text.tfidf_pairs(docs, "doc_id", "text", 0.75, first), copies)


@R.query("word_match_count", "SELECT doc_id, CAST(len(list_filter(['the', 'of', 'ed', 'zebra'], lambda q: contains(lower(text), q))) AS BIGINT) AS n FROM documents")
def word_match_count(spark, sf_dir):
    words = F.array(*map(F.lit, ("the", "of", "ed", "zebra")))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(words, lambda q: F.contains(F.lower("text"), q))).cast("long").alias("n"))


R.statement("dedup_topk", "WITH c AS (SELECT l_orderkey, l_partkey, l_discount, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey % 3 END AS task FROM {lineitem}), one AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, coalesce(CAST(task AS VARCHAR(20)), 'id' || l_partkey) ORDER BY l_discount DESC, l_partkey) AS u FROM c) SELECT l_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_partkey) AS k FROM one WHERE u = 1) x WHERE k <= 3")
R.statement("keyword_like", "SELECT doc_id FROM {documents} WHERE text LIKE '%license%' OR text LIKE '%License%'")
R.statement("substring_ci", "SELECT doc_id FROM {documents} WHERE lower(text) LIKE '%' || lower('LICENSED') || '%'")
