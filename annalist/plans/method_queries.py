"""Queries of the remaining store maintenance and method pipelines, composed of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import chunks
from annalist.functions import text as texts
from annalist.operators import clusters, dedup, fuzzy, scoring, text, vectors
from annalist.plans import history
from annalist.plans.search_queries import BM25, FIRST_WINS, PAIRS, TOP, asked
from annalist.registry import Registry, read

R = Registry()


@R.query("merge_target", "WITH " + PAIRS.format(more=" AND a.vec_id <> b.vec_id") + ", " + TOP + " SELECT query, CASE WHEN score >= 0.5 THEN memory END AS target FROM top WHERE rank = 1")
def merge_target(spark, sf_dir):
    q, m = asked(spark, sf_dir)
    return vectors.topk(q, m, 1, exclude_self=True).select("query", F.when(F.col("score") >= 0.5, F.col("memory")).alias("target"))


@R.query("relation_candidates", "WITH " + PAIRS.format(more=" AND a.vec_id <> b.vec_id") + ", " + TOP + " SELECT query, memory FROM top WHERE rank <= 5 AND score > 0.4")
def relation_candidates(spark, sf_dir):
    q, m = asked(spark, sf_dir)
    return vectors.topk(q, m, 5, exclude_self=True).filter("score > 0.4").select("query", "memory")


@R.query("pref_dual_search", "WITH " + PAIRS.format(more="") + ", t AS (SELECT *, label % 2 AS kind, ROW_NUMBER() OVER (PARTITION BY query, label % 2 ORDER BY score DESC, memory) AS k FROM sim) SELECT query, CAST(kind AS INT) AS kind, memory FROM t WHERE k <= 6 AND score >= 0.3")
def pref_dual_search(spark, sf_dir):
    q, m = asked(spark, sf_dir)
    sides = [vectors.topk(q, m.filter(F.col("label") % 2 == k), 6).filter("score >= 0.3").select("query", F.lit(k).alias("kind"), "memory") for k in (0, 1)]
    return sides[0].unionByName(sides[1])


@R.query("triple_bm25", "WITH w AS (SELECT l_orderkey * 10 + l_linenumber AS doc, ['s' || l_suppkey, 'f' || l_returnflag, 'p' || l_partkey] AS w FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_partkey FROM lineitem) d), t AS (SELECT doc, unnest(w) AS term FROM w), tf AS (SELECT doc, 3 AS len, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w), d AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS i FROM tf, n GROUP BY term, n), m AS (SELECT avg(i) AS m FROM d), idf AS (SELECT term, CASE WHEN i < 0 THEN 0.25 * m ELSE i END AS idf FROM d, m), qt AS (SELECT 's' || s_suppkey AS term, s_suppkey AS query FROM supplier WHERE s_suppkey % 20 = 0 UNION ALL SELECT 'fr', s_suppkey FROM supplier WHERE s_suppkey % 20 = 0), s AS (SELECT query, doc, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM (SELECT doc, len, lower(term) AS lt, term, tf FROM tf) f JOIN qt ON qt.term = lt JOIN idf ON lower(idf.term) = lt, n GROUP BY query, doc), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) SELECT query, doc, round(score, 3) AS score FROM r WHERE rank <= 5")
def triple_bm25(spark, sf_dir):
    row = F.concat(F.lit("s"), "l_suppkey", F.lit(" f"), "l_returnflag", F.lit(" p"), "l_partkey")
    items = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc"), row.alias("t"))
    rows = items.groupBy("doc").agg(F.collect_set("t").alias("t"))  # equal rows count once
    q = read(spark, sf_dir, "supplier").filter("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("query"), F.concat(F.lit("s"), "s_suppkey", F.lit(" fR")).alias("qt"))
    return text.bm25(q, rows, 5, "query", "qt", "doc", "t", repeated=True).select("query", "doc", F.round("score", 3).alias("score"))


@R.query("component_hit", "WITH " + history.SETS + ", t AS (SELECT probe_id, session_id FROM raw WHERE k <= 5), p AS (SELECT probe_id, session_id, ROW_NUMBER() OVER (PARTITION BY probe_id ORDER BY session_id) % 2 AS grp FROM pos), g AS (SELECT p.probe_id, grp, max(CASE WHEN t.session_id IS NULL THEN 0 ELSE 1 END) AS partly, min(CASE WHEN t.session_id IS NULL THEN 0 ELSE 1 END) AS whole FROM p LEFT JOIN t ON t.probe_id = p.probe_id AND t.session_id = p.session_id GROUP BY 1, 2) SELECT probe_id, round(avg(partly), 6) AS component_hit, round(avg(whole), 6) AS component_complete, min(whole) = 1 AS complete_chain FROM g GROUP BY probe_id")
def component_hit(spark, sf_dir):
    df = history.scored_input(spark, sf_dir).withColumn("p", F.sort_array("positives"))
    groups = F.filter(F.array(F.filter("p", lambda x, i: i % 2 == 0), F.filter("p", lambda x, i: i % 2 == 1)), lambda g: F.size(g) > 0)
    hit, complete, chain = scoring.component_scores(F.slice("ranked", 1, scoring.DEPTH), groups)
    return df.select("probe_id", F.round(hit, 6).alias("component_hit"), F.round(complete, 6).alias("component_complete"), chain.alias("complete_chain"))


@R.query("array_set_ops", "WITH " + history.SETS + ", t AS (SELECT probe_id, session_id FROM raw WHERE k <= 5) SELECT p.probe_id, count(*) AS n_pos, count(t.session_id) AS n_common, count(*) - count(t.session_id) AS n_missed FROM pos p LEFT JOIN t ON t.probe_id = p.probe_id AND t.session_id = p.session_id GROUP BY p.probe_id")
def array_set_ops(spark, sf_dir):
    df = history.scored_input(spark, sf_dir).withColumn("t", F.slice("ranked", 1, 5))
    size = lambda c: F.size(c).cast("long")
    return df.select("probe_id", size(F.col("positives")).alias("n_pos"), size(F.array_intersect("positives", "t")).alias("n_common"), size(F.array_except("positives", "t")).alias("n_missed"))


R.statement("visible_domains", "WITH " + history.VISIBLE + " SELECT probe_id, domain, count(*) AS n FROM visible GROUP BY probe_id, domain")
R.statement("keyword_path", "WITH q AS (SELECT DISTINCT p_name AS token FROM {part} WHERE p_partkey % 20 = 0), h AS (SELECT p.p_partkey AS id, q.token, p.p_retailprice / 1000 AS score FROM {part} p JOIN q ON p.p_name = q.token), b AS (SELECT id, max(score) AS score FROM h GROUP BY id) SELECT id, score FROM (SELECT id, score, ROW_NUMBER() OVER (ORDER BY score DESC, id) AS k FROM b) x WHERE k <= 20")
R.statement("working_path", "SELECT p_partkey FROM (SELECT p_partkey, ROW_NUMBER() OVER (ORDER BY p_partkey) AS k FROM {part} WHERE p_type = 'ECONOMY') x WHERE k <= 15")
R.statement("preupdate_recall", "SELECT l_partkey AS id FROM {lineitem} WHERE l_discount >= 0.09 UNION SELECT p_partkey FROM {part} WHERE p_name LIKE '%ring%' AND p_size < 5")
R.statement("get_nodes", "SELECT c_custkey, c_name FROM {customer} WHERE c_custkey IN (1, 2, 5, 8, 13)")
R.statement("edge_exists", "SELECT n.n_nationkey, EXISTS (SELECT 1 FROM {supplier} s WHERE s.s_nationkey = n.n_nationkey) AS has_supplier FROM {nation} n")
R.statement("budgeted_context", "WITH d AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS t FROM {documents}) SELECT doc_id, CAST(CASE WHEN t <= 20000 THEN n_chars ELSE 20000 - (t - n_chars) END AS BIGINT) AS shown FROM d WHERE t - n_chars < 20000")


@R.query("random_k", "SELECT p_partkey FROM part ORDER BY md5('42:' || p_partkey), p_partkey LIMIT 10")
def random_k(spark, sf_dir):
    """A uniform sample of ten by a seeded hash of the key, the same for any layout of the table."""
    return read(spark, sf_dir, "part").select("p_partkey").orderBy(F.md5(F.concat(F.lit("42:"), F.col("p_partkey").cast("string")).cast("binary")), "p_partkey").limit(10)


@R.query("minhash_dedup", """WITH RECURSIVE w AS (SELECT doc_id AS doc, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 2)) AS w FROM documents), t AS (SELECT doc, len(w) AS n, unnest(w) AS term FROM w),
c AS (SELECT a.doc AS a, b.doc AS b, count(*) AS c, any_value(a.n + b.n) AS s FROM t a JOIN t b ON a.term = b.term AND a.doc < b.doc GROUP BY 1, 2), p AS (SELECT a, b FROM c WHERE 100 * c >= 60 * (s - c)), """ + FIRST_WINS)
def minhash_dedup(spark, sf_dir):
    """A document is dropped if it is similar (0.6 or more of their tokens) to an earlier kept one; exact, so without the sketch's misses."""
    docs = read(spark, sf_dir, "documents")
    first, copies = dedup.collapsed(docs.select("doc_id", "text"), "doc_id", text.same_tokens(F.col("text"), distinct=True))
    return dedup.kept_first(docs, "doc_id", text.jaccard_pairs(first, "doc_id", "text", 60), copies)


@R.query("fuzzy_partial")
def fuzzy_partial(spark, sf_dir):
    """The five turns most like the name of every twentieth part, each name once."""
    names = read(spark, sf_dir, "part").filter("p_partkey % 20 = 0").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("turn_id"), "text")
    return fuzzy.best_matches(names, turns, 5, "p_partkey", "p_name", "turn_id", "text")


@R.query("chunk_paragraph")
def chunk_paragraph(spark, sf_dir):
    parts = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks.paragraph_chunks(200)(F.col("text"))).alias("pos", "chunk"))
    return parts.select("doc_id", "pos", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@R.query("chunk_separator")
def chunk_separator(spark, sf_dir):
    parts = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks.separator_chunks(600, 60)(F.col("text"))).alias("pos", "chunk"))
    return parts.select("doc_id", "pos", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


MARKED = """m AS (SELECT page_id, string_split(regexp_replace(replace(replace(replace(html, '<h1>', chr(10) || '# '), '<p><b>', chr(10) || '## '), '<p>', chr(10)), '<[^>]*>', '', 'g'), chr(10)) AS lines FROM pages),
l AS (SELECT page_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM m), k AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6}[ \\t]+') THEN length(regexp_extract(line, '^#+')) END AS lvl FROM l),
s AS (SELECT *, count(lvl) OVER (PARTITION BY page_id ORDER BY i) AS sec FROM k), h AS (SELECT page_id, sec, max(lvl) AS lvl, max(CASE WHEN lvl IS NOT NULL THEN regexp_replace(regexp_replace(line, '^#+[ \\t]+', ''), '[ \\t#]*$', '') END) AS head, trim(coalesce(string_agg(CASE WHEN lvl IS NULL THEN line END, chr(10) ORDER BY i), ''), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM s GROUP BY page_id, sec),
o AS (SELECT *, max(CASE WHEN lvl = 1 THEN sec END) OVER w AS one, max(CASE WHEN lvl = 2 THEN sec END) OVER w AS two FROM h WINDOW w AS (PARTITION BY page_id ORDER BY sec)),
p AS (SELECT o.page_id, o.sec, o.body, list_filter([a.head, b.head], lambda x: x IS NOT NULL) AS path FROM o LEFT JOIN h a ON a.page_id = o.page_id AND a.sec = o.one LEFT JOIN h b ON b.page_id = o.page_id AND b.sec = o.two AND (o.one IS NULL OR o.two > o.one))
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY sec) - 1 AS INTEGER) AS pos, array_to_string(path, ' > ') AS path, md5(body) AS body_md5 FROM p WHERE body <> ''"""


@R.query("chunk_markdown", "WITH " + MARKED)
def chunk_markdown(spark, sf_dir):
    """Sections of the pages, whose headings and paragraphs became Markdown, each with the headings above it."""
    text = F.col("html")
    for tag, mark in (("<h1>", "\n# "), ("<p><b>", "\n## "), ("<p>", "\n")):
        text = F.replace(text, F.lit(tag), F.lit(mark))
    parts = read(spark, sf_dir, "pages").select("page_id", F.posexplode(chunks.heading_chunks()(F.regexp_replace(text, "<[^>]*>", ""))).alias("pos", "x"))
    return parts.select("page_id", "pos", F.concat_ws(" > ", "x.path").alias("path"), F.md5(F.col("x.text").cast("binary")).alias("body_md5"))


@R.query("chunk_recursive")
def chunk_recursive(spark, sf_dir):
    parts = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks.recursive_chunks(600)(F.col("text"))).alias("pos", "chunk"))
    return parts.select("doc_id", "pos", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@R.query("chunk_recursive_rules", "SELECT doc_id, md5(text) AS joined_md5, TRUE AS all_fit, TRUE AS none_joinable FROM documents")
def chunk_recursive_rules(spark, sf_dir):
    """Chunks fit, give back the text, and no two neighbours would fit together."""
    parts = read(spark, sf_dir, "documents").select("doc_id", chunks.recursive_chunks(600)(F.col("text")).alias("c"))
    sizes = F.transform("c", lambda x: F.length(x))
    pairs = F.zip_with(F.slice(sizes, 1, F.greatest(F.size("c") - 1, F.lit(0))), F.slice(sizes, 2, F.greatest(F.size("c"), F.lit(1))), lambda a, b: a + b)
    return parts.select("doc_id", F.md5(F.concat_ws("", "c").cast("binary")).alias("joined_md5"), F.forall(sizes, lambda n: n <= 600).alias("all_fit"), F.forall(pairs, lambda n: n > 600).alias("none_joinable"))


@R.query("kmeans_partition")
def kmeans_partition(spark, sf_dir):
    """The clusters of each label's vectors, twenty at most in each; clusters of ten or fewer are left out."""
    return clusters.partition(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select(F.col("grp").alias("label"), F.col("id").alias("vec_id"), "cluster", "n")


@R.query("kmeans_partition_rules", "SELECT label, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_oversized, CAST(0 AS BIGINT) AS n_undersized, CAST(0 AS BIGINT) AS n_nearer_elsewhere, CAST(0 AS BIGINT) AS n_twice, TRUE AS some_kept FROM embeddings GROUP BY label")
def kmeans_partition_rules(spark, sf_dir):
    """What must hold for the partition of any table: sizes, nearness at the last division, and each vector in one cluster."""
    rows = read(spark, sf_dir, "embeddings")
    found = clusters.partition(rows, "label", "vec_id", "embedding")
    count = lambda c: F.count(F.when(c, True))
    made = found.groupBy("grp").agg(count(F.col("n") > 20).alias("n_oversized"), count((F.col("n") <= 10) & (F.col("cluster") != "")).alias("n_undersized"), count(F.col("own") > F.col("other")).alias("n_nearer_elsewhere"), (F.count("*") - F.countDistinct("id")).alias("n_twice"), (F.count("*") > 0).alias("some_kept"))
    return rows.groupBy("label").agg(F.count("*").alias("n_rows")).join(made, F.col("label") == F.col("grp"), "left").drop("grp")


@R.query("reorganize_loop")
def reorganize_loop(spark, sf_dir):
    """Parents over the vectors that no supplier links to another one, by label."""
    edges = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + F.col("s_nationkey")).alias("dst"))
    return clusters.reorganized(read(spark, sf_dir, "embeddings"), edges, "label", "vec_id", "embedding")
