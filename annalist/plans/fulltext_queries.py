"""Boolean full text, with every twentieth benchmark item as a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import fulltext
from annalist.registry import Registry, read

R = Registry()
#: Words of the asking items; words of the documents by field with the weight of the field's label.
ASKED = "q AS (SELECT item_id AS query, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark WHERE item_id % 20 = 0)"
FIELDS = "f AS (SELECT doc_id AS doc, 0.1 AS weight, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents UNION ALL SELECT doc_id, 1.0, regexp_extract_all(lower(source), '[a-z0-9]+') FROM documents UNION ALL SELECT doc_id, 0.4, regexp_extract_all(lower(lang), '[a-z0-9]+') FROM documents)"
PLACES = ", r AS (SELECT query, doc, round(rank, 6) AS rank FROM s), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY rank DESC, doc) AS INTEGER) AS place FROM r) SELECT query, doc, rank, place FROM p WHERE place <= 10"


def asked(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").filter("item_id % 20 = 0")
    return items.select(F.col("item_id").alias("query"), fulltext.words(F.col("text")).alias("w"))


def documents(spark, sf_dir):
    return fulltext.postings(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), "doc_id", {"text": "D", "source": "A", "lang": "B"})


@R.query("fulltext_or", f"WITH {ASKED}, {FIELDS}, t AS (SELECT query, unnest(list_distinct(w)) AS term FROM q), d AS (SELECT doc, weight, term, count(*) AS tf FROM (SELECT doc, weight, unnest(w) AS term FROM f) GROUP BY ALL), s AS (SELECT query, doc, sum(weight * tf / (tf + 1)) AS rank FROM t JOIN d USING (term) GROUP BY query, doc)" + PLACES)
def fulltext_or(spark, sf_dir):
    """Documents that hold any word of the item, the ten best."""
    words = asked(spark, sf_dir).select("query", F.posexplode(F.array_distinct("w")).alias("leaf", "word"))
    queries = words.select("query", F.lit(0).alias("clause"), "leaf", F.lit(False).alias("negated"), F.array("word").alias("words"), F.lit(False).alias("prefix"))
    return fulltext.search(queries, documents(spark, sf_dir), 10)


@R.query("keyword_match", f"""WITH {ASKED}, {FIELDS},
h AS (SELECT query, doc, weight, CAST(len(list_filter(range(1, len(f.w)), lambda i: f.w[i] = q.w[1] AND f.w[i + 1] = q.w[2])) AS DOUBLE) AS n1, CAST(len(list_filter(f.w, lambda x: x = q.w[3])) AS DOUBLE) AS n2, CAST(len(list_filter(f.w, lambda x: x = q.w[4])) AS DOUBLE) AS n3, CAST(len(list_filter(f.w, lambda x: x = q.w[5])) AS DOUBLE) AS n4 FROM f, q WHERE len(q.w) >= 5),
s AS (SELECT query, doc, sum(weight * (n1 / (n1 + 1) + n2 / (n2 + 1) + n3 / (n3 + 1))) AS rank FROM h GROUP BY query, doc HAVING sum(n1) + sum(n2) > 0 AND sum(n2) + sum(n3) > 0 AND (sum(n4) = 0 OR sum(n1) > 0))""" + PLACES)
def keyword_match(spark, sf_dir):
    """(first two words as a phrase OR the third) AND (third OR fourth) AND (NOT the fifth OR the phrase)."""
    items = asked(spark, sf_dir).filter(F.size("w") >= 5)
    w = F.col("w")
    leaf = lambda clause, n, no, *words: F.struct(F.lit(clause).alias("clause"), F.lit(n).alias("leaf"), F.lit(no).alias("negated"), F.array(*words).alias("words"), F.lit(False).alias("prefix"))
    form = F.array(leaf(0, 0, False, w[0], w[1]), leaf(0, 1, False, w[2]), leaf(1, 1, False, w[2]), leaf(1, 2, False, w[3]), leaf(2, 3, True, w[4]), leaf(2, 0, False, w[0], w[1]))
    return fulltext.search(items.select("query", F.explode(form).alias("x")).select("query", "x.*"), documents(spark, sf_dir), 10)


@R.query("procedural_search", """WITH q AS (SELECT item_id AS query, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1)[1:3]) AS w FROM benchmark WHERE item_id % 20 = 0), f AS (SELECT conv_id AS doc, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations),
t AS (SELECT query, len(w) AS n, generate_subscripts(w, 1) AS leaf, unnest(w) AS word FROM q WHERE len(w) > 0),
h AS (SELECT query, n, leaf, doc, count(*) AS tf FROM t JOIN (SELECT doc, unnest(w) AS term FROM f) d ON d.term = t.word OR length(t.word) >= 3 AND starts_with(d.term, t.word) GROUP BY ALL),
b AS (SELECT query, doc, count(*) = any_value(n) AS whole, sum(0.2 * tf / (tf + 1)) AS rank FROM h GROUP BY query, doc), m AS (SELECT query, bool_or(whole) AS any_whole FROM b GROUP BY query), s AS (SELECT query, doc, rank FROM b JOIN m USING (query) WHERE whole OR NOT any_whole)""" + PLACES)
def procedural_search(spark, sf_dir):
    """Conversations as procedures, their turns as steps: those whose steps hold words that begin with all of the item's first three, or else with any."""
    steps = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("steps"))
    index = fulltext.postings(steps, "conv_id", {"steps": "C"})
    short = F.array_distinct(F.slice(F.filter("w", lambda x: F.length(x) > 1), 1, 3))
    words = asked(spark, sf_dir).select("query", F.posexplode(short).alias("leaf", "word"))
    queries = words.select("query", F.col("leaf").alias("clause"), "leaf", F.lit(False).alias("negated"), F.array("word").alias("words"), F.lit(True).alias("prefix"))
    return fulltext.all_else_any(queries, index, 10)
