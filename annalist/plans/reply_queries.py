"""Queries of functions that read replies, summaries and records; what they read is made from the tables' own texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import text as texts
from annalist.plans import history
from annalist.registry import Registry, read

R = Registry()
#: A reply's letter, and whether its object is closed, has a second key and uses the other name: all from the text.
SHAPE = "t AS (SELECT doc_id, text, upper(substr(text, 1, 1)) AS letter, length(text) % 3 AS cut, contains(text, chr(10)) AS more FROM documents WHERE text IS NOT NULL)"
CITED = history.SETS + ", cited AS (SELECT probe_id, session_id, 1 AS own FROM pos UNION ALL SELECT probe_id, session_id, 0 FROM tmp), asked AS (SELECT q.* FROM probes q WHERE EXISTS (SELECT 1 FROM pos p WHERE p.probe_id = q.probe_id))"


def replies(spark, sf_dir):
    """doc_id, text, and an object about the text: its first letter as a choice, without the last brace where the length is a multiple of 3."""
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL").withColumn("prose", F.translate("text", "{}", "()"))
    more = F.contains("text", F.lit("\n"))
    key = F.when(F.length("text") % 3 == 1, "choice_id").otherwise("decision")
    obj = F.concat(F.lit('{"'), key, F.lit('": "'), texts.upper_letter(F.substring("text", 1, 1)), F.lit('"'), F.when(more, F.concat(F.lit(', "chars": '), F.length("text"))).otherwise(""))
    return docs.select("doc_id", "prose", "text", F.concat(obj, F.when(F.length("text") % 3 == 0, "").otherwise("}")).alias("obj"))


@R.query("yes_no", r"SELECT doc_id, nullif(lower(regexp_extract(text, '(?i)(?:^|[^\p{L}\p{N}_])(yes|no)(?:[^\p{L}\p{N}_]|$)', 1)), '') AS said FROM documents")
def yes_no(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", texts.yes_no(F.col("text")).alias("said"))


@R.query("extract_tagged", "WITH f AS (SELECT page_id, tag, regexp_extract_all(html, '(?s)<' || tag || '>(.*?)</' || tag || '>', 1) AS f FROM pages, (VALUES ('title'), ('h1'), ('b'), ('p')) t(tag)) SELECT page_id, CASE WHEN len(f) = 1 THEN f[1] END AS inside, tag FROM f")
def extract_tagged(spark, sf_dir):
    """The one title, heading, bold part or paragraph of a page; null where it has none or several."""
    pages = read(spark, sf_dir, "pages")
    found = F.array(*(F.struct(F.lit(t).alias("tag"), texts.tagged(F.col("html"), t).alias("inside")) for t in ("title", "h1", "b", "p")))
    return pages.select("page_id", F.explode(found).alias("f")).select("page_id", "f.inside", "f.tag")


@R.query("parse_json_lenient", "WITH " + SHAPE + " SELECT doc_id, '{\"' || CASE WHEN cut = 1 THEN 'choice_id' ELSE 'decision' END || '\": \"' || letter || '\"' || CASE WHEN more THEN ', \"chars\": ' || length(text) ELSE '' END || '}' AS object FROM t WHERE letter NOT IN ('\"', '\\') AND letter >= ' '")
def parse_json_lenient(spark, sf_dir):
    """Objects behind a text, in fences where closed, with the last brace missing in a third."""
    own = replies(spark, sf_dir).filter(~F.upper(F.substring("text", 1, 1)).isin('"', "\\") & (F.substring("text", 1, 1) >= " "))
    fenced = F.when(F.endswith("obj", F.lit("}")), F.concat(F.lit("```json\n"), "obj", F.lit("\n```\n"), "prose")).otherwise(F.col("obj"))
    return own.select("doc_id", texts.json_lenient(F.concat("prose", F.lit("\n"), fenced)).alias("object"))


@R.query("parse_choice_current", "WITH " + SHAPE + " SELECT doc_id, CASE WHEN cut <> 0 AND letter IN ('A', 'B', 'C', 'D', 'E') THEN letter END AS choice, CASE WHEN cut <> 0 AND NOT more AND letter IN ('A', 'B', 'C', 'D', 'E') THEN letter END AS strict_choice FROM t")
def parse_choice_current(spark, sf_dir):
    """The choice of the first complete object in a text; strictly, of an object with no other key."""
    valid = F.array(*map(F.lit, "ABCDE"))
    said = F.concat("prose", F.lit(" "), "obj", F.lit(" "), "prose")
    return replies(spark, sf_dir).select("doc_id", texts.parse_choice_current(said, valid).alias("choice"), texts.parse_choice_current(said, valid, True).alias("strict_choice"))


def summaries(spark, sf_dir):
    """Probes with what a summary cites: the positives, of which full ids are known, and the recent others, of which none are."""
    return history.scored_input(spark, sf_dir).withColumn("ids", F.transform("positives", lambda s: F.concat(F.lit("u"), "user_id", F.lit("_"), s)))


@R.query("expand_citations", "WITH " + CITED + " SELECT c.probe_id, string_agg(CASE WHEN own = 1 THEN '[session:u' || q.user_id || '_' || session_id || ']' ELSE '[' || session_id || ']' END, ' ' ORDER BY session_id) || ' of ' || any_value(q.domain) AS said FROM cited c JOIN asked q USING (probe_id) GROUP BY c.probe_id")
def expand_citations(spark, sf_dir):
    """Short ids in one bracket, those of known sessions as full markers."""
    said = F.concat(F.lit("["), F.array_join(F.array_sort(F.concat("positives", "temporal")), ", "), F.lit("] of "), "domain")
    return summaries(spark, sf_dir).select("probe_id", texts.expand_citations(said, F.col("ids")).alias("said"))


@R.query("validate_summary", "WITH " + CITED + " SELECT q.probe_id, q.domain <> 'error' AND NOT EXISTS (SELECT 1 FROM tmp t WHERE t.probe_id = q.probe_id) AND NOT EXISTS (SELECT 1 FROM non n WHERE n.probe_id = q.probe_id) AS valid FROM asked q")
def validate_summary(spark, sf_dir):
    """Summaries of probes: recent others are unknown ids, errors give bullets without an id, and probes of errors have their headings the wrong way round."""
    line = lambda s: F.concat(F.lit("- seen [session:"), s, F.lit("]\n"))
    facts = F.concat(F.lit("## Facts\n"), F.array_join(F.transform("positives", line), ""))
    plans = F.concat(F.lit("## Plans\n"), F.array_join(F.transform("temporal", line), ""), F.array_join(F.transform("nonbinding", lambda s: F.concat(F.lit("- about "), s, F.lit("\n"))), ""))
    said = F.when(F.col("domain") == "error", F.concat(plans, facts)).otherwise(F.concat(facts, plans))
    return summaries(spark, sf_dir).select("probe_id", texts.valid_summary(said, ["## Facts", "## Plans"], F.col("positives")).alias("valid"))


@R.query("private_field_guard", """WITH j AS (SELECT event_id, CAST('{"seen": [' || props || '], "' || event_type || '": {"note": "error: k"}, "' || event_id % 7 || '": []}' AS JSON) AS js FROM events), k AS (SELECT DISTINCT event_id, t.key AS key FROM j, json_tree(j.js) t WHERE t.key IN ('k', 'error', '3')) SELECT e.event_id, string_agg(k.key, ',' ORDER BY k.key) AS private_keys FROM events e LEFT JOIN k ON k.event_id = e.event_id GROUP BY e.event_id""")
def private_field_guard(spark, sf_dir):
    """Private keys at any depth of a record; values that only name one are none."""
    made = F.concat(F.lit('{"seen": ['), "props", F.lit('], "'), "event_type", F.lit('": {"note": "error: k"}, "'), (F.col("event_id") % 7).cast("string"), F.lit('": []}'))
    found = F.array_sort(F.array_intersect(texts.json_keys(made), F.array(*map(F.lit, ("k", "error", "3")))))
    return read(spark, sf_dir, "events").select("event_id", F.when(F.size(found) > 0, F.array_join(found, ",")).alias("private_keys"))
