"""Queries of scoring, roll-ups and subsets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.operators import asof, scoring
from annalist.plans import history
from annalist.registry import Registry

R = Registry()

PER_PROBE = (
    "WITH "
    + history.SETS
    + """,
top AS (SELECT r.*, CASE WHEN p.session_id IS NOT NULL THEN 1 ELSE 0 END AS is_pos, CASE WHEN t.session_id IS NOT NULL THEN 1 ELSE 0 END AS is_tmp, CASE WHEN n.session_id IS NOT NULL THEN 1 ELSE 0 END AS is_non FROM raw r LEFT JOIN pos p USING (probe_id, session_id) LEFT JOIN tmp t USING (probe_id, session_id) LEFT JOIN non n USING (probe_id, session_id)),
agg AS (SELECT probe_id, count(*) AS attributed, sum(CASE WHEN after THEN 0 ELSE 1 END) AS n_valid, sum(CASE WHEN k <= 5 THEN is_pos ELSE 0 END) AS h, sum(CASE WHEN k <= 5 THEN is_tmp ELSE 0 END) AS ht, sum(CASE WHEN k <= 5 THEN is_non ELSE 0 END) AS hn, least(count(*), 5) AS kk, min(CASE WHEN k <= 5 AND is_pos = 1 THEN k END) AS first, sum(CASE WHEN k <= 5 THEN is_pos / log2(k + 1) ELSE 0 END) AS dcg, sum(CASE WHEN k <= 5 THEN (CASE WHEN is_pos = 1 THEN 3.0 WHEN is_tmp = 1 THEN 1.0 ELSE 0.0 END) / log2(k + 1) ELSE 0 END) AS gdcg FROM top GROUP BY probe_id),
sizes AS (SELECT probe_id, (SELECT count(*) FROM pos p WHERE p.probe_id = q.probe_id) AS g, (SELECT count(*) FROM tmp p WHERE p.probe_id = q.probe_id) AS m, (SELECT count(*) FROM non p WHERE p.probe_id = q.probe_id) AS n FROM probes q),
ranks AS (SELECT unnest(range(1, 6)) AS k),
scored AS (SELECT q.probe_id, q.user_id, q.domain, q.cutoff, q.choice = q.gold AS correct, a.attributed, a.n_valid, a.h, s.g, s.m, s.n,
  CAST(a.h AS DOUBLE) / s.g AS recall, CAST(a.h AS DOUBLE) / least(5, s.g) AS coverage_eff, a.h / 5.0 AS precision, CAST(a.h AS DOUBLE) / a.kk AS returned_precision, coalesce(1.0 / a.first, 0) AS mrr, a.h > 0 AS hit, a.h = s.g AS "full",
  a.dcg / (SELECT sum(1 / log2(k + 1)) FROM ranks WHERE k <= least(5, s.g)) AS ndcg,
  CASE WHEN s.m > 0 THEN a.gdcg / (SELECT sum((CASE WHEN k <= s.g THEN 3.0 WHEN k <= s.g + s.m THEN 1.0 ELSE 0.0 END) / log2(k + 1)) FROM ranks) END AS graded_ndcg,
  CASE WHEN s.m > 0 THEN CAST(a.ht AS DOUBLE) / s.m END AS temporal_recall, CASE WHEN s.n > 0 THEN a.hn / 5.0 END AS intrusion
  FROM probes q JOIN agg a USING (probe_id) JOIN sizes s USING (probe_id) WHERE s.g > 0)"""
)
SCORE_COLUMNS = ["recall", "coverage_eff", "precision", "returned_precision", "mrr", "ndcg", "graded_ndcg", "temporal_recall", "intrusion"]


@R.query("score_probes", PER_PROBE + "\nSELECT probe_id, correct, CAST(attributed AS BIGINT) AS attributed, CAST(n_valid AS BIGINT) AS n_valid, hit, \"full\" AS full_evidence, " + ", ".join(f"round({c}, 6) AS {c}" for c in SCORE_COLUMNS) + " FROM scored")
def score_probes(spark, sf_dir):
    scored = scoring.score_probes(history.scored_input(spark, sf_dir))
    return scored.select("probe_id", "correct", F.col("attributed").cast("long").alias("attributed"), F.col("n_valid").cast("long").alias("n_valid"), "hit", F.col("full").alias("full_evidence"), *(F.round(c, 6).alias(c) for c in SCORE_COLUMNS))


WILSON = "((acc + 3.841458820694124 / (2 * n)) {s} 1.959963984540054 * sqrt(acc * (1 - acc) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n)"
AGGREGATES = """count(*) AS n, sum(CAST(correct AS INT)) AS n_correct, avg(CAST(correct AS INT)) AS acc, avg(recall) AS recall_macro, sum(h) / sum(g) AS recall_micro, avg(coverage_eff) AS coverage_eff, avg(precision) AS precision, avg(CAST(hit AS INT)) AS hit_rate, avg(CAST("full" AS INT)) AS full_rate, avg(mrr) AS mrr, avg(ndcg) AS ndcg, avg(CAST(correct AND hit AS INT)) AS joint_hit_rate, (sum(attributed) - sum(n_valid)) / sum(attributed) AS invalid_rate, avg(graded_ndcg) AS graded_ndcg, avg(temporal_recall) AS temporal_recall, avg(intrusion) AS intrusion, avg(CASE WHEN hit THEN CAST(correct AS INT) END) - avg(CASE WHEN NOT hit THEN CAST(correct AS INT) END) AS utility_gap"""
ROLLED = ["accuracy", "ci_low", "ci_high", "recall_macro", "recall_micro", "coverage_eff", "precision", "hit_rate", "full_rate", "mrr", "ndcg", "joint_hit_rate", "invalid_rate", "graded_ndcg", "temporal_recall", "intrusion", "utility_gap"]
ROLLED_SQL = "CAST(n AS BIGINT) AS n, CAST(n_correct AS BIGINT) AS n_correct, round(acc, 6) AS accuracy, " + ", ".join(
    f"round({('greatest(0, ' + WILSON.format(s='-') + ')') if c == 'ci_low' else ('least(1, ' + WILSON.format(s='+') + ')') if c == 'ci_high' else c}, 6) AS {c}" for c in ROLLED[1:]
)


def rolled(df):
    return df.select(*(c for c in ("group_field", "grp") if c in df.columns), "n", "n_correct", *(F.round(c, 6).alias(c) for c in ROLLED))


@R.query("bucket_rollup", PER_PROBE + f""", b AS (SELECT 'overall' AS group_field, 'all' AS grp, {AGGREGATES} FROM scored UNION ALL SELECT 'domain', domain, {AGGREGATES} FROM scored GROUP BY domain UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), {AGGREGATES} FROM scored GROUP BY user_id)
SELECT group_field, grp, {ROLLED_SQL} FROM b""")  # fmt: skip
def bucket_rollup(spark, sf_dir):
    return rolled(scoring.rollup(scoring.score_probes(history.scored_input(spark, sf_dir)), ["domain", "user_id"]))


@R.query("metric_row", PER_PROBE + f", b AS (SELECT {AGGREGATES} FROM scored) SELECT {ROLLED_SQL} FROM b")
def metric_row(spark, sf_dir):
    return rolled(scoring.score_probes(history.scored_input(spark, sf_dir)).agg(*scoring.metric_columns()))


@R.query("optional_avgs", PER_PROBE + " SELECT domain, round(avg(graded_ndcg), 6) AS graded_ndcg, count(graded_ndcg) AS n_graded, round(avg(intrusion), 6) AS intrusion, count(intrusion) AS n_intrusion FROM scored GROUP BY domain")
def optional_avgs(spark, sf_dir):
    scored = scoring.score_probes(history.scored_input(spark, sf_dir))
    return scored.groupBy("domain").agg(F.round(F.avg("graded_ndcg"), 6).alias("graded_ndcg"), F.count("graded_ndcg").alias("n_graded"), F.round(F.avg("intrusion"), 6).alias("intrusion"), F.count("intrusion").alias("n_intrusion"))


MEANS_RANKED = ["coverage_eff", "precision", "mrr", "ndcg", "graded_ndcg", "intrusion", "discrimination", "hit_rate", "joint_full_rate", "recall_attributed", "accuracy_hit", "accuracy_miss", "utility_gap", "probe_intrusion_rate", "clean_hit_rate", "clean_grounded_rate"]
RETRIEVAL = (
    "WITH "
    + history.SETS
    + """,
shown AS (SELECT r.probe_id, r.session_id, r.k, r.after FROM raw r JOIN probes q USING (probe_id) WHERE q.user_id % 4 <> 3),
modes(mode, depth) AS (VALUES ('ranked', 5), ('context', 1000000)),
asked AS (SELECT probe_id, 'p' AS kind, session_id, CAST(substr(session_id, 2) AS BIGINT) % 2 AS part FROM pos UNION ALL SELECT probe_id, 't', session_id, 0 FROM tmp UNION ALL SELECT probe_id, 'n', session_id, 0 FROM non),
hits AS (SELECT mode, a.*, CASE WHEN r.k <= depth THEN r.k END AS k FROM asked a LEFT JOIN shown r USING (probe_id, session_id) CROSS JOIN modes),
ranks AS (SELECT unnest(range(1, 6)) AS k),
m AS (SELECT mode, probe_id, count(*) FILTER (kind = 'p') AS g, count(k) FILTER (kind = 'p') AS h, count(*) FILTER (kind = 't') AS t, count(k) FILTER (kind = 't') AS ht, count(*) FILTER (kind = 'n') AS n, count(k) FILTER (kind = 'n') AS hn, min(k) FILTER (kind = 'p') AS first, coalesce(sum(1 / log2(k + 1)) FILTER (kind = 'p'), 0) AS dcg, coalesce(sum((CASE kind WHEN 'p' THEN 3 WHEN 't' THEN 1 ELSE 0 END) / log2(k + 1)), 0) AS gdcg FROM hits GROUP BY 1, 2),
parts AS (SELECT mode, probe_id, part, max(CASE WHEN k IS NULL THEN 0 ELSE 1 END) AS met, min(CASE WHEN k IS NULL THEN 0 ELSE 1 END) AS whole FROM hits WHERE kind = 'p' GROUP BY 1, 2, 3),
c AS (SELECT mode, probe_id, avg(met) AS met, avg(whole) AS whole, min(whole) AS chain FROM parts GROUP BY 1, 2),
u AS (SELECT q.probe_id, q.domain, q.user_id, q.cutoff, q.choice = q.gold AS correct, q.user_id % 4 = 3 AS none, count(s.k) AS shown, count(*) FILTER (s.after) AS after FROM probes q LEFT JOIN shown s USING (probe_id) GROUP BY ALL),
a AS (SELECT *, CASE WHEN none OR cutoff % 4 <> 1 THEN 0 ELSE 1 END AS dup, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS wrong, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS unknown FROM u),
f AS (SELECT m.*, c.met, c.whole, c.chain, a.domain, a.correct, a.dup, a.wrong, a.after, a.wrong + a.unknown + a.after AS invalid, a.shown + a.wrong + a.unknown AS uniq, a.shown + a.wrong + a.unknown + a.dup AS attributed, a.cutoff, a.user_id, a.shown > a.after AS available, m.h > 0 AS hit, m.h = m.g AS whole_set, CAST(m.h AS DOUBLE) / m.g AS recall,
  CASE WHEN m.n > 0 THEN m.hn / 5.0 END AS intrusion, CASE WHEN m.n > 0 THEN m.h > 0 AND m.hn = 0 END AS clean,
  m.dcg / (SELECT sum(1 / log2(k + 1)) FROM ranks WHERE k <= least(5, m.g)) AS ndcg, CASE WHEN m.t > 0 THEN m.gdcg / (SELECT sum((CASE WHEN k <= m.g THEN 3.0 WHEN k <= m.g + m.t THEN 1.0 ELSE 0.0 END) / log2(k + 1)) FROM ranks) END AS graded
  FROM m JOIN c USING (mode, probe_id) JOIN a USING (probe_id) WHERE m.g > 0),
g AS (SELECT mode, domain, count(*) AS n, avg(CASE WHEN user_id % 2 = 0 THEN attributed + cutoff % 3 ELSE uniq END) AS avg_reported, avg(attributed) AS avg_attributed, avg(CAST(available AS INT)) AS attribution_coverage, coalesce(sum(invalid) / nullif(sum(attributed), 0), 0) AS invalid_rate, coalesce(sum(dup) / nullif(sum(attributed), 0), 0) AS duplicate_rate, CAST(sum(wrong) AS BIGINT) AS n_wrong_user, CAST(sum(after) AS BIGINT) AS n_after_cutoff,
  avg(recall) AS recall_macro, sum(h) / sum(g) AS recall_micro, avg(CAST(whole_set AS INT)) AS full_rate, avg(CAST(correct AND hit AS INT)) AS joint_hit_rate, avg(met) AS component_hit, avg(whole) AS component_complete, avg(chain) AS complete_chain_rate, avg(CASE WHEN t > 0 THEN CAST(ht AS DOUBLE) / t END) AS temporal_recall, avg(CASE WHEN n > 0 THEN CAST(hn AS DOUBLE) / n END) AS exposure,
  avg(CAST(h AS DOUBLE) / least(5, g)) AS coverage_eff, avg(h / 5.0) AS precision, avg(coalesce(1.0 / first, 0)) AS mrr, avg(ndcg) AS ndcg, avg(graded) AS graded_ndcg, avg(intrusion) AS intrusion, avg(h / 5.0 - intrusion) AS discrimination, avg(CAST(hit AS INT)) AS hit_rate, avg(CAST(correct AND whole_set AS INT)) AS joint_full_rate, avg(CASE WHEN available THEN recall END) AS recall_attributed,
  avg(CASE WHEN hit THEN CAST(correct AS INT) END) AS accuracy_hit, avg(CASE WHEN NOT hit THEN CAST(correct AS INT) END) AS accuracy_miss, avg(CASE WHEN hit THEN CAST(correct AS INT) END) - avg(CASE WHEN NOT hit THEN CAST(correct AS INT) END) AS utility_gap, avg(CASE WHEN n > 0 THEN CAST(hn > 0 AS INT) END) AS probe_intrusion_rate, avg(CAST(clean AS INT)) AS clean_hit_rate, avg(CAST(clean AND correct AS INT)) AS clean_grounded_rate
  FROM f GROUP BY mode, domain)
SELECT mode, domain, n, n_wrong_user, n_after_cutoff, """
    + ", ".join(f"round({c}, 6) AS {c}" for c in "avg_reported avg_attributed attribution_coverage invalid_rate duplicate_rate recall_macro recall_micro full_rate joint_hit_rate component_hit component_complete complete_chain_rate temporal_recall".split())
    + ", CASE mode WHEN 'context' THEN round(exposure, 6) END AS exposure, "
    + ", ".join(f"CASE mode WHEN 'ranked' THEN round({c}, 6) END AS {c}" for c in MEANS_RANKED)
    + " FROM g"
)


@R.query("retrieval_aggregates", RETRIEVAL)
def retrieval_aggregates(spark, sf_dir):
    """All aggregates of both modes by domain. Some users have no attribution; others report ids of other users, unknown or repeated ones."""
    df = history.scored_input(spark, sf_dir)
    none, user = F.array().cast("array<string>"), F.col("user_id")
    extra = lambda on, c: F.when(on, F.array(c)).otherwise(none)
    seen = F.when(user % 4 == 3, none).otherwise(F.col("ranked"))
    after = F.when(user % 4 == 3, none).otherwise(F.col("after_cutoff"))
    wrong, unknown = extra(user % 2 == 0, F.concat(F.lit("w"), "probe_id")), extra(user % 3 == 0, F.concat(F.lit("u"), "probe_id"))
    again = F.when(F.col("cutoff") % 4 == 1, F.slice(seen, 1, 1)).otherwise(none)
    odd = lambda x: F.substr(x, F.lit(2)).cast("long") % 2
    groups = F.filter(F.array(F.filter("positives", lambda x: odd(x) == 0), F.filter("positives", lambda x: odd(x) == 1)), lambda g: F.size(g) > 0)
    df = df.withColumns({"wrong_user": wrong, "unknown": unknown, "after_cutoff": after, "ranked": F.concat(seen, wrong, unknown, again), "groups": groups})
    df = df.withColumn("reported", F.when(user % 2 == 0, F.size("ranked") + F.col("cutoff") % 3).cast("long"))
    both = scoring.retrieval_aggregates(df, "ranked", "domain").unionByName(scoring.retrieval_aggregates(df, "context", "domain"), allowMissingColumns=True)
    return scoring.rounded(both)


@R.query("two_level_macro", PER_PROBE + ", u AS (SELECT user_id, avg(recall) AS r, avg(CAST(correct AS INT)) AS c FROM scored GROUP BY user_id) SELECT count(*) AS n_units, round(avg(r), 6) AS recall_macro, round(avg(c), 6) AS correct_macro FROM u")
def two_level_macro(spark, sf_dir):
    return scoring.rounded(scoring.two_level(scoring.score_probes(history.scored_input(spark, sf_dir)), "user_id", "recall", "correct"))


@R.query("wilson_ci", "WITH c AS (SELECT event_type AS domain, count(*) AS n, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS acc FROM events GROUP BY 1) SELECT domain, round(" + WILSON.format(s="-") + ", 6) AS ci_low, round(" + WILSON.format(s="+") + ", 6) AS ci_high FROM c")
def wilson_ci(spark, sf_dir):
    low, high = scoring.wilson(F.sum((F.col("value") > 50).cast("int")), F.count(F.lit(1)))
    return scoring.rounded(history.lifelines(spark, sf_dir).groupBy("domain").agg(low.alias("ci_low"), high.alias("ci_high")))


@R.query("rank_labels", "WITH " + history.SETS + """
SELECT r.probe_id, r.session_id, CAST(r.k AS BIGINT) AS k, CASE WHEN p.session_id IS NOT NULL THEN 'positive' WHEN t.session_id IS NOT NULL THEN 'temporal' WHEN n.session_id IS NOT NULL THEN 'nonbinding' WHEN r.after THEN 'after_cutoff' ELSE 'other' END AS label
FROM raw r LEFT JOIN pos p USING (probe_id, session_id) LEFT JOIN tmp t USING (probe_id, session_id) LEFT JOIN non n USING (probe_id, session_id) WHERE r.k <= 5 AND r.probe_id IN (SELECT probe_id FROM pos)""")  # fmt: skip
def rank_labels(spark, sf_dir):
    df = history.scored_input(spark, sf_dir).withColumn("t", F.slice("ranked", 1, scoring.DEPTH))
    none = F.array().cast("array<string>")
    named = scoring.labels_of(F.col("t"), F.col("positives"), F.col("temporal"), F.col("nonbinding"), none, none, F.col("after_cutoff"))
    rows = df.select("probe_id", F.posexplode(F.arrays_zip(F.col("t").alias("session_id"), named.alias("label"))).alias("pos", "x"))
    return rows.select("probe_id", "x.session_id", (F.col("pos") + 1).cast("long").alias("k"), "x.label")


@R.query("attribution_classes", "WITH " + history.SETS + " SELECT CASE WHEN after THEN 'after_cutoff' ELSE 'valid' END AS class, count(*) AS n FROM raw WHERE probe_id IN (SELECT probe_id FROM pos) GROUP BY 1")
def attribution_classes(spark, sf_dir):
    rows = history.scored_input(spark, sf_dir).select("after_cutoff", F.explode("ranked").alias("id"))
    return rows.groupBy(F.when(F.array_contains("after_cutoff", F.col("id")), "after_cutoff").otherwise("valid").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@R.query("capability_panels", PER_PROBE + ", m(panel, domain) AS (VALUES ('engagement', 'view'), ('engagement', 'click'), ('conversion', 'purchase'), ('conversion', 'signup'), ('failure', 'error')) SELECT panel, count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS accuracy, round(1 - avg(CAST(correct AS INT)), 6) AS error_rate FROM scored JOIN m USING (domain) GROUP BY panel")
def capability_panels(spark, sf_dir):
    panels = spark.createDataFrame([("engagement", "view"), ("engagement", "click"), ("conversion", "purchase"), ("conversion", "signup"), ("failure", "error")], "panel string, domain string")
    own = scoring.score_probes(history.scored_input(spark, sf_dir)).join(F.broadcast(panels), "domain")  # five rows
    accuracy = F.avg(F.col("correct").cast("double"))
    return own.groupBy("panel").agg(F.count(F.lit(1)).alias("n"), F.round(accuracy, 6).alias("accuracy"), F.round(1 - accuracy, 6).alias("error_rate"))


@R.query("asof_history", "WITH " + history.VISIBLE + " SELECT probe_id, count(*) AS n_visible, max(session_index) AS last_index, round(sum(value), 4) AS total FROM visible GROUP BY probe_id")
def asof_history(spark, sf_dir):
    sessions = history.lifelines(spark, sf_dir)
    seen = asof.visible_history(history.probes(sessions).select("probe_id", "user_id", "cutoff"), sessions.select("user_id", "session_index", "value"))
    return seen.groupBy("probe_id").agg(F.count(F.lit(1)).alias("n_visible"), F.max("session_index").alias("last_index"), F.round(F.sum("value"), 4).alias("total"))


@R.query("history_prefix", "WITH " + history.PROBES + ", run AS (SELECT user_id, session_index, sum(value) OVER (PARTITION BY user_id ORDER BY session_index) AS total FROM sessions) SELECT p.probe_id, round(r.total, 4) AS total FROM probes p JOIN run r ON r.user_id = p.user_id AND r.session_index = p.cutoff")
def history_prefix(spark, sf_dir):
    """The running form of the as-of join: one pass by user, no row for each pair."""
    w = Window.partitionBy("user_id").orderBy("session_index")
    run = history.lifelines(spark, sf_dir).select("user_id", "event_id", "session_index", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("total"))
    return run.filter("session_index > 0 AND session_index % 10 = 0").select(F.concat(F.lit("p"), "event_id").alias("probe_id"), F.round("total", 4).alias("total"))


@R.query("snapshot_join", "WITH " + history.VISIBLE + ", snap AS (SELECT DISTINCT user_id, cutoff FROM probes) SELECT p.probe_id, x.n_domains FROM probes p JOIN (SELECT s.user_id, s.cutoff, count(DISTINCT e.domain) AS n_domains FROM snap s JOIN sessions e ON e.user_id = s.user_id AND e.session_index <= s.cutoff GROUP BY 1, 2) x USING (user_id, cutoff)")
def snapshot_join(spark, sf_dir):
    sessions = history.lifelines(spark, sf_dir)
    asked = history.probes(sessions).select("probe_id", "user_id", "cutoff")
    seen = asof.visible_history(asof.snapshots(asked), sessions.select("user_id", "session_index", "domain"))
    done = seen.groupBy("user_id", "cutoff").agg(F.countDistinct("domain").alias("n_domains"))
    return asked.join(done, ["user_id", "cutoff"]).select("probe_id", "n_domains")


R.statement("session_ordinal", "WITH " + history.SESSIONS + " SELECT session_id, user_id, CAST(session_index AS BIGINT) AS session_index FROM sessions")
R.statement("visible_history", "WITH " + history.VISIBLE + " SELECT probe_id, session_id FROM visible")
R.statement("filter_domain", "WITH " + history.PROBES + " SELECT p.probe_id, count(s.session_id) AS n_sessions FROM probes p JOIN sessions s ON s.user_id = p.user_id AND lower(trim(s.domain)) = 'purchase' WHERE lower(trim(p.domain)) = lower(trim(' Purchase ')) GROUP BY p.probe_id")
R.statement("group_user_jobs", "WITH " + history.PROBES + " SELECT p.user_id, p.probe_id, CAST(ROW_NUMBER() OVER (PARTITION BY p.user_id ORDER BY p.cutoff, p.probe_id) AS BIGINT) AS job_pos, n.n_sessions FROM probes p JOIN (SELECT user_id, count(*) AS n_sessions FROM sessions GROUP BY user_id) n USING (user_id)")
R.statement("join_probe_key", "WITH " + history.PROBES + ", keys AS (SELECT probe_id, gold FROM probes WHERE event_id % 17 <> 3) SELECT coalesce(p.probe_id, k.probe_id) AS probe_id, k.gold, CASE WHEN k.probe_id IS NULL THEN 'no key' WHEN p.probe_id IS NULL THEN 'no probe' ELSE 'ok' END AS state FROM (SELECT probe_id FROM probes WHERE event_id % 13 <> 2) p FULL OUTER JOIN keys k ON p.probe_id = k.probe_id")
R.statement("join_prediction_probe", "WITH " + history.PROBES + ", pred AS (SELECT probe_id, choice FROM probes WHERE event_id % 11 <> 5 UNION ALL SELECT probe_id, choice FROM probes WHERE event_id % 29 = 1), n AS (SELECT probe_id, count(*) AS n, max(choice) AS choice FROM pred GROUP BY probe_id) SELECT p.probe_id, coalesce(n.n, 0) AS n_predictions, CASE WHEN n.n IS NULL THEN 'missing' WHEN n.n > 1 THEN 'duplicate' WHEN n.choice NOT IN ('A', 'B', 'C', 'D') THEN 'invalid' ELSE 'ok' END AS state FROM probes p LEFT JOIN n ON n.probe_id = p.probe_id")


@R.query("join_session_lookup", "WITH " + history.SETS.replace("{events}", "events") + " SELECT r.probe_id, r.session_id, s.user_id AS owner, CAST(s.session_index AS BIGINT) AS session_index FROM raw r LEFT JOIN sessions s ON s.session_id = r.session_id")
def join_session_lookup(spark, sf_dir):
    """Ranked ids with their session's owner and ordinal."""
    of = history.lifelines(spark, sf_dir).select("session_id", F.col("user_id").alias("owner"), F.col("session_index").cast("long").alias("session_index"))
    return history.evidence(spark, sf_dir).select("probe_id", F.explode("ranked").alias("session_id")).join(of, "session_id", "left")


R.statement("coverage_diff", "WITH " + history.PROBES + ", got AS (SELECT probe_id FROM probes WHERE event_id % 7 <> 0 UNION ALL SELECT 'extra' || event_id FROM probes WHERE event_id % 41 = 0) SELECT p.probe_id, 'missing' AS side FROM probes p LEFT JOIN got g ON g.probe_id = p.probe_id WHERE g.probe_id IS NULL UNION ALL SELECT g.probe_id, 'extra' FROM got g LEFT JOIN probes p ON p.probe_id = g.probe_id WHERE p.probe_id IS NULL")
R.statement("key_identity", "SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN NULL ELSE 'q' || event_id END, ''), nullif('p' || event_id, ''), '') AS key_id FROM {events}")
R.statement("dup_check", "WITH d AS (SELECT event_id % 900 AS id FROM {events}) SELECT id, count(*) AS n FROM d GROUP BY id HAVING count(*) > 1")
R.statement("mode_guard", "SELECT user_id, count(DISTINCT event_type) AS n_modes, count(DISTINCT event_type) = 1 AS uniform FROM {events} GROUP BY user_id")


@R.query("gold_validation", "WITH " + history.SETS.replace("{events}", "events") + ", gold AS (SELECT probe_id, session_id, user_id, cutoff FROM pos JOIN probes USING (probe_id) UNION ALL SELECT probe_id, 's' || (event_id + 1), user_id, cutoff FROM probes UNION ALL SELECT probe_id, 's' || event_id, user_id, cutoff FROM probes), m AS (SELECT g.*, s.user_id AS owner, s.session_index AS place, s.session_id IS NOT NULL AS known FROM gold g LEFT JOIN sessions s USING (session_id)) SELECT probe_id, session_id, CASE WHEN NOT known THEN 'unknown' WHEN owner IS DISTINCT FROM user_id THEN 'wrong user' ELSE 'after cutoff' END AS violation FROM m WHERE NOT known OR owner IS DISTINCT FROM user_id OR place > cutoff")
def gold_validation(spark, sf_dir):
    """Labels of probes, and two wrong ones each: the session of the next event, and the probe's own."""
    asked = history.evidence(spark, sf_dir).withColumn("own", F.concat("positives", F.array(*(F.concat(F.lit("s"), F.col("event_id") + d) for d in (1, 0)))))
    return scoring.gold_violations(asked.select("probe_id", "user_id", "cutoff", F.explode("own").alias("session_id")), history.lifelines(spark, sf_dir))


R.statement("count_by_fields", "SELECT event_type, CAST(CAST(get_json_object(props, '$.k') AS INT) % 5 AS BIGINT) AS k, count(*) AS n FROM {events} GROUP BY 1, 2", "SELECT event_type, CAST(CAST(json_extract_string(props, '$.k') AS INT) % 5 AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
R.statement("count_total", "SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id")
R.statement("usage_totals", "SELECT l_returnflag AS phase, count(*) AS calls, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens, round(sum(l_tax), 4) AS latency FROM {lineitem} GROUP BY l_returnflag")
R.statement("runtime_totals", "SELECT count(*) AS sessions, round(sum(value), 2) AS seconds, round(count(*) / sum(value), 8) AS sessions_per_second FROM {events}")
R.statement("max_per_id", "WITH hits AS (SELECT l_partkey AS id, l_discount AS score FROM {lineitem} UNION ALL SELECT l_partkey, l_tax FROM {lineitem}) SELECT id, max(score) AS score FROM hits GROUP BY id")
R.statement("dedup_text_best", "SELECT p_name, p_partkey, p_retailprice AS score FROM (SELECT p_name, p_partkey, p_retailprice, ROW_NUMBER() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS k FROM {part}) x WHERE k = 1")
R.statement("latest_per_user", "SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {events}) x WHERE k = 1")
R.statement("zscore_stats", "SELECT event_id, round(coalesce((value - avg(value) OVER (PARTITION BY user_id)) / nullif(CASE WHEN count(*) OVER (PARTITION BY user_id) = 1 THEN 1 ELSE stddev_pop(value) OVER (PARTITION BY user_id) END, 0), 0), 6) AS z FROM {events}")
R.statement("distinct_ordered", "WITH first AS (SELECT user_id, event_type, min(ts) AS t FROM {events} GROUP BY user_id, event_type) SELECT user_id, event_type, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY t, event_type) AS BIGINT) AS pos FROM first")
