"""Sessions, probes, keys and predictions over the event table: each event is one session of its user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.operators import asof
from annalist.registry import read

#: The same relations as common table expressions.
SESSIONS = """sessions AS (SELECT 's' || event_id AS session_id, user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS session_index, ts, event_type AS domain, event_id, value, props FROM {events})"""
PROBES = (
    SESSIONS
    + """,
probes AS (SELECT 'p' || event_id AS probe_id, user_id, session_index - 1 AS cutoff, domain, event_id, substr('ABCD', CAST(1 + event_id % 4 AS INT), 1) AS gold, substr('ABCD', CAST(1 + (event_id * 7) % 4 AS INT), 1) AS choice FROM sessions WHERE session_index > 0 AND session_index % 10 = 0)"""
)
VISIBLE = (
    PROBES
    + """,
visible AS (SELECT p.probe_id, p.user_id, p.cutoff, p.domain AS probe_domain, s.session_id, s.session_index, s.domain, s.value FROM probes p JOIN sessions s ON s.user_id = p.user_id AND s.session_index <= p.cutoff)"""
)
SETS = (
    VISIBLE
    + """,
pos AS (SELECT probe_id, session_id FROM (SELECT probe_id, session_id, ROW_NUMBER() OVER (PARTITION BY probe_id ORDER BY session_index DESC) AS k FROM visible WHERE domain = probe_domain) x WHERE k <= 6),
tmp AS (SELECT v.probe_id, v.session_id FROM visible v LEFT JOIN pos p ON p.probe_id = v.probe_id AND p.session_id = v.session_id WHERE v.session_index > v.cutoff - 3 AND p.session_id IS NULL),
non AS (SELECT probe_id, session_id FROM (SELECT probe_id, session_id, ROW_NUMBER() OVER (PARTITION BY probe_id ORDER BY session_index DESC) AS k FROM visible WHERE domain = 'error' AND probe_domain <> 'error') x WHERE k <= 3),
raw AS (SELECT probe_id, session_id, k, after FROM (SELECT p.probe_id, s.session_id, s.session_index > p.cutoff AS after, ROW_NUMBER() OVER (PARTITION BY p.probe_id ORDER BY s.value DESC, s.session_index DESC) AS k FROM probes p JOIN sessions s ON s.user_id = p.user_id AND s.session_index <= p.cutoff + 2) x WHERE k <= 8)"""
)


def lifelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their ordinal for the user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), "event_id").alias("session_id"), "user_id", (F.row_number().over(order) - 1).alias("session_index"), "ts", F.col("event_type").alias("domain"), "event_id", "value", "props"
    )


def probes(sessions: DataFrame, *also: str) -> DataFrame:
    """Every tenth session asks about what came before it; columns ``also`` stay."""
    letter = lambda n: F.substring(F.lit("ABCD"), (n % 4 + 1).cast("int"), F.lit(1))
    own = sessions.filter((F.col("session_index") > 0) & (F.col("session_index") % 10 == 0))
    return own.select(
        F.concat(F.lit("p"), "event_id").alias("probe_id"), "user_id", (F.col("session_index") - 1).alias("cutoff"), "domain", letter(F.col("event_id")).alias("gold"), letter(F.col("event_id") * 7).alias("choice"), *also
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each probe: evidence sets and the raw ranked list with each id's class.

    A probe stands at its own session, so what it saw are frames before that row and running lists up to it: the work
    grows with the sessions, not with the sessions before each probe.
    """
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sessions = lifelines(spark, sf_dir).filter(F.col("user_id").isNotNull())
    best = asof.running_top(sessions, "user_id", ["ts", "event_id"], ["value", "session_index", "session_id"], 8, "best")
    errors = asof.running_top(best, "user_id", ["ts", "event_id"], ["session_index", "session_id"], 3, "errors", F.col("domain") == "error")
    seen = errors.withColumns({"hits": F.coalesce(F.lead("best").over(line), F.col("best")), "newest": F.collect_list("session_id").over(line.rowsBetween(-3, -1))})
    own = Window.partitionBy("user_id", "domain").orderBy("ts", "event_id").rowsBetween(-6, -1)
    same = seen.withColumn("positives", F.when(F.col("domain").isNotNull(), F.collect_list("session_id").over(own)))
    asked = probes(same, "hits", "newest", "positives", "errors", "event_id")
    return asked.select(
        "probe_id", "event_id", "user_id", "cutoff", "domain", "gold", "choice", "positives",
        F.array_except("newest", "positives").alias("temporal"),
        F.when(F.col("domain") != "error", F.col("errors.session_id")).otherwise(F.array().cast("array<string>")).alias("nonbinding"),
        F.col("hits.session_id").alias("ranked"),
        F.filter("hits", lambda x: x["session_index"] > F.col("cutoff"))["session_id"].alias("after_cutoff"),
    )


def scored_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes with positives; one without any is an error of the keys and not scored."""
    return evidence(spark, sf_dir).filter(F.size("positives") > 0).drop("event_id")
