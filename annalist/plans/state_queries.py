"""Queries of stateful operators in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.plans import history
from annalist.plans.scalar_queries import PACK
from annalist.registry import Registry
from annalist.streaming import memory

R = Registry()


@R.query("short_buffer", PACK.replace("SELECT user_id, CAST(i AS BIGINT) AS session_index, chunk FROM w", "SELECT w.user_id, w.chunk AS batch, count(*) AS n_items, CAST(sum(c.cost) AS BIGINT) AS cost FROM w JOIN c ON c.user_id = w.user_id AND c.i = w.i GROUP BY 1, 2"))
def short_buffer(spark, sf_dir):
    rows = history.lifelines(spark, sf_dir).select("user_id", F.col("session_index").cast("long").alias("ord"), (10 + F.col("event_id") % 37).alias("cost"))
    return memory.short_buffer(rows, 100)


@R.query("chronological_ingest", "WITH " + history.VISIBLE + " SELECT probe_id, CAST(count(*) AS VARCHAR) || ':' || CAST(max(session_index) AS VARCHAR) AS memory_context FROM visible GROUP BY probe_id")
def chronological_ingest(spark, sf_dir):
    """The state here is how many sessions came, and the last ordinal; a memory method takes its place."""
    sessions = history.lifelines(spark, sf_dir).select("user_id", "session_index")
    asked = history.probes(history.lifelines(spark, sf_dir)).select("probe_id", "user_id", "cutoff")
    return memory.chronological(sessions, asked, lambda: (0, -1), lambda state, s: (state[0] + 1, s["session_index"]), lambda state, p: f"{state[0]}:{state[1]}")
