"""All queries of the engine by name, with the SQL that states what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from annalist.plans import expansion_queries, fulltext_queries, maintenance_queries, memory_queries, method_queries, progress_queries, ranking_queries, reply_queries, scalar_queries, scoring_queries, search_queries, state_queries, store_queries

AREAS = (expansion_queries, fulltext_queries, method_queries, scalar_queries, scoring_queries, search_queries, state_queries, store_queries, memory_queries, maintenance_queries, progress_queries, ranking_queries, reply_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for area in AREAS for k, f in area.R.queries.items()}
ORACLE_SQL: dict[str, str] = {k: s for area in AREAS for k, s in area.R.sql.items()}
FLAGSHIP = "bucket_rollup"
