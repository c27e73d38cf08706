"""Registration of queries together with the SQL that states their result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a DataFrame query, with its SQL where SQL can state it."""

        def keep(f: Query) -> Query:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = plain(sql)
            return f

        return keep

    def statement(self, name: str, sql: str, oracle: str | None = None) -> None:
        """Register a query that is itself a SQL statement; tables stand in braces."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            used = set(re.findall(r"\{(\w+)\}", sql))
            return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in used})

        self.queries[name] = run
        self.sql[name] = plain(oracle or sql)


def plain(sql: str) -> str:
    """Tables in braces as plain names."""
    return re.sub(r"\{(" + "|".join(TABLES) + r")\}", r"\1", sql).strip()
