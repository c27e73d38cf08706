"""Connected components of an edge table, by large-star and small-star contraction in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import drop_table, table

ROUNDS = 60


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` has long columns a and b. Every node of an edge, with the least node of its component.

    Each round hooks the neighbours of a node to the least of them, first the larger ones, then the smaller ones,
    and writes the edges to the shared folder. A star is a fixed point. Loops are dropped; an empty table gives an
    empty table. Rounds grow with the logarithm of the longest path.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = table(now, name)
    mark = None
    for _ in range(ROUNDS):
        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.join(least, both["a"] == least["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, large["a"] == least["u"])
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = table(small.select("e.*").filter("a <> b").distinct(), name)
        drop_table(now)
        now = after
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark:
            break
        mark = (row["n"], row["h"])
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
    out._annalist_path = now._annalist_path  # for drop_table()
    return out
