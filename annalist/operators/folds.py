"""Order-sensitive folds over the rows of a key, as expressions over sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tail_budget(df: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """The longest suffix of each key whose cost stays within the budget."""
    total = F.sum(cost).over(Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("tail_cost", total).filter(F.col("tail_cost") <= budget)


def greedy_pack(items: Column, budget: int) -> Column:
    """Chunk number of each item (order, cost) of a sorted array: a chunk closes before the item that would overflow it."""
    start = F.struct(F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<ord:bigint,chunk:bigint>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        full = (acc["used"] > 0) & (acc["used"] + x["cost"] > budget)
        chunk = acc["chunk"] + full.cast("long")
        used = F.when(full, F.lit(0)).otherwise(acc["used"]) + x["cost"]
        return F.struct(chunk.alias("chunk"), used.alias("used"), F.concat(acc["out"], F.array(F.struct(x["ord"].alias("ord"), chunk.alias("chunk")))).alias("out"))

    return F.aggregate(items, start, add, lambda acc: acc["out"])


def ema(rewards: Column, alpha: float, start: float = 0.0) -> Column:
    """q after each reward in turn: q + alpha (r - q)."""
    return F.aggregate(rewards, F.lit(start), lambda q, r: q + alpha * (r - q))


def anchored_windows(times: Column, width: float) -> Column:
    """Start of the window of each time in a sorted array: a window opens at the first time it does not cover, so gaps are jumped."""
    start = F.struct(F.lit(None).cast("double").alias("open"), F.array().cast("array<struct<t:double,open:double>>").alias("out"))

    def add(acc: Column, t: Column) -> Column:
        opened = F.when(acc["open"].isNull() | (t > acc["open"] + width), t).otherwise(acc["open"])
        return F.struct(opened.alias("open"), F.concat(acc["out"], F.array(F.struct(t.alias("t"), opened.alias("open")))).alias("out"))

    return F.aggregate(times, start, add, lambda acc: acc["out"])
