"""Ranking of recalled rows by group: similarity and learned value, level weights, and keys that memories are attached to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mean and deviation of similarities.
SIM_MEAN, SIM_STD = 0.1857, 0.0941
#: Fixed value: a deviation not above this counts as 1.
LEAST_STD = 1e-9


def best(df: DataFrame, group: str, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1. Spark keeps k rows a group in each task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(name) <= k)


def blended(df: DataFrame, group: str, sim: str, value: str, w_sim: float, w_value: float, name: str = "score") -> DataFrame:
    """``df`` with w_sim * z(similarity) + w_value * z(value) within [-3, 3]: fixed statistics for similarities, the group's own for values.

    A group of one row, or of equal values, has z 0; a null similarity or value gives a null score. The statistics are
    combined in each task before the shuffle and joined back, so a hot group is not one task's sort.
    """
    own = df.groupBy(F.col(group).alias("_of")).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    spread = F.when(F.col("_std") > LEAST_STD, F.col("_std")).otherwise(F.lit(1.0))
    z = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.col(value) - F.col("_mean")) / spread))
    z = F.when(F.col(value).isNotNull(), z)
    score = w_sim * ((F.col(sim) - SIM_MEAN) / SIM_STD) + w_value * z
    return df.join(own, F.col(group).eqNullSafe(F.col("_of")), "left").withColumn(name, score).drop("_of", "_mean", "_std")


def valued(value: Column, start: float, floor: float | None = None, boost: float = 0.0, used: Column | None = None) -> Column:
    """The value a choice goes by: ``start`` where none is known, not below ``floor``, raised by ``boost`` where the memory was used before."""
    q = F.coalesce(value, F.lit(start))
    if floor is not None:
        q = F.greatest(q, F.lit(floor))
    return q if used is None or boost <= 0 else q + F.when(used, F.lit(boost)).otherwise(F.lit(0.0))


def select_valued(df: DataFrame, group: str, value: Column, sim: str, k: int, ties: list[str], least: float | None = None) -> DataFrame:
    """The ``k`` rows of each group of the highest value, then similarity; rows with a value below ``least`` are out before."""
    scored = df.withColumn("q", value)
    if least is not None:
        scored = scored.filter(F.col("q") >= least)
    return best(scored, group, [F.col("q").desc(), F.col(sim).desc(), *map(F.col, ties)], k)


def weighted(df: DataFrame, group: str, cosine: Column, weight: Column, recalled: Column, position: list[str], k: int) -> DataFrame:
    """Recalled rows by cosine times level weight, ``k`` a group.

    Rows without a vector (null cosine) come behind those with one, in the order of recall, at -1. In a group without any
    vector the order of recall stands, with the recall score, or 0.5 where it is null or 0.
    """
    scored = df.withColumns({"_own": F.round(cosine * weight, 6)})
    some = scored.groupBy(F.col(group).alias("_of")).agg((F.count("_own") > 0).alias("_some"))
    joined = scored.join(some, F.col(group) == F.col("_of"))
    fallback = F.when(F.col("_some"), F.lit(-1.0)).otherwise(F.coalesce(F.nullif(recalled, F.lit(0.0)), F.lit(0.5)))
    ranked = best(joined, group, [F.col("_own").desc_nulls_last(), *map(F.col, position)], k)
    return ranked.withColumn("score", F.coalesce("_own", fallback)).drop("_own", "_of", "_some")


def attached(tasks: DataFrame, recalled: DataFrame, task: str, query: str, score: str, position: list[str], bar: float) -> DataFrame:
    """Each task with the key its memory goes to: the best recalled query of at least ``bar`` (ties: the first recalled), else the task's own.

    ``key`` is null and ``is_new`` true where a key is made anew. A task's best is found in each task of the shuffle's map
    side, as one struct, so a task with many recalled queries makes few rows.
    """
    fits = recalled.filter(F.col(score) >= bar)
    order = F.struct((-F.col(score)).alias("s"), *position)
    first = fits.groupBy(F.col(task).alias("_task")).agg(F.min_by(query, order).alias("key"))
    return tasks.join(first, F.col(task) == F.col("_task"), "left").drop("_task").withColumn("is_new", F.col("key").isNull())


def children(edges: DataFrame, nodes: DataFrame, parents: DataFrame, tenant: str) -> DataFrame:
    """parent and the row of each child behind one of its edges (parent, child), once, where both belong to one tenant.

    ``nodes`` and ``parents`` have an id and the tenant. Edges are cut to the asked parents before children are joined.
    """
    asked = parents.select(F.col("id").alias("_asked"), F.col(tenant).alias("_tenant"))
    near = edges.join(asked, F.col("parent") == F.col("_asked")).select("parent", "child", "_tenant").distinct()
    return near.join(nodes, (F.col("child") == F.col("id")) & (F.col("_tenant") == F.col(tenant))).drop("_tenant", "id")
