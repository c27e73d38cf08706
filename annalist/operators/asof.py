"""As-of joins of probes with the sessions of their user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible_history(probes: DataFrame, sessions: DataFrame, cutoff: str = "cutoff") -> DataFrame:
    """Each probe with the sessions of its user up to its cutoff; an equi join on the user with a bound on the ordinal."""
    of = sessions.withColumnRenamed("user_id", "of_user")
    return probes.join(of, (F.col("user_id") == F.col("of_user")) & (F.col("session_index") <= F.col(cutoff))).drop("of_user")


def around(df: DataFrame, key: str, time: str, id_col: str, seconds: int) -> DataFrame:
    """Pairs (a, b) of different rows of one key whose times are at most ``seconds`` apart, in both orders.

    Rows meet in buckets of that width, each with its own and the two beside it, so a key of a third of all rows is
    dealt out by time, and rows far apart never meet. A null key or time is near nothing.
    """
    width = seconds * 1_000_000
    rows = df.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(id_col).alias("a"), F.col(key).alias("_key"), F.unix_micros(F.col(time).cast("timestamp")).alias("_at"))
    rows = rows.withColumn("_bucket", F.floor(F.col("_at") / width))
    near = rows.select(F.col("a").alias("b"), "_key", F.col("_at").alias("_then"), F.explode(F.array(*(F.col("_bucket") + d for d in (-1, 0, 1)))).alias("_bucket"))
    return rows.join(near, ["_key", "_bucket"]).filter((F.abs(F.col("_at") - F.col("_then")) <= width) & (F.col("a") != F.col("b"))).select("a", "b")


def snapshots(probes: DataFrame) -> DataFrame:
    """Distinct (user, cutoff): what several probes share is computed once."""
    return probes.select("user_id", "cutoff").distinct()


def running_top(df: DataFrame, key: str, order: list[str], by: list[str], k: int, name: str, where: Column | None = None) -> DataFrame:
    """``df`` with ``name``: of the rows of its key up to and with each row, the ``k`` with the greatest ``by``, greatest first, as structs of ``by``.

    A place of the list is the running maximum of what the place above it let go: the lesser of a newcomer and of the
    holder before it. So a list is k running maxima over one sort, whatever the length of a history, and no row is paired
    with another. ``order`` and ``by`` are each unique within a key; nulls in ``by`` are least; rows where ``where``
    doesn't hold are in no list but have one.
    """
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    new = F.struct(*by)
    df = df.withColumn("_new", new if where is None else F.when(where, new))
    for i in range(k):
        held = F.max("_new").over(before)
        df = df.withColumn(f"_held{i}", held)
        passed = F.when(F.col("_new").isNotNull() & F.col(f"_held{i}").isNotNull(), F.least("_new", f"_held{i}"))
        df = df.withColumns({f"_held{i}": F.greatest("_new", f"_held{i}"), "_new": passed})
    places = [f"_held{i}" for i in range(k)]
    return df.withColumn(name, F.array_compact(F.array(*places))).drop("_new", *places)
