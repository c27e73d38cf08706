"""Pages of a totally ordered table: opaque cursors, an index of pages, and pages from many cursors in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators.dedup import numbered

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def cursor(df: DataFrame, *order: str, within: Column | None = None) -> Column:
    """A place as opaque text: base64 of a JSON array of the values of ``order``. Places are values, so rows added or removed elsewhere leave them valid."""
    kinds = dict(df.dtypes)
    value = lambda c: F.col(c) if within is None else within[c]
    texts = [F.date_format(value(c), STAMP) if kinds[c].startswith("timestamp") else value(c).cast("string") for c in order]
    return F.base64(F.to_json(F.array(*texts)).cast("binary"))


def placed(cursors: DataFrame, like: DataFrame, *order: str) -> DataFrame:
    """``cursors`` (cursor_id, cursor) with the values of ``order`` in the types of ``like``. What is no cursor is left out."""
    kinds = dict(like.dtypes)
    parts = cursors.select("cursor_id", F.from_json(F.expr("try_to_binary(cursor, 'base64')").cast("string"), "array<string>").alias("_parts"))
    return parts.filter(F.size("_parts") == len(order)).select("cursor_id", *(F.col("_parts")[i].try_cast(kinds[c]).alias(c) for i, c in enumerate(order))).dropna()


def paged(df: DataFrame, size: int, *order: str) -> DataFrame:
    """``df`` with its page (from 0) in a total order, numbered by ranges without a single task. ``order`` is unique and not null."""
    return numbered(df, "_place", *order).withColumn("page", F.floor(F.col("_place") / size)).drop("_place")


def page_index(pages: DataFrame, *order: str) -> DataFrame:
    """page, n_rows, and cursors of the first and the last row of each page: any page is read by a bound on ``order``, not by an offset."""
    ends = pages.groupBy("page").agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.struct(*order)).alias("_low"), F.max(F.struct(*order)).alias("_high"))
    return ends.select("page", "n_rows", cursor(pages, *order, within=F.col("_low")).alias("first_cursor"), cursor(pages, *order, within=F.col("_high")).alias("last_cursor"))


def from_cursors(df: DataFrame, cursors: DataFrame, size: int, *order: str, backwards: bool = False) -> DataFrame:
    """The ``size`` rows after each cursor (before it if ``backwards``), nearest first as rank 1: cursor_id, rank, has_more and the columns of ``order``.

    All cursors are placed by one sort of rows and cursors together, so a cursor whose row is gone still has its place;
    pages are then read by place. ``order`` is unique and not null in ``df``; cursor ids are unique.
    """
    rows = numbered(df.select(*order), "_place", *order)
    marks = placed(cursors, df, *order)
    kind = -1 if backwards else 1  # a cursor stands before or after the row of its own values
    both = df.select(*order, F.lit(0).alias("_kind"), F.lit(None).cast(dict(marks.dtypes)["cursor_id"]).alias("cursor_id")).unionByName(marks.withColumn("_kind", F.lit(kind)))
    spot = numbered(both, "_all", *order, "_kind", "cursor_id").filter(F.col("_kind") != 0).select("cursor_id", "_all")
    ahead = numbered(marks, "_marks", *order, "cursor_id").select(F.col("cursor_id").alias("_id"), "_marks")
    at = spot.join(ahead, F.col("cursor_id") == F.col("_id")).select("cursor_id", (F.col("_all") - F.col("_marks")).alias("_at"))
    # one row more than a page tells whether another follows
    step = F.col("_at") - F.col("rank") if backwards else F.col("_at") + F.col("rank") - 1
    wanted = at.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(size + 1)))).select("cursor_id", "rank", step.alias("_want"))
    found = wanted.join(rows, F.col("_want") == F.col("_place")).select("cursor_id", "rank", *order)
    more = found.filter(F.col("rank") == size + 1).select(F.col("cursor_id").alias("_more"))
    return found.filter(F.col("rank") <= size).join(more, F.col("cursor_id") == F.col("_more"), "left").select("cursor_id", "rank", F.col("_more").isNotNull().alias("has_more"), *order)


def between(df: DataFrame, after: Column, before: Column, size: int, *order: str) -> DataFrame:
    """Rows strictly between two places (structs of ``order``), in order: of the first ``2 * size`` the middle ``size``, where there are more than ``size``."""
    at = F.struct(*order)
    own = df.filter((at > after) & (at < before)).orderBy(*order).limit(2 * size)
    n = numbered(own, "_place", *order)  # at most two pages
    total = n.agg(F.count(F.lit(1)).alias("_n"))
    start = F.when(F.col("_n") > size, F.greatest(F.lit(0), F.floor(F.col("_n") / 2) - size // 2)).otherwise(0)
    return n.crossJoin(F.broadcast(total)).filter((F.col("_place") >= start) & (F.col("_place") < start + size)).drop("_place", "_n")  # one row
