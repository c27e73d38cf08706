"""Keep-first resolution of pairs, pinned intermediate tables, and numbering without a single task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs of similar rows that one task decides.
RANGE_PAIRS = 1_000_000


def pinned(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the session's shared folder (``spark.checkpoint.dir``)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(found or spark.conf.get("spark.sql.warehouse.dir") + "/.checkpoints")
    return df.checkpoint()


def first_wins(pairs: DataFrame) -> DataFrame:
    """Dropped ids, of pairs (a < b) of similar rows: in the order of ids a row is dropped if it is like an earlier kept one.

    Undecided pairs are sorted into ranges of b, of about ``RANGE_PAIRS`` each. A task walks its range in the order of
    ids and decides every row whose earlier partners are decided: they are in the range, or like nothing earlier. So a
    chain of any length within a range takes one round; each round decides the whole lowest range at least and leaves
    fewer ranges. Pairs may repeat; ids are not null.
    """
    left, dropped = pinned(pairs.select("a", "b").distinct()), None
    kinds = dict(pairs.dtypes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        now, partners = None, []

        def decide() -> tuple[list, list]:
            said = [True if head else known.get(a) for a, head in partners]
            verdict = False if any(said) else True if all(x is False for x in said) else None
            if verdict is not None:
                known[now] = verdict
            return ([now], [verdict]) if verdict is not None else ([], [])

        for batch in batches:
            ids, kept = [], []
            for a, b, head in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if partners and b != now:
                    i, k = decide()
                    ids, kept, partners = ids + i, kept + k, []
                now = b
                partners.append((a, head))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(1).type), pa.array(kept, pa.bool_())], ["id", "kept"])
        if partners:
            i, k = decide()
            yield pa.RecordBatch.from_arrays([pa.array(i, batch.column(1).type), pa.array(k, pa.bool_())], ["id", "kept"])

    while (n := left.count()) > 0:
        later = left.select(F.col("b").alias("_b")).distinct()
        marked = left.join(later, F.col("a") == F.col("_b"), "left").select("a", "b", F.col("_b").isNull().alias("head"))
        ranged = marked.repartitionByRange(n // RANGE_PAIRS + 1, "b").sortWithinPartitions("b", "a")
        decided = pinned(ranged.mapInArrow(walk, f"id {kinds['b']}, kept boolean"))
        gone = decided.filter("NOT kept").select("id")
        dropped = gone if dropped is None else dropped.union(gone)
        rest = left.join(decided.select(F.col("id").alias("x")), F.col("b") == F.col("x"), "left_anti")
        left = pinned(rest.join(gone.withColumnRenamed("id", "y"), F.col("a") == F.col("y"), "left_anti"))
    return left.select(F.col("b").alias("id")) if dropped is None else dropped


def collapsed(df: DataFrame, id_col: str, alike: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that are the first with their value of ``alike``, and the ids of all the others. A null is like nothing.

    What holds for a row's partners holds for those of all rows with its value, so only first rows need be compared, and
    the others always go: n copies are n rows here, not n * n pairs.
    """
    keyed = pinned(df.select(F.col(id_col).alias("id"), alike.alias("_alike")))
    first = keyed.filter("_alike IS NOT NULL").groupBy(F.col("_alike").alias("_key")).agg(F.min("id").alias("_first"))
    copies = keyed.join(first, F.col("_alike") == F.col("_key")).filter("id <> _first").select("id")
    return df.join(copies, F.col(id_col) == F.col("id"), "left_anti"), copies


def kept_first(df: DataFrame, id_col: str, pairs: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """Each id and whether it is kept: neither one of ``copies`` nor dropped by ``pairs``."""
    gone = first_wins(pairs) if copies is None else first_wins(pairs).union(copies)
    gone = gone.withColumn("gone", F.lit(True)).withColumnRenamed("id", "gone_id")
    return df.select(id_col).join(gone, F.col(id_col) == F.col("gone_id"), "left").select(id_col, F.col("gone").isNull().alias("kept"))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with its place (from 0) in a total order: ranges are numbered in parallel and shifted by the rows ahead of them."""
    ranged = pinned(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    ahead = counts.select(F.col("_range").alias("_of"), F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(ahead), F.col("_range") == F.col("_of")).withColumn(name, F.col("_own") - 1 + F.col("_ahead")).drop("_range", "_own", "_of", "_ahead")
