"""Changes to stored rows, as joins of the store with a batch of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators.ordered import previous


def upsert(store: DataFrame, batch: DataFrame, *key: str) -> DataFrame:
    """Rows of the batch replace those of the store with their key (one column or several) or join them; columns that a side lacks are null."""
    return store.join(batch.select(*key), [*key], "left_anti").unionByName(batch, allowMissingColumns=True)


def update(store: DataFrame, changes: DataFrame, key: str, *columns: str) -> DataFrame:
    """Given values replace stored ones; a null leaves the stored value; unknown keys change nothing."""
    new = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = store.join(new, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*store.columns)


def merge_actions(store: DataFrame, actions: DataFrame) -> DataFrame:
    """Apply ADD, UPDATE, DELETE and NONE. Store: id, text. Actions: pos, id, event, text.

    Of the changes to an id the last counts. An UPDATE of an unknown id adds it; a DELETE of one is dropped.
    """
    real = actions.filter(F.col("event") != "NONE")
    last = real.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.col("pos").desc()))).filter("k = 1")
    last = last.select(F.col("id").alias("to_id"), "event", F.col("text").alias("to_text"))
    merged = store.join(last, F.col("id") == F.col("to_id"), "full_outer").filter("event IS NULL OR event <> 'DELETE'")
    return merged.select(F.coalesce("id", "to_id").alias("id"), F.coalesce("to_text", "text").alias("text"), F.when(F.col("event").isNull(), "kept").when(F.col("id").isNull(), "added").otherwise("updated").alias("state"))


def newest(store: DataFrame, n: int, by: str, order: str, tie: str) -> DataFrame:
    """The ``n`` newest rows of each kind; older ones are removed."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc(), F.col(tie).desc()))
    return store.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def mark(store: DataFrame, ids: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """Set a column on the rows whose key is in ``ids``."""
    hit = ids.select(F.col(key).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    return store.join(hit, F.col(key) == F.col("_key"), "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).drop("_key", "_hit")


def archive(store: DataFrame, new: DataFrame, key: str, text: str, history: str, relation: str) -> DataFrame:
    """The old text goes to the history, with the relation of the new one to it; the new text takes its place."""
    given = new.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    joined = store.join(given, F.col(key) == F.col("_key"), "left")
    entry = F.struct(F.col(text).alias("text"), F.lit(relation).alias("relation"))
    grown = F.when(F.col("_text").isNull(), F.col(history)).otherwise(F.concat(F.col(history), F.array(entry)))
    return joined.withColumns({history: grown, text: F.coalesce("_text", text)}).drop("_key", "_text")


def logged(store: DataFrame, actions: DataFrame) -> DataFrame:
    """The change log of a batch of actions: pos, id, event, before, after, is_deleted. Store: id, text. Actions: pos, id, event, text.

    Every ADD and UPDATE is a change, to the text it brings; it is logged as ADD where the id had no text, else as
    UPDATE. A DELETE is one where there was something to delete. NONE, null and unknown events change nothing, nor do
    rows without an id. ``pos`` is unique. Of a repeated id of the store the least text counts; its null texts are no rows.
    """
    base = store.filter("id IS NOT NULL AND text IS NOT NULL").groupBy("id").agg(F.min("text").alias("text")).select("id", F.lit(None).cast("long").alias("pos"), F.lit("BASE").alias("event"), "text")
    real = actions.filter(F.col("id").isNotNull() & F.col("event").isin("ADD", "UPDATE", "DELETE"))
    both = base.unionByName(real.select("id", F.col("pos").cast("long").alias("pos"), "event", F.when(F.col("event") == "DELETE", None).otherwise(F.coalesce("text", F.lit(""))).alias("text")))
    steps = previous(both.withColumn("at", F.coalesce("pos", F.lit(-(1 << 63)).cast("long"))), "id", "at", "text", "before").filter("event <> 'BASE'")
    event = F.when(F.col("text").isNull(), "DELETE").when(F.col("before").isNull(), "ADD").otherwise("UPDATE")
    return steps.filter("text IS NOT NULL OR before IS NOT NULL").select("pos", "id", event.alias("event"), "before", F.col("text").alias("after"), F.col("text").isNull().cast("int").alias("is_deleted"))


def replayed(store: DataFrame, log: DataFrame, last: Column) -> DataFrame:
    """The store after the changes of the log up to position ``last``: id, text, and the position of the change that made it (null: none)."""
    newest = log.filter(F.col("pos") <= last).groupBy("id").agg(F.max_by("after", "pos").alias("after"), F.max("pos").alias("pos"))
    old = store.filter("id IS NOT NULL AND text IS NOT NULL").groupBy("id").agg(F.min("text").alias("text"))
    joined = old.join(newest.withColumnRenamed("id", "to_id"), F.col("id") == F.col("to_id"), "full_outer")
    return joined.select(F.coalesce("id", "to_id").alias("id"), F.when(F.col("pos").isNull(), F.col("text")).otherwise(F.col("after")).alias("text"), "pos").filter("text IS NOT NULL")
