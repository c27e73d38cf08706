"""Upkeep of a store: batches of replacements, flags with undo, working copies, parents, segments and spread samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators import mutation


def soft_delete(store: DataFrame, owners: DataFrame, owner: str, flag: str = "is_deleted") -> DataFrame:
    """Rows of the given owners are flagged; rows flagged before stay so. Readers leave flagged rows out."""
    return mutation.mark(store, owners, owner, flag, F.lit(True))


def delete_cube(store: DataFrame, where: Column, record: str) -> DataFrame:
    """Flag the rows of a cube that aren't flagged yet, under a record by which ``recover`` finds them."""
    hit = F.coalesce(where, F.lit(False)) & ~F.col("is_deleted")
    return store.withColumns({"record": F.when(hit, F.lit(record)).otherwise(F.col("record")), "is_deleted": F.col("is_deleted") | hit})


def recover(store: DataFrame, record: str) -> DataFrame:
    """Undo what one record has flagged, and nothing else."""
    hit = F.col("record").eqNullSafe(F.lit(record))
    return store.withColumns({"is_deleted": F.col("is_deleted") & ~hit, "record": F.when(~hit, F.col("record"))})


def delete_by(store: DataFrame, key: str, ids: DataFrame, where: Column) -> DataFrame:
    """Rows whose key is among ``ids`` or that a filter finds are gone; a filter that is null finds nothing."""
    return store.filter(~F.coalesce(where, F.lit(False))).join(ids.select(key), key, "left_anti")


def update_events(store: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A given summary takes the old one's place; given details follow the old ones on a new line, or replace them.

    ``changes``: key, summary, details, mode ("append" or "replace"); nulls change nothing.
    """
    new = changes.select(F.col(key).alias("_key"), F.col("summary").alias("_summary"), F.col("details").alias("_details"), "mode")
    grown = F.when(F.col("mode") == "append", F.concat_ws("\n", "details", "_details")).otherwise(F.col("_details"))
    details = F.when(F.col("_details").isNull(), F.col("details")).otherwise(grown)
    joined = store.join(new, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({"summary": F.coalesce("_summary", "summary"), "details": details}).select(*store.columns)


def merge_events(store: DataFrame, changes: DataFrame, key: str, insert_missing: bool = True) -> DataFrame:
    """Details are joined by a new line, with the ``state`` of each row; an unknown key is inserted if that is enabled."""
    new = changes.select(F.col(key).alias("_key"), F.col("details").alias("_details"))
    joined = store.select(key, "details").join(new, F.col(key) == F.col("_key"), "full_outer" if insert_missing else "left")
    state = F.when(F.col("_key").isNull(), "kept").when(F.col(key).isNull(), "inserted").otherwise("merged")
    return joined.select(F.coalesce(key, "_key").alias(key), F.concat_ws("\n", "details", "_details").alias("details"), state.alias("state"))


def replace_rows(store: DataFrame, old: DataFrame, new: DataFrame, key: str, must_exist: bool = False) -> DataFrame:
    """The rows of ``old`` keys go, those of ``new`` come. With ``must_exist`` an unknown old key is an error."""
    gone = old.select(key).distinct()
    if must_exist and not (lost := gone.join(store, key, "left_anti")).isEmpty():
        raise KeyError(f"no such {key}: {lost.first()[0]}, ...")
    return store.join(gone, key, "left_anti").unionByName(new)


def dual_write(items: DataFrame, lasting: Column) -> DataFrame:
    """Each item as a working copy, and as a long-term row where ``lasting`` holds; ``copy`` tells them apart."""
    both = F.when(lasting, F.array(F.lit("working"), F.lit("long term"))).otherwise(F.array(F.lit("working")))
    return items.withColumn("copy", F.explode(both))


def replace_working(working: DataFrame, found: DataFrame, n: int, cap: int, score: Column, key: str, at: str) -> DataFrame:
    """The ``n`` best of ``found`` join the working rows, of which the ``cap`` newest stay. Both have key and ``at``."""
    best = found.orderBy(score.desc(), key).limit(n).select(key, at)
    return working.select(key, at).unionByName(best).orderBy(F.col(at).desc(), F.col(key).desc()).limit(cap)


def ensure_parents(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, kind) wanted, with the parent of that text and kind, the least id of several; where there is none, a new id.

    ``nodes``: id, text, kind. A new id comes of text and kind, so that the same parent is made once wherever it is asked for.
    """
    known = nodes.groupBy("text", "kind").agg(F.min("id").alias("known"))
    made = F.concat(F.lit("new-"), F.md5(F.concat_ws("/", "text", "kind").cast("binary")))
    joined = wanted.select("text", "kind").distinct().join(known, ["text", "kind"], "left")
    return joined.select("text", "kind", F.coalesce(F.col("known").cast("string"), made).alias("parent"), F.col("known").isNull().alias("created"))


def slices(rows: DataFrame, lengths: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with the number of the slice they fall in: a list of ``lengths`` cuts a key's ordered rows into
    consecutive slices. Rows beyond the last slice are left out."""
    each = lengths.select(F.col(key).alias("_key"), F.posexplode("lengths").alias("slice", "_n"))
    ends = F.sum("_n").over(Window.partitionBy("_key").orderBy("slice"))
    places = each.withColumn("_end", ends).filter("_n > 0").select("_key", "slice", F.explode(F.sequence(F.col("_end") - F.col("_n"), F.col("_end") - 1)).alias("_pos"))
    placed = rows.withColumn("_at", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))
    return placed.join(places, (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_pos"))).select(*rows.columns, "slice")


def spread_topk(rows: DataFrame, kind: str, score: Column, key: str, n: int, kinds: int = 5) -> DataFrame:
    """A share of ``n`` from each of so many kinds of store, rounded up, kind by kind, cut to ``n`` rows."""
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(score.desc(), key))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= -(-n // kinds)).orderBy(kind, "_rank").limit(n).drop("_rank")


def epsilon_topk(rows: DataFrame, group: str, score: Column, key: str, k: int, epsilon: float, seed: int) -> DataFrame:
    """With chance ``epsilon`` a group gives a random sample of ``k`` rows, else its best. Chance is a seeded hash of
    group and key, the same for any layout of the table."""
    seeded = lambda c: F.md5(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")).cast("binary"))
    explores = F.conv(F.substring(seeded(group), 1, 4), 16, 10).cast("int") < int(epsilon * 65_536)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.when(explores, seeded(key)), score.desc(), key))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def by_user(rows: DataFrame, user: str, *order: str) -> DataFrame:
    """All rows of a user in one partition, in their order."""
    return rows.repartition(user).sortWithinPartitions(user, *order)
