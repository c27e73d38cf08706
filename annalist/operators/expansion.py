"""Recall by key or tags, what is added to found rows (linked notes, rows of the same time, source messages), and batches on their way into a store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators import overlap, pairing
from annalist.operators.dedup import numbered
from annalist.operators.pairing import inside


def linked(found: DataFrame, notes: DataFrame, k: int) -> DataFrame:
    """query, rank, pos, id of found notes (pos 0) and of the notes they link to, in the order of their links (pos from 1).

    ``found``: query, rank, id; ``notes``: id, links (array of ids). Of a note's links the first ``k + 1`` count, links to
    notes that are not there among them, though these don't come out. A note may come out more than once for a query.
    """
    own = found.select("query", "rank", F.col("id").alias("_of"))
    links = notes.select(F.col("id").alias("_note"), F.slice("links", 1, k + 1).alias("_links"))
    held = own.join(links, F.col("_of") == F.col("_note"))
    rows = held.select("query", "rank", F.posexplode(F.concat(F.array("_of"), F.coalesce("_links", F.array().cast(dict(links.dtypes)["_links"])))).alias("pos", "id"))
    return rows.join(notes.select(F.col("id").alias("_there")), F.col("id") == F.col("_there"), "left_semi")


def same_time(rows: DataFrame, seeds: DataFrame, stamp: str, *by: str) -> DataFrame:
    """The rows whose time stamp (and ``by``) is that of a seed; each once, however many seeds share it. A null is no stamp."""
    keys = [stamp, *by]
    wanted = seeds.select(*keys).dropna().distinct()
    return rows.join(wanted, keys, "left_semi")


def entries(facts: DataFrame, messages: DataFrame, *order: str) -> DataFrame:
    """Facts with the message that they come from: source ``n`` is the message at place 2 n of all messages in order.

    ``facts``: fact, source_id; ``messages``: said, speaker, topic and ``order``. Facts of unknown sources are left out.
    Messages are numbered by ranges, not in one task.
    """
    placed = numbered(messages, "seq", *order).select("seq", "said", F.date_format("said", "E").alias("weekday"), "speaker", "topic")
    return facts.join(placed, F.col("seq") == 2 * F.col("source_id")).select("fact", "seq", "said", "weekday", "speaker", "topic")


def merged_extracts(a: Column, b: Column) -> Column:
    """Two lists of results (items, usage) as one, place by place: items joined, usage summed; null only where both are. The longer list sets the length; a null list is empty."""
    none = lambda c: F.coalesce(c, F.array().cast("array<struct<items:array<string>,usage:bigint>>"))
    items = lambda x: F.coalesce(x["items"], F.array().cast("array<string>"))
    usage = lambda x: F.coalesce(x["usage"], F.lit(0).cast("long"))
    both = lambda x, y: F.when(x.isNotNull() | y.isNotNull(), F.struct(F.concat(items(x), items(y)).alias("items"), (usage(x) + usage(y)).alias("usage")))
    return F.zip_with(none(a), none(b), both)


def key_or_tags(asked: DataFrame, rows: DataFrame, least: int = 2) -> DataFrame:
    """query, id, by_key and n_shared of the rows whose key a query names or that share ``least`` different tags with it.

    ``asked``: query, keys, tags (arrays); ``rows``: id, key, tags. Blocks of queries meet blocks of rows as these lie and
    count what they share, so that only what comes out is a row, and a hot tag is no group. Nulls and repeated tags count
    for nothing.
    """
    own = asked.select("query", "keys", F.array_distinct("tags").alias("tags"))
    other = rows.select("id", "key", F.array_distinct("tags").alias("own_tags"))
    kinds = dict(own.dtypes)["query"], dict(other.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for row in range(batch.num_rows):
                number = batch.column("block")[row].as_py()
                if number not in held:
                    held[number] = inside(batch, "query", row), overlap.Tags(inside(batch, "keys", row)), overlap.Tags(inside(batch, "tags", row))
                queries, keys, tags = held[number]
                ids, named, sets = (inside(batch, c, row) for c in ("id", "key", "own_tags"))
                for lo in range(0, len(ids), overlap.ROWS):
                    some = ids.slice(lo, overlap.ROWS)
                    key = named.slice(lo, overlap.ROWS)
                    shared = tags.common(sets.slice(lo, overlap.ROWS))
                    by_key = keys.common(pa.ListArray.from_arrays(pa.array(range(len(key) + 1), pa.int32()), key)) > 0
                    at, to = np.nonzero(by_key | (shared >= least))
                    yield pa.RecordBatch.from_arrays([queries.take(pa.array(at)), some.take(pa.array(to)), pa.array(by_key[at, to]), pa.array(shared[at, to], pa.int64())], ["query", "id", "by_key", "n_shared"])

    return pairing.met(own, other).mapInArrow(run, f"query {kinds[0]}, id {kinds[1]}, by_key boolean, n_shared long")


def passages(df: DataFrame, id_col: str, size: int = 100) -> DataFrame:
    """Rows ready for a store: without blank texts and without an embedding that a row of a smaller id has, in batches of ``size``.

    ``df``: ``id_col`` (unique), text, embedding. Rows without an embedding are left out.
    """
    whole = df.filter((F.trim("text") != "") & F.col("embedding").isNotNull())
    first = whole.groupBy("embedding").agg(F.min(id_col).alias("_first")).select("_first")
    kept = whole.join(first, F.col(id_col) == F.col("_first"), "left_semi")
    return numbered(kept, "_place", id_col).withColumn("batch", F.floor(F.col("_place") / size)).drop("_place")
