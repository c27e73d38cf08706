"""Rows that share tags: the k with the most in common, and all that share some."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators import pairing
from annalist.operators.dedup import pinned
from annalist.operators.pairing import inside

#: Sets of up to so many tags are met by their subsets, larger ones by blocks.
SMALL = 8
#: Subsets that a task holds before it looks which of them it needs, and rows of a block that are counted at once.
HELD, ROWS = 2_000_000, 1_024


class Tags:
    """The sets of a block of queries as an index: for the tag at place t, from ``ends[t]`` on, the queries that have it."""

    def __init__(self, sets: pa.Array) -> None:
        tags, at = pairing.parts(sets)
        tags, at = tags.drop_null(), at[tags.is_valid().to_numpy(zero_copy_only=False)]
        coded = tags.dictionary_encode()
        self.known, self.n = coded.dictionary, len(sets)
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        self.ends, self.query = np.searchsorted(code[order], np.arange(len(self.known) + 1)), at[order]

    def common(self, sets: pa.Array) -> np.ndarray:
        """How many tags each query (a row) has in common with each of the sets (a column)."""
        tags, at = pairing.parts(sets)
        code = pc.index_in(tags, value_set=self.known).fill_null(-1).to_numpy()  # a null is not known
        at, code = at[code >= 0], code[code >= 0]
        often = self.ends[code + 1] - self.ends[code]
        each = np.repeat(np.arange(len(code)), often)
        post = np.arange(len(each)) - np.repeat(np.cumsum(often) - often, often) + self.ends[code][each]
        return np.bincount(self.query[post] * len(sets) + at[each], minlength=self.n * len(sets)).reshape(self.n, -1)


def most_by_blocks(own: DataFrame, rows: DataFrame, k: int, least: int, kinds: tuple[str, str]) -> DataFrame:
    """The k rows (memory, mt) with the most tags in common with each query (q, t), ``least`` or more: blocks meet as they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind = {}, None
        for batch in batches:
            kind = batch.column("memory").type.value_type
            for row in range(batch.num_rows):
                number = batch.column("block")[row].as_py()
                if number not in held:
                    found = pairing.Best(inside(batch, "q", row), k, least)
                    held[number] = found, pairing.plain(found.ids), Tags(inside(batch, "t", row))
                found, ids, tags = held[number]
                names, sets = pairing.plain(inside(batch, "memory", row)), inside(batch, "mt", row)
                for lo in range(0, len(names), ROWS):
                    common = tags.common(sets.slice(lo, ROWS))
                    at, to = found.sift(common, names[lo : lo + ROWS] != ids[:, None], 0, 0)
                    if len(at):
                        found.add(at, common[at, to], names[lo : lo + ROWS][to])
        for found, _, _ in held.values():
            yield found.batch(["a", "b", "n"], kind)

    return pairing.met(own, rows).mapInArrow(run, f"a {kinds[0]}, b {kinds[1]}, n double").withColumn("n", F.col("n").cast("long"))


def subsets(sets: DataFrame, name: str, size: int, first: int | None = None) -> DataFrame:
    """h and ``name``: each subset of ``size`` tags of each set (``name``, t: 64-bit numbers), by the sum of its numbers.

    With ``first`` a task keeps of the rows with a subset that it holds at once only so many, those of the smallest names.
    """
    kind = dict(sets.dtypes)[name]

    def cut(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = pairing.best(h, np.zeros(len(h), np.int8), of, first)
        return h[keep], of[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ofs, n, was = [], [], 0, None

        def out(h: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(of, was)], ["h", name])

        for batch in batches:
            was = batch.column(name).type
            names, column = pairing.plain(batch.column(name)), batch.column("t")
            tags, length = column.flatten().to_numpy(), column.value_lengths().to_numpy()
            start = np.cumsum(length) - length
            for m in np.unique(length[length >= size]):
                at = np.flatnonzero(length == m)
                held = tags[start[at][:, None] + np.arange(m)]
                for some in np.array_split(np.array(list(combinations(range(m), size))), 1 + len(at) * size // 100_000):
                    if len(some):
                        h = held[:, some].sum(axis=2)
                        hs.append(h.ravel())
                        ofs.append(np.repeat(names[at], len(some)))
                        n += h.size
            if n >= HELD or first is None:
                h, of = (np.concatenate(x) for x in (hs or [np.zeros(0, np.int64)], ofs or [names[:0]]))
                if first is not None:
                    h, of = cut(h, of)
                if first is None or len(h) > HELD // 2:
                    yield out(h, of)
                    hs, ofs, n = [], [], 0
                else:
                    hs, ofs, n = [h], [of], len(h)
        if hs:
            h, of = np.concatenate(hs), np.concatenate(ofs)
            yield out(*(cut(h, of) if first is not None else (h, of)))

    return sets.mapInArrow(run, f"h long, {name} {kind}")


def most_by_subsets(own: DataFrame, rows: DataFrame, k: int, least: int) -> DataFrame:
    """As ``most_by_blocks`` for sets of up to ``SMALL`` tags, without a look at each pair.

    A row shares just one subset of n tags with a query where they have n in common. Who has that subset and a smaller
    key has as much in common at least, so a query's k best are among the first k (and itself) of one of its subsets.
    A round takes subsets of one size, from the largest: queries that have k rows by then are done.
    """
    largest = rows.join(F.broadcast(own.agg(F.max(F.size("t")).alias("m"))), F.lit(True)).agg(F.max(F.least(F.size("t"), F.col("m")))).first()[0] or 0  # one row
    found, left = None, own
    for size in range(largest, least - 1, -1):
        held = subsets(rows, "memory", size, k + 1)
        held = held.withColumn("_k", F.row_number().over(Window.partitionBy("h").orderBy("memory"))).filter(F.col("_k") <= k + 1).drop("_k")
        hits = subsets(left, "q", size).join(held, "h").filter("q <> memory").select(F.col("q").alias("a"), F.col("memory").alias("b"), F.lit(size).cast("long").alias("n"))
        both = hits.distinct() if found is None else hits.join(found, ["a", "b"], "left_anti").distinct().unionByName(found)
        found = pinned(both.withColumn("_k", F.row_number().over(Window.partitionBy("a").orderBy(F.col("n").desc(), "b"))).filter(F.col("_k") <= k).drop("_k"))
        if size > least:
            full = found.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
            left = pinned(own.join(full, F.col("q") == F.col("a"), "left_anti"))
            if left.isEmpty():
                break
    return found


def overlap_topk(queries: DataFrame, rows: DataFrame, key: str, tag: str, k: int, least: int) -> DataFrame:
    """a, b and n: for each key of ``queries`` the k other keys of ``rows`` with the most tags in common, ``least`` (1 at least) or more; ties by key.

    Rows may repeat; nulls are no tags. Tags are told apart by 64-bit hashes, subsets by sums of these.
    """
    value = F.when(F.col(tag).isNotNull(), F.xxhash64(tag))
    sets = lambda df, name: df.groupBy(F.col(key).alias(name)).agg(F.collect_set(value).alias("t")).filter(F.size("t") >= least)
    own, rows = pinned(sets(queries, "q")), pinned(sets(rows, "memory"))
    kinds = dict(own.dtypes)["q"], dict(rows.dtypes)["memory"]
    small = F.size("t") <= SMALL
    parts = [most_by_subsets(own.filter(small), rows.filter(small), k, least)]
    hard, wide = own.filter(~small), rows.filter(~small).withColumnRenamed("t", "mt")
    if not hard.isEmpty():
        parts.append(most_by_blocks(hard, rows.withColumnRenamed("t", "mt"), k, least, kinds))
    if not wide.isEmpty():
        parts.append(most_by_blocks(own.filter(small), wide, k, least, kinds))
    parts = [p for p in parts if p is not None]
    if parts:
        found = reduce(DataFrame.unionByName, parts)
    else:
        found = own.join(rows, F.lit(False)).select(F.col("q").alias("a"), F.col("memory").alias("b"), F.lit(0).cast("long").alias("n"))
    return found.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.col("n").desc(), "b"))).filter(F.col("k") <= k).drop("k")
