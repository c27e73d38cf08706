"""Vector search by blocks: exact top-k without a row for each pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators import pairing
from annalist.operators.overlap import overlap_topk  # noqa: F401
from annalist.operators.pairing import inside

#: Queries and memories that one task multiplies.
QUERY_BLOCK, MEMORY_BLOCK = 1_024, 8_192


def cosine(a: Column, b: Column, eps: float = 1e-10) -> Column:
    """Cosine of two arrays, in double precision; null where one is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + eps)


def unit(rows: pa.Array) -> np.ndarray:
    """Vectors of one width as rows of length 1."""
    out = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def top(score: np.ndarray, names: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores among those that fit; ties by name."""
    keep = np.flatnonzero(fits)
    if len(keep) > 4 * k:
        own = score[keep]
        keep = keep[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return keep[np.lexsort((names[keep], -score[keep]))[:k]]


def blocks(queries: DataFrame, rows: DataFrame, query_block: int = QUERY_BLOCK, memory_block: int = MEMORY_BLOCK):
    """Cogroups of a block of queries (column q) and one of rows (column memory), each pair of blocks once."""
    n_query, n_memory = queries.count() // query_block + 1, rows.count() // memory_block + 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(n_query)).cast("int")).withColumn("mb", each(n_memory))
    right = rows.withColumn("mb", F.pmod(F.xxhash64("memory"), F.lit(n_memory)).cast("int")).withColumn("qb", each(n_query))
    return left.groupBy("qb", "mb").cogroup(right.groupBy("qb", "mb"))


def topk(
    queries: DataFrame, memories: DataFrame, k: int, query_id: str = "query_id", memory_id: str = "memory_id", vector: str = "embedding", threshold: float | None = None, exclude_self: bool = False, not_later: bool = False
) -> DataFrame:
    """query, memory, score (cosine to 9 places) and rank of the k best memories; ties by memory id.

    Blocks of queries meet blocks of memories as these lie, so no pair of vectors is a row, none is copied on disk and
    nothing passes through the driver; a task keeps k rows for each of its queries over all its blocks. Null vectors
    never rank. A threshold applies before the cut, and so does ``not_later``, which leaves a query only memories whose
    id is not above its own; blocks are then ranges of ids, and those that are all later don't meet.
    """
    own = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).filter("v IS NOT NULL")
    rows = memories.select(F.col(memory_id).alias("memory"), F.col(vector).alias("mv")).filter("mv IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind = {}, None
        for batch in batches:
            kind = batch.column("memory").type.value_type
            for row in range(batch.num_rows):
                number = batch.column("block")[row].as_py()
                if number not in held:
                    found = pairing.Best(inside(batch, "q", row), k, -np.inf if threshold is None else threshold)
                    held[number] = found, pairing.plain(found.ids), unit(inside(batch, "v", row))
                found, ids, asked = held[number]
                names, other = pairing.plain(inside(batch, "memory", row)), unit(inside(batch, "mv", row))
                for lo in range(0, len(ids), 256):
                    scores = asked[lo : lo + 256] @ other.T
                    fits = np.ones(scores.shape, bool)
                    if exclude_self:
                        fits &= names != ids[lo : lo + 256, None]
                    if not_later:
                        fits &= names <= ids[lo : lo + 256, None]
                    at, to = found.sift(scores, fits, lo, 1e-9)
                    score = np.round(scores[at, to], 9)
                    keep = score >= found.least
                    if keep.any():
                        found.add(at[keep] + lo, score[keep], names[to[keep]])
        for found, _, _ in held.values():
            yield found.batch(["query", "memory", "score"], kind)

    kinds = own.schema["q"].dataType.simpleString(), rows.schema["memory"].dataType.simpleString()
    pairs = pairing.met(own, rows, "q" if not_later else None, read_often=True)
    if not_later:
        pairs = pairs.filter(F.array_min("memory") <= F.array_max("q"))
    found = pairs.mapInArrow(run, f"query {kinds[0]}, memory {kinds[1]}, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "memory"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def centroid(df: DataFrame, group: str, vector: str = "embedding", weight: Column | None = None) -> DataFrame:
    """Mean (or weighted mean) of the vectors of each group, place by place."""
    w = F.lit(1.0) if weight is None else weight
    parts = df.select(group, w.alias("w"), F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("x"))
    return parts.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centroid"))


def matrix(df: DataFrame, group: str, id_col: str, vector: str = "embedding") -> DataFrame:
    """All cosines (to 6 places) of the vectors of each group, which is one retrieved set; a zero vector has cosine 0."""

    def run(held: pa.Table) -> pa.Table:
        x = unit(held.column("v").combine_chunks())
        sim = np.round(x @ x.T, 6)
        n = len(x)
        a, b = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
        return pa.table({"g": held.column("g").take(pa.array(a)), "a": held.column("i").take(pa.array(a)), "b": held.column("i").take(pa.array(b)), "sim": pa.array(sim.ravel())})

    rows = df.select(F.col(group).alias("g"), F.col(id_col).alias("i"), F.col(vector).alias("v")).filter("v IS NOT NULL")
    kinds = dict(rows.dtypes)
    return rows.groupBy("g").applyInArrow(run, f"g {kinds['g']}, a {kinds['i']}, b {kinds['i']}, sim double").withColumnRenamed("g", group)


def diverse(df: DataFrame, group: str, id_col: str, bar: float, vector: str = "embedding") -> DataFrame:
    """In order of id, the vectors of each group whose cosine (to 9 places) with no taken one is above the bar."""

    def run(held: pa.Table) -> pa.Table:
        ids = np.array(held.column("i").to_pylist())
        order = np.argsort(ids)
        x = unit(held.column("v").combine_chunks())
        taken: list[int] = []
        for i in order.tolist():
            if not taken or np.round(x[taken] @ x[i], 9).max() <= bar:
                taken.append(i)
        return pa.table({"g": held.column("g").take(pa.array(taken)), "i": held.column("i").take(pa.array(taken))})

    rows = df.select(F.col(group).alias("g"), F.col(id_col).alias("i"), F.col(vector).alias("v")).filter("v IS NOT NULL")
    kinds = dict(rows.dtypes)
    return rows.groupBy("g").applyInArrow(run, f"g {kinds['g']}, i {kinds['i']}").select(F.col("g").alias(group), F.col("i").alias(id_col))
