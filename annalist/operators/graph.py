"""Walks over edge tables by bounded rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators.dedup import pinned

#: Bits of the table that edges are looked up in before they are dealt out, at most.
MOST_BITS = 1 << 26


def neighbors(edges: DataFrame, node: DataFrame, direction: str = "both") -> DataFrame:
    """Neighbours of the nodes in ``node`` (column id): out, in, or both without repetition."""
    out = edges.join(node, F.col("src") == F.col("id")).select("id", F.col("dst").alias("neighbor"))
    back = edges.join(node, F.col("dst") == F.col("id")).select("id", F.col("src").alias("neighbor"))
    return {"out": out, "in": back}.get(direction, out.union(back).distinct())


def sifted(df: DataFrame, column: str, nodes: DataFrame, n: int) -> DataFrame:
    """``df`` without most rows whose ``column`` is not among the about ``n`` values of ``nodes`` (column node), before it is dealt out.

    The values set bits of a table of 16 bits a value, ``MOST_BITS`` at most (8 MB), which each task looks them up in; so
    some rows stay that a join will drop.
    """
    bits = min(MOST_BITS, max(1 << 10, 1 << (16 * n).bit_length()))
    place = f"pmod(xxhash64(%s), {bits}L)"
    held = nodes.selectExpr(place % "node" + " AS p").groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS INT)))").alias("b"))
    words = nodes.sparkSession.range(bits // 64).join(held, F.col("id") == F.col("w"), "left").select(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")).alias("x"))
    table = words.agg(F.sort_array(F.collect_list("x")).alias("x")).select(F.expr("x.b").alias("_words"))  # one row
    known = F.expr(f"getbit(_words[CAST(shiftright({place % column}, 6) AS INT)], CAST({place % column} % 64 AS INT)) = 1")
    return df.join(F.broadcast(table), known, "left_semi")


def fanned(rows: DataFrame) -> DataFrame:
    """id and the nodes (dst) of neighbouring rows of one id as an array, so that the id travels once with them; a batch of rows at most."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                ids = batch.column("id")
                other = pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
                start = np.flatnonzero(np.r_[True, other])
                ends = pa.array(np.r_[start, n], pa.int32())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(start)), pa.ListArray.from_arrays(ends, batch.column("dst"))], ["id", "dsts"])

    return rows.mapInArrow(run, f"id {kinds['id']}, dsts array<{kinds['dst']}>")


def distances(edges: DataFrame, start: DataFrame, depth: int, directed: bool = True) -> DataFrame:
    """id, node and least number of steps (0 to ``depth``). Edges and starts may repeat.

    Each round joins only the newest frontier with the edges that may leave it; edges are never made distinct. What is
    reached travels to its start in arrays, where it is made distinct and held against what is known. What is known after
    a round is a checkpoint, so plans don't grow with the depth, but not after the last; an empty frontier ends the walk.
    """
    ways = [edges.select("src", "dst")] + ([] if directed else [edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))])
    seen = frontier = start.select("id", F.col("id").alias("node"), F.lit(0).alias("steps")).distinct()
    for d in range(1, depth + 1):
        if (n := frontier.count()) == 0:
            break
        onward = reduce(DataFrame.union, [sifted(way, "src", frontier, n) for way in ways])
        reached = fanned(frontier.join(onward, F.col("node") == F.col("src")).select("id", "dst"))
        known = seen.select("id", F.array("node").alias("dsts"), "steps")
        rows = reached.withColumn("steps", F.lit(d)).unionByName(known).repartition("id").select("id", F.explode("dsts").alias("node"), "steps")
        seen = rows.groupBy("id", "node").agg(F.min("steps").alias("steps"))  # dealt out by id already
        if d < depth:
            seen = pinned(seen)
            frontier = seen.filter(F.col("steps") == d)
    return seen


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (column id) without an edge in either direction."""
    return nodes.join(edges, F.col("id") == F.col("src"), "left_anti").join(edges, F.col("id") == F.col("dst"), "left_anti")


def inherit_edges(edges: DataFrame, old: int, new: int, lineage: str) -> DataFrame:
    """All edges of ``old`` but lineage ones go to ``new``; loops and repetitions are dropped."""
    move = lambda c: F.when((F.col(c) == old) & (F.col("kind") != lineage), new).otherwise(F.col(c)).alias(c)
    return edges.select(move("src"), move("dst"), "kind").filter("src <> dst").dropDuplicates()


def paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """id, node, path (nodes on the way) and steps of the shortest paths of at most ``depth`` edges; ties by the smaller path.

    Each step joins the frontier with the edges; of the paths to a node one goes on, and a node that has been reached
    is not reached again, so no more than a row for each start and node is kept.
    """
    front = starts.select("id", F.col("id").alias("node"), F.array("id").alias("path"))
    found = front.withColumn("steps", F.lit(0))
    for step in range(1, depth + 1):
        onward = front.join(edges, F.col("node") == F.col("src")).select("id", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        front = onward.groupBy("id", "node").agg(F.min("path").alias("path")).join(found.select("id", "node"), ["id", "node"], "left_anti")
        found = found.unionByName(front.withColumn("steps", F.lit(step)))
    return found


def added(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, ...) and edges (src, dst, kind) after a batch: a new node takes the place of that of its id, an edge is there once.

    New edges with an end that no node has are left out; edges that were there stay. A batch brings an id once.
    """
    all_nodes = nodes.join(new_nodes.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti").unionByName(new_nodes)
    ids = all_nodes.select(F.col("id").alias("_end"))
    sound = new_edges.join(ids, F.col("src") == F.col("_end"), "left_semi").join(ids, F.col("dst") == F.col("_end"), "left_semi")
    return all_nodes, edges.select("src", "dst", "kind").unionByName(sound.select("src", "dst", "kind")).distinct()
