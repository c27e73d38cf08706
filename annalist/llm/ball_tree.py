"""Exact top-k by inner product: a ball tree in each shard, searched by branch and bound with a shared kth score.

1. Vectors are dealt to shards of bounded size by the nearest of a few pivots, so that a shard is a ball; a pivot with
   many vectors has many shards.
2. A task builds the tree of its shard; the nodes are a table in the shared folder.
3. A query first searches the shard whose ball has the highest upper bound. Its kth score then goes with it to the
   other shards: those whose bound is lower are never asked, and in the others the search begins with that score.

A node's bound is q.c + |q| r for its centre c and radius r. Nodes are visited from the highest bound down, until that
is below the kth score. Bounds are doubles with room for rounding; scores are exact integers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import column, drop_table, table
from annalist.llm.vectors import integers, matrix, packed, products, unpacked, widths

#: Vectors of a shard and of a leaf; pivots; queries that a task answers at once; shards whose balls it looks at.
SHARD_ROWS, LEAF_ROWS, PIVOTS, QUERY_BLOCK, ROOT_BLOCK = 2_048, 256, 64, 1_024, 4_096
#: Share of |q| (|c| + r) that is added to a bound for rounding.
ROOM = 1e-9

SHARD = ["width", "pivot", "part"]


def sharded(points: DataFrame) -> DataFrame:
    """``points`` (vec_id, v and a row number that stays) with the shard of each row: width, pivot, part.

    Pivots are the vectors of the least row hashes, one for each ``SHARD_ROWS`` rows and ``PIVOTS`` at most. A width of
    which no vector is a pivot has pivot -1.
    """
    some = points.count() // SHARD_ROWS + 1
    chosen = points.orderBy(F.xxhash64("row"), "row").limit(min(some, PIVOTS)).select("v").collect()
    pivots = {w: np.array([r["v"] for r in chosen if len(r["v"]) == w], np.float64) for w in {len(r["v"]) for r in chosen}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = column(batch, "v")
            own = widths(v).astype(np.int64)
            pivot = np.full(len(own), -1)
            for w in np.unique(own).tolist():
                at = np.flatnonzero(own == w)
                if w in pivots:
                    x = matrix(v.take(pa.array(at)), w).astype(np.float64)
                    pivot[at] = ((pivots[w] ** 2).sum(1) - 2 * x @ pivots[w].T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(pivot, pa.int32())], [*batch.schema.names, "width", "pivot"])

    placed = points.select("vec_id", "v", "row").mapInArrow(run, "vec_id long, v array<bigint>, row long, width int, pivot int")
    held = placed.filter("pivot >= 0").groupBy("width", "pivot").count().collect()  # at most one row a pivot
    parts = F.lit(some)
    for r in held:
        parts = F.when((F.col("width") == r["width"]) & (F.col("pivot") == r["pivot"]), F.lit(r["count"] // SHARD_ROWS + 1)).otherwise(parts)
    return placed.withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int")).drop("row")


def split(x: np.ndarray) -> list[tuple[int, int, np.ndarray, float, np.ndarray | None]]:
    """Nodes (left, right, centre, radius, rows of a leaf) of the ball tree of the rows of ``x``; the root is the first.

    A node is halved along the line between two rows far apart, so equal rows do no harm.
    """
    nodes: list = []
    work = [(np.arange(len(x)), -1, 0)]
    while work:
        at, above, side = work.pop()
        if above >= 0:
            nodes[above][side] = len(nodes)
        own = x[at]
        centre = own.mean(0)
        away = ((own - centre) ** 2).sum(1)
        leaf = len(at) <= LEAF_ROWS
        nodes.append([-1, -1, centre, float(np.sqrt(away.max())), at if leaf else None])
        if not leaf:
            first = own[away.argmax()]
            line = own[((own - first) ** 2).sum(1).argmax()] - first
            order = np.argpartition(own @ line, len(at) // 2)
            half = len(at) // 2
            here = len(nodes) - 1
            work += [(at[order[half:]], here, 1), (at[order[:half]], here, 0)]
    return nodes


NODES = "width int, pivot int, part int, node int, left int, right int, centre array<double>, radius double, ids array<bigint>, held binary"


def build(points: DataFrame) -> DataFrame:
    """The nodes of the trees of all shards, one row a node; leaves hold their ids and vectors."""

    def run(held: pa.Table) -> pa.Table:
        width = held.column("width")[0].as_py()
        x, ids = matrix(held.column("v"), width), held.column("vec_id").to_numpy()
        nodes = split(x.astype(np.float64))
        key = {k: pa.repeat(held.column(k)[0], len(nodes)) for k in SHARD}
        leaf = [n[4] for n in nodes]
        return pa.table(key | {
            "node": pa.array(range(len(nodes)), pa.int32()), "left": pa.array([n[0] for n in nodes], pa.int32()), "right": pa.array([n[1] for n in nodes], pa.int32()),
            "centre": pa.array([n[2] for n in nodes], pa.list_(pa.float64())), "radius": pa.array([n[3] for n in nodes], pa.float64()),
            "ids": pa.array([None if at is None else ids[at] for at in leaf], pa.list_(pa.int64())), "held": pa.array([None if at is None else packed(x[at]) for at in leaf], pa.binary()),
        })

    return sharded(points).groupBy(*SHARD).applyInArrow(run, NODES)


def bounds(asked: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of each query with what lies in each ball."""
    q, c = np.sqrt((asked**2).sum(1)), np.sqrt((centres**2).sum(1))
    return asked @ centres.T + q[:, None] * radii[None] + ROOM * q[:, None] * (c + radii)[None] + 1e-6


def descend(tree: dict, asked: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[list, list, list]:
    """Places of the queries, ids and scores of the k best rows of a tree for each query, of those at ``least`` or above.

    Rows with the query's own id are left out. Equal scores go to smaller ids.
    """
    reach = bounds(asked.astype(np.float64), tree["centres"], tree["radii"])
    places, found, scored = [], [], []
    for i in range(len(asked)):
        kth, ids, scores = int(least[i]), np.zeros(0, np.int64), np.zeros(0, np.int64)
        up, heap = reach[i], [(-reach[i, 0], 0)]
        while heap and -heap[0][0] >= kth:
            n = heapq.heappop(heap)[1]
            if tree["left"][n] >= 0:
                for child in (tree["left"][n], tree["right"][n]):
                    if up[child] >= kth:
                        heapq.heappush(heap, (-up[child], child))
                continue
            s = products(asked[i : i + 1], tree["held"][n])[0]
            fits = np.flatnonzero((s >= kth) & (tree["ids"][n] != own[i]))
            if len(fits):
                scores, ids = np.concatenate([scores, s[fits]]), np.concatenate([ids, tree["ids"][n][fits]])
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
                if len(scores) == k:
                    kth = max(kth, int(scores[-1]))
        places += [i] * len(ids)
        found += ids.tolist()
        scored += scores.tolist()
    return places, found, scored


def visited(asks: DataFrame, trees: DataFrame, blocks: int, k: int) -> DataFrame:
    """q, vec_id, score: ``asks`` (q, own, v, least and a shard) searched in the tree of that shard."""

    def run(asked: pa.Table, nodes: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = [], [], []
        if asked.num_rows and nodes.num_rows:
            nodes = nodes.sort_by("node")
            width = nodes.column("width")[0].as_py()
            left = nodes.column("left").to_pylist()
            tree = {
                "left": left, "right": nodes.column("right").to_pylist(), "centres": matrix(nodes.column("centre"), width), "radii": nodes.column("radius").to_numpy(),
                "ids": [np.array(x or [], np.int64) for x in nodes.column("ids").to_pylist()],
                "held": [None if b is None else unpacked(b, width) if width else np.zeros((len(i), 0), np.int64) for b, i in zip(nodes.column("held").to_pylist(), nodes.column("ids").to_pylist(), strict=True)],
            }
            out = descend(tree, matrix(asked.column("v"), width), asked.column("own").to_numpy(), asked.column("least").to_numpy(), k)
        return pa.table({"q": asked.column("q").take(pa.array(out[0], pa.int64())), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    key = [*SHARD, "qb"]
    left = asks.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    right = trees.join(asks.select(SHARD).distinct(), SHARD, "left_semi").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "q long, vec_id long, score long")


def routed(asks: DataFrame, roots: DataFrame, blocks: int, shards: int, best: bool) -> DataFrame:
    """``asks`` (q, own, v, least) with the shards that a query has to visit: those whose ball reaches its ``least``.

    With ``best`` only the one with the highest bound of each block of shards.
    """

    def run(asked: pa.Table, balls: pa.Table) -> pa.Table:
        places, to, reach = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        mine, theirs = (np.array(t.column("width").to_pylist(), np.int64) for t in (asked, balls))
        for w in np.intersect1d(mine, theirs).tolist():
            a, b = np.flatnonzero(mine == w), np.flatnonzero(theirs == w)
            up = bounds(matrix(asked.column("v").take(pa.array(a)), w).astype(np.float64), matrix(balls.column("centre").take(pa.array(b)), w), balls.column("radius").to_numpy()[b])
            i, j = (np.arange(len(a)), up.argmax(1)) if best else np.nonzero(up >= asked.column("least").to_numpy()[a][:, None])
            places.append(a[i])
            to.append(b[j])
            reach.append(up[i, j])
        at, to_ = pa.array(np.concatenate(places)), pa.array(np.concatenate(to))
        return pa.table({n: asked.column(n).take(at) for n in ("q", "own", "v", "least")} | {n: balls.column(n).take(to_) for n in SHARD} | {"reach": pa.array(np.concatenate(reach))})

    n = shards // ROOT_BLOCK + 1
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = asks.withColumn("width", F.size("v")).withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("rb", each(n))
    right = roots.withColumn("rb", F.pmod(F.xxhash64(*SHARD), F.lit(n)).cast("int")).withColumn("qb", each(blocks))
    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(run, "q long, own long, v array<bigint>, least long, width int, pivot int, part int, reach double")


def topk(queries: DataFrame, points: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows of ``points`` with the highest integer inner products.

    Components become floor(scale * x). Ties go to the smaller vec_id. Rows without an id, a vector or a finite
    component take no part, as query or as candidate. Rows that have the query's id are not its candidates. Otherwise
    each row is a candidate of its own, repeated ones too; equal query rows ask once. Vectors of another width than
    the query's are no candidates; empty vectors have score 0 with each other. Fewer candidates than k: all of them.
    An empty table gives an empty one. Scores beyond the range of a long stay at its end.
    """
    held = table(integers(points, scale, id_col, vector).withColumn("row", F.monotonically_increasing_id()), "ball-points")
    asks = integers(queries, scale, id_col, vector).dropDuplicates().withColumnRenamed("vec_id", "own")
    asks = table(asks.withColumn("q", F.monotonically_increasing_id()).withColumn("least", F.lit(-(1 << 63)).cast("long")), "ball-queries")
    trees = table(build(held), "ball-trees")
    roots = trees.filter("node = 0").select(*SHARD, "centre", "radius")
    blocks, shards = asks.count() // QUERY_BLOCK + 1, roots.count()

    home = routed(asks, roots, blocks, shards, best=True).withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.col("reach").desc(), *SHARD))).filter("k = 1").drop("k", "reach")
    home = table(home, "ball-home")
    first = table(visited(home, trees, blocks, k), "ball-first")
    kth = first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k).select("q", "kth")
    shared = asks.join(kth, "q", "left").withColumn("least", F.coalesce("kth", "least")).drop("kth")
    rest = routed(shared, roots, blocks, shards, best=False).drop("reach").join(home.select("q", *SHARD), ["q", *SHARD], "left_anti")
    rest = table(visited(rest, trees, blocks, k), "ball-rest")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    out = first.union(rest).withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    out = table(out.join(asks.select("q", F.col("own").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score"), "ball-result")
    for done in (held, asks, trees, home, first, rest):
        drop_table(done)
    return out


#: The rows that take part, their components as whole numbers held in doubles.
KEPT = """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)"""


def oracle(k: int = 5, every: int = 50) -> str:
    return f"""
WITH {KEPT.format(scale=256)},
asks AS (SELECT DISTINCT vec_id, v FROM kept WHERE vec_id % {every} = 0),
pairs AS (SELECT q.vec_id AS query_id, q.v, c.vec_id, CAST(CASE WHEN len(q.v) = 0 THEN 0 ELSE list_inner_product(q.v, c.v) END AS BIGINT) AS score
  FROM asks q JOIN kept c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""
