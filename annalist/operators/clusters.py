"""Recursive clustering of every group's vectors, level by level for all groups at once, and the tree that it plants.

A cluster of more than ``LARGEST`` rows is divided by k-means until none is left. One job divides all clusters that are
too large for a task; their centres are a table. What fits in a task is divided to the end there, by the same rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators.dedup import pinned

#: Rows of a cluster at most, and rows above which one is kept; children of a division at most; rounds of k-means.
LARGEST, SMALLEST, FANOUT, ROUNDS = 20, 10, 16, 5
#: Centres are fitted on the rows of a cluster with the least hashes, so many at most; a cluster of so many rows is one task.
FIT_ROWS = 4_096
#: Rows of a larger cluster that meet its centres in one task.
PART_ROWS = 8_192
#: Components become floor(SCALE * x), so that sums are exact and the same in any order.
SCALE = 1_024.0

STATE = "grp {g}, id {i}, h long, path string, x array<bigint>, own long, other long"


def away(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number vectors (components below 2^22)."""
    a, c = x.astype(np.float64), centres.astype(np.float64)
    return ((a * a).sum(1)[:, None] - 2 * a @ c.T + (c * c).sum(1)[None]).astype(np.int64)


def fit(x: np.ndarray, k: int) -> np.ndarray:
    """Centres of the rows of ``x``, which come in order of hash: the first k, then ``ROUNDS`` times the floor of the mean of what is nearest."""
    centres = x[:k].copy()
    for _ in range(ROUNDS):
        near = away(x, centres).argmin(1)
        for c in range(k):
            own = x[near == c]
            if len(own):
                centres[c] = own.sum(0) // len(own)
    return centres


def fanout(n: int, n_vectors: int) -> int:
    return min(n_vectors, -(-n // LARGEST), FANOUT)


def placed(x: np.ndarray, h: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Child of each row, the distance to its centre and to the nearest other one."""
    far = away(x, centres)
    child = far.argmin(1)
    own = far[np.arange(len(x)), child]
    far[np.arange(len(x)), child] = np.iinfo(np.int64).max
    return child, own, far.min(1, initial=np.iinfo(np.int64).max)


def by_hash(h: np.ndarray, level: int, k: int) -> np.ndarray:
    """Children of rows that no centre tells apart."""
    return ((h.astype(np.uint64) >> np.uint64(4 * (level % 16))) & np.uint64(15)).astype(np.int64) % k


def divide(x: np.ndarray, has: np.ndarray, h: np.ndarray, path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Paths of the final clusters of the rows below ``path``, and the distances of the last division. Rows come in order of hash."""
    paths, own, other = [path] * len(h), np.full(len(h), -1, np.int64), np.full(len(h), -1, np.int64)
    work = [(np.arange(len(h)), path)]
    while work:
        at, here = work.pop()
        with_x = at[has[at]]
        for i in at.tolist():
            paths[i] = here
        if len(at) <= LARGEST or len(with_x) < SMALLEST or len(here) > 64:
            continue
        k = fanout(len(at), len(with_x))
        child = np.zeros(len(h), np.int64)
        child[with_x], own[with_x], other[with_x] = placed(x[with_x], h[with_x], fit(x[with_x][:FIT_ROWS], k))
        sizes = np.bincount(child[with_x], minlength=k)
        if (sizes > 0).sum() < 2:
            child[with_x], own[with_x], other[with_x] = by_hash(h[with_x], len(here), k), -1, -1
            sizes = np.ones(1)
        child[at[~has[at]]] = sizes.argmax()
        work += [(at[child[at] == c], here + f"{c:x}") for c in range(k) if (child[at] == c).any()]
    return paths, own, other


def filled(x: pa.ChunkedArray, has: np.ndarray) -> np.ndarray:
    """Vectors as a matrix; rows without one are zeros."""
    some = x.combine_chunks().drop_null()
    width = len(some[0]) if len(some) else 0
    out = np.zeros((len(has), width), np.int64)
    if width:
        out[has] = some.flatten().to_numpy().reshape(-1, width)
    return out


def partition(df: DataFrame, group: str, id_col: str, vector: str, seed: int = 42) -> DataFrame:
    """grp, id, cluster, n (rows of the cluster), own and other: the clusters of each group that are kept.

    Clusters have ``LARGEST`` rows at most; those of ``SMALLEST`` or fewer are left out, but a group that small is one
    cluster. ``own`` is the squared distance to the centre of the last division, ``other`` that to the nearest of its
    siblings (null where there was none). Of a repeated id of a group one row stays; rows with a null id are left out.
    Rows without a vector go with the largest child, or the first where hashes decide; a cluster with fewer than ``SMALLEST`` vectors is not divided.
    The vectors of a group have one width and finite components. The seed alone decides; layout doesn't.
    """
    kinds = dict(df.dtypes)
    schema = STATE.format(g=kinds[group], i=kinds[id_col])
    x = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(F.lit(SCALE) * c).cast("long"))
    rows = df.select(F.col(group).alias("grp"), F.col(id_col).alias("id"), x.alias("x")).filter("id IS NOT NULL").groupBy("grp", "id").agg(F.max("x").alias("x"))
    now = pinned(rows.select("grp", "id", F.xxhash64(F.lit(seed), "id").alias("h"), F.lit("").alias("path"), "x", F.lit(-1).cast("long").alias("own"), F.lit(-1).cast("long").alias("other")))
    key, done = ["grp", "path"], None

    def finish(held: pa.Table) -> pa.Table:
        held = held.sort_by([("h", "ascending"), ("id", "ascending")])
        has = held.column("x").is_valid().to_numpy()
        paths, own, other = divide(filled(held.column("x"), has), has, held.column("h").to_numpy(), held.column("path")[0].as_py())
        old = held.column("own").to_numpy(), held.column("other").to_numpy()
        same = np.array([p == q for p, q in zip(paths, held.column("path").to_pylist(), strict=True)], bool)
        return pa.table({"grp": held.column("grp"), "id": held.column("id"), "path": pa.array(paths, pa.string()), "own": pa.array(np.where(same, old[0], own)), "other": pa.array(np.where(same, old[1], other))})

    while True:
        sizes = now.groupBy(*key).agg(F.count("*").alias("n"), F.count("x").alias("n_x"))
        large = pinned(sizes.filter((F.col("n") > FIT_ROWS) & (F.col("n_x") >= SMALLEST)).withColumn("k", F.least("n_x", F.ceil(F.col("n") / LARGEST), F.lit(FANOUT)).cast("int")))
        small = now.join(large.select(*(F.col(c).alias("_" + c) for c in key)), F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("path") == F.col("_path")), "left_anti")
        out = small.groupBy(*key).applyInArrow(finish, f"grp {kinds[group]}, id {kinds[id_col]}, path string, own long, other long")
        if large.isEmpty():
            done = out if done is None else done.union(out)
            break
        out = pinned(out)
        done = out if done is None else done.union(out)
        now = pinned(level(now, large, schema))
    n = F.count("*").over(Window.partitionBy("grp", "cluster"))
    named = done.select("grp", "id", F.col("path").alias("cluster"), *(F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in ("own", "other"))).withColumn("n", n)
    return named.filter((F.col("n") > SMALLEST) | (F.col("cluster") == "")).select("grp", "id", "cluster", "n", "own", "other")


def level(now: DataFrame, large: DataFrame, schema: str) -> DataFrame:
    """The rows of the clusters of ``large`` (grp, path, n, k), each one level further down."""
    tied = F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("path") == F.col("_path"))
    rows = now.join(large.select(F.col("grp").alias("_grp"), F.col("path").alias("_path"), "n", "k"), tied).drop("_grp", "_path")
    first = Window.partitionBy("grp", "path").orderBy("h", "id")
    some = rows.filter("x IS NOT NULL").withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= FIT_ROWS)

    def centred(held: pa.Table) -> pa.Table:
        held = held.sort_by([("h", "ascending"), ("id", "ascending")])
        c = fit(filled(held.column("x"), np.ones(held.num_rows, bool)), held.column("k")[0].as_py())
        return pa.table({"grp": held.column("grp").slice(0, 1), "path": held.column("path").slice(0, 1), "n": held.column("n").slice(0, 1), "centres": pa.array([c.tolist()], pa.list_(pa.list_(pa.int64())))})

    grp = schema.split(",")[0]
    centres = pinned(some.groupBy("grp", "path").applyInArrow(centred, f"{grp}, path string, n long, centres array<array<bigint>>"))
    parts = lambda n: (F.floor(F.col(n) / PART_ROWS) + 1).cast("int")
    left = rows.withColumn("part", F.pmod(F.col("h"), parts("n")).cast("int"))
    right = centres.withColumn("part", F.explode(F.sequence(F.lit(0), parts("n") - 1)))

    def run(held: pa.Table, found: pa.Table) -> pa.Table:
        has = held.column("x").is_valid().to_numpy()
        child, own, other = (np.full(len(has), -1, np.int64) for _ in range(3))
        if has.any():
            x, h = filled(held.column("x"), has), held.column("h").to_numpy()
            child[has], own[has], other[has] = placed(x[has], h[has], np.array(found.column("centres")[0].as_py(), np.int64))
        return pa.table({n: held.column(n) for n in ("grp", "id", "h", "path", "x")} | {"own": pa.array(own), "other": pa.array(other), "k": held.column("k"), "child": pa.array(child)})

    moved = pinned(left.groupBy("grp", "path", "part").cogroup(right.groupBy("grp", "path", "part")).applyInArrow(run, schema + ", k int, child long"))
    sizes = moved.filter("child >= 0").groupBy("grp", "path", "child").count()
    most = sizes.groupBy(F.col("grp").alias("_grp"), F.col("path").alias("_path")).agg(F.count("*").alias("kinds"), F.min_by("child", F.struct(-F.col("count"), F.col("child"))).alias("largest"))
    joined = moved.join(most, tied)
    depth = F.length("path") % 16
    nibble = F.coalesce(*(F.when(depth == d, F.pmod(F.shiftrightunsigned("h", 4 * d).bitwiseAND(F.lit(15)), F.col("k"))) for d in range(16)))
    alone = F.col("kinds") == 1
    child = F.when(F.col("child") < 0, F.when(alone, F.lit(0)).otherwise(F.col("largest"))).when(alone, nibble).otherwise(F.col("child"))
    plain = lambda c: F.when(alone, F.lit(-1).cast("long")).otherwise(F.col(c))
    return joined.select("grp", "id", "h", F.concat("path", F.lower(F.hex(child))).alias("path"), "x", plain("own").alias("own"), plain("other").alias("other"))


def reorganized(nodes: DataFrame, edges: DataFrame, group: str, id_col: str, vector: str, least: int = 20) -> DataFrame:
    """grp, parent, child, n: the parents that one run of the reorganiser plants over nodes without an edge.

    Groups with fewer than ``least`` such nodes are left alone; the nodes of the others are partitioned, and each kept
    cluster gets a parent, whose id is a digest of its group and place. What a parent says is left to a caller's model.
    """
    ends = edges.select(F.col("src").alias("_end")).union(edges.select("dst")).distinct()
    free = nodes.join(ends, F.col(id_col) == F.col("_end"), "left_anti")
    enough = free.groupBy(F.col(group).alias("_grp")).count().filter(F.col("count") >= least).select("_grp")
    found = partition(free.join(enough, F.col(group).eqNullSafe(F.col("_grp")), "left_semi"), group, id_col, vector)
    return found.select("grp", F.md5(F.concat_ws(":", F.col("grp").cast("string"), "cluster").cast("binary")).alias("parent"), F.col("id").alias("child"), "n")
