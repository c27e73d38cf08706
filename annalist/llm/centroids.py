"""Centroid clustering with Drake's adaptive bounds.

Each vector keeps an upper bound of its distance to its centroid, lower bounds to its several nearest other centroids,
and one lower bound to all the remaining ones. A round moves the bounds by what the centroids moved. Where they still
put the own centroid first, nothing is computed. Else the exact distance to the own centroid may settle it, then exact
distances to the listed centroids, and only if the remainder bound is in the way all centroids are scanned. The list
shrinks to the places that a round needed, once no vector needs more than it holds.

The state is a table in the shared folder, written anew each round. Sums are exact whole numbers, kept by adding what
changed its cluster. What reaches the driver is a row for each cluster and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import column, drop_table, table
from annalist.llm.vectors import distances, integers, matrix, most

#: Listed centroids at first, as a share of all: one in so many, two at least.
LISTED = 4
#: Room for rounding, as a share of a bound.
ROOM = 1e-9

STATE = "vec_id long, v array<bigint>, cluster int, was int, upper double, near array<int>, lows array<double>, rest double, used int, distance long"


def above(x: np.ndarray) -> np.ndarray:
    return x * (1 + ROOM) + ROOM


def below(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * (1 - ROOM) - ROOM, 0.0)


def scan(x: np.ndarray, centres: np.ndarray, listed: int) -> tuple[np.ndarray, ...]:
    """Cluster, upper, near, lows and rest from the distances to all centroids; ties go to the smaller number."""
    far = distances(x, centres)
    order = np.argsort(far, axis=1, kind="stable")
    root = np.sqrt(np.take_along_axis(far, order, 1).astype(np.float64))
    rest = below(root[:, listed + 1]) if len(centres) > listed + 1 else np.full(len(x), np.inf)
    return order[:, 0], above(root[:, 0]), order[:, 1 : listed + 1], below(root[:, 1 : listed + 1]), rest


def listed_distances(x: np.ndarray, centres: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Squared distances of each row to its own listed centroids only."""
    out = np.empty(near.shape, np.int64)
    for c in np.unique(near).tolist():
        i, j = np.nonzero(near == c)
        out[i, j] = distances(x[i], centres[c : c + 1])[:, 0]
    return out


def moved(x: np.ndarray, state: dict, centres: np.ndarray, shift: np.ndarray) -> dict:
    """The state after the centroids moved by at most ``shift``; ``used`` is the last place of the list that was needed, or one more for a scan."""
    cluster, near, listed = state["cluster"].copy(), state["near"].copy(), state["near"].shape[1]
    upper, lows, rest = above(state["upper"] + shift[cluster]), below(state["lows"] - shift[near]), below(state["rest"] - shift.max(initial=0.0))
    used = np.zeros(len(x), np.int32)
    least = np.minimum(lows.min(1, initial=np.inf), rest)
    open_ = np.flatnonzero(upper >= least)
    if len(open_):
        d = np.empty(len(open_), np.int64)
        for c in np.unique(cluster[open_]).tolist():
            at = cluster[open_] == c
            d[at] = distances(x[open_[at]], centres[c : c + 1])[:, 0]
        upper[open_] = above(np.sqrt(d.astype(np.float64)))
        still = upper[open_] >= least[open_]
        open_, d = open_[still], d[still]
    if len(open_):
        far = listed_distances(x[open_], centres, near[open_])
        both, names = np.column_stack([d, far]), np.column_stack([cluster[open_], near[open_]])
        order = np.lexsort((names, both))
        both, names = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        root = np.sqrt(both.astype(np.float64))
        settled = above(root[:, 0]) < rest[open_]
        at = open_[settled]
        # the place of the last listed bound that was not above the exact distance to the own centroid
        asked = lows[at] <= upper[at][:, None]
        used[at] = np.where(asked.any(1), listed - asked[:, ::-1].argmax(1), 0) if listed else 0
        cluster[at], upper[at], near[at], lows[at] = names[settled, 0], above(root[settled, 0]), names[settled, 1:], below(root[settled, 1:])
        at = open_[~settled]
        if len(at):
            cluster[at], upper[at], near[at], lows[at], rest[at] = scan(x[at], centres, listed)
            used[at] = listed + 1
    return {"cluster": cluster, "upper": upper, "near": near, "lows": lows, "rest": rest, "used": used}


def step(df: DataFrame, centres: np.ndarray, shift: np.ndarray | None, listed: int, last: bool) -> DataFrame:
    """The next state of ``df``: the first one (without ``shift``) from scans of all, later ones by bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda n: column(batch, n)  # noqa: B023, E731
            x = matrix(get("v"), centres.shape[1])
            if shift is None:
                was = np.full(len(x), -1)
                new = dict(zip(("cluster", "upper", "near", "lows", "rest"), scan(x, centres, listed), strict=True)) | {"used": np.full(len(x), listed + 1)}
            else:
                was = get("cluster").to_numpy()
                held = len(get("near")[0])
                old = {"cluster": was, "upper": get("upper").to_numpy(), "near": matrix(get("near"), held), "lows": matrix(get("lows"), held), "rest": get("rest").to_numpy()}
                if listed < held:
                    old |= {"near": old["near"][:, :listed], "lows": old["lows"][:, :listed], "rest": np.minimum(old["rest"], old["lows"][:, listed:].min(1))}
                new = moved(x, old, centres, shift)
            d = np.zeros(len(x), np.int64)
            if last:
                for c in np.unique(new["cluster"]).tolist():
                    at = new["cluster"] == c
                    d[at] = distances(x[at], centres[c : c + 1])[:, 0]
            n = new["near"].shape[1]
            lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n, pa.int32()), pa.array(a.ravel(), kind))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [get("vec_id"), get("v"), pa.array(new["cluster"], pa.int32()), pa.array(was, pa.int32()), pa.array(new["upper"], pa.float64()), lists(new["near"], pa.int32()), lists(new["lows"], pa.float64()), pa.array(new["rest"], pa.float64()), pa.array(new["used"], pa.int32()), pa.array(d)],
                [f.split()[0] for f in STATE.split(", ")],
            )

    return df.mapInArrow(run, STATE)


def changes(state: DataFrame, width: int) -> dict[tuple[int, int], int]:
    """By cluster and component what its sum gained in the last round; component -1 is the number of vectors.

    Each task sums what it reads; a row for each cluster and component is left for the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        for batch in batches:
            x = matrix(column(batch, "v"), width)
            x = x.astype(object) if most(x) * max(len(x), 1) >= 2.0**62 else x
            for name, sign in (("cluster", 1), ("was", -1)):
                names = column(batch, name).to_numpy()
                for c in np.unique(names[names >= 0]).tolist():
                    own = x[names == c]
                    for pos, s in enumerate([len(own), *own.sum(0).tolist()], -1):
                        sums[c, pos] = sums.get((c, pos), 0) + sign * int(s)
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([Decimal(sums[k]) for k in keys], pa.decimal128(38, 0))], ["cluster", "pos", "gain"])

    parts = state.filter("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "cluster int, pos int, gain decimal(38,0)")
    return {(r["cluster"], r["pos"]): int(r["gain"]) for r in parts.groupBy("cluster", "pos").agg(F.sum("gain").alias("gain")).collect()}


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding", scans: list | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The vectors with exactly ``width`` components, none null or non-finite, are kept; a component becomes
    floor(scale * x). Centroids start as the k vectors with the smallest sha256 of ``<seed>:<vec_id>`` (ties by the
    vector; all of them if they are fewer). A round assigns each vector to the nearest centroid (squared distance,
    ties to the smaller number) and replaces each centroid that has vectors by the floor of their mean, place by place.
    At the end vectors are assigned once more. Rounds that would change nothing are left out.

    Repeated rows count each by itself. Rows without an id or vector take no part. An empty table gives an empty one.
    Distances beyond the range of a long stay at its end. ``scans`` gets the number of vectors that scanned all
    centroids in each round.
    """
    points = integers(df, scale, id_col, vector).filter(F.size("v") == width)
    points = table(points, "centroids-points")
    first = points.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256), "v").limit(k).collect()
    k = len(first)
    if not k:
        centres = np.zeros((1, width), np.int64)
    else:
        centres = np.array([r["v"] for r in first], np.int64)
    listed = min(max(2, -(-k // LISTED)), max(k - 1, 0))
    sums, sizes = [[0] * width for _ in range(k)], [0] * k
    state, shift = points, None
    for nth in range(rounds + 1):
        after = table(step(state, centres, shift, listed, nth == rounds), "centroids-state")
        drop_table(state)
        state = after
        if scans is not None:
            scans.append(state.filter(F.col("used") == listed + 1).count())
        if nth == rounds:
            break
        for (c, pos), gain in changes(state, width).items():
            if pos < 0:
                sizes[c] += gain
            else:
                sums[c][pos] += gain
        new = np.array([[s // n for s in own] if n else was.tolist() for own, n, was in zip(sums, sizes, centres, strict=True)], np.int64) if k else centres
        if (new == centres).all():  # a fixed point: the assignment at hand is the last one
            after = table(step(state, centres, np.zeros(len(centres)), listed, True), "centroids-state")
            drop_table(state)
            state = after
            break
        shift = above(np.sqrt(((new - centres).astype(np.float64) ** 2).sum(1)))
        needed = state.agg(F.max("used")).first()[0] if nth else listed
        centres, listed = new, max(min(listed, needed), min(1, listed))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    by = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row a cluster
    held = lambda s: int(min(s, (1 << 63) - 1))
    own = {r["cluster"]: held(r["s"]) for r in by}
    pick = F.array(*(F.struct(F.lit(own.get(c, 0)).cast("long").alias("s"), F.lit(d).alias("sha")) for c, d in enumerate(digests)))[F.col("cluster")]
    return state.select("vec_id", "cluster", "distance", pick["s"].alias("cluster_inertia"), F.lit(held(sum(r["s"] for r in by))).cast("long").alias("inertia"), pick["sha"].alias("centroid_sha256"))


def oracle(k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64, scale: int = 1024) -> str:
    """The same result from plain assignments to all centroids, round by round."""
    parts = [f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c FROM (SELECT vec_id, v FROM kept ORDER BY sha256('{seed}:' || vec_id), v LIMIT {k}))"]
    for n in range(rounds + 1):
        away = "list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)"
        parts.append(f"a{n} AS MATERIALIZED (SELECT vec_id, v, min_by(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT vec_id, v, row_id, cluster, {away} AS d FROM (SELECT *, row_number() OVER () AS row_id FROM kept), c{n}) GROUP BY row_id, vec_id, v)")
        if n < rounds:
            parts.append(f"""c{n + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(s.c, o.c) AS c FROM c{n} o LEFT JOIN (
  SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, floor(sum(v[i]) / count(*)) AS m FROM a{n}, range(1, {width + 1}) t(i) GROUP BY cluster, i) GROUP BY cluster) s ON s.cluster = o.cluster)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, a.cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(o.c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} o ON o.cluster = a.cluster"""  # fmt: skip
