"""Folds by key whose state is a table of its own, over rows streamed in order."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

OUT_ROWS = 5_000


def folded(df: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], list[tuple]], schema: str, finish: Callable[[Any, Any], list[tuple]] | None = None) -> DataFrame:
    """Rows of ``step(state, row)`` for each row of a key in order, then those of ``finish(key, state)``.

    Each key starts anew from ``start()``. A task streams its sorted partition, so it holds one key's state and a batch
    of rows, however long a key's history is. Such a fold is sequential by nature: a key is the work of one task.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rows, begun = None, None, [], False
        for batch in batches:
            for row in batch.to_pylist():
                if not begun or row[key] != now:
                    if begun and finish is not None:
                        rows += finish(now, state)
                    now, state, begun = row[key], start(), True
                rows += step(state, row)
                if len(rows) >= OUT_ROWS:
                    yield table(rows)
                    rows = []
        if begun and finish is not None:
            rows += finish(now, state)
        if rows:
            yield table(rows)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


class Values:
    """The learned values of one user's memories: q, visits, moving mean of rewards and last reward of each.

    A reward r moves a memory to (1 - alpha) q + alpha (r + gamma m), m the highest q of all the user's memories before
    it (0 without any), and not below ``floor``. The highest is kept in a heap; entries that no longer hold are skipped.
    """

    def __init__(self, alpha: float, gamma: float, first: float, floor: float | None) -> None:
        self.alpha, self.gamma, self.first, self.floor = alpha, gamma, first, floor
        self.held: dict[Any, tuple[float, int, float, float]] = {}
        self.top: list[tuple[float, Any]] = []

    def highest(self) -> float:
        while self.top and self.held[self.top[0][1]][0] != -self.top[0][0]:
            heapq.heappop(self.top)
        return -self.top[0][0] if self.top else 0.0

    def reward(self, memory: Any, r: float) -> None:
        q, visits, mean, _ = self.held.get(memory, (self.first, 0, 0.0, 0.0))
        q = (1 - self.alpha) * q + self.alpha * (r + self.gamma * self.highest())
        q = q if self.floor is None else max(self.floor, q)
        self.held[memory] = (q, visits + 1, (1 - self.alpha) * mean + self.alpha * r, r)
        heapq.heappush(self.top, (-q, memory))


def learned_values(df: DataFrame, alpha: float, gamma: float, first: float = 0.0, floor: float | None = None) -> DataFrame:
    """user_id, memory_id, q, visits, reward_mean, last_reward after all rewards (user_id, ord, memory_id, reward) in order.

    Rows without a memory or a reward change nothing; ties in ``ord`` go by memory, then reward.
    """

    def step(values: Values, row: dict) -> list[tuple]:
        values.reward(row["memory_id"], row["reward"])
        return []

    def finish(user: Any, values: Values) -> list[tuple]:
        return [(user, m, *held) for m, held in values.held.items()]

    kinds = dict(df.dtypes)
    rows = df.select("user_id", "ord", "memory_id", F.col("reward").cast("double").alias("reward")).filter("memory_id IS NOT NULL AND reward IS NOT NULL")
    schema = f"user_id {kinds['user_id']}, memory_id {kinds['memory_id']}, q double, visits long, reward_mean double, last_reward double"
    return folded(rows, "user_id", ["ord", "memory_id", "reward"], lambda: Values(alpha, gamma, first, floor), step, schema, finish)
