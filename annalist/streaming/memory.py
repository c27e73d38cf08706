"""Order-sensitive state by user, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUFFER = "user_id long, batch long, n_items long, cost long"


def pack(costs: list[int], budget: int, held: tuple[int, int, int]) -> tuple[list[tuple[int, int, int]], tuple[int, int, int]]:
    """Batches (number, items, cost) that close before the item that would overflow; and what stays open."""
    number, items, used = held
    out = []
    for c in costs:
        if items and used + c > budget:
            out.append((number, items, used))
            number, items, used = number + 1, 0, 0
        items, used = items + 1, used + c
    return out, (number, items, used)


def short_buffer(df: DataFrame, budget: int) -> DataFrame:
    """Closed batches and the forced last one of each user. ``df``: user_id, ord, cost."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        done, left = pack(group["cost"].tolist(), budget, (0, 0, 0))
        rows = [*done, left] if left[1] else done
        return pd.DataFrame([(group["user_id"].iloc[0], *r) for r in rows], columns=["user_id", "batch", "n_items", "cost"])

    return df.groupBy("user_id").applyInPandas(run, BUFFER)


def short_buffer_stream(df: DataFrame, budget: int) -> DataFrame:
    """The same over a stream: closed batches come out as they close, the open one is state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(frames)).sort_values("ord")
        done, held = pack(rows["cost"].tolist(), budget, held)
        state.update(held)
        yield pd.DataFrame([(key[0], *r) for r in done], columns=["user_id", "batch", "n_items", "cost"])

    return df.groupBy("user_id").applyInPandasWithState(run, BUFFER, "number long, items long, used long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(df: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by event-time window with a watermark; beyond what the memory methods have."""
    return df.withWatermark("at", late).groupBy(F.window("at", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def segments_by_weight(weights: list[int], limit: int, boundary: list[bool]) -> list[int]:
    """Segment of each item: after ``limit`` of weight has gathered, the next item at a boundary opens a new one."""
    out, segment, used = [], 0, 0
    for w, cut in zip(weights, boundary):
        if used >= limit and cut:
            segment, used = segment + 1, 0
        out.append(segment)
        used += w
    return out


def compact(sessions: list[str], budget: int, fold: Callable[[str, list[str]], str]) -> tuple[str, list[str]]:
    """A summary and the recent sessions within a budget of tokens.

    When both together overflow, the oldest half of the recent sessions is folded into the summary; a summary that
    would not fit by itself is cut to the budget. ``fold(summary, evicted)`` is the injected model.
    """
    summary, recent = "", []
    size = lambda s: len(s) // 3
    for text in sessions:
        recent.append(text)
        while size(summary) + sum(map(size, recent)) > budget and len(recent) > 1:
            out, recent = recent[: (len(recent) + 1) // 2], recent[(len(recent) + 1) // 2 :]
            summary = fold(summary, out)[: 3 * budget]
    return summary, recent


def chronological(sessions: DataFrame, probes: DataFrame, start: Callable[[], object], ingest: Callable[[object, dict], object], answer: Callable[[object, dict], str]) -> DataFrame:
    """Answer each probe from the state after exactly the sessions up to its cutoff.

    ``sessions``: user_id, session_index and what ``ingest`` reads; ``probes``: probe_id, user_id, cutoff. Users are
    independent: one group each, sessions fed in order, probes answered on the way.
    """

    def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        state, out = start(), []
        feed = own.sort_values("session_index").to_dict("records")
        at = 0
        for p in asked.sort_values(["cutoff", "probe_id"]).to_dict("records"):
            while at < len(feed) and feed[at]["session_index"] <= p["cutoff"]:
                state = ingest(state, feed[at])
                at += 1
            out.append((p["probe_id"], answer(state, p)))
        return pd.DataFrame(out, columns=["probe_id", "memory_context"])

    return sessions.groupBy("user_id").cogroup(probes.groupBy("user_id")).applyInPandas(run, "probe_id string, memory_context string")


def stand_in(summary: str, evicted: list[str]) -> str:
    """What takes the model's place in a fold: the first word of each evicted session behind the summary so far."""
    return " ".join([*([summary] if summary else []), *(t.split(" ", 1)[0] for t in evicted)])


def compacted(df: DataFrame, budget: int, fold: Callable[[str, list[str]], str] = stand_in) -> DataFrame:
    """user_id, summary and number of recent sessions by ``compact`` over each user's sessions (user_id, session_index, text)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        summary, recent = compact(group.sort_values("session_index")["text"].tolist(), budget, fold)
        return pd.DataFrame([(group["user_id"].iloc[0], summary, len(recent))], columns=["user_id", "summary", "n_recent"])

    return df.groupBy("user_id").applyInPandas(run, "user_id long, summary string, n_recent long")
