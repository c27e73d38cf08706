"""Segments of conversations and lives of memories, in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from annalist.operators.carried import folded

#: Share of a turn's words, in hundredths, that its segment has to hold.
SHARED = 20
Judge = Callable[[set, list], bool]


def shares_words(segment: set, words: list) -> bool:
    """Whether a turn goes on with a segment: enough of its words are there, or it has none. Takes the place of a model."""
    return 100 * sum(w in segment for w in words) >= SHARED * len(words)


def words_of(text: Column, least: int = 6) -> Column:
    """Distinct words of a turn, a-z in lower case, of so many letters or more; none of a null."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"([a-z]{{{least},}})"), F.lit(1))), F.array().cast("array<string>"))


def place(number: int, segment: set, words: list, belongs: Judge) -> tuple[int, set]:
    """Segment number and words after a turn: it is added to the last segment, or opens one. -1: there is none yet."""
    if number >= 0 and belongs(segment, words):
        return number, segment | set(words)
    return number + 1, set(words)


def segmented(df: DataFrame, belongs: Judge = shares_words) -> DataFrame:
    """key, ord, segment of turns (key, ord, words). State is a key's last segment alone. Equal ``ord`` keep all rows."""

    def step(state: dict[str, Any], row: dict) -> list[tuple]:
        state["number"], state["words"] = place(state["number"], state["words"], row["words"], belongs)
        return [(row["key"], row["ord"], state["number"])]

    return folded(df.select("key", "ord", "words"), "key", ["ord", "words"], lambda: {"number": -1, "words": set()}, step, "key long, ord long, segment long")


def segmented_stream(df: DataFrame, belongs: Judge = shares_words) -> DataFrame:
    """The same over a stream whose batches bring a key's turns in order: the last segment is the state of a key."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, held = state.get if state.exists else (-1, [])
        segment = set(held)
        rows = pd.concat(list(frames))
        rows["words"] = [list(w) for w in rows["words"]]
        out = []
        for ord_, words in sorted(zip(rows["ord"], rows["words"])):
            number, segment = place(number, segment, words, belongs)
            out.append((key[0], ord_, number))
        state.update((number, sorted(segment)))
        yield pd.DataFrame(out, columns=["key", "ord", "segment"])

    return df.groupBy("key").applyInPandasWithState(run, "key long, ord long, segment long", "number long, words array<string>", "append", GroupStateTimeout.NoTimeout)


def lives(df: DataFrame, key: list[str], at: str, ttl: str) -> DataFrame:
    """Lives of keyed records under expiry: started, ends (last update and ``ttl``) and n_updates of each.

    A record that is not updated for ``ttl`` is deleted; a later update starts a new life. Rows without a time are left
    out. Over a stream with a watermark a life comes out once the watermark has passed its end, so what is deleted and
    when does not depend on the batches in which rows came; in batch all lives come out.
    """
    rows = df.groupBy(*key, F.session_window(at, ttl).alias("life")).agg(F.count(F.lit(1)).alias("n_updates"))
    return rows.select(*key, F.col("life.start").alias("started"), F.col("life.end").alias("ends"), "n_updates")
