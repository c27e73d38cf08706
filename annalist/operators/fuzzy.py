"""Best-window similarity of patterns with texts: bit-parallel common subsequences of many windows at once, behind a q-gram filter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators.vectors import blocks

#: Characters of the texts that are laid out at once.
CHARS_AT_ONCE = 1 << 19
#: Patterns and texts that meet in a task.
PATTERN_BLOCK, TEXT_BLOCK = 16, 1_024
GAP = np.uint32(0xFFFFFFFF)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def common(pattern: np.ndarray, places: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Lengths of the longest common subsequences of ``pattern`` with the windows of ``width`` from ``starts``.

    ``places`` gives for each position of the text the number of its character among those of the pattern, from 1, or
    0. A window has a bit for each character of the pattern, in words of 64; a step takes one character of all windows.
    """
    kinds, own = np.unique(pattern, return_inverse=True)
    words = -(-len(pattern) // 64)
    masks = np.zeros((words, len(kinds) + 1), np.uint64)
    for i, k in enumerate(own.tolist()):
        masks[i // 64, k + 1] |= np.uint64(1 << i % 64)
    row = np.full((words, len(starts)), ~np.uint64(0))
    for j in range(width):
        at, carry = places[starts + j], np.uint64(0)
        for w in range(words):
            s = row[w]
            both = s & masks[w, at]
            total = s + both
            over = total < s
            total = total + carry
            carry = (over | (total < carry)).astype(np.uint64)
            row[w] = total | (s & ~masks[w, at])
    rest = len(pattern) - 64 * (words - 1)
    row[-1] |= ~np.uint64(0) << np.uint64(rest) if rest < 64 else np.uint64(0)
    return 64 * words - np.bitwise_count(row).sum(0).astype(np.int64)


class Laid:
    """Texts one after the other as numbers of characters, with room for windows over their ends."""

    def __init__(self, texts: list[str], room: int):
        self.lengths = np.array([len(t) for t in texts])
        gap = np.full(room, GAP, np.uint32)
        self.kinds, self.places = np.unique(np.concatenate([x for t in texts for x in (gap, codes(t))] + [gap]), return_inverse=True)
        self.real = (self.kinds != GAP)[self.places]
        self.ends = np.cumsum(self.lengths + room) + room  # where the window that begins at a text's last place would be over
        self.room = room

    def best(self, pattern: str) -> np.ndarray:
        """Best similarity of the pattern with a window of each text; no text is shorter. Windows over an end are cut off there."""
        own, m = codes(pattern), len(pattern)
        if not m:
            return np.where(self.lengths > 0, 0.0, 100.0)
        chars, number = np.unique(own, return_inverse=True)
        known = np.zeros(len(self.kinds), np.int64)
        at = np.searchsorted(chars, self.kinds).clip(0, len(chars) - 1)
        known[chars[at] == self.kinds] = at[chars[at] == self.kinds] + 1
        places = known[self.places]
        inside, most = summed(self.real, m), summed(places > 0, m)
        if m > 1:  # pairs of neighbours in common: a change spoils two pairs of the pattern at most
            pairs = np.zeros((len(chars) + 1) ** 2, bool)
            pairs[(number[:-1] + 1) * (len(chars) + 1) + number[1:] + 1] = True
            most = np.minimum(most, (summed(pairs[places[:-1] * (len(chars) + 1) + places[1:]], m - 1) + m + inside + 1) // 3)
        bound = 200.0 * most / (m + inside)
        # a text's windows begin where they end on its first character, and end where they begin on its last
        begin = np.append(0, self.ends[:-1] - self.room) + self.room - m + 1
        of = np.repeat(np.arange(len(begin)), self.lengths + m - 1)
        starts = np.arange(len(of)) + np.repeat(begin - np.append(0, np.cumsum(self.lengths + m - 1)[:-1]), self.lengths + m - 1)
        bound, inside = bound[starts], inside[starts]
        cuts = np.append(0, np.cumsum(self.lengths + m - 1)[:-1])
        top = np.maximum.reduceat(bound, cuts)
        best = np.zeros(len(begin))
        first = bound == top[of]
        for at in (np.flatnonzero(first), None):
            at = np.flatnonzero((bound > best[of]) & ~first) if at is None else at
            if len(at):
                got = 200.0 * common(own, places, starts[at], m) / (m + inside[at])
                edge = np.flatnonzero(np.append(True, of[at][1:] != of[at][:-1]))
                best[of[at][edge]] = np.maximum(best[of[at][edge]], np.maximum.reduceat(got, edge))
        return best


def summed(x: np.ndarray, width: int) -> np.ndarray:
    """Sums of ``width`` neighbours."""
    c = np.append(0, np.cumsum(x))
    return c[width:] - c[: len(c) - width]


def ratios(patterns: list[str | None], texts: list[str | None]) -> np.ndarray:
    """(pattern, text): similarity (0 to 100) of the shorter of both with the best window of the longer one, case aside; null is empty."""
    patterns, texts = [(p or "").lower() for p in patterns], [(t or "").lower() for t in texts]
    out = np.zeros((len(patterns), len(texts)))
    longest = max(map(len, patterns), default=0)
    groups: list[list[int]] = [[]]
    held = 0
    for i, t in enumerate(texts):
        if held > CHARS_AT_ONCE:
            groups.append([])
            held = 0
        groups[-1].append(i)
        held += len(t) + longest
    for group in groups:
        group.sort(key=lambda i: -len(texts[i]))
        for n in sorted({len(p) for p in patterns}, reverse=True):
            fit = [i for i in group if len(texts[i]) >= n]
            if fit:
                laid = Laid([texts[i] for i in fit], max(n - 1, 0))
                for k in (k for k, p in enumerate(patterns) if len(p) == n):
                    out[k, fit] = laid.best(patterns[k])
    short = [i for i, t in enumerate(texts) if len(t) < longest]
    for i in short:
        for k, p in enumerate(patterns):
            if len(texts[i]) < len(p):
                out[k, i] = Laid([p], max(len(texts[i]) - 1, 0)).best(texts[i])[0]
    return out


def best_matches(patterns: DataFrame, rows: DataFrame, k: int, query_id: str, pattern: str, id_col: str, text: str) -> DataFrame:
    """query, id, ratio (to 6 places) and place: for each pattern the k most similar texts; ties by id.

    Blocks of patterns meet blocks of rows; a task keeps k rows a pattern. Rows with a null id are left out; a null text is empty.
    """
    left = patterns.select(F.col(query_id).alias("q"), F.col(pattern).cast("string").alias("p")).filter("q IS NOT NULL")
    right = rows.select(F.col(id_col).alias("memory"), F.col(text).cast("string").alias("t")).filter("memory IS NOT NULL")

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        at, to, found = [], [], []
        texts, names = held.column("t").to_pylist(), np.array(held.column("memory").to_pylist())
        for i, r in enumerate(np.round(ratios(asked.column("p").to_pylist(), texts), 6) if texts else []):
            best = np.lexsort((names, -r))[:k]
            at += [i] * len(best)
            to += best.tolist()
            found += r[best].tolist()
        return pa.table({"query": asked.column("q").take(pa.array(at, pa.int64())), "id": held.column("memory").take(pa.array(to, pa.int64())), "ratio": pa.array(found, pa.float64())})

    kinds = dict(left.dtypes)["q"], dict(right.dtypes)["memory"]
    out = blocks(left, right, PATTERN_BLOCK, TEXT_BLOCK).applyInArrow(run, f"query {kinds[0]}, id {kinds[1]}, ratio double")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("ratio").desc(), "id"))).filter(F.col("place") <= k)
