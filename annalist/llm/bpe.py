"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces of a block of documents form one small corpus. An inverted index maps each adjacent token
pair to the positions where it stands; the merges are applied in rank order over that index, and a merge touches
only the two neighbours of each position. Pieces are independent of each other, so blocks can be replayed
anywhere and a lost executor only repeats its own blocks.

Defined results: null and empty texts have no ids; a text of any length is encoded whole; equal rows give equal
rows; an empty table gives an empty table; columns besides id and text are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import blocks, claim, column, id_text

#: Encoded pieces and words that one Python worker remembers; beyond that it starts anew.
CACHE_PIECES, CACHE_WORDS = 150_000, 300_000
#: Pieces taken from a text at once, so that a very long text never becomes one list.
PIECES_AT_ONCE = 1 << 17
#: Longer texts take the way that holds only some pieces at a time.
PLAIN_CHARS = 1 << 22
#: White space other than blank and line end; and what a piece may share with its neighbours.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
RUNS = ("  ", "\n\n", " \n", "\n ")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_word(ids: list[int], rank_of: Callable[[int, int], int]) -> list[int]:
    """The rule for one piece, step by step: merge the leftmost pair of the lowest rank until no pair has one."""
    ids = list(ids)
    while len(ids) > 1:
        ranks = [rank_of(a, b) for a, b in zip(ids, ids[1:])]
        least = min((r for r in ranks if r >= 0), default=-1)
        if least < 0:
            break
        i = ranks.index(least)
        ids[i : i + 2] = [least]
    return ids


class MergeReplay:
    """Applies the merges of a rank table to many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.none = max(ranks.values()) + 1
        self.single = np.array([ranks.get(bytes([b]), self.none) for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * (self.none + 1) + b] = rank
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], -1)
        self.of_bytes = self.rank(np.repeat(self.single, 256), np.tile(self.single, 256)).reshape(256, 256)
        self.narrow = np.uint16 if self.none < 1 << 16 else np.int64  # ranks sort faster in 16 bits

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or -1."""
        key = a.astype(np.int64, copy=False) * (self.none + 1) + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def one(self, a: int, b: int) -> int:
        return int(self.rank(np.array([a]), np.array([b]))[0])

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as int32 bytes. A piece that is a token itself is that token; the rest is replayed together."""
        out: list[bytes | None] = [None] * len(pieces)
        todo = []
        for i, p in enumerate(pieces):
            rank = self.ranks.get(p)
            if rank is None:
                todo.append(i)
            else:
                out[i] = rank.to_bytes(4, "little")
        for i, ids in zip(todo, self._replay([pieces[i] for i in todo])):
            out[i] = ids
        return out

    def _replay(self, pieces: list[bytes]) -> list[bytes]:
        if not pieces:
            return []
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n, stops = int(lens.sum()), np.cumsum(lens)
        held = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.append(self.single[held], self.none).astype(np.int32)  # position n stands beside every end
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        nxt[stops - 1], prv[stops - lens], nxt[n] = n, n, n
        # The rank that each position makes with the next one, or -1: tells which entries of the index still stand.
        pair = np.append(self.of_bytes[held[:-1], held[1:]], [-1, -1]).astype(np.int32)
        pair[stops - 1] = -1
        dead = self.none
        slow: dict[int, list[int]] = {}
        # The inverted index: for each rank, the left positions of the pairs that make it.
        index: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def put(at: np.ndarray, rank: np.ndarray) -> None:
            some = np.flatnonzero(rank >= 0)
            if not len(some):
                return
            at, rank = at[some].astype(np.int32, copy=False), rank[some]
            by = np.argsort(rank.astype(self.narrow), kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for r, a, b in zip(rank[starts].tolist(), starts, [*starts[1:], len(at)]):
                if r not in index:
                    index[r] = []
                    heapq.heappush(order, r)
                index[r].append(at[a:b])

        put(np.arange(n), pair[:n])
        while order:
            rank = heapq.heappop(order)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = np.sort(at[pair[at] == rank])  # the others have lost a neighbour since
            if len(at) > 1:
                at = at[np.append(True, at[1:] != at[:-1])]
            elif not len(at):
                continue
            after = nxt[at]
            touch = after[:-1] == at[1:]
            if touch.any():  # runs such as aaa: leftmost first, each position once, so every other one of a run
                i = np.arange(len(at))
                at = at[(i - np.maximum.accumulate(np.where(np.append(False, touch), 0, i))) % 2 == 0]
                after = nxt[at]
            far, before = nxt[after], prv[at]
            near = np.flatnonzero(far[:-1] == at[1:])  # a merge right behind another: for a moment its first half has the other's token beside it
            between = self.rank(np.full(len(near), rank), ids[far[near]]) if len(near) else near
            ids[at], ids[after], pair[after] = rank, dead, -1
            nxt[at], prv[far] = far, at
            left = np.concatenate([before, at])
            made = self.rank(ids[left], ids[nxt[left]])
            lower = [left[(made >= 0) & (made < rank)], at[near[(between >= 0) & (between < rank)]]]
            if len(lower[0]) or len(lower[1]):  # a merge that makes a pair of lower rank changes the order in its piece: such pieces go step by step
                for w in np.unique(np.searchsorted(stops, np.concatenate(lower), side="right")).tolist():
                    slow[w] = merge_word(self.single[np.frombuffer(pieces[w], np.uint8)].tolist(), self.one)
                    own = slice(stops[w] - lens[w], stops[w])
                    ids[own], pair[own] = dead, -1
                    made[(left >= own.start) & (left < own.stop)] = -1
            pair[left] = made
            put(left, made)
        alive = ids[:n] != dead
        flat = ids[:n][alive].tobytes()
        ends = (4 * np.append(0, np.cumsum(alive))[stops]).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for w, own in slow.items():
            out[w] = np.array(own, np.int32).tobytes()
        return out


class Encoder:
    """Splits texts into pieces and remembers the ids of recent words."""

    def __init__(self, path: str, pattern: str):
        self.split = regex.compile(pattern)
        ranks = load_ranks(path)
        self.replay = MergeReplay(ranks)
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        by_rank = {v: k for k, v in ranks.items()}
        self.bytes_of = [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known = {p: self.known[p] for p in pieces if p in self.known}
        self.known.update(zip(new, self.replay.encode([p.encode() for p in new])))

    def join(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, pieces))

    def long(self, text: str) -> np.ndarray:
        """A text of any size and shape, some pieces at a time."""
        found, parts = (m.group() for m in self.split.finditer(text)), []
        while part := list(islice(found, PIECES_AT_ONCE)):
            self.learn(set(part))
            parts.append(self.join(part))
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the new pieces of all texts are replayed together.

        Where single blanks between other characters are the only blanks, no piece crosses them, and a blank with the
        word behind it is looked up as one. A text with other runs of white space is split whole.
        """
        plain = [is_plain(t) for t in texts]
        words, starts = set(), set()
        for t in (t for t, p in zip(texts, plain) if p):
            own = t.split(" ")
            starts.add(own[0])
            words.update(own[1:])
        new = list(words.difference(self.words))
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words = {w: self.words[w] for w in words if w in self.words}
        first = {w: self.split.findall(w) for w in starts}
        simple = [w for w in new if w.isascii() and w.isalpha()]  # one piece with the blank before it
        mixed = [w for w in new if not (w.isascii() and w.isalpha())]
        parts = [self.split.findall(" " + w) for w in mixed]
        self.learn(set().union(*first.values(), *parts, (" " + w for w in simple)))
        self.words.update(zip(mixed, map(self.join, parts)))
        self.words.update((w, self.known[" " + w]) for w in simple)
        begin = {w: self.join(p) for w, p in first.items()}
        done = []
        for t, p in zip(texts, plain):
            if p:
                own = t.split(" ")
                done.append(np.frombuffer(b"".join([begin[own[0]], *map(self.words.__getitem__, own[1:])]), dtype=np.int32))
            else:
                done.append(self.long(t))
        return done

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def is_plain(text: str) -> bool:
    """Whether single blanks and line ends between other characters are the only white space."""
    if not 0 < len(text) <= PLAIN_CHARS or text[0] in " \n" or text[-1] in " \n":
        return False
    return not any(r in text for r in RUNS) and not any(c in text for c in OTHER_SPACE)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids array<int>`` of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", encoder.cache_clear)
        own = encoder(ranks_path, pattern)
        for block in blocks(batches):
            ids = own.encode([t or "" for t in column(block, "text").to_pylist()])
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([column(block, "doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    df = id_text(df, id_col, text_col)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and ``decoded binary``: the bytes that the ids stand for; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", encoder.cache_clear)
        own = encoder(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lists = column(part, "ids")
                ends = lists.offsets.to_numpy()
                flat = lists.values.to_numpy(zero_copy_only=False)
                texts = [own.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), lists, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    df = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def digest(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, decode again, and reduce both to lengths and digests."""
    both = decode(encode(df, ranks_path, pattern), ranks_path, pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
