"""Removal of repeated substrings by a common-prefix-aware distributed merge sort of suffixes.

Every byte is removed that a string of ``length`` bytes covers which also starts anywhere else.

1. Which suffixes. A window is ``length`` bytes from some start. Its anchor is the leftmost of its ``GRAM``-byte
   strings with the least hash: equal windows have equal anchors at equal places. So only the suffixes at anchors
   are sorted, about one in ``(length - GRAM) / 2`` bytes, each for the run of windows that share it (its span).
   Anchors whose GRAM string is found nowhere else take no part. Spans that are equal as a whole are settled by
   their hash and take part once.
2. Runs. Each task sorts the suffixes it holds, right contexts forwards and left contexts backwards, and emits runs
   coded by the prefix shared with the suffix before (front coding), one for each bucket of anchor strings.
3. Merge. A task merges the runs of its bucket with loser trees that carry the prefix shared with the last winner,
   so that no byte known to be equal is compared again. Sorted order and shared prefixes tell, for each place of a
   window around its anchor, which windows are equal.

A class of one anchor string with over ``HOT`` spans would be one task's; its windows are compared by their 128-bit
hashes instead, in any number of tasks.

Defined results: null counts as empty; texts shorter than ``length`` lose nothing; equal texts of ``length`` bytes
or more lose everything; repeated rows count as elsewhere; a text of any length is taken whole, in segments; an
empty table gives an empty table; other columns are ignored. Equal texts are told by 64-bit, equal spans by
128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import as_bytes, blocks, claim, column, id_text, release, table

LENGTH, GRAM = 400, 100
HOT = 50_000
#: Bytes of text, and of contexts, that a task holds at once.
SEGMENT, RUN_BYTES = 2 << 20, 16 << 20
#: Anchors of one merging task, about.
BUCKET_ITEMS = 20_000
BASE = 0x9E3779B97F4A7C15 | 1
BASE_BACK = pow(BASE, -1, 2**64)
MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        _powers[base] = np.cumprod(np.append(np.uint64(1), np.full(n + 1024, base, np.uint64)), dtype=np.uint64)
    return _powers[base][:n]


def forget() -> None:
    """Named, so that a task clears its own worker's table and no copy of it travels along."""
    _powers.clear()


def scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours, by running minima of blocks from both sides."""
    n = len(x)
    full = np.append(x, np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)).reshape(-1, w)
    left = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(full, axis=1).ravel()
    return np.minimum(left[: n - w + 1], right[w - 1 : n])


def anchors(data: np.ndarray, owner_end: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of concatenated texts ending at ``owner_end``: anchor, first and last window start, gram hash, span hash."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    up, back = powers(BASE, n), powers(BASE_BACK, n)
    table_ = scatter(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    sums = np.append(np.uint64(0), np.cumsum(table_[data] * up))
    grams = scatter((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    key = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
    at = (window_min(key, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = np.arange(len(at))
    whole = np.searchsorted(owner_end, starts, side="right") == np.searchsorted(owner_end, starts + length - 1, side="right")
    at, starts = at[whole], starts[whole]
    if not len(at):
        return none, none, none, none, none
    new = np.append(True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))
    s = starts[new]
    e = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    p = at[new]
    span = (sums[e + length] - sums[s]) * back[s]
    span = scatter(span + scatter(((e - s) * 1024 + (p - s)).astype(np.uint64)))
    return p, s, e, grams[p].astype(np.int64), span.astype(np.int64)


def segments(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts put together to at most SEGMENT bytes: which text, its offset, the bytes. Long ones overlap by length - 1."""
    which, offset, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), SEGMENT):
            part = t[at : at + SEGMENT + length - 1]
            if held and size + len(part) > SEGMENT:
                yield which, offset, held
                which, offset, held, size = [], [], [], 0
            which.append(i)
            offset.append(at)
            held.append(part)
            size += len(part)
    if held:
        yield which, offset, held


ANCHOR = "tid long, p long, s long, e long, gram long, span long, c long"


def find_anchors(df: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchor rows of all texts (tid, text). Equal spans of a task's block are one row with c = 2; the windows of
    their members are rows without a gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("suffix_dedup", forget)
        seen: set[int] = set()
        for block in blocks(batches, limit=SEGMENT):
            tids, texts = column(block, "tid").to_pylist(), as_bytes(block)
            fresh = [i for i, t in enumerate(tids) if len(texts[i]) >= length and not (t in seen or seen.add(t))]
            if len(seen) > 1_000_000:
                seen.clear()
            for which, offset, held in segments([texts[i] for i in fresh], length):
                ends = np.cumsum([len(x) for x in held])
                p, s, e, g, h = anchors(np.frombuffer(b"".join(held), np.uint8), ends, length, gram)
                if not len(p):
                    continue
                own = np.searchsorted(ends, p, side="right")
                shift = np.array(offset)[own] - np.append(0, ends)[own]
                tid = np.array([tids[fresh[i]] for i in which])[own]
                p, s, e = p + shift, s + shift, e + shift
                order = np.lexsort((h, g))
                first = np.append(True, (g[order][1:] != g[order][:-1]) | (h[order][1:] != h[order][:-1]))
                group = np.cumsum(first) - 1
                counts = np.bincount(group)
                rep, c = order[first], np.minimum(counts, 2)
                dup = np.sort(order[counts[group] > 1])  # in order of text and start, to be put together
                cut = np.append(True, (tid[dup][1:] != tid[dup][:-1]) | (s[dup][1:] != e[dup][:-1] + 1)) if len(dup) else np.zeros(0, bool)
                ds, de = s[dup][cut], e[dup][np.append(np.flatnonzero(cut)[1:] - 1, len(dup) - 1)] if len(dup) else e[dup]
                cols = [(tid[rep], tid[dup][cut]), (p[rep], ds), (s[rep], ds), (e[rep], de)]
                arrays = [pa.array(np.concatenate(x)) for x in cols]
                pad = pa.nulls(len(ds), pa.int64())
                arrays += [pa.concat_arrays([pa.array(g[rep]), pad]), pa.concat_arrays([pa.array(h[rep]), pad]), pa.array(np.append(c, np.full(len(ds), 2)))]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in ANCHOR.split(", ")])

    return df.mapInArrow(run, ANCHOR)


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of two strings known to be equal up to ``at``."""
    n = min(len(a), len(b))
    while at < n:
        x, y = a[at : at + 48], b[at : at + 48]
        if x != y:
            k = min(len(x), len(y))
            d = int.from_bytes(x[:k], "big") ^ int.from_bytes(y[:k], "big")
            return at + k - (d.bit_length() + 7) // 8
        at += 48
    return n


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Prefix shared with the string before, length of the rest, and the rests."""
    lcp, before = [], b""
    for x in strings:
        lcp.append(shared(before, x) if before else 0)
        before = x
    tails = [x[k:] for x, k in zip(strings, lcp)]
    return np.array(lcp, np.int32), np.array([len(t) for t in tails], np.int32), b"".join(tails)


class Run:
    """A front-coded run, decoded string by string."""

    def __init__(self, lcp: bytes, lens: bytes, tails: bytes):
        self.lcp, self.lens = np.frombuffer(lcp, np.int32).tolist(), np.frombuffer(lens, np.int32).tolist()
        self.tails, self.at, self.i, self.now = tails, 0, -1, b""

    def step(self) -> bool:
        self.i += 1
        if self.i >= len(self.lcp):
            return False
        n = self.lens[self.i]
        self.now = self.now[: self.lcp[self.i]] + self.tails[self.at : self.at + n]
        self.at += n
        return True


def merge_runs(runs: list[Run]) -> tuple[list[int], list[int], list[int]]:
    """Loser tree over runs: source run, index in it, and prefix shared with the string before, in sorted order.

    ``known[r]`` is the prefix that the head of run r shares with the last winner. Of two heads the one that shares
    more with it is the less; only heads that share the same are compared, from there on.
    """
    width = 1
    while width < len(runs):
        width *= 2
    live = [r.step() for r in runs] + [False] * (width - len(runs))
    known = [0] * width
    loser = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser then knows what it shares with the winner."""
        if not live[b]:
            return a, b
        if not live[a]:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y, at = runs[a].now, runs[b].now, known[a]
        k = shared(x, y, at)
        if k == len(x) or (k < len(y) and x[k] < y[k]):
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    def build(node: int) -> int:
        if node >= width:
            return node - width
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    source, index, lcps = [], [], []
    top = build(1)
    while live[top]:
        run = runs[top]
        source.append(top)
        index.append(run.i)
        lcps.append(known[top])
        live[top] = run.step()
        if live[top]:
            known[top] = run.lcp[run.i]
        node = (top + width) // 2
        while node:
            winner, loser[node] = play(top, loser[node])
            top = winner
            node //= 2
    return source, index, lcps


RUNS = "bucket long, n long, tid binary, p binary, s binary, e binary, single binary, r_lcp binary, r_len binary, r_tail binary, l_item binary, l_lcp binary, l_len binary, l_tail binary"


def sorted_runs(df: DataFrame, length: int, buckets: int) -> DataFrame:
    """(tid, text, items) to one row for each bucket and run: meta data, the right run and the left run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for bucket, items in held.items():
                items.sort(key=lambda x: x[0])
                left = sorted(range(len(items)), key=lambda i: items[i][1])
                right_run, left_run = front_code([x[0] for x in items]), front_code([items[i][1] for i in left])
                meta = [np.array([x[k] for x in items], np.int64).tobytes() for k in range(2, 7)]
                rows.append((bucket, len(items), *meta, right_run[0].tobytes(), right_run[1].tobytes(), right_run[2], np.array(left, np.int64).tobytes(), left_run[0].tobytes(), left_run[1].tobytes(), left_run[2]))
            for i in range(0, len(rows), 16):
                cols = list(zip(*rows[i : i + 16]))
                kinds = [x.split() for x in RUNS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.binary()) for c, (_, k) in zip(cols, kinds)], [n for n, _ in kinds])

        for block in blocks(batches, limit=SEGMENT):
            for tid, text, items in zip(column(block, "tid").to_pylist(), as_bytes(block), column(block, "items").to_pylist()):
                for x in items:
                    p, s, e, gram = x["p"], x["s"], x["e"], x["gram"]
                    head = (gram & (2**64 - 1)).to_bytes(8, "big")
                    right, left = head + text[p : e + length], head + text[s:p][::-1]
                    held.setdefault(gram % buckets, []).append((right, left, tid, p, s, e, int(x["single"])))
                    size += len(right) + len(left)
                if size > RUN_BYTES:
                    yield from flush()
                    held.clear()
                    size = 0
        yield from flush()

    return df.select("tid", "text", "items").mapInArrow(run, RUNS)


def equal_windows(p, s, e, right_lcp, left_order, left_lcp, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Item and place (anchor minus start) of each window that equals another. Items are in the right order."""
    n = len(p)
    least, most = p - e, p - s
    items, places = [], []
    for d in range(int(least.min()), int(most.max()) + 1):
        valid = np.flatnonzero((least <= d) & (d <= most))
        if len(valid) < 2:
            continue
        right = np.cumsum(right_lcp < length - d + 8)[valid]
        left = np.empty(n, np.int64)
        left[left_order] = np.cumsum(left_lcp < d + 8)
        _, at, count = np.unique(right * (n + 1) + left[valid], return_inverse=True, return_counts=True)
        found = valid[count[at] > 1]
        items.append(found)
        places.append(np.full(len(found), d))
    none = np.zeros(0, np.int64)
    return (np.concatenate(items), np.concatenate(places)) if items else (none, none)


def merged_buckets(df: DataFrame, length: int) -> DataFrame:
    """Windows (tid, s, e) of single spans that equal other windows, from the runs of each bucket."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        meta = [np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) for k in ("tid", "p", "s", "e", "single")]
        base = np.cumsum([0, *(r["n"] for r in rows)])
        src, idx, right_lcp = merge_runs([Run(r["r_lcp"], r["r_len"], r["r_tail"]) for r in rows])
        order = base[np.array(src)] + np.array(idx)
        lsrc, lidx, left_lcp = merge_runs([Run(r["l_lcp"], r["l_len"], r["l_tail"]) for r in rows])
        item = np.concatenate([np.frombuffer(r["l_item"], np.int64) + b for r, b in zip(rows, base)])
        left = item[base[np.array(lsrc)] + np.array(lidx)]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        tid, p, s, e, single = (m[order] for m in meta)
        at, d = equal_windows(p, s, e, np.array(right_lcp), rank[left], np.array(left_lcp), length)
        mine = single[at] == 1
        at, start = at[mine], p[at[mine]] - d[mine]
        by = np.lexsort((start, at))
        at, start = at[by], start[by]
        new = np.append(True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)) if len(at) else np.zeros(0, bool)
        end = start[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] if len(at) else start
        return pa.table({"tid": pa.array(tid[at[new]], pa.int64()), "s": pa.array(start[new], pa.int64()), "e": pa.array(end, pa.int64())})

    return df.groupBy("bucket").applyInArrow(run, "tid long, s long, e long")


def hashed_windows(df: DataFrame, length: int) -> DataFrame:
    """The same for hot classes: every window as a row with its 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=1 << 18):
            for tid, text, items in zip(column(block, "tid").to_pylist(), as_bytes(block), column(block, "items").to_pylist()):
                for x in items:
                    span = range(x["s"], x["e"] + 1)
                    n = len(span)
                    h = [xxhash.xxh3_128_digest(text[i : i + length]) for i in span]
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array([tid] * n, pa.int64()), pa.array(list(span), pa.int64()), pa.array([x["single"]] * n, pa.bool_())], ["h", "tid", "s", "single"])

    rows = df.select("tid", "text", "items").mapInArrow(run, "h binary, tid long, s long, single boolean")
    twice = rows.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("h").alias("h2"))
    return rows.filter("single").join(twice, F.col("h") == F.col("h2"), "left_semi").select("tid", "s", F.col("s").alias("e"))


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated(df: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The texts (doc_id, text, tid) and the windows (tid, s, e) of distinct texts that also start elsewhere."""
    spark = df.sparkSession
    texts = df.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tid", F.xxhash64("text"))
    found = table(find_anchors(texts.select("tid", "text"), length, gram), "suffix-anchors")
    held = found.filter("gram IS NOT NULL")
    spans = held.groupBy("gram", "span").agg(F.sum("c").alias("c"), F.min(F.struct("tid", "p", "s", "e")).alias("rep"))
    own = Window.partitionBy("gram")
    spans = spans.withColumn("n", F.count("*").over(own)).withColumn("singles", F.sum((F.col("c") == 1).cast("long")).over(own))
    spans = table(spans.filter("c > 1 OR (n > 1 AND singles > 0)"), "suffix-spans")
    release(spark)
    equal = spans.filter("c > 1").select(F.col("gram").alias("g2"), F.col("span").alias("h2"))
    settled = held.join(equal, (F.col("gram") == F.col("g2")) & (F.col("span") == F.col("h2")), "left_semi").select("tid", "s", "e")
    settled = settled.union(found.filter("gram IS NULL").select("tid", "s", "e"))
    parts = spans.filter("n > 1 AND singles > 0").select("gram", "rep.*", (F.col("c") == 1).alias("single"), (F.col("n") > hot).alias("hot"))
    reps = texts.groupBy("tid").agg(F.min("doc_id").alias("rep_id"))
    items = parts.groupBy("tid", "hot").agg(F.collect_list(F.struct("p", "s", "e", "gram", "single")).alias("items"))
    items = items.join(reps.withColumnRenamed("tid", "t2"), F.col("tid") == F.col("t2")).select("tid", "hot", "items", "rep_id")
    full = texts.select(F.col("tid").alias("t3"), "doc_id", "text")
    with_text = items.join(full, (F.col("tid") == F.col("t3")) & F.col("rep_id").eqNullSafe(F.col("doc_id"))).select("tid", "hot", "items", "text")
    counts = spans.agg(F.count(F.when(F.col("n") <= hot, 1)).alias("cool"), F.count(F.when((F.col("n") > hot) & (F.col("singles") > 0), 1)).alias("hot")).first()
    buckets = counts["cool"] // BUCKET_ITEMS + 12
    cool = with_text.filter("NOT hot").dropDuplicates(["tid"])
    compared = merged_buckets(sorted_runs(cool, length, buckets), length)
    if counts["hot"]:
        compared = compared.union(hashed_windows(with_text.filter("hot").dropDuplicates(["tid"]), length))
    windows = table(settled.union(compared), "suffix-windows")
    release(spark)
    return texts, windows


def cut_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``spans`` (the maximal removed runs in order, bytes ``a`` to before ``b``) and ``kept`` (the other bytes,
    binary, as a run may begin or end within a character)."""
    texts, windows = repeated(id_text(df, id_col, text_col), length, gram, hot)
    copies = texts.groupBy("tid").agg(F.count("*").alias("k")).filter("k > 1").select("tid", F.lit(True).alias("copied"))
    spans = windows.groupBy("tid").agg(F.collect_list(F.struct(F.col("s").alias("a"), (F.col("e") + length).alias("b"))).alias("spans"))
    by_text = spans.join(copies, "tid", "full_outer").select(F.col("tid").alias("t2"), "spans", "copied")
    rows = texts.join(by_text, F.col("tid") == F.col("t2"), "left").select("doc_id", "text", "spans", F.coalesce("copied", F.lit(False)).alias("copied"))
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            cut, rest = [], []
            for text, spans, copied in zip(as_bytes(block), column(block, "spans").to_pylist(), column(block, "copied").to_pylist()):
                gone = [(0, len(text))] if copied and len(text) >= length else union_spans([(x["a"], x["b"]) for x in spans or []])
                kept, at = [], 0
                for a, b in gone:
                    kept.append(text[at:a])
                    at = b
                cut.append([{"a": a, "b": b} for a, b in gone])
                rest.append(b"".join([*kept, text[at:]]))
            yield pa.RecordBatch.from_arrays([column(block, "doc_id"), pa.array(cut, kind), pa.array(rest, pa.binary())], ["doc_id", "spans", "kept"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<a: long, b: long>>, kept binary")


def remove_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``cut_repeats`` did to each row, in figures: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    rows = cut_repeats(df, length, gram, hot, id_col, text_col).select("doc_id", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept")
    return rows.select("doc_id", (F.octet_length("kept") + F.col("n_removed")).alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
