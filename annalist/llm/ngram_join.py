"""N-gram Jaccard join with PartEnum signatures.

A document is its set of hashed word shingles. Two sets x and y whose Jaccard similarity reaches the threshold t
differ in at most ``(|x| + |y|) (1 - t) / (1 + t)`` elements. Sets are banded by size, ``1 / t**WIDE`` from end to
end; a set signs for its own band and, where its larger partners reach there, for the next, as the smaller one. For a band the domain of hashes is cut into groups of ``PARTS``
partitions (first level); in each group all subsets of ``PARTS - MISS`` partitions are enumerated (second level),
and what a set holds in such a subset is a signature. Spoiling all subsets of a group takes ``MISS + 1``
differences, so two similar sets agree in some signature of at least ``agreeing`` groups.

As that is more than one group, a set may leave out its weakest signatures, those with the fewest elements, which
chance shares most: it leaves out what is below the least signature of its ``agreeing``-th weakest group, in the
order of (elements, place). An agreeing signature has the same place in that order in both sets, and the stricter
partner still keeps one of those it agrees in (see ``signatures``); so no pair is lost.

Sets that share a signature are candidates. Candidates are linked to the least set of their bucket, first within a
task's block, so that a common signature is one row a block, then over all blocks. Signatures of different bands
never meet: a set is one node for each of its two bands, and the components of these links hold every candidate
pair. A component too large for a task is first compared with one hub, in rounds: what reaches the threshold is one
cluster, whose members need no more comparison with each other; by the triangle inequality only sets that differ
from the hub by no more than twice the distance can link with them. Then components are thinned out by sketches
(how many hashes fall in each of ``SKETCH`` ranges, eight times as many for sets of ``FINE`` elements or more: the
counts of two sets differ by no more than the sets do) and verified exactly by counting common shingles, pairs of
blocks over many tasks where they are still large. Of the links found a spanning forest goes on.

Defined results: lower-cases A-Z only; fewer words than a shingle are one shingle; null, empty or blank texts have
none and link with nothing; equal sets are one node, so copies are not expanded; each row is a document of its own,
also where ids repeat, with the same or another text; an empty table gives an empty table; other columns are
ignored. Shingles are told apart by 64-bit hashes, sets by another 64-bit hash and their size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import as_bytes, blocks, claim, column, drop_table, id_text, release, table
from annalist.llm.components import components

#: Partitions of a group, differences that spoil not all of its subsets, and groups beyond those that differences can spoil.
PARTS, MISS, SPARE = 3, 1, 0.1
#: Sizes of a band, as a power of the largest ratio of similar sets.
WIDE = 2
#: Words whose hashes a Python worker remembers.
CACHE_WORDS = 100_000
#: Shingles that one verifying task holds, about.
BLOCK_SHINGLES = 500_000
#: Nodes that one thinning task holds, about.
BLOCK_NODES = 8_192
#: Buckets of text marks that are sent to all tasks at most, a long each.
MARK_BUCKETS = 1 << 20
#: Rounds of comparing a large component with a hub before it is compared in pairs of blocks.
HUB_ROUNDS = 4
TILE, SKETCH, FINE = 256, 64, 1_000
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``words`` words; of all words where there are fewer."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, parts), np.uint64, len(parts))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def sketch(h: np.ndarray) -> bytes:
    """Elements in each range of the domain, as 16-bit counts; a count cut off at the top differs by less, not more."""
    n = SKETCH * 8 if len(h) >= FINE else SKETCH
    edges = np.arange(1, n, dtype=np.uint64) * np.uint64(2**64 // n)
    counts = np.diff(np.concatenate(([0], np.searchsorted(h, edges), [len(h)])))
    return np.minimum(counts, 65_535).astype(np.uint16).tobytes()


def set_id(h: np.ndarray) -> int:
    total = mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).reshape(1)
    return int((total + np.array([len(h)], np.uint64) * MIX2).astype(np.int64)[0])


class PartEnum:
    """Size bands and signatures for a threshold of ``share`` hundredths."""

    def __init__(self, share: int):
        self.share = share
        self.starts = [1]

    def start(self, band: int) -> int:
        """Least size in a band."""
        while len(self.starts) <= band:
            start = self.starts[-1]
            for _ in range(WIDE):
                start = start * 100 // self.share + 1
            self.starts.append(start)
        return self.starts[band]

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.start(len(self.starts))
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def most(self, band: int) -> int:
        """Largest size in a band."""
        return self.start(band + 1) - 1

    def partner(self, size: int) -> int:
        """Largest size of a similar set."""
        return size * 100 // self.share

    def differences(self, one: int, other: int) -> int:
        """Most elements in which similar sets of these sizes differ."""
        return (one + other) * (100 - self.share) // (100 + self.share)

    def groups(self, band: int) -> int:
        spoiled = self.differences(self.most(band), self.most(band)) // (MISS + 1)
        return spoiled + 1 + int(spoiled * SPARE)

    def signatures(self, h: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Signatures of a sorted set in its own band and, as the smaller partner, in the next.

        Two similar sets agree in a signature of at least ``agreeing`` groups, for either set's own bound. Say the
        cut of y is the higher. Fewer than ``agreeing`` groups of y hold a signature below it, so in one of the
        agreeing groups all of y's signatures are kept, and x keeps the one that agrees as it is above both cuts.
        """
        own, out = self.band(len(h)), []
        sums = np.append(np.uint64(0), np.cumsum(mix(h ^ MIX1)))
        subsets = [list(x) for x in combinations(range(PARTS), PARTS - MISS)]
        for band in (own, own + 1) if self.partner(len(h)) >= self.start(own + 1) else (own,):
            groups = self.groups(band)
            n = groups * PARTS
            edges = np.arange(1, n, dtype=np.uint64) * np.uint64(2**64 // n)
            cuts = np.concatenate(([0], np.searchsorted(h, edges), [len(h)]))
            counts, held = np.diff(cuts).reshape(groups, PARTS), (sums[cuts[1:]] - sums[cuts[:-1]]).reshape(groups, PARTS)
            count = np.stack([counts[:, x].sum(1) for x in subsets], 1)
            held = np.stack([held[:, x].sum(1, dtype=np.uint64) for x in subsets], 1)
            place = np.arange(count.size).reshape(count.shape)
            order = count * count.size + place
            agreeing = groups - self.differences(len(h), min(self.most(band), self.partner(len(h)))) // (MISS + 1)
            keep = order >= np.partition(order.min(1), agreeing - 1)[agreeing - 1]
            name = (place.astype(np.uint64) + np.uint64(band << 32)) * MIX2 + np.uint64(1)
            out.append((band, mix(mix(name) + held)[keep].astype(np.int64)))
        return out


def node(sid: int, band: int) -> int:
    """A set in a band, as one number."""
    return (sid ^ (band * 0x9E3779B97F4A7C15 & 2**63 - 1)) if band else sid


def describe(df: DataFrame, words: int, share: int) -> DataFrame:
    """doc_id, hash of the text, set id (null for an empty set), set size, and the set's nodes in its own band and in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngram_join", word_hashes.cache_clear)
        enum = PartEnum(share)
        for block in blocks(batches, limit=1 << 20):
            sets = [shingles(t, words) for t in as_bytes(block)]
            sid = [set_id(h) if len(h) else None for h in sets]
            bands = [enum.band(len(h)) if len(h) else 0 for h in sets]
            nodes = [[None if i is None else node(i, b + k) for i, b in zip(sid, bands)] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [column(block, "doc_id"), column(block, "mark"), *(pa.array(x, pa.int64()) for x in (sid, [len(h) for h in sets], *nodes)), pa.array(map(sketch, sets), pa.binary())],
                ["doc_id", "mark", "sid", "n", "own", "next", "sketch"],
            )
        word_hashes.cache_clear()

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, mark long, sid long, n long, own long, next long, sketch binary")


def signed(df: DataFrame, words: int, share: int) -> DataFrame:
    """(sig, node) of every set. In a block only the least node of a signature signs; each other is put with it under
    a signature of the pair. A set that a task has signed before is not signed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngram_join", word_hashes.cache_clear)
        enum, seen = PartEnum(share), set()
        for block in blocks(batches, limit=1 << 20):
            sigs, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for text in as_bytes(block):
                h = shingles(text, words)
                if len(h) and (sid := set_id(h)) not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(sid)
                    for band, found in enum.signatures(h):
                        sigs.append(found)
                        nodes.append(np.full(len(found), node(sid, band), np.int64))
            sig, own = np.concatenate(sigs), np.concatenate(nodes)
            by = np.lexsort((own, sig))
            sig, own = sig[by], own[by]
            first = np.append(True, sig[1:] != sig[:-1])[: len(sig)]
            least = own[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
            link = own != least
            a, b = np.unique(np.stack([own[link], least[link]], 1), axis=0).T
            pair = mix(mix(a.astype(np.uint64)) + b.astype(np.uint64) * MIX2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([sig[first], pair, pair], [own[first], a, b])], ["sig", "node"])
        word_hashes.cache_clear()

    return df.select("text").mapInArrow(run, "sig long, node long")


def candidates(df: DataFrame, words: int, share: int) -> DataFrame:
    """Links (a, b) of each node to the least node of a bucket, all buckets."""
    star = signed(df, words, share).withColumn("b", F.min("node").over(Window.partitionBy("sig").orderBy("node"))).filter("node <> b")
    return star.select(F.col("node").alias("a"), "b").distinct()


Hits = Callable[[slice, slice], np.ndarray]


def forest(size: np.ndarray, share: int, small: np.ndarray, hub: np.ndarray, cross: np.ndarray | None, hits: Hits) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that ``hits`` finds among sets of ascending ``size``, tile by tile.

    Pairs of two ``small`` sets are left to their own band, pairs of one ``hub`` (0: none) are linked by it; with
    ``cross`` only pairs of different blocks count.
    """
    label, out, n = np.arange(len(size)), [], len(size)
    for a in range(0, n, TILE):
        x = slice(a, min(a + TILE, n))
        for b in range(a, n, TILE):
            y = slice(b, min(b + TILE, n))
            if 100 * size[x.stop - 1] < share * size[b]:
                break  # no later set can be similar to one of this tile
            hit = hits(x, y) & ~(small[x, None] & small[None, y]) & ((hub[x, None] != hub[None, y]) | (hub[x, None] == 0))
            if cross is not None:
                hit &= cross[x, None] != cross[None, y]
            for p in (np.flatnonzero(hit.any(1)) + a).tolist():
                q = np.flatnonzero(hit[p - a]) + b
                for k in q[(q > p) & (label[q] != label[p])].tolist():
                    if label[k] != label[p]:
                        label[label == label[k]] = label[p]
                        out.append((p, k))
    return out


def similar(sets: list[np.ndarray], share: int) -> Hits:
    """Which pairs of sets reach the threshold, by their common shingles."""
    # Only shingles of two sets or more can be common; they are numbered.
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    by = np.argsort(flat, kind="stable")
    same = flat[by][1:] == flat[by][:-1]
    again = np.append(same, False) | np.append(False, same)
    feature, owner = (np.cumsum(np.append(True, ~same)) - 1)[again], owner[by][again]
    by = np.argsort(owner, kind="stable")
    feature, owner = feature[by], owner[by]
    at = np.searchsorted(owner, np.arange(len(sets) + 1))

    def hits(x: slice, y: slice) -> np.ndarray:
        fx, ox = feature[at[x.start] : at[x.stop]], owner[at[x.start] : at[x.stop]] - x.start
        fy, oy = feature[at[y.start] : at[y.stop]], owner[at[y.start] : at[y.stop]] - y.start
        used = np.intersect1d(fx, fy)
        place = [np.searchsorted(used, f) for f in (fx, fy)]
        common = np.zeros((x.stop - x.start, y.stop - y.start), np.float32)
        ok = [used[np.minimum(k, len(used) - 1)] == f for k, f in zip(place, (fx, fy))] if len(used) else []
        for lo in range(0, len(used), 8192):
            dense = []
            for k, o, good, n in zip(place, (ox, oy), ok, common.shape):
                m = good & (k >= lo) & (k < lo + 8192)
                dense.append(np.zeros((n, min(8192, len(used) - lo)), np.float32))
                dense[-1][o[m], k[m] - lo] = 1
            common += dense[0] @ dense[1].T
        return 100 * common >= share * (size[x, None] + size[None, y] - common)

    return hits


def near(counts: np.ndarray, size: np.ndarray, share: int) -> Hits:
    """Which pairs of sets their sketches leave possible."""

    def hits(x: slice, y: slice) -> np.ndarray:
        apart = np.array([np.abs(counts[y] - row).sum(1, dtype=np.int32) for row in counts[x]])
        return apart * (100 + share) <= (size[x, None] + size[None, y]) * (100 - share)

    return hits


def placed(members: DataFrame, weight: str, limit: int) -> DataFrame:
    """``members`` (with comp and node) with key, block and pair: whole components in shared bins, large ones as pairs of blocks.

    A member of a large component is a row for each pair of blocks that its own is in.
    """
    parts = members.groupBy(F.col("comp").alias("of_comp")).agg(F.ceil(F.sum(weight) / limit).cast("long").alias("parts"))
    total = members.agg(F.sum(F.col(weight).cast("long"))).first()[0] or 0
    bins = int(total // limit * 4 + 24)
    out = members.join(parts, F.col("comp") == F.col("of_comp")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")))
    out = out.withColumn("with", F.explode(F.when(F.col("parts") == 1, F.array("block")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
    none = F.lit(-1).cast("long")
    key = F.when(F.col("parts") == 1, F.struct(F.pmod(F.xxhash64("comp"), F.lit(bins)).alias("k"), none.alias("i"), none.alias("j")))
    key = key.otherwise(F.struct(F.col("comp").alias("k"), F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j")))
    return out.withColumn("key", key).withColumn("pair", F.col("key.i") != F.col("key.j")).drop("parts", "of_comp", "with")


def by_component(group: pa.Table) -> Iterator[np.ndarray]:
    """Rows of each component in a group, by ascending size, each node once."""
    comp, node, n = (group.column(c).to_numpy() for c in ("comp", "node", "n"))
    order = np.lexsort((node, n, comp))
    order = order[np.append(True, (comp[order][1:] != comp[order][:-1]) | (node[order][1:] != node[order][:-1]))]
    cuts = np.append(np.flatnonzero(np.append(True, comp[order][1:] != comp[order][:-1])), len(order))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield order[lo:hi]


def linked(df: DataFrame, share: int, payload: str, out: str, prepare: Callable[[list[bytes], np.ndarray], Hits]) -> DataFrame:
    """Forest links (a, b), in terms of the column ``out``, of the pairs that ``prepare(payloads, sizes)`` finds."""

    def run(group: pa.Table) -> pa.Table:
        claim("ngram_join", word_hashes.cache_clear)
        block, pair, small, hub, n, name = (group.column(c).to_numpy() for c in ("block", "pair", "small", "hub", "n", out))
        held = group.column(payload).cast(pa.binary()).combine_chunks()
        a, b = [], []
        for rows in by_component(group):
            payloads = [x or b"" for x in held.take(pa.array(rows)).to_pylist()]
            for p, q in forest(n[rows], share, small[rows], hub[rows], block[rows] if pair[rows[0]] else None, prepare(payloads, n[rows])):
                a.append(int(name[rows[p]]))
                b.append(int(name[rows[q]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return df.groupBy("key").applyInArrow(run, "a long, b long")


def hub_distances(df: DataFrame, words: int, share: int) -> DataFrame:
    """(node, sid, to, linked, near) of the rows of each (comp, part), which also holds its hub: the sets that reach
    the threshold with it, and those that a member of its cluster may reach it with."""

    def run(group: pa.Table) -> pa.Table:
        claim("ngram_join", word_hashes.cache_clear)
        node, sid, hub = (group.column(c).to_numpy() for c in ("node", "sid", "is_hub"))
        texts = group.column("text").cast(pa.binary()).to_pylist()
        at = int(np.flatnonzero(hub)[0])
        centre = shingles(texts[at] or b"", words)
        found = []
        for i in np.flatnonzero(~hub).tolist():
            h = shingles(texts[i] or b"", words)
            common = int((centre[np.minimum(np.searchsorted(centre, h), len(centre) - 1)] == h).sum())
            union = len(h) + len(centre) - common
            found.append((int(node[i]), int(sid[i]), int(sid[at]), 100 * common >= share * union, 100 * common >= (2 * share - 100) * union))
        cols = list(zip(*found)) or [()] * 5
        kinds = [pa.int64()] * 3 + [pa.bool_()] * 2
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("node", "sid", "to", "linked", "near"), cols, kinds)})

    return df.groupBy("comp", "part").applyInArrow(run, "node long, sid long, to long, linked boolean, near boolean")


def hubs(members: DataFrame, star: DataFrame, with_text: Callable[[DataFrame], DataFrame], words: int, share: int) -> tuple[DataFrame, DataFrame | None]:
    """``members`` with a ``hub`` (0: none), large components broken up by rounds of hubs, and the links found (a, b of sids).

    A component above the bounds of one task gives its cluster, which then meets only the sets near the hub, under a
    component of their own; the rest stays and has its next round.
    """
    links, done = None, members.withColumns({"hub": F.lit(0).cast("long"), "ring": F.lit(False)})
    degree = star.groupBy(F.col("b").alias("of_b")).agg(F.count("*").alias("degree"))
    for step in range(HUB_ROUNDS):
        sizes = done.filter("NOT ring").groupBy(F.col("comp").alias("c")).agg(F.count("*").alias("k"), F.sum("n").alias("held"))
        sizes = sizes.filter((F.col("k") > BLOCK_NODES) | (F.col("held") > BLOCK_SHINGLES)).select("c", F.ceil(F.greatest(F.col("k") / BLOCK_NODES, F.col("held") / BLOCK_SHINGLES)).cast("long").alias("parts"))
        large = done.filter("NOT ring").join(sizes, F.col("comp") == F.col("c")).drop("c")
        rows = large.join(degree, F.col("node") == F.col("of_b"), "left")
        centre = rows.groupBy("comp").agg(F.max_by(F.struct("node", "sid", "rep", "mark", "parts"), F.struct(F.coalesce("degree", F.lit(0)), "node")).alias("x")).select("comp", "x.*")
        centre = table(centre, "ngram-hubs")
        if centre.isEmpty():
            drop_table(centre)
            break
        key = ["comp", "node", "sid", "rep", "mark"]
        all_rows = large.select(*key, F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), F.lit(False).alias("is_hub")).unionByName(
            centre.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_hub"))
        )
        found = table(hub_distances(with_text(all_rows), words, share), "ngram-hub-links")
        new = found.filter("linked AND sid <> to").select(F.col("sid").alias("a"), F.col("to").alias("b"))
        links = new if links is None else links.union(new)
        told = done.filter("NOT ring").join(found.select(F.col("node").alias("of_node"), "to", "linked", "near"), F.col("node") == F.col("of_node"), "left")
        # The cluster and what is near it meet in a component of their own, the rest goes on.
        # What is in such a ring takes no part in later rounds, so its sets stay together.
        ring, none = F.xxhash64("comp", F.lit(step)), F.lit(0).cast("long")
        roles = F.when(F.col("linked"), F.array(F.struct(ring.alias("comp"), F.col("to").alias("hub"), F.lit(True).alias("ring"))))
        roles = roles.when(F.col("near"), F.array(F.struct(ring.alias("comp"), none.alias("hub"), F.lit(True).alias("ring")), F.struct("comp", none.alias("hub"), F.lit(False).alias("ring"))))
        roles = roles.otherwise(F.array(F.struct("comp", "hub", "ring")))
        keep = [c for c in members.columns if c != "comp"]
        dealt = told.withColumn("x", F.explode(roles)).select("x.comp", *keep, "x.hub", "x.ring")
        done = table(done.filter("ring").select("comp", *keep, "hub", "ring").unionByName(dealt), "ngram-parted")
        # Only clusters with a set near them have anything left to compare.
        open_ = done.filter("hub = 0").select(F.col("comp").alias("open")).distinct()
        done = done.join(open_, F.col("comp") == F.col("open"), "left_semi")
        release(members.sparkSession)
    return done, links


def join_components(df: DataFrame, words: int = 4, share: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links of ``share`` hundredths or more)."""
    spark = df.sparkSession
    df = id_text(df, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    docs = table(describe(df, words, share), "ngram-sets")
    star = table(candidates(df, words, share), "ngram-candidates")
    release(spark)
    groups = components(star, "ngram-groups")
    sets = docs.filter("sid IS NOT NULL").groupBy("sid").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), *(F.min(c).alias(c) for c in ("n", "own", "next", "sketch")))
    roles = F.explode(F.array(F.struct(F.col("own").alias("node"), F.lit(False).alias("small")), F.struct(F.col("next").alias("node"), F.lit(True).alias("small"))))
    nodes = sets.select("sid", F.col("rep.doc_id").alias("rep"), F.col("rep.mark").alias("mark"), "n", "sketch", roles.alias("x")).select("sid", "rep", "mark", "n", "sketch", "x.*")
    members = table(groups.withColumnRenamed("node", "of_node").join(nodes, F.col("of_node") == F.col("node")).drop("of_node"), "ngram-members")
    drop_table(groups)
    texts = df.filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("mark").alias("m"), "text")

    def with_text(rows: DataFrame) -> DataFrame:
        """A set's text is that of the row (doc_id, mark) which stands for it. Texts whose mark falls in no bucket of
        those sought are left where they are; at most ``MARK_BUCKETS`` bucket numbers are sent out for that."""
        bucket = lambda c: F.pmod(c, F.lit(MARK_BUCKETS))
        sought = F.broadcast(rows.select(bucket(F.col("mark")).alias("sought")).distinct())
        some = texts.join(sought, bucket(F.col("m")) == F.col("sought"), "left_semi")
        return rows.join(some, F.col("rep").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m"))).drop("id", "m", "rep", "mark")

    parted, links = hubs(members, star, with_text, words, share)

    def thin(payloads: list[bytes], n: np.ndarray) -> Hits:
        counts = [np.frombuffer(x, np.uint16).astype(np.int32) for x in payloads]
        if min(map(len, counts)) < max(map(len, counts)):
            counts = [c.reshape(SKETCH, -1).sum(1) for c in counts]
        return near(np.array(counts), n, share)

    possible = table(linked(placed(parted.withColumn("one", F.lit(1)), "one", BLOCK_NODES), share, "sketch", "node", thin), "ngram-possible")
    thinned = components(possible, "ngram-thinned")
    of = thinned.toDF("of_node", "to_comp")
    once = parted.groupBy("node").agg(*(F.max(c).alias(c) for c in ("sid", "rep", "mark", "n", "small", "hub")))
    left = table(once.join(of, F.col("of_node") == F.col("node")).select(F.col("to_comp").alias("comp"), "node", "sid", "rep", "mark", "n", "small", "hub"), "ngram-thin-members")
    exact = linked(with_text(placed(left, "n", BLOCK_SHINGLES)), share, "text", "sid", lambda payloads, n: similar([shingles(t, words) for t in payloads], share))
    links = table(exact if links is None else exact.union(links), "ngram-links")
    release(spark)
    found = components(links, "ngram-components")
    label = docs.join(found.withColumnRenamed("node", "of_sid"), docs["sid"] == F.col("of_sid"), "left").select("doc_id", "n", F.coalesce("comp", "sid").alias("c"))
    label = table(label, "ngram-labels")
    for used in (docs, star, members, possible, thinned, left, links, found):
        drop_table(used)
    # As a table of its own, so that the rows of a component with very many are split over tasks as they meet it.
    least = table(label.filter("c IS NOT NULL").groupBy(F.col("c").alias("of_c")).agg(F.min("doc_id").alias("m")), "ngram-least")
    return label.join(least, label["c"] == least["of_c"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("m", "doc_id").alias("component_id"))
