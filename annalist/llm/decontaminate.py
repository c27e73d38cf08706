"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all documents give the TF-IDF weights.
2. A randomised SVD of the TF-IDF passages of the benchmark items (windows of the largest of ``SIZES`` words that
   the item fills) gives a latent space: the passages are multiplied with a random matrix and back in the tasks that hold them, the driver only
   orthonormalises a matrix of at most ``BUCKETS`` by ``RANK + EXTRA``; a second pass rotates it.
3. Each document's windows are folded in, once for each size that the items have, so that a short item is compared
   with windows of its own length. Windows with little weight in words of the benchmark are passed over; of the rest,
   cosines with all passages of their size give candidates. Items with a passage of which the space keeps less than
   ``BLIND`` have no cosine worth the name; they are candidates (cosine 0) wherever enough of their words stand.
4. A candidate holds if the longest common subsequence of item and region carries ``SURE`` of the item's weight, or
   ``LIKELY`` of it while the answer is there too: the item's answer column if given, else its last sentence.

The space is fitted on at most ``FIT_PASSAGES`` passages, chosen by hash; all items are indexed, in blocks of
``BLOCK_ITEMS`` items if there are more, and all windows of all documents are searched.

Defined results: null and empty texts have no hits; items without words match nothing; repeated documents get equal
hits; equal items each hit; an empty benchmark gives no hits; a text of any length is searched whole; other columns
are kept as they are by ``with_hits``, but for one called ``hits``, which the result takes the place of, and ignored
by ``contaminated``; names that begin with ``_hits_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import append, as_bytes, blocks, claim, column, id_text

BUCKETS = 1 << 17
#: Words of a window. Windows of documents begin at every fourth part of one.
SIZES = (24, 16, 12, 8, 6, 4, 3, 2, 1)
RANK, EXTRA, SEED = 48, 8, 7
FIT_ITEMS, BLOCK_ITEMS = 20_000, 10_000
#: Least share of a window's weight in benchmark words, and least cosine.
GATE, COSINE = 0.2, 0.5
#: Least share of a passage's length that its latent vector keeps.
BLIND = 0.05
SURE, LIKELY, ANSWER = 0.8, 0.6, 0.8
BASE = 0xD6E8FEB86659FD93
BASE_BACK = pow(BASE, -1, 2**64)
MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(n + 4096, b, np.uint64)), dtype=np.uint64) for b in (BASE, BASE_BACK)]
    return _powers[0][:n], _powers[1][:n]


def forget() -> None:
    """Named, so that a task clears its own worker's table and no copy of it travels along."""
    _powers.clear()


def byte_table() -> np.ndarray:
    """Lower-case ASCII letters, digits and bytes of other characters as they are; 0 between words."""
    table = np.zeros(256, np.uint8)
    for lo, hi in ((48, 58), (97, 123), (128, 256)):
        table[lo:hi] = np.arange(lo, hi)
    table[65:91] = np.arange(97, 123)
    return table


TABLE = byte_table()


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and where each text ends among them."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    if (data >= 0xC4).any():  # letters beyond Latin-1 that may have a lower case
        texts = [t if t.isascii() else t.decode("utf-8", "replace").lower().encode() for t in texts]
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    upper = np.append(False, (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))
    data = TABLE[data]
    data[upper] |= 0x20
    up, back = powers(len(data))
    inside = data != 0
    edge = np.flatnonzero(np.append(inside[0], inside[1:] != inside[:-1]))
    start, end = edge[::2], edge[1::2]
    sums = np.append(np.uint64(0), np.cumsum(data.astype(np.uint64) * up))
    h = (sums[end] - sums[start]) * back[start]
    h = (h ^ (h >> np.uint64(29))) * MIX
    ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]) - 1, side="right")
    return h ^ (h >> np.uint64(32)), ends


def bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def frequencies(df: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold a word of each bucket, and the number of documents; the sums have a row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("decontaminate", forget)
        counts, n = np.zeros(BUCKETS, np.int64), 0
        for block in blocks(batches, limit=1 << 18):
            h, ends = words(as_bytes(block))
            n += block.num_rows
            if len(h):
                doc = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
                key = np.sort(doc * BUCKETS + bucket(h))
                counts += np.bincount(key[np.append(True, key[1:] != key[:-1])] & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], n))], ["b", "n"])

    out = df.select("text").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    b, n = out.column("b").to_numpy(), out.column("n").to_numpy()
    counts = np.zeros(BUCKETS)
    counts[b[b >= 0]] = n[b >= 0]
    return counts, int(n[b < 0].sum())


def passages(n: int) -> list[tuple[int, int]]:
    """Windows over an item of ``n`` words, half overlapping, the last one at its end."""
    if not n:
        return []
    size = next(k for k in SIZES if k <= n)
    starts = [*range(0, n - size, max(1, size // 2)), n - size]
    return [(s, s + size) for s in starts]


def passage_matrix(texts: list[bytes], idf: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], list[np.ndarray]]:
    """(item, word buckets) of each passage, and the word hashes of each item."""
    h, ends = words(texts)
    own = [h[a:b] for a, b in zip(np.append(0, ends[:-1]), ends)]
    return [(i, bucket(x[a:b])) for i, x in enumerate(own) for a, b in passages(len(x))], own


def fit(items: DataFrame, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary (bucket to row, -1 outside) and projection rows of the latent space.

    The words of all items, ``BUCKETS`` rows at most, span the space; only its axes are turned by a bounded sample.
    """
    sample = items.select("text").orderBy(F.xxhash64("text"), "text").limit(FIT_ITEMS)
    shared = items.sparkSession.sparkContext.broadcast(idf)
    k = RANK + EXTRA

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of A' (A R) for a random R that each task makes from the seed."""
        weights, random = shared.value, np.random.default_rng(SEED).standard_normal((BUCKETS, k), np.float32)
        total: dict[int, np.ndarray] = {}
        for block in blocks(batches):
            for _, b in passage_matrix(as_bytes(block), weights)[0]:
                x = weights[b] / max(1e-9, np.linalg.norm(weights[b]))
                y = x @ random[b]
                for w, v in zip(b.tolist(), x[:, None] * y):
                    total[w] = total[w] + v if w in total else v
        rows = np.array(list(total.values()), float).reshape(-1, k)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["b", "v"])

    sums = [F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(k)]
    got = items.select("text").mapInArrow(multiply, "b long, v array<double>").groupBy("b").agg(*sums).orderBy("b").toArrow()
    b = got.column("b").to_numpy()
    vocabulary = np.full(BUCKETS, -1, np.int32)
    vocabulary[b] = np.arange(len(b))
    if not len(b):
        return vocabulary, np.zeros((0, 1), np.float32)
    q = np.linalg.qr(np.column_stack([got.column(f"v{i}").to_numpy() for i in range(k)]))[0]
    space = items.sparkSession.sparkContext.broadcast((vocabulary, q))

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, (place, basis) = shared.value, space.value
        total = np.zeros((basis.shape[1],) * 2)
        for block in blocks(batches):
            for _, b in passage_matrix(as_bytes(block), weights)[0]:
                x = weights[b] / max(1e-9, np.linalg.norm(weights[b]))
                y = x @ basis[place[b]]
                total += np.outer(y, y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    found = sample.mapInArrow(gram, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow()
    size = q.shape[1]
    _, rotate = np.linalg.eigh(found.column("v").to_numpy().reshape(size, size))
    return vocabulary, (q @ rotate[:, ::-1][:, :RANK]).astype(np.float32)


@dataclass
class Index:
    """Weights and space, and a block of items: word hashes, answers, and latent passages."""

    idf: np.ndarray
    vocabulary: np.ndarray
    projection: np.ndarray
    item_ids: list
    items: list[np.ndarray]
    answers: list[np.ndarray]
    owner: np.ndarray
    vectors: np.ndarray
    sizes: np.ndarray


def build(rows: list, idf: np.ndarray, vocabulary: np.ndarray, projection: np.ndarray) -> Index:
    """``rows``: item_id, text, answer (or None)."""
    parts, own = passage_matrix([(r["text"] or "").encode() for r in rows], idf)
    said = [r["answer"] if r["answer"] else last_sentence(r["text"] or "") for r in rows]
    h, ends = words([a.encode() for a in said])
    answers = [h[a:b] for a, b in zip(np.append(0, ends[:-1]), ends)]
    vectors = [fold(b[None, :], idf, vocabulary, projection)[0] for _, b in parts]
    return Index(idf, vocabulary, projection, [r["item_id"] for r in rows], own, answers, np.array([i for i, _ in parts], np.int64), np.array(vectors, np.float32).reshape(-1, projection.shape[1]), np.array([len(b) for _, b in parts], np.int64))


def last_sentence(text: str) -> str:
    parts = [p for p in text.replace("\n", " ").split(". ") if p.strip()]
    return parts[-1] if parts else ""


def fold(b: np.ndarray, idf: np.ndarray, vocabulary: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Unit latent vectors of windows given as rows of buckets; -1 is no word."""
    place = np.where(b >= 0, vocabulary[b], -1)
    weight = np.where(place >= 0, idf[b], 0).astype(np.float32)
    out = np.zeros((len(b), projection.shape[1]), np.float32)
    for j in range(b.shape[1]):
        out += weight[:, j, None] * projection[np.maximum(place[:, j], 0)] if len(projection) else 0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def common_weight(item: np.ndarray, region: np.ndarray, weight: np.ndarray) -> float:
    """Weight of the heaviest common subsequence of an item and a region."""
    before = np.zeros(len(region) + 1)
    for h, w in zip(item, weight):
        now = np.maximum(before[1:], np.where(region == h, before[:-1] + w, 0.0))
        before[1:] = np.maximum.accumulate(now)
    return float(before[-1])


class Searcher:
    def __init__(self, index: Index):
        self.x = index
        self.weights = [index.idf[bucket(h)] for h in index.items]
        self.pairs = [list(zip(h.tolist(), w.tolist())) for h, w in zip(index.items, self.weights)]
        self.sizes = np.array([len(h) for h in index.items], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        flat = np.concatenate([*index.items, np.zeros(0, np.uint64)])
        self.known, self.flat = np.unique(flat, return_inverse=True)
        self.flat_weights = np.concatenate([*self.weights, np.zeros(0)])
        self.member = np.zeros(len(self.known) + 1, bool)
        self.inside = (index.vocabulary >= 0).astype(np.float64)
        weight = np.zeros(len(index.projection), np.float32)
        weight[index.vocabulary[index.vocabulary >= 0]] = index.idf[index.vocabulary >= 0]
        self.rows = np.vstack([index.projection * weight[:, None], np.zeros((1, index.projection.shape[1]), np.float32)])

        self.blind = self.blind_items()
        self.posts, self.post_ends = self.blind_posts()

    def folded(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``fold`` of windows over ``b``, in order of their starts, by running sums over the words that they cover."""
        base, n = start[0], end.max() - start[0]
        open_at = np.bincount(start - base, minlength=n + 1) - np.bincount(end - base, minlength=n + 1)
        covered = np.cumsum(open_at)[:n] > 0
        place = np.append(0, np.cumsum(covered))
        sums = np.zeros((place[-1] + 1, self.rows.shape[1]))
        np.cumsum(self.rows[self.x.vocabulary[b[base : base + n][covered]]], axis=0, out=sums[1:])  # -1 is the row of zeros
        out = (sums[place[end - base]] - sums[place[start - base]]).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def blind_items(self) -> np.ndarray:
        x, out = self.x, set()
        for i, h in enumerate(x.items):
            b = bucket(h)
            for s, e in passages(len(h)):
                latent = self.rows[x.vocabulary[b[s:e]]].sum(axis=0)
                if np.linalg.norm(latent) < BLIND * np.linalg.norm(x.idf[b[s:e]]):
                    out.add(i)
        return np.array(sorted(out), np.int64)

    def blind_posts(self) -> tuple[np.ndarray, np.ndarray]:
        """Blind items by word, of each item's heaviest words so many that a document without any of them can't pass."""
        pairs = []
        for i in self.blind.tolist():
            at = slice(self.offsets[i], self.offsets[i] + self.sizes[i])
            w, first = np.unique(self.flat[at], return_index=True)
            weight = np.bincount(np.searchsorted(w, self.flat[at]), self.flat_weights[at])
            order = np.argsort(-weight, kind="stable")
            n = int(np.searchsorted(np.cumsum(weight[order]), (1 - LIKELY + 1e-6) * weight.sum())) + 1
            pairs += [(x, i) for x in w[order[:n]].tolist()]
        pairs.sort()
        return np.array([p[1] for p in pairs], np.int64), np.searchsorted([p[0] for p in pairs], np.arange(len(self.known)), side="right")

    def blind_candidates(self, own: np.ndarray) -> np.ndarray:
        """The blind items that a document with the words ``own`` may hold."""
        own = np.unique(own[own >= 0])
        end = self.post_ends[own]
        n = end - np.where(own > 0, self.post_ends[own - 1], 0)
        at = np.repeat(end - np.cumsum(n), n) + np.arange(n.sum())
        return np.unique(self.posts[at])

    def coverable(self, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Which of the items can still pass, by the weight of their words that stand anywhere in a document."""
        self.member[word] = True
        self.member[-1] = False
        sizes = self.sizes[item]
        first = np.cumsum(sizes) - sizes
        at = np.repeat(self.offsets[item] - first, sizes) + np.arange(sizes.sum())
        weight = self.flat_weights[at]
        there = np.add.reduceat(weight * self.member[self.flat[at]], first)
        self.member[word] = False
        return there >= (LIKELY - 1e-9) * np.add.reduceat(weight, first)

    def search(self, texts: list[bytes]) -> list[list[dict]]:
        x, out = self.x, [[] for _ in texts]
        if not len(x.vectors):
            return out
        h, ends = words(texts)
        begins = np.append(0, ends[:-1])
        b = bucket(h)
        word = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        word = np.where(self.known[word] == h, word, -1)
        squares = x.idf[b] ** 2
        every = np.append(0.0, np.cumsum(squares))
        known = np.append(0.0, np.cumsum(squares * self.inside[b]))
        found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        for size in SIZES:
            own = np.flatnonzero(x.sizes == size)
            if not len(own):
                continue
            step = max(1, size // 4)
            counts = np.where(ends > begins, np.maximum(0, ends - begins - size + step - 1) // step + 1, 0)
            doc = np.repeat(np.arange(len(texts)), counts)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = begins[doc] + nth * step
            end = np.minimum(start + size, ends[doc])
            keep = known[end] - known[start] >= GATE * (every[end] - every[start])
            keep &= every[end] > every[start]
            start, end, doc = start[keep], end[keep], doc[keep]
            for lo in range(0, len(start), 4096):
                s, e = start[lo : lo + 4096], end[lo : lo + 4096]
                cosine = self.folded(b, s, e) @ x.vectors[own].T
                i, j = np.nonzero(cosine >= COSINE)
                cuts = np.append(np.flatnonzero(np.diff(doc[lo + i], prepend=-1)), len(i))
                for a, z in zip(cuts[:-1], cuts[1:]):
                    d, owner = int(doc[lo + i[a]]), x.owner[own[j[a:z]]]
                    item = np.unique(owner)
                    item = item[self.coverable(item, word[begins[d] : ends[d]])]
                    for k in a + np.flatnonzero(np.isin(owner, item)) if len(item) else ():
                        found.setdefault((d, int(owner[k - a])), []).append((float(cosine[i[k], j[k]]), int(s[i[k]]), int(e[i[k]])))
        for d in range(len(texts)) if len(self.blind) else ():
            own = word[begins[d] : ends[d]]
            near = self.blind_candidates(own)
            for item in near[self.coverable(near, own)].tolist() if len(near) else ():
                at = begins[d] + np.flatnonzero(np.isin(own, self.flat[self.offsets[item] : self.offsets[item] + self.sizes[item]]))
                found.setdefault((d, item), []).extend((0.0, k, k + 1) for k in at.tolist())
        for (d, item), hits in found.items():
            if (hit := self.check(item, hits, h, begins[d], ends[d])) is not None:
                out[d].append(hit)
        return out

    def check(self, item: int, hits: list[tuple[float, int, int]], h: np.ndarray, begin: int, end: int) -> dict | None:
        """The best region around the candidate windows, if it passes."""
        own, weight = self.x.items[item], self.weights[item]
        total, room = float(weight.sum()), len(own)
        regions: list[list] = []
        for cosine, s, e in sorted(hits, key=lambda t: t[1:]):
            if regions and s <= regions[-1][2] + room:
                regions[-1][2] = max(regions[-1][2], e)
                regions[-1][0] = max(regions[-1][0], cosine)
            else:
                regions.append([cosine, s, e])
        best = None
        for cosine, s, e in regions:
            lo, hi = max(begin, s - room), min(end, e + room)
            region = h[lo:hi]
            there = set(region.tolist())
            if sum(w for x, w in self.pairs[item] if x in there) < LIKELY * total:
                continue  # no subsequence can carry more than the words that are there
            share = common_weight(own, region, weight) / max(total, 1e-9)
            if share < LIKELY or (share < SURE and not self.answered(item, region)):
                continue
            if best is None or share > best["lcs"]:
                best = {"item_id": self.x.item_ids[item], "cosine": cosine, "lcs": share, "start": int(lo - begin), "stop": int(hi - begin)}
        return best

    def answered(self, item: int, region: np.ndarray) -> bool:
        answer = self.x.answers[item]
        if not len(answer):
            return False
        weight = self.x.idf[bucket(answer)]
        return common_weight(answer, region, weight) >= ANSWER * float(weight.sum())


def with_hits(df: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", answer_col: str | None = None) -> DataFrame:
    """``df`` (with a string column text) and ``hits``: item, cosine, share of the common subsequence, region in words."""
    counts, n = frequencies(df)
    idf = np.log((n + 1.0) / (counts + 1.0)) + 0.1
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"), answer.alias("answer")).filter("text IS NOT NULL")
    vocabulary, projection = fit(items, idf)
    parts = items.count() // BLOCK_ITEMS + 1
    kind = "array<struct<item_id:string,cosine:double,lcs:double,start:int,stop:int>>"
    arrow = pa.list_(pa.struct([("item_id", pa.string()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("start", pa.int32()), ("stop", pa.int32())]))
    names = []
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()  # about BLOCK_ITEMS
        shared = df.sparkSession.sparkContext.broadcast(build(rows, idf, vocabulary, projection))

        def start(shared=shared):
            claim("decontaminate", forget)
            own = Searcher(shared.value)
            return lambda block: [pa.array(own.search(as_bytes(block)), arrow)]

        names.append(f"_hits_{part}")
        df = append(df, start, f"{names[-1]} {kind}", limit=1 << 19)
    return df.withColumn("hits", F.concat(*map(F.col, names))).drop(*names)


def contaminated(df: DataFrame, benchmark: DataFrame, answer_col: str | None = None) -> DataFrame:
    """doc_id, item_id, cosine and lcs of every document that holds a benchmark item."""
    kind = benchmark.schema["item_id"].dataType
    out = with_hits(id_text(df), benchmark, answer_col=answer_col).select("doc_id", F.explode("hits").alias("hit"))
    return out.select("doc_id", F.col("hit.item_id").cast(kind).alias("item_id"), "hit.cosine", "hit.lcs")
