"""Hard negatives by product quantisation with stored residual norms.

Each vector is cut into pieces; a piece is stored as the number of its nearest codeword and the norm of what is left
(rounded up). For an anchor q, the lookup table of q with all codewords gives a score s of every row, and the sum of
|q piece| * |residual piece| a bound e with |true score - s| <= e. Rows that s and e cannot rule out of a window are
scored again exactly, in whole numbers, so the result doesn't depend on the codewords.

Blocks of anchors meet blocks of rows in tasks; a task returns a few rows for each anchor or window, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import column, drop_table, table
from annalist.llm.vectors import integers, matrix, packed, products, unpacked, widths

#: Components of a piece, codewords of a piece, vectors that codewords are fitted on (about; no other use is bounded).
PIECE, CODEWORDS, FIT_ROWS, FIT_ROUNDS = 2, 256, 4_096, 6
#: Rows and anchors that meet in a task, and anchors whose scores are held at once.
ROW_BLOCK, ANCHOR_BLOCK, AT_ONCE = 4_096, 1_024, 64
#: Where scores stay.
SCORES = -(2.0**63), 2.0**63
#: Share of the sizes at hand that a bound grows by, for rounding.
ROOM = 1e-9


def pieces(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` as (row, piece, component), filled up with zeros."""
    return np.pad(x.astype(np.float64), ((0, 0), (0, -x.shape[1] % PIECE))).reshape(len(x), -1, PIECE)


def codebook(x: np.ndarray) -> np.ndarray:
    """Codewords (piece, codeword, component) by k-means from evenly spread rows; with few rows, the rows themselves."""
    own = pieces(x).transpose(1, 0, 2)
    words = own[:, np.linspace(0, len(x) - 1, min(CODEWORDS, len(x))).astype(int)].copy()
    for book, rows in zip(words, own, strict=True):
        for _ in range(FIT_ROUNDS if len(x) > CODEWORDS else 0):
            near = ((book**2).sum(1) - 2 * rows @ book.T).argmin(1)
            n = np.bincount(near, minlength=len(book))
            sums = np.stack([np.bincount(near, rows[:, c], len(book)) for c in range(PIECE)], 1)
            book[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


def fit(points: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Codewords by width, from about ``FIT_ROWS`` rows spread by hash (at most twice as many)."""
    some = points.filter(F.pmod(F.xxhash64("row"), F.lit(count // FIT_ROWS + 1)) == 0).limit(2 * FIT_ROWS).select("row", "v").collect()
    some = sorted(some, key=lambda r: r["row"])
    return {w: codebook(np.array([r["v"] for r in some if len(r["v"]) == w])) for w in {len(r["v"]) for r in some} if w}


def encode(points: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """The index: vec_id, label, row, width, codes (a byte a piece), norms (a half a piece, rounded up), held (the vector).

    A vector of a width without codewords has no codes; nothing is ruled out for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = column(batch, "v")
            own = widths(v).astype(np.int64)
            out: list[tuple] = [(b"", b"", b"\1")] * len(own)
            for w in np.unique(own[own > 0]).tolist():
                at = np.flatnonzero(own == w)
                x = matrix(v.take(pa.array(at)), w)
                codes, norms = np.zeros((len(at), 0), np.uint8), np.zeros((len(at), 0), np.float16)
                if w in books:
                    codes, norms = coded(pieces(x), books[w])
                for i, c, n, row in zip(at.tolist(), codes, norms, x, strict=True):
                    out[i] = (c.tobytes(), n.tobytes(), packed(row[None]))
            made = [pa.array([o[k] for o in out], pa.binary()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in ("vec_id", "label", "row")), pa.array(own, pa.int32()), *made], ["vec_id", "label", "row", "width", "codes", "norms", "held"])

    return points.select("vec_id", "label", "row", "v").mapInArrow(run, "vec_id long, label long, row long, width int, codes binary, norms binary, held binary")


def coded(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.empty(x.shape[:2], np.uint8)
    norms = np.empty(x.shape[:2], np.float64)
    for m, words in enumerate(book):
        codes[:, m] = ((words**2).sum(1) - 2 * x[:, m] @ words.T).argmin(1)
        norms[:, m] = np.sqrt(((x[:, m] - words[codes[:, m]]) ** 2).sum(1)) * (1 + ROOM)
    with np.errstate(over="ignore"):
        return codes, np.nextafter(norms.astype(np.float16), np.float16(np.inf))


class Block:
    """The index rows of a task, of one width."""

    def __init__(self, rows: pa.Table, at: np.ndarray, width: int, book: np.ndarray | None):
        take = lambda n: rows.column(n).take(pa.array(at))
        self.ids, self.labels = take("vec_id").to_numpy(), take("label").to_numpy()
        self.x = np.concatenate([unpacked(h, width).astype(np.int64) for h in take("held").to_pylist()]) if width else np.zeros((len(at), 0), np.int64)
        self.book = book
        if book is not None:
            self.codes = np.frombuffer(b"".join(take("codes").to_pylist()), np.uint8).reshape(len(at), -1)
            self.norms = np.frombuffer(b"".join(take("norms").to_pylist()), np.float16).reshape(len(at), -1).astype(np.float64)

    def ranges(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of anchors with all rows, each (anchor, row)."""
        if self.book is None:
            none = np.full((len(q), len(self.ids)), np.inf)
            return -none, none
        own = pieces(q)
        score = np.zeros((len(self.ids), len(q)))
        for m, words in enumerate(self.book):
            score += (words @ own[:, m].T)[self.codes[:, m]]
        far = np.sqrt((self.book**2).sum(2)).max(1)
        sizes = np.sqrt((own**2).sum(2))
        with np.errstate(invalid="ignore"):
            room = np.nan_to_num(self.norms @ sizes.T, nan=np.inf, posinf=np.inf) * (1 + ROOM) + ROOM * (sizes @ far)[None] + 1e-6
        return np.clip((score - room).T, *SCORES), np.clip((score + room).T, *SCORES)

    def exact(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return products(q[None], self.x[at])[0]


def highest(x: np.ndarray, k: int) -> float:
    """The k-th largest; no bound where there are fewer."""
    return float(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else -np.inf


def dealt(anchors: DataFrame, index: DataFrame, count: int, n_anchors: int):
    """Cogroups of a block of anchors and a block of the index, by row number, so that no label or id is one block."""
    n, m = n_anchors // ANCHOR_BLOCK + 1, count // ROW_BLOCK + 1
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = anchors.withColumn("ab", F.pmod(F.xxhash64("q"), F.lit(n)).cast("int")).withColumn("rb", each(m))
    right = index.withColumn("rb", F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")).withColumn("ab", each(n))
    return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb"))


def met(asked: pa.Table, rows: pa.Table, books: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, Block, np.ndarray, np.ndarray]]:
    """Places and vectors of some anchors, the rows of their width, and the ranges of the scores."""
    mine, theirs = (np.array(t.column("width").to_pylist(), np.int64) for t in (asked, rows))
    for w in np.intersect1d(mine, theirs).tolist():
        block = Block(rows, np.flatnonzero(theirs == w), w, books.get(w))
        places = np.flatnonzero(mine == w)
        for lo in range(0, len(places), AT_ONCE):
            at = places[lo : lo + AT_ONCE]
            q = matrix(asked.column("v").take(pa.array(at)), w)
            yield at, q, block, *block.ranges(q)


def positives(anchors: DataFrame, index: DataFrame, books: dict, count: int, n_anchors: int, k: int) -> DataFrame:
    """q, positive_id, positive_score and place (from 1): the k best other rows of each anchor's label."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = [], [], []
        ids, labels = asked.column("own").to_numpy(), asked.column("label").to_numpy()
        for at, q, block, low, high in met(asked, rows, books):
            for i, place in enumerate(at.tolist()):
                keep = np.flatnonzero((block.labels == labels[place]) & (block.ids != ids[place]))
                keep = keep[high[i, keep] >= highest(low[i, keep], k)]
                s = block.exact(q[i], keep)
                best = np.lexsort((block.ids[keep], -s))[:k]
                out[0].extend([place] * len(best))
                out[1].extend(block.ids[keep[best]].tolist())
                out[2].extend(s[best].tolist())
        return pa.table({"q": asked.column("q").take(pa.array(out[0], pa.int64())), "positive_id": pa.array(out[1], pa.int64()), "positive_score": pa.array(out[2], pa.int64())})

    found = dealt(anchors, index, count, n_anchors).applyInArrow(run, "q long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("positive_score").desc(), "positive_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def negatives(anchors: DataFrame, index: DataFrame, books: dict, count: int, n_anchors: int, k: int, share: int) -> DataFrame:
    """q, place, negative_id, negative_score and rank: for each window of an anchor the k best rows of other labels in it.

    A window goes from ``share`` hundredths of a positive's score to that score.
    """

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = [], [], [], []
        labels, windows = asked.column("label").to_numpy(), asked.column("windows").to_pylist()
        for at, q, block, low, high in met(asked, rows, books):
            for i, place in enumerate(at.tolist()):
                wide = [(w["place"], -(-share * w["positive_score"] // 100), w["positive_score"]) for w in windows[place] if w["positive_score"] >= 0]
                if not wide:
                    continue
                at_all = np.flatnonzero((block.labels != labels[place]) & (high[i] >= min(w[1] for w in wide)) & (low[i] <= max(w[2] for w in wide)))
                lo, hi, known = low[i, at_all], high[i, at_all], np.zeros(len(at_all), bool)
                scores = np.zeros(len(at_all), np.int64)
                for nth, least, largest in wide:
                    maybe = (hi >= least) & (lo <= largest)
                    maybe &= hi >= highest(lo[(lo >= least) & (hi <= largest)], k)
                    new = np.flatnonzero(maybe & ~known)
                    scores[new] = block.exact(q[i], at_all[new])
                    known |= maybe
                    own = np.flatnonzero(maybe & (scores >= least) & (scores <= largest))
                    best = own[np.lexsort((block.ids[at_all[own]], -scores[own]))[:k]]
                    out[0].extend([place] * len(best))
                    out[1].extend([nth] * len(best))
                    out[2].extend(block.ids[at_all[best]].tolist())
                    out[3].extend(scores[best].tolist())
        return pa.table({"q": asked.column("q").take(pa.array(out[0], pa.int64())), "place": pa.array(out[1], pa.int32()), "negative_id": pa.array(out[2], pa.int64()), "negative_score": pa.array(out[3], pa.int64())})

    found = dealt(anchors, index, count, n_anchors).applyInArrow(run, "q long, place int, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("q", "place").orderBy(F.col("negative_score").desc(), "negative_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)


def mine(
    df: DataFrame, is_anchor: Column, label: Column, k_positive: int = 5, k_negative: int = 5, share: int = 80, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of vectors whose components became floor(scale * x). Each anchor has its
    ``k_positive`` best other rows of the same ``label``; for each of them the ``k_negative`` best rows of other labels
    are returned whose score is at most the positive's and at least ``share`` hundredths of it. Ties go to the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Rows with the anchor's id
    are not its positives. Otherwise repeated rows count each by itself; equal anchor rows ask once, and what their
    positives of one id return is one set for each positive row. Vectors of another width than the anchor's are
    neither. A positive of negative score has no window. An empty table gives an empty one. Scores beyond the range of
    a long stay at its end.
    """
    rows = integers(df, scale, id_col, vector, {"label": label.cast("long"), "anchor": F.coalesce(is_anchor, F.lit(False))}).filter("label IS NOT NULL")
    points = table(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-points")
    count = points.count()
    books = fit(points, count)
    index = table(encode(points, books), "negatives-index")
    asks = points.filter("anchor").select(F.col("vec_id").alias("own"), "label", "v").dropDuplicates()
    asks = table(asks.withColumn("q", F.monotonically_increasing_id()).withColumn("width", F.size("v")), "negatives-anchors")
    n_anchors = asks.count()
    good = table(positives(asks, index, books, count, n_anchors, k_positive), "negatives-positives")
    windows = good.groupBy("q").agg(F.collect_list(F.struct("place", "positive_score")).alias("windows"))  # k_positive at most
    hard = negatives(asks.join(windows, "q"), index, books, count, n_anchors, k_negative, share)
    named = good.join(hard, ["q", "place"]).join(asks.select("q", F.col("own").alias("anchor_id")), "q")
    out = table(named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives-result")
    for done in (points, index, asks, good):
        drop_table(done)
    return out


def oracle() -> str:
    from annalist.llm.ball_tree import KEPT

    dot = lambda a, b: f"CAST(CASE WHEN len({a}) = 0 THEN 0 ELSE list_inner_product({a}, {b}) END AS BIGINT)"
    return f"""
WITH {KEPT.format(scale=256)},
rows_ AS (SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM kept WHERE label IS NOT NULL),
anchors AS (SELECT DISTINCT vec_id, label, v FROM rows_ WHERE vec_id % 100 = 0),
scored AS (SELECT a.vec_id AS anchor_id, a.v AS av, c.vec_id, a.label = c.label AS same, a.label, {dot("a.v", "c.v")} AS score
  FROM anchors a JOIN rows_ c ON c.vec_id <> a.vec_id AND len(a.v) = len(c.v)),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, av, label ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) WHERE place <= 5),
hard AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.av, p.label, p.place ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND n.av = p.av AND n.label = p.label AND NOT n.same AND 100 * n.score BETWEEN 80 * p.score AND 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 5"""
