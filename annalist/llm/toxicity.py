"""Toxicity of texts behind obfuscated spelling: a noisy channel decoded by Viterbi, then a lexical score.

1. A character trigram model is counted over all texts.
2. A token that is not plain letters becomes a lattice: each character may stand for itself, for the letters it
   imitates (``4`` for ``a``), for any letter (``*`` inside a word), for nothing (a separator between spelled-out
   letters, a stretched repetition). Viterbi finds the likeliest letters under the trigram model. Runs of single
   characters between blanks are joined to one token first.
3. Restored words are scored by a lexicon of log odds learned from labelled rows; the strongest words of a text
   and its size go through a logistic function.

The classifier (lexicon and logistic weights) is fitted on at most ``ROWS_PER_CLASS`` labelled rows of each class,
chosen by the hash of the id and weighted back to the class sizes. The trigram counts cover all rows.

Defined results: null and empty texts and texts without words score as a text without evidence; several labels of
one id count as toxic if any does; null labels are no labels; without labels of both classes every score is 0;
equal texts get equal scores; an empty table gives an empty table; a text of any length is read whole; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import append, as_bytes, blocks, claim, column, id_text

ROWS_PER_CLASS = 10_000
THRESHOLD = 0.7
#: Symbols of the language model: 0 a word's edge, 1 to 26 letters, 27 any other letter.
SYMBOLS, OTHER = 28, 27
#: Which letters a character may imitate.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "§": "s"}
HOMOGLYPHS = str.maketrans("аеорсухікьνοραεικτυ", "aeopcyxikbvopaeiktu")
WILD, GAPS = "*", ".-_~,'·*/\\"
#: Log probabilities of the channel.
SAME, IMITATE, ANY, DROP, STRETCH = -0.01, -1.2, -3.5, -2.0, -0.7
PLAIN = re.compile(r"[^\W\d_]+\Z")
TRIPLE = re.compile(r"(.)\1\1")
DOUBLE = re.compile(r"(.)\1+")
SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
HIDDEN = re.compile("[​-‏⁠﻿­]")
FRONT, BACK = ".,;:\"'[]{}>#%&*-_=?~`^/\\", ".,;:\"'()[]{}<>#%&*-_=?!~`^/\\|$+@"
#: Only words in so many toxic rows, and so much likelier in toxic rows, enter the lexicon.
LEAST_ROWS, LEAST_LIFT = 3, 3.0
#: Tokens that one Python worker remembers.
CACHE_TOKENS = 150_000
TOP = 3


def symbol_table() -> np.ndarray:
    """UTF-8 byte to symbol; 255 for the bytes inside a character."""
    table = np.zeros(256, np.uint8)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = i + 1
    table[0x80:0xC0] = 255
    table[0xC3:] = OTHER
    return table


def trigrams(df: DataFrame) -> np.ndarray:
    """Counts of symbol trigrams over all texts; a table of fixed size, summed by task and then by code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = symbol_table(), np.zeros(SYMBOLS**3, np.int64)
        for block in blocks(batches):
            s = table[np.frombuffer(b"\n \n".join(["".encode(), *as_bytes(block), b""]), np.uint8)]
            s = s[s != 255].astype(np.int32)
            s = s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))]
            counts += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3) if len(s) > 2 else 0
        codes = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts[codes], pa.int64())], ["code", "n"])

    out = np.zeros(SYMBOLS**3)
    for r in df.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r["code"]] = r["n"]
    return out.reshape((SYMBOLS,) * 3)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of the third symbol after the first two; trigrams fall back to bigrams and letters."""
    one = counts.sum((0, 1)) + 1.0
    one /= one.sum()
    two = counts.sum(0)
    two = (two + 20.0 * one) / (two.sum(1, keepdims=True) + 20.0)
    three = (counts + 20.0 * two[None]) / (counts.sum(2, keepdims=True) + 20.0)
    return np.log(three)


def symbol(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else OTHER if ch.isalpha() else 0


class Decoder:
    """Viterbi over the lattice of a token; states are the last two letters."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def choices(self, token: str, i: int) -> list[tuple[str, float]]:
        """What the i-th character may stand for, with the channel's log probability; the empty string for nothing."""
        ch, last = token[i], i == len(token) - 1
        if ch.isalpha():
            out = [(ch, SAME)]
        else:
            out = [(x, IMITATE) for x in LOOKS.get(ch, "")]
            if ch == WILD and 0 < i and not last:
                out += [(chr(97 + k), ANY) for k in range(26)]
            out.append(("", 3 * DROP if ch in LOOKS else DROP))
        if i and token[i - 1] == ch:
            out.append(("", STRETCH))
        return out

    def restore(self, token: str) -> str:
        """The likeliest word. What all paths have in common is written out on the way, so a token of any length is
        decoded as one in time linear in it."""
        model, done = self.model, []
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for i in range(len(token)):
            step: dict[tuple[int, int], tuple[float, str]] = {}
            options = self.choices(token, i)
            for (a, b), (score, text) in states.items():
                for ch, cost in options:
                    if ch:
                        c = symbol(ch)
                        key, found = (b, c), (score + cost + model[a][b][c], text + ch)
                    else:
                        key, found = (a, b), (score + cost - 2.5, text)  # what a letter costs on average
                    if key not in step or found > step[key]:
                        step[key] = found
            states = step
            if i % 32 == 31:
                done.append(os.path.commonprefix([t for _, t in states.values()]))
                states = {key: (s, t[len(done[-1]) :]) for key, (s, t) in states.items()}
        return "".join(done) + max((s + model[a][b][0], t) for (a, b), (s, t) in states.items())[1]


class Restorer:
    def __init__(self, model: np.ndarray):
        self.decoder = Decoder(model)
        self.known: dict[str, tuple[str, ...]] = {}

    def forms(self, token: str) -> tuple[str, ...]:
        """Features of one observed token: its restored word, and that word without doubled letters."""
        token = token.lower()
        if not token.isascii():
            token = HIDDEN.sub("", unicodedata.normalize("NFKC", token))
            if re.search("[a-z]", token):
                token = token.translate(HOMOGLYPHS)
        core = token.lstrip(FRONT).rstrip(BACK)
        if not core or not any(c.isalpha() or c in LOOKS for c in core) or core.isdigit():
            return ()
        if not PLAIN.match(core) or TRIPLE.search(core):
            core = self.decoder.restore(core)
        if not core:
            return ()
        return ("=" + core, "~" + DOUBLE.sub(r"\1", core))

    def tokens(self, text: str) -> set[str]:
        """Distinct observed tokens; spelled-out runs also as one."""
        found = set(text.split())
        if " " in text:
            found.update(m.group().replace(" ", "").replace("\t", "") for m in SPELLED.finditer(text))
        return found

    def features(self, text: str) -> set[str]:
        known, out = self.known, set()
        for token in self.tokens(text):
            forms = known.get(token)
            if forms is None:
                if len(known) >= CACHE_TOKENS:
                    known.clear()
                forms = known[token] = self.forms(token)
            out.update(forms)
        return out


def log_odds(n1, n0, all1: float, all0: float):
    return np.log((n1 + 0.3) / (all1 + 0.6)) - np.log((n0 + 0.3) / (all0 + 0.6))


@dataclass
class Model:
    language: np.ndarray
    lexicon: dict[str, float]
    weights: list[float]


class Scorer:
    def __init__(self, model: Model):
        self.restorer, self.model = Restorer(model.language), model
        self.weight: dict[str, float] = {}

    def token_weight(self, token: str) -> float:
        lexicon = self.model.lexicon
        return max((lexicon.get(f, 0.0) for f in self.restorer.forms(token)), default=0.0)

    def score(self, text: str) -> float:
        if not self.model.weights:
            return 0.0
        known = self.weight
        tokens = self.restorer.tokens(text)
        new = [t for t in tokens if t not in known]
        if len(known) + len(new) > CACHE_TOKENS:
            known.clear()
            new = list(tokens)
        for t in new:
            known[t] = self.token_weight(t)
        found = [known[t] for t in tokens]
        z = sum(a * b for a, b in zip(self.model.weights, evidence(found, len(tokens))))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def evidence(weights: list[float], n: int) -> list[float]:
    """The strongest weights, the strong ones by text size, the size, and one."""
    top = heapq.nlargest(TOP, weights)
    top += [0.0] * (TOP - len(top))
    return [*top, sum(w - 2.0 for w in weights if w > 2.0) / math.sqrt(n + 1.0), math.log1p(n), 1.0]


def labelled(labels: DataFrame, train: Column) -> tuple[DataFrame, dict[int, int]]:
    """At most ROWS_PER_CLASS ids of each class, and the sizes of the classes."""
    own = labels.filter(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    own = own.groupBy(F.col("doc_id").alias("label_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    sizes = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [own.filter(F.col("y") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(ROWS_PER_CLASS) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), sizes


def fit(df: DataFrame, labels: DataFrame, train: Column) -> Model:
    """``df`` has doc_id and text; ``labels`` doc_id and toxic; ``train`` is a condition on the labels' doc_id."""
    df = id_text(df)
    language = language_model(trigrams(df))
    ids, sizes = labelled(labels, train)
    if not sizes.get(0) or not sizes.get(1):
        return Model(language, {}, [])
    rows = df.join(F.broadcast(ids), df["doc_id"] == F.col("label_id")).select("text", "y")  # 2 x ROWS_PER_CLASS ids
    shared = df.sparkSession.sparkContext.broadcast(language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", lambda: None)
        restorer, held = Restorer(shared.value), {}

        def rows_held() -> pa.RecordBatch:
            n = np.array(list(held.values()), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(n[:, 0]), pa.array(n[:, 1])], ["f", "n0", "n1"])

        for block in blocks(batches):
            for text, y in zip(column(block, "text").to_pylist(), column(block, "y").to_pylist()):
                for f in restorer.features(text or ""):
                    if f in held:
                        held[f][y] += 1
                    else:
                        held[f] = [1 - y, y]
                if len(held) > 100_000:
                    yield rows_held()
                    held = {}
        yield rows_held()

    words = rows.mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n1, n0 = (min(sizes[y], ROWS_PER_CLASS) for y in (1, 0))
    strong = words.filter((F.col("n1") >= LEAST_ROWS) & (F.col("n1") > LEAST_LIFT * n1 / n0 * F.col("n0"))).toArrow()
    counted = dict(zip(strong.column("f").to_pylist(), zip(strong.column("n1").to_pylist(), strong.column("n0").to_pylist())))
    counts = df.sparkSession.sparkContext.broadcast(counted)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Evidence of each labelled row as if it had not been counted itself."""
        restorer, known = Restorer(shared.value), counts.value
        for block in blocks(batches):
            out, ys = [], column(block, "y").to_pylist()
            for text, y in zip(column(block, "text").to_pylist(), ys):
                tokens = restorer.tokens(text or "")
                best = []
                for token in tokens:
                    w = 0.0
                    for f in restorer.known.get(token) or restorer.known.setdefault(token, restorer.forms(token)):
                        if (c := known.get(f)) is not None and c[0] - y >= LEAST_ROWS - 1:
                            w = max(w, math.log((c[0] - y + 0.3) / (n1 + 0.6)) - math.log((c[1] - (1 - y) + 0.3) / (n0 + 0.6)))
                    best.append(w)
                if len(restorer.known) > CACHE_TOKENS:
                    restorer.known.clear()
                out.append(evidence(best, len(tokens)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())), pa.array(ys, pa.int32())], ["x", "y"])

    got = rows.mapInArrow(measure, "x array<double>, y int").toArrow()  # 2 x ROWS_PER_CLASS rows
    if not got.num_rows:
        return Model(language, {}, [])
    x, y = np.array(got.column("x").to_pylist()), got.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    weight = np.where(y == 1, sizes[1] / n1, sizes[0] / n0)
    lexicon = {f: float(w) for f, (a, b) in counted.items() if (w := log_odds(a, b, n1, n0)) > 0}
    return Model(language, lexicon, logistic(x, y, weight / weight.mean()))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Weights by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (weight * (p - y)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def score(df: DataFrame, model: Model) -> DataFrame:
    """``df`` (with a string column text) and ``score double``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        claim("toxicity", lambda: None)
        own = Scorer(shared.value)
        return lambda block: [pa.array([own.score(t or "") for t in column(block, "text").to_pylist()], pa.float64())]

    return append(df, start, "score double")


def judge(df: DataFrame, labels: DataFrame, held_out, train: Column) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    own = id_text(df)
    out = score(own, fit(own, labels, train))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
