"""Language identification by compression with per-language dictionaries.

For each language a raw-content dictionary is filled with texts of that language. A text is encoded by zstandard
with every dictionary, in chunks, and the language whose dictionary gives the fewest bytes is chosen. Where the
lead over the second language is narrow the text is marked as rejected.

The dictionaries are the fitted model, of a bounded sample: of at most ``ROWS`` texts a language, in the order of a
hash of id and text and those of ``LEAST_CHARS`` to ``MOST_CHARS`` characters first, whole texts are taken as long as
they fit in ``DICT_BYTES``. A single text above that bound, where a language has no other, counts with that many
bytes. Everything else covers all rows and whole texts.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected; ties go to the language
first in order of name; equal texts get equal results; no training row leaves every row ``und``; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import blocks, column, id_text, remainder

UNKNOWN = "und"
#: Bounds of the sample that is learned from, for each language.
ROWS, LEAST_CHARS, MOST_CHARS = 60, 200, 8_000
DICT_BYTES = 64 << 10
#: Texts above this size are not sent to the driver for a dictionary.
MOST_BYTES = 4 * DICT_BYTES
#: Texts are encoded in pieces of so many bytes, so that a dictionary counts in all parts of a long text.
CHUNK_BYTES = 2_048
LEVEL, SHORT_LEVEL, SHORT_BYTES = 6, 12, 600
#: A lead below this share of the smallest size rejects.
MARGIN = 0.01
LETTER = regex.compile(r"\p{L}")
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """What is encoded: lower-cased words, a blank between them; marks, digits and case say little of a language."""
    return (" " + OTHER.sub(" ", text.lower()).strip() + " ").encode()


def fit(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary content by language, from the rows where ``train`` holds and text and language are given."""
    size = F.length(text_col)
    rows = df.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    odd = ~size.between(LEAST_CHARS, MOST_CHARS)
    keys = rows.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), odd.alias("odd"), F.xxhash64(id_col, text_col).alias("h"), F.octet_length(text_col).alias("bytes"))
    best = keys.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("odd", "h", "i"))).filter(F.col("k") <= ROWS)
    # Texts that the dictionary has no room for stay where they are; without any that fits, the first gives its beginning.
    best = best.withColumn("fits", F.max(F.col("bytes") <= MOST_BYTES).over(Window.partitionBy("l"))).filter((F.col("bytes") <= MOST_BYTES) | (~F.col("fits") & (F.col("k") == 1)))
    least = F.broadcast(best.select("i", "l", "k"))  # ROWS rows a language at most
    found = rows.join(least, (F.col(id_col) == F.col("i")) & (F.col(lang_col) == F.col("l"))).select("l", "k", F.substring(text_col, 1, MOST_BYTES).alias("t"))
    texts: dict[str, list[str]] = {}
    for r in found.orderBy("l", "k").collect():
        texts.setdefault(r["l"], []).append(r["t"])
    return {lang: sample(list(map(letters, t))) for lang, t in sorted(texts.items())}


def sample(texts: list[bytes]) -> bytes:
    """Whole texts, as many as fit; the first stands last, where references to it are cheapest."""
    held = b""
    for t in texts:
        if len(t) + len(held) <= DICT_BYTES:
            held = t + held
    return held or texts[0][:DICT_BYTES]


class Classifier:
    def __init__(self, model: dict[str, bytes]):
        self.langs = sorted(model)
        make = lambda d, level: zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        raw = [model[x] for x in self.langs]
        self.by_level = {level: [make(zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level) for d in raw] for level in (LEVEL, SHORT_LEVEL)}

    def sizes(self, text: bytes) -> list[int]:
        ways = self.by_level[SHORT_LEVEL if len(text) <= SHORT_BYTES else LEVEL]
        parts = [text[i : i + CHUNK_BYTES] for i in range(0, len(text), CHUNK_BYTES)]
        return [sum(len(c.compress(p)) for p in parts) for c in ways]

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the lead is too narrow."""
        if not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(letters(text))
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        least = sizes[order[0]]
        if len(order) == 1:
            return self.langs[0], 1.0, False
        lead = sizes[order[1]] - least
        score = 1.0 / sum(math.exp(-min(50.0, (s - least) / 2.0)) for s in sizes)
        return self.langs[order[0]], score, lead < MARGIN * least


def predict(df: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``lang_pred``, ``score`` and ``rejected`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x DICT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(shared.value)
        for block in blocks(batches):
            found = [own.predict(t or "") for t in column(block, "text").to_pylist()]
            lang, score, rejected = zip(*found)
            yield pa.RecordBatch.from_arrays([column(block, "doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    df = id_text(df, id_col, text_col)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def identify(df: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learn from the rows outside the held-out fold, predict all."""
    own = df.select("doc_id", "text", "lang")
    model = fit(own, remainder(F.col("doc_id"), folds) != held)
    out = predict(own, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score", "rejected")
