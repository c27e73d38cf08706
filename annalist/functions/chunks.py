"""Chunkers and similarity that need a scan of the text; plain functions and their Arrow forms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql.functions import pandas_udf

#: Characters that stand for one token.
TOKEN_CHARS = 3
URL = re.compile(r"https?://\S+")
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", " ")


def pack(parts: list[str], size: int, glue: str) -> list[str]:
    """Neighbouring parts put together as long as they fit; a part that does not fit stands alone."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(glue) + len(p) <= size:
            out[-1] += glue + p
        else:
            out.append(p)
    return out


def by_paragraph(text: str | None, tokens: int) -> list[str]:
    """Paragraphs packed to a size; longer ones cut at sentences, longer sentences at half as many characters again."""
    size = tokens * TOKEN_CHARS
    parts: list[str] = []
    for p in (x.strip() for x in re.split(r"\n\s*\n", text or "")):
        if not p:
            continue
        if len(p) <= size:
            parts.append(p)
            continue
        whole = int(size * 1.5)
        cut = [s[i : i + whole] for s in re.split(r"(?<=[.!?])\s+", p) for i in range(0, len(s), whole)]
        parts += pack(cut, size, " ")
    return pack(parts, size, "\n\n")


def by_separator(text: str | None, size: int, overlap: int) -> list[str]:
    """Windows of ``size`` characters that end behind the last separator of the first kind found in their second half.

    A cut inside a web address moves to its start. The next window begins ``overlap`` characters before the cut.
    """
    text = text or ""
    urls = [m.span() for m in URL.finditer(text)]
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            for sep in SEPARATORS:
                k = text.rfind(sep, at + size // 2, end)
                if k > 0:
                    end = k + len(sep)
                    break
            for a, b in urls:
                if a < end < b and a > at:
                    end = a
        out.append(text[at:end])
        if end == len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits for each character of ``b``."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    row = 0
    for ch in b:
        x = row | places.get(ch, 0)
        row = x & ~(x - (row << 1 | 1))
    return row.bit_count()


def partial_ratio(a: str | None, b: str | None) -> float:
    """Best similarity (0 to 100) of the shorter text with a window of the longer one, case aside."""
    a, b = (a or "").lower(), (b or "").lower()
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    best = 0.0
    for k in range(1 - len(a), len(b)):
        w = b[max(0, k) : k + len(a)]
        best = max(best, 200.0 * common_length(a, w) / (len(a) + len(w)))
    return best


def diverse(scores: list[float], similar: list[list[float]], bar: float) -> list[int]:
    """Places in order of score (ties by place) of those not more similar than ``bar`` to one taken before."""
    taken: list[int] = []
    for i in sorted(range(len(scores)), key=lambda i: (-scores[i], i)):
        if all(similar[i][j] <= bar for j in taken):
            taken.append(i)
    return taken


def paragraph_chunks(tokens: int):
    @pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: by_paragraph(t, tokens))

    return run


def separator_chunks(size: int, overlap: int):
    @pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: by_separator(t, size, overlap))

    return run


HEADING = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t#]*$")
#: From the widest to the narrowest; the empty one cuts anywhere.
CUTS = ("\n\n", "\n", ". ", "。", " ", "")


def by_heading(text: str | None) -> list[dict]:
    """path and text of each section of a Markdown text that is not blank: the headings above it, outermost first.

    A heading closes all headings of its level and below. Lines inside a fence are text.
    """
    out: list[dict] = []
    stack: list[tuple[int, str]] = []
    held: list[str] = []
    fence = None

    def close() -> None:
        if (body := "\n".join(held).strip()):
            out.append({"path": [h for _, h in stack], "text": body})
        held.clear()

    for line in (text or "").split("\n"):
        mark = line.lstrip()[:3]
        if mark in ("```", "~~~"):
            fence = None if fence == mark else fence or mark
        m = None if fence or mark in ("```", "~~~") else HEADING.match(line)
        if m is None:
            held.append(line)
            continue
        close()
        while stack and stack[-1][0] >= len(m[1]):
            stack.pop()
        stack.append((len(m[1]), m[2]))
    close()
    return out


def recursively(text: str | None, size: int) -> list[str]:
    """Pieces of at most ``size`` characters that joined give the text, cut at the widest separators that do.

    Level by level, the pieces that are too long are cut behind the next separator; then neighbours are joined again as
    long as they fit.
    """
    pieces = [text] if text else []
    for sep in CUTS:
        if all(len(p) <= size for p in pieces):
            break
        cut: list[str] = []
        for p in pieces:
            if len(p) <= size:
                cut.append(p)
            elif sep:
                parts = p.split(sep)
                cut += [x for x in (*(q + sep for q in parts[:-1]), parts[-1]) if x]
            else:
                cut += [p[i : i + size] for i in range(0, len(p), size)]
        pieces = cut
    out: list[str] = []
    for p in pieces:
        if out and len(out[-1]) + len(p) <= size:
            out[-1] += p
        else:
            out.append(p)
    return out


def heading_chunks():
    @pandas_udf("array<struct<path:array<string>,text:string>>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(by_heading)

    return run


def recursive_chunks(size: int):
    @pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: recursively(t, size))

    return run
