"""Functions without Spark."""

import random

from annalist.functions import chunks
from annalist.streaming import memory


def test_paragraphs_keep_all_words():
    rng = random.Random(1)
    text = "\n\n".join(" ".join("w" * rng.randint(1, 9) + ("." if rng.random() < 0.1 else "") for _ in range(rng.randint(1, 80))) for _ in range(12))
    out = chunks.by_paragraph(text, 40)
    assert " ".join(out).split() == text.split() and all(len(c) <= 180 for c in out)
    assert chunks.by_paragraph(None, 40) == [] == chunks.by_paragraph("", 40)


def test_separators_cover_the_text():
    text = "One two three. Four five six! See https://example.com/a/long/path?x=1 now. " * 9
    out = chunks.by_separator(text, 60, 0)
    assert "".join(out) == text and all(len(c) <= 60 for c in out)
    over = chunks.by_separator(text, 60, 10)
    assert all(b.startswith(a[-10:]) for a, b in zip(over, over[1:]))
    assert chunks.by_separator(None, 5, 1) == []


def test_partial_ratio():
    assert chunks.partial_ratio("Rain", "a rainy day") == 100.0
    assert chunks.partial_ratio("", "") == 100.0 and chunks.partial_ratio("x", None) == 0.0
    assert 70 < chunks.partial_ratio("abcd", "zzabxdzz") < 80

    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert chunks.common_length(a, b) == slow(a, b)


def test_diverse():
    assert chunks.diverse([0.9, 0.8, 0.7], [[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]], 0.5) == [0, 2]


def test_segments_and_compaction():
    assert memory.segments_by_weight([5, 5, 5, 5, 5], 10, [True, True, False, True, True]) == [0, 0, 0, 1, 1]
    fold = lambda s, out: f"{s}+{len(out)}"
    summary, recent = memory.compact(["x" * 30] * 9, 40, fold)
    assert len(summary) // 3 + sum(len(r) // 3 for r in recent) <= 40
    assert sum(map(int, summary.strip("+").split("+"))) + len(recent) == 9
    assert memory.compact([], 10, fold) == ("", [])


def test_headings_carry_their_path():
    text = "before\n# One\n\n## Two ##\nbody 2\n```\n# not a heading\n```\n# Next\nlast\n### Deep\n\n#tag\n"
    got = [(c["path"], c["text"]) for c in chunks.by_heading(text)]
    assert got == [([], "before"), (["One", "Two"], "body 2\n```\n# not a heading\n```"), (["Next"], "last"), (["Next", "Deep"], "#tag")]
    assert chunks.by_heading(None) == [] == chunks.by_heading(" \n ")


def test_recursive_chunks_give_back_the_text():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["\n\n", "\n", ". ", " ", "ab", "x" * 9, "é😀"]) for _ in range(rng.randrange(80)))
        for size in (1, 7, 30):
            out = chunks.recursively(text, size)
            assert "".join(out) == text and all(0 < len(c) <= size for c in out) and all(len(a) + len(b) > size for a, b in zip(out, out[1:]))
    assert chunks.recursively("One two. Three four.\n\nFive", 14) == ["One two. ", "Three four.\n\n", "Five"]
    assert chunks.recursively(None, 5) == []
