"""Best-window similarity against a plain table of common subsequences over all windows."""

import random

import pytest

from annalist.functions import chunks
from annalist.operators import fuzzy


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute(a, b):
    a, b = (a or "").lower(), (b or "").lower()
    a, b = (b, a) if len(a) > len(b) else (a, b)
    if not a:
        return 0.0 if b else 100.0
    windows = [b[max(0, k) : k + len(a)] for k in range(1 - len(a), len(b))]
    return max(200.0 * lcs(a, w) / (len(a) + len(w)) for w in windows)


@pytest.mark.parametrize("alphabet", ["ab", "abcdeé 😀", "ABCDEFGHIJKLMNOPqrstuv "])
def test_ratios(alphabet):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    for n in (1, 2, 3, 9, 17):
        texts = [text(rng.randrange(60)) for _ in range(25)] + ["", None]
        p = text(n)
        assert fuzzy.ratios([p], texts)[0].round(6).tolist() == [round(brute(p, t), 6) for t in texts]
    for n in (63, 64, 65, 130):
        p = text(n)
        texts = [text(rng.randrange(n, 170)) for _ in range(4)] + [text(40), p[5:-5] + text(20)]
        assert fuzzy.ratios([p], texts)[0].round(6).tolist() == [round(brute(p, t), 6) for t in texts]
    assert fuzzy.ratios([None], ["", "a"])[0].tolist() == [100.0, 0.0]
    assert chunks.partial_ratio("abc d", "xx abcd yy") == fuzzy.ratios(["zz", "abc d"], ["xx abcd yy"])[1, 0]


def test_best_matches(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    rows = [(i, text(rng.randrange(30)), 1) for i in range(80)] + [(90, None, 1), (None, "abc", 1), (91, "abcd", 1), (91, "abcd", 1)]
    asked = [(1, "abcd"), (2, "a"), (3, None), (None, "b"), (4, text(40))]
    got = fuzzy.best_matches(spark.createDataFrame(asked, "q long, p string"), spark.createDataFrame(rows, "id long, t string, ratio int"), 5, "q", "p", "id", "t")
    want = []
    for q, p in asked:
        if q is not None:
            best = sorted((-round(brute(p, t), 6), i) for i, t, _ in rows if i is not None)[:5]
            want += [(q, i, -r, n + 1) for n, (r, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
