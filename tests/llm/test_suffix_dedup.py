import hashlib
import random
from collections import Counter

import pytest

from annalist.llm import suffix_dedup as D


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(i), len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df, length, gram, hot=D.HOT):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in D.remove_repeats(df, length, gram, hot).collect())


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(2, 7)))
    shared = [" ".join(word() for _ in range(rng.choice([6, 12, 30]))) for _ in range(6)]
    texts = []
    for _ in range(50):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(0, 6))]
        texts.append(" ".join(parts))
    return [*texts, texts[7], "ab" * 200, "ab" * 90 + "c" + "ab" * 90, None, "", "x" * 39, "x" * 40, "y" * 41]


@pytest.mark.parametrize("hot", [D.HOT, 1])
def test_like_brute_force(spark, hot):
    rows = list(enumerate(corpus(6)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, 40, 12, hot) == brute(rows, 40)


def test_segments_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT", 64)
    texts = [t for t in corpus(8) if t]
    for which, offset, held in D.segments([t.encode() for t in texts], 40):
        assert all(texts[i].encode()[o : o + len(h)] == h for i, o, h in zip(which, offset, held))
    starts = [(i, o + k) for which, offset, held in D.segments([t.encode() for t in texts], 40) for i, o, h in zip(which, offset, held) for k in range(len(h) - 39)]
    assert sorted(starts) == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 39)]


def test_kept_texts_and_spans(spark):
    shared = "zwölf Boxkämpfer jagen Viktor über den Deich, "
    rows = [(1, "ä" + shared + "eins"), (2, "zwei " + shared), (3, "short"), (4, None), (5, shared), (6, shared)]
    df = spark.createDataFrame(rows, "item long, body string").repartition(3)
    got = {r["doc_id"]: r for r in D.cut_repeats(df, 40, 12, id_col="item", text_col="body").collect()}
    n = len(shared.encode())
    assert {i: [(x["a"], x["b"]) for x in r["spans"]] for i, r in got.items()} == {1: [(2, 2 + n)], 2: [(5, 5 + n)], 3: [], 4: [], 5: [(0, n)], 6: [(0, n)]}
    assert {i: bytes(r["kept"]) for i, r in got.items()} == {1: "äeins".encode(), 2: b"zwei ", 3: b"short", 4: b"", 5: b"", 6: b""}


def test_passages_of_just_under_and_of_the_length(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    filler = lambda n: " ".join(word() for _ in range(n))
    passage = filler(80)
    under, just = passage[:399], passage[:400]
    rows = [(1, f"{filler(90)}A{under}B{filler(5)}"), (2, f"C{under}D{filler(70)}"), (3, filler(60) + "E" + just + "F"), (4, "G" + just + "H" + filler(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(under.split()) > 50
    assert [r[2] for r in got(df, 400, 100)] == [0, 0, 400, 400]
    assert got(df, 400, 100) == brute(rows, 400)


def test_odd_rows(odd, none, odd_rows):
    assert got(odd, 400, 100) == brute([r[:2] for r in odd_rows], 400)
    assert D.remove_repeats(none).collect() == []


def test_merge_never_disagrees_with_sorting():
    rng = random.Random(3)
    for n in (1, 2, 3, 5, 9):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 30))) for _ in range(n)]
        coded = [D.front_code(r) for r in runs]
        source, index, lcp = D.merge_runs([D.Run(a.tobytes(), b.tobytes(), c) for a, b, c in coded])
        merged = [runs[s][i] for s, i in zip(source, index)]
        assert merged == sorted(x for r in runs for x in r)
        assert lcp[1:] == [D.shared(a, b) for a, b in zip(merged, merged[1:])]
