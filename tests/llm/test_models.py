"""Toxicity, language identification and decontamination."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import decontaminate, langid, toxicity
from annalist.llm.common import remainder

ENGLISH = "the cat sat on a mat while rain fell over quiet streets and people walked home to eat warm bread with their friends after work".split()
GERMAN = "der hund lief durch den wald und die kinder spielten im garten während der regen leise auf das alte dach des hauses fiel".split()


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(ENGLISH) for _ in range(rng.randint(8, 60))]
        bad = i % 5 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "scumbag", "stupid"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_behind_spelling(spark, toxic_rows, odd, none):
    rows, labels = toxic_rows
    hidden = ["you 1d10t of the rain", "what a st*pid cat on a mat", "s t u p i d people walked home", "an iiidiooot sat over streets", "such a scumb@g in the rain"]
    clean = ["the cat sat on a mat", "people walked home to eat", "", None, "555 123 4567", "quiet streets $$$ ***"]
    df = spark.createDataFrame([*rows, *((1000 + i, t) for i, t in enumerate(hidden)), *((2000 + i, t) for i, t in enumerate(clean))], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (0, None), (None, 1)], "doc_id long, toxic int")
    held = lambda i: remainder(i, 3) == 1
    got = {r["doc_id"]: r for r in toxicity.judge(df, marks, held, ~held(F.col("doc_id"))).collect()}
    assert [i for i in range(5) if got[1000 + i]["predicted"] == 0] == []
    assert [i for i in range(6) if got[2000 + i]["predicted"] == 1] == []
    out = [i for i in range(600) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in out]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.judge(none, marks, held, F.lit(True)).collect() == []
    assert toxicity.judge(odd, marks.limit(0), held, F.lit(True)).filter("score <> 0").count() == 0


def test_language(spark, odd, none):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(ENGLISH if i % 2 else GERMAN) for _ in range(rng.randint(3, 90))), "en" if i % 2 else "de", i) for i in range(400)]
    rows += [(900, None, "en", 0), (901, "", "de", 0), (902, "12 34 !!", "en", 0), (903, "the cat sat on a mat", None, 0)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")).collect()}
    assert np.mean([got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(400) if got[i]["held_out"]]) > 0.97
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and got[903]["lang_pred"] == "en"
    assert langid.identify(none).collect() == []
    long = [(1, "the cat sat on a mat " * 60_000, "en"), (2, "der hund lief " * 40, "de"), (3, "der hund lief durch den wald " * 30_000, "de")]
    model = langid.fit(spark.createDataFrame(long, "doc_id long, text string, lang string"), F.lit(True))
    assert {k: len(v) <= langid.DICT_BYTES for k, v in model.items()} == {"en": True, "de": True} and b"cat sat" in model["en"] and b"wald" not in model["de"]
    assert langid.identify(odd).count() == odd.count()


def test_decontamination(spark, odd, none):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(ENGLISH) + str(rng.randrange(60)) for _ in range(n))
    items = [(i, text(rng.choice([12, 30, 60])) + ". " + text(8) + ".", "x") for i in range(30)]
    rows, want = [], set()
    for i in range(200):
        body = text(rng.randint(0, 300))
        if i % 4 == 0:
            item = items[rng.randrange(30)]
            said = item[1]
            if i % 8 == 0:
                w = said.split()
                w[len(w) // 3] = "changed"
                said = " ".join(w)
            body = f"{body} {said.upper() if i % 3 == 0 else said} {text(rng.randint(0, 80))}"
            want.add((i, item[0]))
        rows.append((i, body, 0.5))
    rows += [(900, None, 0.0), (901, "", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cosine double")
    bench = spark.createDataFrame([*items, (50, None, None), (51, "", None)], "item_id long, text string, hits string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == want
    assert decontaminate.contaminated(df, bench.limit(0)).collect() == []
    assert decontaminate.contaminated(none, bench).collect() == []
    assert decontaminate.with_hits(odd.select("doc_id", "text", "lang"), bench).count() == odd.count()


def test_short_and_reworded_items(spark):
    """Items shorter than a long window, verbatim and with a changed word, amid words of other items."""
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(ENGLISH) + str(rng.randrange(60)) for _ in range(n))
    items = [(i, text((5, 8, 12, 40)[i % 4])) for i in range(80)]
    around = lambda: " ".join(rng.choice(rng.choice(items)[1].split()) for _ in range(30))
    rows = []
    for i, said in items:
        w = said.split()
        if i % 8 > 3 and len(w) > 5:
            w[len(w) // 2] = "changed"
        rows.append((i, f"{around()} {' '.join(w)} {around()}"))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    counts, n = decontaminate.frequencies(df)
    idf = np.log((n + 1.0) / (counts + 1.0)) + 0.1
    want = set()
    for d, said in rows:
        h = decontaminate.words([said.encode()])[0]
        for i, item in items:
            own = decontaminate.words([item.encode()])[0]
            w = idf[decontaminate.bucket(own)]
            if w[np.isin(own, h)].sum() < decontaminate.SURE * w.sum():
                continue
            regions = (h[k : k + len(own) + 2] for k in range(len(h)))
            if max(decontaminate.common_weight(own, r, w) for r in regions) >= decontaminate.SURE * w.sum():
                want.add((d, i))
    assert len(want) >= 75 and want <= got


def test_viterbi_against_all_paths():
    """The decoder's best path is the best of all, letter by letter, under the same costs."""
    from annalist.llm.toxicity import Decoder, symbol

    rng = np.random.default_rng(7)
    for token in ("b4d", "a*c", "$0", "x1!", "ab"):
        model = np.log(rng.dirichlet(np.full(toxicity.SYMBOLS, 0.3), (toxicity.SYMBOLS, toxicity.SYMBOLS))) / 3
        own = Decoder(model)
        paths = [((0, 0), 0.0, "")]
        for i in range(len(token)):
            step = []
            for (a, b), cost, text in paths:
                for ch, c in own.choices(token, i):
                    if ch:
                        step.append(((b, symbol(ch)), cost + c + own.model[a][b][symbol(ch)], text + ch))
                    else:
                        step.append(((a, b), cost + c - 2.5, text))
            paths = step
        best = max((c + own.model[a][b][0], t) for (a, b), c, t in paths)
        assert own.restore(token) == best[1]


@pytest.mark.parametrize("foreign", [True, False])
def test_items_beyond_the_sample(spark, monkeypatch, foreign):
    """One item in twelve turns the space; all the others are found as well, verbatim or with several words changed."""
    monkeypatch.setattr(decontaminate, "FIT_ITEMS", 20)
    rng = random.Random(9)
    text = lambda n, kind: " ".join(rng.choice(ENGLISH) + kind + str(rng.randrange(300)) for _ in range(n))
    items = [(i, text((5, 8, 12, 20, 30, 40)[i % 6], "i")) for i in range(240)]
    around = lambda: text(60, "f") if foreign else " ".join(rng.choice(rng.choice(items)[1].split()) for _ in range(60))
    rows, reworded = [], set()
    for i, said in items:
        w = said.split()
        if i % 2 and len(w) >= 12:
            for at in range(3, len(w), 8):
                w[at] = f"changed{at}"
            reworded.add(i)
        rows.append((i, f"{around()} {' '.join(w)} {around()}"))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert {(i, i) for i in range(240) if i not in reworded} <= got
    assert sum((i, i) in got for i in reworded) >= 0.9 * len(reworded)
    assert foreign is False or got <= {(i, i) for i in range(240)}


def test_blind_items_by_word():
    """Where a space keeps nothing of an item, its words lead to it, and to no document that can't hold it."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, 9)) for _ in range(30)]
    idf = np.linspace(0.5, 3, decontaminate.BUCKETS)
    index = decontaminate.build([{"item_id": i, "text": t, "answer": None} for i, t in enumerate(texts)], idf, np.full(decontaminate.BUCKETS, -1, np.int32), np.zeros((0, 1), np.float32))
    own = decontaminate.Searcher(index)
    assert own.blind.tolist() == list(range(30))
    for _ in range(50):
        h = decontaminate.words([" ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 30))).encode()])[0]
        word = np.minimum(np.searchsorted(own.known, h), len(own.known) - 1)
        word = np.where(own.known[word] == h, word, -1)
        near = own.blind_candidates(word)
        assert set(own.blind[own.coverable(own.blind, word)].tolist()) == set(near[own.coverable(near, word)].tolist() if len(near) else [])


def test_common_weight():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b, w = rng.integers(0, 5, 9), rng.integers(0, 5, 14), rng.random(9)
        table = np.zeros((10, 15))
        for i in range(9):
            for j in range(14):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + w[i] if a[i] == b[j] else 0)
        assert abs(decontaminate.common_weight(a, b, w) - table[-1, -1]) < 1e-9
