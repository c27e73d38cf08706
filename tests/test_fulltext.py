"""Boolean trees against direct evaluation; the change log against a plain run of the actions."""

import random
import re

from pyspark.sql import functions as F

from annalist.operators import fulltext, mutation
from annalist.operators.fulltext import And, Leaf, Not, Or
from annalist.operators.ordered import previous

WORDS = "red green blue black white".split()
WEIGHT = {"title": 1.0, "body": 0.1, "steps": 0.2}


def tree(rng, depth=0):
    kind = rng.randrange(4) if depth < 3 else 3
    if kind == 0:
        return Not(tree(rng, depth + 1))
    if kind < 3:
        return (And, Or)[kind - 1](tuple(tree(rng, depth + 1) for _ in range(2)))
    prefix = rng.random() < 0.3
    return Leaf((rng.choice(WORDS)[:3],), True) if prefix else Leaf(tuple(rng.choice(WORDS) for _ in range(rng.choice([1, 1, 2]))))


def found(leaf, doc):
    """Times that the leaf stands in each field."""
    out = {}
    for field, texts in doc.items():
        n = 0
        for text in [texts] if isinstance(texts, str) else texts or []:
            w = re.findall("[a-z0-9]+", (text or "").lower())
            same = (lambda a, b: a.startswith(b)) if leaf.prefix and len(leaf.words[0]) > 2 else (lambda a, b: a == b)
            n += sum(all(same(w[i + k], x) for k, x in enumerate(leaf.words)) for i in range(len(w) - len(leaf.words) + 1))
        if n:
            out[field] = n
    return out


def true(t, doc):
    if isinstance(t, Leaf):
        return bool(found(t, doc))
    return not true(t.of, doc) if isinstance(t, Not) else (all if isinstance(t, And) else any)(true(p, doc) for p in t.parts)


def test_trees(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)).upper()
    docs = {i: {"title": text(rng.randrange(3)), "body": text(rng.randrange(6)), "steps": [text(rng.randrange(3)) for _ in range(rng.randrange(3))]} for i in range(60)}
    docs[60], docs[61] = {"title": None, "body": "", "steps": None}, {"title": "red", "body": None, "steps": ["red", None, "green"]}
    df = spark.createDataFrame([(i, d["title"], d["body"], d["steps"], "red") for i, d in docs.items()], "id long, title string, body string, steps array<string>, doc string")
    trees = {i: tree(rng) for i in range(25)} | {100: Leaf(("red", "green")), 101: Or((Leaf(("bl",), True), Leaf(("blu",), True)))}
    got = {(r["query"], r["doc"]): (r["rank"], r["place"]) for r in fulltext.search(fulltext.table_of(spark, trees), fulltext.postings(df, "id", {"title": "A", "body": "D", "steps": "C"})).collect()}
    want = {}
    for q, t in trees.items():
        every = [x for clause in fulltext.clauses(t) for x in clause]
        wanted = {leaf for leaf, no in every} - {leaf for leaf, no in every if no and (leaf, False) not in every}
        scored = []
        for i, d in docs.items():
            d = {k: v for k, v in d.items() if v}
            rank = sum(WEIGHT[f] * n / (n + 1) for leaf in wanted for f, n in found(leaf, d).items())
            if rank > 0 and true(t, d):
                scored.append((-round(rank, 6), i))
        want |= {(q, i): (-r, n + 1) for n, (r, i) in enumerate(sorted(scored))}
    assert len(want) > 200 and got == want


def test_empty_index(spark):
    none = spark.createDataFrame([], "id long, title string")
    assert fulltext.search(fulltext.table_of(spark, {1: Leaf(("red",))}), fulltext.postings(none, "id", {"title": "A"})).collect() == []


def test_previous_across_ranges(spark):
    rows = [(k, o, k * 100 + o if o % 5 else None, "x") for k in range(6) for o in range(3 if k else 900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["k"], r["o"]): r["before"] for r in previous(spark.createDataFrame(rows, "k long, o long, v long, _x string").repartition(5), "k", "o", "v", "before").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    values = {(k, o): v for k, o, v, _ in rows}
    assert got == {(k, o): values.get((k, o - 1)) for k, o in values}


def test_log_and_replay(spark):
    rng = random.Random(3)
    store = [(i, f"s{i}") for i in range(20)] + [(3, "s3"), (None, "x"), (30, None)]
    actions = [(p, None if p % 41 == 0 else 7 if p % 3 == 0 else rng.randrange(40), rng.choice(["ADD", "UPDATE", "DELETE", "NONE", None, "odd"]), None if p % 29 == 0 else f"t{p}") for p in range(600)]
    s, a = spark.createDataFrame(store, "id long, text string"), spark.createDataFrame(actions, "pos long, id long, event string, text string").repartition(7)
    log = mutation.logged(s, a)
    state, want, states = {i: t for i, t in store if i is not None and t is not None}, [], {}
    for pos, i, event, text in actions:
        if i is not None and event in ("ADD", "UPDATE"):
            want.append((pos, i, "UPDATE" if i in state else "ADD", state.get(i), text or "", 0))
            state[i] = text or ""
        elif i is not None and event == "DELETE" and i in state:
            want.append((pos, i, "DELETE", state.pop(i), None, 1))
        states[pos] = dict(state)
    assert sorted(map(tuple, log.collect())) == sorted(want)
    for pos in (0, 17, 250, 599):
        assert {r["id"]: r["text"] for r in mutation.replayed(s, log, F.lit(pos)).collect()} == states[pos]
    assert mutation.logged(s, a.limit(0)).collect() == []
    merged = {r["id"]: r["text"] for r in mutation.merge_actions(s.filter("id IS NOT NULL AND text IS NOT NULL").distinct(), a.filter("id IS NOT NULL AND event IN ('ADD', 'UPDATE', 'DELETE')").fillna({"text": ""})).collect()}
    assert merged == states[599]
