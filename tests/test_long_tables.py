"""Queries over rows that only longer tables hold, against their SQL in DuckDB; operators against plain Python where blocks and rounds matter."""

import duckdb
import pytest

from annalist import catalog


def like_sql(spark, tmp_path, name, **tables):
    """The rows of a query over small tables, given as SQL, and those of its SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    return sorted(map(repr, map(tuple, got))), sorted(map(repr, want.fetchall()))


def test_letters_of_several_and_braces(spark, tmp_path):
    texts = ["ßabc", "ßab", "}abc", "}ab", "}ab\nc}", "{a}", "ﬁsch", "ᾳ x", "éa", '"q', "\\q", "", "+"]
    values = ", ".join(f"({i}, '" + t.replace("'", "''") + "')" for i, t in enumerate(texts))
    got, want = like_sql(spark, tmp_path, "parse_json_lenient", documents=f"SELECT * FROM (VALUES {values}) t(doc_id, text)")
    assert len(want) == 10 and got == want


def test_added_rows_replace_none(spark, tmp_path):
    part = "SELECT i::BIGINT AS p_partkey, 'n' || i AS p_name, (i % 7)::INTEGER AS p_size FROM (SELECT unnest([3, 5, 13, 105, 1000003, 1000005, 1000105, 1000106]) AS i)"
    got, want = like_sql(spark, tmp_path, "upsert_vectors", part=part)
    assert len(want) == 12 and got == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_by_blocks_in_place(spark, monkeypatch):
    import numpy as np

    from annalist.operators import pairing, vectors

    monkeypatch.setattr(pairing, "FEW_BLOCK", 8)
    monkeypatch.setattr(pairing, "FEW_HELD", 20)
    monkeypatch.setattr(pairing.met, "__defaults__", (None, False, 16))
    x = np.random.default_rng(5).normal(size=(90, 6)).round(1)
    x[60:] = x[:30]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 9)
    for later in (False, True):
        found = vectors.topk(rows, rows, 3, "i", "i", "v", 0.2, exclude_self=True, not_later=later)
        assert "CartesianProduct" in plan(found)
        want = []
        for a in range(90):
            fits = [b for b in range(90) if b != a and sim[a, b] >= 0.2 and (b < a or not later)]
            want += [(a, b, n) for n, b in enumerate(sorted(fits, key=lambda b: (-sim[a, b], b))[:3], 1)]
        assert sorted((r["query"], r["memory"], r["rank"]) for r in found.collect()) == sorted(want)


def test_bm25_leaves_words_where_they_are(spark, monkeypatch):
    import random

    from annalist.operators import pairing, text

    monkeypatch.setattr(text, "CELLS", 40)
    monkeypatch.setattr(pairing, "FEW_BLOCK", 3)
    monkeypatch.setattr(pairing, "FEW_HELD", 5)
    rng = random.Random(4)
    said = lambda n: " ".join(rng.choice(["the", "the", "of", "aa", "bb", "cc", "dd", f"w{rng.randrange(40)}"]) for _ in range(n))
    docs = [(i, said(rng.choice([0, 1, 2, 2, 9]))) for i in range(150)]
    docs += [(150 + i, docs[i % 20][1]) for i in range(100)]
    asked = [(i, said(6)) for i in range(12)] + [(12, "zz")]
    found = text.bm25(spark.createDataFrame(asked, "i long, t string"), spark.createDataFrame(docs, "d long, t string").repartition(3), 4, "i", "t", "d", "t")
    assert "CartesianProduct" in plan(found) and "hashpartitioning(term" not in plan(found)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", asked)
    want = con.execute(catalog.ORACLE_SQL["bm25_okapi"].replace("rank <= 5", "rank <= 4")).fetchall()
    assert sorted((r["query"], r["doc"], round(r["score"], 3), r["rank"]) for r in found.collect()) == sorted(want)


def test_searches_deal_out_no_texts(spark, tmp_path):
    docs = "SELECT i::BIGINT AS doc_id, 'the ab' || (i % 7) || ' cd' || (i % 5) || ' ' || repeat('long ', (i % 9)::INTEGER) AS text FROM range(60) t(i)"
    items = "SELECT i::BIGINT AS item_id, 'the ab' || i || ' cd' || i || ' long' AS text FROM range(6) t(i)"
    vectors = "SELECT i::BIGINT AS vec_id, [sin(i), cos(i * 3), sin(i * i)]::FLOAT[] AS embedding, (i % 4)::INTEGER AS label FROM range(60) t(i)"
    for name in ("hybrid_rank", "bm25_tfidf_rerank", "milvus_hybrid", "hybrid_alpha", "search_pipeline"):
        at = tmp_path / name
        at.mkdir()
        got, want = like_sql(spark, at, name, documents=docs, benchmark=items, embeddings=vectors)
        assert want and got == want
        steps = plan(catalog.QUERIES[name](spark, str(at))).split("\n")
        assert not any("hashpartitioning(doc_id" in line and "text" in line for line in steps) and not any("hashpartitioning(term" in line and "len" in line for line in steps)


def sharing(rng, ids, most, n_tags):
    return {i: set(rng.sample(range(n_tags), rng.randint(0, most))) for i in ids}


@pytest.mark.parametrize("most", [5, 12])
def test_most_tags_by_subsets_and_blocks(spark, monkeypatch, most):
    import random

    from annalist.operators import overlap, vectors

    monkeypatch.setattr(overlap, "HELD", 500)
    sets = sharing(random.Random(most), range(260), most, 14)
    rows = spark.createDataFrame([(i, t) for i, s in sets.items() for t in (*s, None)] * 2, "o long, tag long").repartition(3)
    want = []
    for a in range(0, 260, 4):
        near = sorted((-len(sets[a] & sets[b]), b) for b in sets if b != a and len(sets[a] & sets[b]) >= 2)
        want += [(a, b, -n) for n, b in near[:5]]
    found = vectors.overlap_topk(rows.filter("o % 4 = 0"), rows, "o", "tag", 5, 2)
    assert sorted(tuple(r) for r in found.select("a", "b", "n").collect()) == sorted(want)


def test_shared_tags_make_no_groups(spark):
    import random

    from annalist.operators import expansion

    sets = sharing(random.Random(1), range(120), 9, 12)
    rows = spark.createDataFrame([(i, f"k{i}" if i % 9 else None, [*map(str, s), None, *map(str, s)]) for i, s in sets.items()], "id long, key string, tags array<string>").repartition(3)
    asked = rows.filter("id % 5 = 0").selectExpr("id AS query", "array(key, concat('k', id + 1), 'k7', 'k7') AS keys", "tags")
    found = expansion.key_or_tags(asked, rows)
    assert "hashpartitioning(tag" not in plan(found)
    want = []
    for a in range(0, 120, 5):
        keys = {f"k{a}" if a % 9 else None, f"k{a + 1}", "k7"} - {None}
        for b in sets:
            named = b % 9 != 0 and f"k{b}" in keys
            if named or len(sets[a] & sets[b]) >= 2:
                want.append((a, b, named, len(sets[a] & sets[b])))
    assert sorted(tuple(r) for r in found.select("query", "id", "by_key", "n_shared").collect()) == sorted(want)


def test_walk_keeps_no_copy_of_its_last_round(spark, monkeypatch):
    import random

    from annalist.operators import graph

    made = []
    monkeypatch.setattr(graph, "MOST_BITS", 64)
    monkeypatch.setattr(graph, "pinned", lambda df: made.append(df) or df.localCheckpoint())
    rng = random.Random(3)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(110)] * 2 + [(0, x) for x in range(40)]
    edges = spark.createDataFrame(links, "src long, dst long").repartition(3)
    start = spark.createDataFrame([(x,) for x in (0, 1, 2, 2, 500)], "id long")
    for directed in (True, False):
        both = set(links) | (set() if directed else {(b, a) for a, b in links})
        want = set()
        for s in (0, 1, 2, 500):
            steps, front = {s: 0}, {s}
            for d in (1, 2, 3):
                front = {b for a, b in both if a in front} - set(steps)
                steps |= dict.fromkeys(front, d)
            want |= {(s, *x) for x in steps.items()}
        got = [tuple(r) for r in graph.distances(edges, start, 3, directed).select("id", "node", "steps").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(made) == 4


def test_similar_documents_by_blocks(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    from annalist.operators import similar, text

    for name, n in (("COMMON", 6), ("GROUPS", 4), ("BLOCK", 40), ("SLICE", 16), ("TERMS", 30), ("PRODUCTS", 50)):
        monkeypatch.setattr(similar, name, n)
    rng = random.Random(7)
    said = [[rng.choice(["the", "of", "and", f"w{rng.randrange(12)}", f"v{rng.randrange(300)}"]) for _ in range(rng.choice([1, 3, 8, 30]))] for _ in range(150)]
    said += [[w for w in said[i] if rng.random() < 0.9] + ["aa"] for i in range(60)] + [[]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(said)], "d long, t string").repartition(4)
    among = docs.filter("d % 10 <> 3")
    df = Counter(w for s in said for w in set(s))
    unit = []
    for s in said:
        w = {x: n * (math.log((1 + len(said)) / (1 + df[x])) + 1) for x, n in Counter(s).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        unit.append({x: v / norm for x, v in w.items()})
    cos, sets = [], []
    for b in range(len(said)):
        for a in range(b):
            if a % 10 != 3 and b % 10 != 3 and round(sum(v * unit[b].get(x, 0) for x, v in unit[a].items()), 6) >= 0.75:
                cos.append((a, b))
            if said[a] and said[b] and 100 * len(set(said[a]) & set(said[b])) >= 60 * len(set(said[a]) | set(said[b])):
                sets.append((a, b))
    found = text.tfidf_pairs(docs, "d", "t", 0.75, among)
    assert "hashpartitioning(term" not in plan(found) and "hashpartitioning(a" not in plan(found)
    assert cos and sorted(tuple(r) for r in found.collect()) == sorted(cos)
    assert sets and sorted(tuple(r) for r in text.jaccard_pairs(docs, "d", "t", 60).collect()) == sorted(sets)
