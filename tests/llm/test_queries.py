"""The registered queries against SQL, and the pipeline stage by stage against plain Python, on the smallest tables."""

import base64
import hashlib
import os
import re

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from annalist.llm import queries
from tests.llm.test_ngram_join import brute

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_like_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SMALL).select(*columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    bench = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic = 1").collect()}
    labelled = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out.append({r["doc_id"]: r for r in docs.collect()})
        assert k == 4 or docs.columns == columns
    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    gone = set(start) - set(out[0])
    assert len(gone & (labelled - toxic)) <= 0.02 * len(labelled) and len(gone & toxic) >= 0.5 * len(toxic)
    groups = brute([(i, r["text"]) for i, r in out[0].items()], corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SHARE)
    assert set(out[1]) == {i for _, i, _, c in groups if i == c}
    held = {i for i, r in out[1].items() if any(b in " ".join(re.findall(r"\w+", r["text"].lower())) for b in bench)}
    assert set(out[1]) - set(out[2]) == held
    for i, r in out[3].items():
        assert r["text"] == re.sub(r'(token = ")[0-9a-f]{40}(")', r"\1[SECRET]\2", out[2][i]["text"]) and r["n_chars"] == len(r["text"])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in out[4].items():
        ids = library.encode_ordinary(out[3][i]["text"])
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert {tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()} == {tuple(r) for r in out[4].values()}
