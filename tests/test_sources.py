import json

import pytest
from pyspark.sql import functions as F

from annalist.sources import datasets, sinks

NESTED = [{"user_id": "u1", "domain": "food", "session_count": 2, "sessions": [{"session_id": "a0", "session_index": 0, "messages": [{"role": "user", "content": "hi"}], "extra": 1}, {"session_id": "a1", "session_index": 1, "messages": [{"role": "tool", "content": ""}]}]}]
FLAT = [{"session_id": "b0", "user_id": "u2", "session_index": 0, "messages": [{"role": "user", "content": "x"}]}, {"session_id": "b1", "user_id": "u2", "session_index": 3, "messages": [{"role": "user", "content": "y"}]}]


def write(path, rows):
    path.write_text("﻿" + "\n\n".join(json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def problems(spark, path, rows):
    return sorted((r["problem"], r["id"]) for r in datasets.session_violations(datasets.read_jsonl(spark, write(path, rows), datasets.LIFELINES)).collect())


def test_layouts(spark, tmp_path):
    one = datasets.sessions(datasets.read_jsonl(spark, write(tmp_path / "n.jsonl", NESTED), datasets.LIFELINES))
    assert sorted((r["session_id"], r["user_id"], r["domain"], r["session_index"]) for r in one.collect()) == [("a0", "u1", "food", 0), ("a1", "u1", "food", 1)]
    two = datasets.sessions(datasets.read_jsonl(spark, write(tmp_path / "f.jsonl", FLAT), datasets.LIFELINES))
    assert {r["domain"] for r in two.collect()} == {"unknown"}
    assert problems(spark, tmp_path / "ok.jsonl", FLAT) == [] == problems(spark, tmp_path / "ok2.jsonl", NESTED)


@pytest.mark.parametrize("change,problem", [
    (lambda r: [*r, r[0]], "duplicate session"), (lambda r: [*r, {**r[0], "session_id": "z"}], "duplicate index"), (lambda r: [*r, *NESTED], "mixed layouts"),
    (lambda r: [{**NESTED[0], "session_count": 5}], "session_count"), (lambda r: [{**r[0], "messages": [{"role": "boss", "content": "x"}]}], "bad message"), (lambda r: [{**r[0], "messages": []}], "no messages"),
])
def test_broken_sessions(spark, tmp_path, change, problem):
    found = problems(spark, tmp_path / "b.jsonl", change(list(FLAT)))
    assert problem in {p for p, _ in found}
    with pytest.raises(datasets.ContractError):
        datasets.require(spark.createDataFrame(found, "problem string, id string"))


def test_malformed_line_fails(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"session_id": \n')
    with pytest.raises(Exception):
        datasets.read_jsonl(spark, str(tmp_path / "x.jsonl"), datasets.SESSION).collect()


def probe(i, **more):
    return {"probe_id": i, "user_id": "u2", "query": "q", "choices": [{"choice_id": "A", "text": "a"}, {"choice_id": "B", "text": "b"}], **more}


def test_probes(spark, tmp_path):
    rows = datasets.sessions(datasets.read_jsonl(spark, write(tmp_path / "f.jsonl", FLAT), datasets.LIFELINES))
    public = [probe("p1"), probe("p2", visible_history_scope={"max_session_index": 1}), probe("p3", query=" "), probe("p4", choices=[{"choice_id": "A", "text": "a"}]), probe("p5"), probe("p6", visible_history_scope={"max_session_index": 9})]
    keys = [{"public_probe_id": p, "gold_choice_id": "A", "decision_evidence_session_ids": ["b0"]} for p in ("p1", "p3", "p4", "p6")] + [{"probe_id": "p2", "public_probe_id": "", "gold_choice_id": "Z", "gold_evidence_session_ids": []}, {"probe_id": "p9", "gold_choice_id": "A"}]
    joined = datasets.probes(datasets.read_jsonl(spark, write(tmp_path / "p.jsonl", public), datasets.PROBES), datasets.read_jsonl(spark, write(tmp_path / "k.jsonl", keys), datasets.KEYS), rows)
    assert {r["probe_id"]: r["cutoff"] for r in joined.collect() if r["probe_id"]}["p1"] == 3
    assert {r["probe_id"]: r["cutoff"] for r in joined.collect() if r["probe_id"]}["p2"] == 1
    got = {(r["problem"], r["id"]) for r in datasets.probe_violations(joined).collect()}
    assert got == {("blank query", "p3"), ("too few choices", "p4"), ("probe without key", "p5"), ("cutoff outside range", "p6"), ("gold not among choices", "p2"), ("no evidence", "p2"), ("key without probe", "p9")}


def test_shards_add_up(spark):
    rows = spark.range(200).select(F.col("id").alias("pos"), F.concat(F.lit("u"), F.col("id") % 17).alias("user_id"))
    whole = {r["pos"] for r in datasets.subset(rows, 9, 60).collect()}
    parts = [{r["pos"] for r in datasets.subset(rows, 9, 60, i, 4).collect()} for i in range(4)]
    assert set().union(*parts) == whole and sum(map(len, parts)) == len(whole)
    with pytest.raises(datasets.ContractError):
        datasets.subset(rows, shard=1)


def test_private_names(spark):
    df = spark.createDataFrame([], "a string, m array<struct<x:int,gold_choice_id:string>>, decision_unit_ids array<string>")
    assert datasets.private_fields(df) == ["$.m[].gold_choice_id", "$.decision_unit_ids"]


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "b int, a string"), spark.createDataFrame([(2, None)], "b int, c string")
    assert [r["value"] for r in sinks.sorted_json(a).collect()] == ['{"a":"x","b":1}']
    sinks.write_csv([a, b], str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns == ["b", "a", "c"] and back.count() == 2
    sinks.write_document({"b": "é", "a": 1}, str(tmp_path / "d" / "x.json"))
    assert json.loads((tmp_path / "d" / "x.json").read_text(encoding="utf-8")) == {"a": 1, "b": "é"}


def test_passages(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.txt").write_text("one\ntwo\n\nthree\n\n\n")
    assert sorted(r["passage"].strip() for r in datasets.read_passages(spark, str(tmp_path)).collect()) == ["one\ntwo", "three"]


def test_publication(spark, tmp_path, monkeypatch):
    """A writer that dies leaves the old version readable; the next one takes its place as a whole."""
    path = f"file://{tmp_path}/scores"
    rows = lambda n: spark.createDataFrame([("a", i, i / 3, None) for i in range(n)], "domain string, n_rows long, recall double, note string")
    assert sinks.published(spark, path) == {} and sinks.current(spark, path) is None
    first = sinks.publish(sinks.score_outputs(rows(5), rows(3), rows(0)), path)
    assert first["outputs"]["scored"]["rows"] == 5 and first["outputs"]["groups"] == {"rows": 0, "digest": "0"}
    assert {k: df.count() for k, df in sinks.published(spark, path, check=True).items()} == {"scored": 5, "metrics": 3, "groups": 0, "retrieval_metrics": 3, "retrieval_groups": 0}
    assert sinks.published(spark, path)["retrieval_metrics"].columns == ["domain", "recall", "note"]

    def dead(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(sinks, "put", dead)
        sinks.publish({"scored": rows(9)}, path)
    assert sinks.current(spark, path) == first["version"] and sinks.published(spark, path, check=True)["scored"].count() == 5
    assert len(sinks.sweep(spark, path)) == 1 and sinks.sweep(spark, path) == []
    second = sinks.publish({"scored": rows(9)}, path)
    assert set(sinks.published(spark, path, check=True)) == {"scored"} and sinks.sweep(spark, path) == [first["version"]]
    rows(4).write.mode("overwrite").parquet(f"{path}/{second['version']}/scored")
    with pytest.raises(ValueError, match="not what was published"):
        sinks.published(spark, path, check=True)
