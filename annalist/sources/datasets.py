"""Readers of sessions, probes and keys, with their contracts as queries that return the violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"
SESSION = f"session_id string, user_id string, session_index int, timestamp string, domain string, messages {MESSAGES}"
LIFELINES = f"{SESSION}, session_count int, sessions array<struct<session_id:string,user_id:string,session_index:int,timestamp:string,domain:string,messages:{MESSAGES}>>"
PROBES = "probe_id string, user_id string, domain string, timestamp string, query string, choices array<struct<choice_id:string,text:string>>, visible_history_scope struct<user_id:string,max_session_index:int>, split string"
KEYS = "public_probe_id string, probe_id string, gold_choice_id string, visible_history_scope struct<max_session_index:int,through_session_index:int>, decision_evidence_session_ids array<string>, gold_evidence_session_ids array<string>, temporal_context_session_ids array<string>, nonbinding_evidence_session_ids array<string>, required_component_groups array<array<string>>, decision_bundle_id string, probe_type string, capability_group string, habit_family string, stress_variant string"
ROLES = ("user", "assistant", "system", "tool")
#: Names that nothing shown to a method may hold.
PRIVATE = ("gold_choice_id", "decision_evidence_session_ids", "gold_evidence_session_ids", "temporal_context_session_ids", "nonbinding_evidence_session_ids", "required_component_groups", "decision_unit_ids", "decision_bundle_id", "public_probe_id")


class ContractError(ValueError):
    """The input breaks its contract."""


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines: blank lines are passed over, a byte order mark is dropped, a malformed line fails the read."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_passages(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Files below a folder, cut at blank lines: path, pos, passage."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value")
    parts = files.select("path", F.posexplode(F.split("value", r"\n\s*\n")).alias("pos", "passage"))
    return parts.filter(F.trim("passage") != "")


def sessions(lifelines: DataFrame) -> DataFrame:
    """Flat sessions from either layout, with known fields only; a nested session inherits user and domain."""
    nested = lifelines.filter("sessions IS NOT NULL").select("user_id", "domain", F.explode("sessions").alias("s"))
    nested = nested.select("s.session_id", F.coalesce("s.user_id", "user_id").alias("user_id"), "s.session_index", "s.timestamp", F.coalesce("s.domain", "domain", F.lit("unknown")).alias("domain"), "s.messages")
    flat = lifelines.filter("sessions IS NULL").select("session_id", "user_id", "session_index", "timestamp", F.coalesce("domain", F.lit("unknown")).alias("domain"), "messages")
    return nested.unionByName(flat)


def session_violations(lifelines: DataFrame) -> DataFrame:
    """(problem, id) of every broken rule of the sessions."""
    rows = sessions(lifelines)
    said = lambda df, problem, c: df.select(F.lit(problem).alias("problem"), F.col(c).cast("string").alias("id"))
    layouts = lifelines.agg(F.count("sessions").alias("n"), F.count(F.lit(1)).alias("m")).filter("n > 0 AND n < m").withColumn("id", F.lit("file"))
    out = [
        said(layouts, "mixed layouts", "id"),
        said(lifelines.filter("sessions IS NOT NULL AND session_count <> size(sessions)"), "session_count", "user_id"),
        said(rows.groupBy("session_id").count().filter("count > 1"), "duplicate session", "session_id"),
        said(rows.groupBy("user_id", "session_index").count().filter("count > 1"), "duplicate index", "user_id"),
        said(rows.filter("messages IS NULL OR size(messages) = 0"), "no messages", "session_id"),
        said(rows.filter(F.exists("messages", lambda m: ~m["role"].isin(*ROLES) | m["content"].isNull())), "bad message", "session_id"),
        said(rows.filter("session_id IS NULL OR user_id IS NULL OR session_index IS NULL"), "missing field", "session_id"),
    ]
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first


def probes(public: DataFrame, keys: DataFrame, session_rows: DataFrame) -> DataFrame:
    """Probes with their keys, cutoffs resolved: public scope, key scope, the user's last session."""
    last = session_rows.groupBy("user_id").agg(F.max("session_index").alias("last_index"), F.min("session_index").alias("first_index"))
    key_id = F.coalesce(F.nullif("public_probe_id", F.lit("")), F.nullif("probe_id", F.lit("")), F.lit(""))
    k = keys.select(key_id.alias("key_id"), "gold_choice_id", F.col("visible_history_scope").alias("key_scope"), F.coalesce("decision_evidence_session_ids", "gold_evidence_session_ids").alias("positives"), F.coalesce("temporal_context_session_ids", F.array().cast("array<string>")).alias("temporal"), F.coalesce("nonbinding_evidence_session_ids", F.array().cast("array<string>")).alias("nonbinding"), "probe_type")
    cutoff = F.coalesce("visible_history_scope.max_session_index", "key_scope.max_session_index", "key_scope.through_session_index", "last_index")
    return public.join(k, F.col("probe_id") == F.col("key_id"), "full_outer").join(last, "user_id", "left").withColumn("cutoff", cutoff)


def probe_violations(joined: DataFrame) -> DataFrame:
    """(problem, id) of every broken rule of probes and keys, from the output of ``probes``."""
    rules = [
        ("probe without key", F.col("key_id").isNull()), ("key without probe", F.col("probe_id").isNull()), ("blank query", F.trim("query") == ""), ("too few choices", F.size("choices") < 2),
        ("gold not among choices", ~F.array_contains("choices.choice_id", F.col("gold_choice_id"))), ("cutoff outside range", (F.col("cutoff") > F.col("last_index")) | (F.col("cutoff") < F.col("first_index"))), ("no evidence", F.size("positives") == 0),
    ]
    found = F.filter(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules)), lambda x: x.isNotNull())
    return joined.select(F.explode(found).alias("problem"), F.coalesce("probe_id", "key_id").alias("id"))


def require(violations: DataFrame) -> None:
    """Fail with the first few violations."""
    some = violations.limit(5).collect()
    if some:
        raise ContractError("; ".join(f"{r['problem']}: {r['id']}" for r in some))


def private_fields(df: DataFrame, names: tuple[str, ...] = PRIVATE) -> list[str]:
    """Paths of private names anywhere in the schema."""

    def walk(kind, at: str) -> list[str]:
        found = []
        for f in getattr(kind, "fields", []):
            path = f"{at}.{f.name}"
            found += [path] * (f.name in names) + walk(f.dataType, path)
        if hasattr(kind, "elementType"):
            found += walk(kind.elementType, f"{at}[]")
        if hasattr(kind, "valueType"):
            found += walk(kind.valueType, f"{at}{{}}")
        return found

    return walk(df.schema, "$")


def subset(probe_rows: DataFrame, max_users: int | None = None, max_probes: int | None = None, shard: int | None = None, shards: int | None = None, pos: str = "pos") -> DataFrame:
    """Users in order of name, then probes in file order, then every ``shards``-th of the users left; shards add up to the whole."""
    if (shard is None) != (shards is None):
        raise ContractError("a shard needs its number of shards")

    def by_user(df: DataFrame) -> DataFrame:
        users = df.select("user_id").distinct().withColumn("user_pos", F.row_number().over(Window.orderBy("user_id")) - 1)
        return df.join(users, "user_id")

    out = probe_rows
    if max_users is not None:
        out = by_user(out).filter(F.col("user_pos") < max_users).drop("user_pos")
    if max_probes is not None:
        out = out.orderBy(pos).limit(max_probes)
    if shards is not None:
        out = by_user(out).filter(F.col("user_pos") % shards == shard).drop("user_pos")
    return out
