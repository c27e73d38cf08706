"""Reuse of stored results whose identity is unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(text: Column) -> Column:
    """JSON text with the keys of all objects in order, at any depth, and no blanks; text that is not one JSON value stays as it is.

    Numbers that are equal may be written alike (1.0 as 1); of a repeated key the text is no JSON. A parser stops after
    the first value, so the text is read inside an array and inside an object: what follows a value breaks one of them.
    """
    inside = lambda ahead, end: F.to_json(F.try_parse_json(F.concat(F.lit(ahead), text, F.lit(end))))
    array, field = inside("[", "]"), inside('{"":', "}")
    return F.when(F.concat(F.lit('{"":'), F.substr(array, F.lit(2), F.length(array) - 2), F.lit("}")) == field, F.substr(array, F.lit(2), F.length(array) - 2)).otherwise(text)


def identity(*parts: Column) -> Column:
    """Hash of what a result depends on: each part's canonical JSON with its length ahead, so parts can't run together; a null differs from all texts."""
    framed = [F.coalesce(F.concat(F.length(canonical(p)).cast("string"), F.lit(":"), canonical(p)), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws(",", *framed).cast("binary"), 256)


def stored(results: DataFrame, result: str = "result") -> DataFrame:
    """Results as they are kept: with a digest of their own, by which damage is seen."""
    return results.withColumn("result_sha256", identity(F.col(result)))


def resumed(jobs: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """``jobs`` (key, identity, ...) with result and reused: the result kept under the same key and identity, if undamaged.

    ``kept``: key, identity, result, result_sha256; repeated rows count once, of several undamaged results of one
    identity the least is taken. Jobs without a key or an identity are run again.
    """
    whole = kept.filter(F.col("result_sha256") == identity(F.col("result")))
    one = whole.groupBy(F.col(key).alias("_key"), F.col("identity").alias("_identity")).agg(F.min("result").alias("result"))
    joined = jobs.join(one, (F.col(key) == F.col("_key")) & (F.col("identity") == F.col("_identity")), "left")
    return joined.withColumn("reused", F.col("_key").isNotNull()).drop("_key", "_identity")


def resumed_groups(jobs: DataFrame, kept: DataFrame, group: str, key: str) -> DataFrame:
    """The same where results hold by group: one is reused only if each of its jobs can be, and no result of another job is kept for it.

    A user's memory is one state: with a probe changed, added or gone all the user's probes are answered anew.
    """
    single = resumed(jobs, kept, key)
    asked = single.groupBy(F.col(group).alias("_group")).agg(F.min("reused").alias("_all"), F.count_distinct(key).alias("_n"))
    held = kept.groupBy(F.col(group).alias("_of")).agg(F.count_distinct(key).alias("_held"))
    fit = asked.join(held, F.col("_group") == F.col("_of"), "left").filter("_all AND _n = _held").select(F.col("_group").alias("_fit"))
    marked = single.join(fit, F.col(group) == F.col("_fit"), "left")
    reused = F.col("_fit").isNotNull()
    return marked.withColumns({"result": F.when(reused, F.col("result")), "reused": reused}).drop("_fit")
