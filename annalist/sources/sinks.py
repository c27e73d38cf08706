"""Writers: JSON Lines with sorted keys, CSV with the union of columns, small documents, and several outputs as one publication."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sorted_json(df: DataFrame) -> DataFrame:
    """One column value: each row as JSON with keys in order; null fields are kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    sorted_json(df).write.mode("overwrite").text(path)


def write_csv(frames: list[DataFrame], path: str) -> None:
    """Columns in the order in which the frames first name them; what a frame lacks is empty."""
    first, *rest = frames
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    first.write.mode("overwrite").option("header", True).csv(path)


def write_document(payload: Any, path: str) -> None:
    """A small JSON document, whole or not at all: written beside its place and moved there."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def publish(outputs: dict[str, DataFrame], path: str) -> dict:
    """Several outputs as one publication below ``path``, on any file system that Spark writes to; returns its manifest.

    Everything is written to a folder of its own and read back for the manifest: rows and a digest of each output. The
    one step that makes it the current version is the renaming of a pointer file. A writer that dies before leaves the
    old version as it was; ``sweep`` removes what it left.
    """
    spark = next(iter(outputs.values())).sparkSession
    version = uuid.uuid4().hex
    manifest: dict = {"version": version, "outputs": {}}
    for name, df in outputs.items():
        df.write.parquet(f"{path}/{version}/{name}")
        manifest["outputs"][name] = digest(spark.read.schema(df.schema).parquet(f"{path}/{version}/{name}"))
    put(spark, f"{path}/{version}/MANIFEST.json", json.dumps(manifest, sort_keys=True))
    put(spark, f"{path}/CURRENT", version)
    return manifest


def digest(df: DataFrame) -> dict:
    """Rows and the sum of their hashes, which the order of rows doesn't change."""
    row = df.select(F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("h")).first()
    return {"rows": row["n"], "digest": str(row["h"] or 0)}


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name and rename it over the old one."""
    jvm = spark._jvm
    target, temporary = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(temporary), fs.makeQualified(target), how)


def current(spark: SparkSession, path: str) -> str | None:
    """The version that the pointer names; None where nothing was published."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.text(f"{path}/CURRENT").first()[0]


def published(spark: SparkSession, path: str, check: bool = False) -> dict[str, DataFrame]:
    """The outputs of the current version; with ``check`` their rows and digests must be those of the manifest."""
    if (version := current(spark, path)) is None:
        return {}
    manifest = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/{version}/MANIFEST.json").collect()))
    out = {name: spark.read.parquet(f"{path}/{version}/{name}") for name in manifest["outputs"]}
    for name, df in out.items():
        if check and digest(df) != manifest["outputs"][name]:
            raise ValueError(f"{name} of version {version} is not what was published")
    return out


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Remove all versions but the current one, and return their names; not to be run beside a writer."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, keep, gone = top.getFileSystem(spark._jsc.hadoopConfiguration()), current(spark, path), []
    for f in fs.listStatus(top):
        name = f.getPath().getName()
        if name not in (keep, "CURRENT") and not name.startswith(".CURRENT."):
            fs.delete(f.getPath(), True)
            gone.append(name)
    return gone


def score_outputs(scored: DataFrame, metrics: DataFrame, groups: DataFrame) -> dict[str, DataFrame]:
    """The five outputs of a scoring run: rows, metrics, groups, and the retrieval columns of the last two by name.

    A retrieval column speaks of recall, precision, hits, ranks, coverage or intrusion; keys are the columns that are not numbers.
    """
    words = ("recall", "precision", "hit", "full", "mrr", "ndcg", "coverage", "intrusion", "discrimination", "clean")

    def retrieval(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        return df.select(*(c for c in df.columns if kinds[c] == "string" or any(w in c for w in words)))

    return {"scored": scored, "metrics": metrics, "groups": groups, "retrieval_metrics": retrieval(metrics), "retrieval_groups": retrieval(groups)}
